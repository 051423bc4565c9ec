"""Vector features.

Vectors are ``ARRAY<FLOAT>`` columns; per-dimension statistics explode to
``(pos, value)`` and aggregate with partial aggregation, so no task ever
holds a whole matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.functions import stats, vectors as V


def l2_normalise(df: DataFrame, vec: str, out: str | None = None, floor: float = 1e-12) -> DataFrame:
    """unit-L2 rows (norm floor 1e-12)."""
    return df.withColumn(out or vec, V.l2_normalise(F.col(vec), floor))


def concat_modalities(frames: dict[str, DataFrame], key: str, vec: str, dims: dict[str, int]) -> tuple:
    """equi-join modalities on ``key`` and concatenate their vectors in the
    dict's order; returns ``(features, layout)``.  Rows whose modality has the
    wrong width fail the query (dimension guard)."""
    out = None
    layout, start = [], 0
    for name, df in frames.items():
        d = dims[name]
        checked = df.select(key, F.when(F.size(vec) == d, F.col(vec)).otherwise(
            F.raise_error(F.lit(f"modality {name}: dimension is not {d}"))).alias(name))
        out = checked if out is None else out.join(checked, key)
        layout.append((name, start, start + d))
        start += d
    feats = out.select(key, F.concat(*[F.col(n) for n in frames]).alias("features"))
    spark = next(iter(frames.values())).sparkSession
    return feats, spark.createDataFrame(layout, "modality string, start int, end int")


def one_hot_index(*frames: DataFrame, col: str = "taxon_id") -> DataFrame:
    """category index over the union of all frames, ascending category."""
    cats = None
    for f in frames:
        c = f.select(col).distinct()
        cats = c if cats is None else cats.unionByName(c).distinct()
    cats = cats.withColumn("_g", F.lit(0))
    return stats.group_positions(cats, ["_g"], [col], out="col_idx").drop("_g") \
        .withColumn("col_idx", F.col("col_idx").cast("int"))


def one_hot(df: DataFrame, index: DataFrame, col: str = "taxon_id", dim: int | None = None) -> DataFrame:
    """one-hot vector per row; categories missing from the index give zeros."""
    j = df.join(index, col, "left")
    n = dim if dim is not None else index.count()
    v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda i: F.when(i == F.col("col_idx"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return j.withColumn("onehot", v.cast("array<float>")).drop("col_idx")


def exploded(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("pos", "value"))


def standard_scaler_fit(df: DataFrame, vec: str) -> DataFrame:
    """per-dimension mean and population std; zero variance -> scale 1."""
    e = df.select(F.posexplode(vec).alias("pos", "value"))
    s = e.groupBy("pos").agg(F.avg(F.col("value").cast("double")).alias("mean"),
                             F.stddev_pop(F.col("value").cast("double")).alias("std"))
    return s.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def standard_scaler_transform(df: DataFrame, key: str, vec: str, fitted: DataFrame, eps: float = 0.0) -> DataFrame:
    """``(x - mean) / (scale + eps)`` as a long ``(key, pos, value)`` table."""
    e = exploded(df, key, vec).join(F.broadcast(fitted.select("pos", "mean", "scale")), "pos")
    return e.select(key, "pos", ((F.col("value") - F.col("mean")) / (F.col("scale") + eps)).alias("value"))


def masked_mean_pool(tokens: DataFrame, group: str, vec: str, mask: str) -> DataFrame:
    """``sum(mask * h) / max(sum(mask), 1)`` per group and dimension."""
    e = tokens.select(group, F.col(mask).cast("double").alias("m"), F.posexplode(vec).alias("pos", "value"))
    return e.groupBy(group, "pos").agg(
        (F.sum(F.col("m") * F.col("value")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("value"))


def length_histogram(df: DataFrame, value: str, lo: float, hi: float, n_edges: int,
                     by: list[str] | None = None) -> DataFrame:
    """Fixed-bin histogram with edges ``linspace(lo, hi, n_edges)``
    (numpy semantics: the last bin is closed, values outside are dropped)."""
    by = by or []
    nb = n_edges - 1
    w = (hi - lo) / nb
    x = F.col(value).cast("double")
    b = F.when(x == hi, F.lit(nb - 1)).otherwise(F.floor((x - lo) / F.lit(w))).cast("int")
    return df.filter((x >= lo) & (x <= hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def norm_distribution(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """Min / p50 / p95 / max of row L2 norms and of non-zeros per row."""
    by = by or []
    r = df.select(*by, V.l2_norm(F.col(vec)).alias("norm"),
                  F.size(F.filter(vec, lambda x: x != 0)).cast("long").alias("nnz"))
    base = r.groupBy(*by).agg(F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"),
                              F.min("nnz").alias("nnz_min"), F.max("nnz").alias("nnz_max"))
    q1 = stats.exact_quantiles(r, "norm", {"norm_p50": 0.5, "norm_p95": 0.95}, by=by)
    q2 = stats.exact_quantiles(r, "nnz", {"nnz_p50": 0.5, "nnz_p95": 0.95}, by=by)
    if by:
        return base.join(q1, by).join(q2, by)
    s1 = q1.select(F.struct("norm_p50", "norm_p95").alias("s")).scalar()  # one subquery each
    s2 = q2.select(F.struct("nnz_p50", "nnz_p95").alias("s")).scalar()
    return base.select("*", s1.getField("norm_p50").alias("norm_p50"), s1.getField("norm_p95").alias("norm_p95"),
                       s2.getField("nnz_p50").alias("nnz_p50"), s2.getField("nnz_p95").alias("nnz_p95"))


def finite_report(df: DataFrame, vec: str) -> DataFrame:
    """Rows, rows with NaN / Inf, and the maximum absolute value."""
    return df.agg(F.count("*").alias("rows"),
                  F.count_if(V.has_non_finite(F.col(vec))).alias("non_finite_rows"),
                  F.max(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))).alias("max_abs"))


def finite_gate(df: DataFrame, vec: str) -> DataFrame:
    """Pass the rows through, failing the job on any NaN / Inf value or
    when every value is <= 0 (an all-zero / broken feature block)."""
    rep = finite_report(df, vec)
    bad = rep.select(F.when(F.col("non_finite_rows") > 0,
                            F.raise_error(F.concat(F.lit("non-finite rows: "), F.col("non_finite_rows").cast("string"))))
                     .when(F.col("max_abs") <= 0, F.raise_error(F.lit("feature block is all zeros")))
                     .otherwise(F.lit(True)).alias("ok"))
    return df.filter(bad.select("ok").scalar())


def modality_importance(weights: DataFrame, layout: DataFrame) -> DataFrame:
    """Mean |w| per feature column (over all terms), averaged per
    modality range of the layout and normalised to percent.  ``weights`` is
    long ``(term_id, pos, w)``; the layout has one row per modality, so the
    range lookup is a broadcast of a few rows."""
    col = weights.groupBy("pos").agg(F.avg(F.abs("w")).alias("mean_abs"))
    j = col.join(F.broadcast(layout), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    per = j.groupBy("modality").agg(F.avg("mean_abs").alias("importance"))
    total = per.agg(F.sum("importance")).scalar()
    return per.withColumn("percent", F.col("importance") / total * 100.0)


def length_bucket_order(df: DataFrame, length: F.Column, n_parts: int | None = None) -> DataFrame:
    """Longest first — range-partition by length (descending) and sort
    inside partitions, so every batch holds rows of similar length."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_len", length)
    return d.repartitionByRange(n, F.col("_len").desc()).sortWithinPartitions(F.col("_len").desc()) \
        .withColumnRenamed("_len", "length")


def largest_n(listing: DataFrame, n: int, size: str = "bytes") -> DataFrame:
    """The ``n`` largest entries (size desc, path asc) — a top-n report."""
    return listing.orderBy(F.col(size).desc(), F.col("path")).limit(n)
