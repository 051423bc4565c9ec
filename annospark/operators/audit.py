"""Score and dataset audits.

Dense semantics are kept without building the dense grid: a cell that is
absent from a sparse score table is a zero, so zero counts are
``entities x terms - present cells`` and enter histograms as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.functions import stats
from annospark.session import cut_lineage


def evidence_histogram(rows: DataFrame, evidence: str = "evidence") -> DataFrame:
    """A10: rows and distinct entities per evidence code."""
    return rows.groupBy(evidence).agg(F.count("*").alias("rows"),
                                      F.countDistinct("entity_id").alias("entities"))


def dense_score_distribution(scores: DataFrame, n_cells: int | Column) -> DataFrame:
    """Min / p01 / p05 / p50 / p95 / p99 / max / mean over the dense grid
    of ``n_cells`` cells where absent cells are 0 (exact, linear quantiles)."""
    hist = scores.groupBy(F.col("score").alias("v")).agg(F.count("*").alias("c"))
    n = n_cells if isinstance(n_cells, Column) else F.lit(int(n_cells))
    zeros = scores.agg(F.lit(0.0).alias("v"), (n - F.count("*")).alias("c"))
    h = hist.unionByName(zeros).groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") > 0)
    extra = {"min": F.min("v"), "max": F.max("v"), "mean": F.sum(F.col("v") * F.col("c")) / F.sum("c")}
    q = stats.histogram_quantiles(h, "v", "c", {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95,
                                                "p99": 0.99}, extra=extra)
    return q.select("min", "p01", "p05", "p50", "p95", "p99", "max", "mean")


def spike_audit(scores: DataFrame, n_cells: int | Column, eps: float = 1e-6) -> DataFrame:
    """Share of dense cells within ``eps`` of 0, 0.5 and 1, and in
    [0.49, 0.51] and [0.99, 1]; absent cells count as exact zeros."""
    s = F.col("score")
    present = F.count("*")
    n = n_cells if isinstance(n_cells, Column) else F.lit(float(n_cells))
    return scores.agg(
        ((F.count_if(F.abs(s) <= eps) + (n - present)) / n).alias("near_0"),
        (F.count_if(F.abs(s - 0.5) <= eps) / n).alias("near_half"),
        (F.count_if(F.abs(s - 1.0) <= eps) / n).alias("near_1"),
        (F.count_if((s >= 0.49) & (s <= 0.51)) / n).alias("band_half"),
        (F.count_if((s >= 0.99) & (s <= 1.0)) / n).alias("band_top"))


def count_above_threshold(scores: DataFrame, thr: float) -> DataFrame:
    """Positives at ``score >= thr``, terms and entities with any."""
    p = scores.filter(F.col("score") >= thr)
    return p.agg(F.count("*").alias("positives"), F.countDistinct("term_id").alias("terms"),
                 F.countDistinct("entity_id").alias("entities"))


def prediction_diversity(pred: DataFrame, n_entities: int | Column) -> DataFrame:
    """Distinct predicted term sets / entities and distinct terms per aspect.

    A set is known by its size and two 64-bit hashes of its distinct terms, xor-ed in any order and partly before
    the shuffle, so no entity's terms are gathered (two of n sets fall together with a chance of n^2 / 2^129).
    """
    terms = pred.select("entity_id", "term_id").distinct()
    hashes = [F.when(F.col("term_id").isNotNull(), F.xxhash64(F.lit(seed), "term_id")) for seed in (0, 1)]
    sets = terms.groupBy("entity_id").agg(F.struct(F.count("term_id"), *map(F.bit_xor, hashes)).alias("ts"))
    n = n_entities if isinstance(n_entities, Column) else F.lit(float(n_entities))
    d = sets.agg((F.countDistinct("ts") / n).alias("set_diversity"))
    per = pred.groupBy("aspect").agg(F.countDistinct("term_id").alias("terms"))
    return per.select("aspect", "terms", d.scalar().alias("set_diversity"))


def rank_correlation(cells: DataFrame, a: str = "y", b: str = "score") -> DataFrame:
    """Spearman correlation (average ranks for ties) of two columns.

    The cells are counted once by the pair of values; ranks come from the
    histograms of each value numbered with ``group_positions``, and joins and
    sums take one row per distinct pair, so a frequent value (0.0) is no hot key."""
    joint = cut_lineage(cells.groupBy(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).agg(F.count("*").alias("n")))

    def avg_rank(col: str) -> DataFrame:
        h = joint.groupBy(F.col(col).alias("v")).agg(F.sum("n").alias("c"))
        h = h.withColumn("_g", F.lit(0))
        h = stats.group_positions(h, ["_g"], ["v"], out="start", weight="c").drop("_g")
        return h.select(F.col("v").alias(col), (F.col("start") + (F.col("c") + 1) / 2.0).alias(f"r_{col}"))
    x = joint.join(avg_rank(a), a).join(avg_rank(b), b)
    total = joint.agg(F.sum("n")).scalar()  # the mean rank is (total + 1) / 2
    da, db = (F.col(f"r_{c}") - (total + 1) / 2.0 for c in (a, b))
    s = x.agg(F.sum(F.col("n") * da * db).alias("ab"), F.sum(F.col("n") * da * da).alias("aa"), F.sum(F.col("n") * db * db).alias("bb"))
    return s.select(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))).alias("spearman"))


def null_aware_term_stats(wide: DataFrame, value: str) -> DataFrame:
    """Per term mean over non-NULL cells and the NULL rate."""
    return wide.groupBy("term_id").agg(F.avg(value).alias("mean"),
                                       F.avg(F.col(value).isNull().cast("double")).alias("null_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value including NULL."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def row_stats_histogram(row_stats: DataFrame, col: str = "row_max", bins: int = 10) -> DataFrame:
    """Histogram of a per-entity statistic over [0, 1] in ``bins`` bins."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int")
    return row_stats.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# Preference order of external-evidence file names (most
# preferred first) and the preferred suffix.
SOURCE_PREFERENCE = ("goa_filtered_all", "goa_filtered_iea", "all", "iea")
PREFERRED_SUFFIX = ".tsv.gz"


def choose_best_source(listing: DataFrame, group: str = "kind") -> DataFrame:
    """Pick one candidate file per group: names are ranked by the first
    ``SOURCE_PREFERENCE`` pattern they contain (others last), then the
    preferred suffix before other suffixes, then path."""
    name = F.lower(F.element_at(F.split(F.col("path"), "/"), -1))
    rank = F.lit(len(SOURCE_PREFERENCE))
    for i, pat in reversed(list(enumerate(SOURCE_PREFERENCE))):
        rank = F.when(name.contains(pat), F.lit(i)).otherwise(rank)
    suf = F.when(name.endswith(PREFERRED_SUFFIX), 0).otherwise(1)
    w = Window.partitionBy(group).orderBy(rank, suf, F.col("path"))
    return listing.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def artefact_inventory(required: DataFrame, present: DataFrame) -> DataFrame:
    """Per required artefact whether it exists and its size; plus totals."""
    p = present.select(F.col("name"), F.col("length").alias("bytes"))
    j = required.select("name").join(p, "name", "left")
    return j.select("name", F.col("bytes").isNotNull().alias("exists"), "bytes")


def stage_manifest(listing: DataFrame, stage: str, note: str) -> DataFrame:
    """Manifest rows ``(stage, path, bytes, ts_utc, note)`` for a stage's files."""
    return listing.select(F.lit(stage).alias("stage"), "path", F.col("length").alias("bytes"),
                          F.date_format(F.col("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"),
                          F.lit(note).alias("note"))
