"""Exact top-k cosine join and neighbour label transfer.

``knn_join`` is a block nested-loop join: rows of both sides are hashed
into blocks of bounded size, every (query block, base block) pair meets in
one Arrow-batched pandas task that runs a numpy GEMM and keeps only the
per-query top-k of that base block; a ``row_number() <= k`` window (which
Spark plans as a partial + final WindowGroupLimit) merges the block
winners.  No task ever holds more than one block of each side and no
all-pairs relation is emitted.  ``pruned_knn_join`` gives the same rows and
leaves out the clusters of base rows that an angle bound rules out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.session import cut_lineage

NEG = -np.inf


def _block_topk(k: int, use_fold: bool, exclude_self: bool, chunk: int = 1024):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": left["qid"].iloc[:0], "base_id": right["bid"].iloc[:0],
                              "sim": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("bid", kind="stable")  # ties at the k-th value go to the least ids
        Bm = np.stack(right["bvec"].to_numpy()).astype(np.float64)
        Bm /= np.maximum(np.linalg.norm(Bm, axis=1), 1e-12)[:, None]
        bid = right["bid"].to_numpy()
        bfold = right["bfold"].to_numpy() if use_fold else None
        outs = []
        for s in range(0, len(left), chunk):
            part = left.iloc[s:s + chunk]
            Qm = np.stack(part["qvec"].to_numpy()).astype(np.float64)
            Qm /= np.maximum(np.linalg.norm(Qm, axis=1), 1e-12)[:, None]
            sims = Qm @ Bm.T
            qid = part["qid"].to_numpy()
            if use_fold:
                sims[part["qfold"].to_numpy()[:, None] == bfold[None, :]] = NEG
            if exclude_self:
                sims[qid[:, None] == bid[None, :]] = NEG
            m = sims.shape[1]
            if m > k:
                kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                keep = (sims >= kth[:, None]) & np.isfinite(sims)
                tied = np.flatnonzero(keep.sum(axis=1) > k)
                if len(tied):
                    above = sims[tied] > kth[tied, None]
                    equal = keep[tied] & ~above
                    room = k - above.sum(axis=1, keepdims=True)
                    keep[tied] = above | (equal & (equal.cumsum(axis=1) <= room))
            else:
                keep = np.isfinite(sims)
            qi, bi = np.nonzero(keep)
            outs.append(pd.DataFrame({"query_id": qid[qi], "base_id": bid[bi], "sim": sims[qi, bi]}))
        return pd.concat(outs, ignore_index=True) if outs else empty
    return fn


def knn_join(query: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id",
             vec_col: str = "embedding", fold_col: str | None = None,
             exclude_self: bool = True, block_rows: int = 4096, query_rows: int = 16384) -> DataFrame:
    """Exact k nearest base rows per query by cosine similarity.

    Output ``(query_id, base_id, sim, rank)``, rank 1..k ordered by
    ``sim desc, base_id asc``.  With ``fold_col`` a query never matches a
    base row of its own fold; with ``exclude_self`` never itself.

    Base rows go to every query block and the reverse, so query blocks are
    wide (``query_rows``; multiplied 1024 at a time): the base is copied once
    per ``query_rows`` queries.  A block gives at most k rows per query, also
    when many base rows tie.
    """
    id_type = query.schema[id_col].dataType
    qcols = [F.col(id_col).alias("qid"), F.col(vec_col).alias("qvec")]
    bcols = [F.col(id_col).alias("bid"), F.col(vec_col).alias("bvec")]
    if fold_col:
        qcols.append(F.col(fold_col).alias("qfold"))
        bcols.append(F.col(fold_col).alias("bfold"))
    nq = max(1, math.ceil(query.count() / query_rows))
    nb = max(1, math.ceil(base.count() / block_rows))
    q = (query.select(*qcols)
         .withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("long"))
         .withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long")))))
    b = (base.select(*bcols)
         .withColumn("bb", F.pmod(F.xxhash64("bid"), F.lit(nb)).cast("long"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long")))))
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("base_id", id_type),
                           T.StructField("sim", T.DoubleType())])
    cand = (q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb"))
            .applyInPandas(_block_topk(k, fold_col is not None, exclude_self), schema))
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("base_id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join_without_folds(query: DataFrame, base: DataFrame, k: int, folds: list[int], fold_col: str = "fold", id_col: str = "vec_id",
                           vec_col: str = "embedding", exclude_self: bool = True, block_rows: int = 4096, query_rows: int = 16384) -> DataFrame:
    """``(without, query_id, base_id, sim, rank)``: for every fold the k nearest base rows of the other folds.

    The vectors meet once, whatever the number of folds: the k nearest outside a fold are among the k nearest of every
    other fold.  Base rows without a fold take no part.
    """
    f = F.col(fold_col).cast("int")
    base = base.filter(f.isNotNull())
    own = sorted(r["f"] for r in base.select(f.alias("f")).distinct().collect())  # a row per fold
    best = None
    for o in own:
        n = knn_join(query, base.filter(f == o), k, id_col, vec_col, None, exclude_self, block_rows, query_rows).withColumn("of", F.lit(o))
        best = n if best is None else best.unionByName(n)
    if best is None:
        best = knn_join(query, base, k, id_col, vec_col, None, exclude_self, block_rows, query_rows).withColumn("of", F.lit(0))
    others = F.filter(F.array(*[F.lit(o) for o in folds]), lambda o: o != F.col("of"))
    each = best.select("query_id", "base_id", "sim", F.explode(others).alias("without"))
    w = Window.partitionBy("without", "query_id").orderBy(F.col("sim").desc(), F.col("base_id"))
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_label_transfer(neigh: DataFrame, labels: DataFrame, label_entity: str = "entity_id",
                             term_col: str = "term_id", ia: DataFrame | None = None,
                             clip_sims: bool = False, denom_floor: float | None = None,
                             denom_eps: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Similarity-weighted vote (J9; J12 with ``ia``).

    ``score(q, t) = sum(sim * [neighbour has t] [* ia_t]) / denom(q)`` with
    ``denom(q) = sum of sim over all k neighbours`` (+ ``denom_eps``), or
    ``max(denom, denom_floor)`` when a floor is given.  Output
    ``(query_id, term_id, score)``, for each value of the ``by`` columns; terms no neighbour carries are absent.
    """
    of = [*(by or []), "query_id"]
    sim = F.least(F.greatest(F.col("sim"), F.lit(0.0)), F.lit(1.0)) if clip_sims else F.col("sim")
    n = neigh.select(*of, "base_id", sim.alias("sim"))
    n = n.withColumn("denom", F.sum("sim").over(Window.partitionBy(*of)) + F.lit(denom_eps))
    if denom_floor is not None:
        n = n.withColumn("denom", F.greatest(F.col("denom"), F.lit(denom_floor)))
    lab = labels.select(F.col(label_entity).alias("base_id"), F.col(term_col).alias("term_id")).distinct()
    j = n.join(lab, "base_id")
    w = F.col("sim")
    if ia is not None:
        j = j.join(ia.select("term_id", "ia"), "term_id", "left")
        w = w * F.coalesce(F.col("ia"), F.lit(0.0))
    out = j.groupBy(*of, "term_id").agg((F.sum(w) / F.first("denom")).alias("score"))
    return out


def mixed_k_transfer(neigh: DataFrame, labels: DataFrame, k_by_aspect: dict[str, int],
                     label_entity: str = "entity_id", eps: float = 1e-9) -> DataFrame:
    """Per-aspect k (J10): neighbours ranked ``<= k_aspect`` vote for that aspect's terms.

    ``labels`` carries ``(entity_id, term_id, aspect)``.  Each neighbour row
    is expanded to the aspects whose k covers its rank (a generate, no
    join); the denominator per (query, aspect) sums the sims of the first
    k_aspect neighbours, plus ``eps``.
    """
    ks = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(int(k)).alias("k"))
                   for a, k in k_by_aspect.items()])
    n = neigh.select("query_id", "base_id", "sim",
                     F.explode(F.filter(ks, lambda x: F.col("rank") <= x["k"])).alias("a"))
    n = n.select("query_id", "base_id", "sim", F.col("a.aspect").alias("aspect"))
    n = n.withColumn("denom", F.sum("sim").over(Window.partitionBy("query_id", "aspect")) + F.lit(eps))
    lab = labels.select(F.col(label_entity).alias("base_id"), "term_id", "aspect").distinct()
    j = n.join(lab, ["base_id", "aspect"])
    return j.groupBy("query_id", "term_id", "aspect").agg(
        (F.sum("sim") / F.first("denom")).alias("score"))


def baseline_vote(neigh: DataFrame, labels: DataFrame, label_entity: str = "entity_id") -> DataFrame:
    """``sum(sim)`` per (query, term) divided by the query's maximum."""
    lab = labels.select(F.col(label_entity).alias("base_id"), "term_id").distinct()
    s = neigh.join(lab, "base_id").groupBy("query_id", "term_id").agg(F.sum("sim").alias("votes"))
    mx = F.max("votes").over(Window.partitionBy("query_id"))
    return s.select("query_id", "term_id", (F.col("votes") / mx).alias("score"))


def max_neighbour_similarity(neigh: DataFrame) -> DataFrame:
    """Per-query maximum similarity."""
    return neigh.groupBy("query_id").agg(F.max("sim").alias("max_sim"))


# ------------------------------------------------------------------ pruned

PLACE_ROWS = 8192      # base rows of a block in the second pass
BROADCAST_PAIRS = 1_000_000  # (query block, base block) pairs
MAX_PIVOTS = 4096  # vectors and cluster sizes that go to every task and through the driver


@dataclass
class Clusters:
    """Pivots, and for each the widest angle of a base row to it, its base rows and its base blocks."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    place: np.ndarray   # first of its places (blocks of base rows, of one large or several small clusters)
    places: np.ndarray  # their number


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def _nearest_pivot(df: DataFrame, vec_col: str, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``home`` and the angle to it.  A zero vector is at a right angle to all."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*df.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(frames):
        for pdf in frames:
            if len(pdf):
                sims = _units(pdf[vec_col]) @ sent.value.T
                home = sims.argmax(axis=1)
                yield pdf.assign(home=home.astype(np.int32),
                                 angle=np.arccos(np.clip(sims[np.arange(len(home)), home], -1.0, 1.0)))
    return df.mapInPandas(run, schema)


def _packed(rows: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cluster: large ones are cut, small neighbours in the order share one."""
    first, count = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // block_rows))
    block, held = 0, 0
    for c, n in enumerate(rows):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[c] = block
        held += n
        if count[c] > 1:
            block, held = block + int(count[c]), 0
    return first, count


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each follows the nearest one before it, so that neighbours share blocks."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        sims = np.where(left, pivots @ pivots[order[-1]], NEG)
        order.append(int(sims.argmax()))
        left[order[-1]] = False
    return pivots[order]


def _opened_clusters(asked: DataFrame, clusters: Clusters) -> DataFrame:
    """``asked`` with ``clusters``, those besides its home that may hold one of a query's k nearest, and ``places``, their
    blocks and those of its home.

    The angle from a query to a row of a cluster is at least the angle to its pivot less its radius; a cluster
    is left out only if that exceeds the angle of the k-th neighbour found at home (none found: pi)."""
    sent = asked.sparkSession.sparkContext.broadcast(clusters)

    def run(frames):
        known = sent.value
        for pdf in frames:
            if not len(pdf):
                continue
            angle = np.arccos(np.clip(_units(pdf["qvec"]) @ known.pivots.T, -1.0, 1.0))
            limit = np.arccos(np.clip(pdf["kth"].fillna(-1.0).to_numpy(), -1.0, 1.0))
            may = (angle - known.radius[None, :] <= limit[:, None] + 1e-6) & (known.rows > 0)[None, :]
            home = pdf["home"].to_numpy()
            may[np.arange(len(pdf)), home] = False
            away = [np.flatnonzero(m).astype(np.int32) for m in may]
            may[np.arange(len(pdf)), home] = known.rows[home] > 0
            at = [np.unique(np.concatenate([np.arange(known.place[c], known.place[c] + known.places[c], dtype=np.int32)
                                            for c in np.flatnonzero(m)] or [np.zeros(0, np.int32)])) for m in may]
            yield pdf.assign(clusters=away, places=at)
    ints = T.ArrayType(T.IntegerType())
    return asked.mapInPandas(run, T.StructType([*asked.schema.fields, T.StructField("clusters", ints), T.StructField("places", ints)]))


def pruned_knn_join(query: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                    fold_col: str | None = None, exclude_self: bool = True, block_rows: int = 4096,
                    query_rows: int = 16384, n_pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`knn_join` (J8) without the clusters that cannot hold a neighbour; exact as well.

    Returns the neighbours and ``opened``, the distinct (query id, cluster) pairs met in the second pass.
    Rows without a vector take no part.

    ``n_pivots`` base rows (one per ``block_rows``, at most ``MAX_PIVOTS``; the first in hash order of the id) are
    pivots, and every base row belongs to the nearest one.  A query first meets the cluster of its own nearest
    pivot; the k-th similarity found there bounds, by the triangle inequality of angles, which other clusters it has
    to meet.  Large clusters are cut by a hash of the id into blocks of about ``PLACE_ROWS`` rows (``block_rows``
    in the first pass) and the queries of a home into blocks of ``query_rows``, so no cluster, however large, is one
    task; small clusters, and the queries of homes, that follow each other in a chain of near pivots share a block.
    A base block is shipped to those query blocks alone in which some query opens one of its clusters, and there meets
    only those queries.  Work follows the data: vectors in clusters open few; vectors spread evenly over many
    dimensions open nearly all, and then as much is shipped as by :func:`knn_join` with blocks of these sizes.
    """
    id_type = query.schema[id_col].dataType
    pick = [F.col(vec_col).isNotNull()]
    base, query = base.filter(*pick), query.filter(*pick)
    if n_pivots is None:
        n_pivots = min(MAX_PIVOTS, max(1, math.ceil(base.count() / block_rows)))
    first = base.orderBy(F.xxhash64(id_col), id_col).limit(n_pivots).select(F.col(vec_col).alias("v")).toPandas()  # the bound
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("base_id", id_type),
                           T.StructField("sim", T.DoubleType())])
    if first.empty:
        spark = query.sparkSession
        return (spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])),
                spark.createDataFrame([], T.StructType([T.StructField("qid", id_type), T.StructField("cluster", T.IntegerType())])))
    pivots = _chained(_units(first["v"]))
    fold = [F.col(fold_col)] if fold_col else []
    b = cut_lineage(_nearest_pivot(base.select(F.col(id_col).alias("bid"), F.col(vec_col).alias("bvec"),
                                               *[f.alias("bfold") for f in fold]), "bvec", pivots))
    q = cut_lineage(_nearest_pivot(query.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("qvec"),
                                                *[f.alias("qfold") for f in fold]), "qvec", pivots).drop("angle"))
    sizes = b.groupBy("home").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row per pivot
    asked = dict(q.groupBy("home").count().collect())
    radius, rows = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for row in sizes:
        radius[row["home"]], rows[row["home"]] = row["r"], row["n"]
    clusters = Clusters(pivots, radius, rows, *_packed(rows, max(block_rows, PLACE_ROWS)))
    blocks = np.maximum(1, -(-rows // block_rows))
    first_asked, n_asked = _packed(np.array([asked.get(c, 0) for c in range(len(pivots))]), query_rows)
    parts = query.sparkSession.createDataFrame(
        [(c, *(int(v[c]) for v in (blocks, clusters.place, clusters.places, first_asked, n_asked))) for c in range(len(pivots))],
        "home int, n_blocks int, place int, n_places int, asked int, n_asked int")  # a row per pivot
    parts = F.broadcast(parts)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    b = b.join(parts.select("home", "n_blocks", "place", "n_places"), "home").withColumn("block", hashed("bid", "n_blocks")) \
        .withColumn("place", F.col("place") + hashed("bid", "n_places")).drop("angle", "n_blocks", "n_places").withColumnRenamed("home", "cluster")
    q = q.join(parts.select("home", "asked", "n_asked"), "home").withColumn("qb", F.col("asked") + hashed("qid", "n_asked")).drop("asked", "n_asked")
    of_cluster = parts.select(F.col("home").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    near = _block_topk(k, fold_col is not None, exclude_self)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("base_id"))
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    own, meet = q.withColumn("cluster", F.col("home")), ["cluster", "qb", "block"]
    apart = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in cols]).distinct()  # noqa: E731  (columns apart from the queries')
    blocks_of = apart(own, "cluster", "qb")
    at_home = best(own.join(of_cluster, "cluster").groupBy(*meet).cogroup(b.join(blocks_of, "cluster").groupBy(*meet)).applyInPandas(near, schema))
    kth = at_home.filter(F.col("rank") == k).groupBy(F.col("query_id").alias("qid")).agg(F.max("sim").alias("kth"))
    opened = cut_lineage(_opened_clusters(q.join(kth, "qid", "left"), clusters))
    asks = opened.drop("clusters", "kth", "home").withColumn("place", F.explode("places")).drop("places")
    shipped = apart(asks, "qb", "place")
    met = asks.groupBy("qb", "place").cogroup(b.join(F.broadcast(shipped) if shipped.count() <= BROADCAST_PAIRS else shipped, "place")
                                              .groupBy("qb", "place")).applyInPandas(near, schema)
    return best(met), opened.select("qid", F.explode("clusters").alias("cluster")).distinct()
