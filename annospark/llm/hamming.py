"""Approximate nearest neighbours by multi-index hashing.

*Codes.*  Vectors are scaled by the largest norm and get one more component that
makes all norms 1, so the largest inner product is the smallest angle.  A code is
the signs after learned rotations (iterative quantization: a rotation and the
signs of a bounded sample are fitted to each other in turn).  A query's code
comes from the query with 0 in the added component.

*Index.*  Codes are split into substrings of 16 bits, and in every block of rows
each substring has a table from its value to the rows that have it.  Two codes
within radius r agree within ``r // m`` bits in one of m substrings, and within one
bit less in all substrings after the first ``r % m + 1`` (pigeonhole), so probing the
values within these radii finds every code within r; those are checked on the whole
code and ranked by their inner products in double precision.

*Radius.*  A bounded sample of queries is compared with all rows; the radius is
the one within which ``target`` of their true neighbours lie.  A query that finds
fewer than k rows asks again with a wider radius, in the end with all.

*Spark.*  Equal vectors are one row with the smallest ids, found before anything
else.  Rows and queries are dealt into blocks of fixed size, and each pair of
blocks meets in one task, which keeps the k best of each query.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import stored

BITS, PIECE = 128, 16
FIT_ROWS, FIT_STEPS = 4096, 30   # sample that the rotations are fitted to
TRIED, TARGET = 128, 0.985       # sample of queries that sets the radius, share of their neighbours within it
BLOCK_ROWS, BLOCK_QUERIES = 65536, 16384


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) without null and zero vectors and those that hold nulls or non-finite components."""
    kind = rows.schema[vec_col].dataType.elementType.simpleString()
    vec = F.col(vec_col).cast(f"array<{'float' if kind == 'float' else 'double'}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))


def distinct_vectors(usable: DataFrame, k: int) -> DataFrame:
    """(vh, vec, ids): the vectors with their k + 1 smallest ids (nulls last), all that a result can name."""
    same = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    few = usable.withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"])
    return few.groupBy("vec").agg(ids.alias("ids")).withColumn("vh", F.monotonically_increasing_id())


def learn_rotations(sample: np.ndarray, bits: int = BITS, steps: int = FIT_STEPS) -> np.ndarray:
    """(dimensions, bits) of stacked rotations, each fitted to the signs that it gives on the sample."""
    n, dim = sample.shape
    rng = np.random.default_rng(11)
    parts = []
    for start in range(0, bits, dim):
        wide = min(dim, bits - start)
        rot = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :wide]
        for _ in range(steps):
            signs = np.where(sample @ rot >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ signs, full_matrices=False)
            rot = u @ v
        parts.append(rot)
    return np.concatenate(parts, axis=1)


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(rows, bits / 16) substrings of the sign codes."""
    return np.packbits(vectors @ rotations >= 0, axis=1).view(np.uint16)


def scaled(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Rows of norm 1: divided by the largest norm, and one component for the rest."""
    x = vectors / largest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]], axis=1)


def directions(queries: np.ndarray) -> np.ndarray:
    """Queries of norm 1 (by their largest component first, so that squares stay finite), with 0 added."""
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def masks(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits set."""
    if radius < 0:
        return np.empty(0, np.uint16)
    if radius >= PIECE:
        return np.arange(1 << PIECE, dtype=np.uint16)
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(PIECE), r)], np.uint16)


class BlockIndex:
    """Tables from substring values to the rows of a block."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.rows = [np.argsort(code[:, s], kind="stable") for s in range(code.shape[1])]
        self.starts = [np.searchsorted(code[r, s], np.arange((1 << PIECE) + 1)) for s, r in enumerate(self.rows)]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose codes are within ``radius`` of the query's code, and their distances."""
        n, m = self.code.shape
        found = np.zeros(n, bool)
        for s in range(m):
            probe = masks_of(radius // m - (s > radius % m)) ^ query[s]
            low, high = self.starts[s][probe], self.starts[s][probe.astype(np.int64) + 1]
            low, size = low[high > low], (high - low)[high > low]
            if len(low):
                at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                found[self.rows[s][at]] = True
        rows = np.flatnonzero(found)
        distance = np.bitwise_count(self.code[rows] ^ query).sum(axis=1, dtype=np.int64)
        return rows[distance <= radius], distance[distance <= radius]


_MASKS: dict[int, np.ndarray] = {}


def masks_of(radius: int) -> np.ndarray:
    radius = max(-1, min(radius, PIECE))
    if radius not in _MASKS:
        _MASKS[radius] = masks(radius)
    return _MASKS[radius]


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, the same wherever a vector stands."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def best(x: np.ndarray, query: np.ndarray, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k rows of largest inner product, ties by the smaller id."""
    rough = x @ query
    at = np.arange(len(x))
    if len(x) > k:
        spare = 1e-11 * np.abs(x).max() * np.abs(query).sum()  # far above the rounding of the rough products
        at = np.flatnonzero(~(rough < np.partition(rough, len(x) - k)[len(x) - k] - spare))
    score = inner(x[at], query)
    order = np.lexsort((first_id[at], -score))[:k]
    return at[order], score[order]


def probed(queries: DataFrame, vectors: DataFrame, rotations: np.ndarray, largest: float, radius: int, k: int,
           n_rows: int, n_queries: int) -> DataFrame:
    """(qh, vh, score, distance): of every query (qh, vec) and block of rows the k best distinct vectors within the radius."""
    context = queries.sparkSession.sparkContext
    row_blocks = max(1, math.ceil(n_rows / BLOCK_ROWS))
    query_blocks = max(context.defaultParallelism, math.ceil(n_queries / BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("qh", "vec", F.pmod(F.xxhash64("qh"), F.lit(query_blocks)).cast("int").alias("qb"),
                           each(row_blocks).alias("rb"))
    base = vectors.select("vh", "vec", F.coalesce(F.get("ids", F.lit(0)), F.lit((1 << 63) - 1)).alias("first"),
                          F.pmod(F.xxhash64("vh"), F.lit(row_blocks)).cast("int").alias("rb"), each(query_blocks).alias("qb"))
    sent = context.broadcast(rotations)

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        qh, vh, score, distance = [], [], [], []
        if q.num_rows and v.num_rows:
            x, y = _matrix(v.column("vec")), _matrix(q.column("vec"))
            ids, first = (np.asarray(v.column(c), np.int64) for c in ("vh", "first"))
            index = BlockIndex(codes(scaled(x, largest), sent.value))
            code = codes(directions(y), sent.value)
            for i, name in enumerate(q.column("qh").to_pylist()):
                rows, far = index.within(code[i], radius)
                at, s = best(x[rows], y[i], first[rows], k)
                qh.append(np.full(len(at), name, np.int64))
                vh.append(ids[rows[at]])
                score.append(s)
                distance.append(far[at])
        column = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"qh": column(qh, pa.int64()), "vh": column(vh, pa.int64()), "score": column(score, pa.float64()),
                         "distance": column(distance, pa.int64())})

    return (asked.groupBy("qb", "rb").cogroup(base.groupBy("qb", "rb"))
            .applyInArrow(meet, "qh long, vh long, score double, distance long"))


def nearest(rows: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that meets ``queries`` the k rows of largest inner product found.

    Candidates are all rows but the query's own; ties go to the smaller id, null
    ids last.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do those of another length than most (ties: the longer).
    Rows that repeat are rows of their own, as candidates and as queries.  With
    fewer than k candidates all are returned; without queries or vectors there are
    no rows.  Extra columns are ignored.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), queries.alias("asks"))
    usable = usable_vectors(named, "id", "vec")
    length = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return none
    usable = usable.where(F.size("vec") == length["d"])
    vectors = stored(distinct_vectors(usable, k), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n_rows, n_ids, largest = vectors.agg(F.count("*"), F.sum(F.size("ids")), F.max(norm)).first()
    asking = usable_vectors(named.where(F.col("asks")), "id", "vec").where(F.size("vec") == length["d"])
    askers = stored(asking.join(vectors.select("vec", F.col("vh").alias("qh")), "vec").select(F.col("id").alias("query_id"), "qh"), "askers")
    rest = stored(askers.select("qh").distinct().join(vectors.select(F.col("vh").alias("qh"), "vec"), "qh"), "queries")
    n_queries = rest.count()
    if not n_queries:
        return none
    sample = vectors.orderBy(F.xxhash64("vec"), "vh").limit(FIT_ROWS).select("vec").toArrow()
    rotations = learn_rotations(scaled(_matrix(sample.column("vec")), largest))
    rank = Window.partitionBy("qh").orderBy(F.col("score").desc(), F.get("ids", F.lit(0)).asc_nulls_last(), "vh")

    def search(asked: DataFrame, radius: int, n: int) -> DataFrame:
        """The k + 1 best vectors of each query, as its own row may be the first of one."""
        met = probed(asked, vectors, rotations, largest, radius, k + 1, n_rows, n)
        return (met.join(vectors.select("vh", "ids"), "vh").withColumn("at", F.row_number().over(rank))
                .where(F.col("at") <= k + 1))

    tried = stored(rest.orderBy(F.xxhash64("vec"), "qh").limit(TRIED), "tried")
    true = search(tried, BITS, TRIED).where("vh <> qh").agg(F.percentile("distance", F.lit(TARGET)).alias("r")).first()["r"]
    radius = math.ceil(true) if true is not None else BITS
    found = None
    while True:
        got = stored(search(rest, radius, n_queries).select("qh", "vh", "score", "ids"), "found")
        enough = got.groupBy("qh").agg(F.sum(F.size("ids")).alias("c")).where(F.col("c") >= min(k + 1, n_ids)).select("qh")
        full = got if radius >= BITS else got.join(enough, "qh", "left_semi")
        found = full if found is None else found.unionByName(full)
        if radius >= BITS:
            break
        rest = stored(rest.join(enough, "qh", "left_anti"), "queries")
        n_queries = rest.count()
        if not n_queries:
            break
        radius = min(BITS, radius + PIECE)
    row = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("vh").alias("vh"))
    lists = (found.select("qh", "vh", "score", F.explode("ids").alias("id")).groupBy("qh")
             .agg(F.slice(F.array_sort(F.collect_list(row)), 1, k + 1).alias("rows")))
    own = F.array_position(F.transform("rows", lambda r: (r["vh"] == F.col("qh")) & r["id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("rows", lambda r, i: i + 1 != F.col("own")), 1, k)
    return (askers.join(lists, "qh").withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "r"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.s")).alias("score")))
