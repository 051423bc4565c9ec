"""Graph stacker out of fold (F11): graph-smoothed level-1 scores, one small logistic model per aspect, fold and seed.

Simplified graph convolution: the powers of the normalised adjacency (G6) are
small term-by-term tables, so all hops of all channels and aspects come from one
join and one aggregate of the scores.  The models, IA-weighted logistic
regressions on some ten features, are fitted together by Newton steps, one job a
step; a task adds up the gradients and Hessians of every model over its rows, and
only those sums, their size set by parameters alone, leave it.  The model of fold
f never sees fold f; seeds are bootstrap draws of the entities, averaged as in A22.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.operators.ontology import CLOSURE_BROADCAST_ROWS
from annospark.session import bounded_broadcast, cut_lineage, ensure_checkpoint_dir

# P(draws <= k) of a Poisson(1) variable for k = 0, 1, 2, 3: how often a bootstrap takes an entity
DRAWS = (0.367879, 0.735759, 0.919699, 0.981012)


def edges_within_aspects(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """The edges whose ends have the same aspect, so that no hop leaves it."""
    a = terms.select("term_id", "aspect")
    return (edges.join(a.select(F.col("term_id").alias("child"), F.col("aspect").alias("ca")), "child")
            .join(a.select(F.col("term_id").alias("parent"), F.col("aspect").alias("pa")), "parent")
            .where(F.col("ca") == F.col("pa")).select("child", "parent"))


def hop_weights(adj: DataFrame, hops: int) -> DataFrame:
    """``(i, j, w0 .. w<hops>)``: entry (i, j) of every power of the adjacency, the identity first."""
    a = adj.select("i", "j", "w")
    powers = [a.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")).distinct()]
    for _ in range(hops):
        p = powers[-1].select("i", F.col("j").alias("m"), F.col("w").alias("v"))
        powers.append(cut_lineage(p.join(a.select(F.col("i").alias("m"), "j", "w"), "m").groupBy("i", "j")
                                  .agg(F.sum(F.col("v") * F.col("w")).alias("w"))))
    rows = powers[0].withColumn("hop", F.lit(0))
    for k, p in enumerate(powers[1:], 1):
        rows = rows.unionByName(p.withColumn("hop", F.lit(k)))
    return rows.groupBy("i", "j").agg(*[F.sum(F.when(F.col("hop") == k, F.col("w")).otherwise(0.0)).alias(f"w{k}")
                                        for k in range(hops + 1)])


def smoothed_channels(wide: DataFrame, channels: list[str], adj: DataFrame, hops: int) -> DataFrame:
    """``(entity_id, term_id, x)``: the channels of F10 after 0 .. ``hops`` hops, for all pairs that the hops reach."""
    w = bounded_broadcast(cut_lineage(hop_weights(adj, hops)), CLOSURE_BROADCAST_ROWS)
    sums = [F.sum(F.col(f"w{k}") * F.col(c)) for k in range(hops + 1) for c in channels]
    return (wide.select("entity_id", F.col("term_id").alias("j"), *channels).join(w, "j")
            .groupBy("entity_id", F.col("i").alias("term_id")).agg(F.array(*sums).alias("x")))


@dataclass
class StackerModel:
    aspects: list[str]
    folds: list[int]
    seeds: int
    weights: np.ndarray  # (aspects, folds, seeds, features + 1), the bias last

    def logits(self, aspect: int, fold: int, x: np.ndarray) -> np.ndarray:
        """(rows, seeds)"""
        w = self.weights[aspect, fold]
        return np.clip(x @ w[:, :-1].T + w[:, -1], -50, 50)


def training_rows(features: DataFrame, truth: DataFrame, ia: DataFrame, terms: DataFrame, aspects: list[str], fold: Column,
                  seeds: int, ia_default: float) -> DataFrame:
    """``(entity_id, term_id, a, fold, x, y, draws)``, written to the shared folder: ``a`` numbers the aspect and
    ``draws`` holds the row's weight (IA times the entity's bootstrap draws) under each seed; seed 0 draws all once."""
    t = truth.select("entity_id", "term_id").distinct().withColumn("y", F.lit(1.0))
    d = features.join(t, ["entity_id", "term_id"], "left")
    info = terms.select("term_id", F.array_position(F.array(*map(F.lit, aspects)), F.col("aspect")).cast("int").alias("a"))
    d = d.join(info.where("a > 0"), "term_id").join(ia.select("term_id", "ia"), "term_id", "left")

    def drawn(seed: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), "entity_id"), F.lit(1_000_000)) / 1e6
        return sum((u >= p).cast("double") for p in DRAWS) if seed else F.lit(1.0)
    weight = F.coalesce("ia", F.lit(float(ia_default)))
    d = d.select("entity_id", "term_id", (F.col("a") - 1).alias("a"), fold.cast("int").alias("fold"), "x",
                 F.coalesce("y", F.lit(0.0)).alias("y"), F.array(*[weight * drawn(s) for s in range(seeds)]).alias("draws"))
    path = f"{ensure_checkpoint_dir(d.sparkSession).rstrip('/')}/stacker-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def step_sums(rows: DataFrame, m: StackerModel) -> DataFrame:
    """``(model, sums)``: gradient and Hessian of every (aspect, fold, seed) model over the rows outside its fold."""
    d = m.weights.shape[-1]
    schema = "model int, part int, sums array<double>"

    def run(batches):
        total, part = np.zeros((len(m.aspects), len(m.folds), m.seeds, d + d * d)), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, fold, y = (np.asarray(batch.column(c), np.float64) for c in ("a", "fold", "y"))
            x = np.column_stack([_matrix(batch.column("x"), n), np.ones(n)])
            w = _matrix(batch.column("draws"), n)
            part = int(a[0]) if part is None else part
            for i in range(len(m.aspects)):
                for k, f in enumerate(m.folds):
                    use = (a == i) & (fold != f)
                    xs = x[use]
                    p = 1.0 / (1.0 + np.exp(-m.logits(i, k, xs[:, :-1])))
                    for s in range(m.seeds):
                        ws = w[use, s]
                        total[i, k, s, :d] += xs.T @ (ws * (p[:, s] - y[use]))
                        total[i, k, s, d:] += (xs.T @ (xs * (ws * p[:, s] * (1 - p[:, s]))[:, None])).ravel()
        if part is not None:
            flat = total.reshape(-1, d + d * d)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([part] * len(flat), pa.int32()),
                                              pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["model", "part", "sums"])

    given = rows.select("a", "fold", "x", "y", "draws").mapInArrow(run, schema)
    at = given.select("model", F.posexplode("sums").alias("pos", "v")).groupBy("model", "pos").agg(F.sum("v").alias("v"))
    return at.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s")) \
        .select("model", F.transform("s", lambda r: r["v"]).alias("sums"))  # d + d^2 numbers


def fit(rows: DataFrame, aspects: list[str], seeds: int, steps: int = 50, ridge: float = 1e-3, tolerance: float = 1e-6) -> StackerModel:
    """All models at once: damped Newton steps until none moves by more than ``tolerance``, at most ``steps``.
    ``ridge`` keeps models finite whose rows are of one class or that have no rows."""
    folds = sorted(r["fold"] for r in rows.select("fold").where("fold IS NOT NULL").distinct().collect())
    head = rows.select(F.size("x").alias("d")).first()
    d = (head["d"] if head else 0) + 1
    m = StackerModel(aspects, folds, seeds, np.zeros((len(aspects), len(folds), seeds, d)))
    for _ in range(steps if folds else 0):
        sums = {r["model"]: np.asarray(r["sums"]) for r in step_sums(rows, m).collect()}  # a row per model
        flat, moved = m.weights.reshape(-1, d).copy(), 0.0
        for k, w in enumerate(flat):
            g, h = sums[k][:d] + ridge * w, sums[k][d:].reshape(d, d) + ridge * np.eye(d)
            step = np.clip(np.linalg.solve(h, g), -4.0, 4.0)
            flat[k], moved = w - step, max(moved, float(np.abs(step).max()))
        m = StackerModel(aspects, folds, seeds, flat.reshape(m.weights.shape))
        if moved <= tolerance:
            break
    return m


def out_of_fold(rows: DataFrame, m: StackerModel) -> DataFrame:
    """``(entity_id, term_id, seed, score)`` of every row under the models that did not see its fold."""
    schema = T.StructType([rows.schema["entity_id"], rows.schema["term_id"], T.StructField("seed", T.IntegerType()),
                           T.StructField("score", T.DoubleType())])
    at = {f: k for k, f in enumerate(m.folds)}

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, a, fold = _matrix(batch.column("x"), n), np.asarray(batch.column("a")), np.asarray(batch.column("fold"))
            score = np.zeros((n, m.seeds))
            for i in range(len(m.aspects)):
                for f, k in at.items():
                    use = (a == i) & (fold == f)
                    score[use] = 1.0 / (1.0 + np.exp(-m.logits(i, k, x[use])))
            rows_at = pa.array(np.repeat(np.arange(n), m.seeds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity_id").take(rows_at), batch.column("term_id").take(rows_at),
                 pa.array(np.tile(np.arange(m.seeds), n), pa.int32()), pa.array(score.ravel())], names=schema.names)

    return rows.select("entity_id", "term_id", "a", "fold", "x").mapInArrow(run, schema)


def graph_stacker(wide: DataFrame, channels: list[str], truth: DataFrame, ia: DataFrame, terms: DataFrame, adj: DataFrame,
                  fold: Column, aspects: tuple[str, ...] = ("BP", "MF", "CC"), hops: int = 2, seeds: int = 3, steps: int = 50,
                  ia_default: float = 1.0) -> DataFrame:
    """``(entity_id, term_id, score)``, out of fold and averaged over the seeds.

    ``wide`` has the level-1 ``channels`` (F10) by (entity, term); ``adj`` is G6 over :func:`edges_within_aspects`;
    ``fold`` is a column of ``entity_id``, and rows whose fold is null are left out.  Pairs that no hop reaches have no row.
    """
    features = smoothed_channels(wide, channels, adj, hops)
    rows = training_rows(features.where(fold.isNotNull()), truth, ia, terms, list(aspects), fold, seeds, ia_default)
    scored = out_of_fold(rows, fit(rows, list(aspects), seeds, steps))
    return scored.groupBy("entity_id", "term_id").agg((F.sum("score") / seeds).alias("score"))
