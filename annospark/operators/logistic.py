"""One-vs-rest logistic regression, all folds and a block of terms in one pass.

Rows lie in blocks (see :func:`vector_blocks`): a Parquet row holds the vectors,
folds and labels of up to some thousand entities.  A step is one job: each task
adds up the gradients of its blocks for every fold's model, and gives them as
arrays by (fold, slice of features); the slices are summed side by side, and only
the sums, the size of the weights, come to the driver.  The model of fold f learns
from the other folds and scores fold f.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.session import ensure_checkpoint_dir

SLICE = 64            # features whose gradients are summed together
CELLS = 4_000_000     # numbers in a block


@dataclass
class LogisticModel:
    terms: list[str]
    folds: list[int]
    weights: np.ndarray   # (folds, features, terms)
    bias: np.ndarray      # (folds, terms)
    fitted: np.ndarray    # (folds, terms): enough positives outside the fold
    mean: np.ndarray      # (features), what vectors are scaled by
    scale: np.ndarray


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def vector_blocks(x: DataFrame, labels: DataFrame, terms: list[str], fold: F.Column, features: int,
                  key: str = "entity_id", vec: str = "vec") -> DataFrame:
    """(block, keys, fold, x, ys), written to the shared folder."""
    index = F.create_map(*[v for i, t in enumerate(terms) for v in (F.lit(t), F.lit(i))])
    has = (labels.where(F.col("term_id").isin(terms)).groupBy(key)
           .agg(F.collect_set(F.element_at(index, F.col("term_id"))).alias("ys")))
    h = F.xxhash64(F.col(key))
    blocks = max(1, math.ceil(x.count() / max(64, min(4096, CELLS // max(1, features + len(terms))))))
    rows = x.select(key, vec, fold.cast("int").alias("fold"), h.alias("h"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"))
    rows = rows.join(has, key, "left").withColumn("ys", F.coalesce("ys", F.array().cast("array<int>")))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), (key, "ascending")])
        ys = np.zeros((t.num_rows, len(terms)), np.uint8)
        for i, js in enumerate(t.column("ys").to_pylist()):
            ys[i, js] = 1
        cells = {"fold": np.asarray(t.column("fold"), np.int32), "x": _matrix(t.column(vec).combine_chunks()), "ys": ys}
        return pa.table({"block": t.column("block").slice(0, 1), "keys": pa.array([t.column(key).to_pylist()], pa.list_(t.schema.field(key).type)),
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in cells.items()}})

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(x.schema[key].dataType))]
                          + [T.StructField(c, T.BinaryType()) for c in ("fold", "x", "ys")])
    packed = rows.groupBy("block").applyInArrow(pack, schema)
    path = f"{ensure_checkpoint_dir(x.sparkSession).rstrip('/')}/logistic-{uuid.uuid4().hex}"
    packed.write.parquet(path)
    return x.sparkSession.read.schema(schema).parquet(path)


def _unpacked(row: dict, features: int, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.frombuffer(row["fold"], np.int32)
    x = (np.frombuffer(row["x"], np.float64).reshape(len(fold), features) - mean) / scale
    return fold, x, np.frombuffer(row["ys"], np.uint8).reshape(len(fold), -1).astype(np.float64)


def gradient_sums(blocks: DataFrame, m: LogisticModel, positive: np.ndarray, negative: np.ndarray) -> DataFrame:
    """(fold, slice, sums): gradients of the weights by slices of features, of the bias as slice -1, over the rows
    outside each fold; ``positive`` and ``negative`` are the class weights (folds, terms)."""
    features = m.weights.shape[1]

    def run(batches):
        total, bias, first = np.zeros_like(m.weights), np.zeros_like(m.bias), None
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] if first is None else first
                fold, x, y = _unpacked(row, features, m.mean, m.scale)
                for k, f in enumerate(m.folds):
                    use = fold != f
                    p = sigmoid(x[use] @ m.weights[k] + m.bias[k])
                    s = np.where(y[use] > 0, positive[k], negative[k]) * (p - y[use])
                    total[k] += x[use].T @ s
                    bias[k] += s.sum(axis=0)
        if first is None:
            return
        for k, f in enumerate(m.folds):
            parts = [(-1, bias[k]), *((low // SLICE, total[k, low:low + SLICE]) for low in range(0, features, SLICE))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([first] * len(parts), pa.int32()),
                 pa.array([p[1].tobytes() for p in parts], pa.binary())], names=["fold", "slice", "first", "sums"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")  # in one order, whatever arrives first
        total = sum(np.frombuffer(v, np.float64) for v in t.column("sums").to_pylist())
        return pa.table({"fold": t.column("fold").slice(0, 1), "slice": t.column("slice").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    given = blocks.select("block", "fold", "x", "ys").mapInArrow(run, "fold int, slice int, first int, sums binary")
    return given.groupBy("fold", "slice").applyInArrow(add, "fold int, slice int, sums binary")


def ovr_logistic_fit(x: DataFrame, labels: DataFrame, terms: list[str], fold: F.Column, key: str = "entity_id", vec: str = "vec",
                     steps: int = 100, rate: float = 0.5, l2: float = 1e-3, balanced: bool = True, least_positive: int = 2,
                     scaler: pd.DataFrame | None = None) -> tuple[LogisticModel, DataFrame]:
    """L2 logistic regression by full gradient steps, one model per fold and term of a block (at most some hundred terms).

    ``scaler`` has (pos, mean, scale) of every feature (F3).  Terms with fewer than
    ``least_positive`` positives outside a fold have no model there.  Returns the
    model and the blocks, for :func:`out_of_fold`.
    """
    x = x.where(F.col(vec).isNotNull() & fold.isNotNull())
    head = x.select(F.size(vec).alias("d")).first()
    features = head["d"] if head else 0
    sizes = {r["fold"]: r["n"] for r in x.groupBy(fold.cast("int").alias("fold")).agg(F.count("*").alias("n")).collect()}
    folds = sorted(sizes)
    held = (labels.where(F.col("term_id").isin(terms)).select(key, "term_id").distinct().join(x.select(key, fold.cast("int").alias("fold")), key)
            .groupBy("fold", "term_id").agg(F.count("*").alias("n")).collect())
    count = {(r["fold"], r["term_id"]): r["n"] for r in held}
    n = np.array([[sum(sizes[o] for o in folds if o != f)] for f in folds], np.float64)
    pos = np.array([[sum(count.get((o, t), 0) for o in folds if o != f) for t in terms] for f in folds], np.float64)
    ones = np.ones_like(pos)
    positive, negative = (n / (2 * np.maximum(pos, 1)), n / (2 * np.maximum(n - pos, 1))) if balanced else (ones, ones)
    mean, scale = np.zeros(features), np.ones(features)
    if scaler is not None:
        at = scaler["pos"].to_numpy()
        mean[at], scale[at] = scaler["mean"].to_numpy(), scaler["scale"].to_numpy()
    m = LogisticModel(terms, folds, np.zeros((len(folds), features, len(terms))), np.zeros_like(pos), pos >= least_positive, mean, scale)
    blocks = vector_blocks(x, labels, terms, fold, features, key, vec)
    for _ in range(steps):
        g, gb = np.zeros_like(m.weights), np.zeros_like(m.bias)
        for r in gradient_sums(blocks, m, positive, negative).toPandas().itertuples():
            k, sums = folds.index(r.fold), np.frombuffer(r.sums, np.float64)
            if r.slice < 0:
                gb[k] = sums
            else:
                g[k, r.slice * SLICE:(r.slice + 1) * SLICE] = sums.reshape(-1, len(terms))
        m = LogisticModel(terms, folds, m.weights - rate * (g / n[:, :, None] + l2 * m.weights), m.bias - rate * gb / n, m.fitted, mean, scale)
    return m, blocks


def out_of_fold(m: LogisticModel, blocks: DataFrame, key: str = "entity_id") -> DataFrame:
    """(entity_id, term_id, score) of every row under the model that did not see its fold."""
    terms, features = pa.array(m.terms, pa.string()), m.weights.shape[1]

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                fold, x, _ = _unpacked(row, features, m.mean, m.scale)
                keys = batch.column("keys")[i].values
                for k, f in enumerate(m.folds):
                    at, js = np.flatnonzero(fold == f), np.flatnonzero(m.fitted[k])
                    score = sigmoid(x[at] @ m.weights[k][:, js] + m.bias[k][js])
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.repeat(at, len(js)))), terms.take(pa.array(np.tile(js, len(at)))), pa.array(score.ravel())],
                        names=[key, "term_id", "score"])

    schema = T.StructType([T.StructField(key, blocks.schema["keys"].dataType.elementType), T.StructField("term_id", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return blocks.select("block", "keys", "fold", "x", "ys").mapInArrow(run, schema)
