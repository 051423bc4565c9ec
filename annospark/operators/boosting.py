"""Gradient boosted trees for all elite terms and folds at once.

Features are cut into at most 32 bins.  The rows lie in blocks: a Parquet row
holds the bins, labels and margins of some thousand entities, so a task works on
whole arrays.  One pass over the blocks per tree level sums the gradients by
(fold, term, node, feature, bin); the sums meet by (fold, term, feature group),
where the best split of each node is chosen, and only those splits (the model) come
to the driver.  All terms and all folds share every pass, so the number of jobs is
trees x depth however many terms there are.

A pass shuffles the sums of all models and nodes for each block, whose files go with
the pass (:func:`shuffles_dropped`).  Where the bins of all rows fit (``WHOLE``
bytes), no sums move: the bins are broadcast instead, like a small table of a join, and
the models are dealt over the tasks, each of which grows ``KEPT_TREES`` trees of its
models in a job.  Both ways choose by the same sums, block by block.

The model of fold f learns from the other folds; fold f is its validation set,
whose loss comes with the first pass of the next tree.  A fold whose mean loss has
not improved for ``patience`` trees stops, and its best number of trees counts.
Margins are written to the shared folder every few trees, and the trees since then
are applied where the rows are read, so a lost executor costs no more than that.
"""

from __future__ import annotations

import math
import uuid
from collections import namedtuple
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.session import ensure_checkpoint_dir

FEATURES = 256         # features whose histograms go together
CELLS = 4_000_000      # entities x terms x folds of a block
KEPT_TREES = 10        # trees applied on the fly before margins are written again
WHOLE = 64_000_000     # bytes of bins, hashes and folds that are broadcast; the rows are passed over by level beyond
ROW = 12               # bytes of a row's hash and fold
MODELS_A_TASK = 16     # at most, where models are dealt over tasks


@dataclass(frozen=True)
class BoostParams:
    trees: int = 150
    rate: float = 0.05
    depth: int = 6
    subsample: float = 0.8
    columns: float = 0.8
    patience: int = 50
    bins: int = 32
    l2: float = 1.0
    least_rows: int = 10   # in a leaf
    seed: int = 42


@dataclass
class Tree:
    """Of every model (fold x term): split feature (-1: none) and bin by node, and the value of each node that ends."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(models: int, depth: int) -> Tree:
        inner, all_ = (1 << depth) - 1, (1 << (depth + 1)) - 1
        return Tree(np.full((models, inner), -1, np.int32), np.zeros((models, inner), np.uint8), np.zeros((models, all_)))

    def of(self, models: np.ndarray) -> Tree:
        return Tree(self.feature[models], self.bin[models], self.value[models])

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """(models, rows): the node that each row reaches within ``levels``."""
        node = np.zeros((len(self.feature), len(bins)), np.int64)
        for _ in range(levels):
            node = self.below(node, bins)
        return node

    def below(self, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """(models, rows): where the rows at ``node`` come to by one level."""
        inside = np.minimum(node, self.feature.shape[1] - 1)
        f = np.take_along_axis(self.feature, inside, 1)
        right = bins[np.arange(len(bins))[None, :], np.maximum(f, 0)] > np.take_along_axis(self.bin, inside, 1)
        return np.where((f >= 0) & (node == inside), 2 * node + 1 + right, node)

    def values(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.take_along_axis(self.value, self.nodes(bins, depth), 1)


@dataclass
class BoostedModel:
    terms: list[str]
    folds: list[int]
    cuts: np.ndarray                  # (features, bins - 1) upper bounds
    start: np.ndarray                 # (folds x terms) margins without trees
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)
    best: dict[int, int] = field(default_factory=dict)           # fold -> number of trees
    losses: dict[int, list[float]] = field(default_factory=dict)  # fold -> validation loss by number of trees
    root_splits: list[dict] = field(default_factory=list)        # of the first tree, with their sums

    def margins(self, bins: np.ndarray, fold: int) -> np.ndarray:
        """(terms, rows) under the model of a fold."""
        k = self.folds.index(fold)
        models = np.arange(k * len(self.terms), (k + 1) * len(self.terms))
        m = np.repeat(self.start[models][:, None], len(bins), axis=1)
        for tree in self.trees[:self.best[fold]]:
            m += tree.of(models).values(bins, self.params.depth)
        return m


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -50, 50)))


def feature_cuts(x: DataFrame, vec: str = "vec", bins: int = 32) -> np.ndarray:
    """(features, bins - 1) approximate quantiles of every feature over all rows; one row per feature comes to the driver."""
    shares = [k / bins for k in range(1, bins)]
    q = (x.select(F.posexplode(vec).alias("pos", "v")).groupBy("pos")
         .agg(F.percentile_approx("v", shares, 2000).alias("q")).orderBy("pos").toPandas())
    return np.stack([np.asarray(v, np.float64) for v in q["q"]])


def binned(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin b holds the values above cut b - 1 and up to cut b."""
    out = np.empty(vectors.shape, np.uint8)
    for j in range(vectors.shape[1]):
        out[:, j] = np.searchsorted(cuts[j], vectors[:, j], side="left")
    return out


def kept_rows(hashes: np.ndarray, tree: int, p: BoostParams) -> np.ndarray:
    """The row sample of a tree, by hash, so a task that runs again draws the same rows."""
    z = hashes.view(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + p.seed) & (2 ** 64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0 ** 64 < p.subsample


def kept_columns(features: int, tree: int, p: BoostParams) -> np.ndarray:
    n = max(1, round(p.columns * features))
    return np.sort(np.random.default_rng([p.seed, tree]).permutation(features)[:n])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def row_blocks(x: DataFrame, labels: DataFrame, terms: list[str], fold: F.Column, cuts: np.ndarray, start: np.ndarray,
               key: str, vec: str) -> DataFrame:
    """(block, keys, hash, fold, bins, ys, margins): some thousand entities a row."""
    index = F.create_map(*[v for i, t in enumerate(terms) for v in (F.lit(t), F.lit(i))])
    has = (labels.where(F.col("term_id").isin(terms)).groupBy(key)
           .agg(F.collect_set(F.element_at(index, F.col("term_id"))).alias("ys")))
    n, per_block = x.count(), max(64, min(16384, CELLS // max(1, len(start))))
    h = F.xxhash64(F.col(key))
    rows = x.select(key, vec, fold.cast("int").alias("fold"), h.alias("h"),
                    F.pmod(h, F.lit(max(1, math.ceil(n / per_block)))).cast("int").alias("block"))
    rows = rows.join(has, key, "left").withColumn("ys", F.coalesce("ys", F.array().cast("array<int>")))
    kind = x.schema[key].dataType

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), (key, "ascending")])
        ys = np.zeros((len(terms), t.num_rows), np.uint8)
        for i, js in enumerate(t.column("ys").to_pylist()):
            ys[js, i] = 1
        margins = np.repeat(start[:, None], t.num_rows, axis=1)
        cells = [np.asarray(t.column("h"), np.int64), np.asarray(t.column("fold"), np.int32), binned(_matrix(t.column(vec)), cuts),
                 ys, margins]
        return pa.table({"block": t.column("block").slice(0, 1), "keys": pa.array([t.column(key).to_pylist()], pa.list_(t.schema.field(key).type)),
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("hash", "fold", "bins", "ys", "margins"), cells)}})

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind))]
                          + [T.StructField(c, T.BinaryType()) for c in ("hash", "fold", "bins", "ys", "margins")])
    return rows.groupBy("block").applyInArrow(pack, schema)


@dataclass
class Work:
    """What a task needs for a pass: which models still learn, the trees since the margins were written, the tree that grows."""
    params: BoostParams
    folds: list[int]          # of the models that still learn
    models: np.ndarray        # their positions among all folds x terms
    terms: int
    features: int
    fresh: list[Tree]
    growing: Tree
    tree: int
    level: int                # -1: validation loss only
    alive: dict[tuple[int, int], np.ndarray]  # (fold, term) -> nodes of this level that may still be split


def block_arrays(row: dict, models: int, features: int) -> tuple[np.ndarray, ...]:
    hashes, fold = np.frombuffer(row["hash"], np.int64), np.frombuffer(row["fold"], np.int32)
    n = len(hashes)
    return (hashes, fold, np.frombuffer(row["bins"], np.uint8).reshape(n, features), np.frombuffer(row["ys"], np.uint8).reshape(-1, n),
            np.frombuffer(row["margins"], np.float64).reshape(models, n))


def node_sums(bins: np.ndarray, local: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    """(3, nodes x features x bins): sums of gradient, curvature and count of rows whose nodes are ``local`` of ``width``."""
    d, low = bins.shape[1], local * p.bins
    out = np.empty((3, width, d, p.bins))
    for j in range(d):
        at = low + bins[:, j]
        for c, v in enumerate((g, h, None)):
            out[c, :, j] = np.bincount(at, weights=v, minlength=width * p.bins).reshape(width, p.bins)
    return out.reshape(3, -1)


def loss_sum(prob: np.ndarray, y: np.ndarray) -> float:
    return -np.log(np.clip(np.where(y > 0, prob, 1 - prob), 1e-15, None)).sum()


def gradient_sums(state: DataFrame, work: Work, models: int) -> DataFrame:
    """(fold, term, part, block, sums): sums of gradient, curvature and count by (node, feature, bin) of a group of
    features; part -1 has the sum and count of the validation loss."""
    p, w = work.params, work

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, folds, bins, ys, margins = block_arrays(row, models, w.features)
                margins = margins[w.models]
                for tree in w.fresh:
                    margins = margins + tree.of(w.models).values(bins, p.depth)
                node = w.growing.of(w.models).nodes(bins, max(w.level, 0))
                sampled = kept_rows(hashes, w.tree, p)
                first = (1 << max(w.level, 0)) - 1
                for k, fold in enumerate(w.folds):
                    out: dict[str, list] = {c: [] for c in ("fold", "term", "part", "block", "sums")}

                    def add(term, part, sums):
                        for c, v in zip(out, (fold, term, part, row["block"], np.ascontiguousarray(sums, np.float64).tobytes())):
                            out[c].append(v)

                    for j in range(w.terms):
                        prob, y = sigmoid(margins[k * w.terms + j]), ys[j].astype(np.float64)
                        if w.level <= 0:
                            held = folds == fold
                            add(j, -1, [loss_sum(prob[held], y[held]), held.sum()])
                        alive = w.alive.get((fold, j))
                        if alive is None:
                            continue
                        place = np.full((1 << (p.depth + 1)) + 1, -1)
                        place[alive + first] = np.arange(len(alive))
                        local, width = place[node[k * w.terms + j]], len(alive)
                        rows = np.flatnonzero((folds != fold) & sampled & (local >= 0))
                        g, h = prob[rows] - y[rows], prob[rows] * (1 - prob[rows])
                        for part, low in enumerate(range(0, w.features, FEATURES)):
                            add(j, part, node_sums(bins[rows, low:low + FEATURES], local[rows], len(alive), g, h, p))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(out[c], pa.int32()) for c in ("fold", "term", "part", "block")), pa.array(out["sums"], pa.binary())],
                        names=list(out))

    return state.select("block", "hash", "fold", "bins", "ys", "margins").mapInArrow(
        run, "fold int, term int, part int, block int, sums binary")


SPLIT_SCHEMA = ("fold int, term int, node int, gain double, feature int, bin int, left_g double, left_h double, "
                "left_n double, g double, h double, n double")


def node_splits(total: np.ndarray, nodes: np.ndarray, names: np.ndarray, usable: np.ndarray, p: BoostParams) -> list[tuple]:
    """(node, gain, feature, bin, left sums, sums) of every node from its sums (3, nodes, features, bins) of the features ``names``."""
    left = np.cumsum(total, axis=3)[..., :-1]
    whole = total.sum(axis=3)
    right = whole[..., None] - left
    score = lambda s: s[0] ** 2 / (s[1] + p.l2)
    gain = score(left) + score(right) - score(whole)[..., None]
    ok = (left[2] >= p.least_rows) & (right[2] >= p.least_rows)
    ok[:, ~usable] = False
    flat = np.where(ok, gain, -np.inf).reshape(len(nodes), -1)
    rows = []
    for i, at in enumerate(flat.argmax(axis=1)):
        j, b = divmod(int(at), p.bins - 1)
        found = flat[i, at] > 1e-12
        rows.append((int(nodes[i]), float(flat[i, at]) if found else 0.0, int(names[j]) if found else -1, b if found else 0,
                     *(float(left[c, i, j, b]) if found else 0.0 for c in range(3)), *(float(whole[c, i, 0]) for c in range(3))))
    return rows


def best_splits(sums: DataFrame, work: Work) -> DataFrame:
    """The best split of every node within a group of features (feature -1: none); node -1 has the validation loss."""
    p, features, alive = work.params, work.features, work.alive
    usable = kept_columns(features, work.tree, p)

    def choose(t: pa.Table) -> pa.Table:
        fold, term, part = (t.column(c)[0].as_py() for c in ("fold", "term", "part"))
        t = t.sort_by("block")  # sums in one order, whatever arrives first
        total = sum((np.frombuffer(v, np.float64) for v in t.column("sums").to_pylist()), np.zeros(1))
        if part < 0:
            rows = [(fold, term, -1, 0.0, -1, 0, 0.0, 0.0, 0.0, float(total[0]), 0.0, float(total[1]))]
        else:
            low, nodes = part * FEATURES, alive[fold, term]
            d, width = min(FEATURES, features - low), len(nodes)
            held = np.isin(np.arange(low, low + d), usable)
            rows = [(fold, term, *split) for split in node_splits(total.reshape(3, width, d, p.bins), nodes, np.arange(low, low + d), held, p)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SPLIT_SCHEMA.split(", ")])

    return sums.groupBy("fold", "term", "part").applyInArrow(choose, SPLIT_SCHEMA)


def margins_written(state: DataFrame, trees: list[Tree], models: int, features: int, depth: int) -> DataFrame:
    """The blocks with the trees added to their margins, written to the shared folder."""
    schema = state.schema

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select(["hash", "fold", "bins", "ys", "margins"]).to_pylist():
                _, _, bins, _, margins = block_arrays(row, models, features)
                for tree in trees:
                    margins = margins + tree.values(bins, depth)
                out.append(margins.tobytes())
            at = batch.schema.get_field_index("margins")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.binary())], names=batch.schema.names)

    return written(state.mapInArrow(run, schema) if trees else state)


def written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/boosting-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is executed inside leaves no shuffle files: else those of hundreds of passes stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def boosted_ovr_fit(x: DataFrame, labels: DataFrame, terms: list[str], fold: F.Column, params: BoostParams | None = None,
                    key: str = "entity_id", vec: str = "vec", cuts: np.ndarray | None = None) -> tuple[BoostedModel, DataFrame]:
    """boosted trees with log loss, one tree per term, fold and round, all grown in the same passes.

    ``terms`` is one block of (at most some hundred) elite terms, whose trees the
    driver holds.  ``fold`` names each row's validation fold.  Returns the model and
    the blocks of rows, for :func:`out_of_fold`.  Rows without a fold or vector are left out.
    """
    p = params or BoostParams()
    x = x.where(F.col(vec).isNotNull() & fold.isNotNull())
    cuts = feature_cuts(x, vec, p.bins) if cuts is None else cuts
    sizes = {r["fold"]: r["n"] for r in x.groupBy(fold.cast("int").alias("fold")).agg(F.count("*").alias("n")).collect()}
    folds = sorted(sizes)
    positive = (labels.where(F.col("term_id").isin(terms)).select(key, "term_id").distinct().join(x.select(key, fold.cast("int").alias("fold")), key)
                .groupBy("fold", "term_id").agg(F.count("*").alias("n")).collect())
    count = {(r["fold"], r["term_id"]): r["n"] for r in positive}
    share = np.array([sum(count.get((o, t), 0) for o in folds if o != f) / max(1, sum(sizes[o] for o in folds if o != f))
                      for f in folds for t in terms])
    share = np.clip(share, 1e-6, 1 - 1e-6)
    model = BoostedModel(terms, folds, cuts, np.log(share / (1 - share)), p, best={f: 0 for f in folds}, losses={f: [] for f in folds})
    n, models = len(terms), len(folds) * len(terms)
    state = written(row_blocks(x, labels, terms, fold, cuts, model.start, key, vec))
    with shuffles_dropped(x.sparkSession):
        if models and sum(sizes.values()) * (len(cuts) + ROW) <= WHOLE:
            grow_models(model, state, sizes)
        else:
            state = grow_by_levels(model, state)
    return model, state


def grow_by_levels(model: BoostedModel, state: DataFrame) -> DataFrame:
    """The trees of all models, a pass over the blocks for each level; returns the blocks with the margins as last written."""
    p, folds, n, features = model.params, model.folds, len(model.terms), len(model.cuts)
    models = len(folds) * n
    fresh: list[Tree] = []
    learning = list(folds)
    for r in range(p.trees + 1):
        tree = Tree.empty(models, p.depth)
        alive = {(f, j): np.zeros(1, np.int64) for f in learning for j in range(n)} if r < p.trees else {}
        for level in range(p.depth if r < p.trees else 0) or (-1,):
            at = np.concatenate([np.arange(folds.index(f) * n, (folds.index(f) + 1) * n) for f in learning])
            work = Work(p, learning, at, n, features, fresh, tree, r, level, alive)
            splits = best_splits(gradient_sums(state, work, models), work).toPandas()
            if level <= 0:
                for f, part in splits[splits.node < 0].groupby("fold"):
                    model.losses[f].append(part.g.sum() / max(1.0, part.n.sum()))
                    model.best[f] = int(np.argmin(model.losses[f]))
                learning = [f for f in learning if len(model.losses[f]) - 1 - model.best[f] < p.patience]
            if r == p.trees or not learning:
                break
            alive = grow(tree, best_of(splits[(splits.node >= 0) & splits.fold.isin(learning)]).itertuples(), folds, n, level, p)
            if r == 0 and level == 0:
                model.root_splits = best_of(splits[splits.node >= 0]).to_dict("records")
            if not alive:
                break
        if r == p.trees or not learning:
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEPT_TREES:
            state, fresh = margins_written(state, fresh, models, features, p.depth), []
    return state


SPLIT = namedtuple("Split", [c.split()[0] for c in SPLIT_SCHEMA.split(", ")])


def grown_alone(blocks: list[tuple[np.ndarray, ...]], fold: int, term: int, tree: int, p: BoostParams) -> tuple[Tree, tuple]:
    """A tree of one model from its blocks' (bins, y, probabilities, rows to learn from), and its first split."""
    grown, alive, root = Tree.empty(1, p.depth), np.zeros(1, np.int64), None
    names = kept_columns(blocks[0][0].shape[1], tree, p)
    parts = [(bins[rows], np.ascontiguousarray(bins[np.ix_(rows, names)].T), prob[rows] - y[rows], prob[rows] * (1 - prob[rows]))
             for bins, y, prob, rows in blocks]
    nodes = [np.zeros((1, len(bins)), np.int64) for bins, *_ in parts]
    for level in range(p.depth):
        place = np.full((1 << (p.depth + 1)) + 1, -1)
        place[alive + (1 << level) - 1] = np.arange(len(alive))
        total = np.zeros((3, len(alive) * len(names) * p.bins))
        if level:
            nodes = [grown.below(node, bins) for node, (bins, *_) in zip(nodes, parts)]
        for node, (_, some, g, h) in zip(nodes, parts):  # ``some``: a row a feature
            local = place[node[0]]
            here = local >= 0
            if not here.all():
                local, some, g, h = local[here], some[:, here], g[here], h[here]
            total += node_sums(some.T, local, len(alive), g, h, p)
        found = [SPLIT(fold, 0, *s) for s in node_splits(total.reshape(3, len(alive), len(names), p.bins), alive, names,
                                                         np.ones(len(names), bool), p)]
        root = found[0]._replace(term=term) if level == 0 else root
        alive = grow(grown, found, [fold], 1, level, p).get((fold, 0))
        if alive is None:
            break
    return grown, root


def grow_models(model: BoostedModel, state: DataFrame, sizes: dict[int, int]) -> None:
    """The trees of all models, ``KEPT_TREES`` a job: a task holds the bins of all rows and grows its models,
    one after the other.

    A row has a model's labels and margins, block after block; they go on from job to job in the shared folder."""
    p, folds, n, features, spark = model.params, model.folds, len(model.terms), len(model.cuts), state.sparkSession
    models = len(folds) * n
    blocks = state.select("block", "hash", "fold", "bins").toArrow().sort_by("block")  # at most WHOLE bytes
    sent = spark.sparkContext.broadcast([(np.frombuffer(r["hash"], np.int64), np.frombuffer(r["fold"], np.int32),
                                          np.frombuffer(r["bins"], np.uint8).reshape(-1, features)) for r in blocks.to_pylist()])
    del blocks
    parts = min(models, max(spark.sparkContext.defaultParallelism, -(-models // MODELS_A_TASK)))

    def dealt(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ys = np.frombuffer(row["ys"], np.uint8).reshape(n, -1)
                margins = np.frombuffer(row["margins"], np.float64).reshape(models, -1)
                for m in range(models):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([ys[m % n].tobytes()], pa.binary()),
                         pa.array([margins[m].tobytes()], pa.binary())], names=["model", "block", "y", "margins"])

    own = state.select("block", "ys", "margins").mapInArrow(dealt, "model int, block int, y binary, margins binary")
    own = own.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("block", "y", "margins"))).alias("own")) \
        .select("model", F.transform("own", lambda b: b["y"]).alias("ys"), F.transform("own", lambda b: b["margins"]).alias("margins"))
    own = written(own)
    kinds = pa.schema([("model", pa.int32()), ("ys", pa.list_(pa.binary())), ("margins", pa.list_(pa.binary())), ("trees", pa.list_(pa.binary())),
                       ("losses", pa.list_(pa.float64())), ("root", pa.list_(pa.float64()))])
    schema = ("model int, ys array<binary>, margins array<binary>, trees array<binary>, losses array<double>, root array<double>")

    def job(first: int, last: int):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    fold, term = folds[row["model"] // n], row["model"] % n
                    given = [(*b, np.frombuffer(y, np.uint8).astype(np.float64)) for b, y in zip(sent.value, row["ys"])]
                    margins = [np.frombuffer(m, np.float64) for m in row["margins"]]
                    trees, losses, root = [], [], None
                    for r in range(first, last + (last == p.trees)):
                        prob = [sigmoid(m) for m in margins]
                        losses.append(sum(loss_sum(q[f == fold], y[f == fold]) for q, (_, f, _, y) in zip(prob, given)))
                        if r == last:
                            break
                        tree, split = grown_alone([(bins, y, q, np.flatnonzero((f != fold) & kept_rows(h, r, p)))
                                                   for q, (h, f, bins, y) in zip(prob, given)], fold, term, r, p)
                        root = split if r == 0 else root
                        margins = [m + tree.values(bins, p.depth)[0] for m, (_, _, bins, _) in zip(margins, given)]
                        trees += [v.tobytes() for v in (tree.feature, tree.bin, tree.value)]
                    out = {"model": row["model"], "ys": row["ys"], "margins": [m.tobytes() for m in margins], "trees": trees,
                           "losses": losses, "root": [float(v) for v in root or ()]}
                    yield pa.RecordBatch.from_pylist([out], schema=kinds)
        return run

    learning, inner, all_ = list(folds), (1 << p.depth) - 1, (1 << (p.depth + 1)) - 1
    for first in range(0, max(1, p.trees), KEPT_TREES):
        last = min(p.trees, first + KEPT_TREES)
        alone = F.col("model").isin([folds.index(f) * n + j for f in learning for j in range(n)])
        # by ranges, so that no task has more models than its share
        own = written(own.where(alone).select("model", "ys", "margins").repartitionByRange(parts, "model").mapInArrow(job(first, last), schema))
        grown = own.select("model", "trees", "losses", "root").orderBy("model").toPandas()  # the model, which the driver holds
        if not first:
            model.root_splits = [SPLIT(*(int(v) if c in ("fold", "term", "node", "feature", "bin") else float(v) for c, v in zip(SPLIT._fields, r)))._asdict()
                                 for r in grown["root"] if len(r)]
        for r in range(first, last + (last == p.trees)):
            for f in learning:
                k = folds.index(f)
                of = grown[(grown["model"] >= k * n) & (grown["model"] < (k + 1) * n)]
                model.losses[f].append(float(sum(v[r - first] for v in of["losses"])) / max(1.0, float(n * sizes[f])))
                model.best[f] = int(np.argmin(model.losses[f]))
            learning = [f for f in learning if len(model.losses[f]) - 1 - model.best[f] < p.patience]
            if r == p.trees or not learning:
                return
            tree = Tree.empty(models, p.depth)
            for m, flat in zip(grown["model"], grown["trees"]):
                if folds[m // n] in learning:
                    f, b, v = flat[3 * (r - first):3 * (r - first) + 3]
                    tree.feature[m], tree.bin[m] = np.frombuffer(f, np.int32).reshape(inner), np.frombuffer(b, np.uint8).reshape(inner)
                    tree.value[m] = np.frombuffer(v, np.float64).reshape(all_)
            model.trees.append(tree)


def best_of(splits):
    """One row a node: the largest gain, then the least feature, of its feature groups."""
    order = splits.assign(none=splits.feature < 0).sort_values(["fold", "term", "node", "none", "gain", "feature"],
                                                               ascending=[True, True, True, True, False, True])
    return order.groupby(["fold", "term", "node"], as_index=False).first().drop(columns="none")


def grow(tree: Tree, splits, folds: list[int], terms: int, level: int, p: BoostParams) -> dict[tuple[int, int], np.ndarray]:
    """Put the splits of a level (one a node) into the tree, with the values of the nodes that end; returns the nodes below that
    have rows enough to be split."""
    value = lambda g, h: -p.rate * g / (h + p.l2)
    first, alive = (1 << level) - 1, {}
    for s in splits:
        m, node = folds.index(s.fold) * terms + s.term, first + s.node
        if s.feature < 0:
            tree.value[m, node] = value(s.g, s.h)
            continue
        tree.feature[m, node], tree.bin[m, node] = s.feature, s.bin
        tree.value[m, 2 * node + 1] = value(s.left_g, s.left_h)
        tree.value[m, 2 * node + 2] = value(s.g - s.left_g, s.h - s.left_h)
        if level + 1 < p.depth:
            below = [2 * s.node + side for side, rows in enumerate((s.left_n, s.n - s.left_n)) if rows >= 2 * p.least_rows]
            if below:
                alive.setdefault((s.fold, s.term), []).extend(below)
    return {k: np.array(v, np.int64) for k, v in alive.items()}


def out_of_fold(model: BoostedModel, state: DataFrame, key: str = "entity_id") -> DataFrame:
    """(entity_id, term_id, score) of every row under the model that did not see its fold."""
    terms = pa.array(model.terms)
    kind = state.schema["keys"].dataType.elementType
    models, features = len(model.folds) * len(model.terms), len(model.cuts)

    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                _, folds, bins, _, _ = block_arrays(row, models, features)
                keys = batch.column("keys")[k].values
                for f in np.unique(folds):
                    at = np.flatnonzero(folds == f)
                    score = sigmoid(model.margins(bins[at], int(f)))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.tile(at, len(terms)))), terms.take(pa.array(np.repeat(np.arange(len(terms)), len(at)))),
                         pa.array(score.ravel())], names=[key, "term_id", "score"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("term_id", T.StringType()), T.StructField("score", T.DoubleType())])
    return state.mapInArrow(run, schema)


def boosted_score(x: DataFrame, model: BoostedModel, key: str = "entity_id", vec: str = "vec") -> DataFrame:
    """(entity_id, term_id, score) of new rows: the mean over the folds' models."""
    schema = T.StructType([T.StructField(key, x.schema[key].dataType), T.StructField("term_id", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    terms = pa.array(model.terms)

    def run(batches):
        for batch in batches:
            bins = binned(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1), model.cuts)
            score = np.mean([sigmoid(model.margins(bins, f)) for f in model.folds], axis=0)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.tile(np.arange(n), len(terms)))),
                 terms.take(pa.array(np.repeat(np.arange(len(terms)), n))), pa.array(score.ravel())], names=[key, "term_id", "score"])

    return x.where(F.col(vec).isNotNull()).select(key, vec).mapInArrow(run, schema)
