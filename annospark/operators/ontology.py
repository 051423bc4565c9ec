"""Ontology graph operators.

The closure is computed once and written to the shared checkpoint folder.  Up to
a checked number of edges, the edges go to every task, which climbs from its
terms to all their ancestors at once: one job, however deep the ontology is.
Beyond that, the closure is found in waves from the roots: a term is closed once
all its parents are, and takes the union of their ancestors, so every edge carries
its parent's ancestors once.  An ontology of more than ``WAVES`` levels falls back
on a semi-naive, path-doubling loop of joins (each round joins only the newly found
pairs with the known pairs and anti-joins what is known).
Every propagation afterwards is a single join against the closure followed by a
``groupBy(entity, ancestor)`` aggregate — no per-level relaxation sweeps.  Where only sums
over an entity's ancestors are asked for, a row travels to its entity with all its ancestors
packed into some bytes (:func:`ancestor_sums`), so that no row is shuffled for each of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.functions.keys import accession
from annospark.session import bounded_broadcast, cut_lineage, ensure_checkpoint_dir

# Closure pairs and adjacency rows of an ontology are small next to the
# annotation data (48k terms give ~1-2M closure pairs of two short ids,
# ~40 bytes each); they are broadcast only when the measured row count is
# below this bound (~120 MB), otherwise the joins shuffle (and AQE may still
# switch to a broadcast from runtime sizes).
CLOSURE_BROADCAST_ROWS = 3_000_000
# Edges sent to every task (48k terms have some 90k): at most two numbers each, 16 MB.
CLIMB_EDGES = 1_000_000
CLIMB_TERMS = 1024  # terms that a task climbs from at a time
PIECE = 2_000_000  # bytes of packed ancestors that are unpacked at a time
# Levels closed one after the other (GO has some 20); deeper graphs double their paths instead.
WAVES = 32
# A wave with fewer ancestors is sent to the edges (some 24 MB), a larger one is shuffled.
WAVE_BROADCAST = 1_000_000


def ancestor_closure(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 200,
                     climb_edges: int = CLIMB_EDGES) -> DataFrame:
    """G1: reflexive transitive closure ``(term_id, ancestor)`` of ``child -> parent`` edges.

    Reflexive pairs cover every edge endpoint and every ``nodes.term_id``.
    Self loops add nothing to them; a longer cycle raises ``ValueError``.  Up to
    ``climb_edges`` distinct edges are sent to the tasks; more are joined.
    """
    base = edges.select("child", "parent").where(F.col("child") != F.col("parent")).distinct()
    few = base.limit(climb_edges + 1).toArrow()  # the bound, and one to tell that it is passed
    ids = edges.select(F.explode(F.array("child", "parent")).alias("term_id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("term_id"))
    ids = ids.where(F.col("term_id").isNotNull()).distinct()
    if few.num_rows > climb_edges:
        roots = ids.join(base.select(F.col("child").alias("term_id")), "term_id", "left_anti") \
            .select("term_id", F.array("term_id").alias("above"))
        closed = _closed_in_waves(base, roots)
        return _joined_closure(edges, nodes, max_rounds) if closed is None else _pairs(closed)
    return _climbed_closure(few, ids)


def _pairs(closed: DataFrame) -> DataFrame:
    return closed.select("term_id", F.explode("above").alias("ancestor"))


def _closed_in_waves(edges: DataFrame, starts: DataFrame, waves: int = WAVES) -> DataFrame | None:
    """``(term_id, above)``: every term and its ancestors with itself, by waves up from ``starts``, terms whose ``above``
    is known.  ``edges`` are distinct and without loops; no start is a child.  A cycle raises ``ValueError``; None after
    ``waves`` waves.

    A wave's table in the checkpoint folder holds the terms with a closed parent: those that have met all their parents
    are closed by it, the others wait in the next wave with what they have got.  A term that is closed goes down each of
    its edges once, so the work grows with the closure (times the parents of a term).
    """
    spark = edges.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/closure-{uuid.uuid4().hex}"
    parents = edges.groupBy("child").agg(F.count("*").alias("parents"))
    edges.join(parents, "child").write.parquet(f"{path}-edges")
    down = spark.read.parquet(f"{path}-edges")
    starts.select("term_id", "above", F.lit(0).cast("long").alias("parents"), F.lit(0).cast("long").alias("met")).write.parquet(f"{path}/wave=0")
    schema = spark.read.parquet(f"{path}/wave=0").schema
    closed, waiting = F.col("met") == F.col("parents"), F.col("met") < F.col("parents")
    for k in range(waves + 1):
        last = spark.read.schema(schema).parquet(f"{path}/wave={k}")
        found, size = last.agg(F.count_if(closed), F.sum(F.when(closed, F.size("above")))).first()
        if not found:
            break
        if k == waves:
            return None
        ready = last.where(closed).select(F.col("term_id").alias("parent"), "above")
        ready = F.broadcast(ready) if size <= WAVE_BROADCAST else ready.hint("merge")
        got = down.join(ready, "parent").select(F.col("child").alias("term_id"), "above", "parents", F.lit(1).cast("long").alias("met"))
        got.unionByName(last.where(waiting)).groupBy("term_id").agg(
            F.flatten(F.collect_list("above")).alias("above"), F.max("parents").alias("parents"), F.sum("met").alias("met")) \
            .select("term_id", F.array_distinct(F.concat("above", F.array("term_id"))).alias("above"), "parents", "met") \
            .write.parquet(f"{path}/wave={k + 1}")
    done = spark.read.schema(T.StructType([*schema.fields, T.StructField("wave", T.IntegerType())])).parquet(path).where(closed)
    left = edges.join(done.select(F.col("term_id").alias("child")), "child", "left_anti")
    if not left.isEmpty():  # on a cycle, or below one
        _joined_closure(left, None, 200)
    return done.select("term_id", "above")


class Climb:
    """The edges as arrays: terms are numbered, a term's parents lie together."""

    def __init__(self, edges: pa.Table):
        ends = pa.chunked_array([*edges.column("child").chunks, *edges.column("parent").chunks], edges.schema.field("child").type)
        self.terms = ends.unique()
        number = lambda c: np.asarray(pa.compute.index_in(edges.column(c), self.terms), np.int64)
        child, parent = number("child"), number("parent")
        order = np.argsort(child, kind="stable")
        self.parents = parent[order]
        self.starts = np.searchsorted(child[order], np.arange(len(self.terms) + 1))

    def above(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, parent) for every parent of the terms that the rows are at."""
        low, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(rows, size), self.parents[place]

    def cycle(self) -> int | None:
        """A term on a cycle: one that is left when terms without children are taken off again and again."""
        below = np.bincount(self.parents, minlength=len(self.terms))
        left, bare = np.ones(len(self.terms), bool), np.flatnonzero(below == 0)
        while len(bare):
            left[bare] = False
            _, up = self.above(bare, bare)
            np.subtract.at(below, up, 1)
            bare = np.unique(up[(below[up] == 0) & left[up]])
        return int(np.flatnonzero(left)[0]) if left.any() else None

    def ancestors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ancestor or self) of the terms ``at``, each once."""
        n = len(self.terms)
        seen = new = np.arange(len(at)) * n + at
        while len(new):
            rows, up = self.above(new // n, new % n)
            new = np.setdiff1d(rows * n + up, seen)
            seen = np.union1d(seen, new)
        return seen // n, seen % n


def _climbed_closure(edges: pa.Table, ids: DataFrame) -> DataFrame:
    spark = ids.sparkSession
    climb = Climb(edges) if edges.num_rows else None
    if climb is not None and (on := climb.cycle()) is not None:
        raise ValueError(f"the ontology has a cycle through {climb.terms[on].as_py()}")
    sent = spark.sparkContext.broadcast(climb)
    kind = ids.schema["term_id"].dataType

    def run(batches):
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, CLIMB_TERMS):
                terms = batch.column(0).slice(start, CLIMB_TERMS)
                if known is None:
                    yield pa.RecordBatch.from_arrays([terms, terms], names=["term_id", "ancestor"])
                    continue
                number = pa.compute.index_in(terms, known.terms)
                alone = terms.filter(pa.compute.is_null(number))  # terms without edges
                yield pa.RecordBatch.from_arrays([alone, alone], names=["term_id", "ancestor"])
                terms = terms.filter(pa.compute.is_valid(number))
                rows, above = known.ancestors(np.asarray(number.drop_null(), np.int64))
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(rows)), known.terms.take(pa.array(above)).cast(terms.type)],
                                                 names=["term_id", "ancestor"])

    schema = T.StructType([T.StructField("term_id", kind), T.StructField("ancestor", kind)])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/closure-{uuid.uuid4().hex}"
    ids.repartition(spark.sparkContext.defaultParallelism, "term_id").mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _joined_closure(edges: DataFrame, nodes: DataFrame | None, max_rounds: int) -> DataFrame:
    """The closure by joins alone, for more edges than a task should hold."""
    spark = edges.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/closure-{uuid.uuid4().hex}"
    # The closure is a table in the shared checkpoint folder, one partition
    # per round.  Each round doubles path lengths (delta o known and
    # known o delta) and appends only pairs not known yet, so it needs
    # log2(depth) rounds and every file holds distinct pairs.
    loops = edges.filter(F.col("child") == F.col("parent")).select(F.col("child").alias("t"))
    base = edges.select("child", "parent").filter(F.col("child") != F.col("parent")).distinct() \
        .withColumn("round", F.lit(0))
    schema = base.schema  # explicit: an empty round writes no files to infer from
    base.write.partitionBy("round").parquet(path)

    def table():
        return spark.read.schema(schema).parquet(path)
    for k in range(1, max_rounds + 1):
        known = table()
        delta = known.filter(F.col("round") == k - 1).select("child", "parent")
        kn = known.select("child", "parent")
        a = delta.alias("d").join(kn.alias("r"), F.col("d.parent") == F.col("r.child")) \
            .select(F.col("d.child").alias("child"), F.col("r.parent").alias("parent"))
        b = kn.alias("r").join(delta.alias("d"), F.col("r.parent") == F.col("d.child")) \
            .select(F.col("r.child").alias("child"), F.col("d.parent").alias("parent"))
        new = a.unionByName(b).distinct().join(kn, ["child", "parent"], "left_anti")
        new.withColumn("round", F.lit(k)).write.mode("append").partitionBy("round").parquet(path)
        # reads only this round's partition; a pair (x, x) closes a cycle
        found, cyclic = table().filter(F.col("round") == k).agg(
            F.count("*"), F.min(F.when(F.col("child") == F.col("parent"), F.col("child")))).first()
        if cyclic is not None:
            raise ValueError(f"the ontology has a cycle through {cyclic}")
        if not found:
            break
    else:
        raise RuntimeError("ancestor closure did not converge (too deep)")
    e = table().filter(F.col("round") == 0)
    ids = e.select(F.explode(F.array("child", "parent")).alias("t")).unionByName(loops)
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("term_id").alias("t")))
    ids.distinct().select(F.col("t").alias("child"), F.col("t").alias("parent"), F.lit(-1).alias("round")) \
        .write.mode("append").partitionBy("round").parquet(path)
    return table().select(F.col("child").alias("term_id"), F.col("parent").alias("ancestor"))


def maintained_closure(closure: DataFrame, edges: DataFrame, inserted: DataFrame, deleted: DataFrame,
                       climb_edges: int = CLIMB_EDGES) -> DataFrame:
    """G1 after a batch of edits: the closure of ``edges`` (the edges after the edits) from the ``closure`` before them.

    A term's ancestors can change only if it lies below the child of an edited
    edge, by the old closure, or is an end of an inserted one; the others keep
    their rows.  Inserting what is there and deleting what is not change
    nothing.  Terms stay (with themselves) when their last edge goes, also
    terms that ``edges`` does not name; a cycle raises ``ValueError``.
    Work grows with the terms below the edits, but for one scan of the closure.
    """
    below = inserted.select(F.col("child").alias("ancestor")).unionByName(deleted.select(F.col("child").alias("ancestor"))).distinct()
    hit = closure.join(below, "ancestor", "left_semi").select("term_id") \
        .unionByName(inserted.select(F.explode(F.array("child", "parent")).alias("term_id"))) \
        .where(F.col("term_id").isNotNull()).distinct()
    hit = cut_lineage(hit)
    base = edges.select("child", "parent").where(F.col("child") != F.col("parent")).distinct()
    few = base.limit(climb_edges + 1).toArrow()
    kept = closure.join(hit, "term_id", "left_anti").select("term_id", "ancestor")
    if few.num_rows > climb_edges:
        # the edges above the terms that are hit: up to terms whose closure is known, since nothing changed there
        todo = base.join(hit.withColumnRenamed("term_id", "child"), "child", "left_semi")
        starts = todo.select(F.col("parent").alias("term_id")).unionByName(hit).distinct() \
            .join(todo.select(F.col("child").alias("term_id")), "term_id", "left_anti")
        known = kept.join(starts, "term_id", "left_semi").groupBy("term_id").agg(F.collect_set("ancestor").alias("known"))
        closed = _closed_in_waves(todo, starts.join(known, "term_id", "left").select(
            "term_id", F.coalesce("known", F.array("term_id")).alias("above")))
        if closed is not None:
            new = _pairs(closed.join(hit, "term_id", "left_semi"))
        else:
            fresh = _joined_closure(todo, hit, 200)
            beyond = fresh.join(kept.select(F.col("term_id").alias("a"), F.col("ancestor").alias("beyond")), F.col("ancestor") == F.col("a"))
            new = fresh.unionByName(beyond.select("term_id", F.col("beyond").alias("ancestor"))).distinct() \
                .join(hit, "term_id", "left_semi")
    else:
        new = _climbed_closure(few, hit)
    return kept.unionByName(new.select("term_id", "ancestor"))


def induced_edges(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges whose child and parent are both in ``terms`` (a gap blocks paths)."""
    t = terms.select("term_id").distinct()
    return edges.join(t.withColumnRenamed("term_id", "child"), "child", "left_semi") \
        .join(t.withColumnRenamed("term_id", "parent"), "parent", "left_semi")


def propagate_annotations(rows: DataFrame, closure: DataFrame, contract: DataFrame,
                          score: float = 1.0) -> DataFrame:
    """Every annotated term lifts to all its ancestors (full graph) that are
    in the contract; distinct ``(entity_id, term_id)`` with a constant score."""
    c = bounded_broadcast(cut_lineage(closure_into(closure, contract)), CLOSURE_BROADCAST_ROWS)
    up = rows.select("entity_id", "term_id").distinct().join(c, "term_id") \
        .select("entity_id", F.col("ancestor").alias("term_id")).distinct()
    return up.withColumn("score", F.lit(float(score)))


def closure_into(closure: DataFrame, contract: DataFrame) -> DataFrame:
    """The pairs of the closure whose ancestor is in the contract: a few hundred to thousand terms, so that a large
    closure is cut to them in place, before any row meets it."""
    con = bounded_broadcast(cut_lineage(contract.select("term_id").distinct().withColumnRenamed("term_id", "ancestor")), CLIMB_EDGES)
    return closure.join(con, "ancestor", "left_semi").select("term_id", "ancestor")


def propagate_resolved(rows: DataFrame, universe: DataFrame, closure: DataFrame, contract: DataFrame,
                       policy: str = "lenient", score: float = 1.0) -> DataFrame:
    """G2 with resolution: ``rows`` (raw_id, term_id) and ``universe`` (entity_id, split) meet by their accession under
    ``policy``; a row goes to the entity's original id, and an accession that is both a training and a test entity is a
    training one.  Of several original ids under one accession the smallest counts.  Rows of no known entity are left
    out.  Result: distinct (entity_id, split, term_id) with a constant score."""
    first = F.min(F.struct(F.when(F.col("split") == "train", 0).otherwise(1).alias("rank"), "entity_id", "split"))
    known = universe.groupBy(accession(F.col("entity_id"), policy).alias("_key")).agg(first.alias("u"))
    known = known.where(F.col("_key").isNotNull()).select("_key", "u.entity_id", "u.split")
    pairs = rows.select(accession(F.col("raw_id"), policy).alias("_key"), "term_id").distinct()
    found = pairs.join(known, "_key").select(F.struct("entity_id", "split").alias("entity_id"), "term_id")
    return propagate_annotations(found, closure, contract, score).select("entity_id.entity_id", "entity_id.split", "term_id", "score")


def contract_closure(edges: DataFrame, contract: DataFrame) -> DataFrame:
    """Closure of the subgraph that the contract induces, for G3-G5: built once
    for a graph and passed to each of them."""
    return ancestor_closure(induced_edges(edges, contract), nodes=contract)


def max_propagate(scores: DataFrame, closure: DataFrame) -> DataFrame:
    """``parent = max(parent, child)`` to the fixpoint on the subgraph
    of a :func:`contract_closure`: every contract ancestor-or-self of a scored
    term takes the maximum over its scored descendants.  Terms outside the
    contract have no closure rows and drop out."""
    c = bounded_broadcast(closure, CLOSURE_BROADCAST_ROWS)
    up = scores.select("entity_id", "term_id", "score").join(c, "term_id")
    return up.groupBy("entity_id", F.col("ancestor").alias("term_id")).agg(F.max("score").alias("score"))


def numbered_columns(closure: DataFrame, weights: DataFrame) -> DataFrame:
    """``(ancestor, aspect, weight, number)``: the ancestors of the closure that have a row in ``weights`` (term_id, aspect,
    weight), numbered from 0, those of the most terms first, so that most numbers of a term are small."""
    terms = closure.where(F.col("ancestor").isNotNull()).groupBy("ancestor").agg(F.count("*").alias("terms"))
    found = terms.join(weights.withColumnRenamed("term_id", "ancestor"), "ancestor")
    found = cut_lineage(found.orderBy(F.col("terms").desc(), "ancestor", "aspect"))
    # the id of a row holds its partition and its place there: places go on from partition to partition
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    found = found.withColumn("id", F.monotonically_increasing_id())
    sizes = {r["part"]: r["n"] for r in found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes} or {0: 0}
    offset = F.element_at(F.create_map(*[F.lit(v) for p, n in before.items() for v in (p, n)]), part)
    return found.select("ancestor", "aspect", "weight", (offset + place).cast("long").alias("number"))


def packed(rows: np.ndarray, numbers: np.ndarray, n: int) -> pa.Array:
    """The distinct numbers of each of ``n`` rows as bytes: ascending, each as its distance from the one before, seven bits
    a byte, the last byte of a number below 128."""
    order = np.lexsort((numbers, rows))
    rows, numbers = rows[order], numbers[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]])[:len(rows)]
    kept = first | np.concatenate([[True], numbers[1:] != numbers[:-1]])[:len(rows)]
    rows, numbers, first = rows[kept], numbers[kept], first[kept]
    gaps = np.where(first, numbers, numbers - np.concatenate([[0], numbers[:-1]])[:len(numbers)])
    size = 1 + sum((gaps >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - 1 - np.arange(size.sum())  # bytes of the number that follow
    place = np.repeat(size, size) - 1 - left
    data = ((np.repeat(gaps, size) >> 7 * place & 127) | np.where(left > 0, 128, 0)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=size, minlength=n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of a column of :func:`packed` bytes; no row is empty."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    total = np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts))
    per_row = np.diff(np.searchsorted(ends, offsets - offsets[0]))
    begin = np.cumsum(per_row) - per_row
    return np.repeat(np.arange(len(column)), per_row), total - np.repeat(np.concatenate([[0], total])[begin], per_row)


def ancestor_sums(rows: DataFrame, closure: DataFrame, weights: DataFrame, levels: int) -> DataFrame:
    """G3 with its sums: ``(aspect, entity_id, b, wp, wt, yt)`` over the ancestors of each entity's terms.

    ``rows`` are ``(entity_id, term_id, b, y)`` with ``b`` from 0 to ``levels`` - 1 and ``y`` 0 or 1; an ancestor takes the
    largest ``b`` and the largest ``y`` of the entity's terms below it.  ``wp`` sums the ``weights`` (term_id, aspect, weight)
    of an entity's ancestors with that ``b``, ``wt`` those of them with ``y`` = 1, ``yt`` is their largest ``y``.

    The closure's ancestors are numbered and gathered by term, some bytes each (terms keep about one byte a near number).
    A row takes those of its term along to its entity, and the rows of an entity meet in one task, which unpacks some
    thousand rows at a time: what is shuffled grows with the rows and these bytes, never with a row for each ancestor.
    Aspects and weights by number (nine bytes a term) are sent to every task.
    """
    spark = rows.sparkSession
    columns = numbered_columns(closure, weights)
    known = columns.select("number", "aspect", "weight").toArrow()
    aspects = sorted(pa.compute.unique(known.column("aspect")).to_pylist())
    number = np.asarray(known.column("number"), np.int64)
    width, kinds = len(number), max(1, len(aspects))
    aspect, weight = np.zeros(width, np.int8), np.zeros(width)
    aspect[number] = np.asarray(pa.compute.index_in(known.column("aspect"), pa.array(aspects, pa.string())), np.int8)
    weight[number] = np.asarray(known.column("weight"), np.float64)
    sent = spark.sparkContext.broadcast((aspect, weight))
    del known

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            of = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(of, np.asarray(lists.flatten(), np.int64), len(lists))],
                                             names=["term_id", "above"])

    up = closure.join(bounded_broadcast(columns.select("ancestor", "number"), CLOSURE_BROADCAST_ROWS), "ancestor") \
        .groupBy("term_id").agg(F.collect_list("number").alias("above"))
    up = up.mapInArrow(pack, T.StructType([closure.schema["term_id"], T.StructField("above", T.BinaryType())]))
    if width <= CLIMB_TERMS:  # the terms of a small ontology go to the rows
        up = F.broadcast(up)

    def sums(part: pa.Table):
        entity = part.column("entity_id").combine_chunks().dictionary_encode(null_encoding="encode")
        e, b, y = np.asarray(entity.indices, np.int64), np.asarray(part.column("b"), np.int64), np.asarray(part.column("y"), np.int64)
        of, at = unpacked(part.column("above").combine_chunks())
        cell = np.sort((((e * width)[of] + at) * levels + b[of]) * 2 + y[of])  # by entity, ancestor, level, truth
        same = cell // (2 * levels)
        first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        last = np.concatenate([first[1:], [len(cell)]]) - 1
        true, best, column = np.bitwise_or.reduceat(cell & 1, first), (cell[last] >> 1) % levels, same[first] % width
        of_aspect, of_weight = sent.value
        group, w = (same[first] // width * kinds + of_aspect[column]) * levels + best, of_weight[column]
        n = np.bincount(group)
        wp, wt, yt = (np.bincount(group, weights=v) for v in (w, w * true, true))
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(aspects, pa.string()).take(pa.array(at // levels % kinds)), entity.dictionary.take(pa.array(at // (levels * kinds))),
             pa.array((at % levels).astype(np.int32)), pa.array(wp[at]), pa.array(wt[at]), pa.array((yt[at] > 0).astype(np.int32))],
            names=["aspect", "entity_id", "b", "wp", "wt", "yt"])

    def meet(batches):
        held = None  # the rows of the last entity, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            *pieces, held = whole_entities(held)
            yield from map(sums, pieces)
        if held is not None:
            yield sums(held)

    met = rows.join(up, "term_id").select("entity_id", "b", "y", "above").repartition("entity_id").sortWithinPartitions("entity_id")
    double, whole = T.DoubleType(), T.IntegerType()
    return met.mapInArrow(meet, T.StructType([T.StructField(c, k) for c, k in (
        ("aspect", T.StringType()), ("entity_id", rows.schema["entity_id"].dataType), ("b", whole), ("wp", double), ("wt", double), ("yt", whole))]))


def whole_entities(table: pa.Table) -> list[pa.Table]:
    """The table, sorted by entity, cut between entities into pieces of some ``PIECE`` packed bytes; the last has the last entity alone."""
    codes = np.asarray(table.column("entity_id").combine_chunks().dictionary_encode(null_encoding="encode").indices)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    size = np.cumsum(np.asarray(pa.compute.binary_length(table.column("above"))))
    piece = np.concatenate([[0], size[starts[1:] - 1]]) // PIECE  # of the entity's first byte
    cuts = np.unique(np.concatenate([starts[np.flatnonzero(np.diff(piece, prepend=-1))], starts[-1:], [table.num_rows]]))
    return [table.slice(low, high - low) for low, high in zip(cuts[:-1], cuts[1:])]


def min_propagate(scores: DataFrame, closure: DataFrame) -> DataFrame:
    """``child = min(child, parents)`` to the fixpoint on the subgraph of a
    :func:`contract_closure`, i.e. the minimum over all contract
    ancestors-or-self; an absent ancestor counts as 0, so such a pair drops
    out of the sparse result."""
    n_anc = closure.groupBy("term_id").agg(F.count("*").alias("n_anc"))
    s = scores.join(n_anc, "term_id", "left_semi").select("entity_id", "term_id", "score")
    pairs = s.join(closure, "term_id").select("entity_id", "term_id", "ancestor")
    anc_scores = s.select("entity_id", F.col("term_id").alias("ancestor"), F.col("score").alias("a_score"))
    j = pairs.join(anc_scores, ["entity_id", "ancestor"], "left")
    g = j.groupBy("entity_id", "term_id").agg(F.min("a_score").alias("score"),
                                              F.count("a_score").alias("n_present"))
    return g.join(n_anc, "term_id").filter((F.col("n_present") == F.col("n_anc")) & (F.col("score") > 0)) \
        .select("entity_id", "term_id", "score")


def average_max_min(scores: DataFrame, closure: DataFrame) -> DataFrame:
    """``(max_propagated + min_propagated) / 2`` over the union of supports."""
    mx = max_propagate(scores, closure).withColumnRenamed("score", "mx")
    mn = min_propagate(scores, closure).withColumnRenamed("score", "mn")
    j = mx.join(mn, ["entity_id", "term_id"], "full_outer")
    return j.select("entity_id", "term_id",
                    ((F.coalesce("mx", F.lit(0.0)) + F.coalesce("mn", F.lit(0.0))) / 2).alias("score"))


def normalised_adjacency(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Symmetric is_a adjacency on ``terms`` plus self loops, coalesced,
    weighted ``1 / sqrt(deg_i * deg_j)`` (D^-1/2 A D^-1/2)."""
    e = induced_edges(edges, terms)
    t = terms.select("term_id").distinct()
    a = (e.select(F.col("child").alias("i"), F.col("parent").alias("j"))
         .unionByName(e.select(F.col("parent").alias("i"), F.col("child").alias("j")))
         .unionByName(t.select(F.col("term_id").alias("i"), F.col("term_id").alias("j")))
         .distinct())
    deg = a.groupBy("i").agg(F.count("*").alias("deg"))
    a = a.join(deg.select("i", F.col("deg").alias("di")), "i") \
        .join(deg.select(F.col("i").alias("j"), F.col("deg").alias("dj")), "j")
    return a.select("i", "j", (1.0 / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def graph_smooth(scores: DataFrame, adj: DataFrame, hops: int = 1) -> DataFrame:
    """``h <- A h`` per entity, ``hops`` times (sparse matrix product by join)."""
    a = bounded_broadcast(adj.select("i", "j", "w"), CLOSURE_BROADCAST_ROWS)
    h = scores.select("entity_id", "term_id", "score")
    for _ in range(hops):
        h = h.join(a, h.term_id == a.j).groupBy("entity_id", F.col("i").alias("term_id")) \
            .agg(F.sum(F.col("w") * F.col("score")).alias("score"))
    return h


def edge_stats(edges: DataFrame, ontology_terms: DataFrame, subset: DataFrame) -> DataFrame:
    """How many subset terms exist in the ontology and how many is_a edges
    lie inside the subset."""
    s = subset.select("term_id").distinct()
    found = s.join(ontology_terms.select("term_id"), "term_id", "left_semi").agg(
        F.count("*").alias("terms_found"))
    inside = induced_edges(edges.select("child", "parent").distinct(), s).agg(F.count("*").alias("edges_inside"))
    return found.select("terms_found", inside.scalar().alias("edges_inside"))


def hierarchy_violations(scores: DataFrame, edges: DataFrame, contract: DataFrame) -> DataFrame:
    """(entity, child, parent) over contract-induced edges where the child
    outscores the parent (an absent parent counts 0)."""
    e = induced_edges(edges, contract)
    s = scores.select("entity_id", "term_id", "score")
    j = s.join(e, s.term_id == e.child).select("entity_id", "child", "parent", F.col("score").alias("cs"))
    p = s.select("entity_id", F.col("term_id").alias("parent"), F.col("score").alias("ps"))
    j = j.join(p, ["entity_id", "parent"], "left")
    return j.filter(F.col("cs") > F.coalesce(F.col("ps"), F.lit(0.0))) \
        .select("entity_id", "child", "parent", "cs", F.col("ps"))
