"""Conversation prefix trie by a z-fast trie.

A conversation is the path of its turns from a textless root; a turn's name is a
128-bit digest of role and text, and the name of a depth-d node the chained
digest of the first d turns, so equal names mean equal prefixes in every task.

*Compacted nodes.*  Only the ends of conversations and nodes with several
children are kept, each with the edge (a, b] that leads to it from its parent's
depth a to its own depth b.  Its *handle* is the node on that edge whose depth is
divisible by the largest power of two (the two-fattest depth).

*Fat binary search.*  Where a conversation of n turns leaves the trie is found by
at most log2(n) + 1 lookups: between the bounds l and r it asks whether its own
prefix at the two-fattest depth of (l, r] is a handle.  A hit moves l to the end of
that edge, or stops if the conversation leaves it; a miss moves r below.  The
child of the last node that was reached is then looked up by its first turn.

*Batches.*  All conversations search at once (joins by handle).  Of those that
leave at one place with the same next turn, one is inserted, the others search
again below it; edges are cut where conversations leave or end.  Each round works
on all branches side by side, and a hash chooses who goes first, so the rounds
grow with the logarithm of the branchings on a path and not with the conversations.

*Sums* over subtrees come from pointer jumping on the compacted nodes, and edges
are expanded into nodes only at the end.  Copies of a conversation are one path
with a count from the start.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import slices, stored

ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 512  # ids of an end that are put into one string at once


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns' (h, w), digest and word count, in order.

    Ordered by turn, null first; rows with equal turns by role, then digest.  Null
    role or text: empty.  Rows without conv_id are left out.  Texts go no further
    than this, so a conversation's row is some 30 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("h"),
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["w"].alias("w"))).alias("turns"))


def prefix_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, end, n, path, cum) of (conv_id, turns): names of all prefixes and words up to each, from depth 0."""
    src = conversations.select("conv_id", F.transform("turns", lambda t: t["h"]).alias("h"),
                               F.transform("turns", lambda t: t["w"]).alias("w"))

    def run(batches):
        for batch in slices(batches):
            ends, ns, paths, cums = [], [], [], []
            for hs, ws in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                path, cum = [ROOT], [0]
                for h, w in zip(hs, ws):
                    path.append(xxhash.xxh3_128_digest(path[-1] + h))
                    cum.append(cum[-1] + w)
                ends.append(path[-1])
                ns.append(len(hs))
                paths.append(path)
                cums.append(cum)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends, pa.binary()), pa.array(ns, pa.int32()), pa.array(paths, pa.list_(pa.binary())),
                 pa.array(cums, pa.list_(pa.int64()))], names=["conv_id", "end", "n", "path", "cum"])

    return src.mapInArrow(run, "conv_id long, end binary, n int, path array<binary>, cum array<long>")


def two_fattest(low: str, high: str) -> F.Column:
    """The number in (low, high] that the largest power of two divides."""
    return F.expr(f"cast({high} & shiftleft(cast(-1 AS int), length(bin({low} ^ {high})) - 1) AS int)")


def located(pending: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """``pending`` (with a node that it passes at depth ``e``) with ``e`` where it leaves the trie, and ``cut``:
    (node, depth) if that is within the edge to that node."""
    handles = trie.select(F.get("edge", two_fattest("a", "b") - F.col("a")).alias("key"), "ext", F.col("a").alias("ha"),
                          F.col("b").alias("hb"))
    at = pending.withColumnsRenamed({"e": "l"}).withColumn("r", F.col("n"))
    for _ in range(longest.bit_length()):
        asked = at.withColumn("f", F.when(F.col("l") < F.col("r"), two_fattest("l", "r"))).withColumn("key", F.get("path", "f"))
        passes = F.get("path", "hb").eqNullSafe(F.col("ext"))
        hit, open_ = F.col("ext").isNotNull(), F.col("f").isNotNull()
        at = asked.join(handles, "key", "left").select(
            "end", "n", "path", "cum", "members",
            F.when(hit & passes, F.col("hb")).when(hit, F.col("ha")).otherwise(F.col("l")).alias("l"),
            # a hit that is not passed to its end is the edge that the conversation leaves
            F.when(hit & ~passes, F.col("ha")).when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("r")).alias("r"))
    tops = trie.select(F.get("edge", F.lit(1)).alias("key"), "ext", F.col("b").alias("hb"), "edge")
    below = at.withColumn("key", F.get("path", F.col("l") + 1)).join(tops, "key", "left")
    shared = F.size(F.array_intersect("path", F.slice("edge", 2, F.size("edge"))))
    e = F.when(F.col("ext").isNull(), F.col("l")).otherwise(F.col("l") + shared)
    cut = F.when(F.col("ext").isNotNull() & (F.col("e") < F.col("hb")), F.struct(F.col("ext").alias("ext"), F.col("e").alias("at")))
    return below.withColumn("e", e).select("end", "n", "path", "cum", "members", "e", cut.alias("cut"))


def edges_cut(trie: DataFrame, cuts: DataFrame) -> DataFrame:
    """The trie with its edges cut at (ext, at)."""
    places = cuts.distinct().groupBy("ext").agg(F.collect_set("at").alias("places"))
    points = F.array_sort(F.concat(F.array("a"), F.coalesce("places", F.array().cast("array<int>")), F.array("b")))
    rows = trie.join(places, "ext", "left").select("a", "edge", "ecum", points.alias("points"))
    ends = F.slice("points", 2, F.size("points") - 1)
    parts = rows.select("a", "edge", "ecum", F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("low"),
                                                                     ends.alias("high"))).alias("p"))
    piece = lambda c: F.slice(c, F.col("p.low") - F.col("a") + 1, F.col("p.high") - F.col("p.low") + 1)
    return parts.select(piece("edge").alias("edge"), piece("ecum").alias("ecum"), F.col("p.low").alias("a"), F.col("p.high").alias("b")
                        ).select(F.element_at("edge", -1).alias("ext"), "a", "b", "edge", "ecum")


def z_fast_trie(paths: DataFrame, longest: int) -> DataFrame:
    """(ext, a, b, edge, ecum) of the compacted nodes but the root, of distinct paths (end, n, path, cum, members).

    ``edge`` has the names from depth a to b, so its first is the parent's and its last the node's own.
    """
    spark = paths.sparkSession
    none = F.lit(None).cast("struct<ext binary, at int>")
    exits = paths.select("end", "n", "path", "cum", "members", F.lit(0).alias("e"), none.alias("cut"))
    trie = None
    while True:
        # one for each place and next turn goes in, the least by name
        first = exits.where("e < n").groupBy(F.get("path", F.col("e") + 1).alias("top")).agg(F.min("end").alias("end"))
        chosen = exits.join(first.select("end"), "end")
        length = F.col("n") - F.col("e") + 1
        new = chosen.select(F.col("end").alias("ext"), F.col("e").alias("a"), F.col("n").alias("b"),
                            F.slice("path", F.col("e") + 1, length).alias("edge"), F.slice("cum", F.col("e") + 1, length).alias("ecum"))
        if trie is not None:
            new = edges_cut(trie, exits.where("cut IS NOT NULL").select("cut.*")).unionByName(new)
        trie = stored(new, "trie")
        pending = stored(exits.where("e < n").join(first.select("end"), "end", "left_anti").drop("cut"), "pending")
        if pending.isEmpty():
            return trie
        exits = stored(located(pending, trie, longest), "exits")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(ext, convs, least, words, edge_words, leaves) over each node's subtree, by pointer jumping.

    After round k a row holds the sums of the nodes less than 2 ** k below it; those
    between 2 ** k and 2 ** (k + 1) are the sums of the rows that point to it from 2 ** k below.
    """
    at = stored(nodes, "sums")
    while not at.where("up IS NOT NULL").isEmpty():
        below = at.where("up IS NOT NULL").groupBy(F.col("up").alias("ext")).agg(
            F.sum("convs").alias("c"), F.min("least").alias("m"), F.sum("words").alias("w"), F.sum("edge_words").alias("v"),
            F.sum("leaves").alias("s"))
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        summed = at.join(below, "ext", "left").select(
            "ext", "up", add("convs", "c"), F.least("least", "m").alias("least"), add("words", "w"), add("edge_words", "v"),
            add("leaves", "s"))
        # nothing is above the root, so rows that point to it need no lookup
        jump = at.where(F.col("up").isNotNull()).select(F.col("ext").alias("up"), F.col("up").alias("next"))
        inner = summed.where(F.col("up") != F.lit(ROOT)).join(jump, "up", "left").drop("up").withColumnRenamed("next", "up")
        outer = summed.where(F.col("up").isNull() | (F.col("up") == F.lit(ROOT))).withColumn("up", F.lit(None).cast("binary"))
        at = stored(inner.unionByName(outer), "sums")
    return at.drop("up")


def end_digests(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, conv_id): the ids in ascending order, joined by commas, hashed.

    A hash runs over its whole text in order, so an end's ids meet in one task; they
    come as strings of up to 512 ids and pass through it one after the other.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = ends.groupBy("end", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))

    def run(batches):
        name, digest = None, None
        for batch in slices(batches):
            out = []
            for end, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != name:
                    if name is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = end, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())],
                                             names=["end", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])

    return (blocks.repartition("end").sortWithinPartitions("end", "block").select("end", "ids")
            .mapInArrow(run, "end binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, turns) as :func:`turn_digests` gives them.

    conv_id (the smallest member; with depth it names the node), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (words that copies of the node's and its subtree's last turns repeat),
    ends_sha256 (ids of the conversations that end here).  Conversations without
    turns end at the root; copies and prefixes of others are members like all
    others; repeated turns are turns of their own; without conversations there is
    no row.
    """
    paths = stored(prefix_paths(conversations), "paths")
    distinct = stored(paths.groupBy("end").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"), F.first("n").alias("n"),
                                               F.first("path").alias("path"), F.first("cum").alias("cum")), "distinct-paths")
    longest, least = paths.agg(F.max("n"), F.min("conv_id")).first()
    if longest is None:
        return paths.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                                      "n_leaves long, saved_tokens long, ends_sha256 string")
    trie = z_fast_trie(distinct.select("end", "n", "path", "cum", "members"), longest)
    root = paths.sparkSession.createDataFrame([(bytearray(ROOT), 0, 0, [bytearray(ROOT)], [0])], "ext binary, a int, b int, edge array<binary>, ecum array<long>")
    trie = trie.unionByName(root)
    parent = F.when(F.col("b") > 0, F.get("edge", F.lit(0)))
    children = trie.where("b > 0").groupBy(parent.alias("ext")).agg(F.count("*").alias("n_children"))
    ends = distinct.select(F.col("end").alias("ext"), "members", "least", (F.col("members") * F.element_at("cum", -1)).alias("words"))
    trie = stored(trie.join(children, "ext", "left").join(ends, "ext", "left").withColumn("up", parent), "trie")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = subtree_sums(trie.select(
        "ext", "up", zero("members").alias("convs"), "least", zero("words").alias("words"),
        (F.element_at("ecum", -1) - F.get("ecum", F.lit(0))).alias("edge_words"), F.col("n_children").isNull().cast("long").alias("leaves")))
    nodes = stored(trie.select("ext", "up", "a", "b", "ecum", "n_children").join(sums, "ext")
                   .join(end_digests(paths.select("end", "conv_id")).withColumnRenamed("end", "ext"), "ext", "left"), "nodes")
    above = nodes.select(F.col("ext").alias("up"), F.col("least").alias("up_least"))
    top = F.col("up").isNull() | (F.col("up") == F.lit(ROOT))
    nodes = (nodes.where(~top).join(above, "up")
             .unionByName(nodes.where(top).withColumn("up_least", F.lit(least))))
    depth, last = F.col("depth"), F.col("depth") == F.col("b")
    before = F.get("ecum", F.greatest(depth - 1 - F.col("a"), F.lit(0))) - F.get("ecum", F.lit(0))
    total = F.col("words") - F.col("convs") * F.get("ecum", F.lit(0)) - F.col("edge_words")
    return nodes.withColumn("depth", F.explode(F.sequence(F.least(F.col("a") + 1, F.col("b")), F.col("b")))).select(
        F.col("least").alias("conv_id"), depth.cast("long").alias("depth"),
        F.when(depth == 0, F.lit(None)).when(depth == F.col("a") + 1, F.col("up_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(last, zero("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (total - (F.col("convs") - 1) * before).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
