"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct five-word shingles (words are runs without
ASCII white space, A-Z lower-cased; fewer than five words: the whole sequence as
one shingle; no words: no set and no link).  Two documents link when their
sets' Jaccard similarity is at least 0.75.  Equal sets are one set from here on.

1. Groups.  Sets that share a least shingle hash (of four orders) meet two leaders,
   the one with most company and that of a small part of them (a leader that is far
   from its whole family groups nobody); those that an exact comparison links to one
   are joined, and connected sets form a group.  All others are groups of one.
2. Matrix.  For each group the union of its members' tokens.  The rows kept are
   those of the members' prefixes: a set of n tokens can only link to one that
   shares at least one of its first n - ceil(0.75 n) + 1 tokens in any fixed
   order.  A row also has the largest size of a set that can link if this is the
   first token that the two share (see :func:`largest_partner`).  Groups that share
   a row at which each is small enough for the other are candidates.
3. Bound.  Each member of the smaller group is a query to the larger one: it
   can only link if at least 0.75 of its tokens are in the larger group's union.
4. Open.  Only groups that pass are opened: query and members of fitting size
   are compared exactly, on the words themselves.

The order of tokens is by how many sets they are in, rare ones first: tokens that
several sets of a stretch share are counted there and over all stretches, and a
table of bounded size gives the level (twice the binary logarithm) by token hash.
So the prefixes of a family of similar sets hold what its members do not share.
The order only affects the work: any order gives the same links.

Pairs meet by sketch before their texts are fetched: the parities of a set's tokens by
hash place.  Places where two sketches differ hold tokens of one set only, so
too many of them rule a link out (see :func:`may_link`); no link is lost.

Components are found by joins on the set links.  Nothing that grows with the
documents comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import slices, stored

WORDS, SIMILARITY = 5, (75, 100)
KEYS = 4                  # least-hash keys for the groups
CHUNK = 4_000_000         # tokens looked at together for shared ones
ENTRIES = 250_000         # matrix entries a task packs at once
FREQUENT = 2              # occurrences (in different sets) in a chunk
LEVEL_BITS = (22, 26)     # least and most bits of the level table's size; two levels a byte, 32 MB at most
BROADCAST_ROWS = 400_000  # keys (24 bytes each) are broadcast up to here, joined by a shuffle beyond
WORD_CACHE = 150_000
PROBES = 32               # members of a large group tried before all of them
PART = 8                  # sets of a least-hash bucket that share a second leader, about
TOKEN_BYTES, GROUP_BYTES = 5, 6  # of a matrix entry
SKETCH_BITS = (6, 15)     # least and most bits of the number of places of a sketch

_MIX = np.uint64(0x9E3779B97F4A7C15)
_A = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            self[w] = h
        return h


_WORDS = _Words()


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: ASCII white space and A-Z only


def tokens(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the whole text."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    if len(_WORDS) >= WORD_CACHE:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))
    x = h[:len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        x *= _MIX
        x ^= x >> np.uint64(29)
        x += h[k:len(h) - WORDS + 1 + k]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return np.unique(x)


def shingles(text: str | None) -> set[bytes]:
    """The shingles themselves, for exact comparison."""
    ws = words(text)
    if len(ws) < WORDS:
        return {b" ".join(ws)} if ws else set()
    return {b" ".join(ws[k:k + WORDS]) for k in range(len(ws) - WORDS + 1)}


def linked(a: set, b: set) -> bool:
    if not a or not b:
        return False
    common = len(a & b)
    num, den = SIMILARITY
    return den * common >= num * (len(a) + len(b) - common)


def least_overlap(n: int) -> int:
    """Tokens of a set of n that any linked set must share."""
    return -(-SIMILARITY[0] * n // SIMILARITY[1])


def largest_partner(n: int, at: np.ndarray) -> np.ndarray:
    """The most tokens of a set that may link to one of n tokens if their first common token is number ``at`` of it.

    Then n - at tokens can be common at most, and linked sets of sizes n and m share
    75 (n + m) / 175 of them at least.
    """
    num, den = SIMILARITY
    return ((num + den) * (n - at) - num * n) // num


def sketch(t: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits; at least two places a token, within SKETCH_BITS."""
    low, high = SKETCH_BITS
    places = 1 << min(high, max(low, (2 * len(t) - 1).bit_length()))
    at = (t & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


def folded(s: bytes, size: int) -> bytes:
    """The sketch of the same set with fewer places."""
    return np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0).tobytes() if len(s) > size else s


def may_link(n: int, s: bytes, m: int, t: bytes) -> bool:
    """Whether sets of n and m tokens with these sketches can link: linked ones have (n + m) / 7 tokens
    at most that only one of them holds."""
    num, den = SIMILARITY
    if den * min(n, m) < num * max(n, m):
        return False
    size = min(len(s), len(t))
    apart = int.from_bytes(folded(s, size)) ^ int.from_bytes(folded(t, size))
    return (num + den) * apart.bit_count() <= (den - num) * (n + m)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): th tells rows of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.col(text_col).cast("string").alias("text"))


def document_sets(rows: DataFrame) -> DataFrame:
    """Per row (doc_id, th, n, sid, keys, sketch): set size, set id, least-hash keys and sketch; and rows (token, times)
    of tokens that several sets of a chunk share."""
    schema = "doc_id long, th long, n long, sid binary, keys array<long>, sketch binary, token long, times long"
    names = ["doc_id", "th", "n", "sid", "keys", "sketch", "token", "times"]

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def frequent():
            nonlocal size
            if not held:
                return
            t, c = np.unique(np.concatenate(list(held.values())), return_counts=True)
            held.clear()
            size = 0
            t, c = t[c >= FREQUENT], c[c >= FREQUENT]
            nulls = [pa.nulls(len(t), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

        for batch in slices(batches):
            ns, sids, keys, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                t = tokens(text)
                ns.append(len(t))
                sid = xxhash.xxh3_128_digest(t.tobytes())
                sids.append(sid)
                keys.append([int((t * a).min().view(np.int64)) for a in _A[:KEYS]] if len(t) else [])
                sketches.append(sketch(t))
                if len(t) and sid not in held:
                    held[sid] = t
                    size += len(t)
                    if size >= CHUNK:
                        yield from frequent()
            m = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(sids, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.nulls(m, pa.int64()),
                 pa.nulls(m, pa.int64())], names=names)
        yield from frequent()

    return rows.mapInArrow(run, schema)


def frequency_levels(found: DataFrame) -> np.ndarray:
    """Levels 0 to 15 by the low bits of the token hash, two in a byte.

    The table has about eight places for every shared token, within the bounds of
    LEVEL_BITS; it comes to the driver in slices that the tasks have packed.
    """
    shared = stored(found.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times")), "shared-tokens")
    low, high = LEVEL_BITS
    bits = min(high, max(low, (8 * max(1, shared.count())).bit_length()))
    place = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    level = F.least(F.lit(15), F.floor(2 * F.log2("times"))).cast("int")
    slice_bits = 16
    by_slice = (shared.select(place.alias("p"), level.alias("level")).groupBy("p").agg(F.max("level").alias("level"))
                .select(F.shiftright("p", slice_bits).cast("int").alias("slice"), F.col("p").bitwiseAND(F.lit((1 << slice_bits) - 1)).cast("int").alias("at"),
                        "level"))

    def pack(t: pa.Table) -> pa.Table:
        levels = np.zeros(1 << slice_bits, np.uint8)
        levels[np.asarray(t.column("at"))] = np.asarray(t.column("level"))
        return pa.table({"slice": t.column("slice").slice(0, 1), "packed": pa.array([(levels[::2] << 4 | levels[1::2]).tobytes()], pa.binary())})

    table = np.zeros(1 << (bits - 1), np.uint8)
    half = 1 << (slice_bits - 1)
    for r in by_slice.groupBy("slice").applyInArrow(pack, "slice int, packed binary").toLocalIterator():
        table[r["slice"] * half:(r["slice"] + 1) * half] = np.frombuffer(r["packed"], np.uint8)
    return table


def rare_first(t: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sorted tokens in the order of their levels, then of their hashes."""
    place = (t & np.uint64(2 * len(table) - 1)).astype(np.int64)
    pair = table[place >> 1]
    return t[np.argsort(np.where(place & 1, pair & 15, pair >> 4), kind="stable")]


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a key table only after counting its rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def texts_of(rows: DataFrame, sets: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, text) of one document of each set in ``sids``."""
    place = (sets.join(sids, "sid").groupBy("sid", "doc_id", "th").agg(F.count("*").alias("copies")).groupBy("sid")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "copies")).alias("p"))
             .select("sid", F.col("p.doc_id").alias("pid"), F.col("p.th").alias("pth"), F.col("p.copies").alias("copies")))
    place = stored(place, "places")

    def texts(some: DataFrame) -> DataFrame:
        return rows.join(_small(some), F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth"))).select("sid", "text")

    repeated = place.where("copies > 1")  # rows with the same id and text; the texts of the others need no shuffle
    if repeated.isEmpty():
        return texts(place)
    return texts(place.where("copies = 1")).unionByName(texts(repeated).dropDuplicates(["sid"]))


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose sizes and sketches allow a link."""
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    one = stored(sets.select("sid", "n", "sketch").join(_small(stored(sids, "asked-sets")), "sid")
                 .groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    both = (pairs.join(one.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(one.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"))

    def run(batches):
        for batch in slices(batches):
            keep = [may_link(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sets those whose documents link, compared exactly."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    pairs = stored(near(pairs, sets), "near-pairs")
    texts = stored(texts_of(rows, sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()), "texts")
    both = (pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        last: tuple[bytes, set] = (b"", set())
        for batch in slices(batches, 128):
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(a)):
                if b[k] != last[0]:
                    last = (b[k], shingles(tb[k]))
                keep.append(linked(shingles(ta[k]), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return stored(both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(sid, label): the least set id reachable by links, for every linked set."""
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                   .unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct(), "edges")
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("sid"), F.least("x", "m").alias("label")), "labels")
    while not labels.isEmpty():
        seen = (edges.join(labels, edges.y == labels.sid).groupBy("x").agg(F.min("label").alias("m")))
        step = labels.join(seen, labels.sid == seen.x).select(
            "sid", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        # and the label of the label
        jump = labels.select(F.col("sid").alias("l"), F.col("label").alias("ll"))
        step = stored(step.join(jump, step.label == jump.l, "left").select(
            "sid", "was", F.least("label", F.coalesce("ll", "label")).alias("label")), "labels")
        changed = not step.where("was <> label").isEmpty()
        labels = step.select("sid", "label")
        if not changed:
            break
    return labels


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each set and the leaders of its least-hash buckets and of its parts of them; linear in the number of sets."""
    one = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    at = stored(one.select("sid", "n", F.posexplode("keys").alias("k", "key")), "least-hashes")
    company = at.groupBy("k", "key").agg(F.count("*").alias("c")).where("c > 1")
    shared = stored(at.join(company, ["k", "key"]), "shared-hashes")
    support = shared.groupBy("sid").agg(F.sum("c").alias("support"))
    shared = shared.join(support, "sid")
    shared = shared.withColumn("part", F.pmod(F.xxhash64("sid", "k"), F.ceil(F.col("c") / PART)))
    num, den = SIMILARITY

    def led(*bucket: str) -> DataFrame:
        leader = shared.groupBy(*bucket).agg(F.max_by(F.struct("sid", "n"), F.struct("support", "sid")).alias("leader"))
        return (shared.join(leader, list(bucket))
                .where((F.col("sid") != F.col("leader.sid")) & (F.col("n") * den >= F.col("leader.n") * num)
                       & (F.col("leader.n") * den >= F.col("n") * num))
                .select(F.col("sid").alias("a"), F.col("leader.sid").alias("b")))

    return led("k", "key").unionByName(led("k", "key", "part")).distinct()


def matrix_rows(rows: DataFrame, sets: DataFrame, groups: DataFrame, levels: np.ndarray, buckets: int,
                width: int = GROUP_BYTES) -> DataFrame:
    """(bucket, token, g, size, most): packed columns of matrix entries (token, group, set size, largest partner).

    A token is shipped as the low TOKEN_BYTES of its quotient by the number of buckets and a group as the first ``width``
    bytes of its id: a chance meeting of either may add candidates and loses none."""
    mine = sets.join(groups.withColumnRenamed("label", "gid"), "sid").select(
        F.col("doc_id").alias("pid"), F.col("th").alias("pth"), "gid").distinct()
    src = rows.join(_small(stored(mine, "members")),
                    F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")), "left").select("text", "gid")
    sent = rows.sparkSession.sparkContext.broadcast(levels)
    schema = "bucket int, token binary, g binary, size binary, most binary"

    def run(batches):
        table = sent.value
        parts: list[tuple] = []
        held = 0

        def flush():
            nonlocal held
            if not parts:
                return
            t = np.concatenate([p[0] for p in parts])
            length = [len(p[0]) for p in parts]
            g, n = (np.repeat(np.array([p[k] for p in parts], np.int64), length) for k in (1, 2))
            most = np.concatenate([p[3] for p in parts])
            parts.clear()
            held = 0
            t, g, size, most = merged(t, g, n, most)
            bucket = (t % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((t, g, bucket))  # by group: runs of equal ids
            t, g, size, most, bucket = (v[order] for v in (t // np.uint64(buckets), g, size, most, bucket))
            cut = np.flatnonzero(np.diff(bucket)) + 1
            first = np.concatenate([[0], cut])
            cols = [[planes(c, w) for c in np.split(v, cut)]
                    for v, w in ((t, TOKEN_BYTES), (g, width), (size.astype(np.int32), 4), (most.astype(np.int32), 4))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]],
                                             names=["bucket", "token", "g", "size", "most"])

        for batch in slices(batches):
            for text, gid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens(text)
                if not len(t):
                    continue
                n = len(t)
                if gid is None:
                    gid = xxhash.xxh3_128_digest(t.tobytes())
                t = rare_first(t, table)[:n - least_overlap(n) + 1]
                parts.append((t, int.from_bytes(gid[:width]), n, largest_partner(n, np.arange(len(t)))))
                held += len(t)
                if held >= ENTRIES:
                    yield from flush()
        yield from flush()

    return src.mapInArrow(run, schema)


def short_ids(g: np.ndarray, width: int) -> list[bytes]:
    """The first ``width`` bytes of group ids, back from numbers."""
    return [v.tobytes() for v in g.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - width:]]


def planes(v: np.ndarray, width: int = 4) -> bytes:
    """The low ``width`` bytes of numbers, all first bytes first: the high ones of sizes are nearly all zero, so the shuffle
    packs them away."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1)[:, :width].T).tobytes()


def from_planes(b: bytes, width: int = 4) -> np.ndarray:
    """32-bit numbers, 64-bit ones if they are wider."""
    v = np.zeros((len(b) // width, 4 if width <= 4 else 8), np.uint8)
    v[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return v.view(np.int32 if width <= 4 else np.int64).ravel()


def merged(t, g, size, most):
    """Entries with the same token and group as one, with the least size and the largest partner."""
    order = np.lexsort((g, t))
    t, g, size, most = (v[order] for v in (t, g, size, most))
    if not len(t):
        return t, g, size, most
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])]))
    return t[first], g[first], np.minimum.reduceat(size, first), np.maximum.reduceat(most, first)


def candidate_groups(matrix: DataFrame, sizes: DataFrame, parts: int, buckets: int, width: int = GROUP_BYTES) -> DataFrame:
    """(ga, gb, ma, mb), each pair once: groups with a common matrix row at which a link between them may begin, and how
    many members they have, from the sizes (gid, members) of all groups.

    Groups with the same short id are one in the matrix: they are candidates of each other, and all of them of its partners."""
    def run(batches):
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            cols[0].extend(from_planes(v, TOKEN_BYTES) * buckets + b
                           for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k, w in enumerate((width, 4, 4), 1):
                cols[k].extend(from_planes(v, w) for v in batch.column(k + 1).to_pylist())
        if not cols[0]:
            return
        t, g, size, most = merged(*[np.concatenate(c) for c in cols])
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.concatenate([start, [len(t)]]))
        out: list[np.ndarray] = []

        def emit(i: np.ndarray, j: np.ndarray):
            fits = (size[i] <= most[j]) & (size[j] <= most[i])
            i, j = i[fits], j[fits]  # within a token the groups ascend, so i is always the lesser group
            if len(i):
                out.append(np.unique(np.stack([g[i], g[j]], axis=1).astype(np.int64), axis=0))
            if len(out) > 16:
                out[:] = [np.unique(np.concatenate(out), axis=0)]

        two = start[count == 2]
        emit(two, two + 1)
        pending_i, pending_j, held = [], [], 0
        for s, n in zip(start[count > 2], count[count > 2]):
            for k in range(n - 1):  # a row against the later ones of its token, so memory stays flat
                pending_i.append(np.full(n - 1 - k, s + k))
                pending_j.append(np.arange(s + k + 1, s + n))
                held += n - 1 - k
                if held > 100_000:
                    emit(np.concatenate(pending_i), np.concatenate(pending_j))
                    pending_i, pending_j, held = [], [], 0
        if held:
            emit(np.concatenate(pending_i), np.concatenate(pending_j))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        for k in range(0, len(pairs), 100_000):
            p = pairs[k:k + 100_000]
            ids = [pa.array(short_ids(p[:, c], width), pa.binary()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(ids, names=["sa", "sb"])

    met = matrix.repartition(parts, "bucket").mapInArrow(run, "sa binary, sb binary").distinct()
    ids = stored(sizes.select("gid", "members", F.substring("gid", 1, width).alias("short")), "short-ids")
    a, b = (ids.select(F.col("short").alias(f"s{c}"), F.col("gid").alias(f"g{c}"), F.col("members").alias(f"m{c}")) for c in "ab")
    pairs = met.join(a, "sa").join(b, "sb").select("ga", "gb", "ma", "mb")
    same = ids.groupBy("short").agg(F.count("*").alias("c")).where("c > 1").select(F.col("short").alias("sa"))
    if same.count() == 0:
        return pairs
    return pairs.unionByName(a.join(same, "sa").join(b, F.col("sa") == F.col("sb")).where("ga < gb").select("ga", "gb", "ma", "mb"))


def token_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., token) of (text, keep...)."""
    src = texts.select("text", *keep)
    schema = ", ".join([*[f"{k} binary" for k in keep], "token long"])

    def run(batches):
        for batch in slices(batches, 256):
            ts = [tokens(t) for t in batch.column(0).to_pylist()]
            at = np.repeat(np.arange(len(ts)), [len(t) for t in ts])
            cols = [batch.column(k + 1).take(pa.array(at)) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(ts).view(np.int64))], names=[*keep, "token"])

    return src.mapInArrow(run, schema)


def opened(queries: DataFrame, members: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (q, gid) those with at least 0.75 of q's tokens in the union of the group's tokens."""
    texts = stored(texts_of(rows, sets, queries.select(F.col("q").alias("sid")).union(
        members.join(queries.select("gid").distinct(), "gid").select("sid")).distinct()), "group-texts")
    union = token_rows(texts.join(members, "sid"), "gid").distinct()
    asked = token_rows(queries.join(texts.withColumnRenamed("sid", "q"), "q"), "q", "gid")
    num, den = SIMILARITY
    size = sets.groupBy(F.col("sid").alias("q")).agg(F.first("n").alias("n"))
    common = asked.join(union, ["gid", "token"]).groupBy("q", "gid").agg(F.count("*").alias("c"))
    return common.join(size, "q").where(F.col("c") * den >= F.col("n") * num).select("q", "gid")


def prefix_rows(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(sid, token, size, most) of (sid, text): the rows that a set has in the matrix, see :func:`largest_partner`."""
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in slices(batches, 256):
            ts = [tokens(t) for t in batch.column(1).to_pylist()]
            kept = [rare_first(t, sent.value)[:len(t) - least_overlap(len(t)) + 1] for t in ts]
            size = [len(k) for k in kept]
            join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            most = [largest_partner(len(t), np.arange(len(k))) for t, k in zip(ts, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(ts)), size))), pa.array(join(kept).view(np.int64)),
                 pa.array(np.repeat(np.array([len(t) for t in ts], np.int64), size)), pa.array(join(most).astype(np.int64))],
                names=["sid", "token", "size", "most"])

    return texts.select("sid", "text").mapInArrow(run, "sid binary, token long, size long, most long")


def set_links(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between sets that connect all that the exact join connects."""
    sets = found.where(F.col("sid").isNotNull() & (F.col("n") > 0)).select("doc_id", "th", "n", "sid", "keys", "sketch")
    first = verified(leader_pairs(sets), rows, sets)
    groups = components(first)
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 3_000_000))
    levels = frequency_levels(found)
    entries = matrix_rows(rows, sets, groups, levels, 4 * parts)
    sizes = (sets.select("sid").distinct().join(groups, "sid", "left").groupBy(F.coalesce("label", "sid").alias("gid"))
             .agg(F.count("*").alias("members")))
    sized = stored(candidate_groups(entries, sizes, parts, 4 * parts), "sized-groups")
    # groups of one: the union is the set itself, so bound and comparison are the same
    direct = verified(sized.where("ma = 1 AND mb = 1").select(F.col("ga").alias("a"), F.col("gb").alias("b")), rows, sets)
    links = first.unionByName(direct)
    large = sized.where("ma > 1 OR mb > 1").select(
        F.when(F.col("ma") <= F.col("mb"), F.col("ga")).otherwise(F.col("gb")).alias("small"),
        F.when(F.col("ma") <= F.col("mb"), F.col("gb")).otherwise(F.col("ga")).alias("gid"),
        F.greatest("ma", "mb").alias("size"))
    if large.isEmpty():
        return links
    members = stored(groups.select("sid", F.col("label").alias("gid")), "group-members")
    queries = stored(large.join(members.select(F.col("sid").alias("q"), F.col("gid").alias("small")), "small", "left")
                     .select(F.coalesce("q", "small").alias("q"), "gid", "size").distinct(), "queries")
    into = stored(opened(queries.select("q", "gid"), members, rows, sets).join(queries, ["q", "gid"]), "opened")
    size = sets.groupBy("sid").agg(F.first("n").alias("n"))
    num, den = SIMILARITY

    def against(asked: DataFrame, some: DataFrame) -> DataFrame:
        qn = size.select(F.col("sid").alias("q"), F.col("n").alias("qn"))
        return (asked.join(some.join(size, "sid"), "gid").join(qn, "q")
                .where((F.col("n") * den >= F.col("qn") * num) & (F.col("qn") * den >= F.col("n") * num))
                .select(F.col("q").alias("a"), F.col("sid").alias("b")))

    # A query that links to one member is connected to all: large groups get a few probes first.
    big = members.join(into.where(F.col("size") > PROBES).select("gid").distinct(), "gid", "left_semi")
    probe = big.withColumn("slot", F.pmod(F.xxhash64("sid"), F.lit(PROBES))).groupBy("gid", "slot") \
        .agg(F.min("sid").alias("sid")).select("gid", "sid")
    small = members.join(into.where(F.col("size") <= PROBES).select("gid").distinct(), "gid", "left_semi").select("gid", "sid")
    probed = verified(against(into, small.unionByName(probe)), rows, sets)
    done = probed.join(members.select(F.col("sid").alias("b"), "gid"), "b").select(F.col("a").alias("q"), "gid").distinct()
    rest = into.where(F.col("size") > PROBES).join(done, ["q", "gid"], "left_anti")
    # the others meet those members with which they share a row at which a link may begin
    rest = stored(rest.select("q", "gid"), "rest")
    some = stored(big.select("gid", "sid").join(rest.select("gid").distinct(), "gid", "left_semi"), "rest-members")
    texts = texts_of(rows, sets, rest.select(F.col("q").alias("sid")).union(some.select("sid")).distinct())
    prefixes = stored(prefix_rows(texts, levels), "prefixes")
    asked = rest.join(prefixes.select(F.col("sid").alias("q"), "token", F.col("size").alias("qn"), F.col("most").alias("qm")), "q")
    met = asked.join(some.join(prefixes, "sid"), ["gid", "token"]).where((F.col("size") <= F.col("qm")) & (F.col("qn") <= F.col("most")))
    far = verified(met.select(F.col("q").alias("a"), F.col("sid").alias("b")), rows, sets)
    return links.unionByName(probed).unionByName(far)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, set_label) of every row.

    ``component_id`` is the least id reachable by links, itself included;
    ``set_label`` is unique per component, also where ids are null or repeated
    with other texts (null for rows without words);
    ``th`` (a hash of the text) tells rows that share an id apart.  Null ids
    take part but never name a component unless it has no other id; null or
    empty texts, or texts without words, link with nothing and keep their own
    id; repeated rows have equal sets and so share a component.
    """
    rows = _keyed(docs, id_col, text_col)
    found = stored(document_sets(rows), "document-sets")
    labels = components(set_links(rows, found))
    sets = found.where(F.col("sid").isNotNull())
    labelled = stored(sets.select("doc_id", "th", "n", "sid").join(labels, "sid", "left")
                      .select("doc_id", "th", "n", F.coalesce("label", "sid").alias("label")), "labelled")
    least = labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("label")).alias("set_label"))
