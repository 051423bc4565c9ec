"""Token-group Jaccard join against all pairs by brute force."""

import random

import numpy as np
import pytest

from annospark.llm import jaccard


def brute(rows):
    sets = [jaccard.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None] if sets[k] else [i]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] else i))
    return sorted(out, key=str)


def test_links_begin_where_both_are_small_enough():
    rnd = random.Random(5)
    for _ in range(4000):
        n, m = rnd.randint(1, 60), rnd.randint(1, 60)
        o = rnd.randint(0, min(n, m))
        universe = list(range(n + m - o))
        rnd.shuffle(universe)
        a, b = sorted(universe[:n]), sorted(universe[n - o:])
        if 100 * o >= 75 * (n + m - o) and o:
            first = min(set(a) & set(b))
            i, j = a.index(first), b.index(first)
            assert i <= n - jaccard.least_overlap(n) and j <= m - jaccard.least_overlap(m)
            assert m <= jaccard.largest_partner(n, np.array(i)) and n <= jaccard.largest_partner(m, np.array(j))


def test_sketches_lose_no_link_and_stop_far_pairs():
    rnd = np.random.default_rng(3)
    stopped = 0
    for _ in range(2000):
        n, m = (int(x) for x in rnd.integers(1, 400, 2))
        if rnd.random() < 0.7:
            m = max(1, int(n * rnd.uniform(0.7, 1.4)))
        o = int(rnd.integers(0, min(n, m) + 1)) if rnd.random() < 0.4 else max(0, min(n, m) - int(rnd.integers(0, 1 + n // 8)))
        t = rnd.integers(0, 1 << 63, n + m - o, dtype=np.uint64)
        a, b = t[:n], t[n - o:]
        near = jaccard.may_link(n, jaccard.sketch(a), m, jaccard.sketch(b))
        if 100 * o >= 75 * (n + m - o):
            assert near
        elif 100 * o < 50 * (n + m - o):
            stopped += not near
    assert stopped > 300
    assert jaccard.folded(jaccard.sketch(t), 8) == np.packbits(
        (np.bincount((t & np.uint64(63)).astype(int), minlength=64) & 1).astype(np.uint8)).tobytes()
    v = np.array([0, 1, 300, 70_000], np.int32)
    assert jaccard.from_planes(jaccard.planes(v)).tolist() == v.tolist()


def test_far_pairs_fetch_no_texts_and_families_are_grouped(make_docs, monkeypatch):
    """Texts of pairs that cannot link are not fetched; a family whose leader is far from it is grouped all the same."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]

    def member(changes):
        ws = list(base)
        for at in rnd.sample(range(120), changes):
            ws[at] = f"x{rnd.random()}"
        return " ".join(ws)

    docs = make_docs([(k, member(1)) for k in range(40)] + [(100 + k, member(12)) for k in range(4)] + [(k, None) for k in (7, 7)])
    rows = jaccard._keyed(docs, "doc_id", "text")
    sets = jaccard.stored(jaccard.document_sets(rows), "t").where("n > 0").select("doc_id", "th", "n", "sid", "keys", "sketch")
    pairs = jaccard.stored(sets.select(jaccard.F.col("sid").alias("a")).crossJoin(sets.select(jaccard.F.col("sid").alias("b")))
                           .where("a < b"), "p")
    links = {tuple(r) for r in jaccard.verified(pairs, rows, sets).collect()}
    near = {tuple(r) for r in jaccard.near(pairs, sets).collect()}
    assert links <= near and len(near) < pairs.count()
    fetched = []
    monkeypatch.setattr(jaccard, "texts_of", lambda r, s, sids, real=jaccard.texts_of: fetched.append(sids.count()) or real(r, s, sids))
    far = pairs.join(rows.sparkSession.createDataFrame([*near], "a binary, b binary"), ["a", "b"], "left_anti")
    assert jaccard.verified(far, rows, sets).count() == 0 and fetched == [0]
    # all sets share all four least hashes, and the set with most company is the far one
    one = sets.withColumn("keys", jaccard.F.expr("array(1L, 2L, 3L, 4L)"))
    leaders = jaccard.leader_pairs(one).collect()
    assert len({bytes(r["b"]) for r in leaders}) > 4 and len(leaders) < 44 * 8


def test_texts_of_repeated_rows_come_once(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (3, "k l m n o p")])
    rows = jaccard._keyed(docs, "doc_id", "text")
    sets = jaccard.stored(jaccard.document_sets(rows), "t").where("n > 0").select("doc_id", "th", "n", "sid", "keys", "sketch")
    got = sorted(r["text"] for r in jaccard.texts_of(rows, sets, sets.select("sid").distinct()).collect())
    assert got == ["a b c d e f", "k l m n o p", "q r s t u v"]


def test_matrix_entries_are_short_and_lose_no_pair(make_docs):
    """11 bytes of token and group an entry; groups with the same short id are told apart again, and are candidates."""
    rnd = random.Random(4)
    F, vocabulary = jaccard.F, [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((3, 12, 40)))) for _ in range(500)]
    texts += [t + " more" for t in texts[::3]]
    docs = make_docs(list(enumerate(texts)))
    rows = jaccard._keyed(docs, "doc_id", "text")
    sets = jaccard.stored(jaccard.document_sets(rows), "t").where("n > 0").select("doc_id", "th", "n", "sid", "keys", "sketch")
    groups = rows.sparkSession.createDataFrame([], "sid binary, label binary")
    gids = sets.select(F.col("sid").alias("gid")).distinct()
    found = {}
    for width in (1, jaccard.GROUP_BYTES):
        matrix = jaccard.stored(jaccard.matrix_rows(rows, sets, groups, np.zeros(8, np.uint8), 6, width), "m")
        pairs = [tuple(map(bytes, r[:2])) for r in jaccard.candidate_groups(
            matrix, gids.withColumn("members", F.lit(1)), 3, 6, width).collect()]
        assert len(pairs) == len({frozenset(p) for p in pairs}) and all(a != b for a, b in pairs)
        found[width] = {frozenset(p) for p in pairs}
    size = matrix.agg(F.sum(F.length("token") + F.length("g")), F.sum(F.length("size"))).first()
    assert size[0] == 11 * size[1] // 4
    linked = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in jaccard.verified(
        gids.select(F.col("gid").alias("a")).crossJoin(gids.select(F.col("gid").alias("b"))).where("a < b"), rows, sets).collect()}
    ids = [bytes(r["gid"]) for r in gids.collect()]
    alike = {frozenset((a, b)) for a in ids for b in ids if a < b and a[0] == b[0]}
    assert len(linked) > 50 and linked <= found[6] <= found[1] and alike <= found[1]


def test_rare_tokens_come_first():
    table = np.zeros(8, np.uint8)  # 16 places
    table[1] = 0x30                # place 2: level 3
    t = np.array([2, 3, 18, 19], np.uint64)
    assert jaccard.rare_first(t, table).tolist() == [3, 19, 2, 18]


@pytest.mark.parametrize("seed,probes", [(1, 32), (2, 1)])
def test_equals_brute_force(make_docs, monkeypatch, seed, probes):
    monkeypatch.setattr(jaccard, "PROBES", probes)  # with 1, groups of two and more are large
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "É two"), (906, "é two"),
            (None, "a b c d e f g h"), (None, "a b c d e f g h"), (907, "a b c d e f g h")]
    for k in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((4, 8, 20, 60, 150)))]
        if k % 4 == 0:
            base = passage + base
        for c in range(rnd.choice((1, 1, 2, 8))):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    chain = [f"c{k}" for k in range(80)]  # a chain whose ends do not link
    rows += [(500 + s, " ".join(chain[s * 3:s * 3 + 40])) for s in range(8)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in
                  jaccard.jaccard_components(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(make_docs):
    assert jaccard.jaccard_components(make_docs([(1, "a")]).limit(0)).count() == 0
