"""Both ways to the closure against a plain search, and cycles."""

import random

import pytest

from annospark.operators import ontology as G


def plain(edges, nodes):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    ids = {t for e in edges for t in e} | set(nodes)
    out = set()
    for t in ids:
        todo, seen = [t], {t}
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out |= {(t, a) for a in seen}
    return sorted(out)


@pytest.mark.parametrize("climb_edges", [10 ** 6, 0])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_equals_plain_search(spark, climb_edges, kind):
    rnd = random.Random(6)
    name = (lambda k: f"GO:{k:04d}") if kind == "string" else (lambda k: k)
    edges = [(name(k), name(rnd.randrange(k))) for k in range(1, 120) for _ in range(rnd.randint(0, 3))]
    edges += [(name(k), name(k - 1)) for k in range(200, 260)] + [(name(5), name(5)), edges[0], edges[0]]
    df = spark.createDataFrame(edges, f"child {kind}, parent {kind}")
    nodes = spark.createDataFrame([(name(k),) for k in (3, 500, 501)], f"term_id {kind}")
    got = G.ancestor_closure(df, nodes, climb_edges=climb_edges)
    assert got.columns == ["term_id", "ancestor"]
    assert sorted(tuple(r) for r in got.collect()) == plain([e for e in edges if e[0] != e[1]] + [(name(5), name(5))], [name(3), name(500), name(501)])


@pytest.mark.parametrize("climb_edges", [10 ** 6, 0])
def test_cycles_and_empty_tables(spark, climb_edges):
    cyclic = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle through"):
        G.ancestor_closure(cyclic, climb_edges=climb_edges)
    none = spark.createDataFrame([], "child string, parent string")
    assert G.ancestor_closure(none, climb_edges=climb_edges).count() == 0
    one = spark.createDataFrame([("t",)], "term_id string")
    assert [tuple(r) for r in G.ancestor_closure(none, one, climb_edges=climb_edges).collect()] == [("t", "t")]


def test_closure_after_edits(spark):
    rnd = random.Random(5)
    old = {(f"t{k}", f"t{rnd.randrange(k)}") for k in range(1, 40) for _ in range(2)}
    frame = lambda e: spark.createDataFrame(sorted(e), "child string, parent string")
    closure = G.ancestor_closure(frame(old)).checkpoint()
    gone = set(rnd.sample(sorted(old), 6)) | {("t3", "nothing")}
    new = {("t30", "t2"), ("n1", "t12"), ("n1", "n2"), ("n2", "t9"), ("t38", "n1")}
    after = (old - gone) | new
    terms = spark.createDataFrame([(t,) for t in sorted({x for e in old | new for x in e})], "term_id string")
    want = {tuple(r) for r in G.ancestor_closure(frame(after), nodes=terms).collect()}
    for bound in (1000, 3):  # the edges in every task, and by joins
        got = G.maintained_closure(closure, frame(after), frame(new), frame(gone), climb_edges=bound).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    same = G.maintained_closure(closure, frame(old), frame(old).where("false"), frame(old).where("false"))
    assert sorted(same.collect()) == sorted(closure.collect())
    with pytest.raises(ValueError):
        G.maintained_closure(closure, frame(old | {("t0", "t39")}), frame({("t0", "t39")}), frame(old).where("false")).collect()


def test_large_graph_is_closed_in_waves(spark, monkeypatch):
    """beyond the bound, and up to WAVES levels, no paths are doubled."""
    monkeypatch.setattr(G, "_joined_closure", lambda *a: pytest.fail("paths are doubled"))
    rnd = random.Random(8)
    edges = [(f"t{k}", f"t{p}") for k in range(1, 90) for p in {k // 2, k // 3, rnd.randrange(k // 2 + 1)}] + [("t4", "t4"), (None, "t1"), ("t5", None)]
    got = G.ancestor_closure(spark.createDataFrame(edges, "child string, parent string"), climb_edges=0).collect()
    assert sorted(tuple(r) for r in got) == plain([e for e in edges if None not in e], [])


def test_deep_graph_falls_back_and_cycles_below_roots_raise(spark):
    deep = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    starts = spark.createDataFrame([("d", ["d"])], "term_id string, above array<string>")
    assert G._closed_in_waves(deep, starts, waves=2) is None
    assert G._closed_in_waves(deep, starts, waves=4).count() == 4
    loop = deep.union(spark.createDataFrame([("b", "y"), ("y", "z"), ("z", "b")], deep.schema))
    with pytest.raises(ValueError, match="cycle through [byz]$"):
        G._closed_in_waves(loop, starts)


def test_only_contract_ancestors_meet_the_rows(spark, monkeypatch):
    """the closure is cut to the contract before it is joined."""
    seen = []
    monkeypatch.setattr(G, "bounded_broadcast", lambda df, n: (seen.append(df.count()), df)[1])
    closure = spark.createDataFrame([(f"t{k}", f"t{a}") for k in range(30) for a in range(k + 1)], "term_id string, ancestor string")
    rows = spark.createDataFrame([(1, "t7"), (1, "t7"), (2, "t1"), (None, "t29"), (3, None)], "entity_id long, term_id string")
    contract = spark.createDataFrame([("t2",), ("t2",), ("t40",), (None,)], "term_id string")
    got = G.propagate_annotations(rows, closure, contract).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "t2", 1.0), (None, "t2", 1.0)]
    assert max(seen) == 28
