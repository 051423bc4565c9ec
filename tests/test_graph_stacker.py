"""The graph stacker against dense numpy: channels, weights of each model, and scores out of fold."""

import numpy as np
from pyspark.sql import functions as F

from annospark.operators import graph_stacker as gs
from annospark.operators import ontology

TERMS = [("a0", "BP"), ("a1", "BP"), ("a2", "BP"), ("c0", "MF"), ("c1", "MF"), ("u", "UNK")]
EDGES = [("a1", "a0"), ("a2", "a1"), ("c1", "c0"), ("c1", "a0"), ("u", "a0")]


def inputs(spark, n=60):
    rnd = np.random.default_rng(1)
    cells = [(e, t, float(rnd.random()), float(rnd.random() * (rnd.random() < 0.7))) for e in range(n) for t, _ in TERMS if rnd.random() < 0.6]
    truth = [(e, t) for e, t, p, q in cells if p + q + 0.6 * rnd.normal() > 1.0]
    terms = spark.createDataFrame(TERMS, "term_id string, aspect string")
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    adj = ontology.normalised_adjacency(gs.edges_within_aspects(edges, terms), terms)
    return (spark.createDataFrame(cells, "entity_id long, term_id string, p double, q double"),
            spark.createDataFrame(truth, "entity_id long, term_id string"), terms, adj, cells, truth)


def test_channels_are_powers_of_the_adjacency(spark):
    wide, _, _, adj, cells, _ = inputs(spark, 6)
    at = {t: k for k, (t, _) in enumerate(TERMS)}
    a = np.zeros((6, 6))
    for r in adj.collect():
        a[at[r.i], at[r.j]] = r.w
    assert a[at["c1"], at["a0"]] == 0 and a[at["a1"], at["a0"]] > 0
    h = np.zeros((6, 6, 2))
    for e, t, p, q in cells:
        h[e, at[t]] = p, q
    hops = [h, np.einsum("ij,ejc->eic", a, h), np.einsum("ij,ejc->eic", a @ a, h)]
    got = gs.smoothed_channels(wide, ["p", "q"], adj, 2).collect()
    assert len(got) == (np.abs(hops[2]).sum(axis=2) > 0).sum()
    for r in got:
        assert np.allclose(r.x, np.concatenate([k[r.entity_id, at[r.term_id]] for k in hops]))


def test_models_are_optimal_and_never_see_their_fold(spark):
    wide, truth, terms, adj, _, _ = inputs(spark)
    fold = F.pmod(F.col("entity_id"), F.lit(3))
    ia = spark.createDataFrame([("a0", 0.5), ("a1", 2.0)], "term_id string, ia double")
    x = gs.smoothed_channels(wide, ["p", "q"], adj, 1)
    rows = gs.training_rows(x, truth, ia, terms, ["BP", "MF"], fold, 2, 1.0)
    m = gs.fit(rows, ["BP", "MF"], 2)
    data = rows.collect()
    assert {r.term_id for r in data} == {"a0", "a1", "a2", "c0", "c1"}  # no aspect, no row
    assert len({tuple(r.draws) for r in data}) > 4
    for i in range(2):
        for k, f in enumerate(m.folds):
            use = [r for r in data if r.a == i and r.fold != f]
            xs = np.array([[*r.x, 1.0] for r in use])
            for s in range(2):
                p = 1 / (1 + np.exp(-xs @ m.weights[i, k, s]))
                g = xs.T @ (np.array([r.draws[s] for r in use]) * (p - np.array([r.y for r in use]))) + 1e-3 * m.weights[i, k, s]
                assert np.abs(g).max() < 1e-4
    got = {(r.entity_id, r.term_id): r.score for r in gs.graph_stacker(
        wide, ["p", "q"], truth, ia, terms, adj, fold, ("BP", "MF"), hops=1, seeds=2).collect()}
    assert len(got) == len(data)
    for r in data:
        p = 1 / (1 + np.exp(-np.array([*r.x, 1.0]) @ m.weights[r.a, m.folds.index(r.fold)].T))
        assert abs(got[r.entity_id, r.term_id] - p.mean()) < 1e-5


def test_no_rows_and_one_class(spark):
    wide, truth, terms, adj, _, _ = inputs(spark, 9)
    ia = spark.createDataFrame([], "term_id string, ia double")
    fold = F.pmod(F.col("entity_id"), F.lit(3))
    assert gs.graph_stacker(wide.where("false"), ["p", "q"], truth, ia, terms, adj, fold).count() == 0
    got = gs.graph_stacker(wide, ["p", "q"], truth.where("false"), ia, terms, adj, fold, seeds=1).collect()
    assert got and all(r.score < 0.05 for r in got)
