"""Boosted trees and logistic regression against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import boosting, logistic


@pytest.fixture(scope="module")
def data(spark):
    from annospark.session import ship_package
    ship_package(spark)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((400, 6)), 3)
    ys = {"a": x[:, 0] + 0.3 * x[:, 1] ** 2 > 0.4, "b": (x[:, 2] > 0) ^ (x[:, 3] > 0.2), "noise": rng.random(400) < 0.3}
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(900, None)], "entity_id long, vec array<double>")
    lab = spark.createDataFrame([(k, t) for t, y in ys.items() for k in range(400) if y[k]] + [(3, "other"), (7000, "a")], "entity_id long, term_id string")
    return x, ys, df, lab


FOLD = "entity_id % 4"


def first_tree(x, y, use, cuts, p):
    """Values of every row after one tree, grown by trying all cuts."""
    start = np.log(y[use].mean() / (1 - y[use].mean()))
    prob = 1 / (1 + np.exp(-start))
    g, h = prob - y, np.full(len(y), prob * (1 - prob))
    out = np.zeros(len(y))

    def split(train, rows, depth):
        best = (1e-12, None)
        G, H = g[train].sum(), h[train].sum()
        for j in range(x.shape[1]):
            for c in cuts[j]:
                left = train & (x[:, j] <= c)
                right = train & ~left
                if min(left.sum(), right.sum()) >= p.least_rows:
                    gain = g[left].sum() ** 2 / (h[left].sum() + p.l2) + g[right].sum() ** 2 / (h[right].sum() + p.l2) - G ** 2 / (H + p.l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, c))
        if depth == 0 or best[1] is None or train.sum() < 2 * p.least_rows:
            out[rows] = -p.rate * G / (H + p.l2)
            return
        j, c = best[1]
        split(train & (x[:, j] <= c), rows & (x[:, j] <= c), depth - 1)
        split(train & (x[:, j] > c), rows & (x[:, j] > c), depth - 1)

    split(use, np.ones(len(y), bool), p.depth)
    return 1 / (1 + np.exp(-(start + out)))


def test_first_tree_equals_a_search_over_all_cuts(data):
    x, ys, df, lab = data
    p = boosting.BoostParams(trees=1, depth=3, subsample=1.0, columns=1.0, patience=9)
    cuts = np.tile(np.linspace(-1.5, 1.5, 31), (6, 1))
    m, blocks = boosting.boosted_ovr_fit(df, lab, ["a", "b"], F.expr(FOLD), p, cuts=cuts)
    m.best = {f: 1 for f in m.folds}
    got = {(r.entity_id, r.term_id): r.score for r in boosting.out_of_fold(m, blocks).collect()}
    assert len(got) == 800
    for t in ("a", "b"):
        for f in range(4):
            fold = np.arange(400) % 4
            want = first_tree(x, ys[t].astype(float), fold != f, cuts, p)
            assert all(abs(got[k, t] - want[k]) < 1e-9 for k in range(400) if k % 4 == f)


def test_trees_learn_stop_early_and_do_not_depend_on_blocks(data, monkeypatch):
    x, ys, df, lab = data
    p = boosting.BoostParams(trees=14, depth=3, patience=3, rate=0.3)
    terms = ["a", "b", "noise"]
    m, blocks = boosting.boosted_ovr_fit(df, lab, terms, F.expr(FOLD), p)
    got = {(r.entity_id, r.term_id): r.score for r in boosting.out_of_fold(m, blocks).collect()}
    for t in ("a", "b"):
        s = np.array([got[k, t] for k in range(400)])
        assert s[ys[t]].mean() > s[~ys[t]].mean() + 0.3
    assert all(len(losses) - 1 - m.best[f] <= 3 for f, losses in m.losses.items())
    new = {(r.entity_id, r.term_id): r.score for r in boosting.boosted_score(df, m).collect()}
    assert len(new) == 1200 and new[5, "a"] != got[5, "a"]
    monkeypatch.setattr(boosting, "CELLS", 12 * 70)  # blocks of 70 rows
    monkeypatch.setattr(boosting, "FEATURES", 4)     # two groups of features
    again, blocks = boosting.boosted_ovr_fit(df, lab, terms, F.expr(FOLD), p)
    assert blocks.count() > 3 and again.best == m.best
    other = {(r.entity_id, r.term_id): r.score for r in boosting.out_of_fold(again, blocks).collect()}
    assert max(abs(other[k] - got[k]) for k in got) < 1e-9


def test_few_bins_give_the_trees_of_the_passes_in_few_jobs(data, spark, monkeypatch):
    _, _, df, lab = data
    p = boosting.BoostParams(trees=12, depth=3, patience=5, rate=0.3)
    terms = ["a", "b", "noise"]
    monkeypatch.setattr(boosting, "CELLS", 12 * 70)  # several blocks

    def fit(group):
        spark.sparkContext.setJobGroup(group, group)
        m, blocks = boosting.boosted_ovr_fit(df, lab, terms, F.expr(FOLD), p)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return m, {(r.entity_id, r.term_id): r.score for r in boosting.out_of_fold(m, blocks).collect()}, jobs

    dealt, got, jobs = fit("dealt")
    monkeypatch.setattr(boosting, "WHOLE", 0)
    passed, want, passes = fit("passed")
    assert dealt.best == passed.best and len(dealt.trees) == len(passed.trees)
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() for a, b in zip(dealt.trees, passed.trees))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert all(abs(u - v) < 1e-9 for f in dealt.losses for u, v in zip(dealt.losses[f], passed.losses[f]))
    first = [{(r["fold"], r["term"]): (r["feature"], r["bin"], r["left_n"], r["n"]) for r in m.root_splits} for m in (dealt, passed)]
    assert first[0] == first[1]
    assert 2 * jobs < passes


def test_logistic_equals_a_plain_loop(data, monkeypatch):
    x, ys, df, lab = data
    monkeypatch.setattr(logistic, "CELLS", 9 * 70)
    monkeypatch.setattr(logistic, "SLICE", 4)
    terms = ["a", "noise", "none"]
    m, blocks = logistic.ovr_logistic_fit(df, lab, terms, F.expr(FOLD), steps=6)
    assert blocks.count() > 3
    got = {(r.entity_id, r.term_id): r.score for r in logistic.out_of_fold(m, blocks).collect()}
    assert len(got) == 800  # "none" has no positives and no model
    for t in ("a", "noise"):
        for f in range(4):
            use = np.arange(400) % 4 != f
            y, n = ys[t][use].astype(float), use.sum()
            w, b = np.zeros(6), 0.0
            for _ in range(6):
                s = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum()))) * (1 / (1 + np.exp(-(x[use] @ w + b))) - y)
                w, b = w - 0.5 * (x[use].T @ s / n + 1e-3 * w), b - 0.5 * s.sum() / n
            for k in range(f, 400, 4):
                assert abs(got[k, t] - 1 / (1 + np.exp(-(x[k] @ w + b)))) < 1e-9
