"""Pruned KNN against the block join: equal rows, few clusters opened on clustered vectors, defined edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import knn


def frame(spark, vectors):
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, fold int")


def triples(df):
    return {(r.query_id, r.base_id, round(r.sim, 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("fold", [None, "fold"])
def test_equal_and_pruned_on_clusters(spark, fold):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 8))
    # a third of all rows lie in one cluster, and some rows repeat
    where = np.concatenate([np.zeros(100, int), rnd.integers(0, 12, 180)])
    v = centres[where] + 0.02 * rnd.normal(size=(len(where), 8))
    v[5:9] = v[4]
    df = frame(spark, v)
    got, opened = knn.pruned_knn_join(df, df, 4, fold_col=fold, block_rows=16, query_rows=32, n_pivots=24)
    assert triples(got) == triples(knn.knn_join(df, df, 4, fold_col=fold))
    assert opened.count() < 0.35 * len(v) * 23


def test_equal_on_spread_and_zero_vectors(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(90, 5))
    v[7] = v[8] = 0.0
    df = frame(spark, v)
    got, _ = knn.pruned_knn_join(df, df, 3, block_rows=20)
    want = knn.knn_join(df, df, 3)
    assert triples(got) == triples(want)


def test_few_rows_and_no_rows(spark):
    df = frame(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]).union(
        spark.createDataFrame([(9, None, 0)], "vec_id long, embedding array<double>, fold int"))
    got, _ = knn.pruned_knn_join(df, df, 5, block_rows=1)
    assert triples(got) == triples(knn.knn_join(df.filter("vec_id < 9"), df.filter("vec_id < 9"), 5))
    none, opened = knn.pruned_knn_join(df, df.filter(F.lit(False)), 5)
    assert none.count() == 0 and opened.count() == 0
    assert knn.pruned_knn_join(df.filter(F.lit(False)), df, 5)[0].count() == 0


@pytest.mark.parametrize("spread", [True, False])
def test_small_clusters_share_blocks(spark, monkeypatch, spread):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(150, 6)) if spread else rnd.normal(size=(9, 6))[rnd.integers(0, 9, 150)] + 0.01 * rnd.normal(size=(150, 6))
    monkeypatch.setattr(knn, "PLACE_ROWS", 20)
    sizes = []
    packed = knn._packed
    monkeypatch.setattr(knn, "_packed", lambda rows, n: sizes.append((sum(rows), n, packed(rows, n))) or sizes[-1][2])
    df = frame(spark, v)
    got, _ = knn.pruned_knn_join(df, df, 4, fold_col="fold", block_rows=5, query_rows=40)  # 30 clusters
    assert triples(got) == triples(knn.knn_join(df, df, 4, fold_col="fold"))
    for rows, n, (first, count) in sizes:  # blocks and query blocks follow the rows, not the clusters
        assert rows == 150 and max(first + count) <= 2 * -(-rows // n) + 1


def test_packed_cuts_large_clusters_and_joins_small_ones():
    first, count = knn._packed(np.array([3, 4, 0, 25, 2, 9, 1]), 10)
    assert list(count) == [1, 1, 1, 3, 1, 1, 1]
    assert list(first) == [0, 0, 0, 1, 4, 5, 5]


def test_nearest_outside_every_fold_from_one_meeting(spark):
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(60, 4))
    v[5:8] = v[4]
    df = frame(spark, v).union(spark.createDataFrame([(None, [1.0, 0.0, 0.0, 0.5], None)], "vec_id long, embedding array<double>, fold int"))
    got = knn.knn_join_without_folds(df.where("vec_id IS NOT NULL"), df, 3, [0, 1, 2])
    for f in range(3):
        want = knn.knn_join(df.where("vec_id IS NOT NULL"), df.filter(F.col("fold") != f), 3)
        assert triples(got.filter(F.col("without") == f)) == triples(want)
