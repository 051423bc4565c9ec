"""Edge cases: NULL group keys and values, NaN scores, plain checkpoint rules."""

import pytest
from pyspark.sql import functions as F

from annospark import session
from annospark.functions import stats
from annospark.operators import submit


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, v int")
    got = stats.group_positions(df, ["g"], ["v"])
    assert sorted((str(r.g), r.v, r.pos) for r in got.collect()) == [("None", 3, 0), ("None", 4, 1), ("a", 1, 0), ("a", 2, 1)]


def test_null_values_are_not_in_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (None,)], "v double")
    assert stats.exact_quantiles(df, "v", {"median": 0.5}).first()["median"] == 2.0


def test_nan_scores_are_not_ranked(spark):
    s = spark.createDataFrame([(1, "t1", float("nan")), (1, "t2", 0.4)], "entity_id int, term_id string, score double")
    ia = spark.createDataFrame([("t1", 1.0), ("t2", 1.0)], "term_id string, ia double")
    assert [r.term_id for r in submit.top_n_per_entity(s).collect()] == ["t2"]
    assert [r.term_id for r in submit.top_n_by_expected_value(s, ia).collect()] == ["t2"]


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext, self.conf = _Context(master), {"spark.checkpoint.dir": conf}


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(_Session("spark://host:7077"))
    assert session.ensure_checkpoint_dir(_Session("spark://host:7077", "hdfs://h/x")) == "hdfs://h/x"
    assert session.ensure_checkpoint_dir(_Session("local[2]")).startswith("/tmp/")


def test_rounding_is_that_of_the_binary_value(spark):
    from annospark.operators import submit as U
    df = spark.createDataFrame([(0.1235,), (0.2345,), (0.09996,), (12.25,)], "x double")
    got = df.select(U.fmt_sig3(F.col("x")).alias("a"), U.fmt_fixed3(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in got] == ["0.123", "0.234", "0.1", "12.2"]
    assert [r["b"] for r in got][:2] == ["0.123", "0.234"]


def test_closure_self_loop_and_cycle(spark):
    from annospark.operators import ontology as G
    loop = spark.createDataFrame([("a", "a"), ("a", "b"), ("z", "z")], "child string, parent string")
    got = sorted(tuple(r) for r in G.ancestor_closure(loop).collect())
    assert got == [("a", "a"), ("a", "b"), ("b", "b"), ("z", "z")]
    with pytest.raises(ValueError, match="cycle"):
        G.ancestor_closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))


def test_text_limit_sums_the_rows_of_an_entity(spark):
    from annospark.operators import submit as U
    rows = spark.createDataFrame([(1, "GO:0000001", 0.5)], "entity_id int, term_id string, score double")
    desc = spark.createDataFrame([(1, "a" * 2900, 0.5), (1, "b" * 101, 0.5), (2, "c" * 3000, 0.5)],
                                 "entity_id int, description string, score double")
    got = [(r["rule"], r["entity_id"], r["detail"]) for r in U.validate_submission(rows, desc).collect()]
    assert got == [("text_too_long", 1, "3001")]


def test_weight_table_headers(spark, tmpdir_path):
    from annospark.sources import tables
    for name, text in (("a", "ia\tfull name\tterm\n0.5\ta name\tGO:1\nx\ty\tGO:2\n"), ("b", "GO:1\t0.5\nGO:2\n"),
                       ("c", "#Term Information_Accretion\nGO:1 0.5\n")):
        with open(f"{tmpdir_path}/{name}.tsv", "w") as f:
            f.write(text)
        assert [tuple(r) for r in tables.read_ia(spark, f"{tmpdir_path}/{name}.tsv").collect()] == [("GO:1", 0.5)]


def test_coverage_ranks_by_hand(spark):
    from annospark.operators import labels as L
    counts = spark.createDataFrame([("BP", "a", 9), ("BP", "b", 7), ("BP", "c", 5), ("BP", "d", 2), ("CC", "e", 1)],
                                   "aspect string, term_id string, n long")
    ia = spark.createDataFrame([("a", 1.0), ("b", 18.5), ("c", 0.5), ("d", 5.0), ("e", 1.0)], "term_id string, ia double")
    got = {r["aspect"]: tuple(r)[1:] for r in L.coverage_ranks(counts, ia, 5).collect()}
    assert got == {"BP": (4, 3, 2, 3, 5, 2, 0.8, 1.0), "CC": (1, 0, 0, 0, 0, 1, 0.0, float("inf"))}


def test_unreadable_fold_is_not_computed_again(spark, tmpdir_path):
    from annospark.operators import models
    made = []

    def compute(f):
        made.append(f)
        return spark.createDataFrame([(f * 10,)], "x int")

    out = f"{tmpdir_path}/folds"
    models.run_folds(spark, [0], out, compute)
    t = models.run_folds(spark, [0, 1], out, compute)
    assert made == [0, 1] and sorted(tuple(r) for r in t.collect()) == [(0, 0), (10, 1)]
    with open(f"{out}/fold=0/part-broken.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        models.run_folds(spark, [0, 1], out, compute).collect()
    assert made == [0, 1]


def test_knn_ties_give_k_rows_of_a_block(spark):
    import numpy as np
    import pandas as pd
    from annospark.operators import knn
    vec = [[0.0, 0.0]] * 5 + [[1.0, 0.0]] * 20
    left = pd.DataFrame({"qid": range(25), "qvec": vec})
    right = pd.DataFrame({"bid": np.arange(25)[::-1], "bvec": vec[::-1]})
    got = knn._block_topk(3, False, True)(left, right)
    assert got.groupby("query_id").size().eq(3).all()
    # the least ids of equal similarity: zero vectors are 0 from all, equal vectors 1 from each other
    assert sorted(got[got.query_id == 0].base_id) == [1, 2, 3] and sorted(got[got.query_id == 5].base_id) == [6, 7, 8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec)], "vec_id long, embedding array<double>")
    rows = knn.knn_join(df, df, 3, block_rows=4, query_rows=6).where("query_id = 20").orderBy("rank").collect()
    assert [r["base_id"] for r in rows] == [5, 6, 7]


def test_missing_thresholds_raise(spark):
    from annospark.functions import keys
    from annospark.operators import metrics
    s = spark.createDataFrame([("e", "t", "BP", 0.9), ("e", "u", "CC", 0.2)], "entity_id string, term_id string, aspect string, score double")
    thr = spark.createDataFrame([("BP", 0.5)], "aspect string, thr double")
    assert keys.aspect_threshold(s, thr, default=0.1).count() == 2
    with pytest.raises(Exception, match="no threshold for aspect CC"):
        keys.aspect_threshold(s, thr).collect()
    with pytest.raises(Exception, match="no threshold for aspect CC"):
        s.where(F.col("score") >= metrics.threshold_of({"BP": 0.5})).collect()
    assert s.where(F.col("score") >= metrics.threshold_of({"BP": 0.5, "ALL": 0.1})).count() == 2
    with pytest.raises(ValueError, match="no threshold for CC"):
        metrics.threshold_of({"BP": 0.5}, ("BP", "CC"))


def test_uniform_weights_and_repeated_corpus_keys(spark):
    from annospark.operators import labels
    t = spark.createDataFrame([("a",), ("b",)], "term_id string")
    zero = spark.createDataFrame([("a", 0.0)], "term_id string, ia double")
    assert {r.ia for r in labels.join_ia(t, zero, 0.0).collect()} == {0.0}
    assert {r.ia for r in labels.join_ia(t, zero, 0.0, uniform=True).collect()} == {1.0}
    some = spark.createDataFrame([("a", 2.0)], "term_id string, ia double")
    assert sorted(r.ia for r in labels.join_ia(t, some, 0.0, uniform=True).collect()) == [0.0, 2.0]
    e = spark.createDataFrame([("x", "X"), ("y", "Y")], "raw string, norm string")
    c = spark.createDataFrame([("x", "two"), ("x", "one"), (None, "none"), ("Y", "why")], "key string, text string")
    assert sorted((r.raw, r.text) for r in labels.align_text(e, c, "raw", "norm").collect()) == [("x", "one"), ("y", "why")]
