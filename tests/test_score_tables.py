"""The score relation from one pass, model columns in one aggregate and compiled grid buckets."""

from pyspark.sql import functions as F

from annospark.operators import ensemble, metrics, text
from annospark.plans import standins as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_in_one_pass(spark, tmp_path):
    """one scan and one shuffle of lineitem for the three models."""
    rows = [(1, 7, 20.0, 0.1, 0.05, "A", "O"), (1, 7, 40.0, 0.3, None, "R", "F"), (2, 8, None, 1.0, None, "A", "O"),
            (3, 9, 0.0, None, 0.2, "N", "O"), (None, 7, 50.0, 0.5, 0.0, "R", None), (4, None, 10.0, 0.2, 0.02, None, "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double, "
                                "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = S.scores(spark, str(tmp_path))
    plan = _plan(got)
    want = [(1, "GO:0000007", "m1", 0.8), (1, "GO:0000007", "m2", 0.9), (1, "GO:0000007", "m3", 0.5), (2, "GO:0000008", "m3", 1.0),
            (None, "GO:0000007", "m1", 1.0), (4, None, "m1", 0.2), (4, None, "m2", 0.8)]
    assert sorted(((*r[:2], r.model, round(r.score, 9)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_model_columns_in_one_aggregate(spark):
    """F16: a pair's models side by side without grouping by model first."""
    rows = [(1, "a", "m1", 0.9), (1, "a", "m2", 0.2), (2, "b", "m3", 0.4), (2, "b", "m9", 0.7)]
    wide = ensemble.model_columns(spark.createDataFrame(rows, "entity_id long, term_id string, model string, score double"), ["m1", "m2", "m3"])
    plan = _plan(wide)
    assert sorted(map(tuple, wide.collect())) == [(1, "a", 0.9, 0.2, None), (2, "b", None, None, 0.4)]
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_grid_bucket_counts_the_thresholds_reached(spark):
    """by compiled comparisons, no function per threshold and row."""
    grid = metrics.linspace(0.05, 0.60, 23)
    values = [None, float("nan"), float("inf"), -1.0, 0.0, 0.049, 1.0, *grid, *(t + 1e-12 for t in grid), *(t - 1e-12 for t in grid)]
    for g in (grid, [0.5], [], [0.1, 0.1, 0.3]):
        df = spark.createDataFrame([(v,) for v in values], "score double").select("score", metrics.grid_bucket(F.col("score"), g).alias("b"))
        for r in df.collect():
            s = r.score
            assert r.b == sum(s is not None and (s != s or t <= s) for t in g), (s, g)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_shuffles_tokens_not_ngrams(spark):
    """only tokens by document and sums by term are dealt; a document in two rows counts once."""
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "aa aa"), (3, None), (None, "cc aa")], "id long, t string")
    got = text.tfidf(docs, "id", "t", 10)
    plan = _plan(got)
    assert "hashpartitioning(doc" in plan and not any("hashpartitioning(doc" in x and "term" in x for x in plan.splitlines())
    assert {(r.id, r.term) for r in got.collect()} == {(1, "aa"), (1, "cc"), (2, "aa"), (None, "cc"), (None, "aa")}
