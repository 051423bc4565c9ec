"""One-pass model comparisons, joint rank correlation, resolved propagation and the audit reports, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import audit, labels, metrics, ontology, text


def _scores(spark):
    rows = [(1, "a", "m1", 0.9), (1, "a", "m2", 0.2), (1, "b", "m2", 0.7), (2, "a", "m1", 0.4), (2, "c", "m3", 0.8), (3, "b", "m3", 0.1)]
    scores = spark.createDataFrame(rows, "entity_id long, term_id string, model string, score double")
    truth = spark.createDataFrame([(1, "a"), (2, "c"), (4, "b"), (4, "b")], "entity_id long, term_id string")
    terms = spark.createDataFrame([("a", "BP"), ("b", "MF"), ("c", "CC")], "term_id string, aspect string")
    ia = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term_id string, ia double")
    return scores, truth, terms, ia


def test_subset_cells_equal_the_cells_of_each_subset(spark):
    scores, truth, terms, ia = _scores(spark)
    subsets = {"all": ["m1", "m2", "m3"], "m1": ["m1"], "m2+m3": ["m2", "m3"], "none": ["m9"]}
    got = metrics.subset_cells(scores, truth, terms, ia, subsets, ia_default=0.5)
    alone = metrics.subset_scores(scores, subsets)
    for name in subsets:
        want = metrics.cells(alone.where(F.col("subset") == name), truth, terms, ia, 0.5)
        columns = ["entity_id", "term_id", "score", "y", "ia", "aspect"]
        assert sorted(map(tuple, got.where(F.col("subset") == name).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    report = {(r.model, r.aspect, r.metric): r.value for r in metrics.compare_subsets(scores, truth, terms, ia, subsets, 0.3).collect()}
    for r in metrics.ia_f1_pooled(metrics.cells(alone.where("subset = 'all'"), truth, terms, ia), 0.3).collect():
        assert math.isclose(report["all", r.aspect, "f1"], r.f1) and math.isclose(report["all", r.aspect, "precision"], r.precision)
    assert metrics.subset_cells(scores.limit(0), truth.limit(0), terms, ia, subsets).count() == 0


def test_rank_correlation_with_ties(spark):
    import pandas as pd

    rows = [(0.0, 0.0)] * 50 + [(1.0, 0.3), (1.0, 0.0), (0.0, 0.9), (2.0, 0.9), (1.0, 0.3)]
    df = spark.createDataFrame(rows, "y double, score double")
    ranks = pd.DataFrame(rows, columns=["y", "score"]).rank()
    assert math.isclose(audit.rank_correlation(df).first()[0], ranks["y"].corr(ranks["score"]), rel_tol=1e-9)
    assert audit.rank_correlation(df.limit(0)).first()[0] is None
    assert audit.rank_correlation(df.where("y = 2")).first()[0] is None  # no spread


def test_propagation_keeps_original_ids_and_train_wins(spark):
    closure = ontology.ancestor_closure(spark.createDataFrame([("x", "r"), ("y", "r")], "child string, parent string"))
    contract = spark.createDataFrame([("x",), ("r",)], "term_id string")
    universe = spark.createDataFrame([("sp|P1|N", "train"), ("P1", "test"), ("tr|P2", "test"), ("P9", "test"), (None, "train")],
                                     "entity_id string, split string")
    rows = spark.createDataFrame([("P1", "x"), ("sp|P1|Q", "x"), ("P2", "y"), ("P3", "x"), (None, "x")], "raw_id string, term_id string")
    got = ontology.propagate_resolved(rows, universe, closure, contract)
    assert sorted(map(tuple, got.collect())) == [("sp|P1|N", "train", "r", 1.0), ("sp|P1|N", "train", "x", 1.0), ("tr|P2", "test", "r", 1.0)]
    assert ontology.propagate_resolved(rows.limit(0), universe, closure, contract).count() == 0


def test_reports(spark):
    left = spark.createDataFrame([("sp|1|a",), ("2",), ("2",), ("7",), (None,)], "k string")
    right = spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    got = {r.form: r for r in labels.key_overlap_report(left, right, "k", lambda k: keys.accession(k, "split"), samples=1).collect()}
    assert tuple(got["raw"])[1:] == (3, 3, 1, pytest.approx(1 / 3), "7", "1")
    assert tuple(got["clean"])[1:] == (3, 3, 2, pytest.approx(2 / 3), "7", "3")
    ann = spark.createDataFrame([(1, "a", "BP"), (1, "a", "BP"), (2, "a", "BP"), (2, "b", "BP"), (3, "c", "MF")],
                                "entity_id long, term_id string, aspect string")
    ents = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "entity_id long")
    assert sorted(map(tuple, labels.density_by_aspect(ann, ents).collect())) == [("BP", 2, 3, 3 / 8), ("MF", 1, 1, 1 / 4)]
    corpora = {"a": spark.createDataFrame([(1, "x"), (2, " "), (1, None)], "entity_id long, text string"),
               "b": spark.createDataFrame([(2, "y")], "entity_id long, text string")}
    assert {r.source: (r.with_text, r.non_empty) for r in text.text_coverage_by_source(ents, corpora, "entity_id").collect()} == {
        "a": (0.5, 0.25), "b": (0.25, 0.25), "any": (0.5, 0.5)}
    counts = spark.createDataFrame([("a", "BP", 5), ("b", "BP", 3), ("c", "MF", 4)], "term_id string, aspect string, n long")
    assert sorted((r.term_id, r.col_idx) for r in labels.top_k_per_aspect(counts, {"BP": None, "MF": 1}).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert {(r.entity_id, r.term_id) for r in labels.frequency_baseline(ents, ann, 1).collect()} == {(k, "a") for k in (1, 2, 3, 4)}
