import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annospark.operators import metrics, ontology


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    rows, numbers = rng.integers(0, 50, 4000), rng.integers(0, 1 << rng.integers(1, 40, 4000))
    rows = np.concatenate([rows, np.arange(50)])
    numbers = np.concatenate([numbers, np.full(50, 127)])
    column = ontology.packed(rows, numbers, 50)
    for part in (column, column.slice(7, 20)):
        row, number = ontology.unpacked(part)
        first = 0 if len(part) == 50 else 7
        want = sorted({(r - first, n) for r, n in zip(rows.tolist(), numbers.tolist()) if 0 <= r - first < len(part)})
        assert list(zip(row.tolist(), number.tolist())) == want


def test_tables_are_cut_between_entities(monkeypatch):
    monkeypatch.setattr(ontology, "PIECE", 4)
    keys = [None, None, "a", "a", "a", "b", "c", "d", "d"]
    table = pa.table({"entity_id": pa.array(keys), "above": pa.array([b"x" * n for n in (1, 1, 3, 3, 3, 1, 1, 2, 2)])})
    pieces = [p.column("entity_id").to_pylist() for p in ontology.whole_entities(table)]
    assert sum(pieces, []) == keys and pieces[-1] == ["d", "d"] and len(pieces) > 2
    assert all(a[-1] != b[0] for a, b in zip(pieces, pieces[1:]))


@pytest.fixture
def small(spark, monkeypatch):
    """A random ontology with repeated and null keys: rows, closure, terms, ia."""
    rnd = random.Random(11)
    terms = [f"t{i:02d}" for i in range(40)]
    edges = [(terms[i], terms[rnd.randrange(i)]) for i in range(1, 40) for _ in range(2)]
    closure = ontology.ancestor_closure(spark.createDataFrame(edges, "child string, parent string"))
    named = [(t, ("BP", "MF", "CC", "XX")[i % 4]) for i, t in enumerate(terms) if i % 9] + [("t05", "MF"), ("t06", "CC"), ("t06", "CC"), (None, "BP")]
    weight = [(t, None if i == 8 else 1.0 + i / 8) for i, t in enumerate(terms) if i % 5] + [("t07", 2.0), (None, 1.0)]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "none", *terms, *terms]), rnd.randrange(4), rnd.randrange(2)) for _ in range(400)]
    return (spark.createDataFrame(rows, "entity_id long, term_id string, b int, y int"), closure,
            spark.createDataFrame(named, "term_id string, aspect string"), spark.createDataFrame(weight, "term_id string, ia double"))


def met_by_rows(rows, closure, terms, ia):
    c = rows.join(closure, "term_id").groupBy("entity_id", F.col("ancestor").alias("term_id")).agg(F.max("b").alias("b"), F.max("y").alias("y"))
    c = c.join(terms.where("aspect != 'XX'"), "term_id").join(ia, "term_id", "left").withColumn("ia", F.coalesce("ia", F.lit(0.5)))
    return c.groupBy("aspect", "entity_id", "b").agg(F.sum("ia").alias("wp"), F.sum(F.when(F.col("y") == 1, F.col("ia")).otherwise(0.0)).alias("wt"),
                                                     F.max("y").alias("yt"))


def rounded(df):
    return sorted(((r.aspect, r.entity_id, r.b, round(r.wp, 9), round(r.wt, 9), r.yt) for r in df.collect()), key=str)


@pytest.mark.parametrize("batch", [3, 10000])
def test_sums_are_those_of_a_row_for_each_ancestor(spark, small, batch):
    rows, closure, terms, ia = small
    weights = terms.where("aspect != 'XX'").join(ia, "term_id", "left").groupBy("term_id", "aspect").agg(
        F.sum(F.coalesce("ia", F.lit(0.5))).alias("weight"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rounded(ontology.ancestor_sums(rows, closure, weights, 4))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == rounded(met_by_rows(*small)) and got


def test_no_weights_no_sums(spark, small):
    rows, closure, terms, ia = small
    none = terms.where(F.lit(False)).select("term_id", "aspect", F.lit(1.0).alias("weight"))
    assert ontology.ancestor_sums(rows, closure, none, 4).collect() == []


def test_fmax_shuffles_no_row_for_each_ancestor(spark, small, monkeypatch):
    """rows met all their ancestors in a join and were shuffled by (entity, ancestor)."""
    rows, closure, terms, ia = small
    monkeypatch.setattr(metrics, "cut_lineage", lambda df: df)  # the whole plan
    prior = metrics.prior_knowledge(rows.select("entity_id", F.lit("BP").alias("aspect")))
    r = metrics.fmax_by_knowledge(rows.select("entity_id", "term_id", (F.col("b") / 4).alias("score")), rows.where("y = 1"), terms, ia,
                                  closure, prior)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [entity_id" in line]
    assert grouped and not any("ancestor" in line for line in grouped)
