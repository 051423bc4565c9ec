"""Article files, update-mode sinks, late and replayed files, set digests and Fmax by knowledge group."""

import shutil

import pytest
from pyspark.sql import functions as F

from annospark.operators import audit, metrics
from annospark.sources import articles
from annospark.streaming import jobs


def article(pmid, title, abstract):
    return (f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><ArticleTitle>{title}</ArticleTitle><Abstract>"
            f"<AbstractText>{abstract}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>\n")


def test_article_files(spark, tmp_path):
    long = "word " * 40_000
    (tmp_path / "a.xml").write_text(
        "<?xml version='1.0'?>\n<PubmedArticleSet>\n" + article(1, "One", "a &lt;b&gt; <i>c</i>") + article(2, "Two", "x &nbsp; y")
        + "<PubmedArticle Status='s'>" + article(3, "Three", "é")[len("<PubmedArticle>"):] + article("", "No id", "z") + "</PubmedArticleSet>\n")
    (tmp_path / "b.xml").write_text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>4</PMID>" + article(5, "Five", long)
        + article(5, "Five", long) + "<PubmedArticle><MedlineCitation><PMID>6</PMID><Arti")
    (tmp_path / "c.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    (tmp_path / "d.xml").write_text("")
    for split in ("128m", "16k"):  # whole files, and many splits of one file
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            good, bad = articles.read_article_files(spark, str(tmp_path))
            got = sorted(tuple(r) for r in good.collect())
            assert got == [("1", "One", "a <b> c"), ("3", "Three", "é"), ("5", "Five", long.strip()), ("5", "Five", long.strip())]
            assert sorted((r.file[-5:], r.xml.split("<PMID>")[1][0]) for r in bad.collect()) == \
                [("a.xml", "2"), ("b.xml", "4"), ("b.xml", "6")]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_batch_delivered_twice_counts_once(spark, tmp_path):
    out, sink = str(tmp_path / "t"), jobs.update_sink(str(tmp_path / "t"))
    schema = spark.createDataFrame([], "evidence string, rows long").schema
    assert jobs.latest_updates(spark, out, schema, ["evidence"]).count() == 0
    batches = [[("IEA", 2), (None, 1)], [("IEA", 5)], [("IDA", 1)]]
    for epoch in (0, 1, 1, 2, 2):
        sink(spark.createDataFrame(batches[epoch], schema), epoch)
    got = jobs.latest_updates(spark, out, schema, ["evidence"])
    assert {(r.evidence, r["rows"]) for r in got.collect()} == {("IEA", 5), (None, 1), ("IDA", 1)}


def line(entity, term, evidence="IEA"):
    return "\t".join(["DB", entity, entity, "", term, "R", evidence, "", "P"]) + "\n"


def test_replayed_and_late_files_change_nothing(spark, tmp_path):
    src, out, ckpt = (tmp_path / n for n in ("src", "out", "ckpt"))
    src.mkdir()
    ents = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    closure = spark.createDataFrame([("t1", "t1"), ("t1", "t0"), ("t0", "t0")], "term_id string, ancestor string")
    train = spark.createDataFrame([("e2", "t0")], "entity_id string, term_id string")

    def run():
        r = jobs.incremental_external_ingest(spark, str(src), ents, closure, closure.select("term_id"), str(out), str(ckpt), train=train)
        return sorted((x.entity_id, x.term_id) for x in r.collect())
    (src / "a.gaf").write_text("!gaf\n" + line("e1", "t1") + line("e2", "t1") + line("e3", "t1") + line("e1", "t0", "IDA"))
    first = run()
    assert first == [("e1", "t0"), ("e1", "t1"), ("e2", "t1")]
    shutil.copy(src / "a.gaf", src / "b.gaf")
    (src / "c.gaf").write_text(line("e1", "t0"))
    assert run() == first


def test_set_diversity(spark):
    pred = spark.createDataFrame([("a", "x", "BP"), ("a", "y", "BP"), ("b", "y", "BP"), ("b", "x", "BP"), ("b", "x", "BP"),
                                  ("c", "x", "BP"), ("d", None, "MF")], "entity_id string, term_id string, aspect string")
    got = {r.aspect: (r.terms, r.set_diversity) for r in audit.prediction_diversity(pred, 6).collect()}
    assert got == {"BP": (2, 0.5), "MF": (0, 0.5)}


def test_fmax_by_knowledge(spark):
    terms = spark.createDataFrame([("b0", "BP"), ("b1", "BP"), ("m0", "MF")], "term_id string, aspect string")
    ia = spark.createDataFrame([("b0", 1.0), ("b1", 3.0), ("m0", 2.0)], "term_id string, ia double")
    closure = spark.createDataFrame([("b0", "b0"), ("b1", "b1"), ("b1", "b0"), ("m0", "m0")], "term_id string, ancestor string")
    truth = spark.createDataFrame([("n", "b1"), ("l", "b0"), ("p", "m0"), ("q", "b1")], "entity_id string, term_id string")
    scores = spark.createDataFrame([("n", "b0", 0.9), ("n", "b1", 0.4), ("l", "b1", 0.5), ("p", "m0", 0.2), ("q", "m0", 1.0),
                                    ("x", "b1", 1.0), ("n", "zz", 1.0)], "entity_id string, term_id string, score double")
    prior = spark.createDataFrame([("l", "MF"), ("p", "MF"), ("p", "BP"), ("p", "CC"), ("q", "BP")], "entity_id string, aspect string")
    r = metrics.fmax_by_knowledge(scores, truth, terms, ia, closure, metrics.prior_knowledge(prior), [0.1, 0.45, 0.8])
    got = {(x.knowledge, x.aspect): (x.thr, x.fmax) for x in r.collect()}
    assert len(got) == 13 and got["no", "BP"] == (0.1, 1.0) and got["partial", "MF"] == (0.1, 1.0)
    # b1 at 0.5 also predicts b0: precision 1 / 4, recall 1
    assert got["limited", "BP"] == (0.1, pytest.approx(0.4)) and got["no", "CC"] == (None, 0.0)
    assert got["no", "ALL"] == (None, pytest.approx(1 / 3)) and got["ALL", "ALL"] == (None, pytest.approx(2.4 / 9))
    none = metrics.fmax_by_knowledge(scores, truth.filter(F.lit(False)), terms, ia, closure, metrics.prior_knowledge(prior))
    assert {x.fmax for x in none.collect()} == {0.0}
