"""Structured Streaming queries (T1-T3) over files derived from the driver tables.

The inputs are written as several files into a fresh folder under the
checkpoint dir, then consumed as a stream with ``availableNow`` (one file
per micro-batch), so the running state really spans batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import ensemble, ontology as G
from annospark.plans import standins as S
from annospark.plans.label_queries import CONTRACT_SQL, contract
from annospark.plans.metric_queries import THR, cells_sql, prf_sql
from annospark.plans.ontology_queries import FULL_CL, _rec
from annospark.plans.registry import query
from annospark.plans.source_queries import scratch
from annospark.sources import tables
from annospark.streaming import jobs

FILES = 4


def _gaf_source(spark, d) -> str:
    path = scratch(spark, "gaf-stream")
    tables.write_gaf(S.external(spark, d).repartition(FILES), path)
    return path


@query("stream_ingest_external", "T1 G2 J6 P7", sql=_rec("edges", "ext", "ann", "ck",
       extra=CONTRACT_SQL + ",\n" + FULL_CL) +
       "SELECT DISTINCT CAST(x.entity_id AS VARCHAR) AS entity_id, cl.ancestor AS term_id, 1.0 AS score FROM ext x "
       "JOIN cl ON x.term_id = cl.term_id WHERE x.evidence = 'IEA' AND cl.ancestor IN (SELECT term_id FROM contract)")
def q_stream_ingest(spark, d):
    src = _gaf_source(spark, d)
    ents = S.entities(spark, d).select(F.col("entity_id").cast("string").alias("entity_id"))
    cl = G.ancestor_closure(S.edges(spark, d))
    out = scratch(spark, "t1-out")
    r = jobs.incremental_external_ingest(spark, src, ents, cl, contract(spark, d), out, out + "-ckpt")
    return r.select("entity_id", "term_id", "score")


@query("stream_ingest_train_wins", "T1 G2", sql=_rec("edges", "ext", "ann", "ck",
       extra=CONTRACT_SQL + ",\n" + FULL_CL) +
       "SELECT DISTINCT CAST(x.entity_id AS VARCHAR) AS entity_id, cl.ancestor AS term_id, 1.0 AS score FROM ext x "
       "JOIN cl ON x.term_id = cl.term_id WHERE x.evidence = 'IEA' AND cl.ancestor IN (SELECT term_id FROM contract) "
       "AND NOT EXISTS (SELECT 1 FROM ann a WHERE a.entity_id = x.entity_id AND a.term_id = cl.ancestor)")
def q_stream_ingest_train(spark, d):
    """Every line comes twice, in files of their own; pairs that training data hold are left out."""
    src, out = scratch(spark, "gaf-stream"), scratch(spark, "t1-train-out")
    ext = S.external(spark, d)
    tables.write_gaf(ext.unionByName(ext).repartition(FILES), src)
    text = F.col("entity_id").cast("string").alias("entity_id")
    r = jobs.incremental_external_ingest(
        spark, src, S.entities(spark, d).select(text), G.ancestor_closure(S.edges(spark, d)), contract(spark, d), out,
        out + "-ckpt", train=S.annotations(spark, d).select(text, "term_id"))
    return r.select("entity_id", "term_id", "score")


_T2_SQL = cells_sql() + (
    ", x AS (SELECT *, score >= coalesce(CASE aspect WHEN 'BP' THEN 0.2 WHEN 'MF' THEN 0.4 WHEN 'CC' THEN 0.4 "
    "END, 0.3) AS pred FROM cells), g AS (SELECT coalesce(aspect, 'ALL') AS aspect, "
    "sum(CASE WHEN pred AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, sum(CASE WHEN pred THEN ia ELSE 0.0 END) "
    "AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true FROM x GROUP BY ROLLUP (aspect)) ") + \
    "SELECT aspect, " + prf_sql("w_tp", "w_pred", "w_true") + \
    ", round(w_tp, 6) AS w_tp, round(w_pred, 6) AS w_pred, round(w_true, 6) AS w_true FROM g"


@query("stream_eval_counters", "T2 E1", sql=_T2_SQL)
def q_stream_eval(spark, d):
    src = scratch(spark, "scores-stream")
    ensemble.ensemble_mean(S.scores(spark, d), n_models=3).repartition(FILES).write.parquet(src)
    out = scratch(spark, "t2-out")
    r = jobs.running_evaluation_counters(
        spark, src, "entity_id long, term_id string, score double", S.truth(spark, d), S.terms(spark, d),
        S.ia(spark, d), THR, out, out + "-ckpt")
    return r.select("aspect", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "w_tp", "w_pred",
                                                                 "w_true")])


@query("stream_evidence_histogram", "T3 A10", sql=S.with_("ext") +
       "SELECT evidence, count(*) AS rows FROM ext GROUP BY 1")
def q_stream_hist(spark, d):
    src = _gaf_source(spark, d)
    out = scratch(spark, "t3-out")
    return jobs.running_evidence_histogram(spark, src, out, out + "-ckpt")
