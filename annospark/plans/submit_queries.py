"""Ranking, formatting and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import ensemble, submit as U
from annospark.plans import standins as S
from annospark.plans.registry import query
from annospark.session import ensure_checkpoint_dir
from annospark.sources.tables import read_submission

TOP_N = 5
WEIGHTS = {"m1": 0.5, "m2": 0.3, "m3": 0.4}
ENS = ("ens AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score "
       "FROM scores GROUP BY 1, 2)")
FUSED = ("fused AS (SELECT entity_id, term_id, list_reduce(list_sort(list(CASE model WHEN 'm1' THEN 0.5 WHEN 'm2' "
         "THEN 0.3 WHEN 'm3' THEN 0.4 ELSE 0.0 END * score)), lambda a, b: a + b) AS score FROM scores GROUP BY 1, 2)")
TOPN_SQL = ("top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, term_id) "
            "AS rank FROM (SELECT entity_id, term_id, least(greatest(score, 0.0), 1.0) AS score FROM ens) "
            f"WHERE score > 0) WHERE rank <= {TOP_N})")
DESC_SQL = ("t3 AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, "
            "e.term_id) AS r FROM ens e) WHERE r <= 3), "
            "d0 AS (SELECT t3.entity_id, CAST(t3.entity_id AS VARCHAR) || ' is predicted to be involved in: ' || "
            "string_agg(coalesce(tm.name, t3.term_id), ', ' ORDER BY r) || '.' AS txt, max(score) AS top FROM t3 "
            "LEFT JOIN terms tm ON t3.term_id = tm.term_id GROUP BY 1), "
            "d1 AS (SELECT entity_id, regexp_replace(regexp_replace(txt, '[\\t\\r\\n]', ' ', 'g'), "
            "'[^\\x20-\\x7E]', '?', 'g') AS txt, top FROM d0), "
            "descr AS (SELECT entity_id, CASE WHEN length(txt) > 2900 THEN substr(txt, 1, 2897) || '...' ELSE txt "
            "END AS description, least(greatest(top, 0.001), 1.0) AS score FROM d1)")


def _ens(spark, d):
    return ensemble.ensemble_mean(S.scores(spark, d), n_models=3)


def _fused(spark, d):
    return ensemble.weighted_fusion(S.scores(spark, d), WEIGHTS)


@query("top_n_per_entity", "W5 A19", sql=S.with_("scores", extra=ENS + ", " + TOPN_SQL) +
       "SELECT entity_id, term_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def q_topn(spark, d):
    t = U.top_n_per_entity(_ens(spark, d), TOP_N)
    return t.select("entity_id", "term_id", F.round("score", 6).alias("score"), "rank")


@query("top_n_expected_value", "W6 J1", sql=S.with_("scores", "ia", extra=ENS) +
       "SELECT entity_id, term_id, round(least(greatest(score, 0.001), 1.0), 6) AS score, CAST(rank AS INTEGER) "
       "AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ev DESC, term_id) AS rank FROM "
       "(SELECT e.entity_id, e.term_id, e.score, e.score * coalesce(ia.ia, 0.0) AS ev FROM ens e LEFT JOIN ia "
       f"ON e.term_id = ia.term_id WHERE e.score >= 0.05 AND e.score > 0)) WHERE rank <= {TOP_N}")
def q_topev(spark, d):
    t = U.top_n_by_expected_value(_ens(spark, d), S.ia(spark, d), TOP_N, min_conf=0.05)
    return t.select("entity_id", "term_id", F.round("score", 6).alias("score"), "rank")


@query("top_n_expected_value_row_max", "W6 W1 J1", sql=S.with_("scores", "ia", extra=ENS) +
       "SELECT entity_id, term_id, round(least(greatest(score, 0.001), 1.0), 6) AS score, CAST(rank AS INTEGER) "
       "AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ev DESC, term_id) AS rank FROM "
       "(SELECT e.entity_id, e.term_id, e.score, e.score * coalesce(ia.ia, 0.0) AS ev FROM (SELECT entity_id, term_id, score / "
       "(CASE WHEN max(score) OVER (PARTITION BY entity_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY entity_id) END) AS score "
       f"FROM ens) e LEFT JOIN ia ON e.term_id = ia.term_id WHERE e.score >= 0.05 AND e.score > 0)) WHERE rank <= {TOP_N}")
def q_topev_row_max(spark, d):
    t = U.top_n_by_expected_value(_ens(spark, d), S.ia(spark, d), TOP_N, min_conf=0.05, row_max=True)
    return t.select("entity_id", "term_id", F.round("score", 6).alias("score"), "rank")


@query("aspect_threshold", "P8 A19", sql=S.with_("scores", "terms", "thr", extra=ENS) +
       "SELECT e.entity_id, e.term_id, tm.aspect, round(e.score, 6) AS score FROM ens e JOIN terms tm "
       "ON e.term_id = tm.term_id LEFT JOIN thr ON tm.aspect = thr.aspect WHERE e.score >= coalesce(thr.thr, "
       "(SELECT thr FROM thr WHERE aspect = 'ALL'))")
def q_aspect_thr(spark, d):
    s = _ens(spark, d).join(S.terms(spark, d).select("term_id", "aspect"), "term_id")
    r = keys.aspect_threshold(s, S.thresholds(spark))
    return r.select("entity_id", "term_id", "aspect", F.round("score", 6).alias("score"))


@query("weighted_fusion_clip", "A20 P9", sql=S.with_("scores", extra=FUSED) +
       "SELECT entity_id, term_id, round(least(greatest(score, 0.001), 1.0), 6) AS score FROM fused")
def q_fusion(spark, d):
    f = ensemble.clip_scores(_fused(spark, d), 0.001, 1.0)
    return f.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("top3_description", "W12", sql=S.with_("scores", "terms", extra=ENS + ", " + DESC_SQL) +
       "SELECT entity_id, description, round(score, 6) AS score FROM descr")
def q_top3(spark, d):
    r = U.top3_description(_ens(spark, d), S.terms(spark, d))
    return r.select("entity_id", "description", F.round("score", 6).alias("score"))


LINES_SQL = (", lines AS (SELECT CAST(entity_id AS VARCHAR) || '\t' || term_id || '\t' || printf('%.3g', score) "
             "AS line FROM top UNION ALL SELECT CAST(entity_id AS VARCHAR) || '\tText\t' || printf('%.3g', score) "
             "|| '\t' || description FROM descr) ")


def _lines(spark, d):
    e = _ens(spark, d)
    return U.submission_with_text(U.top_n_per_entity(e, TOP_N), U.top3_description(e, S.terms(spark, d)))


@query("submission_lines", "S14 W13 W5 W12", sql=S.with_("scores", "terms", extra=ENS + ", " + TOPN_SQL + ", " +
       DESC_SQL) + LINES_SQL + "SELECT line FROM lines")
def q_lines(spark, d):
    return _lines(spark, d).select("line")


@query("submission_line_audit", "P15 S12", sql=S.with_("scores", "terms", extra=ENS + ", " + TOPN_SQL + ", " +
       DESC_SQL) + LINES_SQL + (
       ", p AS (SELECT string_split(line, '\t') AS parts FROM lines), k AS (SELECT len(parts) AS n_cols, CASE "
       "WHEN starts_with(parts[2], 'GO:') THEN 'go' WHEN parts[2] = 'Text' THEN 'text' ELSE 'other' END AS kind, "
       "parts[2] AS second FROM p) ") +
       "SELECT CAST(n_cols AS INTEGER) AS n_cols, count(*) AS lines, count(*) FILTER (WHERE kind = 'go') AS go_like, "
       "count(*) FILTER (WHERE kind = 'text') AS text, count(*) FILTER (WHERE kind = 'other') AS other, "
       "count(*) FILTER (WHERE kind = 'go' AND NOT regexp_full_match(second, 'GO:[0-9]{7}')) AS bad_go "
       "FROM k GROUP BY 1")
def q_line_audit(spark, d):
    return U.audit_submission_lines(_lines(spark, d).select("line"))


@query("validate_submission", "W16 A20", sql=S.with_("scores", "terms", extra=FUSED + ", " + ENS + ", " +
       DESC_SQL + ", txt AS (SELECT entity_id, description FROM descr UNION ALL SELECT doc_id, text FROM documents "
       "WHERE text IS NOT NULL)") +
       "SELECT 'score_range' AS rule, entity_id, term_id, CAST(round(score, 6) AS VARCHAR) AS detail FROM fused "
       "WHERE NOT (score > 0 AND score <= 1) UNION ALL SELECT 'go_format', entity_id, term_id, NULL FROM fused "
       "WHERE NOT regexp_full_match(term_id, 'GO:[0-9]{7}') UNION ALL SELECT 'duplicate', entity_id, term_id, "
       "CAST(count(*) AS VARCHAR) FROM fused GROUP BY 2, 3 HAVING count(*) > 1 UNION ALL SELECT 'too_many_terms', "
       f"entity_id, NULL, CAST(count(*) AS VARCHAR) FROM fused GROUP BY 2 HAVING count(*) > {TOP_N} UNION ALL "
       "SELECT 'text_too_long', entity_id, NULL, CAST(sum(length(description)) AS VARCHAR) FROM txt GROUP BY 2 "
       "HAVING sum(length(description)) > 3000 UNION ALL SELECT 'text_not_ascii', "
       "entity_id, NULL, NULL FROM txt WHERE regexp_matches(description, '[^\\x20-\\x7E]')")
def q_validate(spark, d):
    """Two text rows for an entity that has a document: the description and the whole document."""
    f = _fused(spark, d)
    desc = U.top3_description(_ens(spark, d), S.terms(spark, d))
    more = S.table(spark, d, "documents").filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("entity_id"), F.col("text").alias("description"), F.lit(0.5).alias("score"))
    return U.validate_submission(f, desc.unionByName(more), max_terms=TOP_N)


@query("submission_stats", "A15 W5", sql=S.with_("scores", extra=ENS + ", " + TOPN_SQL) +
       "SELECT count(*) AS rows, count(DISTINCT entity_id) AS entities, count(DISTINCT term_id) AS terms, "
       "round(count(*) / count(DISTINCT entity_id), 6) AS per_entity FROM top")
def q_sub_stats(spark, d):
    r = U.submission_stats(U.top_n_per_entity(_ens(spark, d), TOP_N))
    return r.select("rows", "entities", "terms", F.round("per_entity", 6).alias("per_entity"))


@query("submission_roundtrip", "S12 S14", sql=S.with_("scores", "terms", extra=ENS + ", " + TOPN_SQL + ", " +
       DESC_SQL) + LINES_SQL + ", p AS (SELECT string_split(line, '\t') AS parts FROM lines) "
       "SELECT parts[1] AS entity, CAST(len(parts) AS INTEGER) AS n_cols, count(*) AS n FROM p GROUP BY 1, 2")
def q_submission_roundtrip(spark, d):
    """Lines written as text files and read back with all their fields."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/submission-{uuid.uuid4().hex}"
    _lines(spark, d).select(F.col("line").alias("value")).write.text(path)
    r = read_submission(spark, path)
    return r.groupBy(F.get("parts", F.lit(0)).alias("entity"), "n_cols").agg(F.count("*").alias("n"))
