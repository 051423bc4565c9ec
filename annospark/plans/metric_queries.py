"""Metric, threshold-search and model-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import ensemble, labels as L, metrics as M
from annospark.plans import standins as S
from annospark.plans.registry import query

THR = dict(S.THRESHOLDS)
GRID = M.CALIBRATION_GRID
FMAX_GRID = M.linspace(0.01, 1.0, 100)
TRIPLES = [(0.2, 0.4, 0.4), (0.3, 0.3, 0.3), (0.25, 0.35, 0.35), (0.4, 0.4, 0.3)]
MODELS = ["m1", "m2", "m3"]


def _grid_sql(grid) -> str:
    return "[" + ", ".join(f"{t!r}::DOUBLE" for t in grid) + "]"


def cells_sql(ia_default: float = 0.0, ens: str = "SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score "
              "FROM scores GROUP BY 1, 2") -> str:
    return S.with_("scores", "truth", "terms", "ia", extra=(
        f"ens AS ({ens}),\n"
        "tr AS (SELECT DISTINCT entity_id, term_id FROM truth),\n"
        "cells0 AS (SELECT coalesce(e.entity_id, t.entity_id) AS entity_id, coalesce(e.term_id, t.term_id) "
        "AS term_id, coalesce(e.score, 0.0) AS score, CASE WHEN t.entity_id IS NULL THEN 0 ELSE 1 END AS y "
        "FROM ens e FULL OUTER JOIN tr t ON e.entity_id = t.entity_id AND e.term_id = t.term_id),\n"
        "cells AS (SELECT c.*, coalesce(tm.aspect, 'UNK') AS aspect, "
        f"coalesce(ia.ia, {float(ia_default)}) AS ia FROM cells0 c LEFT JOIN terms tm ON c.term_id = tm.term_id "
        "LEFT JOIN ia ON c.term_id = ia.term_id)"))


def _cells(spark, d, ia_default=0.0, scores=None):
    s = scores if scores is not None else ensemble.ensemble_mean(S.scores(spark, d), n_models=3)
    return M.cells(s, S.truth(spark, d), S.terms(spark, d), S.ia(spark, d), ia_default)


def _r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def prf_sql(tp: str, p: str, t: str) -> str:
    pr = f"(CASE WHEN {p} > 0 THEN {tp} / {p} ELSE 0.0 END)"
    rc = f"(CASE WHEN {t} > 0 THEN {tp} / {t} ELSE 0.0 END)"
    f1 = f"(CASE WHEN {pr} + {rc} > 0 THEN 2 * {pr} * {rc} / ({pr} + {rc}) ELSE 0.0 END)"
    return f"round({pr}, 6) AS precision, round({rc}, 6) AS recall, round({f1}, 6) AS f1"


def model_cells_sql(subsets: dict[str, list[str]] | None = None) -> str:
    """Per-model (or per-subset mean ensemble) cells ``mcells(model, ...)``."""
    subsets = subsets or {m: [m] for m in MODELS}
    blocks = []
    for name, ms in subsets.items():
        inl = ", ".join(f"'{m}'" for m in ms)
        blocks.append(
            f"SELECT '{name}' AS model, coalesce(e.entity_id, t.entity_id) AS entity_id, coalesce(e.term_id, "
            "t.term_id) AS term_id, coalesce(e.score, 0.0) AS score, CASE WHEN t.entity_id IS NULL THEN 0 ELSE 1 "
            "END AS y FROM (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / "
            f"{float(len(ms))} AS score FROM scores WHERE model IN ({inl}) GROUP BY 1, 2) e FULL OUTER JOIN tr t "
            "ON e.entity_id = t.entity_id AND e.term_id = t.term_id")
    return S.with_("scores", "truth", "terms", "ia", extra=(
        "tr AS (SELECT DISTINCT entity_id, term_id FROM truth),\n"
        "mc0 AS (" + " UNION ALL ".join(blocks) + "),\n"
        "mcells AS (SELECT c.*, coalesce(tm.aspect, 'UNK') AS aspect, coalesce(ia.ia, 0.0) AS ia FROM mc0 c "
        "LEFT JOIN terms tm ON c.term_id = tm.term_id LEFT JOIN ia ON c.term_id = ia.term_id)"))


MODEL_BEST_SQL = (
    ", gr AS (SELECT unnest({grid}) AS thr), cur AS (SELECT model, gr.thr, sum(CASE WHEN score >= thr AND y = 1 "
    "THEN ia ELSE 0.0 END) AS w_tp, sum(CASE WHEN score >= thr THEN ia ELSE 0.0 END) AS w_pred, sum(CASE WHEN "
    "y = 1 THEN ia ELSE 0.0 END) AS w_true FROM mcells, gr GROUP BY 1, 2), f AS (SELECT model, thr, {f1} AS f1 "
    "FROM cur), b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f1, 12) DESC, thr) AS rn FROM f), "
    "best AS (SELECT model, thr AS best_thr, f1 AS best_f1 FROM b WHERE rn = 1) ")


@query("ia_f1_pooled", "E1 A19 P8", sql=cells_sql() + (
       ", x AS (SELECT *, score >= coalesce(CASE aspect WHEN 'BP' THEN 0.2 WHEN 'MF' THEN 0.4 WHEN 'CC' THEN 0.4 "
       "END, 0.3) AS pred FROM cells), g AS (SELECT coalesce(aspect, 'ALL') AS aspect, "
       "sum(CASE WHEN pred AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, sum(CASE WHEN pred THEN ia ELSE 0.0 END) "
       "AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true, count(DISTINCT CASE WHEN pred THEN term_id "
       "END) AS terms_pred, count(DISTINCT CASE WHEN y = 1 THEN term_id END) AS terms_true FROM x "
       "GROUP BY ROLLUP (aspect)) ") +
       "SELECT aspect, " + prf_sql("w_tp", "w_pred", "w_true") +
       ", round(w_tp, 6) AS w_tp, round(w_pred, 6) AS w_pred, round(w_true, 6) AS w_true, terms_pred, terms_true "
       "FROM g")
def q_ia_f1(spark, d):
    r = M.ia_f1_pooled(_cells(spark, d), THR)
    return r.select("aspect", *_r("precision", "recall", "f1", "w_tp", "w_pred", "w_true"),
                    "terms_pred", "terms_true")


CURVE_SQL = (", gr AS (SELECT unnest({grid}) AS thr), cur AS (SELECT coalesce(c.aspect, 'ALL') AS aspect, gr.thr, "
             "sum(CASE WHEN score >= thr AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, "
             "sum(CASE WHEN score >= thr THEN ia ELSE 0.0 END) AS w_pred, "
             "sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true FROM cells c, gr "
             "GROUP BY GROUPING SETS ((c.aspect, gr.thr), (gr.thr))) ")


@query("threshold_curve", "E7 E1", sql=cells_sql() + CURVE_SQL.format(grid=_grid_sql(GRID)) +
       "SELECT aspect, thr, " + prf_sql("w_tp", "w_pred", "w_true") + " FROM cur")
def q_curve(spark, d):
    c = M.threshold_curve(_cells(spark, d), GRID)
    return c.select("aspect", "thr", *_r("precision", "recall", "f1"))


BEST_SQL = (", f AS (SELECT aspect, thr, {f1} AS f1 FROM cur), b AS (SELECT aspect, thr, f1, row_number() OVER "
            "(PARTITION BY aspect ORDER BY round(f1, 12) DESC, thr) AS rn FROM f) ")
_F1 = ("(CASE WHEN (CASE WHEN w_pred > 0 THEN w_tp / w_pred ELSE 0.0 END) + (CASE WHEN w_true > 0 THEN "
       "w_tp / w_true ELSE 0.0 END) > 0 THEN 2 * (CASE WHEN w_pred > 0 THEN w_tp / w_pred ELSE 0.0 END) * "
       "(CASE WHEN w_true > 0 THEN w_tp / w_true ELSE 0.0 END) / ((CASE WHEN w_pred > 0 THEN w_tp / w_pred ELSE "
       "0.0 END) + (CASE WHEN w_true > 0 THEN w_tp / w_true ELSE 0.0 END)) ELSE 0.0 END)")


@query("best_threshold", "E7", sql=cells_sql() + CURVE_SQL.format(grid=_grid_sql(GRID)) +
       BEST_SQL.format(f1=_F1) + "SELECT aspect, thr AS best_thr, round(f1, 6) AS best_f1 FROM b WHERE rn = 1")
def q_best(spark, d):
    b = M.best_threshold(M.threshold_curve(_cells(spark, d), GRID))
    return b.select("aspect", "best_thr", F.round("best_f1", 6).alias("best_f1"))


@query("calibrate_thresholds", "E8 E7 A19", sql=cells_sql() +
       CURVE_SQL.format(grid=_grid_sql(GRID)) + BEST_SQL.format(f1=_F1) +
       ", best AS (SELECT * FROM b WHERE rn = 1), cnt AS (SELECT aspect, count(*) AS n FROM cells GROUP BY 1), "
       "sc AS (SELECT * FROM (VALUES ('ALL'), ('BP'), ('MF'), ('CC'), ('UNK')) t(scope)) "
       "SELECT sc.scope, coalesce(best.thr, (SELECT thr FROM best WHERE aspect = 'ALL')) AS thr, "
       "round(coalesce(best.f1, (SELECT f1 FROM best WHERE aspect = 'ALL')), 6) AS f1, coalesce(cnt.n, 0) AS cells "
       "FROM sc LEFT JOIN best ON sc.scope = best.aspect LEFT JOIN cnt ON sc.scope = cnt.aspect")
def q_calibrate(spark, d):
    c = _cells(spark, d)
    r = M.calibrate_aspect_thresholds(c, GRID)
    return r.select("scope", "thr", F.round("f1", 6).alias("f1"), "cells")


@query("threshold_probe", "E9", sql=cells_sql() + (
       ", tri AS (SELECT * FROM (VALUES " + ", ".join(
           f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(TRIPLES)) +
       ") t(probe, thr_bp, thr_mf, thr_cc)), x AS (SELECT tri.*, sum(CASE WHEN score >= (CASE aspect WHEN 'BP' THEN "
       "thr_bp WHEN 'MF' THEN thr_mf ELSE thr_cc END) AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, sum(CASE WHEN "
       "score >= (CASE aspect WHEN 'BP' THEN thr_bp WHEN 'MF' THEN thr_mf ELSE thr_cc END) THEN ia ELSE 0.0 END) "
       "AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true FROM cells, tri WHERE aspect IN "
       "('BP', 'MF', 'CC') GROUP BY ALL) ") +
       "SELECT CAST(probe AS INTEGER) AS probe, thr_bp, thr_mf, thr_cc, " + prf_sql("w_tp", "w_pred", "w_true") +
       " FROM x")
def q_probe(spark, d):
    r = M.threshold_probe(_cells(spark, d), TRIPLES)
    return r.select("probe", "thr_bp", "thr_mf", "thr_cc", *_r("precision", "recall", "f1"))


def _entity_agg_sql(weight: str, thr: str, extra_where: str = "") -> str:
    return (f", k AS (SELECT entity_id, aspect, sum(CASE WHEN score >= {thr} AND y = 1 THEN {weight} ELSE 0.0 END) "
            f"AS tp, sum(CASE WHEN score >= {thr} THEN {weight} ELSE 0.0 END) AS pred, sum(CASE WHEN y = 1 THEN "
            f"{weight} ELSE 0.0 END) AS tru FROM cells WHERE aspect IN ('BP', 'MF', 'CC') {extra_where} "
            "GROUP BY 1, 2), pe AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS p, CASE WHEN tru > 0 "
            "THEN tp / tru ELSE 0.0 END AS r FROM k), pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) "
            "ELSE 0.0 END AS f FROM pe) ")


MEAN_ASPECTS_SQL = (
    ", asp AS (SELECT * FROM (VALUES ('BP'), ('MF'), ('CC')) t(aspect)), full_ AS (SELECT asp.aspect, "
    "coalesce(per.precision, 0.0) AS precision, coalesce(per.recall, 0.0) AS recall, coalesce(per.f1, 0.0) AS f1 "
    "FROM asp LEFT JOIN per ON asp.aspect = per.aspect) SELECT aspect, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_ UNION ALL SELECT 'ALL', round(sum(precision) / 3, 6), "
    "round(sum(recall) / 3, 6), round(sum(f1) / 3, 6) FROM full_")


@query("ia_f1_per_entity_all", "E2", sql=cells_sql() + _entity_agg_sql("ia", "0.5") +
       ", per AS (SELECT aspect, sum(p) / (SELECT count(*) FROM orders) AS precision, sum(r) / (SELECT count(*) "
       "FROM orders) AS recall, sum(f) / (SELECT count(*) FROM orders) AS f1 FROM pf GROUP BY 1)" + MEAN_ASPECTS_SQL)
def q_e2(spark, d):
    n = S.entities(spark, d).agg(F.count("*")).scalar()
    r = M.ia_f1_per_entity_all(_cells(spark, d), n, thr=0.5)
    return r.select("aspect", *_r("precision", "recall", "f1"))


@query("ia_f1_per_entity_with_truth", "E3", sql=cells_sql(ia_default=1.0).replace(
       "LEFT JOIN ia ON c.term_id = ia.term_id)", "LEFT JOIN ia ON c.term_id = ia.term_id),\n"
       "tt AS (SELECT DISTINCT aspect, term_id FROM cells WHERE y = 1), te AS (SELECT DISTINCT aspect, entity_id "
       "FROM cells WHERE y = 1), cells2 AS (SELECT c.* FROM cells c JOIN tt ON c.aspect = tt.aspect AND c.term_id "
       "= tt.term_id JOIN te ON c.aspect = te.aspect AND c.entity_id = te.entity_id)") +
       _entity_agg_sql("ia", "0.3").replace("FROM cells WHERE", "FROM cells2 WHERE").replace(
           "CASE WHEN tru > 0 THEN tp / tru", "CASE WHEN pred > 0 AND tru > 0 THEN tp / tru") +
       ", per AS (SELECT aspect, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1 FROM pf GROUP BY 1)" +
       MEAN_ASPECTS_SQL)
def q_e3(spark, d):
    r = M.ia_f1_per_entity_with_truth(_cells(spark, d, ia_default=1.0), thr=0.3)
    return r.select("aspect", *_r("precision", "recall", "f1"))


@query("f1_per_entity_unweighted", "E4", sql=cells_sql() + _entity_agg_sql("1.0", "0.3") +
       ", per AS (SELECT aspect, sum(p) / (SELECT count(*) FROM orders) AS precision, sum(r) / (SELECT count(*) "
       "FROM orders) AS recall, sum(f) / (SELECT count(*) FROM orders) AS f1 FROM pf GROUP BY 1)" + MEAN_ASPECTS_SQL)
def q_e4(spark, d):
    n = S.entities(spark, d).agg(F.count("*")).scalar()
    r = M.f1_per_entity_unweighted(_cells(spark, d), n, thr=0.3)
    return r.select("aspect", *_r("precision", "recall", "f1"))


@query("samples_prf", "E5", sql=cells_sql() + (
       ", k AS (SELECT entity_id, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE "
       "score >= 0.5) AS pred, count(*) FILTER (WHERE y = 1) AS tru FROM cells GROUP BY 1) ") +
       "SELECT round(sum(CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END) / (SELECT count(*) FROM orders), 6) AS "
       "precision, round(sum(CASE WHEN tru > 0 THEN tp / tru ELSE 0.0 END) / (SELECT count(*) FROM orders), 6) AS "
       "recall, round(sum(CASE WHEN pred + tru > 0 THEN 2 * tp / (pred + tru) ELSE 0.0 END) / (SELECT count(*) "
       "FROM orders), 6) AS f1 FROM k")
def q_e5(spark, d):
    n = S.entities(spark, d).agg(F.count("*")).scalar()
    return M.samples_prf(_cells(spark, d), n, 0.5).select(*_r("precision", "recall", "f1"))


@query("micro_f1", "E6", sql=cells_sql() + (
       ", m AS (SELECT 'strict' AS mode, count(*) FILTER (WHERE score > 0.5 AND y = 1) AS tp, count(*) FILTER "
       "(WHERE score > 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE NOT score > 0.5 AND y = 1) AS fn FROM cells "
       "UNION ALL SELECT 'inclusive', count(*) FILTER (WHERE score >= 0.5 AND y = 1), count(*) FILTER (WHERE "
       "score >= 0.5 AND y = 0), count(*) FILTER (WHERE NOT score >= 0.5 AND y = 1) FROM cells) ") +
       "SELECT mode, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 "
       "END, 6) AS f1 FROM m")
def q_e6(spark, d):
    c = _cells(spark, d)
    a = M.micro_f1(c, 0.5, strict=True).withColumn("mode", F.lit("strict"))
    b = M.micro_f1(c, 0.5, strict=False).withColumn("mode", F.lit("inclusive"))
    return a.unionByName(b).select("mode", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("fmax_official", "E10", sql=cells_sql() + (
       ", te AS (SELECT DISTINCT aspect, entity_id FROM cells WHERE y = 1 AND aspect IN ('BP', 'MF', 'CC')), "
       "c2 AS (SELECT c.* FROM cells c JOIN te ON c.aspect = te.aspect AND c.entity_id = te.entity_id), "
       f"gr AS (SELECT unnest({_grid_sql(FMAX_GRID)}) AS thr), "
       "e AS (SELECT c2.aspect, c2.entity_id, gr.thr, sum(CASE WHEN score >= thr THEN ia ELSE 0.0 END) AS wp, "
       "sum(CASE WHEN score >= thr AND y = 1 THEN ia ELSE 0.0 END) AS wtp, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) "
       "AS wt FROM c2, gr GROUP BY 1, 2, 3), nt AS (SELECT aspect, count(*) AS n FROM te GROUP BY 1), "
       "cur AS (SELECT e.aspect, thr, sum(CASE WHEN wp > 0 THEN wtp / wp END) AS sp, count(*) FILTER (WHERE wp > 0) "
       "AS np, sum(CASE WHEN wt > 0 THEN wtp / wt ELSE 0.0 END) AS sr FROM e GROUP BY 1, 2), "
       "pr AS (SELECT cur.aspect, thr, CASE WHEN np > 0 THEN sp / np ELSE 0.0 END AS p, sr / nt.n AS r FROM cur "
       "JOIN nt ON cur.aspect = nt.aspect), ff AS (SELECT aspect, thr, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) "
       "ELSE 0.0 END AS f FROM pr), b AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY round(f, 12) DESC, thr) "
       "AS rn FROM ff), asp AS (SELECT * FROM (VALUES ('BP'), ('MF'), ('CC')) t(aspect)), "
       "full_ AS (SELECT asp.aspect, b.thr, coalesce(b.f, 0.0) AS fmax FROM asp LEFT JOIN (SELECT * FROM b WHERE "
       "rn = 1) b ON asp.aspect = b.aspect) ") +
       "SELECT aspect, thr, round(fmax, 6) AS fmax FROM full_ UNION ALL SELECT 'ALL', NULL, round(sum(fmax) / 3, 6) "
       "FROM full_")
def q_fmax(spark, d):
    r = M.fmax_official(_cells(spark, d), FMAX_GRID)
    return r.select("aspect", "thr", F.round("fmax", 6).alias("fmax"))


@query("ia_weighted_bce", "E17 W2", sql=cells_sql() + (
       ", ann AS (" + S.SQL["ann"] + "), ck AS (" + S.SQL["ck"] + "), " +
       "cnt AS (SELECT term_id, aspect, count(*) AS n FROM ann GROUP BY 1, 2), "
       "rk AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term_id) AS rn FROM cnt), "
       "ct AS (SELECT rk.term_id, coalesce(ia.ia, 1.0) AS w FROM rk JOIN ck USING (aspect) LEFT JOIN ia ON "
       "rk.term_id = ia.term_id WHERE rn <= k), "
       "z AS (SELECT c.term_id, ln(least(greatest(c.score, 1e-7), 1 - 1e-7) / (1 - least(greatest(c.score, 1e-7), "
       "1 - 1e-7))) AS z, c.y FROM cells c WHERE c.term_id IN (SELECT term_id FROM ct)), "
       "lt AS (SELECT term_id, sum(ln(1 + exp(-abs(z))) + greatest(z, 0.0) - z * y) AS loss, count(*) AS np FROM z "
       "GROUP BY 1), z0 AS (SELECT ln(1e-7 / (1 - 1e-7)) AS z0) ") +
       "SELECT round(sum(ct.w * (coalesce(lt.loss, 0.0) + ((SELECT count(*) FROM orders) - coalesce(lt.np, 0)) * "
       "(ln(1 + exp(-abs(z0))) + greatest(z0, 0.0)))) / ((SELECT count(*) FROM orders) * (SELECT count(*) FROM ct)), "
       "6) AS bce FROM ct LEFT JOIN lt ON ct.term_id = lt.term_id, z0")
def q_bce(spark, d):
    from annospark.plans.label_queries import contract
    ct = L.join_ia(contract(spark, d).select("term_id"), S.ia(spark, d), default=1.0)
    n = S.entities(spark, d).count()
    c = _cells(spark, d).join(ct.select("term_id"), "term_id", "left_semi")
    return M.ia_weighted_bce(c, n, ct).select(F.round("bce", 6).alias("bce"))


@query("capped_pos_weight", "E18", sql=S.with_("truth") +
       "SELECT term_id, round(least(((SELECT count(*) FROM orders) - (count(*) + 1) + 1 + 1) / (count(*) + 1 + 1), "
       "20.0), 6) AS pos_weight FROM truth GROUP BY 1")
def q_posw(spark, d):
    n = S.entities(spark, d).count()
    r = M.capped_pos_weight(S.truth(spark, d), n)
    return r.select("term_id", F.round("pos_weight", 6).alias("pos_weight"))


@query("comparison_report", "E19 E1", sql=model_cells_sql() + (
       ", x AS (SELECT *, score >= coalesce(CASE aspect WHEN 'BP' THEN 0.2 WHEN 'MF' THEN 0.4 WHEN 'CC' THEN 0.4 "
       "END, 0.3) AS pred FROM mcells), g AS (SELECT model, coalesce(aspect, 'ALL') AS aspect, "
       "sum(CASE WHEN pred AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, sum(CASE WHEN pred THEN ia ELSE 0.0 END) "
       "AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true FROM x GROUP BY GROUPING SETS ((model, "
       "aspect), (model))), m AS (SELECT model, aspect, " + prf_sql("w_tp", "w_pred", "w_true") + " FROM g) ") +
       "SELECT model, aspect, 'precision' AS metric, precision AS value FROM m UNION ALL SELECT model, aspect, "
       "'recall', recall FROM m UNION ALL SELECT model, aspect, 'f1', f1 FROM m")
def q_report(spark, d):
    r = M.compare_subsets(S.scores(spark, d), S.truth(spark, d), S.terms(spark, d), S.ia(spark, d), {m: [m] for m in MODELS}, THR)
    return r.select("model", "aspect", "metric", F.round("value", 6).alias("value"))


@query("individual_model_scores", "E13 E7 E20", sql=model_cells_sql() + MODEL_BEST_SQL.format(
       grid=_grid_sql(GRID), f1=_F1) + "SELECT model, best_thr, round(best_f1, 6) AS best_f1, CASE WHEN best_f1 > "
       "0.05 THEN 'aligned' ELSE 'broken' END AS verdict FROM best")
def q_individual(spark, d):
    r = M.best_by_subset(S.scores(spark, d), S.truth(spark, d), S.terms(spark, d), S.ia(spark, d), {m: [m] for m in MODELS}, GRID)
    return r.select(F.col("subset").alias("model"), "best_thr", F.round("best_f1", 6).alias("best_f1"),
                    M.alignment_verdict(F.col("best_f1")).alias("verdict"))


ABL = {"ALL_MODELS": MODELS, **{f"-{m}": [x for x in MODELS if x != m] for m in MODELS}}


@query("ablation_leave_one_out", "E11 A19", sql=model_cells_sql(ABL) + MODEL_BEST_SQL.format(
       grid=_grid_sql(GRID), f1=_F1) + ", fullf AS (SELECT best_f1 AS ff FROM best WHERE model = 'ALL_MODELS') "
       "SELECT regexp_replace(model, '^-', '') AS removed, best_thr, round(best_f1, 6) AS best_f1, "
       "round(best_f1 - ff, 6) AS delta, CASE WHEN model = 'ALL_MODELS' THEN 'full' WHEN best_f1 - ff < -0.001 THEN "
       "'MVP' WHEN best_f1 - ff > 0.001 THEN 'confuser' ELSE 'neutral' END AS label FROM best, fullf")
def q_ablation(spark, d):
    r = M.ablation_leave_one_out(S.scores(spark, d), S.truth(spark, d), S.terms(spark, d), S.ia(spark, d), MODELS,
                                 GRID)
    return r.select("removed", "best_thr", F.round("best_f1", 6).alias("best_f1"),
                    F.round("delta", 6).alias("delta"), "label")


@query("metrics_by_fold", "E21 E1 E6", sql=cells_sql() + (
       ", x AS (SELECT CAST(entity_id % 5 AS INTEGER) AS fold, * FROM cells WHERE entity_id IN (SELECT o_orderkey "
       "FROM orders)), g AS (SELECT fold, sum(CASE WHEN score >= 0.3 AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, "
       "sum(CASE WHEN score >= 0.3 THEN ia ELSE 0.0 END) AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS "
       "w_true, count(*) FILTER (WHERE score >= 0.3 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND y = 0)"
       " AS fp, count(*) FILTER (WHERE score < 0.3 AND y = 1) AS fn FROM x GROUP BY 1) ") +
       "SELECT fold, round(" + _F1 + ", 6) AS ia_f1, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + "
       "fp + fn) ELSE 0.0 END, 6) AS micro_f1 FROM g")
def q_by_fold(spark, d):
    folds = S.entities(spark, d).select("entity_id", (F.col("entity_id") % 5).cast("int").alias("fold"))
    r = M.metrics_by_fold(_cells(spark, d), folds, 0.3)
    return r.select("fold", *_r("ia_f1", "micro_f1"))


@query("best_threshold_by_fold", "E21 E7", sql=cells_sql() + (
       ", x AS (SELECT CAST(entity_id % 5 AS INTEGER) AS fold, * FROM cells WHERE entity_id IN (SELECT o_orderkey FROM orders)), "
       "ba AS (SELECT fold, aspect, score, y, ia FROM x UNION ALL SELECT fold, 'ALL', score, y, ia FROM x), "
       "gr AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in GRID) + "]) AS thr), "
       "cur AS (SELECT fold, aspect, thr, sum(CASE WHEN score >= thr AND y = 1 THEN ia ELSE 0.0 END) AS w_tp, "
       "sum(CASE WHEN score >= thr THEN ia ELSE 0.0 END) AS w_pred, sum(CASE WHEN y = 1 THEN ia ELSE 0.0 END) AS w_true "
       "FROM ba, gr GROUP BY 1, 2, 3), f AS (SELECT fold, aspect, thr, " + _F1 + " AS f1 FROM cur) "
       "SELECT fold, aspect, thr AS best_thr, round(f1, 6) AS best_f1 FROM f QUALIFY row_number() OVER (PARTITION BY fold, aspect "
       "ORDER BY round(f1, 12) DESC, thr) = 1"))
def q_best_by_fold(spark, d):
    folds = S.entities(spark, d).select("entity_id", (F.col("entity_id") % 5).cast("int").alias("fold"))
    r = M.best_threshold_by_fold(_cells(spark, d), folds, GRID)
    return r.select("fold", "aspect", "best_thr", F.round("best_f1", 6).alias("best_f1"))
