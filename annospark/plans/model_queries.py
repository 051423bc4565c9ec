"""Model and selection queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from annospark.functions import vectors as V
from annospark.operators import boosting, ensemble, features, graph_stacker as GS, knn, logistic, models, ontology as G, selection as SEL
from annospark.plans import standins as S
from annospark.plans.knn_queries import knn_sql
from annospark.plans.label_queries import CONTRACT_SQL, contract
from annospark.plans.metric_queries import GRID, MODELS
from annospark.plans.registry import query
from annospark.plans.source_queries import scratch

# Candidate neighbour counts, per-aspect thresholds and the threshold grid.
TUNE_KS = [3, 5, 7, 10, 15, 20]
TUNE_THRESHOLDS = {"BP": 0.4, "MF": 0.4, "CC": 0.3}
SWEEP_KS = [5, 10, 15, 20, 25, 50]
SWEEP_GRID = [0.1, 0.2, 0.3, 0.4, 0.5]

ROW_MAX_SQL = ("SELECT k, query_id, term_id, aspect, score / (CASE WHEN greatest(max(score) OVER (PARTITION BY k, query_id), "
               "0) = 0 THEN 1.0 ELSE greatest(max(score) OVER (PARTITION BY k, query_id), 0) END) AS score FROM raw")


def _x(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vec"))


def _labels(spark, d):
    e = S.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("entity_id"), S.term_col(F.col("label").cast("long")).alias("term_id"),
                    S.aspect_col(F.col("label")).alias("aspect"))


def _label_terms(spark, d) -> list[str]:
    # the label vocabulary (distinct labels, bounded by the number of classes)
    return sorted(r["term_id"] for r in _labels(spark, d).select("term_id").distinct().collect())


@query("linear_score", "F8 F1", sql=knn_sql(1).split("pairs AS")[0].rstrip(",\n ") + (
       ", p AS (SELECT vec_id, unnest(range(len(u))) AS pos, unnest(u) AS value FROM u), "
       "c AS (SELECT l.term_id, p.pos, avg(p.value) AS w FROM p JOIN veclab l ON p.vec_id = l.entity_id GROUP BY 1, 2), "
       "xe AS (SELECT vec_id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM vec), "
       "z AS (SELECT xe.vec_id, c.term_id, sum(xe.value * c.w) AS z FROM xe JOIN c ON xe.pos = c.pos GROUP BY 1, 2) "
       "SELECT vec_id AS entity_id, term_id, round(1.0 / (1.0 + exp(-least(greatest(z, -50.0), 50.0))), 6) AS score "
       "FROM z"))
def q_linear(spark, d):
    u = S.table(spark, d, "embeddings").select("vec_id", V.l2_normalise(F.col("embedding")).alias("u"))
    p = u.select("vec_id", F.posexplode("u").alias("pos", "value"))
    lab = _labels(spark, d).select(F.col("entity_id").alias("vec_id"), "term_id")
    c = p.join(lab, "vec_id").groupBy("term_id", "pos").agg(F.avg("value").alias("w"))
    # the weight block (terms x dims) is the model: bounded by its own size
    cw = c.groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("ws")).toPandas()
    model = pd.DataFrame({"term_id": cw["term_id"], "w": [[x["w"] for x in ws] for ws in cw["ws"]], "b": 0.0})
    s = models.linear_score(_x(spark, d), model, floor=0.0)
    return s.select("entity_id", "term_id", F.round("score", 6).alias("score"))


FOLD = "pmod(entity_id, 5)"


def _logistic(spark, d, steps):
    x, terms = _x(spark, d), _label_terms(spark, d)
    scaler = features.standard_scaler_fit(x, "vec").toPandas()  # one row per dimension
    m, blocks = logistic.ovr_logistic_fit(x, _labels(spark, d), terms, F.expr(FOLD), steps=steps, scaler=scaler)
    return logistic.out_of_fold(m, blocks).select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("ovr_logistic", "F7 F3")
def q_ovr(spark, d):
    """Out-of-fold scores after all steps."""
    return _logistic(spark, d, 100)


# One gradient step from zero weights, written out: class weights, sums over the other folds, scores of the own fold.
@query("ovr_logistic_first_step", "F7 F3", sql=(
       "WITH e AS (SELECT vec_id, vec_id % 5 AS fold, label, embedding FROM embeddings), "
       "v AS (SELECT vec_id, fold, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS raw FROM e), "
       "sc AS (SELECT pos, avg(raw) AS mu, CASE WHEN stddev_pop(raw) = 0 THEN 1.0 ELSE stddev_pop(raw) END AS sd FROM v GROUP BY pos), "
       "z AS (SELECT vec_id, fold, label, v.pos, (raw - mu) / sd AS x FROM v JOIN sc ON v.pos = sc.pos), "
       "fl AS (SELECT DISTINCT fold FROM e), lb AS (SELECT DISTINCT label FROM e), "
       "k AS (SELECT fl.fold, lb.label, count(*) AS n, count(*) FILTER (WHERE e.label = lb.label) AS np FROM fl, lb, e "
       "WHERE e.fold <> fl.fold GROUP BY 1, 2), "
       "cw AS (SELECT fold, label, n, np, n / (2.0 * greatest(np, 1)) AS wp, n / (2.0 * greatest(n - np, 1)) AS wn FROM k), "
       "g AS (SELECT cw.fold, cw.label, z.pos, -0.5 * sum(CASE WHEN z.label = cw.label THEN -0.5 * wp ELSE 0.5 * wn END * x) / max(n) "
       "AS w FROM cw JOIN z ON z.fold <> cw.fold GROUP BY 1, 2, 3), "
       "b AS (SELECT fold, label, -0.5 * (-0.5 * wp * np + 0.5 * wn * (n - np)) / n AS b FROM cw) "
       "SELECT z.vec_id AS entity_id, 'GO:' || lpad(CAST(g.label AS VARCHAR), 7, '0') AS term_id, "
       "round(1.0 / (1.0 + exp(-least(greatest(sum(z.x * g.w) + max(b.b), -50.0), 50.0))), 6) AS score "
       "FROM z JOIN g ON z.fold = g.fold AND z.pos = g.pos JOIN b ON b.fold = g.fold AND b.label = g.label "
       "JOIN cw ON cw.fold = g.fold AND cw.label = g.label WHERE cw.np >= 2 GROUP BY 1, 2"))
def q_ovr_step(spark, d):
    return _logistic(spark, d, 1)


def _elite(lab) -> list[str]:
    """Terms with at least 50 positives: one row per class."""
    return [r["term_id"] for r in lab.groupBy("term_id").count().where(F.col("count") >= 50).orderBy("term_id").collect()]


@query("gbdt_elite", "F9 W1 W4")
def q_gbdt(spark, d):
    """Out-of-fold scores of all elite terms, divided by each entity's largest."""
    x, lab = _x(spark, d), _labels(spark, d)
    elite = _elite(lab)
    if not elite:
        return x.limit(0).select("entity_id", F.lit("").alias("term_id"), F.lit(0.0).alias("score"))
    m, blocks = boosting.boosted_ovr_fit(x, lab, elite, F.expr(FOLD))
    p = ensemble.row_max_normalise(boosting.out_of_fold(m, blocks))
    return p.select("entity_id", "term_id", F.round("score", 6).alias("score"))


# The first split of every fold's and term's first tree, with bins of width 1/32, on all rows and features.
# (1e-9 is added before rounding, as many sums lie just between two rounded values.)
@query("gbdt_root_splits", "F9", sql=(
       "WITH e AS (SELECT vec_id, vec_id % 5 AS fold, label, embedding FROM embeddings), "
       "v AS (SELECT fold, label, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM e), "
       "b AS (SELECT fold, label, j, CAST(least(greatest(ceil(x * 32 + 16) - 1, 0), 31) AS INTEGER) AS b FROM v), "
       "fl AS (SELECT DISTINCT fold FROM e), lb AS (SELECT DISTINCT label FROM e), "
       "k AS (SELECT fl.fold, lb.label, count(*) AS n, count(*) FILTER (WHERE e.label = lb.label) AS np FROM fl, lb, e "
       "WHERE e.fold <> fl.fold GROUP BY 1, 2), "
       "h AS (SELECT k.fold, k.label, j, b, count(*) AS n, count(*) FILTER (WHERE b.label = k.label) AS np FROM k JOIN b ON b.fold <> k.fold "
       "GROUP BY 1, 2, 3, 4), "
       "grid AS (SELECT k.*, j, b FROM k, (SELECT DISTINCT j FROM b), (SELECT unnest(range(31)) AS b)), "
       "l AS (SELECT grid.fold, grid.label, grid.j, grid.b, max(grid.n) AS n, max(grid.np) AS np, coalesce(sum(h.n), 0) AS ln, "
       "coalesce(sum(h.np), 0) AS lp FROM grid LEFT JOIN h ON h.fold = grid.fold AND h.label = grid.label AND h.j = grid.j AND h.b <= grid.b "
       "GROUP BY 1, 2, 3, 4), "
       "s AS (SELECT *, np / n AS p, ln * (np / n) - lp AS gl, (n - ln) * (np / n) - (np - lp) AS gr, ln * (np / n) * (1 - np / n) AS hl, "
       "(n - ln) * (np / n) * (1 - np / n) AS hr FROM l), "
       "q AS (SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1) AS gain FROM s "
       "WHERE ln >= 10 AND n - ln >= 10), "
       "el AS (SELECT label FROM e GROUP BY 1 HAVING count(*) >= 50) "
       "SELECT CAST(fold AS INTEGER) AS fold, 'GO:' || lpad(CAST(label AS VARCHAR), 7, '0') AS term_id, CAST(j AS INTEGER) AS feature, b AS bin, "
       "round(gain + 1e-9, 6) AS gain, round(gl + 1e-9, 6) AS left_g, round(hl + 1e-9, 6) AS left_h, CAST(ln AS DOUBLE) AS left_n FROM q "
       "WHERE gain > 1e-12 AND label IN (SELECT label FROM el) "
       "QUALIFY row_number() OVER (PARTITION BY fold, label ORDER BY round(gain, 9) DESC, j, b) = 1"))
def q_gbdt_root(spark, d):
    x, lab = _x(spark, d), _labels(spark, d)
    schema = "fold int, term_id string, feature int, bin int, gain double, left_g double, left_h double, left_n double"
    elite = _elite(lab)
    if not elite:
        return spark.createDataFrame([], schema)
    cuts = np.tile(np.arange(-15, 16) / 32, (len(x.first()["vec"]), 1))
    p = boosting.BoostParams(trees=1, depth=1, subsample=1.0, columns=1.0)
    m, _ = boosting.boosted_ovr_fit(x, lab, elite, F.expr(FOLD), p, cuts=cuts)
    rows = [(r["fold"], elite[r["term"]], r["feature"], r["bin"], *(round(r[c] + 1e-9, 6) for c in ("gain", "left_g", "left_h")), r["left_n"])
            for r in m.root_splits if r["feature"] >= 0]  # one row per fold and term
    return spark.createDataFrame(rows, schema)


@query("graph_stacker", "F11 F10 G7 G6")
def q_stacker(spark, d):
    c = contract(spark, d)
    sc = S.scores(spark, d).join(c.select("term_id"), "term_id", "left_semi")
    wide = ensemble.stack_features(sc, MODELS)
    ens = ensemble.ensemble_mean(sc, n_models=3)
    sm = G.graph_smooth(ens, G.normalised_adjacency(S.edges(spark, d), c), hops=1).withColumnRenamed("score", "hop1")
    f = wide.join(sm, ["entity_id", "term_id"], "left").fillna(0.0, subset=["hop1"])
    p = models.graph_stacker_fit_predict(f, S.truth(spark, d), S.ia(spark, d), MODELS + ["hop1"], max_iter=20)
    return p.select("entity_id", "term_id", F.round("score", 6).alias("score"))


def _stacker_inputs(spark, d):
    c = contract(spark, d)
    terms = S.terms(spark, d).join(c.select("term_id"), "term_id", "left_semi")
    wide = ensemble.stack_features(S.scores(spark, d).join(c.select("term_id"), "term_id", "left_semi"), MODELS)
    adj = G.normalised_adjacency(GS.edges_within_aspects(S.edges(spark, d), terms), c)
    return wide, terms, adj


@query("graph_stacker_out_of_fold", "F11 F10 G6 G7 A22")
def q_stacker_oof(spark, d):
    wide, terms, adj = _stacker_inputs(spark, d)
    p = GS.graph_stacker(wide, MODELS, S.truth(spark, d), S.ia(spark, d), terms, adj, F.pmod(F.col("entity_id"), F.lit(5)))
    return p.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("graph_stacker_channels", "F11 F10 G6 G7", sql=S.with_("scores", "terms", "edges", "ann", "ck", extra=CONTRACT_SQL + (
       ", ct AS (SELECT t.term_id, t.aspect FROM terms t WHERE t.term_id IN (SELECT term_id FROM contract)), "
       "ie AS (SELECT e.child, e.parent FROM edges e JOIN ct a ON e.child = a.term_id JOIN ct b ON e.parent = b.term_id "
       "AND a.aspect = b.aspect), "
       "aj AS (SELECT child AS i, parent AS j FROM ie UNION SELECT parent, child FROM ie UNION SELECT term_id, term_id FROM ct), "
       "dg AS (SELECT i, count(*) AS n FROM aj GROUP BY 1), "
       "w1 AS (SELECT aj.i, aj.j, 1.0 / sqrt(x.n * y.n) AS w FROM aj JOIN dg x ON aj.i = x.i JOIN dg y ON aj.j = y.i), "
       "s AS (SELECT * FROM scores WHERE term_id IN (SELECT term_id FROM contract)), "
       "h0 AS (SELECT entity_id, term_id, model, score FROM s), "
       "h1 AS (SELECT entity_id, w1.i AS term_id, model, sum(w * score) AS score FROM h0 JOIN w1 ON term_id = j GROUP BY 1, 2, 3), "
       "h2 AS (SELECT entity_id, w1.i AS term_id, model, sum(w * score) AS score FROM h1 JOIN w1 ON term_id = j GROUP BY 1, 2, 3), "
       "h AS (SELECT 0 AS hop, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2) ")) + "SELECT entity_id, term_id, " +
       ", ".join(f"round(sum(CASE WHEN hop = {k} AND model = '{m}' THEN score ELSE 0.0 END), 6) AS {m}_hop{k}"
                 for k in range(3) for m in MODELS) + " FROM h GROUP BY 1, 2")
def q_stacker_channels(spark, d):
    wide, _, adj = _stacker_inputs(spark, d)
    x = GS.smoothed_channels(wide, MODELS, adj, 2)
    names = [f"{m}_hop{k}" for k in range(3) for m in MODELS]
    return x.select("entity_id", "term_id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(names)])


@query("resume_by_fold", "F12 A21 J8 J9 W11", sql=knn_sql(10) +
       "SELECT k.query_id, l.term_id, round(sum(k.sim) / max(den.denom), 6) AS score "
       "FROM knn k JOIN (SELECT DISTINCT entity_id, term_id FROM veclab) l ON k.base_id = l.entity_id "
       "JOIN den USING (query_id) GROUP BY 1, 2")
def q_resume(spark, d):
    v = S.vectors(spark, d)
    lab = S.vector_labels(spark, d)
    out = scratch(spark, "oof-folds")

    def compute(f):
        n = knn.knn_join(v.filter(F.col("fold") == f), v.filter(F.col("fold") != f), 10, exclude_self=True)
        return knn.neighbour_label_transfer(n, lab)
    models.run_folds(spark, [0, 1], out, compute)           # an interrupted run: two folds done
    t = models.run_folds(spark, [0, 1, 2, 3, 4], out, compute)  # resume computes only 2, 3, 4
    oof = ensemble.oof_assemble(t.withColumnRenamed("query_id", "entity_id"))
    return oof.select(F.col("entity_id").alias("query_id"), "term_id", F.round("score", 6).alias("score"))


@query("minirun_subset", "F13", sql=(
       "WITH top AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 5), "
       "e AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 100) "
       "SELECT e.vec_id, CAST(unnest(range(16)) AS INTEGER) AS pos, round(CAST(unnest(e.embedding[1:16]) AS DOUBLE), 6) "
       "AS value, CASE WHEN x.label IN (SELECT label FROM top) THEN x.label END AS label FROM e JOIN embeddings x "
       "ON e.vec_id = x.vec_id"))
def q_minirun(spark, d):
    e = S.table(spark, d, "embeddings")
    top = e.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(5).select("label")
    first = e.orderBy("vec_id").limit(100)
    lab = F.when(F.col("label").isin([r["label"] for r in top.collect()]), F.col("label"))  # <= 5 labels
    x = first.select("vec_id", F.slice("embedding", 1, 16).alias("v"), lab.alias("label"))
    return x.select("vec_id", F.posexplode("v").alias("pos", "value"), "label") \
        .select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"), "label")


def _neigh(spark, d, k):
    v = S.vectors(spark, d)
    return knn.knn_join(v, v, k, fold_col="fold")


PF1_SQL = (
    ", tr AS (SELECT DISTINCT vec_id AS entity_id, ('GO:' || lpad(CAST(label AS VARCHAR), 7, '0')) AS term_id, "
    "(CASE WHEN label % 3 = 0 THEN 'BP' WHEN label % 3 = 1 THEN 'MF' ELSE 'CC' END) AS aspect FROM embeddings), "
    "tn AS (SELECT entity_id, aspect, count(*) AS tru FROM tr GROUP BY 1, 2), "
    "pk AS (SELECT {by}, p.entity_id, p.aspect, count(*) AS pred, count(t.term_id) AS tp FROM pred p LEFT JOIN tr t "
    "ON p.entity_id = t.entity_id AND p.term_id = t.term_id AND p.aspect = t.aspect GROUP BY ALL), "
    "per AS (SELECT {by}, pk.aspect, sum(2.0 * tp / (pred + tru)) / {n} AS f1 FROM pk JOIN tn ON pk.entity_id = "
    "tn.entity_id AND pk.aspect = tn.aspect WHERE tp > 0 GROUP BY ALL), "
    "res AS (SELECT * FROM per WHERE aspect IN ('BP', 'MF', 'CC') UNION ALL SELECT {by}, 'ALL', sum(f1) / 3.0 FROM "
    "per WHERE aspect IN ('BP', 'MF', 'CC') GROUP BY ALL) ")


@query("tune_k", "E14 J8 J9", sql=knn_sql(max(TUNE_KS)) + (
       ", ks AS (SELECT * FROM (VALUES " + ", ".join(f"({k})" for k in TUNE_KS) + ") t(k)), "
       "nk AS (SELECT ks.k, knn.* FROM knn JOIN ks ON knn.rank <= ks.k), "
       "dk AS (SELECT k, query_id, sum(sim) AS denom FROM nk GROUP BY 1, 2), "
       "lab AS (SELECT DISTINCT vec_id AS entity_id, ('GO:' || lpad(CAST(label AS VARCHAR), 7, '0')) AS term_id, "
       "(CASE WHEN label % 3 = 0 THEN 'BP' WHEN label % 3 = 1 THEN 'MF' ELSE 'CC' END) AS aspect FROM embeddings), "
       "raw AS (SELECT nk.k, nk.query_id, l.term_id, l.aspect, sum(nk.sim) / (max(dk.denom) + 1e-9) AS score FROM nk "
       "JOIN lab l ON nk.base_id = l.entity_id JOIN dk ON dk.k = nk.k AND dk.query_id = nk.query_id GROUP BY 1, 2, 3, 4), "
       "sc AS (" + ROW_MAX_SQL + "), "
       "pred AS (SELECT k, query_id AS entity_id, term_id, aspect FROM sc WHERE score >= CASE aspect " +
       " ".join(f"WHEN '{a}' THEN {t!r}" for a, t in TUNE_THRESHOLDS.items()) + " END)") +
       PF1_SQL.format(by="k", n="(SELECT count(*) FROM embeddings)") +
       "SELECT k, aspect, round(f1, 6) AS f1, row_number() OVER (PARTITION BY aspect ORDER BY round(f1, 12) DESC, k) = 1 AS "
       "is_best FROM res")
def q_tune_k(spark, d):
    n = S.table(spark, d, "embeddings").count()
    r = SEL.tune_k(_neigh(spark, d, max(TUNE_KS)), _labels(spark, d), TUNE_KS, TUNE_THRESHOLDS, n)
    return r.select(F.col("k").cast("int").alias("k"), "aspect", F.round("f1", 6).alias("f1"), "is_best")


WEIGHT_GRID = SEL.simplex_grid(3, 11)


GRID_WEIGHTS_SQL = (S.with_("scores", "truth", "terms", extra=(
       "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)"
                                                 for i, (a, b, c) in enumerate(WEIGHT_GRID)) +
       ") t(combo, w_m1, w_m2, w_m3)), "
       "wide AS (SELECT s.entity_id, s.term_id, tm.aspect, coalesce(max(score) FILTER (WHERE model = 'm1'), 0.0) AS m1, "
       "coalesce(max(score) FILTER (WHERE model = 'm2'), 0.0) AS m2, coalesce(max(score) FILTER (WHERE model = 'm3'), "
       "0.0) AS m3 FROM scores s JOIN terms tm ON s.term_id = tm.term_id GROUP BY 1, 2, 3), "
       "pred AS (SELECT w.combo, wide.entity_id, wide.term_id, wide.aspect FROM wide, w WHERE w.w_m1 * wide.m1 + "
       "w.w_m2 * wide.m2 + w.w_m3 * wide.m3 >= {thr})")) +
       PF1_SQL.replace("SELECT DISTINCT vec_id AS entity_id, ('GO:' || lpad(CAST(label AS VARCHAR), 7, '0')) AS "
                       "term_id, (CASE WHEN label % 3 = 0 THEN 'BP' WHEN label % 3 = 1 THEN 'MF' ELSE 'CC' END) AS "
                       "aspect FROM embeddings", "SELECT DISTINCT entity_id, term_id, aspect FROM truth")
       .replace(", tr AS (", ", tr0 AS (").replace("FROM tr GROUP BY", "FROM tr0 GROUP BY")
       .replace("LEFT JOIN tr t", "LEFT JOIN tr0 t").format(by="combo", n="(SELECT count(*) FROM orders)") +
       ", full_ AS (SELECT w.*, coalesce(res.f1, 0.0) AS f1 FROM w LEFT JOIN (SELECT * FROM res WHERE aspect = 'ALL') "
       "res ON w.combo = res.combo) SELECT CAST(combo AS INTEGER) AS combo, w_m1, w_m2, w_m3, round(f1, 6) AS f1, "
       "CAST(row_number() OVER (ORDER BY round(f1, 12) DESC, combo) AS INTEGER) AS rank FROM full_ QUALIFY rank <= 5")
# Thresholds by aspect, as in J10.
WEIGHT_THRESHOLDS = {"BP": 0.4, "MF": 0.4, "CC": 0.3}


def _grid_weights(spark, d, thr):
    n = S.entities(spark, d).count()
    r = SEL.grid_search_weights(S.scores(spark, d), S.truth(spark, d), S.terms(spark, d), MODELS, 11, thr, n)
    return r.select("combo", "w_m1", "w_m2", "w_m3", F.round("f1", 6).alias("f1"), "rank")


@query("grid_search_weights", "E15 A20", sql=GRID_WEIGHTS_SQL.replace("{thr}", "0.5"))
def q_grid_weights(spark, d):
    return _grid_weights(spark, d, 0.5)


@query("grid_search_weights_by_aspect", "E15 A20", sql=GRID_WEIGHTS_SQL.replace("{thr}", "CASE wide.aspect " + " ".join(
       f"WHEN '{a}' THEN {t!r}" for a, t in WEIGHT_THRESHOLDS.items()) + " END"))
def q_grid_weights_aspect(spark, d):
    return _grid_weights(spark, d, WEIGHT_THRESHOLDS)


@query("sweep_k_thresholds", "E16 J8 J9 E6", sql=knn_sql(max(SWEEP_KS)) + (
       ", ks AS (SELECT * FROM (VALUES " + ", ".join(f"({k})" for k in SWEEP_KS) + ") t(k)), "
       "gr AS (SELECT unnest([" + ", ".join(f"{g!r}::DOUBLE" for g in SWEEP_GRID) + "]) AS thr), "
       "nk AS (SELECT ks.k, knn.query_id, knn.base_id, least(greatest(knn.sim, 0.0), 1.0) AS sim FROM knn JOIN ks ON "
       "knn.rank <= ks.k), "
       "dk AS (SELECT k, query_id, CASE WHEN sum(sim) = 0 THEN 1.0 ELSE sum(sim) END AS denom FROM nk GROUP BY 1, 2), "
       "lab AS (SELECT DISTINCT vec_id AS entity_id, ('GO:' || lpad(CAST(label AS VARCHAR), 7, '0')) AS term_id, "
       "(CASE WHEN label % 3 = 0 THEN 'BP' WHEN label % 3 = 1 THEN 'MF' ELSE 'CC' END) AS aspect FROM embeddings), "
       "raw AS (SELECT nk.k, nk.query_id, l.term_id, l.aspect, sum(nk.sim) / max(dk.denom) AS score FROM nk JOIN lab l "
       "ON nk.base_id = l.entity_id JOIN dk ON dk.k = nk.k AND dk.query_id = nk.query_id GROUP BY 1, 2, 3, 4), "
       "sc AS (" + ROW_MAX_SQL + "), "
       "sj AS (SELECT sc.*, CASE WHEN t.entity_id IS NULL THEN 0 ELSE 1 END AS y FROM sc LEFT JOIN lab t ON "
       "t.entity_id = sc.query_id AND t.term_id = sc.term_id AND t.aspect = sc.aspect), "
       "tn AS (SELECT aspect, count(*) AS tru FROM lab GROUP BY 1), "
       "cnt AS (SELECT sj.k, sj.aspect, gr.thr, count(*) FILTER (WHERE score >= thr) AS pred, count(*) FILTER (WHERE "
       "score >= thr AND y = 1) AS tp FROM sj, gr GROUP BY 1, 2, 3), "
       "c2 AS (SELECT cnt.*, tn.tru FROM cnt JOIN tn ON cnt.aspect = tn.aspect), "
       "combo AS (SELECT b.k, b.thr AS thr_bp, m.thr AS thr_mf, c.thr AS thr_cc, b.tp + m.tp + c.tp AS tp, "
       "(b.pred - b.tp) + (m.pred - m.tp) + (c.pred - c.tp) AS fp, (b.tru - b.tp) + (m.tru - m.tp) + (c.tru - c.tp) "
       "AS fn FROM c2 b JOIN c2 m ON b.k = m.k AND b.aspect = 'BP' AND m.aspect = 'MF' JOIN c2 c ON c.k = b.k AND "
       "c.aspect = 'CC'), f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 "
       "END AS f1 FROM combo) ") +
       "SELECT CAST(k AS INTEGER) AS k, thr_bp, thr_mf, thr_cc, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER "
       "(PARTITION BY k ORDER BY round(f1, 12) DESC, thr_bp, thr_mf, thr_cc) = 1")
def q_sweep(spark, d):
    r = SEL.sweep_k_thresholds(_neigh(spark, d, max(SWEEP_KS)), _labels(spark, d), SWEEP_KS,
                               {"BP": SWEEP_GRID, "MF": SWEEP_GRID, "CC": SWEEP_GRID})
    return r.select(F.col("k").cast("int").alias("k"), "thr_bp", "thr_mf", "thr_cc", F.round("f1", 6).alias("f1"))


@query("greedy_forward_selection", "E12 E7 A19")
def q_greedy(spark, d):
    steps = SEL.greedy_forward_selection(S.scores(spark, d), S.truth(spark, d), S.terms(spark, d), S.ia(spark, d),
                                         MODELS, GRID)
    # the selection trace: at most one row per model
    return spark.createDataFrame(steps, "step int, added string, best_thr double, best_f1 double") \
        .withColumn("best_f1", F.round("best_f1", 6))
