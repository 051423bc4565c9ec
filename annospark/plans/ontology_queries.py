"""Ontology queries: closure, propagation, adjacency, violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import ensemble, metrics as M, ontology as G
from annospark.plans import standins as S
from annospark.plans.label_queries import CONTRACT_SQL, contract
from annospark.plans.metric_queries import FMAX_GRID, _grid_sql
from annospark.plans.registry import query

PRIOR_WEIGHT = 0.15


def _rec(*names: str, extra: str) -> str:
    return "WITH RECURSIVE " + S.with_(*names, extra=extra)[len("WITH "):]


FULL_CL = (
    "anc(child, ancestor) AS (SELECT child, parent FROM edges UNION "
    "SELECT a.child, e.parent FROM anc a JOIN edges e ON a.ancestor = e.child),\n"
    "cl AS (SELECT child AS term_id, ancestor FROM anc UNION SELECT child, child FROM edges "
    "UNION SELECT parent, parent FROM edges)")

INDUCED_CL = (
    "ie AS (SELECT * FROM edges WHERE child IN (SELECT term_id FROM contract) AND parent IN "
    "(SELECT term_id FROM contract)),\n"
    "ianc(child, ancestor) AS (SELECT child, parent FROM ie UNION "
    "SELECT a.child, e.parent FROM ianc a JOIN ie e ON a.ancestor = e.child),\n"
    "icl AS (SELECT child AS term_id, ancestor FROM ianc UNION SELECT term_id, term_id FROM contract),\n"
    "ens AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score FROM scores GROUP BY 1, 2),\n"
    "sc AS (SELECT * FROM ens WHERE term_id IN (SELECT term_id FROM contract))")

MAXP = "mx AS (SELECT sc.entity_id, cl.ancestor AS term_id, max(sc.score) AS score FROM sc JOIN icl cl " \
       "ON sc.term_id = cl.term_id GROUP BY 1, 2)"
MINP = (
    "pairs AS (SELECT sc.entity_id, sc.term_id, cl.ancestor FROM sc JOIN icl cl ON sc.term_id = cl.term_id),\n"
    "jn AS (SELECT p.entity_id, p.term_id, a.score AS a_score FROM pairs p LEFT JOIN sc a "
    "ON a.entity_id = p.entity_id AND a.term_id = p.ancestor),\n"
    "g AS (SELECT entity_id, term_id, min(a_score) AS score, count(a_score) AS np FROM jn GROUP BY 1, 2),\n"
    "na AS (SELECT term_id, count(*) AS n_anc FROM icl GROUP BY 1),\n"
    "mn AS (SELECT g.entity_id, g.term_id, g.score FROM g JOIN na ON g.term_id = na.term_id "
    "WHERE np = n_anc AND score > 0)")


def _ens_contract_scores(spark, d):
    return ensemble.ensemble_mean(S.scores(spark, d), n_models=3)


@query("ancestor_closure", "G1", sql=_rec("edges", "terms", extra=FULL_CL) +
       "SELECT term_id, ancestor FROM cl UNION SELECT term_id, term_id FROM terms")
def q_closure(spark, d):
    return G.ancestor_closure(S.edges(spark, d), nodes=S.terms(spark, d))


@query("maintained_closure", "G1", sql=_rec("edges", extra=
       "e2 AS (SELECT * FROM edges WHERE CAST(substr(child, 4) AS BIGINT) % 40 <> 7 UNION SELECT " + S._term("p_partkey") +
       ", " + S._term("p_partkey // 5") + " FROM part WHERE p_partkey % 60 = 11 AND p_partkey > 20),\n"
       "anc(child, ancestor) AS (SELECT child, parent FROM e2 UNION SELECT a.child, e2.parent FROM anc a JOIN e2 ON a.ancestor = "
       "e2.child)") + "SELECT child AS term_id, ancestor FROM anc UNION SELECT child, child FROM edges UNION SELECT parent, parent "
       "FROM edges UNION SELECT child, child FROM e2 UNION SELECT parent, parent FROM e2")
def q_maintained(spark, d):
    """Edges of every 40th child go, every 60th term gets a further parent."""
    e = S.edges(spark, d)
    gone = e.filter(F.substring("child", 4, 7).cast("long") % 40 == 7)
    key = F.col("p_partkey")
    new = S.table(spark, d, "part").filter((key % 60 == 11) & (key > 20)).select(
        S.term_col(key).alias("child"), S.term_col(F.floor(key / 5)).alias("parent"))
    after = e.join(gone, ["child", "parent"], "left_anti").unionByName(new).distinct()
    return G.maintained_closure(G.ancestor_closure(e), after, new, gone)


@query("propagate_annotations", "G2 G1 P7 U2", sql=_rec("edges", "ext", "ann", "ck",
       extra=CONTRACT_SQL + ",\n" + FULL_CL) +
       "SELECT DISTINCT x.entity_id, cl.ancestor AS term_id, 1.0 AS score FROM ext x JOIN cl "
       "ON x.term_id = cl.term_id WHERE x.evidence = 'IEA' AND cl.ancestor IN (SELECT term_id FROM contract)")
def q_propagate(spark, d):
    ext = keys.evidence_filter(S.external(spark, d), only_iea=True)
    cl = G.ancestor_closure(S.edges(spark, d))
    return G.propagate_annotations(ext, cl, contract(spark, d))


@query("max_propagate", "G3 A19", sql=_rec("edges", "ann", "ck", "scores",
       extra=CONTRACT_SQL + ",\n" + INDUCED_CL + ",\n" + MAXP) +
       "SELECT entity_id, term_id, round(score, 6) AS score FROM mx")
def q_maxprop(spark, d):
    m = G.max_propagate(_ens_contract_scores(spark, d), G.contract_closure(S.edges(spark, d), contract(spark, d)))
    return m.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("min_propagate", "G4 A19", sql=_rec("edges", "ann", "ck", "scores",
       extra=CONTRACT_SQL + ",\n" + INDUCED_CL + ",\n" + MINP) +
       "SELECT entity_id, term_id, round(score, 6) AS score FROM mn")
def q_minprop(spark, d):
    m = G.min_propagate(_ens_contract_scores(spark, d), G.contract_closure(S.edges(spark, d), contract(spark, d)))
    return m.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("average_max_min", "G5 G3 G4", sql=_rec("edges", "ann", "ck", "scores",
       extra=CONTRACT_SQL + ",\n" + INDUCED_CL + ",\n" + MAXP + ",\n" + MINP) +
       "SELECT coalesce(mx.entity_id, mn.entity_id) AS entity_id, coalesce(mx.term_id, mn.term_id) AS term_id, "
       "round((coalesce(mx.score, 0.0) + coalesce(mn.score, 0.0)) / 2, 6) AS score FROM mx FULL OUTER JOIN mn "
       "ON mx.entity_id = mn.entity_id AND mx.term_id = mn.term_id")
def q_avgmaxmin(spark, d):
    m = G.average_max_min(_ens_contract_scores(spark, d), G.contract_closure(S.edges(spark, d), contract(spark, d)))
    return m.select("entity_id", "term_id", F.round("score", 6).alias("score"))


ADJ = (
    "ie2 AS (SELECT * FROM edges WHERE child IN (SELECT term_id FROM contract) AND parent IN "
    "(SELECT term_id FROM contract)),\n"
    "adj AS (SELECT child AS i, parent AS j FROM ie2 UNION SELECT parent, child FROM ie2 UNION "
    "SELECT term_id, term_id FROM contract),\n"
    "deg AS (SELECT i, count(*) AS deg FROM adj GROUP BY 1),\n"
    "nadj AS (SELECT a.i, a.j, 1.0 / sqrt(di.deg * dj.deg) AS w FROM adj a JOIN deg di ON a.i = di.i "
    "JOIN deg dj ON a.j = dj.i)")


@query("normalised_adjacency", "G6", sql=S.with_("edges", "ann", "ck", extra=CONTRACT_SQL + ",\n" + ADJ) +
       "SELECT i, j, round(w, 6) AS w FROM nadj")
def q_adj(spark, d):
    a = G.normalised_adjacency(S.edges(spark, d), contract(spark, d))
    return a.select("i", "j", F.round("w", 6).alias("w"))


@query("graph_smooth", "G7 G6 A19", sql=S.with_("edges", "ann", "ck", "scores", extra=CONTRACT_SQL + ",\n" +
       ADJ + ",\nsc AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score FROM scores WHERE term_id IN "
       "(SELECT term_id FROM contract) GROUP BY 1, 2)") +
       "SELECT sc.entity_id, a.i AS term_id, round(sum(a.w * sc.score), 6) AS score FROM sc JOIN nadj a "
       "ON sc.term_id = a.j GROUP BY 1, 2")
def q_smooth(spark, d):
    c = contract(spark, d)
    s = _ens_contract_scores(spark, d).join(c.select("term_id"), "term_id", "left_semi")
    h = G.graph_smooth(s, G.normalised_adjacency(S.edges(spark, d), c), hops=1)
    return h.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("edge_stats", "G8", sql=S.with_("edges", "terms", "ann", "ck", extra=CONTRACT_SQL) +
       "SELECT (SELECT count(*) FROM contract WHERE term_id IN (SELECT term_id FROM terms WHERE namespace <> "
       "'cellular_component')) AS terms_found, (SELECT count(*) FROM edges WHERE child IN (SELECT term_id FROM "
       "contract) AND parent IN (SELECT term_id FROM contract)) AS edges_inside")
def q_edge_stats(spark, d):
    obo = S.terms(spark, d).filter(F.col("namespace") != "cellular_component")
    return G.edge_stats(S.edges(spark, d), obo, contract(spark, d))


@query("hierarchy_violations", "G10 G3", sql=_rec("edges", "ann", "ck", "scores",
       extra=CONTRACT_SQL + ",\n" + INDUCED_CL + ",\n" + MAXP + ",\n"
       "vr AS (SELECT count(*) AS n FROM sc c JOIN ie ON c.term_id = ie.child LEFT JOIN sc p "
       "ON p.entity_id = c.entity_id AND p.term_id = ie.parent WHERE c.score > coalesce(p.score, 0.0)),\n"
       "vm AS (SELECT count(*) AS n FROM mx c JOIN ie ON c.term_id = ie.child LEFT JOIN mx p "
       "ON p.entity_id = c.entity_id AND p.term_id = ie.parent WHERE c.score > coalesce(p.score, 0.0))") +
       "SELECT 'raw' AS stage, n AS violations FROM vr UNION ALL SELECT 'max_propagated', n FROM vm")
def q_violations(spark, d):
    c = contract(spark, d)
    e = S.edges(spark, d)
    raw = _ens_contract_scores(spark, d).join(c.select("term_id"), "term_id", "left_semi")
    mx = G.max_propagate(raw, G.contract_closure(e, c))
    v1 = G.hierarchy_violations(raw, e, c).agg(F.count("*").alias("violations")) \
        .select(F.lit("raw").alias("stage"), "violations")
    v2 = G.hierarchy_violations(mx, e, c).agg(F.count("*").alias("violations")) \
        .select(F.lit("max_propagated").alias("stage"), "violations")
    return v1.unionByName(v2)


@query("fmax_by_knowledge", "E10 G1 G3", sql=_rec("edges", "scores", "truth", "terms", "ia", extra=FULL_CL + ",\n"
       "u AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score, 0 AS y "
       "FROM scores GROUP BY 1, 2 UNION ALL SELECT entity_id, term_id, 0.0, 1 FROM truth),\n"
       "c0 AS (SELECT u.entity_id, cl.ancestor AS term_id, max(score) AS score, max(y) AS y FROM u JOIN cl ON u.term_id = "
       "cl.term_id WHERE u.entity_id IN (SELECT entity_id FROM truth) GROUP BY 1, 2),\n"
       "c AS (SELECT t.aspect, c0.entity_id, score, sum(coalesce(ia.ia, 0.0)) AS w, sum(CASE WHEN y = 1 THEN "
       "coalesce(ia.ia, 0.0) ELSE 0.0 END) AS wy, max(y) AS y FROM c0 JOIN terms t ON c0.term_id = t.term_id "
       "LEFT JOIN ia ON c0.term_id = ia.term_id GROUP BY 1, 2, 3),\n"
       "kn AS (SELECT l_orderkey AS entity_id, max(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) AS bp, max(CASE WHEN "
       "l_partkey % 3 = 1 THEN 1 ELSE 0 END) AS mf, max(CASE WHEN l_partkey % 3 = 2 THEN 1 ELSE 0 END) AS cc "
       "FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),\n"
       "te AS (SELECT c.aspect, c.entity_id, CASE WHEN max(bp) IS NULL THEN 'no' WHEN max(CASE c.aspect WHEN 'BP' THEN bp "
       "WHEN 'MF' THEN mf ELSE cc END) = 0 THEN 'limited' WHEN max(bp + mf + cc) = 3 THEN 'partial' END AS knowledge "
       "FROM c LEFT JOIN kn ON c.entity_id = kn.entity_id GROUP BY 1, 2 HAVING max(c.y) = 1),\n"
       "e AS (SELECT te.knowledge, c.aspect, c.entity_id, thr, sum(CASE WHEN score >= thr THEN w ELSE 0.0 END) AS wp, "
       "sum(CASE WHEN score >= thr THEN wy ELSE 0.0 END) AS wtp, sum(wy) AS wt FROM c JOIN te ON c.aspect = te.aspect AND "
       f"c.entity_id = te.entity_id, (SELECT unnest({_grid_sql(FMAX_GRID)}) AS thr) WHERE te.knowledge IS NOT NULL "
       "GROUP BY 1, 2, 3, 4),\n"
       "cur AS (SELECT knowledge, aspect, thr, coalesce(avg(CASE WHEN wp > 0 THEN wtp / wp END), 0.0) AS p, "
       "avg(CASE WHEN wt > 0 THEN wtp / wt ELSE 0.0 END) AS r FROM e GROUP BY 1, 2, 3),\n"
       "ff AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM cur),\n"
       "b AS (SELECT *, row_number() OVER (PARTITION BY knowledge, aspect ORDER BY round(f, 12) DESC, thr) AS rn FROM ff),\n"
       "full_ AS (SELECT k.knowledge, a.aspect, CASE WHEN f > 0 THEN thr END AS thr, coalesce(f, 0.0) AS fmax FROM (VALUES "
       "('no'), ('limited'), ('partial')) k(knowledge) CROSS JOIN (VALUES ('BP'), ('MF'), ('CC')) a(aspect) LEFT JOIN b ON "
       "b.knowledge = k.knowledge AND b.aspect = a.aspect AND rn = 1) ") +
       "SELECT knowledge, aspect, thr, round(fmax, 6) AS fmax FROM full_ UNION ALL SELECT knowledge, 'ALL', NULL, "
       "round(avg(fmax), 6) FROM full_ GROUP BY 1 UNION ALL SELECT 'ALL', 'ALL', NULL, round(avg(fmax), 6) FROM full_")
def q_fmax_knowledge(spark, d):
    s = ensemble.ensemble_mean(S.scores(spark, d, by_entity=True), n_models=3)
    prior = S.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "A").select(
        F.col("l_orderkey").alias("entity_id"), S.aspect_col(F.col("l_partkey")).alias("aspect"))
    r = M.fmax_by_knowledge(s, S.truth(spark, d), S.terms(spark, d), S.ia(spark, d), G.ancestor_closure(S.edges(spark, d)),
                            M.prior_knowledge(prior), FMAX_GRID)
    return r.select("knowledge", "aspect", "thr", F.round("fmax", 6).alias("fmax"))


@query("inject_prior", "G9 G2 A19", sql=_rec("edges", "ext", "ann", "ck", "scores",
       extra=CONTRACT_SQL + ",\n" + FULL_CL + ",\n"
       "pr AS (SELECT DISTINCT x.entity_id, cl.ancestor AS term_id, 1.0 AS prior FROM ext x JOIN cl "
       "ON x.term_id = cl.term_id WHERE x.evidence = 'IEA' AND cl.ancestor IN (SELECT term_id FROM contract)),\n"
       "ens AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score FROM scores GROUP BY 1, 2)") +
       f"SELECT coalesce(e.entity_id, p.entity_id) AS entity_id, coalesce(e.term_id, p.term_id) AS term_id, "
       f"round(greatest(coalesce(e.score, 0.0), coalesce(p.prior * {PRIOR_WEIGHT}, 0.0)), 6) AS score "
       "FROM ens e FULL OUTER JOIN pr p ON e.entity_id = p.entity_id AND e.term_id = p.term_id")
def q_inject(spark, d):
    ext = keys.evidence_filter(S.external(spark, d), only_iea=True)
    pr = G.propagate_annotations(ext, G.ancestor_closure(S.edges(spark, d)), contract(spark, d))
    s = ensemble.inject_prior(_ens_contract_scores(spark, d), pr.withColumnRenamed("score", "prior"),
                              PRIOR_WEIGHT)
    return s.select("entity_id", "term_id", F.round("score", 6).alias("score"))


def _lenient(raw: str) -> str:
    p = f"string_split(trim({raw}), '|')"
    return f"(CASE WHEN (len({p}) >= 2 AND {p}[1] IN ('sp', 'tr')) OR len({p}) >= 3 THEN {p}[2] ELSE trim({raw}) END)"


@query("propagate_resolved", "G2 P1 P7 U2", sql=_rec("edges", "ext", "ann", "ck", "raw", extra=CONTRACT_SQL + ",\n" + FULL_CL + (
       ",\nuni AS (SELECT raw_id AS entity_id, 'train' AS split FROM raw WHERE entity_id % 3 <> 0 UNION ALL "
       "SELECT CAST(entity_id AS VARCHAR), 'test' FROM raw WHERE entity_id % 2 = 0), "
       f"known AS (SELECT {_lenient('entity_id')} AS k, entity_id, split, row_number() OVER (PARTITION BY {_lenient('entity_id')} "
       "ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END, entity_id) AS rn FROM uni), "
       f"x AS (SELECT DISTINCT {_lenient('raw_id')} AS k, term_id FROM ext JOIN raw ON ext.entity_id = raw.entity_id WHERE evidence = 'IEA')")) +
       "SELECT DISTINCT known.entity_id, split, cl.ancestor AS term_id, 1.0 AS score FROM x JOIN known ON x.k = known.k AND rn = 1 "
       "JOIN cl ON x.term_id = cl.term_id WHERE cl.ancestor IN (SELECT term_id FROM contract)")
def q_propagate_resolved(spark, d):
    """Evidence under raw ids; entities with two kinds of original ids, some in both splits."""
    raw = S.raw_ids(spark, d)
    rows = keys.evidence_filter(S.external(spark, d), only_iea=True).join(raw, "entity_id").select("raw_id", "term_id")
    universe = raw.where("entity_id % 3 <> 0").select(F.col("raw_id").alias("entity_id"), F.lit("train").alias("split")).unionByName(
        raw.where("entity_id % 2 = 0").select(F.col("entity_id").cast("string").alias("entity_id"), F.lit("test").alias("split")))
    return G.propagate_resolved(rows, universe, G.ancestor_closure(S.edges(spark, d)), contract(spark, d))
