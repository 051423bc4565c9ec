"""KNN label-transfer queries over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import ensemble, knn
from annospark.plans import standins as S
from annospark.plans.registry import query

K = 10
# Per-aspect neighbour counts of the reference's mixed-K vote.
K_BY_ASPECT = {"BP": 5, "MF": 10, "CC": 15}


def knn_sql(k: int) -> str:
    """CTEs ``vec``, ``veclab``, ``u`` (unit vectors), ``knn`` (brute force top-k)."""
    return S.with_("vec", "veclab", extra=(
        "u AS (SELECT vec_id, fold, list_transform(v, lambda x: x / greatest(sqrt(list_sum("
        "list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM vec),\n"
        "pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.u, b.u) AS sim "
        "FROM u q JOIN u b ON q.fold <> b.fold AND q.vec_id <> b.vec_id),\n"
        "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY sim DESC, base_id) AS rank FROM pairs) WHERE rank <= {k}),\n"
        "den AS (SELECT query_id, sum(sim) AS denom FROM knn GROUP BY 1)"))


def _neighbours(spark, d, k=K):
    v = S.vectors(spark, d)
    return knn.knn_join(v, v, k, id_col="vec_id", vec_col="embedding", fold_col="fold")


@query("knn_topk", "J8 F1 W11(input folds)", sql=knn_sql(K) +
       "SELECT query_id, base_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM knn")
def q_knn_topk(spark, d):
    n = _neighbours(spark, d)
    return n.select("query_id", "base_id", F.round("sim", 6).alias("sim"), "rank")


@query("knn_topk_pruned", "J8 F1", sql=knn_sql(K) +
       "SELECT query_id, base_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM knn")
def q_knn_pruned(spark, d):
    v = S.vectors(spark, d)
    n, _ = knn.pruned_knn_join(v, v, K, id_col="vec_id", vec_col="embedding", fold_col="fold", block_rows=512)
    return n.select("query_id", "base_id", F.round("sim", 6).alias("sim"), "rank")


@query("knn_label_transfer", "J8 J9", sql=knn_sql(K) +
       "SELECT k.query_id, l.term_id, round(sum(k.sim) / max(den.denom), 6) AS score "
       "FROM knn k JOIN (SELECT DISTINCT entity_id, term_id FROM veclab) l ON k.base_id = l.entity_id "
       "JOIN den USING (query_id) GROUP BY 1, 2")
def q_knn_transfer(spark, d):
    s = knn.neighbour_label_transfer(_neighbours(spark, d), S.vector_labels(spark, d))
    return s.select("query_id", "term_id", F.round("score", 6).alias("score"))


@query("knn_rowmax_scores", "J8 J9 W1", sql=knn_sql(K) + ", sc AS ("
       "SELECT k.query_id, l.term_id, sum(k.sim) / max(den.denom) AS score "
       "FROM knn k JOIN (SELECT DISTINCT entity_id, term_id FROM veclab) l ON k.base_id = l.entity_id "
       "JOIN den USING (query_id) GROUP BY 1, 2) "
       "SELECT query_id AS entity_id, term_id, round(score / (CASE WHEN max(score) OVER (PARTITION BY "
       "query_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY query_id) END), 6) AS score FROM sc")
def q_knn_rowmax(spark, d):
    s = knn.neighbour_label_transfer(_neighbours(spark, d), S.vector_labels(spark, d))
    s = ensemble.row_max_normalise(s.withColumnRenamed("query_id", "entity_id"))
    return s.select("entity_id", "term_id", F.round("score", 6).alias("score"))


def _aspect_labels(spark, d):
    lab = S.vector_labels(spark, d)
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"),
                                               S.aspect_col(F.col("label")).alias("aspect"))
    return lab.join(e, "entity_id")


@query("knn_mixed_k", "J8 J10", sql=knn_sql(15).replace(
       "den AS (SELECT query_id, sum(sim) AS denom FROM knn GROUP BY 1)",
       "ks AS (SELECT * FROM (VALUES ('BP', 5), ('MF', 10), ('CC', 15)) t(aspect, k)), "
       "den AS (SELECT query_id, aspect, sum(sim) + 1e-9 AS denom FROM knn JOIN ks ON rank <= k "
       "GROUP BY 1, 2), lab AS (SELECT DISTINCT vec_id AS entity_id, " + S._term("label") +
       " AS term_id, " + S._aspect("label") + " AS aspect FROM embeddings)") +
       "SELECT k.query_id, l.term_id, l.aspect, round(sum(k.sim) / max(den.denom), 6) AS score "
       "FROM knn k JOIN lab l ON k.base_id = l.entity_id JOIN ks ON l.aspect = ks.aspect AND k.rank <= ks.k "
       "JOIN den ON den.query_id = k.query_id AND den.aspect = l.aspect GROUP BY 1, 2, 3")
def q_knn_mixed(spark, d):
    n = _neighbours(spark, d, k=max(K_BY_ASPECT.values()))
    s = knn.mixed_k_transfer(n, _aspect_labels(spark, d), K_BY_ASPECT)
    return s.select("query_id", "term_id", "aspect", F.round("score", 6).alias("score"))


@query("knn_baseline_vote", "J8 J11", sql=knn_sql(K) + ", v AS ("
       "SELECT k.query_id, l.term_id, sum(k.sim) AS votes FROM knn k JOIN (SELECT DISTINCT entity_id, "
       "term_id FROM veclab) l ON k.base_id = l.entity_id GROUP BY 1, 2) "
       "SELECT query_id, term_id, round(votes / max(votes) OVER (PARTITION BY query_id), 6) AS score FROM v")
def q_knn_vote(spark, d):
    s = knn.baseline_vote(_neighbours(spark, d), S.vector_labels(spark, d))
    return s.select("query_id", "term_id", F.round("score", 6).alias("score"))


@query("knn_ia_weighted", "J8 J12 J1", sql=knn_sql(K).replace(
       "den AS (SELECT query_id, sum(sim) AS denom FROM knn GROUP BY 1)",
       "den AS (SELECT query_id, greatest(sum(least(greatest(sim, 0.0), 1.0)), 1e-8) AS denom "
       "FROM knn GROUP BY 1), ia AS (" + S.SQL["ia"] + ")") +
       "SELECT k.query_id, l.term_id, round(sum(least(greatest(k.sim, 0.0), 1.0) * "
       "coalesce(ia.ia, 0.0)) / max(den.denom), 6) AS score "
       "FROM knn k JOIN (SELECT DISTINCT entity_id, term_id FROM veclab) l ON k.base_id = l.entity_id "
       "LEFT JOIN ia ON ia.term_id = l.term_id JOIN den USING (query_id) GROUP BY 1, 2")
def q_knn_ia(spark, d):
    s = knn.neighbour_label_transfer(_neighbours(spark, d), S.vector_labels(spark, d),
                                     ia=S.ia(spark, d), clip_sims=True, denom_floor=1e-8)
    return s.select("query_id", "term_id", F.round("score", 6).alias("score"))


@query("knn_max_similarity", "J8 J13", sql=knn_sql(K) +
       "SELECT query_id, round(max(sim), 6) AS max_sim FROM knn GROUP BY 1")
def q_knn_maxsim(spark, d):
    m = knn.max_neighbour_similarity(_neighbours(spark, d))
    return m.select("query_id", F.round("max_sim", 6).alias("max_sim"))
