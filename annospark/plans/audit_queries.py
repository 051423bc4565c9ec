"""Key-cleaning, feature and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import audit as A, ensemble, features as FE, metrics as M
from annospark.plans import standins as S
from annospark.plans.label_queries import CONTRACT_SQL, contract
from annospark.plans.registry import query

ENS = ("ens AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score "
       "FROM scores GROUP BY 1, 2)")
ENS_C = ENS + ", ensc AS (SELECT * FROM ens WHERE term_id IN (SELECT term_id FROM contract))"


def _ens(spark, d):
    return ensemble.ensemble_mean(S.scores(spark, d), n_models=3)


def _ens_contract(spark, d):
    return _ens(spark, d).join(contract(spark, d).select("term_id"), "term_id", "left_semi")


_P = "string_split(trim(raw_id), '|')"


@query("normalise_accession", "P1", sql=S.with_("raw") + (
       f"SELECT entity_id, raw_id, CASE WHEN len({_P}) >= 3 AND {_P}[1] IN ('sp', 'tr') AND {_P}[2] <> '' THEN "
       f"{_P}[2] ELSE trim(raw_id) END AS strict, CASE WHEN (len({_P}) >= 2 AND {_P}[1] IN ('sp', 'tr')) OR "
       f"len({_P}) >= 3 THEN {_P}[2] ELSE trim(raw_id) END AS lenient, CASE WHEN regexp_matches(raw_id, "
       "'\\|(.+?)\\|') THEN regexp_extract(raw_id, '\\|(.+?)\\|', 1) ELSE raw_id END AS regex, CASE WHEN "
       "contains(raw_id, '|') THEN string_split(raw_id, '|')[2] ELSE raw_id END AS split FROM raw"))
def q_accession(spark, d):
    r = S.raw_ids(spark, d)
    return r.select("entity_id", "raw_id", *[keys.accession(F.col("raw_id"), p).alias(p)
                                             for p in ("strict", "lenient", "regex", "split")])


NS_SQL = ("SELECT CASE p_partkey % 7 WHEN 0 THEN 'biological_process' WHEN 1 THEN 'molecular_function' WHEN 2 THEN "
          "'cellular_component' WHEN 3 THEN 'P' WHEN 4 THEN 'F' WHEN 5 THEN 'C' ELSE p_type END AS namespace FROM part")


@query("aspect_from_namespace", "P6 A28", sql=(
       f"WITH ns AS ({NS_SQL}) SELECT CASE namespace WHEN 'biological_process' THEN 'BP' WHEN 'molecular_function' "
       "THEN 'MF' WHEN 'cellular_component' THEN 'CC' WHEN 'BP' THEN 'BP' WHEN 'MF' THEN 'MF' WHEN 'CC' THEN 'CC' "
       "WHEN 'P' THEN 'BP' WHEN 'F' THEN 'MF' WHEN 'C' THEN 'CC' ELSE 'UNK' END AS aspect, count(*) AS n FROM ns "
       "GROUP BY 1"))
def q_aspect_ns(spark, d):
    p = S.table(spark, d, "part")
    k = F.col("p_partkey") % 7
    ns = (F.when(k == 0, "biological_process").when(k == 1, "molecular_function").when(k == 2, "cellular_component")
          .when(k == 3, "P").when(k == 4, "F").when(k == 5, "C").otherwise(F.col("p_type")))
    x = p.select(keys.aspect_from_namespace(ns).alias("aspect"))
    return A.value_counts(x, "aspect")


@query("evidence_filter", "P7", sql=S.with_("ext") +
       "SELECT entity_id, term_id, evidence FROM ext WHERE evidence NOT IN ('EXP', 'IDA', 'IPI', 'IMP', 'IGI', 'IEP')")
def q_evidence_filter(spark, d):
    return keys.evidence_filter(S.external(spark, d), exclude_experimental=True)


@query("evidence_histogram", "A10", sql=S.with_("ext") +
       "SELECT evidence, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM ext GROUP BY 1")
def q_evidence_hist(spark, d):
    return A.evidence_histogram(S.external(spark, d))


@query("validate_annotations", "P13", sql=(
       "WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, 'GO:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') "
       "AS term_id, l_linestatus AS aspect FROM lineitem) SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coalesce("
       "regexp_full_match(term_id, 'GO:[0-9]{7}'), false)) AS bad_term, count(*) FILTER (WHERE NOT coalesce(aspect IN "
       "('P', 'F', 'C'), false)) AS bad_aspect, count(*) FILTER (WHERE entity_id IS NULL OR trim(entity_id) = '') "
       "AS bad_entry FROM a"))
def q_validate_ann(spark, d):
    li = S.table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").cast("string").alias("entity_id"),
                  S.term_col(F.col("l_partkey")).alias("term_id"), F.col("l_linestatus").alias("aspect"))
    return keys.annotation_problems(a)


@query("validate_taxonomy", "P14", sql=S.with_("tax") +
       "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(regexp_full_match(CAST(taxon_id AS VARCHAR), "
       "'[0-9]+'), false)) AS bad_taxon FROM tax")
def q_validate_tax(spark, d):
    return keys.taxonomy_problems(S.taxonomy(spark, d))


UNIT = ("u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, "
        "lambda y: y * y))), 1e-12)) AS u FROM vec)")


@query("l2_normalise", "F1", sql=S.with_("vec", extra=UNIT) +
       "SELECT vec_id, CAST(unnest(range(len(u))) AS INTEGER) AS pos, round(unnest(u), 6) AS value FROM u")
def q_l2(spark, d):
    v = FE.l2_normalise(S.vectors(spark, d), "embedding")
    e = FE.exploded(v, "vec_id", "embedding")
    return e.select("vec_id", "pos", F.round("value", 6).alias("value"))


@query("concat_modalities", "F2 F5", sql=S.with_("vec", extra=(
       "labs AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS col_idx FROM (SELECT DISTINCT "
       "label FROM embeddings)), nl AS (SELECT count(*) AS n FROM labs), "
       "f AS (SELECT v.vec_id, list_concat(v.v, list_transform(range((SELECT n FROM nl)), lambda i: CASE WHEN i = "
       "l.col_idx THEN 1.0 ELSE 0.0 END)) AS f FROM vec v JOIN labs l ON v.label = l.label)")) +
       "SELECT vec_id, CAST(unnest(range(len(f))) AS INTEGER) AS pos, round(unnest(f), 6) AS value FROM f")
def q_concat_mod(spark, d):
    v = S.table(spark, d, "embeddings")
    idx = FE.one_hot_index(v, col="label")
    oh = FE.one_hot(v.select("vec_id", "label"), idx, col="label")
    dims = {"emb": 64, "label": idx.count()}
    feats, _ = FE.concat_modalities({"emb": v.select("vec_id", F.col("embedding").alias("vec")),
                                     "label": oh.select("vec_id", F.col("onehot").alias("vec"))},
                                    "vec_id", "vec", dims)
    e = FE.exploded(feats, "vec_id", "features")
    return e.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("standard_scaler", "F3", sql=S.with_("vec", extra=(
       "e AS (SELECT CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM vec)")) +
       "SELECT pos, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(CASE WHEN stddev_pop(value)"
       " = 0 THEN 1.0 ELSE stddev_pop(value) END, 6) AS scale FROM e GROUP BY 1")
def q_scaler(spark, d):
    s = FE.standard_scaler_fit(S.table(spark, d, "embeddings"), "embedding")
    return s.select("pos", *[F.round(c, 6).alias(c) for c in ("mean", "std", "scale")])


@query("masked_mean_pool", "F6", sql=S.with_("vec", extra=(
       "e AS (SELECT label, CASE WHEN vec_id % 4 <> 0 THEN 1.0 ELSE 0.0 END AS m, CAST(unnest(range(len(v))) AS "
       "INTEGER) AS pos, unnest(v) AS value FROM vec)")) +
       "SELECT label, pos, round(sum(m * value) / greatest(sum(m), 1.0), 6) AS value FROM e GROUP BY 1, 2")
def q_pool(spark, d):
    v = S.table(spark, d, "embeddings").withColumn("mask", F.col("vec_id") % 4 != 0)
    p = FE.masked_mean_pool(v, "label", "embedding", "mask")
    return p.select("label", "pos", F.round("value", 6).alias("value"))


@query("length_histogram", "A16", sql=(
       "SELECT lang, CAST(CASE WHEN n_chars = 3000 THEN 58 ELSE floor((n_chars - 0.0) / (3000.0 / 59)) END AS INTEGER) "
       "AS bin, count(*) AS n FROM documents WHERE n_chars >= 0 AND n_chars <= 3000 GROUP BY 1, 2"))
def q_len_hist(spark, d):
    return FE.length_histogram(S.table(spark, d, "documents"), "n_chars", 0.0, 3000.0, 60, by=["lang"])


@query("norm_distribution", "A17", sql=S.with_("vec", extra=(
       "r AS (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, len(list_filter(v, lambda x: x <> 0)) "
       "AS nnz FROM vec)")) +
       "SELECT round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max, min(nnz) AS nnz_min, max(nnz) AS "
       "nnz_max, round(quantile_cont(norm, 0.5), 6) AS norm_p50, round(quantile_cont(norm, 0.95), 6) AS norm_p95, "
       "round(quantile_cont(nnz, 0.5), 6) AS nnz_p50, round(quantile_cont(nnz, 0.95), 6) AS nnz_p95 FROM r")
def q_norms(spark, d):
    r = FE.norm_distribution(S.table(spark, d, "embeddings"), "embedding")
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("norm") or c.endswith(("p50", "p95")) else c
                      for c in ("norm_min", "norm_max", "nnz_min", "nnz_max", "norm_p50", "norm_p95", "nnz_p50",
                                "nnz_p95")])


@query("finite_report", "A18", sql=S.with_("vec") +
       "SELECT count(*) AS rows, count(*) FILTER (WHERE list_bool_or(list_transform(v, lambda x: isnan(x) OR "
       "isinf(x)))) AS non_finite_rows, round(max(list_max(list_transform(v, lambda x: abs(x)))), 6) AS max_abs FROM vec")
def q_finite(spark, d):
    v = FE.finite_gate(S.table(spark, d, "embeddings"), "embedding")
    r = FE.finite_report(v, "embedding")
    return r.select("rows", "non_finite_rows", F.round("max_abs", 6).alias("max_abs"))


DENSE = ("n_cells AS (SELECT (SELECT count(*) FROM orders) * (SELECT count(*) FROM contract) AS n), "
         "grid AS (SELECT coalesce(s.score, 0.0) AS score FROM (SELECT o_orderkey AS entity_id FROM orders) e CROSS "
         "JOIN (SELECT term_id FROM contract) t LEFT JOIN ensc s ON s.entity_id = e.entity_id AND s.term_id = t.term_id)")


def _n_cells(spark, d):
    return S.entities(spark, d).count() * contract(spark, d).count()


@query("dense_score_distribution", "A11 A19", sql=S.with_("scores", "ann", "ck", extra=CONTRACT_SQL + ", " + ENS_C +
       ", " + DENSE) +
       "SELECT round(min(score), 6) AS min, round(quantile_cont(score, 0.01), 6) AS p01, round(quantile_cont(score, "
       "0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, "
       "round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS max, round(avg(score), 6) AS mean "
       "FROM grid")
def q_dense_dist(spark, d):
    r = A.dense_score_distribution(_ens_contract(spark, d), _n_cells(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in ("min", "p01", "p05", "p50", "p95", "p99", "max", "mean")])


@query("spike_audit", "A12", sql=S.with_("scores", "ann", "ck", extra=CONTRACT_SQL + ", " + ENS_C + ", " + DENSE) +
       "SELECT round(avg(CASE WHEN abs(score) <= 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS near_0, round(avg(CASE WHEN "
       "abs(score - 0.5) <= 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS near_half, round(avg(CASE WHEN abs(score - 1.0) <= "
       "1e-6 THEN 1.0 ELSE 0.0 END), 6) AS near_1, round(avg(CASE WHEN score >= 0.49 AND score <= 0.51 THEN 1.0 ELSE "
       "0.0 END), 6) AS band_half, round(avg(CASE WHEN score >= 0.99 AND score <= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS "
       "band_top FROM grid")
def q_spikes(spark, d):
    r = A.spike_audit(_ens_contract(spark, d), _n_cells(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in ("near_0", "near_half", "near_1", "band_half", "band_top")])


@query("count_above_threshold", "A13", sql=S.with_("scores", extra=ENS) +
       "SELECT count(*) AS positives, count(DISTINCT term_id) AS terms, count(DISTINCT entity_id) AS entities "
       "FROM ens WHERE score >= 0.5")
def q_count_above(spark, d):
    return A.count_above_threshold(_ens(spark, d), 0.5)


@query("prediction_diversity", "A14", sql=S.with_("scores", "terms", extra=ENS + (
       ", p AS (SELECT e.entity_id, e.term_id, t.aspect FROM ens e JOIN terms t ON e.term_id = t.term_id WHERE "
       "e.score >= 0.5), sets AS (SELECT entity_id, list_sort(list(DISTINCT term_id)) AS ts FROM p GROUP BY 1)")) +
       "SELECT aspect, count(DISTINCT term_id) AS terms, round((SELECT count(DISTINCT ts) FROM sets) / (SELECT "
       "count(*) FROM orders), 6) AS set_diversity FROM p GROUP BY 1")
def q_diversity(spark, d):
    p = _ens(spark, d).filter(F.col("score") >= 0.5).join(S.terms(spark, d).select("term_id", "aspect"), "term_id")
    r = A.prediction_diversity(p, S.entities(spark, d).count())
    return r.select("aspect", "terms", F.round("set_diversity", 6).alias("set_diversity"))


@query("row_stats", "A24", sql=S.with_("scores", "ann", "ck", extra=CONTRACT_SQL + ", " + ENS_C +
       ", rs AS (SELECT entity_id, max(score) AS row_max FROM ensc GROUP BY 1)") +
       "SELECT CAST(least(floor(row_max * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM rs GROUP BY 1")
def q_row_stats(spark, d):
    rs = ensemble.row_stats(_ens_contract(spark, d), contract(spark, d).count())
    return A.row_stats_histogram(rs, "row_max", 10)


@query("rank_correlation", "A25", sql=(
       "WITH " + S.with_("scores", "truth", extra=ENS)[len("WITH "):] + (
           ", tr AS (SELECT DISTINCT entity_id, term_id FROM truth), c AS (SELECT CAST(CASE WHEN t.entity_id IS NULL "
           "THEN 0 ELSE 1 END AS DOUBLE) AS y, coalesce(e.score, 0.0) AS score FROM ens e FULL OUTER JOIN tr t ON "
           "e.entity_id = t.entity_id AND e.term_id = t.term_id), r AS (SELECT rank() OVER (ORDER BY y) + (count(*) "
           "OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) "
           "- 1) / 2.0 AS rs FROM c) SELECT round(corr(ry, rs), 6) AS spearman FROM r")))
def q_rank_corr(spark, d):
    c = M.cells(_ens(spark, d), S.truth(spark, d))
    return A.rank_correlation(c, "y", "score").select(F.round("spearman", 6).alias("spearman"))


@query("stack_features", "F10", sql=S.with_("scores") +
       "SELECT entity_id, term_id, round(coalesce(max(score) FILTER (WHERE model = 'm1'), 0.0), 6) AS m1, "
       "round(coalesce(max(score) FILTER (WHERE model = 'm2'), 0.0), 6) AS m2, round(coalesce(max(score) FILTER "
       "(WHERE model = 'm3'), 0.0), 6) AS m3 FROM scores GROUP BY 1, 2")
def q_stack(spark, d):
    w = ensemble.stack_features(S.scores(spark, d), ["m1", "m2", "m3"])
    return w.select("entity_id", "term_id", *[F.round(c, 6).alias(c) for c in ("m1", "m2", "m3")])


@query("null_rate", "A29", sql=S.with_("scores") +
       "SELECT term_id, round(avg(m2), 6) AS mean, round(avg(CASE WHEN m2 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS "
       "null_rate FROM (SELECT entity_id, term_id, max(score) FILTER (WHERE model = 'm2') AS m2 FROM scores GROUP BY "
       "1, 2) GROUP BY 1")
def q_null_rate(spark, d):
    wide = ensemble.model_columns(S.scores(spark, d), ["m1", "m2", "m3"])
    r = A.null_aware_term_stats(wide, "m2")
    return r.select("term_id", F.round("mean", 6).alias("mean"), F.round("null_rate", 6).alias("null_rate"))


@query("seed_average", "A22", sql=S.with_("scores") +
       "SELECT entity_id, term_id, round(list_reduce(list_sort(list(score)), lambda a, b: a + b) / count(DISTINCT model), 6) AS score "
       "FROM scores GROUP BY 1, 2")
def q_seed_average(spark, d):
    """The models stand for seeds; a seed without a value for a pair does not count."""
    r = ensemble.seed_average_oof(S.scores(spark, d).withColumnRenamed("model", "seed"))
    return r.select("entity_id", "term_id", F.round("score", 6).alias("score"))


@query("standardised_features", "F3", sql=S.with_("vec", extra=(
       "e AS (SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM vec), "
       "f AS (SELECT pos, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM e GROUP BY 1)")) +
       "SELECT vec_id, e.pos, round((value - mean) / scale, 5) AS value FROM e JOIN f ON e.pos = f.pos")
def q_standardised(spark, d):
    v = S.table(spark, d, "embeddings")
    r = FE.standard_scaler_transform(v, "vec_id", "embedding", FE.standard_scaler_fit(v, "embedding"))
    return r.select("vec_id", "pos", F.round("value", 5).alias("value"))
