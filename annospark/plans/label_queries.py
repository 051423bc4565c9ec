"""Label / key / contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import keys, stats
from annospark.operators import labels as L
from annospark.plans import standins as S
from annospark.plans.registry import query
from annospark.session import cut_lineage

CK = dict(S.CONTRACT_K)
ELITE_FLOOR = 40
TOP_N = 100

CONTRACT_SQL = (
    "cnt AS (SELECT term_id, aspect, count(*) AS n FROM ann GROUP BY 1, 2),\n"
    "rk AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term_id) AS rn FROM cnt),\n"
    "kept AS (SELECT rk.* FROM rk JOIN ck USING (aspect) WHERE rn <= k),\n"
    "contract AS (SELECT term_id, aspect, n, CAST(rn - 1 + CASE aspect WHEN 'BP' THEN 0 "
    "WHEN 'MF' THEN (SELECT count(*) FROM kept WHERE aspect = 'BP') "
    "ELSE (SELECT count(*) FROM kept WHERE aspect IN ('BP', 'MF')) END AS INTEGER) AS col_idx FROM kept)")


def contract(spark, d):
    """The label contract as a stored artefact (checkpointed once), the way a
    pipeline keeps it between stages; consumers join the stored table."""
    c = L.term_counts(S.annotations(spark, d), by=["term_id", "aspect"])
    return cut_lineage(L.top_k_per_aspect(c, CK))


@query("term_counts", "A1", sql=S.with_("ann") + "SELECT term_id, count(*) AS n FROM ann GROUP BY 1")
def q_term_counts(spark, d):
    return L.term_counts(S.annotations(spark, d))


@query("term_priors", "A2 J1", sql=S.with_("ann", "ia") +
       "SELECT c.term_id, round(c.n / (SELECT count(DISTINCT entity_id) FROM ann), 6) AS prior, "
       "round(coalesce(ia.ia, 0.0), 6) AS ia FROM (SELECT term_id, count(*) AS n FROM ann GROUP BY 1) c "
       "LEFT JOIN ia ON ia.term_id = c.term_id")
def q_term_priors(spark, d):
    p = L.term_priors(S.annotations(spark, d), S.ia(spark, d), ia_default=0.0)
    return p.select("term_id", F.round("prior", 6).alias("prior"), F.round("ia", 6).alias("ia"))


@query("term_probabilities", "A3", sql=S.with_("ann") +
       "SELECT term_id, round(count(*) / (SELECT count(*) FROM ann), 6) AS prob FROM ann GROUP BY 1")
def q_term_probs(spark, d):
    p = L.term_probabilities(S.annotations(spark, d))
    return p.select("term_id", F.round("prob", 6).alias("prob"))


@query("aspect_summary", "A4 W3", sql=S.with_("ann", extra=(
       "c AS (SELECT aspect, term_id, count(*) AS n FROM ann GROUP BY 1, 2), "
       "tot AS (SELECT term_id, sum(n) AS n FROM c GROUP BY 1), "
       f"top AS (SELECT term_id FROM tot ORDER BY n DESC, term_id LIMIT {TOP_N})")) +
       "SELECT aspect, count(*) AS unique_terms, CAST(sum(n) AS BIGINT) AS annotations, max(n) AS max_freq, "
       "min(n) AS min_freq, count(top.term_id) AS terms_in_top, "
       "list_sort(list(n))[count(*) // 2 + 1] AS median_freq FROM c LEFT JOIN top ON c.term_id = top.term_id "
       "GROUP BY aspect")
def q_aspect_summary(spark, d):
    return L.aspect_summary(S.annotations(spark, d), TOP_N)


LPE_SQL = (
       "SELECT e.entity_id, coalesce(n.n_labels, 0) AS n_labels, "
       "CAST(least(coalesce(n.n_labels, 0), 10) AS INTEGER) AS strat_bin FROM (SELECT DISTINCT entity_id "
       "FROM ents) e LEFT JOIN (SELECT entity_id, count(DISTINCT term_id) AS n_labels FROM ann GROUP BY 1) n "
       "ON e.entity_id = n.entity_id")


@query("labels_per_entity", "A5", sql=S.with_("ann", "ents") + LPE_SQL)
def q_labels_per_entity(spark, d):
    return L.labels_per_entity(S.annotations(spark, d), S.entities(spark, d))


@query("label_contract", "W2", sql=S.with_("ann", "ck", extra=CONTRACT_SQL) +
       "SELECT term_id, aspect, n, col_idx FROM contract")
def q_contract(spark, d):
    return contract(spark, d)


@query("label_matrix", "A6 J3", sql=S.with_("ann", "ck", extra=CONTRACT_SQL) +
       "SELECT DISTINCT a.entity_id, c.col_idx FROM ann a JOIN contract c ON a.term_id = c.term_id")
def q_label_matrix(spark, d):
    return L.label_matrix(S.annotations(spark, d), contract(spark, d))


@query("sparsity_profile", "A7", sql=S.with_("ann", extra=(
       "lab AS (SELECT DISTINCT entity_id, term_id FROM ann), "
       "v AS (SELECT 'row' AS axis, count(*) AS v FROM lab GROUP BY entity_id UNION ALL "
       "SELECT 'col', count(*) FROM lab GROUP BY term_id)")) +
       "SELECT axis, count(*) AS n_keys, CAST(sum(v) AS BIGINT) AS nnz, max(v) AS max, round(avg(v), 6) AS mean, "
       "round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, "
       "round(quantile_cont(v, 0.99), 6) AS p99 FROM v GROUP BY axis")
def q_sparsity(spark, d):
    p = L.sparsity_profile(S.annotations(spark, d))
    return p.select("axis", "n_keys", "nnz", "max", F.round("mean", 6).alias("mean"),
                    *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("global_top_k", "W3", sql=S.with_("ann") +
       "SELECT term_id, count(*) AS n FROM ann GROUP BY 1 ORDER BY n DESC, term_id LIMIT 50")
def q_global_top(spark, d):
    return L.global_top_k(L.term_counts(S.annotations(spark, d)), 50)


@query("elite_contract", "W4 W2", sql=S.with_("ann", "ck", extra=CONTRACT_SQL + ",\n"
       f"el AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term_id) AS r2 "
       f"FROM contract WHERE n >= {ELITE_FLOOR})") +
       "SELECT term_id, aspect, n, CAST(r2 - 1 + CASE aspect WHEN 'BP' THEN 0 WHEN 'MF' THEN "
       "(SELECT count(*) FROM el WHERE aspect = 'BP') ELSE (SELECT count(*) FROM el WHERE aspect IN "
       "('BP', 'MF')) END AS INTEGER) AS col_idx FROM el")
def q_elite(spark, d):
    c = L.term_counts(S.annotations(spark, d), by=["term_id", "aspect"])
    return L.elite_contract(c, contract(spark, d), ELITE_FLOOR, list(S.ASPECTS))


@query("annotation_coverage", "W8", sql=S.with_("ann", extra=(
       "c AS (SELECT aspect, term_id, count(*) AS n FROM ann GROUP BY 1, 2), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term_id) AS rank, "
       "sum(n) OVER (PARTITION BY aspect ORDER BY n DESC, term_id ROWS BETWEEN UNBOUNDED PRECEDING "
       "AND CURRENT ROW) / sum(n) OVER (PARTITION BY aspect) AS cum_share FROM c)")) +
       f"SELECT aspect, round(max(cum_share) FILTER (WHERE rank <= {TOP_N}), 6) AS share_at_k, "
       f"min(n) FILTER (WHERE rank <= {TOP_N}) AS min_count_at_k, "
       "min(rank) FILTER (WHERE cum_share >= 0.99 - 1e-12) AS k_for_target, count(*) AS n_terms "
       "FROM r GROUP BY aspect")
def q_coverage(spark, d):
    c = L.term_counts(S.annotations(spark, d), by=["aspect", "term_id"])
    r = L.annotation_coverage(c, TOP_N, 0.99)
    return r.select("aspect", F.round("share_at_k", 6).alias("share_at_k"), "min_count_at_k",
                    "k_for_target", "n_terms")


@query("coverage_ranks", "W7 J1", sql=S.with_("ann", "ia", extra=(
       "c AS (SELECT aspect, term_id, count(*) AS n FROM ann GROUP BY 1, 2), "
       "cj AS (SELECT c.*, coalesce(ia.ia, 0.0) AS ia FROM c LEFT JOIN ia ON c.term_id = ia.term_id), "
       f"el AS (SELECT * FROM cj WHERE n >= {ELITE_FLOOR}), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term_id) AS rank, "
       "sum(ia) OVER (PARTITION BY aspect ORDER BY n DESC, term_id ROWS BETWEEN UNBOUNDED PRECEDING "
       "AND CURRENT ROW) / nullif(sum(ia) OVER (PARTITION BY aspect), 0) AS cum_ia FROM el), "
       "k AS (SELECT aspect, min(rank) FILTER (WHERE cum_ia >= 0.95 - 1e-12) AS k_95, "
       "min(rank) FILTER (WHERE cum_ia >= 0.99 - 1e-12) AS k_99, min(n) AS at_k, sum(ia) AS el_ia FROM r GROUP BY 1), "
       f"a AS (SELECT aspect, count(*) AS n_terms, count(*) FILTER (WHERE n >= {ELITE_FLOOR}) AS k_noise, sum(ia) AS all_ia, "
       f"max(n) FILTER (WHERE n < {ELITE_FLOOR}) AS below FROM cj GROUP BY 1)")) +
       "SELECT a.aspect, n_terms, k_noise, coalesce(k_95, 0) AS k_95, coalesce(k_99, 0) AS k_99, "
       "coalesce(at_k, 0) AS count_at_k, coalesce(below, 0) AS count_at_k_plus_1, "
       "round(CASE WHEN all_ia > 0 THEN coalesce(el_ia, 0) / all_ia ELSE 'inf'::DOUBLE END, 6) AS ia_fraction_of_all, "
       "CASE WHEN el_ia > 0 THEN 1.0::DOUBLE ELSE 'inf'::DOUBLE END AS ia_fraction_of_eligible "
       "FROM a LEFT JOIN k ON a.aspect = k.aspect")
def q_coverage_ranks(spark, d):
    c = L.term_counts(S.annotations(spark, d), by=["aspect", "term_id"])
    r = L.coverage_ranks(c, S.ia(spark, d), ELITE_FLOOR)
    return r.withColumn("ia_fraction_of_all", F.round("ia_fraction_of_all", 6))


@query("stratified_kfold", "W11 A5", sql=S.with_("ann", "ents") +
       "SELECT entity_id, n_labels, strat_bin, CAST((row_number() OVER (PARTITION BY strat_bin ORDER BY "
       "md5(CAST(entity_id AS VARCHAR) || ':42'), entity_id) - 1) % 5 AS INTEGER) AS fold FROM (" + LPE_SQL + ")")
def q_kfold(spark, d):
    lpe = L.labels_per_entity(S.annotations(spark, d), S.entities(spark, d))
    return L.stratified_kfold(lpe, 5, seed=42)


@query("even_row_sample", "P10", sql=(
       "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), "
       "nn AS (SELECT count(*) AS n FROM orders), m AS (SELECT least(n, 1000) AS m, n FROM nn) "
       "SELECT o_orderkey AS row_idx FROM r WHERE pos IN (SELECT CAST(floor(i * (n - 1) / (m - 1)) AS BIGINT) "
       "FROM m, range(0, m) t(i))"))
def q_even_sample(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"))
    return L.even_row_sample(o, 1000, "row_idx")


@query("holdout_split", "P12", sql="SELECT DISTINCT o_orderkey AS entity_id, CAST('0x' || substr(md5(CAST(o_orderkey AS "
       "VARCHAR) || ':42'), 1, 8) AS BIGINT) / 4294967296 < 0.2 AS is_holdout FROM orders")
def q_holdout(spark, d):
    return L.holdout_split(S.entities(spark, d), 0.2, seed=42)


@query("join_ia_default_one", "J1", sql=S.with_("terms", "ia") +
       "SELECT t.term_id, t.aspect, round(coalesce(ia.ia, 1.0), 6) AS ia FROM terms t "
       "LEFT JOIN ia ON t.term_id = ia.term_id")
def q_join_ia(spark, d):
    t = S.terms(spark, d).select("term_id", "aspect")
    j = L.join_ia(t, S.ia(spark, d), default=1.0)
    return j.select("term_id", "aspect", F.round("ia", 6).alias("ia"))


@query("attach_aspect", "J2", sql=S.with_("ann", "terms") +
       "SELECT a.term_id, coalesce(t.aspect, 'UNK') AS aspect, count(*) AS n FROM ann a "
       "LEFT JOIN terms t ON a.term_id = t.term_id GROUP BY 1, 2")
def q_attach_aspect(spark, d):
    a = L.attach_aspect(S.annotations(spark, d), S.terms(spark, d))
    return a.groupBy("term_id", "aspect").agg(F.count("*").alias("n"))


@query("labels_in_scope", "J3", sql=S.with_("ann", "ck", extra=CONTRACT_SQL) +
       "SELECT DISTINCT a.entity_id, a.term_id FROM ann a WHERE a.entity_id IN "
       "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND a.term_id IN (SELECT term_id FROM contract)")
def q_in_scope(spark, d):
    ents = S.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("entity_id"))
    return L.labels_in_scope(S.annotations(spark, d), ents, contract(spark, d))


@query("scope_report", "J3", sql=S.with_("ann", "ck", extra=CONTRACT_SQL + ", "
       "e AS (SELECT DISTINCT o_orderkey AS entity_id FROM orders WHERE o_orderstatus = 'F')") +
       "SELECT count(*) FILTER (WHERE e.entity_id IS NOT NULL AND c.term_id IS NOT NULL) AS kept, "
       "count(*) FILTER (WHERE e.entity_id IS NULL) AS dropped_entity, "
       "count(*) FILTER (WHERE e.entity_id IS NOT NULL AND c.term_id IS NULL) AS dropped_term "
       "FROM ann a LEFT JOIN e ON a.entity_id = e.entity_id LEFT JOIN contract c ON a.term_id = c.term_id")
def q_scope_report(spark, d):
    ents = S.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("entity_id"))
    return L.scope_report(S.annotations(spark, d), ents, contract(spark, d))


@query("align_taxonomy", "J4", sql=S.with_("ents", "tax") +
       "SELECT e.entity_id, CAST(coalesce(t.taxon_id, 0) AS INTEGER) AS taxon_id FROM ents e "
       "LEFT JOIN (SELECT * FROM tax WHERE taxon_id <> 3) t ON e.entity_id = t.entity_id")
def q_align_tax(spark, d):
    # the taxonomy file lacks one nation to exercise the fill value
    t = S.taxonomy(spark, d).filter(F.col("taxon_id") != 3)
    return L.align_taxonomy(S.entities(spark, d), t, fill=0)


@query("filter_to_entities", "J6 P7", sql=S.with_("ext") +
       "SELECT entity_id, term_id, evidence FROM ext WHERE evidence = 'IEA' AND entity_id IN "
       "(SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def q_filter_entities(spark, d):
    from annospark.functions import keys
    ents = S.table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) \
        .select(F.col("o_orderkey").alias("entity_id"))
    ext = keys.evidence_filter(S.external(spark, d), only_iea=True)
    return L.filter_to_entities(ext, ents)


@query("key_overlap", "J7", sql=(
       "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k "
       "FROM orders WHERE o_orderstatus <> 'P') SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) "
       "AS matched, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) "
       "AS only_right FROM a FULL OUTER JOIN b ON a.k = b.k"))
def q_key_overlap(spark, d):
    a = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    b = S.table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("k"))
    return L.key_overlap(a, b, "k")


@query("truth_vs_prediction", "J14", sql=S.with_("truth", "scores") +
       "SELECT coalesce(t.entity_id, p.entity_id) AS entity_id, coalesce(t.term_id, p.term_id) AS term_id, "
       "CASE WHEN t.entity_id IS NOT NULL AND p.entity_id IS NOT NULL THEN 'tp' WHEN p.entity_id IS NOT NULL "
       "THEN 'fp' ELSE 'fn' END AS status FROM (SELECT DISTINCT entity_id, term_id FROM truth) t FULL OUTER JOIN "
       "(SELECT DISTINCT entity_id, term_id FROM scores WHERE model = 'm1' AND score >= 0.5) p "
       "ON t.entity_id = p.entity_id AND t.term_id = p.term_id")
def q_truth_vs_pred(spark, d):
    p = S.scores(spark, d).filter((F.col("model") == "m1") & (F.col("score") >= 0.5))
    return L.truth_vs_prediction(S.truth(spark, d), p)


@query("frequency_baseline", "J15 A3 W3", sql=S.with_("ann", "ents", extra=(
       "p AS (SELECT term_id, count(*) / (SELECT count(*) FROM ann) AS prob FROM ann GROUP BY 1), "
       "top AS (SELECT * FROM p ORDER BY prob DESC, term_id LIMIT 20)")) +
       "SELECT e.entity_id, top.term_id, round(top.prob, 6) AS prob FROM (SELECT DISTINCT entity_id FROM ents) e, top")
def q_freq_baseline(spark, d):
    fb = L.frequency_baseline(S.entities(spark, d), S.annotations(spark, d), 20)
    return fb.select("entity_id", "term_id", F.round("prob", 6).alias("prob"))


def _listing(spark, d, key_col, src, order_col):
    t = S.table(spark, d, src).select(F.col(key_col).alias("id")).distinct()
    return stats.group_positions(t.withColumn("_g", F.lit(0)), ["_g"], ["id"], out="row_idx").drop("_g")


@query("order_check", "J16", sql=(
       "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey AS id FROM orders), "
       "b AS (SELECT row_number() OVER (ORDER BY k) - 1 AS row_idx, k AS id FROM (SELECT DISTINCT l_orderkey AS k "
       "FROM lineitem)), j AS (SELECT coalesce(a.row_idx, b.row_idx) AS row_idx, a.id AS a, b.id AS b FROM a "
       "FULL OUTER JOIN b ON a.row_idx = b.row_idx), f AS (SELECT count(*) AS n, min(row_idx) FILTER (WHERE a IS "
       "DISTINCT FROM b) AS first_mismatch FROM j) SELECT CASE WHEN n = 0 THEN 'empty' WHEN first_mismatch IS NULL "
       "THEN 'exact_match' ELSE 'mismatch' END AS status, first_mismatch, j.a AS left_id, j.b AS right_id "
       "FROM f LEFT JOIN j ON j.row_idx = f.first_mismatch"))
def q_order_check(spark, d):
    a = _listing(spark, d, "o_orderkey", "orders", "id")
    b = _listing(spark, d, "l_orderkey", "lineitem", "id")
    return L.order_check(a, b, key="id")


@query("reconcile_listings", "J17", sql=(
       "WITH e AS (SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS want FROM "
       "documents WHERE NOT regexp_matches('docs/' || source || '/' || CAST(doc_id AS VARCHAR), '/src1/')), "
       "p AS (SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS have "
       "FROM documents WHERE lang <> 'de') SELECT e.path, e.want, p.have, CASE WHEN p.have IS NULL THEN 'missing' "
       "WHEN e.want IS NULL THEN 'unknown_size' WHEN e.want <> p.have THEN 'size_mismatch' ELSE 'ok' END AS status "
       "FROM e LEFT JOIN p ON e.path = p.path"))
def q_reconcile(spark, d):
    doc = S.table(spark, d, "documents")
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    exp = doc.select(path.alias("path"), F.col("n_chars").alias("bytes"))
    pres = doc.filter(F.col("lang") != "de").select(path.alias("path"),
                                                    F.octet_length("text").cast("long").alias("bytes"))
    return L.reconcile_listings(exp, pres, ignore_regex="/src1/")


@query("namespace_agreement", "J18", sql=S.with_("ann", "terms") +
       "SELECT count(*) AS pairs, count(t.aspect) AS known, count(*) FILTER (WHERE t.aspect IS NOT NULL AND "
       "t.aspect <> p.aspect) AS disagree FROM (SELECT DISTINCT aspect, term_id FROM ann) p LEFT JOIN terms t "
       "ON p.term_id = t.term_id")
def q_namespace(spark, d):
    return L.namespace_agreement(S.annotations(spark, d), S.terms(spark, d))


@query("universe_check", "J19 U3", sql=S.with_("ann", "ia", "terms", extra=(
       "t AS (SELECT DISTINCT term_id FROM ann)")) +
       "SELECT (SELECT count(*) FROM t WHERE term_id NOT IN (SELECT term_id FROM ia)) AS missing_ia, "
       "(SELECT count(*) FROM t WHERE term_id NOT IN (SELECT term_id FROM terms WHERE namespace <> "
       "'cellular_component')) AS missing_obo, CAST(0 AS BIGINT) AS alt_resolvable")
def q_universe(spark, d):
    obo = S.terms(spark, d).filter(F.col("namespace") != "cellular_component")
    return L.universe_check(S.annotations(spark, d), S.ia(spark, d), obo)


@query("union_ids", "U1", sql="SELECT DISTINCT k FROM (SELECT o_orderkey AS k FROM orders UNION ALL "
       "SELECT l_orderkey FROM lineitem)")
def q_union(spark, d):
    a = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return L.union_ids(a, b, "k")


@query("missing_entities", "U3", sql="SELECT o_orderkey AS entity_id FROM orders WHERE o_orderkey NOT IN "
       "(SELECT l_orderkey FROM lineitem)")
def q_missing(spark, d):
    e = S.entities(spark, d)
    a = S.annotations(spark, d)
    return e.join(a.select("entity_id"), "entity_id", "left_anti")


@query("aspect_pair_overlap", "U4", sql=S.with_("ann") +
       "SELECT x.aspect AS a, y.aspect AS b, count(*) AS overlap FROM (SELECT DISTINCT aspect, entity_id FROM ann) x "
       "JOIN (SELECT DISTINCT aspect, entity_id FROM ann) y ON x.entity_id = y.entity_id AND x.aspect < y.aspect "
       "GROUP BY 1, 2")
def q_pair_overlap(spark, d):
    return L.pairwise_overlap(S.annotations(spark, d), "aspect", "entity_id")


@query("ordered_dedup", "U5", sql=S.with_("ann") +
       "SELECT term_id, min(l_orderkey * 100 + l_linenumber) AS pos FROM (SELECT l_orderkey, l_linenumber, "
       "('GO:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0')) AS term_id FROM lineitem) GROUP BY 1")
def q_ordered_dedup(spark, d):
    li = S.table(spark, d, "lineitem")
    rows = li.select(S.term_col(F.col("l_partkey")).alias("term_id"),
                     (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return L.ordered_dedup(rows, "term_id", "pos")


@query("dedup_pairs", "U6", sql=S.with_("ann") + "SELECT DISTINCT entity_id, term_id FROM ann")
def q_dedup(spark, d):
    return S.annotations(spark, d).select("entity_id", "term_id").dropDuplicates()


_CLEAN = "CASE WHEN contains({k}, '|') THEN string_split({k}, '|')[2] ELSE {k} END"


@query("key_overlap_report", "J7 P1", sql=S.with_("raw", extra=(
       "a AS (SELECT raw_id AS k FROM raw), b AS (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE l_returnflag = 'R'), "
       f"f AS (SELECT 'raw' AS form, k, true AS l FROM a UNION ALL SELECT 'clean', {_CLEAN.format(k='k')}, true FROM a "
       f"UNION ALL SELECT 'raw', k, false FROM b UNION ALL SELECT 'clean', {_CLEAN.format(k='k')}, false FROM b), "
       "g AS (SELECT form, k, bool_or(l) AS l, bool_or(NOT l) AS r FROM f WHERE k IS NOT NULL GROUP BY 1, 2), "
       "s AS (SELECT *, row_number() OVER (PARTITION BY form, l, r ORDER BY k) AS rank FROM g)")) +
       "SELECT form, count(*) FILTER (WHERE l) AS n_left, count(*) FILTER (WHERE r) AS n_right, count(*) FILTER (WHERE l AND r) "
       "AS matched, round(count(*) FILTER (WHERE l AND r) / count(*) FILTER (WHERE l), 6) AS matched_share, "
       "coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE l AND NOT r AND rank <= 5), '') AS sample_only_left, "
       "coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE r AND NOT l AND rank <= 5), '') AS sample_only_right FROM s GROUP BY form")
def q_key_report(spark, d):
    a = S.raw_ids(spark, d).select(F.col("raw_id").alias("k"))
    b = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("k"))
    r = L.key_overlap_report(a, b, "k", lambda k: keys.accession(k, "split"))
    return r.withColumn("matched_share", F.round("matched_share", 6))


@query("universe_check_alt", "J19 P18", sql=S.with_("ann", "ia", "terms", extra=(
       "t AS (SELECT DISTINCT term_id FROM ann), obo AS (SELECT term_id FROM terms WHERE namespace <> 'cellular_component'), "
       "alt AS (SELECT term_id AS alt_id FROM terms WHERE namespace = 'cellular_component' AND CAST(substr(term_id, 4) AS BIGINT) % 2 = 0)")) +
       "SELECT (SELECT count(*) FROM t WHERE term_id NOT IN (SELECT term_id FROM ia)) AS missing_ia, "
       "(SELECT count(*) FROM t WHERE term_id NOT IN (SELECT term_id FROM obo)) AS missing_obo, "
       "(SELECT count(*) FROM t WHERE term_id NOT IN (SELECT term_id FROM obo) AND term_id IN (SELECT alt_id FROM alt)) AS alt_resolvable")
def q_universe_alt(spark, d):
    """Half of the terms of one namespace are alternative ids here."""
    obo, alt = _obo_and_alt(spark, d)
    return L.universe_check(S.annotations(spark, d), S.ia(spark, d), obo, alt)


def _obo_and_alt(spark, d):
    t = S.terms(spark, d)
    number = F.substring("term_id", 4, 7).cast("long")
    cc = F.col("namespace") == "cellular_component"
    return t.where(~cc), t.where(cc & (number % 2 == 0)).select(F.col("term_id").alias("alt_id"), S.term_col(F.floor(number / 2)).alias("term_id"))


@query("resolve_alt_ids", "P18", sql=S.with_("ann", "terms", extra=(
       "obo AS (SELECT term_id FROM terms WHERE namespace <> 'cellular_component'), "
       "alt AS (SELECT term_id AS alt_id, 'GO:' || lpad(CAST(CAST(substr(term_id, 4) AS BIGINT) // 2 AS VARCHAR), 7, '0') AS main "
       "FROM terms WHERE namespace = 'cellular_component' AND CAST(substr(term_id, 4) AS BIGINT) % 2 = 0)")) +
       "SELECT entity_id, a.term_id, coalesce(main, a.term_id) AS resolved, main IS NOT NULL AS was_alt FROM ann a "
       "LEFT JOIN alt ON a.term_id = alt_id AND a.term_id NOT IN (SELECT term_id FROM obo)")
def q_resolve_alt(spark, d):
    obo, alt = _obo_and_alt(spark, d)
    return keys.resolve_alt_ids(S.annotations(spark, d).select("entity_id", "term_id"), alt, obo)


@query("density_by_aspect", "A7", sql=S.with_("ann", "ents", extra="l AS (SELECT DISTINCT aspect, term_id, entity_id FROM ann)") +
       "SELECT aspect, count(DISTINCT term_id) AS n_terms, count(*) AS nnz, round(count(*) / (count(DISTINCT term_id) * "
       "(SELECT count(DISTINCT entity_id) FROM ents)), 6) AS density FROM l GROUP BY 1")
def q_density(spark, d):
    r = L.density_by_aspect(S.annotations(spark, d), S.entities(spark, d))
    return r.withColumn("density", F.round("density", 6))
