"""Contract audits, sampling, corpus records and fold averaging
(P11, P16, A9, A21, A22, A23, A26, W9, W10, W14, W15, X2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import ensemble, features as FE, knn, labels as L, text as X
from annospark.plans import standins as S
from annospark.plans.knn_queries import knn_sql
from annospark.plans.label_queries import CK, CONTRACT_SQL, contract
from annospark.plans.registry import query
from annospark.plans.source_queries import scratch
from annospark.sources import tables

BASE_K, EXPANDED_K, NOISE = 100, 400, 30
ENS = ("ens AS (SELECT entity_id, term_id, list_reduce(list_sort(list(score)), lambda a, b: a + b) / 3.0 AS score "
       "FROM scores GROUP BY 1, 2)")
WS = "[ \\t\\n\\x0B\\f\\r]"


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("head_tail_audit", "W9 J1", sql=S.with_("ann", "ia", extra=(
       "c AS (SELECT term_id, count(*) AS n FROM ann GROUP BY 1), "
       "r AS (SELECT c.term_id, c.n, ia.ia IS NULL AS missing, coalesce(ia.ia, 0.0) AS ia, row_number() OVER (ORDER BY "
       "c.n DESC, c.term_id) - 1 AS rank0 FROM c LEFT JOIN ia ON c.term_id = ia.term_id), "
       f"b AS (SELECT min(n) AS base_min_count, CAST(sum(n) AS DOUBLE) AS sum_counts_base, sum(ia) AS ia_sum_base FROM r "
       f"WHERE rank0 < {BASE_K}), "
       "t AS (SELECT count(*) AS tail_k, max(n) AS tail_max_count, min(n) AS tail_min_count, avg(n) AS tail_mean_count, "
       f"CAST(sum(n) AS DOUBLE) AS sum_counts_tail, sum(ia) AS ia_sum_tail, count(*) FILTER (WHERE n < {NOISE}) AS "
       "tail_below_noise_n, quantile_cont(n, 0.5) AS tail_median_count, quantile_cont(n, 0.1) AS tail_p10_count, "
       f"quantile_cont(n, 0.25) AS tail_p25_count FROM r WHERE rank0 >= {BASE_K} AND rank0 < {EXPANDED_K})")) +
       "SELECT (SELECT count(*) FROM r) AS total_terms_available, b.base_min_count, round(b.sum_counts_base, 6) AS "
       "sum_counts_base, round(b.ia_sum_base, 6) AS ia_sum_base, t.tail_k, t.tail_max_count, t.tail_min_count, "
       "round(t.tail_mean_count, 6) AS tail_mean_count, round(t.sum_counts_tail, 6) AS sum_counts_tail, "
       "round(t.ia_sum_tail, 6) AS ia_sum_tail, t.tail_below_noise_n, round(t.tail_median_count, 6) AS "
       "tail_median_count, round(t.tail_p10_count, 6) AS tail_p10_count, round(t.tail_p25_count, 6) AS tail_p25_count, "
       "(SELECT count(*) FILTER (WHERE missing) FROM r) AS missing_ia_terms_n, round(t.sum_counts_tail / "
       "b.sum_counts_base, 6) AS sum_counts_tail_over_base, round(t.ia_sum_tail / b.ia_sum_base, 6) AS "
       "ia_tail_over_base, round(t.tail_below_noise_n / greatest(t.tail_k, 1), 6) AS tail_below_noise_frac, "
       "CASE WHEN t.tail_below_noise_n > t.tail_k / 2 THEN 'CRITICAL AUDIT VERDICT: REJECT EXPANSION.' ELSE "
       "'AUDIT VERDICT: STABLE FOR EXPERIMENTATION.' END AS verdict FROM b, t")
def q_head_tail(spark, d):
    r = L.head_tail_audit(L.term_counts(S.annotations(spark, d)), S.ia(spark, d), BASE_K, EXPANDED_K, NOISE)
    dbl = ["sum_counts_base", "ia_sum_base", "tail_mean_count", "sum_counts_tail", "ia_sum_tail",
           "tail_median_count", "tail_p10_count", "tail_p25_count", "sum_counts_tail_over_base",
           "ia_tail_over_base", "tail_below_noise_frac"]
    return r.select(*[F.round(c, 6).alias(c) if c in dbl else F.col(c) for c in r.columns])


@query("elite_breakdown", "W10", sql=S.with_("ann", extra=(
       "c AS (SELECT term_id, aspect, count(*) AS n FROM ann GROUP BY 1, 2), "
       "r AS (SELECT *, row_number() OVER (ORDER BY n DESC, term_id) - 1 AS rank0 FROM c), "
       "cov AS (SELECT sum(n) FILTER (WHERE rank0 < 500) / sum(n) AS coverage_at_rank FROM r), "
       f"g AS (SELECT aspect, CASE WHEN n >= {NOISE} THEN 'elite' ELSE 'rare' END AS grp, n FROM r), "
       "a AS (SELECT aspect, grp, count(*) AS terms, CAST(sum(n) AS BIGINT) AS annotations, quantile_cont(n, 0.5) AS "
       "p50, quantile_cont(n, 0.9) AS p90 FROM g GROUP BY 1, 2)")) +
       "SELECT aspect, grp AS \"group\", terms, annotations, round(annotations / sum(annotations) OVER (PARTITION BY "
       "aspect), 6) AS share, round(p50, 6) AS p50, round(p90, 6) AS p90, round((SELECT coverage_at_rank FROM cov), 6) "
       "AS coverage_at_rank FROM a")
def q_elite_breakdown(spark, d):
    r = L.elite_breakdown(L.term_counts(S.annotations(spark, d), by=["term_id", "aspect"]), NOISE, 500)
    return r.select("aspect", "group", "terms", "annotations", *_r6("share", "p50", "p90", "coverage_at_rank"))


@query("contract_guards", "P16 W2", sql=S.with_("ann", "ck", "ents", extra=CONTRACT_SQL + ", "
       "per AS (SELECT aspect, count(*) AS n, min(col_idx) AS lo, max(col_idx) AS hi FROM contract GROUP BY 1), "
       "ins AS (SELECT a.entity_id, c.aspect FROM ann a JOIN contract c ON a.term_id = c.term_id), "
       "g AS (SELECT (SELECT count(*) FROM contract) AS terms, (SELECT bool_and(coalesce(per.n = ck.k, false)) FROM "
       "per LEFT JOIN ck ON per.aspect = ck.aspect) AS sizes_ok, (SELECT bool_and(hi - lo + 1 = n) FROM per) AS "
       "blocks_ok, (SELECT count(*) FROM (SELECT term_id FROM contract GROUP BY 1 HAVING count(*) > 1)) AS "
       "duplicate_ids, (SELECT count(*) FROM per WHERE aspect NOT IN (SELECT aspect FROM ins)) AS zero_label_aspects, "
       "(SELECT count(*) FROM (SELECT DISTINCT entity_id FROM ents) WHERE entity_id NOT IN (SELECT entity_id FROM "
       "ins)) AS zero_label_entities)") +
       "SELECT *, terms > 0 AND sizes_ok AND blocks_ok AND duplicate_ids = 0 AND zero_label_aspects = 0 AS ok, "
       "zero_label_entities > 1000 AS warn_zero_label_entities FROM g")
def q_guards(spark, d):
    # the report itself; pipelines wrap it in labels.raise_if_bad to stop on a bad contract
    return L.contract_guards(contract(spark, d), S.annotations(spark, d), S.entities(spark, d), CK)


@query("aspect_assemble", "A23 A19", sql=S.with_("scores", "terms", "ann", "ck", extra=CONTRACT_SQL + ", " + ENS) +
       "SELECT e.entity_id, e.term_id, t.aspect, round(e.score, 6) AS score FROM ens e JOIN terms t ON e.term_id = "
       "t.term_id WHERE (e.term_id, t.aspect) IN (SELECT term_id, aspect FROM contract)")
def q_aspect_assemble(spark, d):
    blocks = ensemble.ensemble_mean(S.scores(spark, d), n_models=3) \
        .join(S.terms(spark, d).select("term_id", "aspect"), "term_id")
    a = ensemble.aspect_assemble(blocks, contract(spark, d))
    return a.select("entity_id", "term_id", "aspect", F.round("score", 6).alias("score"))


@query("random_row_sample", "P11", sql="SELECT o_orderkey AS entity_id FROM orders ORDER BY "
       "md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 100")
def q_random_sample(spark, d):
    return L.random_row_sample(S.entities(spark, d), 100, seed=42, id_col="entity_id")


@query("modality_importance", "A26 F2 F5", sql=S.with_("vec", extra=(
       "labs AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS col_idx FROM (SELECT DISTINCT "
       "label FROM embeddings)), "
       "f AS (SELECT v.vec_id, v.label, list_concat(v.v, list_transform(range((SELECT count(*) FROM labs)), lambda i: "
       "CASE WHEN i = l.col_idx THEN 1.0 ELSE 0.0 END)) AS f FROM vec v JOIN labs l ON v.label = l.label), "
       "e AS (SELECT label, unnest(range(len(f))) AS pos, unnest(f) AS value FROM f), "
       "w AS (SELECT label, pos, avg(value) AS w FROM e GROUP BY 1, 2), "
       "col AS (SELECT pos, avg(abs(w)) AS mean_abs FROM w GROUP BY 1), "
       "per AS (SELECT CASE WHEN pos < 64 THEN 'emb' ELSE 'label' END AS modality, avg(mean_abs) AS importance "
       "FROM col GROUP BY 1)")) +
       "SELECT modality, round(importance, 6) AS importance, round(importance / (SELECT sum(importance) FROM per) * "
       "100.0, 6) AS percent FROM per")
def q_modality(spark, d):
    v = S.table(spark, d, "embeddings")
    idx = FE.one_hot_index(v, col="label")
    oh = FE.one_hot(v.select("vec_id", "label"), idx, col="label")
    feats, layout = FE.concat_modalities({"emb": v.select("vec_id", F.col("embedding").alias("vec")),
                                          "label": oh.select("vec_id", F.col("onehot").alias("vec"))},
                                         "vec_id", "vec", {"emb": 64, "label": idx.count()})
    e = FE.exploded(feats, "vec_id", "features").join(v.select("vec_id", "label"), "vec_id")
    w = e.groupBy(F.col("label").alias("term_id"), "pos").agg(F.avg(F.col("value").cast("double")).alias("w"))
    m = FE.modality_importance(w, layout)
    return m.select("modality", *_r6("importance", "percent"))


@query("length_bucket_order", "W14", sql="SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents")
def q_length_order(spark, d):
    doc = S.table(spark, d, "documents")
    return FE.length_bucket_order(doc.select("doc_id", "text"), F.length("text")).select("doc_id", "length")


@query("largest_n", "W15", sql=(
       "SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS bytes FROM documents "
       "ORDER BY bytes DESC, path LIMIT 25"))
def q_largest(spark, d):
    doc = S.table(spark, d, "documents")
    listing = doc.select(F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
                         .alias("path"), F.col("n_chars").alias("bytes"))
    return FE.largest_n(listing, 25)


_FUNC_SQL = f"trim((regexp_replace(coalesce(text, ''), '[\\t\\r\\n\"]', ' ', 'g')))"
_IDS_SQL = ("list_filter(regexp_split_to_array(coalesce(text, ''), '[;" + WS[1:-1] + "]+'), lambda x: "
            "regexp_full_match(x, '[0-9]+'))")


@query("uniprot_roundtrip", "X2 P5 S11", sql=(
       f"WITH d AS (SELECT doc_id, source, lang, {_FUNC_SQL} AS fn, {_IDS_SQL} AS ids FROM documents), "
       "x AS (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM d), "
       "f AS (SELECT doc_id, id, min(pos) AS p FROM x GROUP BY 1, 2), "
       "g AS (SELECT doc_id, string_agg(id, ',' ORDER BY p) AS ids FROM f GROUP BY 1) "
       "SELECT 'D' || CAST(d.doc_id AS VARCHAR) AS accession, d.source AS protein_name, d.lang AS organism_name, "
       "d.fn AS cc_function, coalesce(g.ids, '') AS pubmed FROM d LEFT JOIN g ON d.doc_id = g.doc_id"))
def q_uniprot(spark, d):
    doc = S.table(spark, d, "documents")
    fn = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\r\n\"]", " "))
    ids = F.array_join(keys.parse_id_list(F.col("text")), "; ")
    rec = doc.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("Entry"),
                     F.col("source").alias("Protein names"), F.col("lang").alias("Organism"),
                     F.lit("").alias("Keywords"), F.lit("").alias("Protein families"), fn.alias("Function [CC]"),
                     F.lit("").alias("Subcellular location [CC]"), ids.alias("PubMed ID"))
    path = scratch(spark, "records")
    rec.write.mode("overwrite").csv(path, sep="\t", header=True, quote="\u0000")
    u = tables.read_uniprot_tsv(spark, path)
    return u.select("accession", "protein_name", "organism_name", "cc_function",
                    F.array_join("pubmed_ids", ",").alias("pubmed"))


_STRIP = ("trim(regexp_replace(replace(regexp_replace({t}, '\\bGO:[0-9]{{7}}\\b', ' ', 'g'), 'GO:', ' '), '" + WS +
          "+', ' ', 'g'))")


@query("assemble_corpus", "A9 P3 P5", sql=(
       "WITH r AS (SELECT doc_id AS key, concat_ws(' ', nullif(trim(source), ''), nullif(trim(lang), '')) AS curated, "
       f"{_IDS_SQL}[1:3] AS pm FROM documents), "
       "ex AS (SELECT key, unnest(range(len(pm))) AS pos, unnest(pm) AS pmid FROM r), "
       "a AS (SELECT CAST(item_id AS VARCHAR) AS pmid, 'Item ' || CAST(item_id AS VARCHAR) AS title, "
       "substr(coalesce(text, ''), 1, 2000) AS abstract FROM benchmark), "
       "j AS (SELECT ex.key, ex.pos, regexp_replace(a.title || '. ' || a.abstract, '^[ .]+|[ .]+$', '', 'g') AS p "
       "FROM ex JOIN a ON ex.pmid = a.pmid WHERE a.title <> '' OR a.abstract <> ''), "
       "pm AS (SELECT key, string_agg(p, ' ' ORDER BY pos) AS pubmed FROM j GROUP BY 1), "
       "o AS (SELECT r.key, trim(concat_ws(' ', CASE WHEN r.curated <> '' THEN r.curated END, pm.pubmed)) AS t, "
       "r.curated <> '' AS has_curated, pm.pubmed IS NOT NULL AS has_pubmed FROM r LEFT JOIN pm ON r.key = pm.key) "
       f"SELECT key, md5(CASE WHEN t <> '' THEN {_STRIP.format(t='t')} ELSE t END) AS text_md5, has_curated, "
       "has_pubmed FROM o"))
def q_corpus(spark, d):
    doc = S.table(spark, d, "documents")
    rec = doc.select(F.col("doc_id").alias("key"), "source", "lang", keys.parse_id_list(F.col("text")).alias("pmids"))
    b = S.table(spark, d, "benchmark")
    ab = b.select(F.col("item_id").cast("string").alias("pmid"),
                  F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"),
                  F.col("text").alias("abstract"))
    c = X.assemble_corpus(rec, ["source", "lang"], ab, max_pmids=3, max_abstract_chars=2000)
    return c.select("key", F.md5("text").alias("text_md5"), "has_curated", "has_pubmed")


def _fold_sql() -> str:
    base = knn_sql(10).split("pairs AS")[0]
    blocks = " UNION ALL ".join(
        f"SELECT {f} AS f, q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.u, b.u) AS sim FROM u q "
        f"JOIN u b ON b.fold <> {f} AND q.vec_id <> b.vec_id" for f in range(5))
    return base + (
        f"pairs AS ({blocks}), "
        "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, query_id ORDER BY sim DESC, base_id) AS "
        "rank FROM pairs) WHERE rank <= 10), den AS (SELECT f, query_id, sum(sim) AS denom FROM knn GROUP BY 1, 2), "
        "per AS (SELECT k.f, k.query_id, l.term_id, sum(k.sim) / max(den.denom) AS score FROM knn k JOIN (SELECT "
        "DISTINCT entity_id, term_id FROM veclab) l ON k.base_id = l.entity_id JOIN den ON den.f = k.f AND "
        "den.query_id = k.query_id GROUP BY 1, 2, 3) "
        "SELECT query_id AS entity_id, term_id, round(list_reduce(list_sort(list(score)), lambda a, b: a + b) / 5.0, 6) "
        "AS score FROM per GROUP BY 1, 2")


@query("test_fold_average", "A21 A22 J8 J9", sql=_fold_sql())
def q_fold_average(spark, d):
    v = S.vectors(spark, d)
    lab = S.vector_labels(spark, d)
    n = knn.knn_join_without_folds(v, v, 10, list(range(5)))
    s = knn.neighbour_label_transfer(n, lab, by=["without"])
    avg = ensemble.fold_average(s.withColumnRenamed("query_id", "entity_id"), n_folds=5)
    return avg.select("entity_id", "term_id", F.round("score", 6).alias("score"))
