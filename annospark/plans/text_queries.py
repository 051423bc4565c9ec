"""Text queries over documents / conversations / pages / benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import labels as L, text as X
from annospark.plans import standins as S
from annospark.plans.registry import query
from annospark.plans.source_queries import scratch
from annospark.sources import articles

MAX_FEATURES = 1000
WS_SQL = "[ \\t\\n\\x0B\\f\\r]"


@query("tfidf", "F4", sql=(
       "WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), "
       "'[\\p{L}\\p{N}_]{2,}') AS t FROM documents), "
       "g AS (SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(list_zip("
       "t[1:len(t) - 1], t[2:len(t)]), lambda x: x[1] || ' ' || x[2]) ELSE [] END)) AS term FROM d), "
       "tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), "
       "st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), "
       f"voc AS (SELECT term, df FROM st WHERE df >= 2 ORDER BY total DESC, term LIMIT {MAX_FEATURES}), "
       "vi AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS col_idx, "
       "ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM voc), "
       "x AS (SELECT tf.doc_id, tf.term, vi.col_idx, tf.tf * vi.idf AS w FROM tf JOIN vi ON tf.term = vi.term) "
       "SELECT doc_id, term, col_idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM x"))
def q_tfidf(spark, d):
    t = X.tfidf(S.table(spark, d, "documents"), "doc_id", "text", MAX_FEATURES, 2, 2)
    return t.select("doc_id", "term", "col_idx", F.round("value", 6).alias("value"))


@query("concat_text_by_key", "A8", sql=(
       "SELECT conv_id, string_agg(text, ' \n ' ORDER BY turn, text) AS text FROM conversations "
       "WHERE text IS NOT NULL GROUP BY 1"))
def q_concat(spark, d):
    return X.concat_text_by_key(S.table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("strip_label_leakage", "P3", sql=(
       "SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_len FROM (SELECT doc_id, trim(regexp_replace("
       "replace(regexp_replace(text, '\\bGO:[0-9]{7}\\b', ' ', 'g'), 'GO:', ' '), '" + WS_SQL + "+', ' ', 'g')) "
       "AS c FROM documents)"))
def q_strip(spark, d):
    c = keys.strip_label_leakage(F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", F.md5(c).alias("clean_md5"),
                                                 F.length(c).cast("long").alias("clean_len"))


@query("html_sniff", "P4", sql=(
       "SELECT page_id, (starts_with(t, '<!doctype html') OR starts_with(t, '<html') OR contains(substr(t, 1, 2000), "
       "'<html')) AS is_html, length(c) AS clean_len, length(html) - length(regexp_replace(html, "
       "'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS n_ctrl FROM (SELECT page_id, html, lower(regexp_replace("
       "coalesce(html, ''), '^" + WS_SQL + "+', '')) AS t, regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', "
       "' ', 'g') AS c FROM pages)"))
def q_html(spark, d):
    p = S.table(spark, d, "pages")
    ctrl = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
    return p.select("page_id", keys.looks_like_html(F.col("html")).alias("is_html"),
                    F.length(keys.sanitise_control_chars(F.col("html"))).cast("long").alias("clean_len"),
                    (F.length("html") - F.length(F.regexp_replace("html", ctrl, ""))).cast("long").alias("n_ctrl"))


@query("parse_id_list", "P5", sql=(
       "WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[;" + WS_SQL[1:-1] +
       "]+'), lambda x: regexp_full_match(x, '[0-9]+')) AS ids FROM documents) "
       "SELECT doc_id, CAST(unnest(range(len(ids))) AS INTEGER) AS pos, unnest(ids) AS id FROM l"))
def q_ids(spark, d):
    doc = S.table(spark, d, "documents")
    return doc.select("doc_id", F.posexplode(keys.parse_id_list(F.col("text"))).alias("pos", "id"))


@query("sanitise_residues", "P2", sql=(
       "SELECT doc_id, md5(s) AS seq_md5, md5(array_to_string(string_split(s, ''), ' ')) AS spaced_md5, "
       "length(s) AS seq_len FROM (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), "
       "'UZOB', 'XXXX') AS s FROM documents)"))
def q_residues(spark, d):
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    doc = S.table(spark, d, "documents").select("doc_id", seq.alias("seq"))
    return doc.select("doc_id", F.md5(keys.sanitise_residues(F.col("seq"))).alias("seq_md5"),
                      F.md5(F.regexp_replace(keys.sanitise_residues(F.col("seq")), "(?s)(.)(?=.)", "$1 "))
                      .alias("spaced_md5"),
                      F.length(keys.sanitise_residues(F.col("seq"))).cast("long").alias("seq_len"))


@query("text_coverage", "A27", sql=(
       "WITH c AS (SELECT doc_id, bool_or(length(trim(text)) > 0) AS ne FROM documents GROUP BY 1) "
       "SELECT round(avg(CASE WHEN c.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_text, "
       "round(avg(CASE WHEN coalesce(c.ne, false) THEN 1.0 ELSE 0.0 END), 6) AS non_empty FROM (SELECT DISTINCT "
       "o_orderkey FROM orders) e LEFT JOIN c ON e.o_orderkey = c.doc_id"))
def q_text_cov(spark, d):
    ents = S.entities(spark, d).select(F.col("entity_id").alias("doc_id"))
    r = X.text_coverage(ents, S.table(spark, d, "documents"), "doc_id")
    return r.select(F.round("with_text", 6).alias("with_text"), F.round("non_empty", 6).alias("non_empty"))


@query("missing_keys", "X3 U3", sql=(
       "SELECT k, CAST(floor((row_number() OVER (ORDER BY k) - 1) / 80) AS BIGINT) AS batch FROM (SELECT DISTINCT "
       "l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 <> 0))"))
def q_missing_keys(spark, d):
    wanted = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    cache = S.table(spark, d, "part").filter(F.col("p_size") % 4 != 0).select(F.col("p_partkey").alias("k"))
    return X.missing_keys(wanted, cache, "k", 80)


def _xml_escape(c):
    c = F.regexp_replace(c, "&", "&amp;")
    c = F.regexp_replace(c, "<", "&lt;")
    return F.regexp_replace(c, ">", "&gt;")


@query("parse_pubmed_xml", "X1 P4", sql=(
       "WITH t AS (SELECT item_id, replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), "
       "chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM benchmark) "
       "SELECT CAST(item_id AS VARCHAR) AS pmid, 'Item ' || CAST(item_id AS VARCHAR) AS title, "
       "array_to_string(list_transform(range(1, 24), lambda i: regexp_replace(CAST(i AS VARCHAR) || ' ' || body, '^" + WS_SQL +
       "+|" + WS_SQL + "+$', '', 'g')), ' ') AS abstract FROM t"))
def q_pubmed(spark, d):
    """Each item as an article of 23 abstract pieces, with an abstract and ids of other kinds beside it."""
    b = S.table(spark, d, "benchmark")
    body = _xml_escape(keys.sanitise_control_chars(F.col("text")))
    pieces = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(23)), lambda i: F.concat(
        F.lit("<AbstractText Label=\"part\"> <b>"), i.cast("string"), F.lit("</b> "), body, F.lit(" </AbstractText>\n"))), "")
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID> "), F.col("item_id").cast("string"),
                   F.lit("\n</PMID><Article><ArticleTitle> Item "), F.col("item_id").cast("string"),
                   F.lit(" </ArticleTitle><Abstract>"), pieces, F.lit("<AbstractText/><CopyrightInformation>c"
                   "</CopyrightInformation></Abstract></Article><OtherAbstract><AbstractText>other</AbstractText>"
                   "</OtherAbstract><CommentsCorrections><PMID>1</PMID></CommentsCorrections></MedlineCitation>"
                   "</PubmedArticle>"))
    return X.parse_pubmed_xml(b.select(xml.alias("xml")))


def _article_files(spark, d) -> str:
    """Files of many articles made from ``benchmark``; every fifth has an element that is not closed."""
    b = S.table(spark, d, "benchmark")
    body = _xml_escape(keys.sanitise_control_chars(F.col("text")))
    xml = F.concat(F.lit("<PubmedArticle Status=\"x\">\n<MedlineCitation><PMID>"), F.col("item_id").cast("string"),
                   F.lit("</PMID><Article><ArticleTitle>Item "), F.col("item_id").cast("string"),
                   F.lit("</ArticleTitle><Abstract><AbstractText>"), body, F.lit(" </AbstractText>"),
                   F.when(F.col("item_id") % 5 == 3, "").otherwise("</Abstract>"),
                   F.lit("</Article></MedlineCitation></PubmedArticle>"))
    path = scratch(spark, "articles")
    b.select(xml.alias("value")).repartition(3, "value").write.text(path)
    return path


_ARTICLE_SQL = (
    "WITH t AS (SELECT item_id, replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), "
    "chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM benchmark) ")


@query("article_files", "X1 P4", sql=_ARTICLE_SQL +
       "SELECT CAST(item_id AS VARCHAR) AS pmid, 'Item ' || CAST(item_id AS VARCHAR) AS title, regexp_replace(body, '^" +
       WS_SQL + "+|" + WS_SQL + "+$', '', 'g') AS abstract FROM t WHERE item_id % 5 <> 3")
def q_article_files(spark, d):
    return articles.read_article_files(spark, _article_files(spark, d))[0]


@query("article_files_malformed", "X1", sql=
       "SELECT count(*) AS records, count(*) FILTER (WHERE item_id % 5 = 3) AS malformed FROM benchmark")
def q_article_files_malformed(spark, d):
    return articles.read_xml_records(spark, _article_files(spark, d), "PubmedArticle").agg(
        F.count("*").alias("records"), F.count_if("malformed").alias("malformed"))


@query("align_text", "J5 P1", sql=(
       "WITH r AS (" + S.SQL["raw"] + "), c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE "
       "'sp|' || CAST(doc_id AS VARCHAR) || '|NAME' END AS key, text FROM documents), "
       "n AS (SELECT entity_id, raw_id, CASE WHEN (len(string_split(trim(raw_id), '|')) >= 2 AND "
       "string_split(trim(raw_id), '|')[1] IN ('sp', 'tr')) OR len(string_split(trim(raw_id), '|')) >= 3 THEN "
       "string_split(trim(raw_id), '|')[2] ELSE trim(raw_id) END AS acc FROM r) "
       "SELECT n.entity_id, md5(coalesce(c1.text, c2.text, '')) AS text_md5 FROM n LEFT JOIN c c1 ON n.raw_id = "
       "c1.key LEFT JOIN c c2 ON n.acc = c2.key"))
def q_align_text(spark, d):
    r = S.raw_ids(spark, d).withColumn("acc", keys.accession(F.col("raw_id"), "lenient"))
    doc = S.table(spark, d, "documents")
    key = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")) \
        .otherwise(F.concat(F.lit("sp|"), F.col("doc_id").cast("string"), F.lit("|NAME")))
    corpus = doc.select(key.alias("key"), "text")
    a = L.align_text(r, corpus, "raw_id", "acc")
    return a.select("entity_id", F.md5("text").alias("text_md5"))


@query("text_coverage_by_source", "A27", sql=(
       "WITH a AS (SELECT doc_id AS k, bool_or(length(trim(coalesce(text, ''))) > 0) AS f FROM documents GROUP BY 1), "
       "b AS (SELECT conv_id AS k, bool_or(length(trim(coalesce(text, ''))) > 0) AS f FROM conversations GROUP BY 1), "
       "j AS (SELECT e.k, a.f AS fa, b.f AS fb FROM (SELECT DISTINCT o_orderkey AS k FROM orders) e LEFT JOIN a ON e.k = a.k "
       "LEFT JOIN b ON e.k = b.k) "
       "SELECT 'curated' AS source, round(avg(CASE WHEN fa IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_text, "
       "round(avg(CASE WHEN coalesce(fa, false) THEN 1.0 ELSE 0.0 END), 6) AS non_empty FROM j UNION ALL "
       "SELECT 'abstracts', round(avg(CASE WHEN fb IS NOT NULL THEN 1.0 ELSE 0.0 END), 6), "
       "round(avg(CASE WHEN coalesce(fb, false) THEN 1.0 ELSE 0.0 END), 6) FROM j UNION ALL "
       "SELECT 'any', round(avg(CASE WHEN fa IS NOT NULL OR fb IS NOT NULL THEN 1.0 ELSE 0.0 END), 6), "
       "round(avg(CASE WHEN coalesce(fa, false) OR coalesce(fb, false) THEN 1.0 ELSE 0.0 END), 6) FROM j"))
def q_text_cov_sources(spark, d):
    ents = S.entities(spark, d).select(F.col("entity_id").alias("k"))
    r = X.text_coverage_by_source(ents, {
        "curated": S.table(spark, d, "documents").select(F.col("doc_id").alias("k"), "text"),
        "abstracts": S.table(spark, d, "conversations").select(F.col("conv_id").alias("k"), "text")}, "k")
    return r.select("source", F.round("with_text", 6).alias("with_text"), F.round("non_empty", 6).alias("non_empty"))
