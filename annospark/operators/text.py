"""Text operators: corpus assembly, TF-IDF, id lists, coverage.

TF-IDF is a DataFrame job: lower-case, accent strip (an Arrow-batched
pandas UDF around ``unicodedata`` — Spark has no Unicode normaliser),
tokens ``[\\p{L}\\p{N}_]{2,}`` (maximal runs, i.e. ``\\b\\w\\w+\\b`` with
Unicode classes), 1..n-grams, document frequencies with partial
aggregation, vocabulary = the ``max_features`` most frequent n-grams with
``df >= min_df`` (count desc, n-gram asc), ``idf = ln((1+n)/(1+df)) + 1``,
raw tf, L2 row norm.  Output stays long ``(doc, term, col_idx, value)``.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.functions import stats
from annospark.session import spread

TOKEN_RE = "[\\p{L}\\p{N}_]{2,}"
_COMBINING = None


def _combining_table():
    global _COMBINING
    if _COMBINING is None:
        _COMBINING = {cp: None for cp in range(sys.maxunicode + 1) if unicodedata.combining(chr(cp))}
    return _COMBINING


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD-decompose and drop combining marks (per Arrow batch)."""
    table = _combining_table()
    return s.map(lambda t: None if t is None else t if t.isascii()
                 else unicodedata.normalize("NFKD", t).translate(table))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def ngrams(toks: Column, n_max: int) -> Column:
    """All 1..n_max-grams of a token array, joined by single spaces.
    ``toks`` should be a column reference (the lambdas index it)."""
    out = toks
    if n_max >= 2:
        m = F.size(toks) - 1
        bi = F.zip_with(F.slice(toks, 1, F.greatest(m, F.lit(1))), F.slice(toks, 2, F.greatest(m, F.lit(1))),
                        lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, F.when(m >= 1, bi).otherwise(F.array().cast("array<string>")))
    for n in range(3, n_max + 1):
        m = F.size(toks) - n + 1
        g = F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
                        lambda i: F.array_join(F.slice(toks, i, n), " "))
        out = F.concat(out, F.when(m >= 1, g).otherwise(F.array().cast("array<string>")))
    return out


def tfidf(docs: DataFrame, id_col: str, text_col: str, max_features: int, ngram_max: int = 2,
          min_df: int = 2) -> DataFrame:
    """long TF-IDF ``(id, term, col_idx, value)`` fitted on all of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n_docs = docs.agg(F.count("*")).scalar()
    d = spread(d)  # tokenising is CPU-heavy: use every core even for a few input splits
    folded = d.select("doc", strip_accents(F.lower("t")).alias("s"))
    # tokens materialised once per document: the n-gram lambdas then index a
    # column instead of re-running the tokenizer per position.  A document's rows are brought together as
    # tokens: its n-grams, several times the text, are then counted and weighed without another shuffle
    tok = folded.select("doc", tokens(F.col("s")).alias("toks")).repartition("doc")
    toks = tok.select("doc", F.explode(ngrams(F.col("toks"), ngram_max)).alias("term"))
    tf = toks.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    stat = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    vocab = stat.filter(F.col("df") >= min_df).orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    # alphabetical column order over a vocabulary bounded by max_features
    vocab = vocab.withColumn("col_idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    x = tf.join(F.broadcast(vocab.select("term", "col_idx", idf.alias("idf"))), "term")
    x = x.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return x.select(F.col("doc").alias(id_col), "term", "col_idx", (F.col("w") / norm).alias("value"))


def concat_text_by_key(rows: DataFrame, key: str, order: str, text: str, sep: str = " \n ") -> DataFrame:
    """Many rows -> one text per key, joined by ``sep`` in ``order``."""
    g = rows.filter(F.col(text).isNotNull()).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("xs"))
    return g.select(key, F.array_join(F.transform("xs", lambda x: x["t"]), sep).alias("text"))


def assemble_corpus(records: DataFrame, fields: list[str], abstracts: DataFrame, max_pmids: int = 3,
                    max_abstract_chars: int = 2000, strip_leakage: bool = True) -> DataFrame:
    """Per record the non-empty curated fields joined by a space, then the
    first ``max_pmids`` referenced abstracts as ``"title. abstract"`` (each
    stripped of surrounding spaces / dots, abstract cut to
    ``max_abstract_chars``), all joined by spaces; optional label-leak strip.

    ``records``: ``(key, fields..., pmids ARRAY<STRING>)``;
    ``abstracts``: ``(pmid, title, abstract)``."""
    from annospark.functions.keys import strip_label_leakage
    cur = F.concat_ws(" ", *[F.when(F.trim(F.col(f)) != "", F.trim(F.col(f))) for f in fields])
    r = records.select("key", cur.alias("curated"), F.slice(F.col("pmids"), 1, max_pmids).alias("pm"))
    ex = r.select("key", F.posexplode("pm").alias("pos", "pmid"))
    a = abstracts.select("pmid", F.coalesce("title", F.lit("")).alias("title"),
                         F.substring(F.coalesce("abstract", F.lit("")), 1, max_abstract_chars).alias("abstract"))
    j = ex.join(a, "pmid").filter((F.col("title") != "") | (F.col("abstract") != ""))
    piece = F.regexp_replace(F.concat(F.col("title"), F.lit(". "), F.col("abstract")), "^[ .]+|[ .]+$", "")
    pm = j.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("p")))).alias("xs"))
    pm = pm.select("key", F.array_join(F.transform("xs", lambda x: x["p"]), " ").alias("pubmed"))
    out = r.join(pm, "key", "left")
    text = F.trim(F.concat_ws(" ", F.when(F.col("curated") != "", F.col("curated")), F.col("pubmed")))
    if strip_leakage:
        text = F.when(text != "", strip_label_leakage(text)).otherwise(text)
    return out.select("key", text.alias("text"), (F.col("curated") != "").alias("has_curated"),
                      F.col("pubmed").isNotNull().alias("has_pubmed"))


def text_coverage(entities: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Share of entities with any corpus row, and with non-empty text."""
    c = corpus.groupBy(key).agg(F.max(F.length(F.trim(F.col("text"))) > 0).alias("non_empty"))
    j = entities.select(key).distinct().join(c, key, "left")
    return j.agg(F.avg(F.col("non_empty").isNotNull().cast("double")).alias("with_text"),
                 F.avg(F.coalesce(F.col("non_empty"), F.lit(False)).cast("double")).alias("non_empty"))


def text_coverage_by_source(entities: DataFrame, corpora: dict[str, DataFrame], key: str) -> DataFrame:
    """A27 for several corpora of ``(key, text)``: per source, and for ``any`` of them, the share of entities with a row and
    with a non-empty text.  All corpora are grouped by key in one pass."""
    rows = None
    for name, df in corpora.items():
        x = df.select(key, F.lit(name).alias("source"), (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("filled"))
        rows = x if rows is None else rows.unionByName(x)
    of = {name: F.col("source") == name for name in corpora} | {"any": F.lit(True)}
    flags = rows.groupBy(key).agg(*[F.max(F.when(cond, F.lit(True))).alias(f"row_{i}") for i, cond in enumerate(of.values())],
                                  *[F.max(F.when(cond, F.col("filled"))).alias(f"text_{i}") for i, cond in enumerate(of.values())])
    j = entities.select(key).distinct().join(flags, key, "left")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    one = j.agg(F.array(*[F.struct(F.lit(name).alias("source"), share(f"row_{i}").alias("with_text"),
                                   share(f"text_{i}").alias("non_empty")) for i, name in enumerate(of)]).alias("rows"))
    return one.select(F.inline("rows"))


_EDGE_WS = "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$"
_PIECE_END = "\uE000\uF8FE\uE000"  # private-use characters: marks the end of each abstract piece


def parse_pubmed_xml(xml: DataFrame, col: str = "xml") -> DataFrame:
    """One ``PubmedArticle`` document per row -> first PMID, title and all
    ``Article/Abstract/AbstractText`` pieces (each its full string value,
    inline markup included), all whitespace-trimmed, the pieces that are not
    empty joined by single spaces; rows without a PMID are dropped.  The end
    of each piece is marked before the text nodes are read, so any number of
    pieces comes apart again."""
    x = F.col(col)
    marked = F.regexp_replace(x, "</AbstractText\\s*>", _PIECE_END + "</AbstractText>")
    trim = lambda c: F.regexp_replace(c, _EDGE_WS, "")
    pmid = trim(F.xpath_string(x, F.lit("string((//MedlineCitation/PMID)[1])")))
    title = trim(F.xpath_string(x, F.lit("string((//Article/ArticleTitle)[1])")))
    nodes = F.array_join(F.xpath(marked, F.lit("//Article/Abstract/AbstractText//text()")), "")
    pieces = F.transform(F.split(nodes, _PIECE_END), trim)
    abstract = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
    return xml.select(pmid.alias("pmid"), title.alias("title"), abstract.alias("abstract")) \
        .filter(F.col("pmid") != "")


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Wanted keys absent from the cache, numbered in key order and cut
    into fetch batches of ``batch_size``."""
    m = wanted.select(key).distinct().join(cache.select(key), key, "left_anti").withColumn("_g", F.lit(0))
    m = stats.group_positions(m, ["_g"], [key], out="pos").drop("_g")
    return m.select(key, (F.floor(F.col("pos") / batch_size)).cast("long").alias("batch"))
