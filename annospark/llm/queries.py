"""One query per operator of the subpackage (opN_<name>), over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import (chat, decontam, fingerprint, hamming, html_extract, jaccard, licenses, pieces, spelling,
                           token_files, toxicity, trie, url_filter)
from annospark.llm.common import LLM_QUERIES, llm_query, table  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@llm_query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
                                   outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def held_out_col() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    """Learnt from the labelled rows that are not held out."""
    labels = (table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~held_out_col())
              .groupBy("doc_id").agg(F.max("toxic").alias("__toxic")))
    sample = toxicity.labelled_sample(docs.select("doc_id", "text"), labels, label_col="__toxic")
    return toxicity.learn(sample, label_col="__toxic")


@llm_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", held_out_col().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@llm_query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(files)


@llm_query("op10_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


# The rules and the added conversation of the queries' contracts.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
ADDED_TEXT = "\\### Assistant: </turn> ok"
ADDED_TURNS = [(-7, 0, "user", ADDED_TEXT), (-7, 1, "assistant", ADDED_TEXT)]


@llm_query("op3_url_filter")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                           (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'))
           + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@llm_query("op6_chat", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame(ADDED_TURNS, "conv_id long, turn long, role string, text string")
    read = chat.read_examples(chat.format_examples(turns.unionByName(added)))
    line = F.lit("\n")
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    trained = F.array_join("trained", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns_text, 256).alias("turns_sha256"),
                       F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
h AS (SELECT doc_id, md5_number(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""


@llm_query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@llm_query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row for each pair."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


@llm_query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / id div 1000 / id div 50, every 25th a licence file.  Only reshapes."""
    i = F.col("doc_id")
    name = F.concat(F.when(i % 25 == 0, F.lit("LICENSE-")).otherwise(F.lit("file-")), i.cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), (i / 1000).cast("long").cast("string"),
                       (i / 50).cast("long").cast("string"), name)
    return docs.select("doc_id", F.when(i.isNotNull(), path).alias("path"), "text")


@llm_query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(document_paths(table(spark, sf_dir, "documents")), keep=("doc_id",))


def dropped_letters(runs: DataFrame) -> DataFrame:
    """The words of (doc_id, word); one in 97, by a hash of document (null: empty) and word, loses a letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    cut = F.expr("concat(substring(word, 1, cast(h % length(word) AS int)), substring(word, cast(h % length(word) AS int) + 2))")
    return runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("word")).alias("word"))


@llm_query("op12_spelling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(dropped_letters(spelling.word_runs(table(spark, sf_dir, "documents")))))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                             lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1::UBIGINT)))), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r),
m AS (SELECT conv_id, d, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM p
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
l AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS last FROM m),
n AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM l GROUP BY k, d),
ch AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT a.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved_tokens
  FROM v JOIN m a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (k) LEFT JOIN n u ON u.k = v.up"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversation c starts with the first h turns of c - c % 20, h = crc32 of c modulo 4, and goes on with its own."""
    own = trie.turn_digests(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    base = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("start"))
    begun = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base", "left").withColumn("h", h)
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return begun.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@llm_query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


@llm_query("op11_hamming_index")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
