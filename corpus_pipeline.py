"""The corpus pipeline: toxicity, near copies, benchmark decontamination, tokens.

Each stage takes the documents that its predecessor kept and returns those it
keeps, with the columns of ``documents``; the last returns their token ids.

All stages: an empty table gives an empty table; a null text counts as empty,
and null ids are ids like any other; whole texts are read, however long; extra
columns of any name pass through the first three stages.  Rows with a null or
empty text are never toxic, copies or leaks, so all of them reach the last
stage, which gives them the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import decontam, jaccard, pieces, toxicity
from annospark.llm.common import free_name, prepare, stored, table
from annospark.llm.queries import tokenizer_path, toxicity_lexicon
from annospark.plans.registry import Query


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the lexicon is learnt from labelled documents.

    Every row is scored on its own: repeated rows stay or go together, and a
    score of exactly 0.5 goes.
    """
    prepare(spark)
    score = free_name(docs.columns, "__toxicity")
    lexicon = toxicity_lexicon(spark, docs, sf_dir)
    scored = toxicity.score_documents(docs, lexicon, keep=tuple(docs.columns), out=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the least id (and text hash) stays; documents
    without words link with nothing and stay.

    Of equal rows with words one stays.  A null id counts as greater than all
    others; rows that share an id but not a group are judged apart.
    """
    prepare(spark)
    key, text_hash, every = (free_name(docs.columns, name) for name in ("__id", "__th", "__every"))
    found = jaccard.jaccard_components(docs)
    # one surviving (id, text) of each component, and only one of equal rows
    keep = (found.where("n_shingles > 0").groupBy("set_label")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("r"))
            .select(F.col("r.doc_id").alias(key), F.col("r.th").alias(text_hash), F.lit(False).alias(every)))
    empty = (found.where("n_shingles = 0").select(F.col("doc_id").alias(key), F.col("th").alias(text_hash)).distinct()
             .withColumn(every, F.lit(True)))
    keep = stored(keep.unionByName(empty), "kept")
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)))
    once = kept.where(~F.col(every)).dropDuplicates([key, text_hash])
    return kept.where(F.col(every)).unionByName(once).drop(key, text_hash, every)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers, names or units, go.

    Repeated rows stay or go together; an empty benchmark leaves every row.
    """
    prepare(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, and the digest of the text decoded from them; one row
    for every row, also for repeated ones."""
    prepare(spark)
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"),
                                   outputs=("n_tokens", "ids", "decoded_sha256"), keep=("doc_id",))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # learnt scores and tokenizer ids are beyond SQL; see tests/llm for what is compared


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


PIPELINE_QUERY = {"pipeline": Query("pipeline", run, ORACLE_SQL, "pipeline")}
