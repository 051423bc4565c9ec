"""Tabular sources and sinks.

All readers declare their schema (no inference) and validate headers with a
small job instead of trusting the first line; malformed numeric fields are
coerced with ``try_cast`` and dropped, never silently shifted.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_gaf(spark: SparkSession, path: str, repartition: int | None = None) -> DataFrame:
    """GAF 2.x ``(entity_id, term_id, evidence)`` = tab fields 2, 5, 7.
    ``!`` comment lines and lines with fewer than 7 fields are skipped.  Gzip
    files are not splittable, so a repartition after the scan spreads the
    rows before any wide work."""
    t = spark.read.text(path).filter(~F.col("value").startswith("!") & (F.col("value") != ""))
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    out = t.select(p.alias("p")).filter(F.size("p") >= 7).select(
        F.col("p").getItem(1).alias("entity_id"), F.col("p").getItem(4).alias("term_id"),
        F.col("p").getItem(6).alias("evidence"))
    return out.repartition(repartition) if repartition else out


def write_gaf(rows: DataFrame, path: str, header: str = "!gaf-version: 2.2") -> None:
    """Write ``(entity_id, term_id, evidence)`` rows as 17-column GAF lines."""
    line = F.concat_ws("\t", F.lit("DB"), F.col("entity_id").cast("string"), F.col("entity_id").cast("string"),
                       F.lit(""), F.col("term_id"), F.lit("REF:0"), F.col("evidence"), F.lit(""),
                       F.lit("P"), F.lit(""), F.lit(""), F.lit("protein"), F.lit("taxon:0"), F.lit("20240101"),
                       F.lit("DB"), F.lit(""), F.lit(""))
    hdr = rows.sparkSession.createDataFrame([(header,)], "value string")
    hdr.unionByName(rows.select(line.alias("value"))).write.mode("overwrite").text(path)


ANNOTATION_HEADER = ["EntryID", "term", "aspect"]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """TSV with the exact header ``EntryID  term  aspect``; all strings."""
    first = spark.read.text(path).limit(1).collect()  # one header line
    if not first or first[0]["value"].rstrip("\r").split("\t") != ANNOTATION_HEADER:
        raise ValueError(f"annotation header must be exactly {ANNOTATION_HEADER}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATION_HEADER])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)
    return df.select(F.col("EntryID").alias("entity_id"), F.col("term").alias("term_id"), "aspect")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column TSV ``(entity_id, taxon_id)``; rows with
    another field count fail the read."""
    t = spark.read.text(path)
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    checked = t.select(F.when(F.size(p) == 2, p).otherwise(
        F.raise_error(F.concat(F.lit("taxonomy line must have 2 columns: "), F.col("value")))).alias("p"))
    return checked.select(F.col("p").getItem(0).alias("entity_id"), F.col("p").getItem(1).alias("taxon_id"))


# Header names of the weight table.
IA_TERM_NAMES = ["term", "#term", "term_id"]
IA_WEIGHT_NAMES = ["ia", "information_accretion"]


def read_ia(spark: SparkSession, path: str) -> DataFrame:
    """IA weights ``(term_id, ia)``.  A header line that names both columns
    (``term`` / ``#term`` / ``term_id``; ``ia`` / ``information_accretion``, in
    any order, among others) tells where they are; without one the first two
    fields are taken.  Lines whose weight is not numeric are dropped, so a
    headerless file keeps its first term."""
    t = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    low = F.transform(F.split(F.lower("value"), "[\t ]+", -1), F.trim)
    header = t.filter(F.arrays_overlap(low, F.array(*map(F.lit, IA_TERM_NAMES)))
                      & F.arrays_overlap(low, F.array(*map(F.lit, IA_WEIGHT_NAMES)))).first()
    sep, term_at, ia_at = "[\t ]+", 0, 1
    if header is not None:
        sep = "\t" if "\t" in header["value"] else sep
        names = [x.strip() for x in re.split(sep, header["value"].lower())]
        term_at = next(i for i, x in enumerate(names) if x in IA_TERM_NAMES)
        ia_at = next(i for i, x in enumerate(names) if x in IA_WEIGHT_NAMES)
    p = F.split("value", sep, -1)
    rows = t.select(F.trim(F.get(p, term_at)).alias("term_id"), F.trim(F.get(p, ia_at)).try_cast("double").alias("ia"))
    return rows.filter(F.col("ia").isNotNull() & (F.col("term_id") != ""))


def select_term_counts(df: DataFrame) -> DataFrame:
    """Pick the term column (``term`` / ``go_id`` / ``index`` / first) and the
    count column (``count`` / ``n`` / second) case-insensitively."""
    low = {c.lower(): c for c in df.columns}
    term = next((low[c] for c in ("term", "term_id", "go_id", "index") if c in low), df.columns[0])
    cnt = next((low[c] for c in ("count", "n", "cnt") if c in low),
               [c for c in df.columns if c != term][0])
    return df.select(F.col(term).cast("string").alias("term_id"), F.col(cnt).cast("long").alias("n"))


def read_embeddings(spark: SparkSession, path: str, modality: str, id_col: str = "entity_id",
                    vec_col: str = "vec") -> DataFrame:
    """One modality's vectors from a Parquet table ``(entity_id, modality,
    vec)``; the modality filter and the two columns are pushed into the scan.
    A modality with no rows fails fast."""
    df = spark.read.parquet(path).filter(F.col("modality") == modality).select(id_col, vec_col)
    if df.isEmpty():
        raise ValueError(f"modality {modality!r} missing in {path}")
    return df


def read_text_corpus(spark: SparkSession, path: str, id_col: str, text_col: str, sep: str = "\t",
                     fmt: str = "csv") -> DataFrame:
    """``(key, text)`` from CSV/TSV or Parquet, columns validated, nulls dropped."""
    if fmt == "csv":
        df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False)
    else:
        df = spark.read.parquet(path)
    missing = [c for c in (id_col, text_col) if c not in df.columns]
    if missing:
        raise ValueError(f"expected columns {id_col!r}, {text_col!r}; missing {missing}")
    return df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text")) \
        .dropna()


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Ragged submission lines with all parts and their count."""
    from annospark.operators.submit import parse_lines
    return parse_lines(spark.read.text(path).select(F.col("value").alias("line")))


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds the ``_SUCCESS`` marker; only a missing path
    counts as not done, any other read error is raised."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_stage(df: DataFrame, path: str, skip_if_exists: bool = True) -> DataFrame:
    """Write a Parquet stage unless it is already complete (a ``_SUCCESS``
    marker exists); returns the stage read back from storage."""
    spark = df.sparkSession
    if not (skip_if_exists and stage_done(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_submission(lines: DataFrame, path: str) -> None:
    """Write formatted lines (``line`` column) as headerless text."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_contract(contract: DataFrame, path: str) -> None:
    """The ordered contract ``(col_idx, term_id, aspect)`` as JSON lines."""
    contract.select("col_idx", "term_id", "aspect").write.mode("overwrite").json(path)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    schema = "col_idx INT, term_id STRING, aspect STRING"
    return spark.read.schema(schema).json(path)


def contract_from_json_list(spark: SparkSession, doc: str, aspects: dict[str, str] | None = None) -> DataFrame:
    """A contract stored as a JSON list of term ids (position = column)."""
    terms = json.loads(doc)
    rows = [(i, t, (aspects or {}).get(t, "UNK")) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "col_idx int, term_id string, aspect string")


# The curated-record TSV columns (header names as exported).
UNIPROT_COLUMNS = {
    "Entry": "accession", "Protein names": "protein_name", "Organism": "organism_name", "Keywords": "keywords",
    "Protein families": "protein_families", "Function [CC]": "cc_function",
    "Subcellular location [CC]": "cc_subcellular_location", "PubMed ID": "pubmed_ids",
}


def read_uniprot_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Curated-record TSV with a header -> the eight fields (trimmed),
    ``pubmed_ids`` parsed with P5 (digits only, order kept, first occurrence
    wins); rows with a blank accession are skipped."""
    from annospark.functions.keys import parse_id_list
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    cols = []
    for src, dst in UNIPROT_COLUMNS.items():
        c = F.trim(F.col(f"`{src}`")) if src in df.columns else F.lit("")
        cols.append(F.coalesce(c, F.lit("")).alias(dst))
    out = df.select(*cols).filter(F.col("accession") != "")
    return out.withColumn("pubmed_ids", F.array_distinct(parse_id_list(F.col("pubmed_ids"))))
