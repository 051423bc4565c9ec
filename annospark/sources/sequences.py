"""FASTA reader.

Records are split by Spark's text reader on the separator ``"\\n>"`` (a
``>`` inside a description is not a record start), so a record never spans
tasks and large files split across the cluster like any text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions import stats


def read_fasta(spark: SparkSession, path: str, with_row_idx: bool = True) -> DataFrame:
    """S1 + S2: ``(row_idx, raw_id, taxon_id, description, sequence)``.

    ``raw_id`` is the first whitespace token of the header, ``taxon_id`` the
    second token as an integer (0 when absent or not an integer), the
    sequence is every following line stripped and concatenated.  Records with
    an empty id are skipped.  ``row_idx`` numbers records in file order
    (files by path, then position inside the file)."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    # file order = (file path, split start, record inside the split); Spark
    # packs splits by size, so the split order alone is not the file order
    rec = raw.select(F.regexp_replace("value", "^>", "").alias("r"),
                     F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"),
                     F.monotonically_increasing_id().alias("_rec"))
    lines = F.split(F.col("r"), "\n", -1)
    header = F.trim(F.regexp_replace(lines.getItem(0), "\r$", ""))
    toks = F.split(header, "[ \t]+", -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    seq = F.array_join(F.transform(body, lambda x: F.trim(F.regexp_replace(x, "[\r\t]", ""))), "")
    second = F.when(F.size(toks) > 1, toks.getItem(1))
    out = rec.select("_file", "_blk", "_rec", toks.getItem(0).alias("raw_id"),
                     F.coalesce(second.try_cast("int"), F.lit(0)).alias("taxon_id"),
                     header.alias("description"), seq.alias("sequence")) \
        .filter((F.col("raw_id").isNotNull()) & (F.col("raw_id") != ""))
    if with_row_idx:
        out = stats.group_positions(out.withColumn("_g", F.lit(0)), ["_g"], ["_file", "_blk", "_rec"],
                                    out="row_idx").drop("_g")
    return out.drop("_file", "_blk", "_rec")


def fasta_header_stats(fasta: DataFrame, n: int) -> DataFrame:
    """S3: number of records and the first ``n`` ids (file order)."""
    first = fasta.filter(F.col("row_idx") < n).agg(
        F.sort_array(F.collect_list(F.struct("row_idx", "raw_id"))).alias("xs"))
    return fasta.agg(F.count("*").alias("records")).select(
        "records", first.select(F.transform("xs", lambda x: x["raw_id"])).scalar().alias("first_ids"))


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "sequence", width: int = 60) -> None:
    """Write ``>header`` + sequence wrapped at ``width`` per record."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped).alias("value")) \
        .write.mode("overwrite").text(path)
