"""Files of many XML articles (X1): splittable reading by closing tag, malformed records kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.operators.text import parse_pubmed_xml


def read_xml_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """``(file, xml, malformed)``: every ``row_tag`` element of the UTF-8 files under ``path``.

    Files are cut at the closing tag, so a large file is read by many tasks and no file is held whole; prologue,
    root element and text between records are left out.  ``malformed`` records are not well-formed XML on their
    own (an entity that XML does not define included).  An opening tag without a closing one before the next
    opening gives a malformed record that ends there; so does a file cut off inside an element.  Elements that
    nest in themselves, and tags inside comments or CDATA, are not supported.  Files without records give no rows.
    """
    opening = f"<{row_tag}(?:\\s[^<>]*[^/<>])?>"
    piece = F.col("value")
    text = spark.read.option("lineSep", f"</{row_tag}>").text(path).select(F.col("_metadata.file_path").alias("file"), piece)
    last = F.regexp_extract(piece, f"(?s)^.*({opening}.*)$", 1)
    before = F.regexp_extract(piece, f"(?s)^.*?({opening}.*){opening}.*$", 1)  # an unclosed record ahead of the last
    found = F.array(F.struct(F.when(last != "", F.concat(last, F.lit(f"</{row_tag}>"))).alias("xml"), F.lit(False).alias("cut")),
                    F.struct(F.when(before != "", before).alias("xml"), F.lit(True).alias("cut")))
    rows = text.select("file", F.inline(F.filter(found, lambda r: r["xml"].isNotNull())))
    corrupt = F.from_xml("xml", "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull()
    return rows.select("file", "xml", (F.col("cut") | corrupt).alias("malformed"))


def read_article_files(spark: SparkSession, path: str, row_tag: str = "PubmedArticle") -> tuple[DataFrame, DataFrame]:
    """X1 over files: (the parsed articles, the malformed records as ``(file, xml)``).

    Articles are those of :func:`parse_pubmed_xml`, one row per record with an id, repeated ids included.
    """
    records = read_xml_records(spark, path, row_tag)
    # XPath fails on malformed text, so it never sees any, wherever the filter runs
    safe = F.when(F.col("malformed"), F.lit("<none/>")).otherwise(F.col("xml"))
    return (parse_pubmed_xml(records.select(safe.alias("xml"))),
            records.filter("malformed").select("file", "xml"))
