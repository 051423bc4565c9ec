"""OBO ontology reader (S4) — the strict variant.

Stanzas are split by the text reader on ``"\\n["``; only ``[Term]`` stanzas
are kept, so tags inside ``[Typedef]`` (or any other) stanzas never leak
into the preceding term.  Each stanza is parsed with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.keys import aspect_from_namespace


def _tag(lines: Column, tag: str) -> Column:
    """All values of ``tag:`` lines, in order (text after the first ``': '``)."""
    pre = f"{tag}: "
    return F.transform(F.filter(lines, lambda x: x.startswith(pre)),
                       lambda x: F.trim(F.substring(x, len(pre) + 1, 1 << 30)))


def read_obo_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``[Term]`` stanza with its lines and a file-order key."""
    raw = spark.read.option("lineSep", "\n[").text(path)
    st = raw.select(F.regexp_replace("value", "^\\[", "").alias("s"), F.monotonically_increasing_id().alias("pos"))
    st = st.filter(F.col("s").startswith("Term]"))
    lines = F.transform(F.split(F.col("s"), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return st.select("pos", lines.alias("lines"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(terms, edges, alt_ids)``.

    terms  ``(term_id, name, namespace, aspect, is_obsolete, pos)``
    edges  ``(child, parent)`` from ``is_a`` (text before `` ! ``)
    alt_ids ``(alt_id, term_id)``, the first primary in file order wins."""
    st = read_obo_stanzas(spark, path).select(
        "pos", F.element_at(_tag(F.col("lines"), "id"), 1).alias("term_id"),
        F.element_at(_tag(F.col("lines"), "name"), 1).alias("name"),
        F.element_at(_tag(F.col("lines"), "namespace"), 1).alias("namespace"),
        F.exists(_tag(F.col("lines"), "is_obsolete"), lambda v: F.lower(v) == "true").alias("is_obsolete"),
        F.transform(_tag(F.col("lines"), "is_a"), lambda v: F.trim(F.split(v, " ! ").getItem(0))).alias("is_a"),
        _tag(F.col("lines"), "alt_id").alias("alt"))
    st = st.filter(F.col("term_id").isNotNull())
    terms = st.select("term_id", "name", "namespace", aspect_from_namespace(F.col("namespace")).alias("aspect"),
                      "is_obsolete", "pos")
    edges = st.select(F.col("term_id").alias("child"), F.explode("is_a").alias("parent")).distinct()
    alt = st.select("pos", "term_id", F.explode("alt").alias("alt_id"))
    alt = alt.groupBy("alt_id").agg(F.min_by("term_id", "pos").alias("term_id"))
    return terms, edges, alt


def write_obo(terms: DataFrame, edges: DataFrame, path: str, alt_ids: DataFrame | None = None,
              extra_stanzas: DataFrame | None = None) -> None:
    """Write ``[Term]`` stanzas (id, name, namespace, is_a with ``! name``,
    alt_id, is_obsolete) plus optional extra stanza texts (a ``value`` column)."""
    names = terms.select(F.col("term_id").alias("parent"), F.col("name").alias("pname"))
    isa = edges.join(names, "parent", "left").groupBy(F.col("child").alias("term_id")).agg(
        F.sort_array(F.collect_list(F.concat(F.lit("is_a: "), F.col("parent"), F.lit(" ! "),
                                             F.coalesce("pname", F.lit(""))))).alias("isa"))
    t = terms.join(isa, "term_id", "left")
    if alt_ids is not None:
        alts = alt_ids.groupBy("term_id").agg(F.sort_array(F.collect_list(
            F.concat(F.lit("alt_id: "), F.col("alt_id")))).alias("alts"))
        t = t.join(alts, "term_id", "left")
    else:
        t = t.withColumn("alts", F.array().cast("array<string>"))
    body = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), F.col("term_id")),
                       F.concat(F.lit("name: "), F.col("name")), F.concat(F.lit("namespace: "), F.col("namespace")),
                       F.coalesce(F.col("alts"), F.array().cast("array<string>")),
                       F.coalesce(F.col("isa"), F.array().cast("array<string>")),
                       F.when(F.col("is_obsolete"), F.lit("is_obsolete: true")), F.lit(""))
    out = t.select(body.alias("value"))
    if extra_stanzas is not None:
        out = out.unionByName(extra_stanzas.select("value"))
    out.write.mode("overwrite").text(path)
