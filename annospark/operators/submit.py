"""Ranked, formatted predictions and their validation.

A submission is a text table of ragged tab-separated lines: GO rows
``entity, term, score`` and free-text rows ``entity, "Text", score,
description``.  Ranking uses ``row_number() <= n`` per entity, which Spark
executes as a partial + final WindowGroupLimit (top-n kept map-side before
the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.operators import ensemble

# Submission rules — at most 1500 terms per entity, at most 5
# free-text rows per entity, at most 3000 characters of text over all rows of an entity (descriptions cut at 2900 -> 2897 + "..."),
# scores clamped to [0.001, 1].
MAX_TERMS = 1500
MAX_TEXT_ROWS = 5
TEXT_MAX = 3000
DESC_CUT = 2900
SCORE_FLOOR = 0.001
GO_RE = "^GO:[0-9]{7}$"


def top_n_per_entity(scores: DataFrame, n: int = MAX_TERMS, key: Column | None = None) -> DataFrame:
    """Clip to [0, 1], drop ``<= 0``, keep the top ``n`` per entity by
    ``key`` (default score) desc with term id as tie-break."""
    s = scores.filter(~F.isnan("score"))  # a NaN would rank above every number
    s = s.withColumn("score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    s = s.filter(F.col("score") > 0)
    k = key if key is not None else F.col("score")
    w = Window.partitionBy("entity_id").orderBy(k.desc(), F.col("term_id"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_n_by_expected_value(scores: DataFrame, ia: DataFrame, n: int = MAX_TERMS,
                            min_conf: float | None = 0.05, ia_default: float = 0.0, row_max: bool = False) -> DataFrame:
    """Rank by ``score * ia`` (optionally only ``score >= min_conf``), keep
    ``score > 0`` and clamp the emitted score to [0.001, 1].  With ``row_max``
    scores are first divided by their entity's largest (the normalised variant)."""
    scores = scores.filter(~F.isnan("score"))
    if row_max:
        scores = ensemble.row_max_normalise(scores)
    s = scores.join(ia.select("term_id", F.col("ia").alias("_ia")), "term_id", "left") \
        .withColumn("_ia", F.coalesce("_ia", F.lit(float(ia_default))))
    if min_conf is not None:
        s = s.filter(F.col("score") >= min_conf)
    s = s.filter(F.col("score") > 0).withColumn("ev", F.col("score") * F.col("_ia"))
    w = Window.partitionBy("entity_id").orderBy(F.col("ev").desc(), F.col("term_id"))
    s = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return s.withColumn("score", F.least(F.greatest(F.col("score"), F.lit(SCORE_FLOOR)), F.lit(1.0))) \
        .drop("_ia")


def fmt_sig3(x: Column) -> Column:
    """C ``%.3g`` (trailing zeros dropped), e.g. 0.5 -> '0.5', 1.0 -> '1',
    0.0004567 -> '0.000457'.  From 0.0001 to below 1000 the exact binary value
    is rounded, as C does (``format_number``; ``format_string`` would round the
    short decimal half-up); beyond, Java's scientific form is taken."""
    a = F.abs(x)
    decimals = F.lit(6)
    for least, d in ((0.001, 5), (0.01, 4), (0.1, 3), (1.0, 2), (10.0, 1), (100.0, 0)):
        decimals = F.when(a >= least, F.lit(d)).otherwise(decimals)
    plain = F.regexp_replace(F.call_function("format_number", x, decimals), ",", "")
    s = F.when((a >= 0.0001) & (a < 999.5), plain).otherwise(F.format_string("%.3g", x))
    return (F.when(s.contains("e"), F.regexp_replace(s, r"\.?0+e", "e"))
            .when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s))


def fmt_fixed3(x: Column) -> Column:
    """S14 variant: ``%.3f`` of the exact binary value after clamping to [0.001, 1]."""
    return F.format_number(F.least(F.greatest(x, F.lit(SCORE_FLOOR)), F.lit(1.0)), 3)


def go_lines(rows: DataFrame, fmt: str = "sig3") -> DataFrame:
    """GO rows as ``entity \\t term \\t score`` lines."""
    f = fmt_sig3 if fmt == "sig3" else fmt_fixed3
    return rows.select("entity_id", F.concat_ws("\t", F.col("entity_id").cast("string"), F.col("term_id"),
                                                f(F.col("score"))).alias("line"))


def ascii_clean(text: Column) -> Column:
    """Tabs / newlines -> space, every non-printable-ASCII character -> '?'."""
    t = F.regexp_replace(text, "[\t\r\n]", " ")
    return F.regexp_replace(t, "[^\\x20-\\x7E]", "?")


def top3_description(scores: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """Per entity the top-k terms by score (term id tie-break) as one
    sentence ``"{id} is predicted to be involved in: a, b, c."`` using term
    names (or ids); ASCII-cleaned, cut to 2897 characters + '...' when longer
    than 2900; score = top score clamped to [0.001, 1]."""
    w = Window.partitionBy("entity_id").orderBy(F.col("score").desc(), F.col("term_id"))
    top = scores.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    top = top.join(names.select("term_id", F.col("name").alias("_n")), "term_id", "left") \
        .withColumn("label", F.coalesce(F.col("_n"), F.col("term_id")))
    g = top.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("r", "label"))).alias("items"), F.max("score").alias("top"))
    txt = F.concat(F.col("entity_id").cast("string"), F.lit(" is predicted to be involved in: "),
                   F.array_join(F.transform("items", lambda x: x["label"]), ", "), F.lit("."))
    txt = ascii_clean(txt)
    txt = F.when(F.length(txt) > DESC_CUT, F.concat(F.substring(txt, 1, DESC_CUT - 3), F.lit("..."))) \
        .otherwise(txt)
    return g.select("entity_id", txt.alias("description"),
                    F.least(F.greatest("top", F.lit(SCORE_FLOOR)), F.lit(1.0)).alias("score"))


def text_lines(desc: DataFrame) -> DataFrame:
    """Free-text rows ``entity \\t Text \\t score \\t description``."""
    return desc.select("entity_id", F.concat_ws("\t", F.col("entity_id").cast("string"), F.lit("Text"),
                                                fmt_sig3(F.col("score")), F.col("description")).alias("line"))


def submission_with_text(go: DataFrame, desc: DataFrame) -> DataFrame:
    """Union of formatted GO rows and free-text rows."""
    return go_lines(go).unionByName(text_lines(desc))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Split ragged lines, keeping every part and the field count."""
    p = F.split(F.col("line"), "\t", -1)
    return lines.select("line", p.alias("parts"), F.size(p).alias("n_cols"))


def audit_submission_lines(lines: DataFrame) -> DataFrame:
    """Totals of GO-like, Text and other rows, bad GO format, by field count."""
    p = parse_lines(lines)
    second = F.col("parts").getItem(1)
    kind = (F.when(second.startswith("GO:"), "go").when(second == "Text", "text").otherwise("other"))
    return p.groupBy("n_cols").agg(
        F.count("*").alias("lines"), F.count_if(kind == "go").alias("go_like"),
        F.count_if(kind == "text").alias("text"), F.count_if(kind == "other").alias("other"),
        F.count_if((kind == "go") & ~second.rlike(GO_RE)).alias("bad_go"))


def validate_submission(rows: DataFrame, desc: DataFrame | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """One violation table ``(rule, entity_id, term_id, detail)``: score
    outside (0, 1], more than ``max_terms`` per entity, duplicate pair, bad
    GO id, more than 5 text rows per entity, descriptions of an entity longer than
    3000 characters together, text rows not printable ASCII."""
    r = rows.select("entity_id", "term_id", "score")
    bad_score = r.filter(~((F.col("score") > 0) & (F.col("score") <= 1))).select(
        F.lit("score_range").alias("rule"), "entity_id", "term_id",
        F.round("score", 6).cast("string").alias("detail"))
    bad_go = r.filter(~F.col("term_id").rlike(GO_RE)).select(
        F.lit("go_format").alias("rule"), "entity_id", "term_id", F.lit(None).cast("string").alias("detail"))
    dup = r.groupBy("entity_id", "term_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(
        F.lit("duplicate").alias("rule"), "entity_id", "term_id", F.col("n").cast("string").alias("detail"))
    many = r.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") > max_terms).select(
        F.lit("too_many_terms").alias("rule"), "entity_id", F.lit(None).cast("string").alias("term_id"),
        F.col("n").cast("string").alias("detail"))
    out = bad_score.unionByName(bad_go).unionByName(dup).unionByName(many)
    if desc is not None:
        total = desc.groupBy("entity_id").agg(F.sum(F.length("description")).alias("n"))
        long_ = total.filter(F.col("n") > TEXT_MAX).select(
            F.lit("text_too_long").alias("rule"), "entity_id", F.lit(None).cast("string").alias("term_id"),
            F.col("n").cast("string").alias("detail"))
        non_ascii = desc.filter(F.col("description").rlike("[^\\x20-\\x7E]")).select(
            F.lit("text_not_ascii").alias("rule"), "entity_id", F.lit(None).cast("string").alias("term_id"),
            F.lit(None).cast("string").alias("detail"))
        many_text = desc.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_TEXT_ROWS) \
            .select(F.lit("too_many_text_rows").alias("rule"), "entity_id", F.lit(None).cast("string").alias("term_id"),
                    F.col("n").cast("string").alias("detail"))
        out = out.unionByName(long_).unionByName(non_ascii).unionByName(many_text)
    return out


def submission_stats(rows: DataFrame) -> DataFrame:
    """Rows, distinct entities, distinct terms, mean rows per entity."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"),
                    F.countDistinct("term_id").alias("terms")) \
        .withColumn("per_entity", F.col("rows") / F.col("entities"))
