"""Key cleaning, text sanitising and small predicate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header prefixes of curated / unreviewed records, evidence
# codes dropped by the "exclude experimental" filter, namespace aliases.
DB_PREFIXES = ("sp", "tr")
EXPERIMENTAL_CODES = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")
ASPECT_ALIASES = {
    "biological_process": "BP", "molecular_function": "MF", "cellular_component": "CC",
    "BP": "BP", "MF": "MF", "CC": "CC", "P": "BP", "F": "MF", "C": "CC",
}
# ASCII whitespace (Java's \s), spelled out so both engines agree.
WS = "[ \\t\\n\\x0B\\f\\r]"


def accession(raw: Column, policy: str) -> Column:
    """Normalise a raw header id.

    strict  : trim; >= 3 pipe parts, prefix sp/tr, non-empty 2nd part -> 2nd part
    lenient : trim; (>= 2 parts and prefix sp/tr) or >= 3 parts -> 2nd part
    regex   : first ``|(.+?)|`` group, else the raw value (no trim)
    split   : 2nd pipe part whenever a pipe exists (no trim)
    otherwise the (trimmed for strict / lenient) raw value.
    """
    if policy in ("strict", "lenient"):
        t = F.trim(raw)
        p = F.split(t, r"\|", -1)
        pre = p.getItem(0).isin(*DB_PREFIXES)
        if policy == "strict":
            cond = (F.size(p) >= 3) & pre & (p.getItem(1) != "")
        else:
            cond = ((F.size(p) >= 2) & pre) | (F.size(p) >= 3)
        return F.when(cond, p.getItem(1)).otherwise(t)
    if policy == "regex":
        pat = r"\|(.+?)\|"
        return F.when(raw.rlike(pat), F.regexp_extract(raw, pat, 1)).otherwise(raw)
    if policy == "split":
        return F.when(raw.contains("|"), F.split(raw, r"\|", -1).getItem(1)).otherwise(raw)
    raise ValueError(f"unknown accession policy {policy!r}")


def sanitise_residues(seq: Column, space_sep: bool = False) -> Column:
    """Rare residues U, Z, O, B -> X; optionally one space between residues."""
    s = F.translate(seq, "UZOB", "XXXX")
    return F.regexp_replace(s, "(.)(?=.)", "$1 ") if space_sep else s


def strip_label_leakage(text: Column) -> Column:
    """Drop explicit GO ids, then any ``GO:`` token, squeeze whitespace, trim."""
    t = F.regexp_replace(text, r"\bGO:[0-9]{7}\b", " ")
    t = F.replace(t, F.lit("GO:"), F.lit(" "))
    return F.trim(F.regexp_replace(t, WS + "+", " "))


def sanitise_control_chars(text: Column) -> Column:
    """XML-illegal control characters -> space (tab, LF, CR kept)."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")


def looks_like_html(text: Column) -> Column:
    """Left-trimmed lower-cased text starts like an HTML page, or has
    ``<html`` in its first 2000 characters."""
    t = F.lower(F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + WS + "+", "")))
    return t.startswith("<!doctype html") | t.startswith("<html") | \
        (F.locate("<html", F.substring(t, 1, 2000)) > 0)


def parse_id_list(raw: Column) -> Column:
    """P5: split on ``[;\\s]+`` and keep all-digit tokens, in order."""
    parts = F.split(F.coalesce(raw, F.lit("")), "[;" + WS[1:-1] + "]+", -1)
    return F.filter(parts, lambda x: x.rlike("^[0-9]+$"))


def aspect_from_namespace(ns: Column, unknown: str = "UNK") -> Column:
    """Namespace / alias -> BP, MF, CC; anything else -> ``unknown``."""
    m = F.create_map(*[F.lit(x) for kv in ASPECT_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(m, ns), F.lit(unknown))


def evidence_filter(rows: DataFrame, only_iea: bool = False, exclude_experimental: bool = False,
                    evidence: str = "evidence") -> DataFrame:
    """IEA-only and / or drop experimental evidence codes."""
    if only_iea:
        rows = rows.filter(F.col(evidence) == "IEA")
    if exclude_experimental:
        rows = rows.filter(~F.col(evidence).isin(*EXPERIMENTAL_CODES))
    return rows


def aspect_threshold(scores: DataFrame, thresholds: DataFrame, default: float | None = None) -> DataFrame:
    """Keep ``score >= thr[aspect]``, else ``thr['ALL']``, else ``default``.
    ``thresholds`` is a few-row ``(aspect, thr)`` parameter table.  A row whose
    aspect has none of the three raises."""
    t = F.broadcast(thresholds.select("aspect", F.col("thr").alias("_thr")))
    all_thr = thresholds.filter(F.col("aspect") == "ALL").select(F.max("thr")).scalar()
    j = scores.join(t, "aspect", "left")
    none = F.raise_error(F.concat(F.lit("no threshold for aspect "), F.coalesce("aspect", F.lit("NULL")))).cast("double")
    thr = F.coalesce(F.col("_thr"), all_thr, none if default is None else F.lit(default))
    return j.filter(F.col("score") >= thr).drop("_thr")


def annotation_problems(ann: DataFrame) -> DataFrame:
    """Bad GO id, bad aspect (not P/F/C), bad entry id (null / blank)."""
    return ann.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(F.col("term_id").rlike("^GO:[0-9]{7}$"), F.lit(False))).alias("bad_term"),
        F.count_if(~F.coalesce(F.col("aspect").isin("P", "F", "C"), F.lit(False))).alias("bad_aspect"),
        F.count_if(F.col("entity_id").isNull() | (F.trim(F.col("entity_id")) == "")).alias("bad_entry"))


def taxonomy_problems(tax: DataFrame) -> DataFrame:
    """Taxon ids that are not all digits."""
    return tax.agg(F.count("*").alias("rows"),
                   F.count_if(~F.coalesce(F.col("taxon_id").cast("string").rlike("^[0-9]+$"),
                                          F.lit(False))).alias("bad_taxon"))


def resolve_alt_ids(terms: DataFrame, alt: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
    """Replace a term missing from the ontology (``term_id``; without one,
    any term) by its primary id via the alt-id map ``(alt_id, term_id)``;
    unknown terms stay as they are."""
    a = alt.select(F.col("alt_id").alias("term_id"), F.col("term_id").alias("_primary"))
    if ontology is not None:
        a = a.join(ontology.select("term_id"), "term_id", "left_anti")
    return terms.join(a, "term_id", "left") \
        .withColumn("resolved", F.coalesce(F.col("_primary"), F.col("term_id"))) \
        .withColumn("was_alt", F.col("_primary").isNotNull()).drop("_primary")
