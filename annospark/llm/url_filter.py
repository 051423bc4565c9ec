"""URL filter: host and path rules, else a character language-model ratio.

Two variable-order Markov models of characters, one of URLs that the rules
accept and one of URLs they reject, are counted over all ruled URLs (contexts
of up to four characters, Witten-Bell smoothing that falls back to shorter
contexts and at last to an even distribution).  A URL that no rule fits is
judged by the difference of the log-likelihoods per character against a
threshold calibrated on ruled URLs that were left out of the counts.

Counting and scoring are joins and sums over distinct character windows, so the
models are never held in one place.

Defined results: null URLs and URLs without ``://`` have empty host and path;
repeated URLs get the same verdict; without ruled URLs of both kinds the
threshold is 0 and every ratio 0, which allows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4        # longest context
ALPHABET = 256   # characters the even distribution is spread over
LEFT_OUT = 5     # one ruled URL in so many calibrates the threshold
BIN, BINS = 0.02, 500  # calibration histogram: bins of BIN, at most BINS either side of 0
START, END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(after, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.  ``rules``: (host/path, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _characters(url: Column) -> Column:
    """The text the models read: what follows the scheme, closed by an end mark."""
    u = F.coalesce(url, F.lit(""))
    return F.concat(F.lit(START * ORDER), F.regexp_replace(u, r"^.*?://", ""), F.lit(END))


def windows(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character: ``gram``, the character after its longest context."""
    t = urls.select(*keep, _characters(F.col("url")).alias("t"))
    return t.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(1), F.length("t") - ORDER), lambda i: F.substring(F.col("t"), i, F.lit(ORDER + 1)))).alias("gram"))


def model(ruled: DataFrame, needed: DataFrame) -> DataFrame:
    """(gram, ratio): log P(accept) - log P(reject) of the last character of each needed gram.

    ``ruled`` has (url, accepted); the counts are summed per distinct gram first.
    """
    seen = (windows(ruled, "accepted").groupBy("gram")
            .agg(F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r")))
    scores = needed.select("gram").distinct()
    even = 1.0 / ALPHABET
    scores = scores.withColumns({"pa": F.lit(even), "pr": F.lit(even)})
    for k in range(ORDER + 1):  # from no context to the longest
        size = k + 1
        grams = seen.groupBy(F.expr(f"right(gram, {size})").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        contexts = grams.groupBy(F.expr(f"left(g, {k})").alias("h")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.count(F.when(F.col("a") > 0, 1)).alias("ta"), F.count(F.when(F.col("r") > 0, 1)).alias("tr"))
        s = scores.withColumns({"g": F.expr(f"right(gram, {size})"),
                                "h": F.expr(f"left(right(gram, {size}), {k})")})
        s = s.join(grams, "g", "left").join(contexts, "h", "left")

        def mixed(n: str, total: str, kinds: str, below: str) -> Column:
            """Witten-Bell: as much weight for what lies below as there are kinds of successors."""
            return F.when(F.col(total) > 0, (F.coalesce(F.col(n), F.lit(0)) + F.col(kinds) * F.col(below))
                          / (F.col(total) + F.col(kinds))).otherwise(F.col(below))

        scores = s.select("gram", mixed("a", "na", "ta", "pa").alias("pa"), mixed("r", "nr", "tr", "pr").alias("pr"))
    return scores.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def log_ratios(urls: DataFrame, scores: DataFrame) -> DataFrame:
    """(url, ratio): the mean over the characters of each distinct URL."""
    # sums of rounded integers do not depend on the order of the rows
    return (windows(urls, "url").join(scores, "gram").groupBy("url")
            .agg((F.sum(F.round(F.col("ratio") * 1e9).cast("long")) / F.count("*") / 1e9).alias("ratio")))


def calibrated(left_out: DataFrame) -> float:
    """The threshold with the least sum of both error rates on (ratio, accepted); ties go to the one nearest 0."""
    clipped = F.greatest(F.least(F.floor(F.col("ratio") / BIN), F.lit(BINS)), F.lit(-BINS)).cast("int")
    rows = left_out.groupBy(clipped.alias("b")).agg(  # at most 2 * BINS + 1 rows
        F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r")).collect()
    n_a, n_r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not n_a or not n_r:
        return 0.0
    def errors(t: int) -> float:
        return sum(x["a"] for x in rows if x["b"] < t) / n_a + sum(x["r"] for x in rows if x["b"] >= t) / n_r
    return min(range(-BINS, BINS + 2), key=lambda t: (round(errors(t), 12), abs(t), t)) * BIN


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, ratio, threshold) of every row; ratio is null where a rule decides."""
    from annospark.llm.common import stored

    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("url")) \
        .withColumns({"host": host, "path": path})
    rows = rows.withColumn("ruled", apply_rules(F.col("host"), F.col("path"), rules))
    distinct = stored(rows.select("url", "ruled").where(F.col("url").isNotNull()).distinct(), "urls")
    ruled = distinct.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled.verdict") == "allow").alias("accepted"))
    out = F.pmod(F.xxhash64("url"), F.lit(LEFT_OUT)) == 0
    unruled = distinct.where(F.col("ruled").isNull()).select("url")
    to_score = ruled.where(out).select("url").unionByName(unruled)
    training = ruled.where(~out)
    kinds = training.agg(F.countDistinct("accepted")).first()[0]
    if kinds == 2:
        scores = model(training, windows(to_score))
    else:
        scores = windows(to_score).distinct().withColumn("ratio", F.lit(0.0))
    ratios = stored(log_ratios(to_score, scores), "url-ratios")
    threshold = calibrated(ratios.join(ruled, "url")) if kinds == 2 else 0.0
    judged = rows.join(ratios.join(unruled, "url", "left_semi"), "url", "left")
    # a null url has nothing to read: ratio 0
    ratio = F.when(F.col("ruled").isNull(), F.coalesce("ratio", F.lit(0.0)))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(ratio >= threshold, "allow").otherwise("block"))
    return judged.select(id_col, "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"),
                         ratio.alias("ratio"), F.lit(threshold).alias("threshold"))
