"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are brought to a template form: numbers (also in words), units after a number, and names
(words with a capital first letter inside a sentence, not all in capitals, and the same words where they begin a
sentence of that text) become typed placeholders; the rest is
lower-cased and stripped of punctuation.  Windows of five template words are
hashed and joined with those of the benchmark items (with and without names
replaced, so a leak in another case matches too).  Of an item's windows that a
document holds, those count whose slots are consistent: along one alignment,
each replaced value of the item always meets the same value in the document
(also outside the windows held, where the literal words beside it are the
item's), or all values of the window are the item's own.
That catches questions asked again with other numbers or names.  A document is
contaminated by an item if at least half of the item's windows count.  Windows
with fewer than two literal words are no evidence, so they are left out of both
numbers.  An item most of whose windows are such (numbers, lists of names) is
searched by its plain words instead: windows of five words as they are.

Defined results: null or empty texts match nothing; items of two to four words
match where a text holds these words in a row, items of one word only a text that
is nothing else; item rows that share an id, or have none, are searched each;
repeated documents are reported each; very long texts are read whole; an empty
benchmark flags nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import free_name, let, stored

WINDOW, LEAST_SHARE, LEAST_LITERAL = 5, 0.5, 2
WITH_NAMES, OTHER_CASE, PLAIN = 0, 1, 2  # kinds of windows: names replaced, names kept, plain words
BROADCAST_ROWS = 1_000_000  # benchmark window hashes (8 bytes each) are broadcast up to here, joined by a shuffle beyond
NUMBER, NAME, UNIT = "", "", ""
# Units that count when they follow a number.
UNITS = ("kg g mg lb lbs oz km m cm mm mi ft yd inch inches mile miles meter meters metre metres hour hours hr hrs "
         "minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros "
         "cent cents usd eur percent litre litres liter liters ml l kb mb gb tb mph kmh volt volts watt watts degrees").split()

_CAPITALISED = r"\p{Lu}\p{Ll}[\p{L}\p{M}'’-]*"
_NAME_RE = rf"(?=\p{{Lu}})(?<=[\p{{L}}\p{{N}},;'’)] ){_CAPITALISED}"
_SENTENCE_RE = rf"(?=[\"“(]*\p{{Lu}})(?<=[^\p{{L}}\p{{N}},;'’){NAME}] |[\n\r\t])"
_FIRST_RE = rf"^([\"“(]*)({_CAPITALISED})"
# Numbers in words ("one" is more often no number).
NUMBER_WORDS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
# word by word; the first two letters are looked at before the rest
_SPELT_RE = "(?:" + "|".join(
    f"[{c}{c.upper()}](?=[{''.join(sorted({x for w in ws for x in w[1] + w[1].upper()}))}])(?<![\\p{{L}}\\p{{N}}'’].)"
    f"(?i:{'|'.join(w[1:] for w in ws)})"
    for c, ws in ((c, [w for w in NUMBER_WORDS if w[0] == c]) for c in sorted({w[0] for w in NUMBER_WORDS}))) + r")(?![\p{L}\p{N}'’])"
_UNIT_RE = rf"(?i)(\d(?:[\d.,]*\d)?|{NUMBER})( ?)(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_NUMBER_RE = r"\d+(?:[.,:/]\d+)*"


def template_words(text: Column, names: bool = True) -> Column:
    """Template words of the text, in step with :func:`plain_words`."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[-]", "")
    if names:
        t = let(t, _names_typed)
    t = F.regexp_replace(t, _SPELT_RE, NUMBER)
    t = F.regexp_replace(F.regexp_replace(t, _UNIT_RE, f"{NUMBER}$2{UNIT}"), _NUMBER_RE, NUMBER)
    return _words(t)


def _names_typed(t: Column) -> Column:
    inside = F.regexp_replace(t, _NAME_RE, NAME)

    def first(names: Column) -> Column:
        typed = F.transform(F.split(inside, _SENTENCE_RE), lambda s: F.when(
            F.array_contains(names, F.regexp_extract(s, _FIRST_RE, 2)), F.regexp_replace(s, _FIRST_RE, f"$1{NAME}")).otherwise(s))
        return F.when(F.size(names) > 0, F.array_join(typed, "")).otherwise(inside)

    return let(F.array_distinct(F.regexp_extract_all(t, F.lit(_NAME_RE), F.lit(0))), first)


def plain_words(text: Column) -> Column:
    return _words(F.regexp_replace(F.coalesce(text, F.lit("")), "[-]", ""))


def _words(t: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{M}\\p{N}\\s-]+", ""), r"\s+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """A hash per window; one for the whole if there are fewer words than a window has."""
    return let(words, _window_hashes)


def _window_hashes(ws: Column) -> Column:
    n = F.size(ws)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    return (F.when(n >= WINDOW, each).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", ws), F.lit("whole"))))
            .otherwise(F.array().cast("array<bigint>")))


def _has_slot(word: Column) -> Column:
    return word.rlike("[-]")


def plain_hashes(words: Column, lengths: list[int]) -> Column:
    """A hash per run of so many plain words; of one word only if it is the whole text."""
    def runs(ws: Column, k: int) -> Column:
        n = F.size(ws)
        each = F.transform(F.sequence(F.lit(0), n - k),
                           lambda i: F.xxhash64(F.lit("plain"), F.array_join(F.slice(ws, i + 1, F.lit(k)), " ")))
        return F.when(n >= k if k > 1 else n == 1, each).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda ws: F.concat(*[runs(ws, k) for k in lengths]))


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, ih, text): ``ih`` (a hash of the text) tells items that share an id apart."""
    return benchmark.select(F.col(item_col).alias("item_id"), F.xxhash64(F.col(text_col)).alias("ih"),
                            F.col(text_col).cast("string").alias("text")).distinct()


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, ih, kind, windows, at, hash, length) of every item: ``windows`` is the number of its windows of that
    kind, ``length`` the number of words of a plain window.

    Template kinds hold the windows with enough literal words, with names replaced and kept, if they are at least
    half of all; plain windows are taken for short items and where the template has not enough.
    """
    def enough(ws: Column) -> Column:
        def one(at: Column) -> Column:
            literal = F.size(F.filter(F.slice(ws, at + 1, F.lit(WINDOW)), lambda w: ~_has_slot(w)))
            return (literal >= LEAST_LITERAL) | (F.size(ws) < WINDOW) & (literal >= 1)
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - WINDOW, F.lit(0))), one)

    ws = benchmark_items(benchmark, item_col, text_col).select(
        "item_id", "ih", template_words(F.col("text")).alias("w0"), template_words(F.col("text"), False).alias("w1"),
        plain_words(F.col("text")).alias("w2"))
    length = F.least(F.size("w2"), F.lit(WINDOW))
    n = F.greatest(F.size("w2") - WINDOW + 1, F.lit(1))
    plain = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda i: F.xxhash64(F.lit("plain"), F.array_join(F.slice("w2", i + 1, length), " ")))
    ws = ws.where(F.size("w2") > 0).select(
        "item_id", "ih", length.alias("length"), n.alias("n"), window_hashes(F.col("w0")).alias("h0"),
        window_hashes(F.col("w1")).alias("h1"), enough(F.col("w0")).alias("e0"), enough(F.col("w1")).alias("e1"),
        plain.alias("h2"))
    held = lambda e: F.size(F.filter(e, lambda x: x))
    each = ws.select("item_id", "ih", "length", "n", held("e0").alias("n0"), held("e1").alias("n1"),
                     F.posexplode(F.arrays_zip("h0", "h1", "e0", "e1", "h2")).alias("at", "w"))
    most = lambda k: F.col(k) >= F.col("n") * LEAST_SHARE
    kinds = [(WITH_NAMES, "n0", "h0", F.col("w.e0") & most("n0")), (WITH_NAMES, "n0", "h1", F.col("w.e0") & most("n0"))]
    other = most("n1") & (F.col("n1") != F.col("n0"))
    kinds += [(OTHER_CASE, "n1", "h0", F.col("w.e0") & other), (OTHER_CASE, "n1", "h1", F.col("w.e1") & other)]
    kinds += [(PLAIN, "n", "h2", ~most("n0") | (F.col("length") < WINDOW))]
    rows = F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(k).cast("long").alias("windows"),
                                           F.col(f"w.{h}").alias("hash"))) for kind, k, h, when in kinds])
    each = each.select("item_id", "ih", "at", "length", F.explode(F.array_compact(rows)).alias("r"))
    return each.select("item_id", "ih", "r.kind", "r.windows", "at", "r.hash", "length").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, th, item_id, n_windows, item_windows): documents and the items they hold.

    ``th`` (a hash of the text) tells rows that share an id apart; ``n_windows``
    is the number of the item's windows that count.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.col(text_col).cast("string").alias("text"))
    bench = stored(benchmark_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    is_plain = F.col("kind") == PLAIN

    def found(each: DataFrame, asked: DataFrame) -> DataFrame:
        hashes = asked.select("hash").distinct()
        hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
        return (each.join(hashes, "hash").distinct().join(asked, "hash")  # repeated rows once
                .select("doc_id", "th", "pos", "item_id", "ih", "kind", "at", "windows"))

    at = rows.select("doc_id", "th", window_hashes(template_words(F.col("text"))).alias("hs"))
    # outer: for a plain explode Spark first filters by the size of the array, for which it makes all of it a second time
    hits = found(at.select("doc_id", "th", F.posexplode_outer("hs").alias("pos", "hash")), bench.where(~is_plain))
    lengths = sorted(r["length"] for r in bench.where(is_plain).select("length").distinct().collect())  # at most WINDOW
    if lengths:
        runs = rows.select("doc_id", "th", F.lit(0).alias("pos"),
                           F.explode_outer(plain_hashes(plain_words(F.col("text")), lengths)).alias("hash"))
        hits = hits.unionByName(found(runs, bench.where(is_plain)))
    hits = stored(hits, "window-hits")
    enough = F.col("n_windows") >= F.col("item_windows") * LEAST_SHARE
    pair = ["doc_id", "th", "item_id", "ih", "kind"]

    def summed(h: DataFrame) -> DataFrame:
        return (h.groupBy(*pair).agg(F.countDistinct("at").alias("n_windows"), F.max("windows").alias("item_windows"))
                .where(enough))

    likely = stored(summed(hits).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("item_id").alias("i"),
                                        F.col("ih").alias("x"), F.col("kind").alias("k")), "likely-leaks")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    this = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("ih") == F.col("x"))
    hits = hits.join(likely, same & this & (F.col("kind") == F.col("k")), "left_semi")
    # Slots: the values under the placeholders of document and item (plain windows have none).
    # Document and item meet once: a hit takes its window's slots along, the first hit of a line also the item's other
    # places; texts are shuffled as strings, words joined by a blank.
    texts = (rows.join(likely.where(F.col("k") != PLAIN).select("d", "t").distinct(), same, "left_semi").dropDuplicates(["doc_id", "th"])
             .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.array_join(template_words(F.col("text")), " ").alias("form"),
                     F.array_join(plain_words(F.col("text")), " ").alias("plain")))
    items = benchmark_items(benchmark, item_col, item_text_col).select(
        F.col("item_id").alias("i"), F.col("ih").alias("x"), plain_words(F.col("text")).alias("item_plain"),
        template_words(F.col("text")).alias("item_form"))
    window, value = [*pair, "pos", "at"], [*pair, "line", "item"]
    on_line = Window.partitionBy(*pair, "line").orderBy("pos")
    pairs = (hits.where(~is_plain).withColumn("line", F.col("pos") - F.col("at")).withColumn("nth", F.row_number().over(on_line))
             .join(texts, same).join(items, this))

    def slots_of(doc: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct(
            F.get(doc["form"], F.col("pos") + k).alias("form"), F.get("item_plain", F.col("at") + k).alias("item"),
            F.get(doc["plain"], F.col("pos") + k).alias("doc"))), lambda s: _has_slot(s["form"]))

    def beside(doc: Column, p: Column) -> Column:
        """The literal words before and after the item's word ``p`` are there in the document too, at least one."""
        sides = F.array(*[F.struct(F.get("item_form", p + k).alias("item"), F.get(doc["form"], F.col("line") + p + k).alias("doc"))
                          for k in (-1, 1)])
        return let(F.filter(sides, lambda w: w["item"].isNotNull() & ~_has_slot(w["item"])),
                   lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: w["item"].eqNullSafe(w["doc"])))

    def values_of(doc: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size("item_form") - 1), lambda p: _has_slot(F.get("item_form", p))
                          & F.get(doc["plain"], F.col("line") + p).isNotNull() & beside(doc, p))
        whole = (F.col("nth") == 1) & (F.size("item_form") == F.size("item_plain")) & (F.size(doc["form"]) == F.size(doc["plain"]))
        return F.when(whole, F.transform(places, lambda p: F.struct(
            F.get("item_plain", p).alias("item"), F.get(doc["plain"], F.col("line") + p).alias("doc"))))

    doc = F.struct(F.split("form", " ").alias("form"), F.split("plain", " ").alias("plain"))
    met = let(doc, lambda w: F.struct(slots_of(w).alias("slots"), values_of(w).alias("values")))
    met = stored(pairs.select(*window, "line", met.alias("m")).select(*window, "line", "m.*"), "met-windows")
    own = F.forall("slots", lambda s: s["item"].eqNullSafe(s["doc"]))
    slots = met.select(*window, "line", own.alias("own"), F.explode("slots").alias("s")).select(*window, "line", "own", "s.*")
    lines = met.select(*pair, "line", F.explode("values").alias("v")).select(*pair, "line", "v.*")
    # sums of an item's slots and windows, at most, in each group
    unlike = (slots.select(*value, "doc").unionByName(lines).groupBy(*value).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
              .where(F.col("least") != F.col("most")).select(*[F.col(c).alias(f"v_{c}") for c in value]))
    broken = (slots.where(~F.col("own")).join(unlike, [F.col(c).eqNullSafe(F.col(f"v_{c}")) for c in value], "left_semi")
              .select(*[F.col(c).alias(f"b_{c}") for c in window]).distinct())
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in window]
    good = summed(hits.join(broken, on, "left_anti"))
    # the best kind and text of an item id
    share = F.col("n_windows") / F.col("item_windows")
    good = (good.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct(share.alias("share"), "n_windows", "item_windows")).alias("b"))
            .select("doc_id", "th", "item_id", "b.n_windows", "b.item_windows"))
    # one result row per document row
    mult = rows.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).where("copies > 1") \
        .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "copies")
    good = good.join(mult, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return good.select("doc_id", "th", "item_id", "n_windows", "item_windows")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns (of any name).

    Null and empty texts stay; repeated rows stay or go together; an empty table
    gives an empty table, an empty benchmark leaves every row.
    """
    bad_id, bad_th = free_name(docs.columns, "__bad_id"), free_name(docs.columns, "__bad_th")
    bad = contaminated(docs, benchmark, id_col, text_col).select(
        F.col("doc_id").alias(bad_id), F.col("th").alias(bad_th)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(bad_id))
                     & (F.xxhash64(docs[text_col]) == F.col(bad_th)), "left_anti")
