"""Spelling variant grouping by a trie-node pair dictionary.

Every word is a path in a forward trie (its prefixes) and in a trie of the
reversed words (its suffixes).  A node's number follows from its parent's number
and the letter: ``parent * BASE + letter + 1`` modulo the prime 2 ** 127 - 1, so
equal prefixes get equal numbers in every task, without a counter that all words
share, and a word of n letters costs n numbers however long it is.

Of each word the dictionary holds the pairs (prefix node, suffix node)

* *skip* at letter i: the nodes before and behind it, and
* *split* at place i: the two nodes that meet there.

Two words that share a skip pair differ by one replaced letter, and in no other
place; a skip pair that is another word's split pair is that word with one letter
inserted.  A letter dropped from a run of equal letters gives the same word at
each of them, so only the last of a run counts, and every near pair is found
exactly once.  The words under one pair differ in one letter: there are no more
of them than letters, however many words there are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import slices, stored

PRIME = (1 << 127) - 1
BASE = 0x5BD1E995A3F1C0DE9E3779B97F4A7C15
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INNER, LAST, SPLIT = 0, 1, 2  # skip inside a run of equal letters, skip at its end, split


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word) of every maximal run of letters of every whole text, A-Z lower-cased.

    Null and empty texts have none; repeated rows count each time.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0)))
    ascii_only = F.octet_length("word") == F.length("word")  # lower() would change letters beyond Z too
    lower = F.when(ascii_only, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER))
    return docs.select(F.col(id_col).alias("doc_id"), runs.alias("word")).select("doc_id", lower.alias("word"))


def word_counts(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least_count`` times."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def node_numbers(word: str) -> tuple[list[int], list[int]]:
    """Numbers of the prefix nodes word[:i] and of the suffix nodes word[i:], i from 0 to its length."""
    letters = [ord(c) + 1 for c in word]
    forward, backward = [0], [0]
    for c in letters:
        forward.append((forward[-1] * BASE + c) % PRIME)
    for c in reversed(letters):
        backward.append((backward[-1] * BASE + c) % PRIME)
    return forward, backward[::-1]


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, wid, kind) of (wid, word): the skip and split pairs of every word."""
    def run(batches):
        for batch in slices(batches, 2048):
            prefix, suffix, wid, kind = [], [], [], []
            for w, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, b = ([x.to_bytes(16, "big") for x in side] for side in node_numbers(word))
                n = len(word)
                prefix += f[:n] + f
                suffix += b[1:] + b
                kind += [LAST if word[k] != word[k + 1:k + 2] else INNER for k in range(n)] + [SPLIT] * (n + 1)
                wid += [w] * (2 * n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(suffix, pa.binary()),
                                              pa.array(wid, pa.int64()), pa.array(kind, pa.int8())],
                                             names=["prefix", "suffix", "wid", "kind"])

    return words.select("wid", "word").mapInArrow(run, "prefix binary, suffix binary, wid long, kind byte")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best) of (wid, word): how many words are near, and the least ``wid`` of those."""
    conf = words.sparkSession.conf
    dealt = words.repartition(int(conf.get("spark.sql.shuffle.partitions")), "wid")  # a small file, long work
    held = (node_pairs(dealt).groupBy("prefix", "suffix").agg(F.collect_list(F.struct("wid", "kind")).alias("all"))
            .where(F.size("all") > 1))
    ids = lambda test: F.transform(F.filter("all", test), lambda m: m["wid"])
    held = held.select("all", F.array_sort(ids(lambda m: m["kind"] != SPLIT)).alias("skips"),
                       F.array_min(ids(lambda m: m["kind"] == SPLIT)).alias("whole"),
                       ids(lambda m: m["kind"] == LAST).alias("longer"))
    others = F.size("skips") - 1
    first, second = F.get("skips", F.lit(0)), F.get("skips", F.lit(1))

    def of(m):
        split = m["kind"] == SPLIT
        joins = (m["kind"] == LAST) & F.col("whole").isNotNull()
        beside = F.when(m["wid"] == first, second).otherwise(first)
        return F.struct(m["wid"].alias("wid"),
                        F.when(split, F.size("longer")).otherwise(others + joins.cast("int")).alias("c"),
                        F.when(split, F.array_min("longer")).otherwise(
                            F.least(F.when(others > 0, beside), F.when(joins, F.col("whole")))).alias("best"))

    found = held.select(F.inline(F.transform("all", of))).where("c > 0")
    return found.groupBy("wid").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(wid, root) of (wid, to): the last word that ``to`` leads to, by doubling jumps."""
    step = stored(forms.select("wid", F.col("to").alias("root")), "forms")
    while True:
        jump = step.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        jumped = stored(step.join(jump, "root", "left").select("wid", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "roots")
        step = jumped.select("wid", "root")
        if jumped.where("moved").isEmpty():
            return step


def variant_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced
    code point.  ``form`` is the near word of largest n (ties: the least in
    code-point order) if that n is at least ``times`` the word's own; ``root`` is
    the last word that forms lead to, else the word.  Null words are left out,
    repeated words count as one with their counts summed, an empty table gives no
    rows; extra columns are ignored.
    """
    once = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    # ids ascend with falling n, then with the word: of near words the least id is the form
    numbered = stored(once.orderBy(F.col("n").desc(), "word").withColumn("wid", F.monotonically_increasing_id()), "words")
    near = stored(near_words(numbered).join(numbered.select("wid", "n"), "wid")
                  .join(numbered.select(F.col("wid").alias("best"), F.col("n").alias("best_n")), "best")
                  .select("wid", "n_near", F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("to")), "near")
    roots = followed(near.where("to IS NOT NULL"))
    name = lambda key, word, n: numbered.select(F.col("wid").alias(key), F.col("word").alias(word), F.col("n").alias(n))
    found = (near.join(roots, "wid", "left").join(name("to", "form", "form_n"), "to", "left")
             .join(name("root", "root_word", "root_n"), "root", "left")
             .select("wid", "form", "root_word", "n_near", "form_n"))
    return numbered.join(found, "wid", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
