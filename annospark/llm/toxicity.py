"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

A text is folded (lower case, look-alike letters of other scripts and digit or
sign substitutions before a letter mapped to Latin letters, everything else a space) and the
automaton finds the lexicon's entries, each anchored at a word start; entries
are whole words or word stems.  A match inside an exception phrase does not
count.  The sum of the matched weights, normalised by the length of the text,
goes through a logistic curve.

The lexicon (entries, weights, exception phrases) and the curve are learnt from
labelled rows only, on a bounded sample of them: ``max_rows`` rows, taken in
the order of a hash of the id.  Scoring uses the text alone.

Defined results: null text = empty text = the score of a text without a match;
repeated rows get the same score; very long texts are folded whole; without any
labelled row of either class the lexicon is empty and every score is the same.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.llm.common import free_name, slices

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
FOLD_CACHE = 40_000  # some ten megabytes, which a worker keeps for as long as it lives
STEMS = (4, 5, 6, 7)  # lengths of word stems that may become entries

_FULLWIDTH = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_FOLD = str.maketrans({**HOMOGLYPHS})
_LEET = str.maketrans(SUBSTITUTES)
_BEFORE_LETTER = re.compile(r"(?<![0134578@$!|])[0134578@$!|]++(?=[^\W\d_])")  # linear: each run is tried once
_OTHER = re.compile(r"[^\w ]+|[\d_]+")


def _fold_piece(piece: str) -> str:
    """The folded words of a text without white space, separated by a space."""
    t = piece.lower() if piece.isascii() else piece.translate(_FULLWIDTH).lower().translate(_FOLD)
    t = _BEFORE_LETTER.sub(lambda m: m.group().translate(_LEET), t)
    return " ".join(_OTHER.sub(" ", t).split())


class _Folded(dict):
    """Folded forms of the pieces met so far in this worker; emptied when full."""

    def __missing__(self, piece: str) -> str:
        folded = _fold_piece(piece)
        if len(piece) <= 40:
            if len(self) >= FOLD_CACHE:
                self.clear()
            self[piece] = folded
        return folded


_FOLDED = _Folded()


def fold(text: str | None) -> str:
    """Folded words, separated and surrounded by one space; '' without a word."""
    if not text:
        return ""
    t = " ".join(filter(None, map(_FOLDED.__getitem__, text.split())))
    return f" {t} " if t else ""


@dataclass
class Lexicon:
    """entries: ' word ' or ' stem' -> weight; exceptions: ' phrase ' inside which matches do not count."""
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -2.0

    def matcher(self):
        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(phrase, (phrase, None))
        for entry, weight in self.entries.items():
            automaton.add_word(entry, (entry, weight))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def evidence(self, automaton, text: str | None) -> float:
        """Sum of the matched weights over the text's length."""
        folded = fold(text)
        if not folded or not len(automaton):
            return 0.0
        found, excused = [], []
        for end, (entry, weight) in automaton.iter(folded):
            start = end - len(entry) + 1
            if weight is None:
                excused.append((start, end))
            else:
                found.append((start, end, weight))
        if excused:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in excused)]
        return normalised(sum(m[2] for m in found), folded.count(" ") - 1)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.offset))))


def normalised(total: float, words: int) -> float:
    """The total per doubling of the length: long texts need more than short ones."""
    return total / math.log2(2 + max(0, words))


def features(text: str | None) -> set[str]:
    """The words and word stems that may become entries."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        for k in STEMS:
            if len(w) > k:
                out.add(f" {w[:k]}")
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic",
                    max_rows: int = 10_000) -> DataFrame:
    """``docs`` with the label of their id, for the ``max_rows`` labelled ids that are first in hash order.

    Only ids meet labels in a shuffle; the texts meet the chosen ids (at most
    ``max_rows``, so they are broadcast) where they are.  ``labels`` has one row per id.
    """
    from annospark.llm.common import stored

    key = free_name([*docs.columns, label_col], "__id")
    ids = docs.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    known = labels.select(F.col(id_col).alias(key), label_col).where(F.col(label_col).isin(0, 1))
    chosen = ids.join(known, key).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_rows)
    chosen = stored(chosen, "toxic-ids")
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen[key]).drop(key)


def training_rows(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, label): at most ``max_rows`` labelled rows, the first in hash order of the id.

    Of rows that share the least five-word shingle hash (copies and most near
    copies) one stays, so that a copied text does not vouch for its words.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"))

    def least(batches):
        for batch in slices(batches):
            keys = []
            for text in batch.column(0).to_pylist():
                words = fold(text).split()
                grams = (" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4)))
                keys.append(min(zlib.crc32(g.encode()) for g in grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())],
                                             names=["text", "label", "least"])

    keyed = (rows.orderBy("h", "label", "text").limit(max_rows).repartition(F.col("h")).select("text", "label")
             .mapInArrow(least, "text string, label int, least long"))
    return (keyed.groupBy("least").agg(F.max_by(F.struct("text", "label"), F.struct("label", "text")).alias("r"))
            .select("r.text", "r.label"))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 10_000, min_share: float = 0.004, min_weight: float = 4.0,
          min_rows: int = 5) -> Lexicon:
    """Learn a lexicon from labelled rows (null ids and texts allowed, other labels than 0 and 1 ignored).

    An entry is a word or stem in at least ``min_share`` (and ``min_rows``) of
    the toxic sample rows whose smoothed log ratio of row shares, toxic against
    other, reaches ``min_weight`` or, in small samples, all that the sample can show.
    Without both labels, or without an entry, the lexicon is empty and calls no text toxic.
    """
    from annospark.llm.common import stored

    sample = stored(training_rows(labelled, id_col, text_col, label_col, max_rows), "toxic-sample")
    totals = dict(sample.groupBy("label").count().collect())
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Lexicon()

    def tally(batches):
        """(feature, label, rows) of a partition of the bounded sample."""
        seen: Counter = Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((f, label) for f in features(text))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()),
                                          pa.array([y for _, y in seen], pa.int32()),
                                          pa.array(list(seen.values()), pa.int64())], names=["feature", "label", "n"])

    need = max(min_rows, min_share * n1)
    counts = (sample.mapInArrow(tally, "feature string, label int, n long").groupBy("feature")
              .agg(F.sum(F.col("label") * F.col("n")).alias("a"), F.sum((1 - F.col("label")) * F.col("n")).alias("b"))
              .where(F.col("a") >= need))  # at most (features of a row) / min_share rows
    floor = min(min_weight, 0.6 * math.log(2 * (n0 + 1)))
    weight = {r["feature"]: (r["a"], math.log((r["a"] + .5) / (n1 + 1)) - math.log((r["b"] + .5) / (n0 + 1)))
              for r in counts.collect()}
    strong = {f: aw for f, aw in weight.items() if aw[1] >= floor}
    entries: dict[str, float] = {}
    for f in sorted(strong, key=lambda f: (len(f.rstrip()), f)):
        if any(f.startswith(e) for e in entries):
            continue
        best = f
        while True:  # the longest form that keeps nearly all of the support
            longer = [g for g in strong if g != best and g.startswith(best) and strong[g][0] >= 0.9 * strong[best][0]]
            if not longer:
                break
            best = max(longer, key=lambda g: (strong[g][0], len(g), g))
        entries[best] = strong[best][1]
    lexicon = Lexicon(entries)
    if not entries:
        return lexicon  # without evidence there is no curve to fit: every text scores as one without matches

    matcher_of = lexicon.matcher

    def phrases(batches):
        """Two-word phrases around matches, with the label."""
        automaton = matcher_of()
        for batch in slices(batches):
            out, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, seen = fold(text), set()
                for end, (entry, _) in automaton.iter(folded) if folded and len(automaton) else ():
                    start = end - len(entry) + 1
                    before = folded.rfind(" ", 0, start)
                    stop = folded.find(" ", start + 1)
                    after = folded.find(" ", stop + 1)
                    if before >= 0:
                        seen.add(folded[before:stop + 1])
                    if after > 0:
                        seen.add(folded[start:after + 1])
                out.extend(seen)
                labels.extend([label] * len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int32())],
                                             names=["phrase", "label"])

    benign = (sample.mapInArrow(phrases, "phrase string, label int").groupBy("phrase")
              .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
              .where((F.col("b") >= max(3, min_share * n0)) & (F.col("a") * n0 < 0.2 * F.col("b") * n1)))
    lexicon.exceptions = tuple(sorted(r["phrase"] for r in benign.collect()))  # at most 2 / min_share each row

    def evidence(batches):
        automaton = lexicon.matcher()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lexicon.evidence(automaton, t) for t in batch.column(0).to_pylist()], pa.float64()),
                 batch.column(1)], names=["x", "label"])

    # one row per sample row: bounded by max_rows
    xy = np.array(sorted(tuple(r) for r in sample.mapInArrow(evidence, "x double, label int").collect()))
    lexicon.slope, lexicon.offset = fit_curve(xy[:, 0], xy[:, 1])
    return lexicon


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> tuple[float, float]:
    """Logistic curve by damped Newton steps; the classes weigh the same; a small penalty keeps it finite."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    design = np.column_stack([x, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (p - y)) + ridge * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_documents(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                    out: str = "score") -> DataFrame:
    """``keep`` columns (of any name) and ``out``: the toxicity score (0 to 1) of every whole text.

    A null text scores as an empty one; one row for every row; an empty table gives an empty table.
    """
    src = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(free_name([*keep, out], "__text")))
    n = len(keep)
    schema = T.StructType([src.schema[i] for i in range(n)] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        automaton = lexicon.matcher()
        for batch in slices(batches):
            scores = [lexicon.score(lexicon.evidence(automaton, t)) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [pa.array(scores, pa.float64())],
                                             names=[f.name for f in schema])

    return src.mapInArrow(run, schema)
