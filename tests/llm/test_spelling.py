"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from annospark.llm import spelling
from annospark.llm.queries import dropped_letters


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def brute(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def groups(df):
    return sorted(tuple(r) for r in spelling.variant_groups(df).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, make_docs, seed):
    make_docs([])
    rnd = random.Random(seed)
    counts = {}
    for _ in range(250):
        w = "".join(rnd.choice("abÀÿ") for _ in range(rnd.randint(1, 7)))
        counts[w] = rnd.choice((1, 2, 3, 6, 6, 12, 30))
    counts |= {"a" * 3000: 1, "a" * 2999: 2, "a" * 1500 + "b" + "a" * 1499: 5, "\U0001F600ab": 2, "ab": 9}
    assert groups(spark.createDataFrame(list(counts.items()), "word string, n long")) == brute(counts)


def test_edges(spark, make_docs):
    make_docs([])
    assert groups(spark.createDataFrame([], "word string, n long")) == []
    rows = [("house", 5, 1), ("house", 5, 1), (None, 9, 1), ("hause", 4, 1), ("", 1, 1), ("x", 2, 1)]
    got = groups(spark.createDataFrame(rows, "word string, n long, wid int"))
    assert got == brute({"house": 10, "hause": 4, "": 1, "x": 2})


def test_query_words(spark, make_docs):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdeÉé×") for _ in range(rnd.randint(3, 8))) for _ in range(40)]
    rows = [(k, " ".join(rnd.choice(vocabulary).title() + rnd.choice(",. -1\n") for _ in range(60))) for k in range(80)]
    rows += [(5, None), (6, ""), (None, "abcdef ABCDEF abcdef"), rows[0]]
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            p = h % len(w)
            counts[w[:p] + w[p + 1:] if h % 97 == 0 else w] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    words = spelling.word_counts(dropped_letters(spelling.word_runs(make_docs(rows))))
    assert {r.word: r.n for r in words.collect()} == want
    assert groups(words) == brute(want)
