"""Multi-index hashing against all inner products."""

import math

import numpy as np
import pytest

from annospark.llm import hamming


def brute(rows, k, asks):
    """(query id, its rows' (score, id)) over (id, vector) rows."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, [np.float64(x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is None or not asks(q):
            continue
        scored = []
        for other, (i, w) in enumerate(rows):
            if other != at:
                s = np.float64(0)
                for a, b in zip(w, v):
                    s += a * b
                scored.append((-s, i is None, i or 0, i))
        scored.sort()
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], r[3], str(r[2])))


def searched(df, k=20):
    from pyspark.sql import functions as F
    got = hamming.nearest(df, F.col("vec_id") % 20 == 0, k)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1], r[3], str(r[2])))


SCHEMA = "vec_id long, embedding array<float>, vh long, ids string, path int"


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    code = np.concatenate([rng.integers(0, 1 << 16, (400, 8)).astype(np.uint16), np.zeros((9, 8), np.uint16)])
    index = hamming.BlockIndex(code)
    for radius in (0, 1, 7, 8, 20, 45, 57, 128):
        for query in (code[5], code[-1], rng.integers(0, 1 << 16, 8).astype(np.uint16)):
            far = np.bitwise_count(code ^ query).sum(axis=1)
            rows, distance = index.within(query, radius)
            assert rows.tolist() == np.flatnonzero(far <= radius).tolist()
            assert distance.tolist() == far[rows].tolist()


def test_recall(spark, make_docs):
    make_docs([])
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    want = {r[:1] + r[2:3]: r[3] for r in brute(rows, 20, lambda q: q % 20 == 0)}
    got = searched(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    assert len(got) == len(want) and {r[1] for r in got} == set(range(1, 21))
    assert sum((r[0], r[2]) in want for r in got) >= 0.9 * len(want)
    assert all(want.get((r[0], r[2]), r[3]) == r[3] for r in got)


@pytest.mark.parametrize("n", [0, 1, 12, 90])
def test_edges(spark, make_docs, n):
    """Ties, copies of vectors and of rows, null ids, unusable vectors; few candidates are returned whole."""
    make_docs([])
    rng = np.random.default_rng(n)
    rows = [(k, [float(x) for x in rng.integers(-1, 3, 6)]) for k in range(n)]
    if n > 1:
        rows += [(20, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0])] * 2 + [(None, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0])] * 3 + [(40, rows[0][1]), (None, [5.0] * 6)]
        rows += [(200 + k, [1.0] * 6) for k in range(60)]
    bad = [(60, None), (80, [0.0] * 6), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (120, [math.nan] * 6), (140, [math.inf] * 6), (160, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + bad], SCHEMA)
    want = brute(rows, 20, lambda q: q % 20 == 0)
    got = searched(df)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    if n == 12:
        assert got == want
    assert sum(a[2:] == b[2:] for a, b in zip(got, want)) >= 0.9 * len(want)
