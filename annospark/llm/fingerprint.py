"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Byte triplets of a window of four bytes are hashed (tabulation hashing with
seeded tables) into 128 buckets and counted; each bucket is then encoded in two
bits by the quartile its count falls in, after a length code and the two
quartile ratios.  Two digests are compared by a bounded difference score, given
as a likeness from 0 to 1.

Defined results: the empty (or null) text has a digest of its own, with all
buckets in the lowest quartile; equal texts have equal digests; long texts are
read whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import ranged, slices

BUCKETS = 128
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # byte places in the window of four
MOST = 400  # differences from here on count as no likeness
_TABLES = np.random.RandomState(20).randint(0, BUCKETS, (len(TRIPLETS), 3, 256)).astype(np.uint8)


def counts(data: bytes) -> np.ndarray:
    """Bucket counts of the byte triplets."""
    x = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for places, tables in zip(TRIPLETS, _TABLES):
        n = len(x) - places[-1]
        if n > 0:
            a, b, c = (tables[k][x[p:p + n]] for k, p in enumerate(places))
            total += np.bincount(a ^ b ^ c, minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    """68 hex digits: length code (2), quartile ratios (1 + 1), bucket quartiles (64)."""
    data = (text or "").encode()
    c = counts(data)
    q1, q2, q3 = (int(v) for v in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = (code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]).astype(np.uint8)
    length = min(255, int(math.log(len(data)) / math.log(1.1))) if data else 0
    ratio = [min(15, 16 * q // q3) if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratio[0]:x}{ratio[1]:x}{packed.tobytes().hex()}"


def _codes(digest: str) -> np.ndarray:
    p = np.frombuffer(bytes.fromhex(digest[4:]), np.uint8)
    return np.stack([p >> 6, p >> 4 & 3, p >> 2 & 3, p & 3], axis=1).ravel().astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0: bucket quartile distances (opposite quartiles count
    double), differences of the length code beyond one step and of the quartile ratios."""
    d = np.abs(_codes(a) - _codes(b))
    total = int(d.sum()) + 3 * int((d == 3).sum())
    total += max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1)
    total += sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))
    return 1.0 - min(MOST, total) / MOST


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see :func:`edited_text`), and their likeness.

    The following document is the next one by id (rows with equal ids by
    text; null ids first); after the last comes the first.  Ids are dealt in
    ranges; each range also gets the first row of the next range, so no task
    needs more than its own range and one row.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, n = ranged(src, "id")
    # Of each range the first row: one row per range.
    heads = rows.groupBy("__range").agg(F.min(F.struct("id", "text")).alias("head"))
    at = sorted(r[0] for r in rows.select("__range").distinct().collect())  # range numbers only
    before = docs.sparkSession.createDataFrame([(at[k], at[k - 1]) for k in range(len(at))], "__range int, to int")
    sent = heads.join(before, "__range").select(F.col("to").alias("__range"), F.lit(1).alias("after"),
                                                "head.id", "head.text")
    both = rows.select("__range", F.lit(0).alias("after"), "id", "text").unionByName(sent)
    parts = max(n // 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.repartition(parts, "__range").sortWithinPartitions("__range", "after", "id", "text")

    def run(batches):
        held = None  # (range, id, text, digest) of the row before
        memo: tuple[str, str] = ("", fingerprint(""))
        for batch in slices(batches):
            out = []
            for at_, after, i, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                digest = memo[1] if text == memo[0] else fingerprint(text)
                memo = (text, digest)
                if held is not None and held[0] == at_:
                    _, held_id, held_text, held_digest = held
                    edited = edited_text(held_text, text)
                    of_edited = fingerprint(edited)
                    out.append((held_id, len(held_text), hashlib.sha256(edited.encode()).hexdigest(), held_digest,
                                of_edited, likeness(held_digest, of_edited), likeness(held_digest, digest)))
                held = None if after else (at_, i, text, digest)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                                pa.string(), pa.float64(), pa.float64()))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])

    return both.mapInArrow(run, SCHEMA)
