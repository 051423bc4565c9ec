"""Token-id files: independent zstandard frames with a trailing seek table and checksums.

File format (little-endian).  One zstandard frame per document holds its ids
as unsigned 32-bit integers; then a skippable frame (0x184D2A50) lists the
documents' ids in frame order (a byte 1 if the id is null, else 0, and a signed
64-bit id each); then the seek table of the zstandard seekable format: a
skippable frame (0x184D2A5E) with, per frame, compressed size, plain size and
the low 32 bits of the plain bytes' XXH64, and a footer (frame count, flags,
0x8F92EAB1).  A reader decompresses only the frames it wants.

Tasks write under a name of their own and rename when done, so a repeated or
speculative task leaves one whole file per range.

Defined results: null text = empty text = the end id alone; an empty table
gives no files; repeated rows are written each.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import open_fs, ranged, scratch_path, slices

# Fixed values of the zstandard seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
WORD_CACHE = 1_000_000
WORDS_AT_ONCE = 200
LEVEL = 3


class WordEncoder:
    """Encodes with the tokenizers library, one white-space separated word at a time.

    For tokenizers that drop white space (no token spans it) this gives the
    same ids as the whole text; the ids of the words met are kept in a bounded
    table, one word after the other in ``pool``.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.known: dict[str, int] = {}  # the word's number
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)  # by number

    def learn(self, new: list[str]) -> None:
        """Add the ids of distinct words that are not in the table; they are numbered in their order."""
        # as the parts of split texts: each is encoded alone, without a result object of its own
        parts = [new[k:k + WORDS_AT_ONCE] for k in range(0, len(new), WORDS_AT_ONCE)]
        for words, e in zip(parts, self.tokenizer.encode_batch(parts, is_pretokenized=True, add_special_tokens=False)):
            ids, first = np.array(e.ids, np.uint32), len(self.known)
            length = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
            self.pool = _grown(self.pool, self.used + len(ids))
            self.start, self.length = (_grown(v, first + len(words)) for v in (self.start, self.length))
            self.pool[self.used:self.used + len(ids)] = ids
            self.length[first:first + len(words)] = length
            self.start[first:first + len(words)] = self.used + np.cumsum(length) - length
            self.used += len(ids)
            self.known.update(zip(words, range(first, first + len(words))))

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
            self.used = 0
        split = pc.ascii_split_whitespace(texts)  # blank, tab and line ends: all of them are white space to any tokenizer
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.learn([distinct[k] for k in new.tolist()])
        number = number[words.indices.to_numpy()]
        length = self.length[number]
        last = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[number] - last[:-1], length) + np.arange(last[-1])].astype("<u4", copy=False).tobytes()
        cut = last[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())])] * 4
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _grown(v: np.ndarray, n: int) -> np.ndarray:
    """The same array with room for at least ``n`` entries."""
    return v if n <= len(v) else np.concatenate([v, np.empty(max(n, 2 * len(v)) - len(v), v.dtype)])


_ENCODERS: dict[bytes, WordEncoder] = {}


def encoder_of(spec: str) -> WordEncoder:
    """One encoder per Python worker, whose tables serve all its tasks."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def encode_frames(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(range, id, n_tokens, check, frame) per row of (range, id, text)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 2 MB
    end = struct.pack("<I", end_id)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, press = encoder_of(spec.value), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for batch in slices(batches, 1024):
            plain = [ids + end for ids in encoder.encode_all(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(p) // 4 for p in plain], pa.int64()),
                 pa.array([xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in plain], pa.int64()),
                 pa.array([press.compress(p) for p in plain], pa.binary())], names=["range", "id", "n_tokens", "check", "frame"])

    return docs.mapInArrow(run, "range int, id long, n_tokens long, check long, frame binary")


class FrameWriter:
    """Writes one file; close() appends the index and the seek table."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.ids: list[int | None] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, frame: bytes, plain_size: int, check: int) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries.append((len(frame), plain_size, check))

    def close(self) -> None:
        index = b"".join(struct.pack("<Bq", i is None, i or 0) for i in self.ids)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:
            self.fs.delete_file(self.temp)  # another attempt's whole file is there
            if self.fs.get_file_info(self.path).size < 0:
                raise


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"no seek table in {uri}")
        table = self._at(size - 9 - 12 * n - 8, 8 + 12 * n)
        if struct.unpack_from("<I", table)[0] != TABLE_MAGIC:
            raise ValueError(f"broken seek table in {uri}")
        self.entries = np.frombuffer(table, "<u4", offset=8).reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        index = self._at(int(self.starts[-1]) + 8, 9 * n)
        self.ids = [None if null else i for null, i in struct.iter_unpack("<Bq", index)]
        self.unpress = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.entries)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        size, plain_size, check = (int(v) for v in self.entries[k])
        plain = self.unpress.decompress(self._at(int(self.starts[k]), size), max_output_size=plain_size)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of document {self.ids[k]} differs")
        return np.frombuffer(plain, "<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write files in ascending id order (null ids first).

    Returns the file list (range, uri, n_docs, n_tokens, start), ``start``
    being the ids in all files before; it has one row per file.  The files
    are under ``uri`` (by default a fresh folder in the shared checkpoint
    folder).
    """
    spark = docs.sparkSession
    folder = uri or scratch_path(spark, "token-files")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    rows, n = ranged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")),
                     "id", rows_per_range=8000)
    frames = encode_frames(rows.select(F.col("__range").alias("range"), "id", "text"), tokenizer_path, end_id)
    parts = max(n // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = frames.repartition(parts, "range").sortWithinPartitions("range", "id", "check", "frame")

    def write(batches):
        writer, at, docs_, tokens = None, None, 0, 0
        done = []
        for batch in slices(batches):
            for r, i, n_tokens, check, frame in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if r != at:
                    if writer:
                        writer.close()
                        done.append((at, f"{folder}/ids-{at:06d}.zst", docs_, tokens))
                    writer, at, docs_, tokens = FrameWriter(f"{folder}/ids-{r:06d}.zst"), r, 0, 0
                writer.add(i, frame, 4 * n_tokens, check)
                docs_, tokens = docs_ + 1, tokens + n_tokens
        if writer:
            writer.close()
            done.append((at, f"{folder}/ids-{at:06d}.zst", docs_, tokens))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["range", "uri", "n_docs", "n_tokens"])

    files = sorted(tuple(r) for r in dealt.mapInArrow(
        write, "range int, uri string, n_docs long, n_tokens long").collect())  # one row per file
    out, start = [], 0
    for r, u, nd, nt in files:
        out.append((r, u, nd, nt, start))
        start += nt
    return spark.createDataFrame(out, "range int, uri string, n_docs long, n_tokens long, start long")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a file list."""
    rows = files.select("uri", "start").repartition(max(1, files.count()), "uri")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, out = FrameReader(uri), []
                for k in range(len(reader)):
                    ids = reader.document(k)
                    out.append((reader.ids[k], start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, schema)
