"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

Method.  In a merge-based tokenizer every prefix of a text has one encoding,
and the encoding of the whole is a chain of tokens in which each neighbouring
pair is compatible: the merges of ``left + right`` taken alone never cross the
border.  So it is enough to store, for each prefix, its unique last token:
the vocabulary automaton yields the pieces that end at a position, and the one
whose left neighbour (the last token of the prefix before it) is compatible is
the last token.  Ids are then recovered backwards from the end.

No piece of such a vocabulary continues with a space mark after another
character, so merges never cross the start of a run of spaces and the table is
built per run-plus-word unit.  Units repeat, so each Python worker keeps a
bounded table unit -> ids.

Defined results: null text = empty text = the end id alone; characters outside
the vocabulary become their UTF-8 byte pieces; very long texts are encoded
whole (time is linear in the length).
"""

from __future__ import annotations

import codecs
import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annospark.llm.common import free_name, slices

SPACE = "▁"
UNIT_CACHE = 250_000   # units kept per worker; the table is emptied when it is full
PAIR_CACHE = 400_000
CACHED_LEN = 48        # longer units are encoded each time


def _each_byte(err: UnicodeDecodeError):
    """An invalid byte decodes to one replacement character each."""
    return "�" * (err.end - err.start), err.end


codecs.register_error("annospark_each_byte", _each_byte)


class Automaton:
    """Aho-Corasick automaton whose transitions over fallback links are filled in as they are used.

    ``after[state]`` maps a character to the next state (ask :meth:`step` when
    it has none); ``ending[state]`` lists (id, size) of the pieces that end
    there, longest first.
    """

    def __init__(self, pieces: dict[str, int]):
        self.after: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for piece, i in pieces.items():
            state = 0
            for c in piece:
                if c not in self.after[state]:
                    self.after[state][c] = len(self.after)
                    self.after.append({})
                state = self.after[state][c]
            own[state] = (i, len(piece))
        self.fall = [0] * len(self.after)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.after)
        level = [(0, dict(self.after[0]))]
        while level:  # breadth first: shorter suffixes are complete before longer ones need them
            deeper = []
            for parent, children in level:
                for c, state in children.items():
                    if parent:
                        self.fall[state] = self.step(self.fall[parent], c)
                    here = (own[state],) if state in own else ()
                    self.ending[state] = here + self.ending[self.fall[state]]
                    deeper.append((state, dict(self.after[state])))
            level = deeper

    def step(self, state: int, c: str) -> int:
        go = self.after[state].get(c)
        if go is None:
            go = self.step(self.fall[state], c) if state else 0
            if state:
                self.after[state][c] = go
        return go


class _Units(dict):
    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = tuple(self.model.encode_unit(unit))
        if len(unit) <= CACHED_LEN:
            self[unit] = ids
        return ids


class PieceModel:
    """Vocabulary, automaton and tables made from the bytes of a SentencePiece BPE model."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not spec.trainer_spec.byte_fallback \
                or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.eos = sp.eos_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        bytes_of = {i: b for b, i in self.byte_id.items()}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in bytes_of}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("pieces that span words are not supported")
        # a piece that its own merges do not yield can never be a last token
        self.automaton = Automaton({p: i for p, i in self.id_of.items() if self._greedy(p) == [p]})
        merging = sorted({c for p in self.id_of if len(p) > 1 for c in p} - {SPACE})
        inside = "".join(map(re.escape, merging))
        self.unit_re = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]")
        self.pairs: dict[int, bool] = {}
        self.units = _Units(self)
        self.raw = [b"" if i in special else bytes([bytes_of[i]]) if i in bytes_of
                    else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for i in special:
            if sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        self.control = {i for i in special if sp.is_control(i)}
        self.decimal = [str(i) for i in range(n)]

    def _greedy(self, text: str) -> list[str]:
        """Merges of a short text: best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both pieces, side by side, never cross the border."""
        key = left * len(self.pieces) + right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            ok = self.pairs[key] = self._greedy(a + b) == [a, b]
        return ok

    def encode_unit(self, unit: str) -> list[int]:
        n = len(unit)
        token = [-1] * (n + 1)      # the last token of each prefix; -1: a character outside the vocabulary
        begin = list(range(-1, n))  # where that token begins
        pairs, n_ids = self.pairs, len(self.pieces)
        after, step, ending = self.automaton.after, self.automaton.step, self.automaton.ending
        state = end = 0
        for c in unit:
            end += 1
            go = after[state].get(c)
            state = step(state, c) if go is None else go
            for i, size in ending[state]:
                left = token[end - size]
                if left >= 0:
                    ok = pairs.get(left * n_ids + i)
                    if ok is None:
                        ok = self.compatible(left, i)
                    if not ok:
                        continue
                token[end] = i
                begin[end] = end - size
                break
        out: list[int] = []
        end = n
        while end:
            i = token[end]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(unit[end - 1].encode()))
                end -= 1
            else:
                out.append(i)
                end = begin[end]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """All ids of the text, then the end id."""
        ids: list[int] = []
        if text:
            if len(self.units) >= UNIT_CACHE:
                self.units.clear()
            units = self.unit_re.findall((SPACE + text).replace(" ", SPACE))
            ids = list(chain.from_iterable(map(self.units.__getitem__, units)))
        ids.append(self.eos)
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "annospark_each_byte")
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            text = text[1:]  # the dummy prefix
        return text


_MODELS: dict[bytes, PieceModel] = {}


def model_of(proto: bytes) -> PieceModel:
    """One model per Python worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_documents(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "decoded"),
                     keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``outputs`` names the columns to add: ``ids`` (with the end id),
    ``decoded`` (the text decoded from the ids), ``n_tokens``, and the digests
    ``ids_sha256`` / ``decoded_sha256`` (hex; of the decimal ids joined by a
    space, and of the decoded text).  ``keep`` columns pass through.  The
    model file (under a megabyte) is read once and sent to the executors.

    Null or empty text gives the end id alone and an empty decoded text; an
    empty table gives an empty table; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    src = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(free_name([*keep, *outputs], "__text")))
    schema = T.StructType([src.schema[i] for i in range(len(keep))]
                          + [T.StructField(o, OUTPUTS[o]) for o in outputs])
    n_keep = len(keep)

    def run(batches):
        model = model_of(proto.value)
        for batch in slices(batches):
            cols: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(n_keep).to_pylist():
                ids = model.encode(text)
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(ids))
                if "ids" in cols:
                    cols["ids"].append(ids)
                if "ids_sha256" in cols:
                    joined = " ".join(map(model.decimal.__getitem__, ids))
                    cols["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                if "decoded" in cols or "decoded_sha256" in cols:
                    decoded = model.decode(ids)
                    if "decoded" in cols:
                        cols["decoded"].append(decoded)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            arrays = [batch.column(k) for k in range(n_keep)] \
                + [pa.array(cols[o], types.get(o, pa.string())) for o in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return src.mapInArrow(run, schema)
