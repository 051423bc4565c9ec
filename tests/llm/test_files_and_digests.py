"""Token files and fingerprints against plain loops."""

import hashlib
import struct
import zlib

import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from annospark.llm import fingerprint, token_files
from annospark.llm.queries import tokenizer_path

ROWS = [(5, "Hello world, it's 42!"), (2, None), (9, "naïve café\ttab\r\nline  "), (3, ""), (7, "x" * 3000),
        (8, "Σίσυφος ΣΑΣ <|endoftext|> ok"), (6, "the same"), (4, "the same")]


def test_token_files(make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = token_files.write_token_files(make_docs(ROWS), path, 1)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files).collect()}
    start = 0
    for i, t in sorted(ROWS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    reader = token_files.FrameReader(files.first()["uri"])
    assert reader.ids == sorted(i for i, _ in ROWS)
    assert list(reader.document(len(reader) - 1))[-1] == 1
    raw = open(files.first()["uri"].removeprefix("file:"), "rb").read()  # any zstandard reader skips the tables
    assert len(b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).readall()
                        for _ in (0,))) == 4 * start
    empty = token_files.write_token_files(make_docs(ROWS).limit(0), path, 1)
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0


def test_fingerprints(make_docs):
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(make_docs(ROWS)).collect()}
    order = sorted(ROWS)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following))
    assert got[6].fingerprint == got[4].fingerprint and fingerprint.likeness(got[4].fingerprint, got[6].fingerprint) == 1
    assert fingerprint.fingerprint_pairs(make_docs(ROWS).limit(0)).count() == 0
    one = fingerprint.fingerprint_pairs(make_docs([(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_counts_by_loop():
    data = b"the quick brown fox"
    want = [0] * fingerprint.BUCKETS
    for places, tables in zip(fingerprint.TRIPLETS, fingerprint._TABLES):
        for at in range(len(data) - places[-1]):
            a, b, c = (int(tables[k][data[at + p]]) for k, p in enumerate(places))
            want[a ^ b ^ c] += 1
    assert list(fingerprint.counts(data)) == want


def test_words_one_by_one_equal_the_whole_text():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from annospark.llm import token_files
    from annospark.llm.queries import tokenizer_path
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encoder, library = token_files.WordEncoder(spec), Tokenizer.from_str(spec)
    rnd = random.Random(2)
    parts = ["'s", "'S", "'re", "'", "''ll", "don't", "Été", "Àß", "ÿ", "×", "÷", "µ", "ª", "½", "12", "3", "_", "--", ".", "…", "İ", "ǆ",
             "é", "́", "<|endoftext|>", "<|", "|>", "naïve", "Straße", "ŒUVRE", "日本", "\U0001F600", "\x85", " ", "A", "b", " ", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_batch_does_not_go_through_the_whole_word_table():
    class Counted(dict):
        walks = 0

        def keys(self):
            Counted.walks += 1
            return super().keys()

        def __iter__(self):
            Counted.walks += 1
            return super().__iter__()

    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    encoder.known = Counted()
    first = encoder.encode_all(["some words", "more  words", "", None])
    assert encoder.encode_all(["more  words", "other words", "some words"])[::2] == [first[1], first[0]] and first[2:] == [b"", b""]
    assert Counted.walks == 0


def test_a_repeated_word_is_looked_up_once_for_a_batch():
    import numpy as np
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encoder, library = token_files.WordEncoder(spec), Tokenizer.from_str(spec)
    encoder.known = Counted()
    texts = ["It's a word. " * 300, "a word.\x0bIt's\x0c\u0085<|endoftext|>", None, " another word,\r\n" * 300, ""]
    for _ in range(2):
        Counted.asked = 0
        for text, ids in zip(texts, encoder.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        assert Counted.asked < 10
