"""SentencePiece operator against the library itself."""

import random

import public_tokenizers
import sentencepiece

from annospark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁", " ", "  ", "a", "the", "ing", "\n", "é", "日本", "🙂", "\x00", "<0x41>", "</s>", "ab", "000", "﻿", "　",
       "...", "====", "    ", "ü", "İ", "\r\n", "ﬁ", "क", "<unk>"]


def test_equals_library_on_random_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as f:
        model = pieces.PieceModel(f.read())
    rnd = random.Random(3)
    parts = ODD + [p.replace("▁", " ") for p in rnd.sample(model.pieces[3:], 300)]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = model.encode(text)
        assert ids == sp.encode(text, add_eos=True)
        assert model.decode(ids) == sp.decode(ids)
    for _ in range(2000):
        ids = [rnd.randrange(32000) if rnd.random() < .5 else rnd.randrange(270) for _ in range(rnd.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids)
    long = "ab" * 20_000 + " " + "x" * 5000
    assert model.encode(long) == sp.encode(long, add_eos=True)


def test_documents(make_docs):
    docs = make_docs([(1, "one two"), (None, None), (1, "one two"), (3, ""), (4, "é\n" * 2000)])
    got = pieces.encode_documents(docs, PATH, outputs=("n_tokens", "ids", "decoded")).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids[-1] == 2
    assert [r.ids for r in got if r.doc_id is None] == [[2]]
    assert {r.decoded for r in got} == {"one two", "", "é\n" * 2000}
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0
