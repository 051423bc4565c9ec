"""Stages of the pipeline: one row of each group stays, clean documents stay, edges have defined results."""

import pytest

import corpus_pipeline

CLASHING = ("__toxicity", "__text", "__id", "__th", "__every", "__bad_id", "__bad_th", "__toxic", "n_windows", "sid")
ITEM = "Which of the seven long rivers of the old northern plain runs past the ruined tower and the silent mill?"
CLEAN = "A quiet walk along the harbour wall in the evening brought nothing new to see that day."
TOXIC = "you worthless idiot you stupid scum nobody wants you here"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables that the stages read beside their documents."""
    root = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 2)) for k in range(100, 160)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def with_training(rows):
    """The rows, and labelled rows (odd ids toxic) of words of their own, from which the lexicon is learnt."""
    def text(k):
        own = " ".join(f"{a}{chr(97 + k % 26)}{b}{chr(97 + k // 5 % 26)}" for a in ("mo", "te", "sur") for b in ("la", "pe", "ki"))
        return f"{own} worthless idiot {own[::-1]}" if k % 2 else f"{own} gentle river {own[::-1]}"
    return rows + [(k, text(k)) for k in range(100, 160)]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_edges_of_every_stage(spark, make_docs, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = with_training([(1, CLEAN), (None, None), (2, ""), (2, ""), (None, CLEAN + " Or so they say, but who would know."),
                          (3, TOXIC), (3, TOXIC), (4, f"Before it. {ITEM} After it."), (5, "word " * 50_000)])
    docs = make_docs(rows).selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(CLASHING)])
    got = stage(spark, docs, tables)
    found = got.collect()
    ids = [r.doc_id for r in found]
    if name == "sentencepiece":
        assert len(found) == len(rows) and sorted(r.n_tokens for r in found)[:3] == [1, 1, 1]
    else:
        assert got.columns == docs.columns
        assert all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in found)
        assert ids.count(2) == 2 and ids.count(1) == 1 and ids.count(5) == 1 and ids.count(None) == 2
        assert ids.count(3) == {"toxicity": 0, "jaccard_join": 1, "decontamination": 2}[name]
        assert ids.count(4) == (name != "decontamination")
    nothing = stage(spark, docs.where("false"), tables)
    assert nothing.columns == got.columns and nothing.count() == 0


def test_no_toxic_words_to_learn_drops_nothing(spark, make_docs, tables):
    docs = make_docs([(k, CLEAN) for k in range(100, 160)])
    assert corpus_pipeline.drop_toxic(spark, docs, tables).count() == 60


def test_near_copies_stage(spark, make_docs):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (1, base + " end"), (2, "something else altogether in this one here"), (4, None), (5, ""), (5, ""),
            (7, base), (7, base)]
    docs = make_docs(rows)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5, 5]


def test_unlinked_rows_with_null_or_repeated_ids_stay(spark, make_docs):
    texts = ["the first clean text of its own here", "another one that shares nothing with it", "some third story told by no one else",
             "and the last which is far from all"]
    got = corpus_pipeline.drop_near_copies(spark, make_docs([(None, texts[0]), (None, texts[1]), (8, texts[2]), (8, texts[3]),
                                                             (8, texts[3])]), "")
    assert sorted(r.text for r in got.collect()) == sorted(texts)
