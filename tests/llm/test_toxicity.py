"""Toxicity: folding, exceptions, learning and held-out accuracy."""

import random

from annospark.llm import toxicity


def test_fold():
    assert toxicity.fold("You 1D10T, stуp1d tra$h!! ａｂ") == " you idiot stypid trash ab "
    assert toxicity.fold(None) == toxicity.fold("  12 !") == ""


def test_exceptions_and_length():
    lex = toxicity.Lexicon({" trash ": 5.0, " moron": 5.0}, exceptions=(" trash can ",))
    m = lex.matcher()
    assert lex.evidence(m, "the trash can is full") == 0
    assert lex.evidence(m, "you trash") > lex.evidence(m, "you trash " + "word " * 500) > 0
    assert lex.evidence(m, "morons") > 0 and lex.evidence(m, "oxymoron") == 0
    assert lex.evidence(m, None) == lex.evidence(m, "") == 0


def test_learns_and_scores(make_docs, spark):
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("ban", "tol", "ser", "min") for b in ("ar", "eno", "ist", "um", "ola")]
    bad = ["idiot", "worthless", "scum"]
    rows = []
    for k in range(600):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 80))]
        toxic = k % 5 == 0
        if toxic:
            for w in rnd.sample(bad, 2):
                text.insert(rnd.randrange(len(text)), w if k % 10 else w.replace("i", "1").upper())
        rows.append((k, " ".join(text), int(toxic)))
    labelled = make_docs([r for r in rows if r[0] % 3], "doc_id long, text string, toxic int")
    lex = toxicity.learn(labelled)
    assert {" idiot ", " scum "} <= set(lex.entries)
    held = make_docs([r for r in rows if not r[0] % 3] + [(None, None, 0), (-1, "", 0)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_documents(held, lex).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all((got[i] >= .5) == bool(truth[i]) for i in got if i is not None and i >= 0)
    assert got[None] == got[-1] < .5
    assert toxicity.learn(labelled.limit(0)).entries == {}


def test_labelled_sample_is_the_first_ids_in_hash_order(make_docs):
    docs = make_docs([(k, f"text {k}") for k in range(40)] + [(3, "again"), (None, "no id")], "doc_id long, text string")
    labels = make_docs([(k, k % 3) for k in range(2, 60)] + [(70, None)], "doc_id long, toxic int")
    every = toxicity.labelled_sample(docs, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in every) == sorted([(k, k % 3) for k in range(2, 40) if k % 3 < 2] + [(3, 0)])
    few = {r.doc_id for r in toxicity.labelled_sample(docs, labels, max_rows=5).collect()}
    assert len(few) == 5 and few == {r.doc_id for r in toxicity.labelled_sample(docs, labels, max_rows=5).collect()}
    assert toxicity.labelled_sample(docs.limit(0), labels).count() == 0


def test_a_task_holds_few_texts_at_once(spark):
    """A batch lies whole in a worker: with large ones, texts and caches took an executor beyond its memory."""
    from annospark.llm.common import BATCH_ROWS, prepare

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("64", "64")):  # 0: no bound
            spark.conf.set(name, given)
            prepare(spark)
            assert spark.conf.get(name) == want
        spark.conf.set(name, "10000")
        prepare(spark)
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: bs, "id long").count()
        most = spark.range(0, 5000, 1, 1).mapInPandas(
            lambda frames: (f.assign(id=len(f)).head(1) for f in frames), "id long").agg({"id": "max"}).first()[0]
        assert sizes == 5000 and most <= BATCH_ROWS
    finally:
        spark.conf.set(name, before)
    for k in range(toxicity.FOLD_CACHE + 10):
        toxicity.fold(f"w{k}x")
    assert len(toxicity._FOLDED) <= toxicity.FOLD_CACHE <= 50_000
