"""Decontamination: planted leaks, slots, clean documents."""

from annospark.llm import decontam

ITEM = ("A train leaves Boston at 9 and drives 120 km to the small town of Salem where Anna waits for 3 hours "
        "before she takes the late bus home")


def flagged(spark, make_docs, docs, items=((1, ITEM), (2, "two words"), (3, None))):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(docs), bench).collect()
                  if r.doc_id is not None)


def test_leaks(spark, make_docs):
    again = ITEM.replace("9", "11").replace("120", "85").replace("Boston", "Denver").replace("Anna", "Maria")
    twice = "the road of 5 km and then 5 km more is the whole way for us all to go"
    broken = "the road of 7 km and then 8 km more is the whole way for us all to go"
    fine = "the road of 7 km and then 7 km more is the whole way for us all to go"
    docs = [(10, "Some words before. " + ITEM + ". And some after."), (11, ITEM.upper()), (12, again),
            (13, "nothing of the kind here, only other words that go on and on"), (14, None), (15, ""), (16, "Two words!"),
            (17, " ".join(ITEM.split()[:8])), (18, broken), (19, fine), (10, "Some words before. " + ITEM + ". And some after."),
            (20, "filler words " * 3000 + ITEM.lower())]
    got = flagged(spark, make_docs, docs, [(1, ITEM), (2, "two words"), (3, None), (4, twice)])
    assert got == [(10, 1), (10, 1), (11, 1), (12, 1), (16, 2), (19, 4), (20, 1)]


def test_empty(spark, make_docs):
    assert flagged(spark, make_docs, [(1, ITEM)], [(1, None)]) == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(make_docs([(1, ITEM)]), bench).count() == 0
    kept = decontam.remove_contaminated(make_docs([(1, ITEM), (None, None), (2, "else")]),
                                        spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_one_inconsistent_slot_keeps_the_rest(spark, make_docs):
    story = ("in the year 1999 my friend Anna went to sea and came back with a basket full of silver fish which she gave away "
             "to the poor people of the old harbour town while Anna sang about the year 1999 and its many happy summer days")
    year = story.replace("1999 and", "2001 and")
    name = story.replace("while Anna", "while Annna")
    assert year != story != name
    assert flagged(spark, make_docs, [(1, year), (2, name), (3, story)], [(1, story)]) == [(1, 1), (2, 1), (3, 1)]


def test_items_of_any_words_are_found(spark, make_docs):
    sums = "12 + 7 = 19 and 14 + 8 = 22 and 31 + 9 = 40 and 55 + 6 = 61 or 70 + 1 = 71"
    names = "we met Anna Boris Clara Dmitri Edith Fritz Greta Hanna Igor Jonas Karl Lena Maria Nils Olga Peter"
    other = ("The second text under the same number is about green apples and how they grow on old trees in the north")
    items = [(1, sums), (2, names), (3, "What is love"), (4, ITEM), (4, other), (None, ITEM), (None, other), (5, "12 34"),
             (6, "bread")]
    docs = [(10, "So it goes. " + sums + " as ever"), (11, sums.replace("12", "13").replace("8", "9").replace("1", "2")),
            (12, "Yes, " + names + "."), (13, "He asked: what is love? Nobody knew it."), (14, other), (15, ITEM), (16, "12 34"),
            (17, "Some bread and butter"), (18, "Bread"), (19, "love is what it is")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.n_windows <= r.item_windows)
                 for r in decontam.contaminated(make_docs(docs), bench).collect())
    assert got == [(10, 1, True), (12, 2, True), (13, 3, True), (14, 0, True), (14, 4, True), (15, 0, True), (15, 4, True),
                   (16, 5, True), (18, 6, True)]


def test_names_at_sentence_starts_and_spelt_numbers(spark, make_docs):
    item = "Anna has 5 apples. Anna gives 3 apples to Tom. How many apples does Anna have left?"
    again = "Zoe has 7 apples. Zoe gives 2 apples to Bob. How many apples does Zoe have left?"
    unlike = "Anna has 5 apples. Bob gives 3 apples to Tom. How many apples does Zoe have left?"
    spelt = "A tram drives at eighty km an hour along the coast. How far does it drive in four hours without a stop?"
    digits = spelt.replace("eighty", "95").replace("four", "6")
    story = "Rain fell. Nobody has apples in the north and how many trees there are is not known to us"
    docs = [(1, again), (2, unlike), (3, item), (4, item.lower()), (5, digits), (6, spelt.replace("eighty", "ninety-five")),
            (7, story), (8, "It began so. " + again)]
    got = flagged(spark, make_docs, docs, [(1, item), (2, spelt)])
    assert got == [(1, 1), (3, 1), (4, 1), (5, 2), (6, 2), (8, 1)]


def _flagged_by_loops(spark, docs, items):
    """Windows counted with plain loops over the template and plain words that Spark gives."""
    from pyspark.sql import functions as F

    def words(rows):
        df = spark.createDataFrame(rows, "id long, text string")
        return {r.id: (r.form, r.kept, r.plain) for r in df.select(
            "id", decontam.template_words(F.col("text")).alias("form"),
            decontam.template_words(F.col("text"), False).alias("kept"), decontam.plain_words(F.col("text")).alias("plain")).collect()}
    slot = lambda w: any(c in w for c in (decontam.NUMBER, decontam.NAME, decontam.UNIT))
    n, out = decontam.WINDOW, set()
    texts, asked = words(docs), words(items)
    for i, (form, _, plain) in asked.items():
        usable = [at for at in range(len(form) - n + 1) if sum(not slot(w) for w in form[at:at + n]) >= 2]
        for d, (dform, _, dplain) in texts.items():
            met, windows = {}, []
            for at in usable:
                for pos in range(len(dform) - n + 1):
                    if dform[pos:pos + n] in (form[at:at + n], asked[i][1][at:at + n]):
                        line = pos - at
                        windows.append((at, line, [plain[at + k] for k in range(n) if slot(dform[pos + k])],
                                        [dplain[pos + k] for k in range(n) if slot(dform[pos + k])]))
                        for a, b in zip(*windows[-1][2:]):
                            met.setdefault((line, a), set()).add(b)
                        for p in range(len(form)):
                            sides = [q for q in (p - 1, p + 1) if 0 <= q < len(form) and not slot(form[q])]
                            if slot(form[p]) and 0 <= line + p < len(dform) and sides and all(
                                    0 <= line + q < len(dform) and form[q] == dform[line + q] for q in sides):
                                met.setdefault((line, plain[p]), set()).add(dplain[line + p])
            good = {at for at, line, a, b in windows if a == b or all(len(met[line, v]) == 1 for v in a)}
            if len(good) >= len(usable) / 2:
                out.add((d, i))
    return sorted(out)


def test_equals_loops(spark, make_docs):
    import random

    r = random.Random(3)
    names, verbs = ["Anna", "Bob", "Zoe", "Tom"], ["gives", "takes", "sells", "finds"]

    def say(who, n):
        return " ".join(f"{who()} {r.choice(verbs)} {n()} green apples to {who()} at the market." for _ in range(3))
    any_name, any_number = (lambda: r.choice(names)), (lambda: r.choice(["3", "40", "seven", "12"]))
    items = [(k, say(any_name, any_number) + f" How many are left for {any_name()} on day {k}?") for k in range(4)]
    docs = [(100 + k, "Some words. " * (k % 3) + say(any_name, any_number) + f" How many are left for {any_name()} on day {k}?")
            for k in range(12)]
    docs += [(200 + k, t.replace("Anna", "Clara").replace("40", "41")) for k, t in items] + [(300 + k, t) for k, t in items]
    make_docs([])
    got = flagged(spark, make_docs, docs, items)
    want = _flagged_by_loops(spark, docs, items)
    assert got == want and 0 < len(want) < len(docs) * len(items)


def test_templates_are_made_once_and_texts_meet_items_once(spark, make_docs, monkeypatch):
    plans = {}

    def stored(df, name, real=decontam.stored):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(decontam, "stored", stored)
    again = ITEM.replace("9", "11").replace("120", "85").replace("Boston", "Denver").replace("Anna", "Maria")
    assert flagged(spark, make_docs, [(1, "Before it. " + again), (2, "no such words"), (None, again)], [(1, ITEM), (2, "two words")]) == [(1, 1)]
    spelt = decontam._SPELT_RE[:40]
    assert plans["window-hits"].count(spelt) == 1  # a filter by the size of the windows made the template again
    assert "met-windows" in plans
