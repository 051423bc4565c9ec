"""Inputs of several passes are computed once (each pass over them used to run all joins behind them again)."""

from pyspark.sql import functions as F

from annospark.operators import metrics, models, selection


def counted(df):
    """``df`` and the number of its rows that were computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema), seen


def test_entities_with_truth(spark):
    rows = [(1, "a", 0.9, 1, 2.0, "BP"), (1, "b", 0.8, 0, 1.0, "BP"), (1, "c", 0.7, 0, 1.0, "BP"), (2, "b", 0.0, 1, 0.0, "BP"),
            (3, "a", 0.9, 0, 2.0, "BP"), (None, "a", 0.9, 1, 2.0, "BP"), (4, None, 0.9, 1, 2.0, "BP"), (5, "d", 0.2, 1, 1.0, "MF"),
            (5, "e", 0.6, 1, 1.0, "MF"), (6, "d", 0.9, 1, 1.0, "UNK")]
    cells, seen = counted(spark.createDataFrame(rows, "entity_id long, term_id string, score double, y int, ia double, aspect string"))
    got = {r.aspect: (round(r.precision, 9), round(r.recall, 9)) for r in metrics.ia_f1_per_entity_with_truth(cells, 0.3).collect()}
    # BP: entity 1 predicts a and b (c has no truth), entity 2 nothing; MF: entity 5 one of two
    assert got["BP"] == (round(2 / 3 / 2, 9), 0.5) and got["MF"] == (1.0, 0.5) and got["CC"] == (0.0, 0.0)
    assert seen.value == len(rows)


def test_greedy_selection(spark):
    truth = spark.createDataFrame([(k, f"t{k % 3}") for k in range(12)], "entity_id long, term_id string")
    rows = [(k, f"t{(k + s) % 3}", m, v) for k in range(12) for m, s, v in
            (("m1", int(k < 5), 0.9), ("m2", int(k > 6), 0.9), ("m3", 1, 0.5))] + [(99, "t0", "m1", None)]
    scores, seen = counted(spark.createDataFrame(rows, "entity_id long, term_id string, model string, score double"))
    terms = spark.createDataFrame([("t0", "BP"), ("t1", "MF"), ("t2", None)], "term_id string, aspect string")
    ia = spark.createDataFrame([("t0", 1.0), ("t1", 2.0), ("t2", 0.5)], "term_id string, ia double")
    grid = [0.1, 0.3, 0.5, 0.7]
    steps = selection.greedy_forward_selection(scores, truth, terms, ia, ["m1", "m2", "m3"], grid)
    weight = {"t0": 1.0, "t1": 2.0, "t2": 0.5}

    def best(names):
        """Largest pooled F1 of the mean of ``names`` and the least threshold that has it."""
        sums, true = {}, {(k, f"t{k % 3}") for k in range(12)}
        for k, t, m, v in rows:
            if m in names and v is not None:
                sums[k, t] = sums.get((k, t), 0.0) + v / len(names)
        out = []
        for thr in grid:
            pred = {c for c, v in sums.items() if v >= thr - 1e-12}
            tp, p, t = (sum(weight[c[1]] for c in s) for s in (pred & true, pred, true))
            out.append((round(2 * tp / (p + t), 9) if tp else 0.0, -thr))
        return max(out)

    chosen, want = [], []
    while len(chosen) < 3:
        f1, thr, m = max(((*best([*chosen, m]), m) for m in ("m3", "m2", "m1") if m not in chosen), key=lambda r: (r[0], -int(r[2][1])))
        if want and f1 <= want[-1][2]:
            break
        chosen.append(m)
        want.append((m, -thr, f1))
    assert [(s["added"], s["best_thr"], round(s["best_f1"], 9)) for s in steps] == want
    assert len(steps) >= 2 and seen.value == len(rows)


def test_stacker_rows(spark):
    rows = [(k, "t", float(k % 2), (k % 5) / 5.0) for k in range(40)]
    f, seen = counted(spark.createDataFrame(rows, "entity_id long, term_id string, x double, z double"))
    truth = spark.createDataFrame([(k, "t") for k in range(1, 40, 2)], "entity_id long, term_id string")
    ia = spark.createDataFrame([("t", 1.0)], "term_id string, ia double")
    got = models.graph_stacker_fit_predict(f, truth, ia, ["x", "z"], max_iter=5)
    assert got.count() == 40 and got.where(F.col("score") > 0.5).where("entity_id % 2 = 0").count() == 0
    assert seen.value == len(rows)
