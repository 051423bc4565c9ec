"""Model / hyper-parameter selection.

Every candidate is evaluated in one pass: rows fan out to the candidate k or
model subsets through a generate over a literal array whose length is the number
of candidates (a parameter), then the usual sparse metric aggregates run grouped
by candidate; weight vectors need no fan-out (see :func:`grid_search_weights`).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.operators import metrics as M
from annospark.operators.ensemble import model_columns
from annospark.session import cut_lineage

KEY = ["entity_id", "term_id"]


def simplex_grid(n_models: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors with entries in {0, 1/(steps-1), ..., 1} summing to 1."""
    m = steps - 1
    out = []
    for c in itertools.product(range(m + 1), repeat=n_models):
        if sum(c) == m:
            out.append(tuple(round(x / m, 6) for x in c))
    return out


def _per_entity_f1(pred_cells: DataFrame, truth: DataFrame, by: list[str], n_entities: int,
                   aspects=("BP", "MF", "CC")) -> DataFrame:
    """Mean per-entity F1 (absent entities count 0) per ``by`` and aspect, plus
    ``ALL`` = mean of aspects.  ``pred_cells``: ``(by..., entity_id, term_id,
    aspect)`` predicted; ``truth``: ``(entity_id, term_id, aspect)``."""
    t = truth.select("entity_id", "term_id", "aspect").distinct()
    true_n = t.groupBy("entity_id", "aspect").agg(F.count("*").alias("true"))
    p = pred_cells.join(t.withColumn("y", F.lit(1)), ["entity_id", "term_id", "aspect"], "left")
    k = p.groupBy(*by, "entity_id", "aspect").agg(F.count("*").alias("pred"), F.count("y").alias("tp"))
    k = k.filter(F.col("tp") > 0).join(true_n, ["entity_id", "aspect"])
    f = 2 * F.col("tp") / (F.col("pred") + F.col("true"))
    per = k.groupBy(*by, "aspect").agg((F.sum(f) / float(n_entities)).alias("f1"))
    per = per.filter(F.col("aspect").isin(*aspects))
    allrow = per.groupBy(*by).agg((F.sum("f1") / float(len(aspects))).alias("f1")).withColumn("aspect", F.lit("ALL"))
    return per.unionByName(allrow)


def transfer_by_k(neigh: DataFrame, labels: DataFrame, ks: list[int], denom) -> DataFrame:
    """``(k, query_id, term_id, aspect, score)``: label transfer over the first
    k neighbours for every k, divided by ``denom`` of the similarities' sum and
    then by the query's largest score (1 where that is 0)."""
    arr = F.array(*[F.lit(int(k)) for k in ks])
    n = neigh.select("query_id", "base_id", "sim", F.explode(F.filter(arr, lambda k: F.col("rank") <= k)).alias("k"))
    of_query = Window.partitionBy("k", "query_id")
    n = n.withColumn("denom", denom(F.sum("sim").over(of_query)))
    lab = labels.select(F.col("entity_id").alias("base_id"), "term_id", "aspect").distinct()
    s = n.join(lab, "base_id").groupBy("k", "query_id", "term_id", "aspect") \
        .agg((F.sum("sim") / F.first("denom")).alias("score"))
    top = F.greatest(F.max("score").over(of_query), F.lit(0.0))
    return s.withColumn("score", F.col("score") / F.when(top == 0, F.lit(1.0)).otherwise(top))


def tune_k(neigh: DataFrame, labels: DataFrame, ks: list[int], thresholds: dict[str, float], n_queries: int) -> DataFrame:
    """One neighbour query at ``max(ks)`` reused for every k: label
    transfer over the first k neighbours (1e-9 added to the denominator),
    row-max normalised, per-entity F1 at each aspect's threshold; ``is_best``
    marks the best k per aspect (ties -> smaller k)."""
    s = transfer_by_k(neigh, labels, ks, lambda d: d + F.lit(1e-9))
    hit = F.lit(False)
    for aspect, thr in thresholds.items():
        hit = hit | ((F.col("aspect") == aspect) & (F.col("score") >= float(thr)))
    pred = s.filter(hit).select("k", F.col("query_id").alias("entity_id"), "term_id", "aspect")
    res = _per_entity_f1(pred, labels, ["k"], n_queries)
    w = Window.partitionBy("aspect").orderBy(F.round("f1", 12).desc(), F.col("k"))
    return res.withColumn("is_best", F.row_number().over(w) == 1)


FIELD, FIELDS = 20, 3  # bits of a count (up to a million terms of an entity and aspect), counts in a number


def grid_search_weights(scores: DataFrame, truth: DataFrame, terms: DataFrame, models: list[str], steps: int,
                        thr: float | dict[str, float], n_entities: int, top: int = 5,
                        aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """Every simplex weight vector over ``models`` (``steps`` per axis);
    fused score ``sum(w_m * s_m)`` in model order, per-entity F1 at ``thr`` (one
    number, or one for each aspect), mean over the aspects; the ``top`` best
    vectors (ties -> grid order).

    A cell stays one row: bit fields say which vectors reach the threshold there,
    the truth is joined before, and summing the fields counts for all vectors, in
    one row per entity and aspect, before the shuffle."""
    grid = simplex_grid(len(models), steps)
    wide = model_columns(scores, models).fillna(0.0, subset=models)
    wide = wide.join(terms.select("term_id", "aspect").where(F.col("aspect").isin(*aspects)), "term_id")
    t = truth.select("entity_id", "term_id", "aspect").distinct()
    limit = M.threshold_of(thr, aspects)
    fused = [sum((F.lit(float(w)) * F.col(m) for w, m in zip(c[1:], models[1:])), F.lit(float(c[0])) * F.col(models[0])) for c in grid]
    hits = [sum((F.when(f >= limit, F.lit(1 << (FIELD * k))).otherwise(F.lit(0)) for k, f in enumerate(fused[low:low + FIELDS])),
                F.lit(0).cast("long")) for low in range(0, len(grid), FIELDS)]
    # weights sum to 1, so a fused score is not above the largest score (1e-9: rounded weights)
    x = wide.where(F.greatest(*models) * (1 + 1e-5) >= limit - 1e-9) if len(models) > 1 else wide
    x = x.join(t.withColumn("y", F.lit(1)), ["entity_id", "term_id", "aspect"], "left").select(
        "entity_id", "aspect", F.coalesce("y", F.lit(0)).alias("y"), *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    packed = x.groupBy("entity_id", "aspect").agg(*[F.sum(f"h{i}").alias(f"p{i}") for i in range(len(hits))],
                                                  *[F.sum(F.col("y") * F.col(f"h{i}")).alias(f"t{i}") for i in range(len(hits))])
    field = lambda c, name: F.shiftright(f"{name}{c // FIELDS}", FIELD * (c % FIELDS)).bitwiseAND(F.lit((1 << FIELD) - 1))
    true_n = t.groupBy("entity_id", "aspect").agg(F.count("*").alias("true"))
    each = packed.join(true_n, ["entity_id", "aspect"])
    by_aspect = each.groupBy("aspect").agg(*[F.sum(2 * field(c, "t") / (field(c, "p") + F.col("true"))).alias(f"f{c}")
                                             for c in range(len(grid))])
    all_f1 = by_aspect.agg(*[(F.coalesce(F.sum(f"f{c}"), F.lit(0.0)) / float(n_entities) / float(len(aspects))).alias(f"f{c}")
                             for c in range(len(grid))])
    rows = F.array(*[F.struct(F.lit(c).alias("combo"), *[F.lit(float(w)).alias(f"w_{m}") for w, m in zip(v, models)], F.col(f"f{c}").alias("f1"))
                     for c, v in enumerate(grid)])
    full = all_f1.select(F.inline(rows))  # one row a weight vector
    w = Window.orderBy(F.round("f1", 12).desc(), F.col("combo"))
    return full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def sweep_k_thresholds(neigh: DataFrame, labels: DataFrame, ks: list[int], grids: dict[str, list[float]]) -> DataFrame:
    """For every k, micro F1 over all per-aspect threshold combinations of
    the transferred, row-max normalised scores (similarities clipped to [0, 1],
    a zero denominator counts as 1);
    tp / fp / fn are additive over aspects, so each aspect is swept once per k
    and the combinations are assembled from those tiny count tables.  Returns
    the best combination per k (ties -> lowest thresholds in aspect order)."""
    clipped = neigh.withColumn("sim", F.least(F.greatest(F.col("sim"), F.lit(0.0)), F.lit(1.0)))
    s = transfer_by_k(clipped, labels, ks, lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d))
    t = labels.select(F.col("entity_id").alias("query_id"), "term_id", "aspect").distinct().withColumn("y", F.lit(1))
    true_n = t.groupBy("aspect").agg(F.count("*").alias("true"))
    sj = s.join(t, ["query_id", "term_id", "aspect"], "left")
    parts = []
    for a, grid in grids.items():
        x = sj.filter(F.col("aspect") == a).select("k", F.col("y").isNotNull().cast("int").alias("y"),
                                                   M.grid_bucket(F.col("score"), grid).alias("b"))
        h = x.groupBy("k", "b").agg(F.count("*").alias("np"), F.sum("y").alias("nt"))
        ex = h.filter(F.col("b") > 0).select("k", "np", "nt", F.explode(F.sequence(F.lit(0), F.col("b") - 1))
                                              .alias("g"))
        c = ex.groupBy("k", "g").agg(F.sum("np").alias("pred"), F.sum("nt").alias("tp"))
        gdf = h.select("k").distinct().select("k", F.posexplode(F.array(*[F.lit(float(v)) for v in grid]))
                                              .alias("g", "thr"))
        c = gdf.join(c, ["k", "g"], "left").fillna(0, subset=["pred", "tp"]).withColumn("aspect", F.lit(a))
        c = c.join(true_n, "aspect").select("k", F.col("thr").alias(f"thr_{a.lower()}"),
                                             F.col("tp").alias(f"tp_{a}"),
                                             (F.col("pred") - F.col("tp")).alias(f"fp_{a}"),
                                             (F.col("true") - F.col("tp")).alias(f"fn_{a}"))
        parts.append(c)
    combo = parts[0]
    for p in parts[1:]:
        combo = combo.join(p, "k")  # grid sizes multiply: a bounded parameter product per k
    tp = sum(F.col(f"tp_{a}") for a in grids)
    fp = sum(F.col(f"fp_{a}") for a in grids)
    fn = sum(F.col(f"fn_{a}") for a in grids)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    combo = combo.withColumn("f1", f1)
    w = Window.partitionBy("k").orderBy(F.round("f1", 12).desc(), *[F.col(f"thr_{a.lower()}") for a in grids])
    return combo.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1) \
        .select("k", *[f"thr_{a.lower()}" for a in grids], "f1")


def greedy_forward_selection(scores: DataFrame, truth: DataFrame, terms: DataFrame, ia: DataFrame,
                             models: list[str], grid: list[float], ia_default: float = 0.0) -> list[dict]:
    """Repeatedly add the candidate (sorted name order, strict ``>``)
    whose mean ensemble with the chosen set has the best pooled IA-F1 over
    ``grid``; stop when nothing improves.  The cells of all models are joined and
    written once, and a step is one pass over them; the driver loop only sees one
    small best-per-candidate row per step."""
    chosen: list[str] = []
    best = -1.0
    steps = []
    cells = cut_lineage(M.model_cells(scores.where(F.col("score").isNotNull()), truth, terms, ia, ia_default))
    while len(chosen) < len(models):
        cands = sorted(m for m in models if m not in chosen)
        subsets = {m: chosen + [m] for m in cands}
        c = M.cells_of_subsets(cells, subsets).withColumn("aspect", F.lit("ALL"))
        res = M.best_threshold(M.threshold_curve(c, grid, by=["subset"], include_all=False), by=["subset"]).collect()  # one row per candidate
        res = sorted(res, key=lambda r: r["subset"])
        top = None
        for r in res:
            if top is None or round(r["best_f1"], 12) > round(top["best_f1"], 12):
                top = r
        if top is None or round(top["best_f1"], 12) <= round(best, 12):
            break
        best = top["best_f1"]
        chosen.append(top["subset"])
        steps.append({"step": len(chosen), "added": top["subset"], "best_thr": top["best_thr"], "best_f1": best})
    return steps
