"""Weighted multi-label metrics, threshold curves and model selection.

Everything starts from one sparse ``cells`` relation: the full outer join
of predictions and truth on (entity, term) with ``score`` (absent = 0),
``y`` (0/1), ``ia`` and ``aspect``.  Cells that are neither predicted nor
true contribute nothing to any metric here, so the dense grid is never
built.  Threshold sweeps do not cross-join a grid with the cells: each cell
is bucketed once by how many grid thresholds it clears, the buckets are
summed into a tiny histogram and the curve is a suffix sum over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.operators.ensemble import ordered_sum
from annospark.operators.ontology import CLOSURE_BROADCAST_ROWS, ancestor_sums
from annospark.session import bounded_broadcast, cut_lineage

KEY = ["entity_id", "term_id"]


def linspace(start: float, stop: float, num: int) -> list[float]:
    """Evenly spaced grid, rounded to 6 decimals so SQL literals agree."""
    if num == 1:
        return [round(start, 6)]
    step = (stop - start) / (num - 1)
    return [round(start + i * step, 6) for i in range(num)]


# The reference's calibration grid is linspace(0.05, 0.60, 23).
CALIBRATION_GRID = linspace(0.05, 0.60, 23)


def cells(scores: DataFrame, truth: DataFrame, terms: DataFrame | None = None,
          ia: DataFrame | None = None, ia_default: float = 0.0, unknown_aspect: str = "UNK") -> DataFrame:
    """Sparse evaluation cells ``(entity_id, term_id, score, y, ia, aspect)``."""
    s = scores.select(*KEY, "score")
    t = truth.select(*KEY).distinct().withColumn("y", F.lit(1))
    c = s.join(t, KEY, "full_outer").select(
        *KEY, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("y", F.lit(0)).alias("y"))
    return _with_terms(c, terms, ia, ia_default, unknown_aspect)


def _with_terms(c: DataFrame, terms: DataFrame | None, ia: DataFrame | None, ia_default: float,
                unknown_aspect: str = "UNK") -> DataFrame:
    if terms is not None:
        c = c.join(terms.select("term_id", F.col("aspect").alias("_a")), "term_id", "left") \
            .withColumn("aspect", F.coalesce("_a", F.lit(unknown_aspect))).drop("_a")
    else:
        c = c.withColumn("aspect", F.lit(unknown_aspect))
    if ia is not None:
        c = c.join(ia.select("term_id", F.col("ia").alias("_ia")), "term_id", "left") \
            .withColumn("ia", F.coalesce("_ia", F.lit(float(ia_default)))).drop("_ia")
    else:
        c = c.withColumn("ia", F.lit(1.0))
    return c


def subset_cells(scores: DataFrame, truth: DataFrame, terms: DataFrame | None, ia: DataFrame | None,
                 subsets: dict[str, list[str]], ia_default: float = 0.0, model: str = "model") -> DataFrame:
    """Cells of the mean ensemble of every named model subset, with a column ``subset``.

    The values of a cell's models (one per model) stay in one row through the joins with truth, terms and weights; the
    subsets part only afterwards, without a shuffle.  A subset has a cell where one of its models has a score or the
    truth has the pair."""
    return cells_of_subsets(model_cells(scores, truth, terms, ia, ia_default, model), subsets)


def model_cells(scores: DataFrame, truth: DataFrame, terms: DataFrame | None, ia: DataFrame | None, ia_default: float = 0.0,
                model: str = "model") -> DataFrame:
    """Cells whose ``score`` holds the (model, score) of every model; see :func:`cells_of_subsets`."""
    wide = scores.groupBy(*KEY).agg(F.collect_list(F.struct(F.col(model).alias("model"), "score")).alias("score"))
    t = truth.select(*KEY).distinct().withColumn("y", F.lit(1))
    c = wide.join(t, KEY, "full_outer").select(*KEY, "score", F.coalesce("y", F.lit(0)).alias("y"))
    return _with_terms(c, terms, ia, ia_default)


def cells_of_subsets(c: DataFrame, subsets: dict[str, list[str]]) -> DataFrame:
    """The cells of every subset's mean from those of :func:`model_cells`."""
    def mean(names: list[str]) -> Column:  # in ascending order, so a recomputed cell is the same
        own = F.transform(F.filter("score", lambda m: m["model"].isin(names)), lambda m: m["score"])
        return F.when(F.size(own) > 0, F.aggregate(F.sort_array(own), F.lit(0.0), lambda a, x: a + x) / float(len(names)))

    each = F.array(*[F.struct(F.lit(name).alias("subset"), mean(names).alias("score")) for name, names in subsets.items()])
    c = c.select(*KEY, "y", "aspect", "ia", F.explode(each).alias("s")).where(F.col("s.score").isNotNull() | (F.col("y") == 1))
    return c.select("s.subset", *KEY, F.coalesce("s.score", F.lit(0.0)).alias("score"), "y", "ia", "aspect")


def threshold_of(thresholds: dict[str, float] | float, aspects: tuple[str, ...] = ()) -> Column:
    """The threshold of a row's aspect: its own, else that of ``ALL``.  A row whose aspect has neither raises, as do
    ``aspects`` without one right away, so that no prediction vanishes unseen."""
    values = thresholds if isinstance(thresholds, dict) else {"ALL": thresholds}
    if any(v <= 0 for v in values.values()):
        raise ValueError("thresholds must be > 0 with sparse scores")
    if missing := [a for a in aspects if a not in values and "ALL" not in values]:
        raise ValueError(f"no threshold for {', '.join(missing)}")
    if not isinstance(thresholds, dict):
        return F.lit(float(thresholds))
    m = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    none = F.lit(float(thresholds["ALL"])) if "ALL" in thresholds else F.raise_error(
        F.concat(F.lit("no threshold for aspect "), F.coalesce("aspect", F.lit("NULL")))).cast("double")
    return F.coalesce(F.element_at(m, F.col("aspect")), none)


_thr_col = threshold_of


def _prf(tp: Column, pred: Column, true: Column):
    p = F.when(pred > 0, tp / pred).otherwise(F.lit(0.0))
    r = F.when(true > 0, tp / true).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


def ia_f1_pooled(c: DataFrame, thresholds: dict[str, float] | float, strict: bool = False,
                 by: list[str] | None = None) -> DataFrame:
    """Pooled IA-weighted P / R / F1 per aspect and ``ALL`` (GROUPING SETS
    ((aspect), ())), with weighted tp / pred / true and term counts; for each value of the ``by`` columns."""
    by = by or []
    thr = _thr_col(thresholds)
    pred = (F.col("score") > thr) if strict else (F.col("score") >= thr)
    hit, true = pred, F.col("y") == 1
    # per term first (partial sums before the shuffle), so that terms are counted on one row each and cells never expand
    x = c.groupBy(*by, "aspect", "term_id").agg(
        F.sum(F.when(hit & true, F.col("ia")).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, F.col("ia")).otherwise(0.0)).alias("p"),
        F.sum(F.when(true, F.col("ia")).otherwise(0.0)).alias("t"), F.max(hit).alias("pred"), F.max(true).alias("true"))
    both = F.explode(F.array("aspect", F.lit("ALL")))  # one row a term by now
    g = x.rollup("aspect") if not by else x.withColumn("aspect", both).groupBy(*by, "aspect")
    g = g.agg(
        F.sum("tp").alias("w_tp"), F.sum("p").alias("w_pred"), F.sum("t").alias("w_true"),
        F.countDistinct(F.when(F.col("pred"), F.col("term_id"))).alias("terms_pred"),
        F.countDistinct(F.when(F.col("true"), F.col("term_id"))).alias("terms_true"))
    p, r, f = _prf(F.col("w_tp"), F.col("w_pred"), F.col("w_true"))
    return g.select(*by, F.coalesce("aspect", F.lit("ALL")).alias("aspect"), p.alias("precision"),
                    r.alias("recall"), f.alias("f1"), "w_tp", "w_pred", "w_true", "terms_pred", "terms_true")


def grid_bucket(score: Column, grid: list[float]) -> Column:
    """Number of grid thresholds ``<= score`` (grid ascending)."""
    grid = sorted(float(t) for t in grid)

    def cleared(low: int, high: int) -> Column:  # by halving, compiled: no array a row
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(score >= grid[mid], cleared(mid + 1, high)).otherwise(cleared(low, mid))
    return cleared(0, len(grid))


def threshold_curve(c: DataFrame, grid: list[float], by: list[str] | None = None,
                    include_all: bool = True) -> DataFrame:
    """Pooled IA-F1 at every grid threshold in one pass over the cells.

    Output ``(aspect, thr, precision, recall, f1, w_tp, w_pred, w_true)`` for
    each aspect (and ``ALL``), plus any extra ``by`` columns (e.g. a model or
    fold).  The cells are read once: each cell is counted for its own aspect
    and for ``ALL`` (a two-way generate), bucketed by the number of grid
    thresholds it clears and summed into a tiny histogram; expanding a bucket
    to its grid positions (plus position -1 carrying the totals) happens on
    that histogram only."""
    by = by or []
    asp = F.array(F.col("aspect"), F.lit("ALL")) if include_all else F.array(F.col("aspect"))
    x = c.select(*by, F.explode(asp).alias("aspect"), "ia", "y", grid_bucket(F.col("score"), grid).alias("b"))
    hist = x.groupBy(*by, "aspect", "b").agg(
        F.sum("ia").alias("wp"), F.sum(F.when(F.col("y") == 1, F.col("ia")).otherwise(0.0)).alias("wt"))
    # a cell in bucket b is predicted at grid positions 0..b-1; position -1 sums everything
    ex = hist.select(*by, "aspect", "wp", "wt", F.explode(F.sequence(F.lit(-1), F.col("b") - 1)).alias("g"))
    cur = ex.groupBy(*by, "aspect", "g").agg(F.sum("wp").alias("w_pred"), F.sum("wt").alias("w_tp"))
    true = cur.filter(F.col("g") == -1).select(*by, "aspect", F.col("w_tp").alias("w_true"))
    thr = F.array(*[F.lit(float(t)) for t in grid])
    grid_df = true.select(*by, "aspect", "w_true", F.posexplode(thr).alias("g", "thr"))
    j = grid_df.join(cur.filter(F.col("g") >= 0), [*by, "aspect", "g"], "left").fillna(0.0, subset=["w_pred", "w_tp"])
    p, r, f = _prf(F.col("w_tp"), F.col("w_pred"), F.col("w_true"))
    return j.select(*by, "aspect", "thr", p.alias("precision"), r.alias("recall"), f.alias("f1"),
                    "w_tp", "w_pred", "w_true")


def best_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First strict maximum of F1 (lowest threshold on ties)."""
    by = by or []
    # ties are judged on F1 rounded to 1e-12 so float summation noise cannot break them
    w = Window.partitionBy(*by, "aspect").orderBy(F.round("f1", 12).desc(), F.col("thr").asc())
    return curve.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1) \
        .select(*by, "aspect", F.col("thr").alias("best_thr"), F.col("f1").alias("best_f1"))


def calibrate_aspect_thresholds(c: DataFrame, grid: list[float] | None = None,
                                scopes: tuple[str, ...] = ("ALL", "BP", "MF", "CC", "UNK")) -> DataFrame:
    """Best threshold per scope; a scope without cells falls back to ALL."""
    grid = grid or CALIBRATION_GRID
    best = best_threshold(threshold_curve(c, grid))
    counts = c.groupBy("aspect").agg(F.count("*").alias("cells"))
    sc = c.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    allrow = best.filter(F.col("aspect") == "ALL").select(F.col("best_thr").alias("all_thr"),
                                                         F.col("best_f1").alias("all_f1"))
    j = sc.join(best, sc.scope == best.aspect, "left").drop("aspect")
    j = j.join(counts, j.scope == counts.aspect, "left").drop("aspect")
    a = allrow.select(F.struct("all_thr", "all_f1").alias("s")).scalar()
    return j.select("scope", F.coalesce("best_thr", a.getField("all_thr")).alias("thr"),
                    F.coalesce("best_f1", a.getField("all_f1")).alias("f1"),
                    F.coalesce("cells", F.lit(0)).alias("cells"))


def threshold_probe(c: DataFrame, triples: list[tuple[float, float, float]],
                    aspects: tuple[str, str, str] = ("BP", "MF", "CC")) -> DataFrame:
    """Pooled IA-F1 over the three aspects at each listed per-aspect
    threshold triple; counts are additive over aspects, so one curve per aspect
    at all distinct thresholds, from one pass over the cells, serves every triple."""
    grid = sorted({float(x) for t in triples for x in t})
    cur = threshold_curve(c.filter(F.col("aspect").isin(*aspects)), grid, include_all=False) \
        .select("aspect", "thr", "w_tp", "w_pred", "w_true")
    spark = c.sparkSession
    rows = [(i, a, float(t[j])) for i, t in enumerate(triples) for j, a in enumerate(aspects)]
    tri = spark.createDataFrame(rows, "probe int, aspect string, thr double")
    j = tri.join(cur, ["aspect", "thr"], "left").fillna(0.0, subset=["w_tp", "w_pred", "w_true"])
    g = j.groupBy("probe").agg(
        *[F.max(F.when(F.col("aspect") == a, F.col("thr"))).alias(f"thr_{a.lower()}") for a in aspects],
        F.sum("w_tp").alias("w_tp"), F.sum("w_pred").alias("w_pred"), F.sum("w_true").alias("w_true"))
    p, r, f = _prf(F.col("w_tp"), F.col("w_pred"), F.col("w_true"))
    return g.select("probe", *[f"thr_{a.lower()}" for a in aspects], p.alias("precision"),
                    r.alias("recall"), f.alias("f1"))


def _entity_aspect_counts(c: DataFrame, thr: Column, weight: Column, *more: Column) -> DataFrame:
    pred = F.col("score") >= thr
    return c.groupBy("entity_id", "aspect").agg(
        F.sum(F.when(pred & (F.col("y") == 1), weight).otherwise(0.0)).alias("tp"),
        F.sum(F.when(pred, weight).otherwise(0.0)).alias("pred"),
        F.sum(F.when(F.col("y") == 1, weight).otherwise(0.0)).alias("true"), *more)


def ia_f1_per_entity_all(c: DataFrame, n_entities: int | Column, thr: float = 0.5,
                         aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """IA-weighted P / R / F1 per entity and aspect, averaged over all
    ``n_entities`` (entities without cells count 0); ``ALL`` = mean of aspects."""
    k = _entity_aspect_counts(c.filter(F.col("aspect").isin(*aspects)), F.lit(thr), F.col("ia"))
    p, r, f = _prf(F.col("tp"), F.col("pred"), F.col("true"))
    n = n_entities if isinstance(n_entities, Column) else F.lit(float(n_entities))
    per = k.groupBy("aspect").agg((F.sum(p) / n).alias("precision"), (F.sum(r) / n).alias("recall"),
                                  (F.sum(f) / n).alias("f1"))
    return _with_mean_of_aspects(per, aspects)


def _with_mean_of_aspects(per: DataFrame, aspects, cols=("precision", "recall", "f1"),
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-aspect rows (missing aspects as zeros) plus ``ALL`` = mean over the
    aspects, from one rollup over the few result rows (the result is consumed
    once, so the pipeline behind it runs once)."""
    spark = per.sparkSession
    full = spark.createDataFrame([(a,) for a in aspects], "aspect string").join(per, "aspect", "left") \
        .fillna(0.0, subset=list(cols))
    div = F.when(F.grouping("aspect") == 1, F.lit(float(len(aspects)))).otherwise(F.lit(1.0))
    g = full.rollup("aspect").agg(*[(F.sum(c) / div).alias(c) for c in cols],
                                  *[F.first(k).alias(k) for k in keep], F.grouping("aspect").alias("_all"))
    out = g.withColumn("aspect", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("aspect")))
    for k in keep:  # per-aspect attributes have no meaning for the ALL row
        out = out.withColumn(k, F.when(F.col("_all") == 1, F.lit(None)).otherwise(F.col(k)))
    return out.drop("_all")


def ia_f1_per_entity_with_truth(c: DataFrame, thr: float,
                                aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """Per aspect, only entities with truth there; predictions restricted
    to terms that occur in that aspect's truth; no prediction -> P = R = F = 0;
    averaged over those entities, ``ALL`` = mean of aspects.  (IA defaults
    are set when building the cells; the reference uses 1.0 here.)"""
    # written once, as the terms with truth come from the same cells; predictions below the threshold count for nothing
    known = F.col("entity_id").isNotNull() & F.col("term_id").isNotNull()
    cc = cut_lineage(c.filter(F.col("aspect").isin(*aspects) & known & ((F.col("y") == 1) | (F.col("score") >= F.lit(thr))))
                     .select("entity_id", "term_id", "aspect", "score", "y", "ia"))
    truth_terms = cc.filter(F.col("y") == 1).select("aspect", "term_id").distinct()
    x = cc.join(bounded_broadcast(truth_terms, CLOSURE_BROADCAST_ROWS), ["aspect", "term_id"], "left_semi")
    k = _entity_aspect_counts(x, F.lit(thr), F.col("ia"), F.max("y").alias("y")).filter(F.col("y") == 1)
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    r = F.when((F.col("pred") > 0) & (F.col("true") > 0), F.col("tp") / F.col("true")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    per = k.groupBy("aspect").agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))
    return _with_mean_of_aspects(per, aspects)


def f1_per_entity_unweighted(c: DataFrame, n_entities: int | Column, thr: float | dict[str, float],
                             aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """Plain per-entity F1 averaged over all entities per aspect, at one
    threshold or a per-aspect threshold dict; ``ALL`` is the plain mean of
    the three aspects."""
    k = _entity_aspect_counts(c.filter(F.col("aspect").isin(*aspects)), _thr_col(thr), F.lit(1.0))
    p, r, f = _prf(F.col("tp"), F.col("pred"), F.col("true"))
    n = n_entities if isinstance(n_entities, Column) else F.lit(float(n_entities))
    per = k.groupBy("aspect").agg((F.sum(p) / n).alias("precision"), (F.sum(r) / n).alias("recall"),
                                  (F.sum(f) / n).alias("f1"))
    return _with_mean_of_aspects(per, aspects)


def samples_prf(c: DataFrame, n_entities: int | Column, thr: float) -> DataFrame:
    """E5: sklearn ``average='samples'`` P / R / F1 with zero_division=0 over all entities."""
    pred = F.col("score") >= thr
    k = c.groupBy("entity_id").agg(
        F.count_if(pred & (F.col("y") == 1)).alias("tp"), F.count_if(pred).alias("pred"),
        F.count_if(F.col("y") == 1).alias("true"))
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    r = F.when(F.col("true") > 0, F.col("tp") / F.col("true")).otherwise(0.0)
    f = F.when(F.col("pred") + F.col("true") > 0,
               2 * F.col("tp") / (F.col("pred") + F.col("true"))).otherwise(0.0)
    n = n_entities if isinstance(n_entities, Column) else F.lit(float(n_entities))
    return k.agg((F.sum(p) / n).alias("precision"), (F.sum(r) / n).alias("recall"), (F.sum(f) / n).alias("f1"))


def micro_f1(c: DataFrame, thr: float, strict: bool = True, by: list[str] | None = None) -> DataFrame:
    """Flattened tp / fp / fn; ``strict`` uses ``score > thr``."""
    by = by or []
    pred = (F.col("score") > thr) if strict else (F.col("score") >= thr)
    g = c.groupBy(*by).agg(F.count_if(pred & (F.col("y") == 1)).alias("tp"),
                           F.count_if(pred & (F.col("y") == 0)).alias("fp"),
                           F.count_if(~pred & (F.col("y") == 1)).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.withColumn("f1", F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0))


def fmax_official(c: DataFrame, grid: list[float] | None = None,
                  aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """Per aspect the maximum over thresholds of the IA-weighted F measure
    where precision averages over entities with at least one prediction and
    recall over all entities with truth in the aspect (full mode); ``ALL`` is
    the mean of the aspects.

    Each entity's precision / recall is a step function of the threshold that
    only changes at its own score buckets, so every entity emits one
    +/- difference pair per occupied bucket (not one row per threshold); a
    prefix sum over the grid (a few hundred rows per aspect) gives the curve."""
    grid = grid or linspace(0.01, 1.0, 100)
    cc = c.filter(F.col("aspect").isin(*aspects))
    x = cc.select("aspect", "entity_id", "ia", "y", grid_bucket(F.col("score"), grid).alias("b"))
    h = x.groupBy("aspect", "entity_id", "b").agg(
        F.sum("ia").alias("wp"), F.sum(F.when(F.col("y") == 1, F.col("ia")).otherwise(0.0)).alias("wt"),
        F.max("y").alias("yt"))
    d = _fmax_steps(h).groupBy("aspect", "g").agg(F.sum("p").alias("dp"), F.sum("n").alias("dn"), F.sum("r").alias("dr"))
    best = _fmax_best(d, grid).select("aspect", F.col("best_thr").alias("thr"), F.col("best_f1").alias("fmax"))
    return _with_mean_of_aspects(best, aspects, cols=("fmax",), keep=("thr",)).select("aspect", "thr", "fmax")


def _fmax_steps(h: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(aspect, g, p, n, r)`` with ``keep``: what an entity adds to the sums at grid position ``g`` (-1 counts it),
    from the ``(aspect, entity_id, b, wp, wt, yt)`` sums of its score buckets; entities without truth add nothing."""
    # one entity holds at most len(grid) + 1 bucket rows, so these windows are
    # small; all ordered quantities share one descending-bucket window
    e = Window.partitionBy("aspect", "entity_id")
    ed = e.orderBy(F.col("b").desc())
    run = ed.rowsBetween(Window.unboundedPreceding, 0)
    hb = h.select("aspect", "entity_id", "b", *keep, F.sum("wp").over(run).alias("s_pred"),
                  F.sum("wt").over(run).alias("s_tp"), F.coalesce(F.lead("b").over(ed), F.lit(0)).alias("lo"),
                  F.sum("wt").over(e).alias("w_true"), F.max("yt").over(e).alias("has_truth"),
                  (F.row_number().over(ed) == 1).alias("first"))
    hb = hb.filter(F.col("has_truth") == 1)  # only entities with truth in the aspect are evaluated
    has = F.col("s_pred") > 0
    p = F.when(has, F.col("s_tp") / F.col("s_pred")).otherwise(0.0)
    n = has.cast("long")
    r = F.when(F.col("w_true") > 0, F.col("s_tp") / F.col("w_true")).otherwise(0.0)
    live = F.col("b") > 0  # bucket 0 rows are never predicted
    # +value where a segment starts (lo), -value where it ends (b); position -1
    # counts the evaluated entities (one per entity, from its first row)
    z = F.lit(0.0)
    items = F.array(
        F.struct(F.col("lo").alias("g"), F.when(live, p).otherwise(z).alias("p"),
                 F.when(live, n).otherwise(F.lit(0)).cast("long").alias("n"), F.when(live, r).otherwise(z).alias("r")),
        F.struct(F.col("b").alias("g"), F.when(live, -p).otherwise(z).alias("p"),
                 F.when(live, -n).otherwise(F.lit(0)).cast("long").alias("n"),
                 F.when(live, -r).otherwise(z).alias("r")),
        F.struct(F.lit(-1).alias("g"), z.alias("p"), F.col("first").cast("long").alias("n"), z.alias("r")))
    return hb.select("aspect", *keep, F.inline(items))


def _fmax_best(d: DataFrame, grid: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """The best threshold and F of each ``by`` and aspect, from the tiny table of differences ``(aspect, g, dp, dn, dr)``."""
    key = [*by, "aspect"]
    n_ent = d.filter(F.col("g") == -1).select(*key, F.col("dn").alias("n_true"))
    gi = n_ent.select(*key, "n_true", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("g", "thr"))
    cur = gi.join(d.filter(F.col("g") >= 0), [*key, "g"], "left") \
        .fillna(0.0, subset=["dp", "dr"]).fillna(0, subset=["dn"])
    runs = Window.partitionBy(*key).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    cur = cur.select(*key, "thr", "n_true", F.sum("dp").over(runs).alias("sum_p"),
                     F.sum("dn").over(runs).alias("n_pred"), F.sum("dr").over(runs).alias("sum_r"))
    pp = F.when(F.col("n_pred") > 0, F.col("sum_p") / F.col("n_pred")).otherwise(0.0)
    rr = F.col("sum_r") / F.col("n_true")
    f = F.when((F.col("n_true") > 0) & (pp + rr > 0), 2 * pp * rr / (pp + rr)).otherwise(0.0)
    return best_threshold(cur.select(*key, "thr", f.alias("f1")), list(by))


def prior_knowledge(prior: DataFrame, aspects: tuple[str, ...] = ("BP", "MF", "CC")) -> DataFrame:
    """``(entity_id, known)``: bit i of ``known`` says that the entity had an annotation in aspect i beforehand."""
    bit = F.create_map(*[F.lit(x) for i, a in enumerate(aspects) for x in (a, 1 << i)])
    return prior.filter(F.col("aspect").isin(*aspects)).groupBy("entity_id").agg(
        F.bit_or(F.element_at(bit, F.col("aspect"))).alias("known"))


# Targets of an aspect by what was known of the entity: nothing; something, but not in
# this aspect; every aspect.  Others (this aspect but not every one) are not evaluated.
KNOWLEDGE = ("no", "limited", "partial")


def fmax_by_knowledge(scores: DataFrame, truth: DataFrame, terms: DataFrame, ia: DataFrame, closure: DataFrame,
                      known: DataFrame, grid: list[float] | None = None, aspects: tuple[str, ...] = ("BP", "MF", "CC"),
                      ia_default: float = 0.0) -> DataFrame:
    """E10 in full: Fmax (:func:`fmax_official`) of propagated predictions by knowledge group.

    Output ``(knowledge, aspect, thr, fmax)``: a row for each group and aspect, each group's mean over the aspects
    (``ALL``) and the mean of the groups (``ALL``, ``ALL``); a group without targets in an aspect has fmax 0 there.

    The maximum of a term's descendants' scores clears as many thresholds as the best of them, so only the number
    of thresholds cleared is propagated: predictions and truth go up the ``closure`` together, and an entity's ancestors
    meet where its rows are, by :func:`ontology.ancestor_sums` (terms outside it are excluded).  ``known`` is
    :func:`prior_knowledge`; an entity's groups are bits, summed side by side in one sweep of differences.
    """
    grid = grid or linspace(0.01, 1.0, 100)
    targets = truth.select("entity_id").distinct()
    found = scores.join(targets, "entity_id", "left_semi").select(*KEY, grid_bucket(F.col("score"), grid).alias("b"),
                                                                 F.lit(0).alias("y")).filter(F.col("b") > 0)
    rows = found.unionByName(truth.select(*KEY, F.lit(0).alias("b"), F.lit(1).alias("y"))) \
        .groupBy(*KEY).agg(F.max("b").alias("b"), F.max("y").alias("y"))
    # a term counts once for each of its rows in both tables
    weights = terms.select("term_id", "aspect").filter(F.col("aspect").isin(*aspects)).join(ia.select("term_id", "ia"), "term_id", "left") \
        .groupBy("term_id", "aspect").agg(F.sum(F.coalesce("ia", F.lit(float(ia_default)))).alias("weight"))
    h = ancestor_sums(rows, closure, weights, len(grid) + 1)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, a in enumerate(aspects) for x in (a, 1 << i)]), F.col("aspect"))
    has = F.coalesce("known", F.lit(0))
    group = (F.when(has == 0, 1).when(has.bitwiseAND(bit) == 0, 2).when(has == (1 << len(aspects)) - 1, 4).otherwise(0))
    h = h.join(known.select("entity_id", "known"), "entity_id", "left").withColumn("groups", group).filter("groups > 0")
    steps = _fmax_steps(h, keep=("groups",))
    inside = [F.col("groups").bitwiseAND(1 << i) != 0 for i in range(len(KNOWLEDGE))]
    sums = [F.sum(F.when(w, F.col(v)).otherwise(F.lit(0))).alias(f"{v}{i}") for i, w in enumerate(inside) for v in ("p", "n", "r")]
    wide = cut_lineage(steps.groupBy("aspect", "g").agg(*sums))  # a row for each aspect and threshold, read twice below
    d = wide.select("aspect", "g", F.inline(F.array(*[
        F.struct(F.lit(name).alias("knowledge"), F.col(f"p{i}").alias("dp"), F.col(f"n{i}").alias("dn"), F.col(f"r{i}").alias("dr"))
        for i, name in enumerate(KNOWLEDGE)])))
    best = _fmax_best(d, grid, ("knowledge",))
    every = scores.sparkSession.createDataFrame([(k, a) for k in KNOWLEDGE for a in aspects], "knowledge string, aspect string")
    full = every.join(best, ["knowledge", "aspect"], "left").select("knowledge", "aspect", F.col("best_thr").alias("thr"),
                                                                   F.coalesce("best_f1", F.lit(0.0)).alias("fmax"))
    # few rows: the means of a rollup over groups and aspects (all cells of the grid are there)
    g = full.rollup("knowledge", "aspect").agg(F.avg("fmax").alias("fmax"), F.first("thr").alias("thr"),
                                               F.grouping("aspect").alias("mean"))
    return g.select(F.coalesce("knowledge", F.lit("ALL")).alias("knowledge"), F.coalesce("aspect", F.lit("ALL")).alias("aspect"),
                    F.when((F.col("mean") == 0) & (F.col("fmax") > 0), F.col("thr")).alias("thr"), "fmax")


def ia_weighted_bce(c: DataFrame, n_entities: int, ia_terms: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Mean of ``ia * BCE(logit(clip(p)), y)`` over the dense entity x term
    grid of the ``ia_terms`` columns.  Absent cells (p = 0, y = 0) share one
    closed-form loss per term, so the grid is never materialised."""
    def bce(z: Column, y: Column) -> Column:
        return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
        return F.log(q / (1 - q))
    t = ia_terms.select("term_id", F.col("ia").alias("w"))
    present = c.join(t, "term_id").groupBy("term_id").agg(
        F.sum(bce(logit(F.col("score")), F.col("y").cast("double"))).alias("loss"),
        F.count("*").alias("n_present"))
    z0 = logit(F.lit(0.0))
    per = t.join(present, "term_id", "left").fillna({"loss": 0.0, "n_present": 0})
    total = per.select((F.col("w") * (F.col("loss") + (F.lit(float(n_entities)) - F.col("n_present"))
                                      * bce(z0, F.lit(0.0)))).alias("l"))
    n_terms = ia_terms.count()
    return total.agg((F.sum("l") / F.lit(float(n_entities) * n_terms)).alias("bce"))


def capped_pos_weight(labels: DataFrame, n_entities: int, cap: float = 20.0) -> DataFrame:
    """``min((neg + 1) / (pos + 1), cap)`` with ``pos = count + 1``,
    ``neg = n - pos + 1`` per term."""
    pos = labels.select(*KEY).distinct().groupBy("term_id").agg((F.count("*") + 1).alias("pos"))
    neg = F.lit(n_entities) - F.col("pos") + 1
    return pos.select("term_id", F.least((neg + 1) / (F.col("pos") + 1), F.lit(cap)).alias("pos_weight"))


def comparison_report(results: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Tidy (model, aspect, metric, value) table from per-model metric frames."""
    out = None
    for name, df in results.items():
        m = df.select(F.lit(name).alias("model"), "aspect", *metrics).unpivot(
            ["model", "aspect"], metrics, "metric", "value")
        out = m if out is None else out.unionByName(m)
    return out


def alignment_verdict(best_f1: Column, cutoff: float = 0.05) -> Column:
    """Aligned when the best F1 clears the cutoff."""
    return F.when(best_f1 > cutoff, F.lit("aligned")).otherwise(F.lit("broken"))


def subset_scores(scores: DataFrame, subsets: dict[str, list[str]], model: str = "model") -> DataFrame:
    """Mean-ensemble score of every named model subset in one pass (absent = 0):
    each score row fans out to the subsets containing its model (a generate
    bounded by the number of subsets)."""
    arr = F.array(*[F.struct(F.lit(name).alias("subset"), F.array(*[F.lit(m) for m in ms]).alias("ms"),
                             F.lit(float(len(ms))).alias("n")) for name, ms in subsets.items()])
    x = scores.select(*KEY, model, "score", F.explode(
        F.filter(arr, lambda s: F.array_contains(s["ms"], F.col(model)))).alias("s"))
    return x.groupBy(F.col("s.subset").alias("subset"), *KEY).agg(
        (ordered_sum("score") / F.first("s.n")).alias("score"))


def best_by_subset(scores: DataFrame, truth: DataFrame, terms: DataFrame, ia: DataFrame, subsets: dict[str, list[str]],
                   grid: list[float], ia_default: float = 0.0) -> DataFrame:
    """(subset, best_thr, best_f1): best pooled IA-F1 over all aspects of every model subset, in one pass over the
    cells.  E13 with one subset for each model."""
    c = subset_cells(scores, truth, terms, ia, subsets, ia_default).withColumn("aspect", F.lit("ALL"))
    return best_threshold(threshold_curve(c, grid, by=["subset"], include_all=False), by=["subset"]) \
        .select("subset", "best_thr", "best_f1")


def compare_subsets(scores: DataFrame, truth: DataFrame, terms: DataFrame, ia: DataFrame, subsets: dict[str, list[str]],
                    thresholds: dict[str, float] | float, ia_default: float = 0.0) -> DataFrame:
    """E19 in one pass: tidy (model, aspect, metric, value) of the pooled IA precision, recall and F1 of every subset."""
    c = subset_cells(scores, truth, terms, ia, subsets, ia_default).withColumnRenamed("subset", "model")
    return ia_f1_pooled(c, thresholds, by=["model"]).unpivot(["model", "aspect"], ["precision", "recall", "f1"], "metric", "value")


def ablation_leave_one_out(scores: DataFrame, truth: DataFrame, terms: DataFrame, ia: DataFrame,
                           models: list[str], grid: list[float] | None = None,
                           ia_default: float = 0.0) -> DataFrame:
    """Best pooled IA-F1 of the full mean ensemble and of every
    leave-one-out ensemble; delta vs full and a label (MVP: removing the model
    costs more than 0.001; confuser: removing it gains more than 0.001)."""
    grid = grid or CALIBRATION_GRID
    subsets = {"ALL_MODELS": list(models)}
    subsets.update({f"-{m}": [x for x in models if x != m] for m in models})
    res = best_by_subset(scores, truth, terms, ia, subsets, grid, ia_default)
    # one row per subset by now
    full = F.max(F.when(F.col("subset") == "ALL_MODELS", F.col("best_f1"))).over(Window.partitionBy(F.lit(0)))
    delta = F.col("best_f1") - full
    label = F.when(F.col("subset") == "ALL_MODELS", F.lit("full")) \
        .when(delta < -0.001, F.lit("MVP")).when(delta > 0.001, F.lit("confuser")).otherwise(F.lit("neutral"))
    return res.select(F.regexp_replace("subset", "^-", "").alias("removed"), "best_thr", "best_f1",
                      delta.alias("delta"), label.alias("label"))


def best_threshold_by_fold(c: DataFrame, folds: DataFrame, grid: list[float]) -> DataFrame:
    """E21, best mode: per CV fold and aspect (and ``ALL``) the grid threshold of the
    best pooled IA-F1 (ties -> lowest) with that F1; all folds in one pass."""
    x = c.join(folds.select("entity_id", "fold"), "entity_id")
    return best_threshold(threshold_curve(x, grid, by=["fold"]), by=["fold"])


def metrics_by_fold(c: DataFrame, folds: DataFrame, thr: float) -> DataFrame:
    """Pooled IA-F1 and micro F1 per CV fold at a fixed threshold."""
    x = c.join(folds.select("entity_id", "fold"), "entity_id")
    pred = F.col("score") >= thr
    g = x.groupBy("fold").agg(
        F.sum(F.when(pred & (F.col("y") == 1), F.col("ia")).otherwise(0.0)).alias("w_tp"),
        F.sum(F.when(pred, F.col("ia")).otherwise(0.0)).alias("w_pred"),
        F.sum(F.when(F.col("y") == 1, F.col("ia")).otherwise(0.0)).alias("w_true"),
        F.count_if(pred & (F.col("y") == 1)).alias("tp"), F.count_if(pred & (F.col("y") == 0)).alias("fp"),
        F.count_if(~pred & (F.col("y") == 1)).alias("fn"))
    p, r, f = _prf(F.col("w_tp"), F.col("w_pred"), F.col("w_true"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.select("fold", f.alias("ia_f1"), F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0)
                    .alias("micro_f1"))
