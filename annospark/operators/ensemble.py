"""Sparse score algebra: normalisation, fusion, fold / seed averaging.

Scores are long ``(entity_id, term_id, [model|fold|seed], score)`` rows and an
absent pair means 0.0, so every mean divides by the number of members and
never uses ``avg`` over the present rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity_id", "term_id"]


def ordered_sum(col: str | F.Column) -> F.Column:
    """Sum of a small per-group value set in ascending order.

    Groups here hold one value per model / fold / seed (bounded by the
    number of members), so sorting them makes the floating-point sum
    independent of shuffle order: reruns and recomputed partitions give
    bit-identical scores, and threshold ties cannot flip."""
    c = F.col(col) if isinstance(col, str) else col
    return F.aggregate(F.sort_array(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x)


def row_max_normalise(scores: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """Divide by the per-entity (per ``by``) maximum; a zero maximum counts as 1."""
    by = by or ["entity_id"]
    mx = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn(score, F.col(score) / F.when(mx == 0, F.lit(1.0)).otherwise(mx))


def ensemble_mean(scores: DataFrame, n_models: int | None = None, model: str = "model",
                  key: list[str] | None = None) -> DataFrame:
    """Mean over all models; a pair a model did not score contributes 0.

    ``n_models`` defaults to the number of distinct models in the input
    (one small aggregate)."""
    key = key or KEY
    if n_models is None:
        n_models = scores.select(model).distinct().count()
    return scores.groupBy(*key).agg((ordered_sum("score") / F.lit(float(n_models))).alias("score"))


def weighted_fusion(scores: DataFrame, weights: dict[str, float], model: str = "model",
                    key: list[str] | None = None) -> DataFrame:
    """``sum(w_model * score)`` without renormalisation; unknown models weigh 0."""
    key = key or KEY
    wmap = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
    w = F.coalesce(F.element_at(wmap, F.col(model)), F.lit(0.0))
    return scores.groupBy(*key).agg(ordered_sum(w * F.col("score")).alias("score"))


def oof_assemble(fold_scores: DataFrame, fold: str = "fold") -> DataFrame:
    """A21 (OOF): every entity is scored only by the model of its held-out fold,
    so the union of folds is the OOF table; duplicates would be a contract
    violation and are collapsed by max."""
    return fold_scores.groupBy(*KEY).agg(F.max("score").alias("score"))


def fold_average(scores: DataFrame, n_folds: int, key: list[str] | None = None) -> DataFrame:
    """A21 (test) / A22: sum over folds (or seeds, TTA repeats) divided by their number."""
    key = key or KEY
    return scores.groupBy(*key).agg((ordered_sum("score") / F.lit(float(n_folds))).alias("score"))


def seed_average_oof(scores: DataFrame, seed: str = "seed") -> DataFrame:
    """A22 (OOF): mean over the seeds that actually produced a value for the pair."""
    return scores.groupBy(*KEY).agg((ordered_sum("score") / F.countDistinct(seed)).alias("score"))


def aspect_assemble(blocks: DataFrame, contract: DataFrame) -> DataFrame:
    """Stitch per-aspect blocks; keep only pairs whose term is in the
    block's aspect of the contract (guard by semi join)."""
    c = contract.select("term_id", "aspect")
    return blocks.join(c, ["term_id", "aspect"], "left_semi")


def row_stats(scores: DataFrame, n_terms: int) -> DataFrame:
    """Per-entity max and dense mean (absent cells are zeros) over ``n_terms`` columns."""
    return scores.groupBy("entity_id").agg(
        F.max("score").alias("row_max"),
        (F.sum("score") / F.lit(float(n_terms))).alias("row_mean"))


def model_columns(scores: DataFrame, models: list[str]) -> DataFrame:
    """A pair's scores (one per model) side by side, null where a model has none: one aggregate, where a pivot of first
    values would group by pair and model beforehand."""
    return scores.groupBy(*KEY).agg(*[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models])


def stack_features(scores: DataFrame, models: list[str], prior: DataFrame | None = None,
                   prior_weight: float = 0.15) -> DataFrame:
    """one channel per level-1 model (absent = 0) and an optional prior channel."""
    wide = model_columns(scores, models).fillna(0.0, subset=models)
    if prior is not None:
        wide = wide.join(prior.select("term_id", (F.col("prior") * prior_weight).alias("prior")),
                         "term_id", "left").fillna(0.0, subset=["prior"])
    return wide


def inject_prior(scores: DataFrame, prior: DataFrame, weight: float) -> DataFrame:
    """``score = max(score, w * prior)`` over the union of both supports."""
    p = prior.select(*KEY, (F.col("prior") * F.lit(weight)).alias("p"))
    j = scores.select(*KEY, "score").join(p, KEY, "full_outer")
    return j.select(*KEY, F.greatest(F.coalesce("score", F.lit(0.0)),
                                     F.coalesce("p", F.lit(0.0))).alias("score"))


def clip_scores(scores: DataFrame, lo: float = 0.0, hi: float = 1.0, score: str = "score") -> DataFrame:
    """NaN -> 0, +inf -> 1, -inf -> 0, then clip to [lo, hi]."""
    s = F.col(score)
    fixed = (F.when(F.isnan(s), F.lit(0.0)).when(s == float("inf"), F.lit(1.0))
             .when(s == float("-inf"), F.lit(0.0)).otherwise(s))
    return scores.withColumn(score, F.least(F.greatest(fixed, F.lit(lo)), F.lit(hi)))
