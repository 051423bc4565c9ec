"""Linear scoring, the graph stacker and resumable folds.

One-vs-rest logistic regression (F7) is in ``logistic.py``, boosted trees (F9)
in ``boosting.py``.

* Linear scoring (F8) is a per-partition GEMM over Arrow batches with the
  weight block shipped to the tasks; only scores above a floor are emitted.
* The stacker (F11) uses an MLlib estimator (JVM-side).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.session import cut_lineage


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def linear_score(x: DataFrame, model: pd.DataFrame, key: str = "entity_id", vec: str = "vec",
                 floor: float = 0.0, degenerate_logit: float = -10.0) -> DataFrame:
    """F8: ``sigmoid(clip(x . w_t + b_t, +-50))`` for every term of a fitted
    block; a degenerate (all-zero, zero-bias) model scores logit -10.  Only
    scores ``> floor`` are emitted (sparse output)."""
    terms = model["term_id"].tolist()
    W = np.stack([np.asarray(w, dtype=np.float64) for w in model["w"]], axis=1)
    b = model["b"].to_numpy(dtype=np.float64)
    degenerate = (np.abs(W).sum(axis=0) == 0) & (b == 0)
    key_type = x.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("term_id", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def score(it):
        for pdf in it:
            if pdf.empty:
                continue
            X = _stack(pdf[vec])
            Z = np.clip(X @ W + b, -50, 50)
            Z[:, degenerate] = degenerate_logit
            P = 1.0 / (1.0 + np.exp(-Z))
            i, j = np.nonzero(P > floor)
            yield pd.DataFrame({key: pdf[key].to_numpy()[i], "term_id": np.asarray(terms, dtype=object)[j],
                                "score": P[i, j]})
    return x.select(key, vec).mapInPandas(score, schema)


def graph_stacker_fit_predict(features: DataFrame, truth: DataFrame, ia: DataFrame, channels: list[str],
                              aspect: str | None = None, max_iter: int = 50, ia_default: float = 1.0) -> DataFrame:
    """F11 (re-aimed as simplified graph convolution): per (entity, term) rows
    whose channels are level-1 scores after graph smoothing, fitted with an
    IA-weighted MLlib logistic regression; returns ``(entity_id, term_id, score)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    f = features if aspect is None else features.filter(F.col("aspect") == aspect)
    t = truth.select("entity_id", "term_id").distinct().withColumn("label", F.lit(1.0))
    d = f.join(t, ["entity_id", "term_id"], "left").fillna(0.0, subset=["label"])
    d = d.join(ia.select("term_id", F.col("ia").alias("weight")), "term_id", "left") \
        .fillna(float(ia_default), subset=["weight"])
    # the rows are made once, for the fit and for the scores
    d = cut_lineage(d.select("entity_id", "term_id", *channels, "label", "weight"))
    d = VectorAssembler(inputCols=channels, outputCol="features").transform(d)
    m = LogisticRegression(maxIter=max_iter, weightCol="weight", regParam=1e-4).fit(d)
    return m.transform(d).select("entity_id", "term_id",
                                 vector_to_array("probability").getItem(1).alias("score"))


def run_folds(spark, folds: list[int], out_path: str, compute) -> DataFrame:
    """resumable per-fold stage.  Each fold is a partition folder
    ``fold=f`` with a ``_SUCCESS`` marker of its own, written when the fold is
    whole; folds with a marker are skipped, all others are computed by
    ``compute(fold) -> DataFrame`` and replace what an interrupted run left.
    Read errors are raised, not taken for missing folds.  Returns the whole
    table."""
    from annospark.sources.tables import stage_done

    for f in folds:
        if not stage_done(spark, f"{out_path}/fold={f}"):
            compute(f).drop("fold").write.mode("overwrite").parquet(f"{out_path}/fold={f}")
    return spark.read.parquet(out_path)
