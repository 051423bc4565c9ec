import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import boosting


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_passes_leave_no_shuffles(spark, monkeypatch):
    """the sums of every pass stayed on disk until the driver collected garbage."""
    monkeypatch.setattr(boosting, "WHOLE", 0)
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(200)], "entity_id long, vec array<double>")
    labels = spark.createDataFrame([(k, "a") for k in range(0, 200, 3)], "entity_id long, term_id string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    before = shuffle_files(spark)
    boosting.boosted_ovr_fit(x, labels, ["a"], F.expr("pmod(entity_id, 4)"), boosting.BoostParams(trees=8, depth=3))
    assert spark.conf.get(name, None) == setting
    for _ in range(40):  # files are removed in the background
        left = shuffle_files(spark) - before
        if len({f.split("_")[1] for f in left}) <= 8:  # those of the counts before the first pass
            return
        time.sleep(0.25)
    raise AssertionError(f"{len(left)} shuffle files are left")


@pytest.mark.parametrize("width", [1, 5])
def test_node_sums(width):
    p, rng = boosting.BoostParams(bins=8), np.random.default_rng(2)
    bins, local = rng.integers(0, 8, (90, 4)).astype(np.uint8), rng.integers(0, width, 90)
    g, h = rng.normal(size=90), rng.random(90)
    want = np.zeros((3, width, 4, 8))
    for r in range(90):
        for j in range(4):
            want[:, local[r], j, bins[r, j]] += (g[r], h[r], 1)
    for layout in (bins, np.asfortranarray(bins)):
        assert np.array_equal(boosting.node_sums(layout, local, width, g, h, p), want.reshape(3, -1))


def test_models_are_dealt_evenly(spark, monkeypatch):
    """dealt by hash, some tasks got several times the models of others."""
    monkeypatch.setattr(boosting, "MODELS_A_TASK", 2)
    rng = np.random.default_rng(6)
    x = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(120)], "entity_id long, vec array<double>")
    terms = [f"t{i}" for i in range(8)]
    labels = spark.createDataFrame([(k, terms[k % 8]) for k in range(120)], "entity_id long, term_id string")
    sizes, write = [], boosting.written

    def seen(df):
        if "root" in df.columns:
            sizes.append([r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return write(df)

    monkeypatch.setattr(boosting, "written", seen)
    boosting.boosted_ovr_fit(x, labels, terms, F.expr("pmod(entity_id, 4)"), boosting.BoostParams(trees=1, depth=2))
    assert sizes and sum(sizes[0]) == 32 and max(sizes[0]) <= 3
