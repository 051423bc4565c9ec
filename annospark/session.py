"""Session construction and small execution helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "annospark") -> SparkSession:
    """Local / test session with AQE on and the web UI off.

    On a cluster the session comes from the platform; this builder is for
    tests, the bench and the smoke entry.  A checkpoint directory is only
    set when the session has none (see :func:`ensure_checkpoint_dir`).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("ANNOSPARK_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ANNOSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``annospark`` importable in the Python workers (once per
    application): the package sources are zipped and added with
    ``SparkContext.addPyFile``, which distributes them to every executor.
    UDFs defined in the package then unpickle wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import annospark
    pkg = os.path.dirname(os.path.abspath(annospark.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="annospark-code-"), "annospark.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as-is, and without it a cluster session is refused; a fresh local folder
    is made only for local masters (tests and local runs).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="annospark-ckpt-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be <= ``max_rows``.

    Above the bound the frame is returned unhinted so the planner falls back
    to a shuffle join (AQE may still convert it at runtime from measured sizes).
    """
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than
    the cluster has cores (a few large files, e.g. a small text corpus in a
    handful of row groups).  Inputs that already span the cluster are left
    alone, so at scale this adds no shuffle."""
    target = min_parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small parameter table (thresholds, grids, k per aspect)."""
    return spark.createDataFrame(rows, schema)
