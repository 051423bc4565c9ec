"""Query registry and small helpers of the llm subpackage.

Conventions shared by the operators:

* an operator selects only the columns it needs, so extra columns of any name
  do no harm; a null text counts as an empty text;
* every row is treated on its own (or in groups of bounded size), so repeated
  rows and null ids each give their own result row;
* intermediate tables go to Parquet in the shared checkpoint folder of the
  session (:func:`stored`), which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annospark.plans.registry import Query
from annospark.session import ensure_checkpoint_dir, ship_package

LLM_QUERIES: dict[str, Query] = {}
BATCH_ROWS = 1000


def llm_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as the query ``name``."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        build.__name__, build.__doc__ = fn.__name__, fn.__doc__
        LLM_QUERIES[name] = Query(name, build, sql, name)
        return fn
    return deco


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and make sure that a checkpoint folder is set.

    An Arrow batch has at most ``BATCH_ROWS`` rows: a batch lies whole in the JVM and in the worker, and
    Spark's 10,000 texts of a few kilobytes cost every task some ten megabytes several times over."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (names are case-insensitive)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows, so that a task holds little at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ranged(df: DataFrame, id_col: str, rows_per_range: int = 4000) -> tuple[DataFrame, int]:
    """Add ``__range``: consecutive ranges of ``id_col`` of about ``rows_per_range`` rows, numbered in id order.

    The bounds are literals taken from approximate quantiles, so a recomputed
    task sees the same ranges.  Null ids are in range 0, before all others.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import functions as F

    n = df.count()
    k = max(1, min(20_000, -(-n // rows_per_range)))
    ids = df.select(F.col(id_col).cast("double").alias("x"))
    cuts = sorted(set(ids.approxQuantile("x", [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    name = "__range"
    if not cuts:
        return df.withColumn(name, F.lit(0)), 1
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__id_double", outputCol=name,
                     handleInvalid="keep")
    out = cut.transform(df.withColumn("__id_double", F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))))
    return out.withColumn(name, F.col(name).cast("int")).drop("__id_double"), len(cuts) + 1


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI as Spark gives it, such as file:/x, hdfs://h/x or s3://b/x."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def let(value, use):
    """The column ``use(value)`` with ``value`` worked out once per row, however often ``use`` refers to it
    (a plain reference would be copied into every place, also into each step of a lambda)."""
    from pyspark.sql import functions as F

    return F.get(F.transform(F.array(value), use), F.lit(0))
