"""Structured Streaming forms of the reference's chunked, accumulate-as-you-go jobs.

All three read a growing folder of files, keep their running state in the
streaming state store (exactly-once with the checkpoint location) and can
run continuously or, as here, with ``availableNow`` to drain what exists.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.functions.keys import evidence_filter
from annospark.operators.metrics import threshold_of
from annospark.operators.ontology import CLOSURE_BROADCAST_ROWS, closure_into
from annospark.session import bounded_broadcast, cut_lineage


def _gaf_stream(spark: SparkSession, source_dir: str, files_per_batch: int) -> DataFrame:
    t = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(source_dir)
    t = t.filter(~F.col("value").startswith("!") & (F.col("value") != ""))
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    return t.select(p.alias("p")).filter(F.size("p") >= 7).select(
        F.col("p").getItem(1).alias("entity_id"), F.col("p").getItem(4).alias("term_id"),
        F.col("p").getItem(6).alias("evidence"))


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state on the executors' disks, not on their heaps."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def incremental_external_ingest(spark: SparkSession, source_dir: str, entities: DataFrame, closure: DataFrame,
                                contract: DataFrame, out_dir: str, checkpoint: str,
                                files_per_batch: int = 1, train: DataFrame | None = None) -> DataFrame:
    """GAF lines as they arrive -> IEA only -> known entities (stream-static
    semi join) -> lift to contract ancestors (static closure join) ->
    globally distinct (entity, term) via streaming dedup state -> append to
    a Parquet table.  Returns the table read back.

    Pairs of ``train`` (``entity_id, term_id``) are left out: what training data
    say stays as it is.  A replayed or late file adds no pair twice: every pair
    written is remembered, one key for each row of the result, in RocksDB on the
    executors' disks with snapshots in ``checkpoint``; nothing expires, since a
    late file may repeat the oldest pair."""
    # static sides are materialised in the checkpoint folder: the stream plan
    # then only references stored tables (no batch-only expressions upstream)
    ents = cut_lineage(entities.select("entity_id").distinct())
    cl = bounded_broadcast(cut_lineage(closure_into(closure, contract)), CLOSURE_BROADCAST_ROWS)
    rows = evidence_filter(_gaf_stream(spark, source_dir, files_per_batch), only_iea=True)
    rows = rows.join(ents, "entity_id", "left_semi")
    up = rows.join(cl, "term_id").select("entity_id", F.col("ancestor").alias("term_id"))
    if train is not None:
        up = up.join(cut_lineage(train.select("entity_id", "term_id").distinct()), ["entity_id", "term_id"], "left_anti")
    with disk_state(spark):
        q = (up.dropDuplicates(["entity_id", "term_id"]).withColumn("score", F.lit(1.0))
             .writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start(out_dir))
        q.awaitTermination()
    return spark.read.parquet(out_dir)


def running_evaluation_counters(spark: SparkSession, scores_dir: str, schema: str, truth: DataFrame,
                                terms: DataFrame, ia: DataFrame, thresholds: dict[str, float], out_dir: str,
                                checkpoint: str, ia_default: float = 0.0, files_per_batch: int = 1) -> DataFrame:
    """Stream of predicted scores joined to static truth; per-term running
    weighted tp / pred counters in complete mode (state = one row per term),
    each micro-batch overwriting the counter table; the pooled IA-F1 per
    aspect and ALL is computed from the final counters."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(scores_dir)
    t = cut_lineage(truth.select("entity_id", "term_id").distinct()).withColumn("y", F.lit(1))
    asp = cut_lineage(terms.select("term_id", "aspect"))
    x = s.join(asp, "term_id", "left").withColumn("aspect", F.coalesce("aspect", F.lit("UNK")))
    x = x.filter(F.col("score") >= threshold_of(thresholds))
    x = x.join(t, ["entity_id", "term_id"], "left")
    counters = x.groupBy("term_id").agg(F.count("*").alias("pred"), F.count("y").alias("tp"))

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    q = (counters.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    c = spark.read.parquet(out_dir)
    true = t.groupBy("term_id").agg(F.count("*").alias("true"))
    per = true.join(c, "term_id", "full_outer").fillna(0, subset=["pred", "tp", "true"])
    per = per.join(asp, "term_id", "left").withColumn("aspect", F.coalesce("aspect", F.lit("UNK")))
    per = per.join(ia.select("term_id", F.col("ia").alias("w")), "term_id", "left") \
        .withColumn("w", F.coalesce("w", F.lit(float(ia_default))))
    g = per.rollup("aspect").agg(F.sum(F.col("w") * F.col("tp")).alias("w_tp"),
                                 F.sum(F.col("w") * F.col("pred")).alias("w_pred"),
                                 F.sum(F.col("w") * F.col("true")).alias("w_true"))
    p = F.when(F.col("w_pred") > 0, F.col("w_tp") / F.col("w_pred")).otherwise(0.0)
    r = F.when(F.col("w_true") > 0, F.col("w_tp") / F.col("w_true")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select(F.coalesce("aspect", F.lit("ALL")).alias("aspect"), p.alias("precision"), r.alias("recall"),
                    f.alias("f1"), "w_tp", "w_pred", "w_true")


def running_evidence_histogram(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                               files_per_batch: int = 1) -> DataFrame:
    """Rows per evidence code over a stream of GAF files, in update mode: a
    micro-batch writes only the codes whose running counts it changed
    (:func:`update_sink`).  An empty source gives an empty table."""
    rows = _gaf_stream(spark, source_dir, files_per_batch)
    counts = rows.groupBy("evidence").agg(F.count("*").alias("rows"))
    q = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(update_sink(out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_updates(spark, out_dir, counts.schema, ["evidence"])


def update_sink(out_dir: str):
    """A ``foreachBatch`` sink that applies every batch once: a batch owns the folder of its epoch, so one that is
    delivered again, after a failure or not, writes the same rows over its own."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch}")
    return sink


def latest_updates(spark: SparkSession, out_dir: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """The table that the batches of :func:`update_sink` have left: each key's row of the last epoch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch=-1")  # never no files
    values = [c for c in schema.names if c not in key]
    t = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(out_dir)
    return t.groupBy(*key).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*key, "v.*")
