"""Structured Streaming over append-only logs: operations left open, and the latest state of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from proofline.operators.history import LEDGER_KEY, history_fold
from proofline.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_operations_stream(ledger: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(seq, event, opened, issue): operations without an answer, and failed ones that no completion of their key follows, when the watermark
    passes their timeout (timeout and delay are ours).

    ``ledger(utc timestamp, pos, seq, event, status, ref, version, reason, figure, figure_version)`` as a stream. Both are one outer join of
    the stream with itself, bounded in time, so state ends with the timeout and no Python runs. Missing equals missing in the key.
    Operations of a key that is used all the time meet only the completions of their own stretch of one timeout and of the next one.
    """
    conf = ledger.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")       # a count for reports that costs a read for each write
    wait = F.expr(f"INTERVAL {timeout}")
    epoch = F.timestamp_micros(F.lit(0))
    stretch = lambda at: F.floor(F.unix_micros(at) / F.greatest(F.unix_micros(epoch + wait), F.lit(1)))
    text = lambda kind, *columns: F.to_json(F.struct(F.lit(kind).alias("kind"), *columns), {"ignoreNullFields": "false"})
    asked = lambda seq: F.when(F.col(seq).isNotNull() & F.col("event").isNotNull(), text("interrupted", F.col(seq).alias("seq"), "event"))
    key = text("failed", *LEDGER_KEY)
    part = lambda condition, at, *columns: ledger.where(condition).select(F.col("utc").alias(at), *columns).withWatermark(at, delay)
    at = F.col("utc")
    opened = part("status = 'pending'", "opened", "seq", "event", F.lit("interrupted").alias("issue"), asked("seq").alias("key"), F.lit(None).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("stretch")).unionByName(
        part("status = 'failed'", "opened", "seq", "event", F.lit("failed").alias("issue"), key.alias("key"), F.col("pos").cast("bigint").alias("pos"), stretch(at).alias("stretch")))
    closed = part("status IN ('complete', 'failed') AND ref IS NOT NULL", "closed", asked("ref").alias("_key"), F.lit(None).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("_stretch")).unionByName(
        part("status = 'complete'", "closed", key.alias("_key"), F.col("pos").cast("bigint").alias("_pos"), F.explode(F.array(stretch(at) - 1, stretch(at))).alias("_stretch")))
    later = F.col("_pos").isNull() | (F.col("_pos") > F.col("pos"))        # the answer to an operation names it and needs no place
    both = opened.join(closed, (F.col("key") == F.col("_key")) & (F.col("stretch") == F.col("_stretch")) & later & (F.col("closed") >= F.col("opened")) & (F.col("closed") <= F.col("opened") + wait), "leftOuter")
    return both.where("_key IS NULL").select("seq", "event", "opened", "issue")


def history_fold_stream(events: DataFrame) -> DataFrame:
    """Folded state per asset, updated as events arrive; the same aggregation as the batch fold."""
    return history_fold(events)


def replay(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over all available input and read back what it wrote.

    Each micro-batch owns one folder, overwritten when the batch is retried, so a lost executor
    cannot leave duplicates. State is kept on disk in as many parts as there are cores: each part costs some commits a batch,
    however few rows it holds.
    """
    spark: SparkSession = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), max(spark.sparkContext.defaultParallelism, 1))))
    try:                                                         # a stream takes the session's settings when it starts
        run = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    run.awaitTermination()
    return spark.read.schema(ST.StructType([*stream.schema.fields, ST.StructField("batch", ST.LongType())])).parquet(out)


def latest_per_key(written: DataFrame, key: str) -> DataFrame:
    """The last update of each key from the batches of an update-mode stream."""
    fields = [c for c in written.columns if c not in (key, "batch")]
    return written.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(key, "r.*")
