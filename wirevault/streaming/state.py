"""Running totals of a stream, kept in streaming state instead of in batches of deltas.

Totals by shape and by body live in RocksDB state stores, off the heap and saved with the
checkpoint. A micro-batch costs work by the keys that it touches, whatever the history, and a key
that is a third of a batch is one row per map task before the shuffle.

Every micro-batch writes the totals that it changed to a folder of its own number, so a batch
that is repeated after a failure replaces its own rows. Totals only ever grow (counts and last
times) or fall (first times), so readers fold all rows of a key by maximum and minimum; no order
of batches matters, and a row that was read twice does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import shape_key
from ..operators.bodies import with_body_keys
from .ingest import FLUSH_INTERVAL

# The setting that names the state store, and the store that spills to disk.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SHAPE = ["host", "method", "path", "status", "resp_body_sha"]


def _start(
    changed: DataFrame, folder: str, mode: str, *, checkpoint: str, available_now: bool, interval: str
) -> StreamingQuery:
    """Write what every micro-batch changed below its number; state in RocksDB."""
    spark = changed.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = changed.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    # A query copies the session's settings when it starts.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def stream_shapes(
    flows: DataFrame, folder: str, *, checkpoint: str, available_now: bool = False, interval: str = FLUSH_INTERVAL
) -> StreamingQuery:
    """Start counting the request shapes of a stream of normalised flows; see `shapes`.

    Bodies are hashed before the shuffle; only their keys move. Programs and tools are counted apart, so
    that those of the earliest flow of a shape can be told.
    """
    totals = with_body_keys(flows).groupBy(*_SHAPE, "program", "source_tool").agg(
        F.count("*").alias("hit_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return _start(totals, folder, "update", checkpoint=checkpoint, available_now=available_now, interval=interval)


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up as of the last finished batch: the columns of `operators.rollup.rollup` but tags.

    Flows have no ids while they stream, so equal first times go by program and tool, null first.
    """
    totals = spark.read.parquet(folder).groupBy(*_SHAPE, "program", "source_tool").agg(
        F.max("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    folded = totals.groupBy(*_SHAPE).agg(
        F.sum("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min(F.struct("first_seen", "program", "source_tool")).alias("_first"),
    )
    return folded.select(
        shape_key(*(F.col(c) for c in _SHAPE)).alias("shape_sha"), "_first.program", "_first.source_tool",
        "method", "host", "path", "status", "resp_body_sha", "hit_count", "first_seen", "last_seen",
    )


def _seen(flows: DataFrame) -> DataFrame:
    """One narrow row per body seen: ``sha256, size, ts``; its content stays behind."""
    sides = (F.struct(F.col(f"{s}_body_sha").alias("sha256"), F.octet_length(f"{s}_body").alias("size"), "ts") for s in ("req", "resp"))
    return with_body_keys(flows).select(F.inline(F.array(*sides))).where("sha256 IS NOT NULL")


def stream_body_counts(
    flows: DataFrame, folder: str, *, checkpoint: str, available_now: bool = False, interval: str = FLUSH_INTERVAL
) -> StreamingQuery:
    """Start counting the bodies of a stream of normalised flows; see `body_counts`."""
    totals = _seen(flows).groupBy("sha256", "size").agg(F.count("*").alias("seen_count"), F.min("ts").alias("first_seen"))
    return _start(totals, folder, "update", checkpoint=checkpoint, available_now=available_now, interval=interval)


def body_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``sha256, size, seen_count, first_seen`` of every body as of the last finished batch."""
    return spark.read.parquet(folder).groupBy("sha256", "size").agg(
        F.max("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen")
    )


def stream_new_bodies(
    flows: DataFrame, folder: str, *, checkpoint: str, horizon: str = "1 day", available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Start a feed of bodies that were not seen within ``horizon``; see `new_bodies`.

    The watermark is on the time of arrival, not of the flow, so late flows are never dropped. Keys
    older than the horizon leave the state, which bounds it by the bodies of that time.
    """
    arrived = _seen(flows).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", horizon)
    first = arrived.dropDuplicatesWithinWatermark(["sha256"])
    return _start(first, folder, "append", checkpoint=checkpoint, available_now=available_now, interval=interval)


def new_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """``sha256, size, seen_at`` of every body; the first time if it came again after the horizon."""
    return spark.read.parquet(folder).groupBy("sha256", "size").agg(F.min("seen_at").alias("seen_at"))
