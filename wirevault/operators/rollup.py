"""Roll-up of flows to distinct request shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import packed_key, shape_key, unpacked_key


_SHAPE = ["host", "method", "path", "status", "resp_body_sha"]
_CARRIED = ["program", "source_tool", "method", "host", "path", "status", "resp_body_sha"]
_KEYS = ["shape_sha", "resp_body_sha"]
_COLUMNS = ["shape_sha", *_CARRIED, "hit_count", "first_seen", "last_seen", "first_id"]
# A number beyond all ids.
_ID_RANGE = str(10**19)


def _first_key(ts: Column, id: Column) -> Column:
    """One number that orders by time and then by id; fixed in width, unlike a struct of both."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(38,0)")
    return (micros * F.lit(_ID_RANGE).cast("decimal(20,0)") + id.cast("decimal(19,0)")).cast("decimal(38,0)")


def _first_id(first: Column) -> Column:
    return F.pmod(first, F.lit(_ID_RANGE).cast("decimal(20,0)")).cast("bigint")


def _folded(parts: DataFrame) -> DataFrame:
    """One row per shape out of parts (packed keys) by shape, program and tool, in one pass over the parts.

    The part that holds the earliest flow, which has the least key, gives program and tool. Shapes
    without any time have no earliest flow and are left out.
    """
    shape = Window.partitionBy("shape_sha")
    folded = parts.select(
        "shape_sha", *_CARRIED, "_first", F.sum("hit_count").over(shape).alias("hit_count"),
        F.min("first_seen").over(shape).alias("first_seen"), F.max("last_seen").over(shape).alias("last_seen"),
        F.row_number().over(shape.orderBy(F.col("_first").asc_nulls_last(), *_CARRIED)).alias("_place"),
    ).where((F.col("_place") == 1) & F.col("_first").isNotNull())
    found = folded.withColumn("first_id", _first_id(F.col("_first")))
    return found.withColumns({k: unpacked_key(F.col(k)) for k in _KEYS}).select(*_COLUMNS)


def shape_stats(flows: DataFrame) -> DataFrame:
    """One row per (host, method, path, status, response body) with hits and time range.

    Program and source tool are those of the earliest flow; ``id`` breaks equal times.
    All aggregates are order-free, so late flows need no special care. Flows are grouped by
    shape, program and tool first, by hash and on the map side; the key is computed per group. Keys move packed.
    """
    parts = flows.withColumn("resp_body_sha", packed_key(F.col("resp_body_sha"))).groupBy(*_SHAPE, "program", "source_tool").agg(
        F.count("*").alias("hit_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min(_first_key(F.col("ts"), F.col("id"))).alias("_first"),
    )
    key = shape_key(*(F.col(c) for c in _SHAPE[:-1]), unpacked_key(F.col("resp_body_sha")))
    return _folded(parts.withColumn("shape_sha", packed_key(key)))


def merge_shape_stats(parts: DataFrame) -> DataFrame:
    """Fold the shape counters of several batches; associative."""
    return _folded(
        parts.withColumns({k: packed_key(F.col(k)) for k in _KEYS}).groupBy("shape_sha", *_CARRIED).agg(
            F.sum("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"), F.min(_first_key(F.col("first_seen"), F.col("first_id"))).alias("_first"),
        )
    )


def flow_agg(stats: DataFrame) -> DataFrame:
    """The public roll-up table. Its tag column exists but is never filled by the roll-up."""
    return stats.drop("first_id").withColumn("fingerprints", F.array().cast("array<string>"))


def rollup(flows: DataFrame) -> DataFrame:
    """Roll-up computed in one go from stored flows."""
    return flow_agg(shape_stats(flows))
