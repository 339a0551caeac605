"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id and text, fixed for good. Bytes and rows are summed per
slot, which gives `SLOTS` rows however large the input is; only those reach the driver, where
the map from slots to shards is made or edited. Every version of the map is kept as a table.
Rebalancing moves whole slots, as few as it takes, and never touches the records' slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import new_scratch_dir
from .common import literal_rows

SLOTS = 8192
# Bytes that a record costs besides its text.
OVERHEAD = 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The text takes part, so that records without an id, or with a common one, spread too."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_sizes(docs: DataFrame, *, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot in use: at most `slots` rows on the driver."""
    found = (
        docs.select(slot_of(F.col("doc_id"), F.col("text"), slots).alias("_slot"), record_size(F.col("text")).alias("_bytes"))
        .groupBy("_slot").agg(F.sum("_bytes").alias("_bytes"), F.count("*").alias("_rows"))
    )
    return sorted(tuple(r) for r in found.collect())


def first_map(sizes: list[tuple[int, int, int]], shards: int, *, slots: int = SLOTS) -> list[int]:
    """Largest slot first, each to the shard that is lightest so far; empty slots go round."""
    to = [slot % shards for slot in range(slots)]
    loads = [(0, shard) for shard in range(shards)]
    for slot, size, _ in sorted(sizes, key=lambda s: (-s[1], s[0])):
        load, shard = heapq.heappop(loads)
        to[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return to


def edited_map(old: list[int], sizes: list[tuple[int, int, int]], shards: int) -> list[int]:
    """Move slots off shards above the mean, largest that fit first, to the lightest shard.

    Shards beyond `shards` are emptied; with one shard more, slots only move where there is room,
    which is the new shard as long as the old ones were even.
    """
    to, bytes_of = list(old), {slot: size for slot, size, _ in sizes}
    load = [0] * max(shards, *(shard + 1 for shard in old))
    for slot, size in bytes_of.items():
        load[to[slot]] += size
    mean = sum(load) / shards
    for slot, shard in enumerate(to):
        if shard >= shards and slot not in bytes_of:
            to[slot] = slot % shards
    for slot in sorted(bytes_of, key=lambda s: (-bytes_of[s], s)):
        size, home = bytes_of[slot], to[slot]
        target = min(range(shards), key=lambda s: (load[s], s))
        if home >= shards or load[home] - size >= mean and load[target] + size <= mean:
            load[home] -= size
            load[target] += size
            to[slot] = target
    return to


def write_map(spark: SparkSession, path: str, version: int, to: list[int]) -> DataFrame:
    """Keep a version of the map as a table of its own and return it: slot, shard, version."""
    rows = literal_rows(spark, [{"slot": i, "shard": s} for i, s in enumerate(to)], "slot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    stored = spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")
    return stored.withColumn("version", F.lit(version))


def newest_version(spark: SparkSession, path: str) -> int:
    """The number of the last map kept at `path`."""
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def rebalance(docs: DataFrame, map_path: str, shards: int, *, slots: int = SLOTS) -> DataFrame:
    """Edit the newest map kept at `map_path` for `docs` and `shards`, keep the result as the next version, return it.

    Records keep their slots, and only slots move, off shards above the new mean. So records that
    were there before stay where they are unless their slot moves, and one shard more takes slots
    but gives none away.
    """
    spark = docs.sparkSession
    version = newest_version(spark, map_path)
    old = [r["shard"] for r in read_map(spark, map_path, version).orderBy("slot").collect()]
    to = edited_map(old, slot_sizes(docs, slots=slots), shards)
    return write_map(spark, map_path, version + 1, to)


def with_shard(docs: DataFrame, slot_map: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """All columns of `docs` with `shard`; a column of that name is replaced. Nothing is shuffled.

    The map is broadcast: it has `slots` rows.
    """
    keyed = docs.drop("shard").withColumn("_vslot", slot_of(F.col("doc_id"), F.col("text"), slots))
    to = slot_map.select(F.col("slot").alias("_vslot"), "shard")
    return keyed.join(F.broadcast(to), "_vslot", "left").drop("_vslot")


def shard_documents(docs: DataFrame, shards: int, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Balance bytes over `shards`: first map of these documents, kept at `map_path` as version 0."""
    path = map_path or new_scratch_dir(docs.sparkSession, "slot-map")
    to = first_map(slot_sizes(docs, slots=slots), shards, slots=slots)
    return with_shard(docs, write_map(docs.sparkSession, path, 0, to), slots=slots)


def placed_records(docs: DataFrame, shards: int, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): size, text_crc32, virtual_slot, shard and `position`.

    Positions count from 0 without gaps in every shard: slot by slot, inside a slot by hash. Each
    slot is numbered by itself and starts at the sum of the slots before it, so no task numbers a
    whole shard. A null text counts as no bytes. Equal texts under different ids are treated like
    different texts, so a group of copies is spread over all slots. Rows equal in id and text share a
    slot, and therefore a shard, however many they are. No rows in, no rows out; other columns are not read.
    """
    spark = docs.sparkSession
    sizes = slot_sizes(docs, slots=slots)
    to = first_map(sizes, shards, slots=slots)
    write_map(spark, map_path or new_scratch_dir(spark, "slot-map"), 0, to)
    start, filled = {}, [0] * shards
    for slot, _, rows in sizes:
        start[slot] = filled[to[slot]]
        filled[to[slot]] += rows
    plan = literal_rows(
        spark, [{"virtual_slot": s, "shard": to[s], "_start": start[s]} for s in start],
        "virtual_slot int, shard int, _start bigint",
    )
    rows = docs.select(
        "doc_id", record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )
    order = Window.partitionBy("virtual_slot").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_k", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(plan), "virtual_slot", "left").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_k")).alias("position"), "virtual_slot"
    )
