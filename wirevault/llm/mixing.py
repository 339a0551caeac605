"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash, so its blocks are in random order from the start. A
source's quota is whole passes over its blocks and the blocks that its remaining words reach into.
A binary tree over the output shards splits the exact quotas: at each node the left half draws its
blocks from all sources by a multivariate hypergeometric law, the right half keeps the rest. The
leaves are disjoint runs of each source's blocks; inside a shard, rows are ordered by a hash.
Sources, weights and quotas are as few as the sources; blocks and documents stay in Spark.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import literal_rows, stored, words

CAP = 3
BLOCK_DOCS = 256
BLOCKS_ABOVE = 1000
SHARDS = 16
SEED = 17


def _source_key(source: Column) -> Column:
    """A text that is never null, so that documents without a source join as one source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sizes: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Per source (`source, source_size`): `weight` and `target` words.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all words by weight.
    Sources that would pass `cap` times their own size stop there, and the rest is shared anew:
    taken by falling need of more, a source is capped if the level left for it still passes its
    cap. The window runs over one row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(place) - 1) % 3 + 1)
    limit = (F.lit(cap) * F.col("source_size")).cast("double")
    before = Window.orderBy("_reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    levels = (
        weighed.withColumn("_limit", limit)
        .withColumn("_reach", limit / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
                    / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("_final", F.min(F.when(F.col("_reach") > F.col("_level"), F.struct("_reach", "_level"))).over(every))
    )
    share = F.col("weight") * F.col("_final._level")
    return levels.select(
        "source", "source_size", "weight",
        F.when(F.col("_final").isNull() | (F.col("_limit") <= share), F.col("_limit")).otherwise(share).alias("target"),
    )


def split_quotas(quotas: list[int], shards: int, *, seed: int = SEED) -> list[list[int]]:
    """Exact whole-number quotas per shard (row) and source; each column sums up to its quota."""
    out: list[list[int]] = []

    def node(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out.append([int(x) for x in left])
            return
        mid = (lo + hi) // 2
        draws = int(left.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        taken = np.zeros_like(left)
        remaining, open_draws = int(left.sum()), draws
        for k, count in enumerate(left):  # one source after the other: the law's marginals
            remaining -= int(count)
            taken[k] = rng.hypergeometric(int(count), remaining, open_draws) if open_draws and count else 0
            open_draws -= int(taken[k])
        node(taken, lo, mid)
        node(left - taken, mid, hi)

    node(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def mixed(
    docs: DataFrame,
    *,
    cap: int = CAP,
    shards: int = SHARDS,
    block_docs: int = BLOCK_DOCS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): `size`, `source_size`, `target` and `draws`.

    `draws` lists what the mix takes of the row: shard, epoch, words, and `order`, by which the draws
    of a shard are shuffled. All but one document of a source are taken whole in every epoch; the one at the end of the quota gives its first words
    only, so that a source's words meet its rounded target. `carry` names input columns to keep.
    Words of a null text are 0; documents without a source are a source of their own; equal rows
    are drawn like different ones. No rows in, no rows out. Columns not named are not read.
    """
    spark = docs.sparkSession
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.col("text"))))
    rows = docs.select(
        F.struct("doc_id", *carry).alias("_row"),
        _source_key(F.col("source")).alias("_key"), F.col("source").alias("_source"),
        F.size(words(F.col("text"))).cast("long").alias("_size"), place.alias("_place"),
    )
    by_source = stored(
        rows.groupBy("_key").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs"), F.first("_source").alias("source")),
        "mix-sources",
    )
    plan = stored(
        source_targets(by_source.select("source", "source_size"), cap=cap)
        .withColumn("_key", _source_key(F.col("source"))).drop("source")
        .join(by_source.select("_key", "_docs"), "_key")
        .select(
            "_key", "source_size", "target",
            F.ceil(F.col("_docs") / block_docs).cast("long").alias("_blocks"),
            F.round("target").cast("long").alias("_quota"),
        )
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("_rest", F.col("_quota") - F.col("_epochs") * F.col("source_size")),
        "mix-plan",
    )
    # One row per source: the mix's own table of weights, which is what it is asked for.
    blocked = rows.drop("_source").join(F.broadcast(plan), "_key").withColumn(
        "_block", F.pmod(F.conv(F.substring("_place", 1, 8), 16, 10).cast("long"), F.col("_blocks"))
    )
    sums = blocked.groupBy("_key", "_block").agg(F.sum("_size").alias("_words"))
    group = F.expr(f"_block div {BLOCKS_ABOVE}")
    inner = Window.partitionBy("_key", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_key").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    grouped = stored(sums.withColumn("_group", group), "mix-blocks")
    groups = grouped.groupBy("_key", "_group").agg(F.sum("_words").alias("_all")).withColumn(
        "_before_group", F.coalesce(F.sum("_all").over(outer), F.lit(0).cast("long"))
    )
    starts = stored(
        grouped.withColumn("_in", F.coalesce(F.sum("_words").over(inner), F.lit(0).cast("long")))
        .join(groups.select("_key", "_group", "_before_group"), ["_key", "_group"])
        .select("_key", "_block", (F.col("_in") + F.col("_before_group")).alias("_start"))
        .join(F.broadcast(plan.select("_key", "_epochs", "_rest", "_blocks")), "_key"),
        "mix-starts",
    )
    quotas = sorted(
        tuple(r) for r in starts.groupBy("_key").agg(
            F.sum(F.col("_epochs") + F.when(F.col("_start") < F.col("_rest"), 1).otherwise(0))
        ).collect()
    )
    parts = np.cumsum(np.array(split_quotas([q for _, q in quotas], shards, seed=seed), dtype=np.int64), axis=0)
    ends = literal_rows(
        spark, [{"_key": key, "_ends": parts[:, k].tolist()} for k, (key, _) in enumerate(quotas)],
        "_key string, _ends array<bigint>",
    )

    def drawn(epoch: Column, block: Column) -> Column:
        turn = epoch * F.col("_blocks") + block
        return F.struct(epoch.alias("epoch"), F.size(F.filter("_ends", lambda e: e <= turn)).alias("shard"))

    def order(t: Column) -> Column:
        return F.xxhash64(F.lit(seed), t["shard"], t["epoch"], F.col("_place"))

    epochs = F.sequence(F.lit(0).cast("long"), F.col("_epochs"))
    last = F.when(F.col("_start") < F.col("_rest"), F.col("_epochs")).otherwise(F.col("_epochs") - 1)
    turns = starts.join(F.broadcast(ends), "_key").select(
        "_key", "_block", "_start",
        F.transform(F.filter(epochs, lambda e: e <= last), lambda e: drawn(e, F.col("_block"))).alias("_turns"),
    )
    within = Window.partitionBy("_key", "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_start") - F.coalesce(F.sum("_size").over(within), F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left))
    placed = blocked.join(turns, ["_key", "_block"]).withColumn("_part", part)
    draws = F.filter(
        F.transform("_turns", lambda t: F.struct(
            t["shard"].alias("shard"), t["epoch"].alias("epoch"), order(t).alias("order"),
            F.when(t["epoch"] < F.col("_epochs"), F.col("_size")).otherwise(F.col("_part")).alias("words"),
        )),
        lambda d: d["words"] > 0,
    )
    return placed.select("_row.*", F.col("_size").alias("size"), "source_size", "target", draws.alias("draws"))


def mixture(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The documents as the mix draws them: all columns of `docs`, once per draw, in random order.

    A cut document keeps its first words, parted by single blanks, and a column `n_chars` follows.
    Added are `_shard` and `_order`: within a shard, rows sorted by `_order` are shuffled.
    """
    columns = docs.columns
    carry = tuple(c for c in columns if c != "doc_id")
    rows = mixed(docs.withColumnsRenamed({c: f"_c_{c}" for c in carry if c not in ("text", "source")}), seed=seed,
                 carry=tuple(c if c in ("text", "source") else f"_c_{c}" for c in carry), **options)
    drawn = rows.withColumn("_draw", F.explode("draws"))
    cut = F.col("_draw.words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("_draw.words").cast("int")), " ")).otherwise(F.col("text"))
    named = {c: F.col(c if c in ("doc_id", "text", "source") else f"_c_{c}") for c in columns}
    named["text"] = text
    if "n_chars" in named:
        kind = docs.schema["n_chars"].dataType
        named["n_chars"] = F.when(cut, F.length(text).cast(kind)).otherwise(named["n_chars"])
    return drawn.select(
        *(named[c].alias(c) for c in columns), F.col("_draw.shard").alias("_shard"), F.col("_draw.order").alias("_order")
    )


def shuffled(draws: DataFrame) -> DataFrame:
    """The result of `mixture` as it is to be written: shard after shard, each in its local order."""
    order = ["_shard", "_order"]
    return draws.repartitionByRange(*order).sortWithinPartitions(*order)
