"""Lookup joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most rows of keys and flags that a join broadcasts: some 20 MB.
BROADCAST_ROWS = 200_000


def hot_keys(counts: DataFrame, key: str, n: str, *, share: int = 1000, floor: int = 1_000_000) -> DataFrame:
    """``key, salts`` of the keys whose rows need splitting in a join.

    ``counts`` has one row per key with its number of rows ``n``. A key is hot when it holds
    at least ``1/share`` of all rows, so there are at most ``share`` hot keys however large
    the input is. That bound is what makes the list safe to broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).scalar()
    limit = F.greatest(F.lit(floor), F.ceil(total / share))
    return counts.where(F.col(n) >= limit).select(
        F.col(key), F.ceil(F.col(n) / limit).cast("int").alias("salts")
    )


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    *,
    table_key: str,
    table_rows: int | None = None,
    hot: DataFrame | None = None,
    row_id: str = "id",
) -> DataFrame:
    """Left join ``rows`` to ``table``, which has unique ``table_key`` plus payload columns.

    With a known number of ``table_rows`` of a narrow payload, up to `BROADCAST_ROWS` of them
    are broadcast and the rows stay where they are. Otherwise both sides are shuffled, whatever the size of the
    table's files lets Spark expect (packed flows of some 6 bytes in a file are 200 in a broadcast):

    * Rows without a key get a filler key of their own, so that they spread over all tasks
      instead of meeting in the one that owns null. Keys are compared as text for that.
    * With ``hot`` (``table_key, salts`` from `hot_keys`) the rows of a hot key are split
      over several salts, and that key's payload is repeated once per salt. Without it,
      splitting is left to adaptive execution.
    """
    right = table.withColumn("_key", F.col(table_key).cast("string")).drop(table_key)
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
    filler = F.concat(F.lit("none:"), F.col(row_id).cast("string"))
    left = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), filler))
    on = ["_key"]
    if hot is not None:
        spread = F.broadcast(
            hot.select(F.col(table_key).cast("string").alias("_key"), F.col("salts").alias("_salts"))
        )
        left = left.join(spread, "_key", "left").withColumn(
            "_salt",
            F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"), F.lit(0)),
        )
        right = right.join(spread, "_key", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
        )
        left, right = left.drop("_salts"), right.drop("_salts")
        on = ["_key", "_salt"]
    return left.join(right.hint("merge"), on, "left").drop(*on)
