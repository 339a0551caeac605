"""What several operators share: words, scratch tables, bounded literals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_scratch_dir, shuffles_dropped

# Fixed value: the six ASCII blanks that part words.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table into the shared scratch folder and read it again.

    It cuts the lineage: executors lost later cost a read, not the work before it. So the shuffle files of
    that work go at once.
    """
    path = new_scratch_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of few rows known to the driver, as one parsed literal."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))
