"""What all sources share: place of arrival, and good records versus dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of arrival of file records: file time, file, split. Within a split, row order.
ARRIVAL = ("src_time", "src_file", "src_split")


def arrival_columns() -> list[Column]:
    """Columns that order the records of file sources by arrival."""
    return [
        F.col("_metadata.file_modification_time").alias("src_time"),
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_split"),
    ]


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("raw", "reason")


def dead_letters(parsed: DataFrame, *, source: str, ingest_ts: Column | None = None) -> DataFrame:
    """Rejected records in the shape of `schemas.DEAD_LETTER`."""
    return parsed.where(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"),
        "raw",
        "reason",
        (F.current_timestamp() if ingest_ts is None else ingest_ts).alias("ingest_ts"),
    )
