"""Import of a bodies table whose content column holds zstd frames.

Own tables need none of this: Parquet compresses pages. The import decodes Arrow batches
inside the tasks; a frame that does not decode follows the chosen fallback.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACKS = ("null", "raw", "empty")


def decode_zstd(content: Column, *, fallback: str = "raw") -> Column:
    """Decompressed bytes; undecodable input becomes null, itself or empty bytes."""
    if fallback not in FALLBACKS:
        raise ValueError(f"fallback must be one of {FALLBACKS}")

    @F.pandas_udf("binary")
    def decode(frames: pd.Series) -> pd.Series:
        import zstandard

        context = zstandard.ZstdDecompressor()

        def one(frame):
            if frame is None:
                return b"" if fallback == "empty" else None
            try:
                return context.decompress(bytes(frame))
            except zstandard.ZstdError:
                return {"null": None, "raw": bytes(frame), "empty": b""}[fallback]

        return frames.map(one)

    return decode(content)


def import_zstd_bodies(table: DataFrame, *, fallback: str = "raw") -> DataFrame:
    """``sha256, content`` from an exported table with columns ``sha256, content``."""
    return table.select("sha256", decode_zstd(F.col("content"), fallback=fallback).alias("content"))
