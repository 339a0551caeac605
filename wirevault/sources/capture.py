"""Structured capture records: request and response structs with decoded bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import header_any_case, or_empty
from ..functions.messages import bad_clocks, duration_ms, epoch_micros
from ..functions.text import non_empty
from ..functions.urls import split_url
from ..schemas import CAPTURE_RECORD
from .common import arrival_columns

# Fixed value: the source name stored with flows of this format.
SOURCE_TOOL = "mitm"


def read_capture(spark: SparkSession, path: str | list[str], *, format: str = "parquet") -> DataFrame:
    """Exported records (Parquet, ORC or JSON with base64 bodies) with their place of arrival."""
    records = spark.read.schema(CAPTURE_RECORD).format(format).load(path)
    return records.select("request", "response", *arrival_columns())


def stream_capture(
    spark: SparkSession, folder: str, *, format: str = "parquet", max_files_per_trigger: int = 200
) -> DataFrame:
    reader = spark.readStream.schema(CAPTURE_RECORD).format(format)
    records = reader.option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
    return records.select("request", "response", *arrival_columns())


def parse_capture(
    records: DataFrame,
    *,
    program: str | None = None,
    session_id: str | None = None,
    source_tool: str = SOURCE_TOOL,
    collapse: bool = False,
) -> DataFrame:
    """Normalise records: the columns of `schemas.FLOW` (but ``ingest_seq``) plus ``raw, reason``.

    A record without the columns that a stored flow must have is rejected with a reason.
    """
    kept = [c for c in records.columns if c not in ("request", "response")]
    req, resp = F.col("request"), F.col("response")
    parts = split_url(req["url"])
    lacking = F.lit(False)
    for name in ("method", "scheme", "host", "url"):
        lacking = lacking | req[name].isNull()
    reason = F.when(lacking, "missing_field").when(
        F.coalesce(parts["bad_authority"], F.lit(False)), "bad_url"
    ).when(bad_clocks(req["timestamp_start"], resp["timestamp_end"]), "bad_time")

    def content_type(message: Column) -> Column:
        return F.coalesce(header_any_case(message["headers"], "content-type"), F.lit(""))

    described = F.struct(req["method"].alias("method"), req["url"].alias("url"), req["host"].alias("host"))
    return records.select(
        *kept,
        F.timestamp_micros(epoch_micros(req["timestamp_start"])).alias("ts"),
        req["method"].alias("method"),
        req["scheme"].alias("scheme"),
        req["host"].alias("host"),
        req["port"].alias("port"),
        F.coalesce(non_empty(parts["path"]), F.lit("/")).alias("path"),
        parts["query"].alias("query"),
        req["url"].alias("url"),
        resp["status_code"].alias("status"),
        or_empty(req["headers"]).alias("req_headers"),
        or_empty(resp["headers"]).alias("resp_headers"),
        req["body"].alias("req_body"),
        resp["body"].alias("resp_body"),
        duration_ms(req["timestamp_start"], resp["timestamp_end"]).alias("duration_ms"),
        F.lit(program).cast("string").alias("program"),
        F.lit(source_tool).alias("source_tool"),
        F.lit(session_id).cast("string").alias("session_id"),
        F.lit(collapse).alias("collapse"),
        content_type(req).alias("req_content_type"),
        content_type(resp).alias("resp_content_type"),
        F.lit(None).cast("bigint").alias("replay_of"),
        F.when(reason.isNotNull(), F.to_json(described)).alias("raw"),
        reason.alias("reason"),
    )
