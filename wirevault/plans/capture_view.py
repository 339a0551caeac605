"""Captured traffic derived from the test tables.

Every event becomes one request/response record: its URL comes from ``pages``, its response
body from ``documents``. One SELECT text serves Spark and the SQL oracle alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_empty
from ..functions.urls import split_url
from ..operators.joins import BROADCAST_ROWS

# Flat columns of every captured record. Header columns are null where the header is absent.
CAPTURE_SQL = """
SELECT k.event_id AS id, k.ts,
  concat('prog-', CAST(k.user_id % 5 AS STRING)) AS program,
  concat('s-', CAST(k.user_id AS STRING)) AS session_id,
  CASE WHEN k.event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  p.url AS url,
  CASE WHEN k.event_type <> 'error' THEN 200 WHEN k.event_id % 5 = 0 THEN 403
       WHEN k.event_id % 5 = 1 THEN 406 WHEN k.event_id % 5 = 2 THEN 419
       WHEN k.event_id % 5 = 3 THEN 500 END AS status,
  CASE WHEN k.hk = 1 THEN 'nginx/1.25' WHEN k.hk = 2 THEN 'Apache' WHEN k.hk = 3 THEN 'AkamaiGHost'
       WHEN k.hk = 4 THEN 'cloudflare' END AS h_server,
  CASE WHEN k.hk = 5 THEN '1.1 abc.CloudFront.net' END AS h_via,
  CASE WHEN k.hk = 6 THEN 'BIGipServerPool=1; path=/' END AS h_set_cookie,
  CASE WHEN k.hk = 7 THEN 'X-AspNet-Version' WHEN k.hk = 8 THEN 'X-Vhost' WHEN k.hk = 9 THEN 'CF-RAY'
       WHEN k.hk = 10 THEN 'X-Akamai-Request-ID' WHEN k.hk = 11 THEN 'X-Proxy' END AS h_extra_name,
  CASE WHEN k.hk = 7 THEN '4.0' WHEN k.hk = 8 THEN 'dispatcher-1' WHEN k.hk = 11 THEN 'Apigee'
       WHEN k.hk BETWEEN 9 AND 10 THEN 'v' END AS h_extra_value,
  CASE WHEN d.doc_id % 4 = 3 THEN 'image/png' WHEN d.doc_id % 4 = 2 THEN 'application/json'
       ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN k.user_id % 10 = 9 THEN NULL
       WHEN d.doc_id % 11 = 1 THEN concat('Access Denied ', d.text)
       WHEN d.doc_id % 11 = 2 THEN concat('{"errors":[{"message":"GraphQL"}]} ', d.text)
       WHEN d.doc_id % 11 = 3 THEN concat('{"fault":1} ', d.text) ELSE d.text END AS resp_text,
  CASE WHEN k.event_type = 'purchase' THEN k.props END AS req_text,
  CASE WHEN k.event_id % 17 = 0 AND k.event_id > 0 THEN k.event_id - 17 END AS replay_of,
  CAST(floor(k.value * 10) AS INT) AS duration_ms
FROM (SELECT e.*, e.event_id % (SELECT count(*) FROM pages) AS page_key,
             e.event_id % (SELECT count(*) FROM documents) AS doc_key,
             e.event_id % 13 AS hk
      FROM events e) k
JOIN pages p ON p.page_id = k.page_key
JOIN documents d ON d.doc_id = k.doc_key
"""


def _more(ids: DataFrame | None) -> list[str]:
    return [n for n in ids.columns if n != "id"] if ids is not None else []


def captured(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The flat records of `CAPTURE_SQL`; with ``ids`` (a column ``id``) those of these events only.

    The choice is joined to the narrow events, so no text takes part in it. Further columns of ``ids`` come along.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "pages", "documents")}
    cores = spark.sparkContext.defaultParallelism
    if tables["events"].rdd.getNumPartitions() < cores:
        # A small events file is one split. Spread its narrow rows before texts are joined to them.
        tables["events"] = tables["events"].repartition(cores)
    if tables["pages"].count() <= BROADCAST_ROWS:  # of pages, only ids and URLs take part
        tables["pages"] = F.broadcast(tables["pages"].select("page_id", "url"))
    if ids is not None:
        chosen = ids.withColumnRenamed("id", "_chosen")
        tables["events"] = tables["events"].join(chosen, F.col("event_id") == F.col("_chosen")).drop("_chosen")
    sql = CAPTURE_SQL
    more = _more(ids)
    if more:
        sql = sql.replace("AS id,", f"AS id, {', '.join(f'k.{n}' for n in more)},", 1)
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    # Curly braces of the literal bodies are doubled for the parameter markers of spark.sql.
    sql = sql.replace('{"', '{{"').replace('"}]}', '"}}]}}').replace(":1}", ":1}}")
    return spark.sql(sql, **tables)


def _headers(*pairs) -> Column:
    entries = F.array(
        *(
            F.struct((F.lit(n) if isinstance(n, str) else n).alias("key"), v.alias("value"))
            for n, v in pairs
        )
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def capture_flows(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The records as normalised flows (`schemas.FLOW`) that keep the event id as ``id``; see `captured`."""
    c = captured(spark, sf_dir, ids)
    parts = split_url(F.col("url"))
    has_body = F.col("req_text").isNotNull()
    return c.select(
        "id", "ts", "method",
        parts["scheme"].alias("scheme"),
        F.coalesce(parts["host"], F.lit("")).alias("host"),
        parts["port"].alias("port"),
        F.coalesce(non_empty(parts["path"]), F.lit("/")).alias("path"),
        parts["query"].alias("query"),
        "url", "status",
        _headers(
            ("Host", F.coalesce(parts["host"], F.lit(""))),
            ("Accept", F.lit("*/*")),
            ("Cookie", F.concat(F.lit("sid='"), F.col("session_id"), F.lit("'"))),
            ("Content-Type", F.when(has_body, "application/json")),
            ("Content-Length", F.length("req_text").cast("string")),
        ).alias("req_headers"),
        _headers(
            ("Server", F.col("h_server")), ("Via", F.col("h_via")), ("Set-Cookie", F.col("h_set_cookie")),
            (F.coalesce("h_extra_name", F.lit("-")), F.col("h_extra_value")),
        ).alias("resp_headers"),
        F.col("req_text").cast("binary").alias("req_body"),
        F.col("resp_text").cast("binary").alias("resp_body"),
        "duration_ms", "program",
        F.lit("replay").alias("source_tool"),
        "session_id", F.lit(False).alias("collapse"),
        F.when(has_body, "application/json").otherwise("").alias("req_content_type"),
        F.col("content_type").alias("resp_content_type"),
        F.col("id").alias("ingest_seq"),
        "replay_of", *_more(ids),
    )
