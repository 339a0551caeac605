"""Flow details: rehydrated requests, both bodies, listings and replay lines.

All of them take any selection of stored flows; the bodies come by a left join on their
keys, which `operators.bodies.join_bodies` keeps balanced.
"""

from __future__ import annotations

from http.client import responses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import header_lines, or_empty
from ..functions.jsontext import pretty_json
from ..functions.text import shell_quote, utf8_text
from ..session import stored_once
from .bodies import join_bodies
from .joins import BROADCAST_ROWS
from .search import iso_time

# Fixed value: characters of a body preview.
PREVIEW_CHARS = 4000
# Most bytes of bodies that a join broadcasts.
BROADCAST_BYTES = 16 << 20


def load_requests(flows: DataFrame, bodies: DataFrame, *, hot: DataFrame | None = None) -> DataFrame:
    """The request of each flow, ready for replay, with its body as ``req_body``.

    Most bodies are responses. Those that the flows sent are named first, by up to `BROADCAST_ROWS` narrow rows, and
    only their content moves; if it is small, it goes to the flows, which stay where they are.
    """
    content = bodies.select("sha256", F.col("content").alias("req_body"))
    narrow = flows.select(
        "id", "ts", "method", "scheme", "host", "port", "path", "query", "url", "status",
        or_empty(F.col("req_headers")).alias("req_headers"), "req_body_sha",
    )
    sent, rows = stored_once(narrow.select(F.col("req_body_sha").alias("sha256")).where("sha256 IS NOT NULL").distinct(), "sent")
    if rows <= BROADCAST_ROWS:
        content = content.join(F.broadcast(sent), "sha256", "left_semi")
        size = content.agg(F.coalesce(F.sum(F.octet_length("req_body")), F.lit(0))).first()[0]
        if size <= BROADCAST_BYTES:
            return join_bodies(narrow, content, "req_body_sha", rows=rows).drop("req_body_sha")
    return join_bodies(narrow, content, "req_body_sha", hot=hot).drop("req_body_sha")


def load_full(flows: DataFrame, bodies: DataFrame, *, hot: DataFrame | None = None) -> DataFrame:
    """Each flow with both bodies and their text flags."""
    full = flows.select(
        "id", "ts", "program", "source_tool", "session_id", "method", "scheme", "host", "port",
        "path", "query", "url", "status", "duration_ms", "fingerprints", "req_headers",
        "resp_headers", "req_body_sha", "resp_body_sha",
    )
    for side in ("req", "resp"):
        content = bodies.select(
            "sha256", F.col("content").alias(f"{side}_body"), F.col("is_text").alias(f"{side}_is_text")
        )
        full = join_bodies(full, content, f"{side}_body_sha", hot=hot)
    return full.drop("req_body_sha", "resp_body_sha")


def body_variant(content: Column, is_text: Column) -> Column:
    """``struct<kind, size, text>`` with kind ``empty``, ``binary`` or ``text``."""
    size = F.octet_length(content)
    text = F.when(is_text, utf8_text(content))
    kind = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(is_text, "text").otherwise("binary")
    return F.struct(
        kind.alias("kind"),
        F.when(kind != "empty", size).alias("size"),
        F.when(kind == "text", text).alias("text"),
    )


def flow_details(flows: DataFrame, bodies: DataFrame, *, hot: DataFrame | None = None) -> DataFrame:
    """Detail records: ISO time, tags as ``tech``, never-null headers, bodies as variants."""
    return load_full(flows, bodies, hot=hot).select(
        "id", iso_time(F.col("ts")).alias("ts"), "program", "source_tool", "session_id", "method",
        "host", "path", "query", "url", "status", "duration_ms", F.col("fingerprints").alias("tech"),
        or_empty(F.col("req_headers")).alias("req_headers"),
        or_empty(F.col("resp_headers")).alias("resp_headers"),
        body_variant(F.col("req_body"), F.col("req_is_text")).alias("req_body"),
        body_variant(F.col("resp_body"), F.col("resp_is_text")).alias("resp_body"),
    )


def listing_line() -> Column:
    """One line per flow: id, minute, status, method, tags and URL."""
    tags = F.when(F.size("fingerprints") > 0, F.array_join("fingerprints", ",")).otherwise("-")
    return F.format_string(
        "#%-8d %s %3s %-6s [%s] %s",
        F.col("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.coalesce(F.col("status").cast("string"), F.lit("None")),
        F.col("method"),
        tags,
        F.col("url"),
    )


def flow_listing(flows: DataFrame) -> DataFrame:
    return flows.select("id", listing_line().alias("line"))


def has_bytes(content: Column) -> Column:
    return F.coalesce(F.octet_length(content), F.lit(0)) > 0


def curl_line() -> Column:
    """Replay command of a rehydrated request; a body is read from standard input."""
    head = F.concat(
        F.lit("curl -sk -X "), F.col("method"), F.lit(" "), shell_quote(F.col("url"))
    )
    options = F.transform(
        header_lines(F.col("req_headers"), skip=("content-length",)),
        lambda line: F.concat(F.lit("-H "), shell_quote(line)),
    )
    stdin = F.when(
        has_bytes(F.col("req_body")), F.array(F.lit("--data-binary @-"))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), options, stdin), " ")


def request_text() -> Column:
    """Raw-looking text of a rehydrated request: start line, host, other headers, body."""
    target = F.concat(
        F.col("path"), F.when(F.coalesce("query", F.lit("")) != "", F.concat(F.lit("?"), "query")).otherwise("")
    )
    lines = F.concat(
        F.array(
            F.concat(F.col("method"), F.lit(" "), target, F.lit(" HTTP/2")),
            F.concat(F.lit("host: "), F.col("host")),
        ),
        header_lines(F.col("req_headers"), skip=("host",)),
    )
    text = F.col("req_body").cast("string")
    shown = F.when(F.is_valid_utf8(text), text).otherwise(
        F.concat(F.lit("<"), F.octet_length("req_body").cast("string"), F.lit(" bytes binary body>"))
    )
    body = F.when(has_bytes(F.col("req_body")), F.concat(F.lit("\n\n"), shown)).otherwise("")
    return F.concat(F.array_join(lines, "\n"), body)


def body_preview(content: Column, is_text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Readable preview: a mark for empty and binary bodies, indented JSON, cut to ``limit``."""
    size = F.octet_length(content).cast("string")
    text = utf8_text(content)
    # Python UDFs run for all rows of a CASE, so rows that are not JSON pass null.
    json_text = F.when(is_text & text.rlike(r"^\s*[{\[]"), text)
    shown = F.coalesce(pretty_json(json_text), text)
    cut = F.when(
        F.length(shown) > limit,
        F.concat(
            F.substring(shown, 1, limit), F.lit("\n... [truncated, "), size, F.lit(" bytes total]")
        ),
    ).otherwise(shown)
    return (
        F.when(~has_bytes(content), "(no body)")
        .when(~F.coalesce(is_text, F.lit(False)), F.concat(F.lit("<binary, "), size, F.lit(" bytes>")))
        .otherwise(cut)
    )


def status_line() -> Column:
    """Status with its standard reason phrase, empty for unknown codes."""
    phrases = F.create_map(*(F.lit(x) for code, phrase in responses.items() for x in (int(code), phrase)))
    return F.concat(
        F.lit("HTTP/1.1 "),
        F.coalesce(F.col("status").cast("string"), F.lit("None")),
        F.lit(" "),
        F.coalesce(F.try_element_at(phrases, F.coalesce("status", F.lit(0))), F.lit("")),
    )


def flow_previews(
    flows: DataFrame, bodies: DataFrame, *, limit: int = PREVIEW_CHARS, hot: DataFrame | None = None
) -> DataFrame:
    """Status line and both body previews of each flow."""
    return load_full(flows, bodies, hot=hot).select(
        "id",
        status_line().alias("status_line"),
        body_preview(F.col("req_body"), F.col("req_is_text"), limit).alias("req_preview"),
        body_preview(F.col("resp_body"), F.col("resp_is_text"), limit).alias("resp_preview"),
    )
