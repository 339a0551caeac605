"""Spark schemas of the input formats and of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, BYTES, FLAG, TIME = StringType(), BinaryType(), BooleanType(), TimestampType()
INT, LONG, REAL, DAY = IntegerType(), LongType(), DoubleType(), DateType()
TEXTS, HEADERS = ArrayType(TEXT), MapType(TEXT, TEXT)


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def extend(schema: StructType, **fields: DataType) -> StructType:
    return StructType([*schema.fields, *struct(**fields).fields])


# One JSONL capture line. `_corrupt` receives lines that do not fit.
JSONL_RECORD = struct(
    timestamp=TEXT,
    url=TEXT,
    request=struct(url=TEXT, raw_url=TEXT, header=HEADERS, headers=HEADERS, raw=TEXT),
    response=struct(header=HEADERS, headers=HEADERS, raw=TEXT),
    _corrupt=TEXT,
)

# One structured capture record, as exported by an intercepting proxy.
CAPTURE_RECORD = struct(
    request=struct(
        method=TEXT, scheme=TEXT, host=TEXT, port=INT, url=TEXT, headers=HEADERS,
        timestamp_start=REAL, body=BYTES,
    ),
    response=struct(status_code=INT, headers=HEADERS, timestamp_end=REAL, body=BYTES),
)

# A normalised flow, both bodies inline: what every source produces.
FLOW = struct(
    ts=TIME, method=TEXT, scheme=TEXT, host=TEXT, port=INT, path=TEXT, query=TEXT, url=TEXT,
    status=INT, req_headers=HEADERS, resp_headers=HEADERS, req_body=BYTES, resp_body=BYTES,
    duration_ms=INT, program=TEXT, source_tool=TEXT, session_id=TEXT, collapse=FLAG,
    req_content_type=TEXT, resp_content_type=TEXT, ingest_seq=LONG, replay_of=LONG,
)

STORED_FLOW = struct(
    id=LONG, ts=TIME, program=TEXT, source_tool=TEXT, session_id=TEXT, method=TEXT, scheme=TEXT,
    host=TEXT, port=INT, path=TEXT, query=TEXT, url=TEXT, status=INT, req_headers=HEADERS,
    resp_headers=HEADERS, req_body_sha=TEXT, resp_body_sha=TEXT, duration_ms=INT,
    fingerprints=TEXTS, replay_of=LONG,
)

# Mergeable counters of one body: sums, minima and "value at the first observation".
BODY_STATS = struct(
    sha256=TEXT, size=INT, is_text=FLAG, ever_text=FLAG, seen_count=LONG, first_seen=TIME,
    first_seq=LONG,
)
# A body as stored in the batch that saw it first, with its text flags in that batch.
BODY_CONTENT = struct(sha256=TEXT, size=INT, is_text=FLAG, ever_text=FLAG, content=BYTES)
BODY_TEXT = struct(sha256=TEXT, tokens=TEXTS)
BODY_WORDS = struct(word=TEXT, run=INT, keys=TEXTS)
# Tags that flows without one were given later, for the flow files of one generation.
FLOW_TAGS = struct(id=LONG, fingerprints=TEXTS, base=LONG, n=LONG, dt=DAY)

HOT_BODIES = struct(sha256=TEXT, salts=INT)

# Mergeable counters of one request shape. `first_id` orders equal timestamps.
SHAPE_STATS = struct(
    shape_sha=TEXT, program=TEXT, source_tool=TEXT, method=TEXT, host=TEXT, path=TEXT, status=INT,
    resp_body_sha=TEXT, hit_count=LONG, first_seen=TIME, last_seen=TIME, first_id=LONG,
)

RETURNED = struct(key=TEXT, id=LONG)

DEAD_LETTER = struct(source=TEXT, raw=TEXT, reason=TEXT, ingest_ts=TIME)

MUTATION = struct(
    flow_id=LONG, method=TEXT, url=TEXT, set_headers=HEADERS, unset_headers=TEXTS, body=BYTES
)

# Bookkeeping of an archive: one row per batch, snapshot or generation.
REGISTRY = struct(upto=LONG, last_id=LONG, written=LONG, rejected=LONG, rules=TEXTS, kind=TEXT, n=LONG)
