"""Small hand-made flows."""

import datetime as dt

from wirevault import schemas

DEFAULTS = dict(
    ts=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), method="GET", scheme="https", host="h.example.com",
    port=None, path="/", query=None, url="https://h.example.com/", status=200, req_headers={}, resp_headers={},
    req_body=None, resp_body=None, duration_ms=1, program="p", source_tool="t", session_id="s", collapse=False,
    req_content_type="", resp_content_type="text/html", ingest_seq=None, replay_of=None,
)


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute, tzinfo=dt.timezone.utc)


def make(spark, *rows):
    """Normalised flows with ids 1, 2, ... unless given."""
    schema = schemas.extend(schemas.FLOW, id=schemas.LONG)
    full = []
    for n, row in enumerate(rows, 1):
        values = {**DEFAULTS, "id": n, **row}
        values["ingest_seq"] = values["ingest_seq"] or values["id"]
        for side in ("req_body", "resp_body"):
            if values[side] is not None:
                values[side] = bytearray(values[side])
        full.append(tuple(values[f.name] for f in schema))
    return spark.createDataFrame(full, schema)
