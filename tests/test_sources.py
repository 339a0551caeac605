"""Capture formats to normalised flows."""

import datetime as dt
import json

import zstandard
from pyspark.sql import functions as F

from wirevault import schemas
from wirevault.sources.capture import parse_capture, read_capture
from wirevault.sources.common import dead_letters, good_records
from wirevault.sources.jsonl import parse_jsonl, read_jsonl
from wirevault.sources.zstd_bodies import import_zstd_bodies

NOW = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)

GOOD = [
    {
        "timestamp": "2024-01-01T00:00:00Z", "url": "https://U:p@Api.Example.com:8443/v1?x=1#f",
        "request": {"header": {"method": "PUT", "path": "/ignored", "host": "no", "scheme": "http", "A": "1", "L": ["x", "y"]},
                    "raw": "PUT /v1 HTTP/1.1\r\n\r\n{\"k\": 1}\r\n\r\nrest"},
        "response": {"headers": {"content-type": "text/html"}, "header": {}, "raw": "HTTP/1.1 404 Not Found\nA: b\n\nbody"},
    },
    {"request": {"raw_url": "/only/path?", "header": {"host": "pseudo.org:99", "scheme": "ftp"}, "url": ""}},
    {"url": "", "request": None, "response": None, "timestamp": "yesterday"},
    {"url": "http://a_b.org", "request": {"header": {"path": "/p"}, "raw": "no separator"},
     "response": {"header": {"Content-Type": "", "content-type": "x/json"}, "raw": "HTTP/1.1 OK\r\n\r\n"}},
]
BAD = ["not json", "[1]", "3", '"text"', "null", '{"url": 1', json.dumps({"url": "http://h:port/"}),
       json.dumps({"url": "http://[::1/"}), json.dumps({"request": "text"})]
DROPPED = ["", "   \t", json.dumps({"url": "h:443", "request": {"header": {"method": "CONNECT"}}})]


def test_jsonl(spark, tmp_path):
    lines = [json.dumps(g) for g in GOOD] + BAD + DROPPED
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    parsed = parse_jsonl(read_jsonl(spark, str(tmp_path)), program="p", session_id="s", collapse=True, ingest_ts=F.lit(NOW))
    letters = dead_letters(parsed, source="jsonl", ingest_ts=F.lit(NOW))
    assert letters.schema.names == schemas.DEAD_LETTER.names
    assert sorted(r.raw for r in letters.collect()) == sorted(BAD)
    reasons = {r.raw: r.reason for r in letters.collect()}
    assert reasons["not json"] == "bad_json" and reasons["[1]"] == "not_a_record" and reasons[BAD[6]] == "bad_url"

    flows = {r.url: r for r in good_records(parsed).collect()}
    assert len(flows) == len(GOOD)
    a = flows[GOOD[0]["url"]]
    assert (a.method, a.scheme, a.host, a.port, a.path, a.query, a.status) == ("PUT", "https", "api.example.com", 8443, "/v1", "x=1", 404)
    assert a.req_headers == {"A": "1", "L": '["x","y"]'} and a.resp_content_type == "text/html"
    assert bytes(a.req_body) == b'{"k": 1}\r\n\r\nrest' and bytes(a.resp_body) == b"body"
    assert (a.program, a.session_id, a.source_tool, a.collapse) == ("p", "s", "proxify", True)
    b = flows["/only/path?"]
    assert (b.method, b.scheme, b.host, b.path, b.query) == ("GET", "ftp", "pseudo.org", "/only/path", None)
    c = flows[""]
    assert (c.scheme, c.host, c.path, c.status, c.req_headers) == ("https", "", "/", None, {})
    d = flows["http://a_b.org"]
    assert (d.host, d.path, d.status, d.req_body, d.resp_body, d.resp_content_type) == ("a_b.org", "/p", None, None, None, "x/json")
    stamps = good_records(parsed).select("url", (F.col("ts") == F.lit(NOW)).alias("now")).collect()
    assert {r.url for r in stamps if r.now} == set(flows) - {GOOD[0]["url"]}


def test_capture(spark, tmp_path):
    rows = [
        (("GET", "https", "h.org", 443, "https://h.org/a?b", {"CONTENT-TYPE": "text/plain"}, 1704164645.5, bytearray(b"\xff\x00")),
         (200, {"Content-Type": "text/html"}, 1704164645.7509, bytearray(b""))),
        (("GET", "http", "h.org", 80, "http://h.org", None, None, None), None),
        ((None, "http", "h.org", 80, "http://h.org/x", {}, 1.0, None), None),
        (("GET", "http", "h.org", 80, "http://h.org:x/", {}, 1.0, None), None),
    ]
    spark.createDataFrame(rows, schemas.CAPTURE_RECORD).write.parquet(str(tmp_path / "c"))
    parsed = parse_capture(read_capture(spark, str(tmp_path / "c")), program="p")
    flows = {r.url: r for r in good_records(parsed).collect()}
    a, b = flows["https://h.org/a?b"], flows["http://h.org"]
    assert (a.path, a.query, a.status, a.duration_ms) == ("/a", "b", 200, 250)
    assert (bytes(a.req_body), bytes(a.resp_body)) == (b"\xff\x00", b"")
    assert (a.req_content_type, a.resp_content_type, a.source_tool) == ("text/plain", "text/html", "mitm")
    assert (b.path, b.query, b.status, b.duration_ms, b.req_headers, b.resp_headers) == ("/", None, None, None, {}, {})
    epochs = good_records(parsed).select("url", F.unix_micros("ts").alias("t")).collect()
    assert {r.url: r.t for r in epochs} == {"https://h.org/a?b": 1704164645500000, "http://h.org": 0}
    assert sorted(r.reason for r in dead_letters(parsed, source="c").collect()) == ["bad_url", "missing_field"]


def test_odd_clocks_are_dead_letters(spark):
    """Other units, no numbers, and two clocks decades apart lose their own flow only."""
    clocks = [(1.7e15, None), (float("nan"), None), (float("inf"), None), (-1e12, None), (1.0, 1.7e9), (1.7e9, float("nan")),
              (1.7e9, 1.7e9 + 1), (None, 1.7e9), (253402300798.5, None)]
    rows = [
        (("GET", "http", "h.org", 80, f"http://h.org/{k}", {}, start, None), (200, {}, end, None))
        for k, (start, end) in enumerate(clocks)
    ]
    parsed = parse_capture(spark.createDataFrame(rows, schemas.CAPTURE_RECORD))
    letters = dead_letters(parsed, source="c").collect()
    assert [r.reason for r in letters] == ["bad_time"] * 6
    assert sorted(r.path for r in good_records(parsed).select("path").collect()) == ["/6", "/7", "/8"]


def test_zstd_import(spark):
    frame = zstandard.ZstdCompressor(level=10).compress(b"hello")
    table = spark.createDataFrame([("a", bytearray(frame)), ("b", bytearray(b"junk")), ("c", None)], "sha256 string, content binary")
    expected = {"raw": (b"hello", b"junk", None), "null": (b"hello", None, None), "empty": (b"hello", b"", b"")}
    for fallback, wanted in expected.items():
        got = {r.sha256: r.content for r in import_zstd_bodies(table, fallback=fallback).collect()}
        assert tuple(None if got[k] is None else bytes(got[k]) for k in "abc") == wanted


def test_blanks_around_a_record_do_no_harm(spark):
    record = json.dumps({"url": "http://h.org/p", "response": {"raw": "HTTP/1.1 200 OK\n\nbody }"}})
    values = [record, f" \t{record}", f"{record}\v\f ", f"{record}\r", "", " \t", "\v\f\r", "{", "}", "{ }", " {} ", "{} x"]
    lines = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, value string")
    found = {r.n: (r.raw, r.reason, r.host, r.resp_body and bytes(r.resp_body)) for r in parse_jsonl(lines).collect()}
    good = (record, None, "h.org", b"body }")
    assert found == {
        0: good, 1: good, 2: good, 3: good, 7: ("{", "bad_json", "", None), 8: ("}", "bad_json", "", None),
        9: ("{ }", None, "", None), 10: ("{}", None, "", None), 11: found[11],
    }


def test_a_url_is_split_once(spark):
    parsed = good_records(parse_jsonl(spark.createDataFrame([("{}",)], "value string")))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = parsed._jdf.queryExecution().explainString(mode)
    filters = [line for line in plan.splitlines() if line.startswith("Condition")]
    assert filters and not any("regexp_replace" in line or "regexp_extract" in line for line in filters)


