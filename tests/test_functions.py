"""Expressions against plain Python on edge values."""

import hashlib
import json
import re
from urllib.parse import urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirevault.functions import headers as H
from wirevault.functions.jsontext import pretty_json
from wirevault.functions.keys import content_key, shape_key
from wirevault.functions.messages import body_of_raw, duration_ms, epoch_micros, iso_timestamp, status_of_raw
from wirevault.functions.ranking import all_match_offsets, match_offsets, relevance
from wirevault.functions.text import (
    has_all_words,
    ilike_contains,
    indexable_text,
    is_text_type,
    shell_quote,
    utf8_text,
    word_tokens,
)
from wirevault.functions.urls import split_url


def column(spark, values, expr, kind="string"):
    """Values of ``expr(col)`` for a list of inputs, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "n").orderBy("n").select("x").collect()]


URLS = [
    "https://Example.com/a/b?x=1#f", "http://a_b.example.com:8080/", "https://u:p@h.org:1/p",
    "http://[2001:DB8::1]:443/x?y", "http://[fe80::1%25Eth0]/", "//host/only", "/just/path?q", "no-scheme",
    "http://host with space/a b", "http://h?query", "http://h#frag", "http://h/?", "HTTP://H/?a?b#c#d",
    "mailto:me@x.org", "http://h:/p", "  http://lead.org/\tx", "", "http://user@name@host/p", "1http://h/p",
]


def test_split_url_like_the_standard_library(spark):
    names = ("scheme", "host", "port", "path", "query")
    got = column(spark, URLS, lambda v: F.struct(*(split_url(v)[n].alias(n) for n in names)))
    for url, row in zip(URLS, got):
        u = urlsplit(url)
        assert tuple(row) == (u.scheme or None, u.hostname, u.port, u.path, u.query or None), url


def test_bad_authority(spark):
    urls = ["http://h:99999/", "http://h:x/", "http://[::1/", "http://h:80/", "http://h/", "/a:b"]
    assert column(spark, urls, lambda v: split_url(v)["bad_authority"]) == [True, True, True, False, False, False]


def test_status_of_raw(spark):
    raws = ["HTTP/1.1 200 OK\r\nX: 1", "HTTP/2 404", "200", "HTTP/1.1 OK\n200", "a 2000 304 b", "", None]
    assert column(spark, raws, status_of_raw) == [200, 404, 200, None, 304, None, None]


def test_body_of_raw(spark):
    raws = ["H\r\n\r\nbody", "H\n\nb\r\n\r\nc", "H\n\nb", "a\r\n\r\nb\r\n\r\nc", "H\r\n\r\n", "none", None]
    got = [None if b is None else bytes(b) for b in column(spark, raws, body_of_raw)]
    # The CRLF form is looked for first, wherever it stands.
    assert got == [b"body", b"c", b"b", b"b\r\n\r\nc", None, None, None]


def test_iso_timestamp(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456789+02:00", "2024-01-02", "yesterday", "12", "", None]
    got = [None if t is None else t.astimezone().timestamp() for t in column(spark, texts, iso_timestamp)]
    assert got[0] == 1704164645.0 and abs(got[1] - 1704157445.123456) < 1e-6
    assert got[2] is not None and got[3:] == [None] * 4


def test_epoch_and_duration(spark):
    assert column(spark, [1704164645.123457, 0.0, None], epoch_micros, "double") == [1704164645123457, 0, 0]
    df = spark.createDataFrame([(1.0, 1.0999), (None, 2.0), (1.0, 0.0), (1.0, 3.5)], "a double, b double")
    assert [r[0] for r in df.select(duration_ms(F.col("a"), F.col("b"))).collect()] == [99, None, None, 2500]


def test_text_types(spark):
    types = ["text/html; charset=utf-8", "IMAGE/SVG+XML", "application/JSON", "image/png", "", None,
             "application/x-www-form-urlencoded", "application/javascript"]
    assert column(spark, types, is_text_type) == [True, True, True, False, False, False, True, True]


def test_utf8_with_replacement_like_python(spark):
    raws = [b"ok", b"\xff", b"a\xc3", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xc3\x28", b"", b"x\x00y"]
    raws = [bytearray(r) for r in raws]
    assert column(spark, raws, utf8_text, "binary") == [bytes(r).decode("utf-8", "replace") for r in raws]
    assert column(spark, raws, indexable_text, "binary")[-1] == "xy"


def test_index_covers_whole_bodies(spark):
    body = bytearray(b"a" * 1_000_000 + b" b c")
    assert column(spark, [body], lambda v: word_tokens(indexable_text(v)), "binary") == [["a" * 1_000_000, "b", "c"]]
    bounded = column(spark, [body], lambda v: word_tokens(indexable_text(v, chars=1_000_000)), "binary")
    assert bounded == [["a" * 1_000_000]]


def test_index_without_markup(spark):
    body = bytearray(b"<p class='x'>one<br>two</p")
    assert column(spark, [body], lambda v: word_tokens(indexable_text(v, strip_markup=True)), "binary") == [["one", "two", "p"]]


def test_word_tokens(spark):
    got = column(spark, ["The Fox, the fox_1! Ünïcode 42", "!!", ""], word_tokens)
    assert got == [["the", "fox", "fox_1", "ünïcode", "42"], [], []]


def test_phrases(spark):
    texts = ["access was denied", "access", "nothing"]
    assert column(spark, texts, lambda v: has_all_words(word_tokens(v), "Denied: ACCESS")) == [True, False, False]
    assert column(spark, texts, lambda v: has_all_words(word_tokens(v), " ?! ")) == [False] * 3


@pytest.mark.parametrize(
    "text, expected",
    [("B.C", [0]), ("a%c", [0, 1]), ("_b", [0, 1]), ("\\%", [2]), ("\\x", [1, 3]), ("100\\%", [2]), ("", [0, 1, 2, 3])],
)
def test_ilike_patterns(spark, text, expected):
    values = ["a.b.c", "aXbc", "100%", "xyz"]
    got = column(spark, values, lambda v: ilike_contains(v, text))
    assert [i for i, hit in enumerate(got) if hit] == expected


def test_ilike_literal(spark):
    got = column(spark, ["a%c", "abc", "A%C"], lambda v: ilike_contains(v, "a%C", literal=True))
    assert got == [True, False, True]


def test_shell_quote(spark):
    assert column(spark, ["it's", "a b"], shell_quote) == ["'it'\\''s'", "'a b'"]


def test_header_order_and_lower_keys(spark):
    maps = [{"Bb": "1", "a": "2", "AB": "3"}, {"Server": "x", "server": "y", "SERVER": "z", "V": "1"}, {}, None]
    kind = "map<string,string>"
    assert column(spark, maps, H.header_lines, kind)[0] == ["a: 2", "AB: 3", "Bb: 1"]
    assert column(spark, maps, H.lower_keys, kind) == [
        {"bb": "1", "a": "2", "ab": "3"}, {"server": "y", "v": "1"}, {}, {},
    ]
    assert column(spark, maps, lambda m: H.header_any_case(m, "sErVer"), kind) == [None, "y", None, None]
    assert column(spark, maps, lambda m: H.without(m, ["SERVER"]), kind)[1] == {"V": "1"}


def test_keys(spark):
    bodies = [None, bytearray(b""), bytearray(b"x")]
    assert column(spark, bodies, content_key, "binary") == [
        None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"x").hexdigest(),
    ]
    df = spark.createDataFrame([("h", "GET", "/", None, None), ("h", "GET", "/", 200, "s")],
                               "h string, m string, p string, s int, b string")
    got = [r[0] for r in df.select(shape_key(*(F.col(c) for c in "hmpsb"))).collect()]
    assert got == [hashlib.sha256(k).hexdigest() for k in (b"h|GET|/|None|", b"h|GET|/|200|s")]


def brute_score(terms, text):
    hay, total = text.lower(), 0
    for term in terms:
        t = term.lower()
        first = hay.find(t)
        if first < 0:
            return 0
        total += 100 - min(first, 99) + hay.count(t)
        if first == 0 or hay[first - 1] in "/.:-_?&=":
            total += 20
    return total


def brute_offsets(term, text):
    return [p for m in re.finditer(re.escape(term.lower()), text.lower()) for p in range(*m.span())]


def test_score_and_offsets(spark):
    texts = ["aaaa/aa", "x" * 150 + "aa", "b.aa", "baa", "", "a.a\\Ea"]
    for terms in (["aa"], ["aa", "b"], ["\\E"], ["."]):
        got = column(spark, texts, lambda v: relevance(terms, v))
        assert got == [brute_score(terms, t) for t in texts]
        got = column(spark, texts, lambda v: match_offsets(terms[0], v))
        assert got == [brute_offsets(terms[0], t) for t in texts]
    assert column(spark, ["ab", "b"], lambda v: all_match_offsets(["a", "ab"], v)) == [[0, 1], None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("ab./", max_size=12), min_size=1, max_size=20), term=st.text("ab.", min_size=1, max_size=3))
def test_score_and_offsets_property(spark, texts, term):
    rows = column(spark, texts, lambda v: F.struct(relevance([term], v), match_offsets(term, v)))
    assert [(r[0], r[1]) for r in rows] == [(brute_score([term], t), brute_offsets(term, t)) for t in texts]


def test_pretty_json(spark):
    texts = ['{"b":1,"a":[2]}', "[", "plain", None, '"é"']
    expected = [json.dumps({"b": 1, "a": [2]}, indent=2), "[", "plain", None, '"é"']
    assert column(spark, texts, pretty_json) == expected
