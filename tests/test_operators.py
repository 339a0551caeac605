"""Operators on golden rows: bodies, roll-up, tags, search, details, replay."""

import hashlib

import pytest
from flows import at, make
from pyspark.sql import functions as F

from wirevault import schemas
from wirevault.operators import bodies as B
from wirevault.operators import detail, joins, replay, rollup, search, stats
from wirevault.operators.tagging import RULES, PythonRule, Rule, RuleSet, tag_flows


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def stored(flows):
    """Flows in stored form with their distinct bodies, and the counters."""
    keyed = B.with_body_keys(flows)
    obs = B.observations(keyed)
    return keyed.withColumn("fingerprints", F.array().cast("array<string>")), B.distinct_content(obs), B.body_stats(obs)


def test_bodies(spark):
    flows = make(
        spark,
        dict(resp_body=b"x", resp_content_type="image/png"),
        dict(resp_body=b"x", req_body=b"", req_content_type="text/plain"),
        dict(resp_body=None, req_body=b"x"),
        dict(resp_body=b"", resp_content_type="image/png"),
    )
    _, content, counters = stored(flows)
    got = {r.sha256: r for r in counters.collect()}
    # Seen first as an image, later as text: not flagged as text, but ever text.
    assert (got[sha(b"x")].is_text, got[sha(b"x")].ever_text, got[sha(b"x")].seen_count) == (False, True, 3)
    # An empty body is a body; no body is none.
    assert (got[sha(b"")].is_text, got[sha(b"")].size, got[sha(b"")].seen_count) == (True, 0, 2)
    assert len(got) == 2 and {bytes(r.content) for r in content.collect()} == {b"x", b""}
    index = B.text_index(content)
    assert {r.sha256: r.tokens for r in index.collect()} == {sha(b"x"): ["x"], sha(b""): []}


def test_folding_counters_equals_one_pass(spark):
    rows = [dict(resp_body=bytes([65 + i % 5]), resp_content_type=["image/png", "text/html"][i % 3 == 0],
                 ts=at(59 - i), host=f"h{i % 2}") for i in range(30)]
    flows = make(spark, *rows)
    keyed, _, whole = stored(flows)
    parts = [B.body_stats(B.observations(keyed.where(F.col("id") % 3 == n))) for n in (2, 0, 1)]
    folded = B.merge_body_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(folded.collect()) == sorted(whole.select(*folded.columns).collect())
    parts = [rollup.shape_stats(keyed.where(F.col("id") % 3 == n)) for n in (1, 0, 2)]
    folded = rollup.merge_shape_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    key = lambda r: r.shape_sha
    assert sorted(folded.collect(), key=key) == sorted(rollup.shape_stats(keyed).collect(), key=key)


def test_rollup(spark):
    flows = make(
        spark,
        dict(ts=at(5), program="late", query="a=1", port=1, scheme="http"),
        dict(ts=at(1), program="early", source_tool=None),
        dict(ts=at(9), status=None),
        dict(ts=at(1), program="tie"),
    )
    got = {r.status: r for r in rollup.rollup(stored(flows)[0]).collect()}
    assert len(got) == 2
    shape = got[200]
    assert (shape.hit_count, shape.program, shape.source_tool, shape.fingerprints) == (3, "early", None, [])
    assert shape.last_seen - shape.first_seen == at(5) - at(1)
    assert got[None].shape_sha == sha(b"h.example.com|GET|/|None|")


HEADER_CASES = [
    ({"Set-Cookie": "BIGipServer=1"}, ["f5-big-ip"]),
    ({"X-CNection": "close"}, ["f5-big-ip"]),
    ({"Server": "AkamaiGHost"}, ["akamai"]),
    ({"X-Akamai-Id": "1"}, ["akamai"]),
    ({"Via": "1.1 CloudFront"}, ["cloudfront"]),
    ({"X-Amz-Cf-Id": "1"}, ["cloudfront"]),
    ({"CF-Ray": "1"}, ["cloudflare"]),
    ({"X-A": "Apigee-x"}, ["apigee"]),
    ({"X-Vhost": "Dispatcher"}, ["aem-dispatcher"]),
    ({"X-CQ": "acq"}, ["aem-dispatcher"]),
    ({"server": "Apache", "Server": "nginx"}, ["apache"]),  # the last in key order wins
    ({"X-Powered-By": "ASP.NET"}, ["iis-aspnet"]),
    ({"Server": "nginx", "X-AspNet-Version": "4"}, ["nginx", "iis-aspnet"]),
    ({}, []),
]


def test_header_rules(spark):
    flows = make(spark, *(dict(resp_headers=h) for h, _ in HEADER_CASES))
    got = {r.id: r.fingerprints for r in tag_flows(*stored(flows)[:2]).collect()}
    assert [got[i] for i in sorted(got)] == [tags for _, tags in HEADER_CASES]


def body_cases():
    def at_char(mark, end):
        return (" " * (end - len(mark)) + mark).encode()

    return [
        (200, at_char('"fault"', 2000), "text/html", ["apigee"]),
        (200, at_char('"fault"', 2001), "text/html", []),
        (200, b'"Fault"', "text/html", []),
        (200, b'"fault"', "image/png", []),
        (200, at_char('"errors"', 500) + b"GraphQL", "application/json", ["graphql"]),
        (200, at_char('"errors"', 501) + b"graphql", "application/json", []),
        (200, b'"errors"' + at_char("graphql", 1993), "application/json", []),
        (200, b'"Errors" graphql', "application/json", []),
        (403, at_char("Access DENIED", 500), "text/html", ["waf-generic"]),
        (419, b"request blocked", "text/html", ["waf-generic"]),
        (None, b"request blocked!", "text/html", []),
        (406, at_char("access denied", 501), "text/html", []),
        (200, "é".encode() * 1993 + b'"fault"', "text/html", ["apigee"]),  # characters, not bytes
    ]


def test_body_rules(spark):
    cases = body_cases()
    flows = make(spark, *(dict(status=s, resp_body=b, resp_content_type=t) for s, b, t, _ in cases))
    got = {r.id: r.fingerprints for r in tag_flows(*stored(flows)[:2]).collect()}
    wanted = [tags for *_, tags in cases]
    assert [got[i] for i in sorted(got)] == wanted


def test_user_rules_and_rerun(spark):
    flows = make(spark, dict(resp_body=b"hello", resp_headers={"Server": "nginx"}), dict(resp_body=None), dict(status=500))
    rules = [
        *RULES,
        Rule("no-body-text", lambda c: c.body_test(lambda text: F.length(text) == 0)),
        Rule("null", lambda c: F.lit(None).cast("boolean")),
        PythonRule("py", lambda s, h, b: h["server"] == "nginx" and b == "hello"),
        PythonRule("broken", lambda s, h, b: 1 / 0),
    ]
    base, content, counters = stored(flows)
    once = tag_flows(base, content, RuleSet(rules))
    got = {r.id: r.fingerprints for r in once.collect()}
    assert got == {1: ["nginx", "py"], 2: ["no-body-text"], 3: ["no-body-text"]}
    twice = tag_flows(once, content, RuleSet(rules))
    assert {r.id: r.fingerprints for r in twice.collect()} == got
    # A rule that is gone leaves no tag; adding rules never changed the others.
    back = tag_flows(once, content)
    assert {r.id: r.fingerprints for r in back.collect()} == {1: ["nginx"], 2: [], 3: []}
    untagged = tag_flows(back, content, RuleSet(rules), only_untagged=True)
    assert sorted(r.id for r in untagged.collect()) == [2, 3]


def test_split_of_hot_bodies_changes_nothing(spark, monkeypatch):
    rows = [dict(resp_body=b'"fault"' if i % 3 else bytes([i]), req_body=None if i % 2 else b"q") for i in range(60)]
    base, content, counters = stored(make(spark, *rows))
    hot = B.hot_bodies(counters, share=4, floor=5)
    salts = {r.sha256: r.salts for r in hot.collect()}
    assert salts and max(salts.values()) > 1
    key = lambda r: r.id
    broadcast = sorted(tag_flows(base, content).select("id", "fingerprints").collect(), key=key)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    plain = sorted(tag_flows(base, content).select("id", "fingerprints").collect(), key=key)
    split = sorted(tag_flows(base, content, hot=hot).select("id", "fingerprints").collect(), key=key)
    assert broadcast == plain == split and len(split) == 60
    words = B.text_index(content)
    for predicate in ({"grep": "fault"}, {"body": "q"}):
        a = search.match_flows(base, body_text=words, **predicate).select("id").collect()
        b = search.match_flows(base, body_text=words, hot=hot, **predicate).select("id").collect()
        assert sorted(a) == sorted(b)
    assert search.match_flows(base, body_text=words, hot=hot, grep="fault").count() == 40


def test_hot_list_is_bounded(spark):
    rows = [dict(resp_body=bytes([i % 50])) for i in range(200)]
    _, _, counters = stored(make(spark, *rows))
    assert B.hot_bodies(counters, share=10, floor=1).count() <= 10
    assert B.hot_bodies(counters).count() == 0


def ids(df):
    return [r.id for r in df.collect()]


def search_flows(spark):
    flows = make(
        spark,
        dict(ts=at(1), host="a.example.com", url="https://a.example.com/x", method="POST", req_body=b"secret word",
             req_content_type="text/plain"),
        dict(ts=at(2), host="b.example.com", url="https://b.example.com/100%", status=None, resp_body=b"the secret"),
        dict(ts=at(2), host="B.org", url="https://b.org/?q=a.example", program="other", session_id="z", resp_body=b"word"),
    )
    base, content, counters = stored(flows)
    tagged = base.withColumn("fingerprints", F.when(F.col("id") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("fingerprints")))
    return tagged, B.text_index(content)


@pytest.mark.parametrize(
    "predicates, expected",
    [
        ({}, [3, 2, 1]),
        ({"tech": ["x"]}, [1]),
        ({"tech": ["y", "x"]}, [1]),
        ({"tech": ["x", "z"]}, []),
        ({"host": "EXAMPLE"}, [2, 1]),
        ({"host": ""}, [3, 2, 1]),
        ({"method": "post"}, [1]),
        ({"status": 200}, [3, 1]),
        ({"status": 0}, []),
        ({"program": "other"}, [3]),
        ({"session": "z"}, [3]),
        ({"since": "2024-01-01T00:02:00Z"}, [3, 2]),
        ({"id": 2}, [2]),
        ({"terms": ["a.example"]}, [3, 1]),
        ({"terms": ["a.example", "b.org"]}, [3]),
        ({"terms": ["0%"]}, [2]),
        ({"grep": "secret"}, [2]),
        ({"grep": "word, WORD"}, [3]),
        ({"grep": "..."}, []),
        ({"body": "secret"}, [2, 1]),
        ({"body": "secret word"}, [1]),
    ],
)
def test_search(spark, predicates, expected):
    flows, words = search_flows(spark)
    assert ids(search.search(flows, body_text=words, **predicates)) == expected


def test_search_limits_and_rank(spark):
    flows, words = search_flows(spark)
    assert ids(search.search(flows, limit=2)) == [3, 2]
    assert ids(search.search_summaries(flows, limit=0)) == []
    assert len(ids(search.search_summaries(flows, limit=None))) == 3
    row = search.search_summaries(flows, id=1).first()
    assert (row.ts, row.tech) == ("2024-01-01T00:01:00+00:00", ["x", "y"])
    many = flows.where("id = 1").withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(1500))))
    assert search.search_summaries(many, limit=1200).count() == 1200
    assert search.ranked_search(many, ["a.example"], limit=1200).count() == 1200
    ranked = search.ranked_search(flows, ["a.example"]).collect()
    assert [(r.id, r.score) for r in ranked] == [(1, 121), (3, 0)]
    with pytest.raises(ValueError):
        search.match_flows(flows, grep="x")


def test_stats(spark):
    flows, _ = search_flows(spark)
    counters = spark.createDataFrame([("a", 3, 4), ("b", 5, 5), ("c", 0, 1), ("d", 1, 1)], "sha256 string, size int, seen_count bigint")
    row = stats.corpus_stats(flows, counters).first()
    assert (row.flows, row.unique_bodies, row.body_occurrences, row.dedup_ratio) == (3, 4, 11, 2.8)
    assert (row.unique_bytes, row.observed_bytes) == (9, 38)
    empty = stats.corpus_stats(flows.limit(0), counters.limit(0)).first()
    assert (empty.flows, empty.dedup_ratio, empty.unique_bytes) == (0, 0.0, 0)
    # 2.25 rounds to the even 2.2.
    assert stats.corpus_stats(flows, counters.withColumn("seen_count", F.when(F.col("sha256") == "a", 6).otherwise(1))).first().dedup_ratio == 2.2
    assert [tuple(r) for r in stats.tech_facets(flows).collect()] == [("x", 1), ("y", 1)]


def test_details(spark):
    flows = make(
        spark,
        dict(req_body=b"\xff\xfe", req_headers={"Host": "z", "X": "it's", "Content-Length": "2"}, query="q", status=404),
        dict(resp_body=b'{"a": 1}', resp_content_type="application/json", status=None),
        dict(resp_body=b"x" * 20, resp_content_type="image/png", req_body=b""),
        dict(resp_body=b"y" * 4001),
    )
    base, content, counters = stored(flows)
    full = content
    lines = {r.id: r.line for r in detail.flow_listing(base).collect()}
    assert lines[1] == "#1        2024-01-01 00:00 404 GET    [-] https://h.example.com/"
    assert " None GET    [-]" in lines[2]
    requests = detail.load_requests(base, full)
    curl = {r.id: r.c for r in requests.select("id", detail.curl_line().alias("c")).collect()}
    assert curl[1] == "curl -sk -X GET 'https://h.example.com/' -H 'X: it'\\''s' -H 'Host: z' --data-binary @-"
    assert curl[3] == "curl -sk -X GET 'https://h.example.com/'"
    raw = {r.id: r.c for r in requests.select("id", detail.request_text().alias("c")).collect()}
    assert raw[1] == "GET /?q HTTP/2\nhost: h.example.com\nX: it's\nContent-Length: 2\n\n<2 bytes binary body>"
    assert raw[3] == "GET / HTTP/2\nhost: h.example.com"
    got = {r.id: r for r in detail.flow_previews(base, full).collect()}
    assert got[1].req_preview == "<binary, 2 bytes>" and got[1].status_line == "HTTP/1.1 404 Not Found"
    assert got[2].resp_preview == '{\n  "a": 1\n}' and got[2].status_line == "HTTP/1.1 None "
    assert got[3].resp_preview == "<binary, 20 bytes>" and got[3].req_preview == "(no body)"
    assert got[4].resp_preview == "y" * 4000 + "\n... [truncated, 4001 bytes total]"
    details = {r.id: r for r in detail.flow_details(base, full).collect()}
    assert details[3].req_body.kind == "empty" and details[3].resp_body.kind == "binary" and details[3].resp_body.size == 20
    assert details[2].resp_body.text == '{"a": 1}'


def test_request_variants(spark):
    flows = make(spark, dict(method="POST", port=8443, query="q", req_headers={"Cookie": "c", "X-A": "1", "x-b": "2"}, req_body=b"old"))
    base, content, counters = stored(flows)
    requests = detail.load_requests(base, content)
    changes = spark.createDataFrame(
        [
            (1, None, None, None, None, None),
            (1, "put", "", {"x-a": "9"}, ["COOKIE"], bytearray(b"")),
            (1, "", "http://N.org", {}, [], None),
            (7, "get", None, None, None, None),
        ],
        schemas.MUTATION,
    )
    got = sorted(replay.request_variants(requests, changes).collect(), key=lambda r: (r.method, r.host))
    assert [r.replay_of for r in got] == [1, 1, 1]
    same, moved, put = got
    assert (same.req_headers, bytes(same.req_body), same.port) == ({"Cookie": "c", "X-A": "1", "x-b": "2"}, b"old", 8443)
    assert (moved.host, moved.scheme, moved.port, moved.path, moved.query) == ("n.org", "http", None, "/", None)
    assert (put.method, put.req_headers, bytes(put.req_body), put.url) == ("PUT", {"x-b": "2", "x-a": "9"}, b"", same.url)
    one = replay.mutate_all(requests, method="patch", set_headers={"Connection": "x"}).first()
    assert one.method == "PATCH" and one.req_headers["Connection"] == "x"
    sent = requests.select(replay.sendable_headers(F.create_map(F.lit("Connection"), F.lit("x"), F.lit("A"), F.lit("b"))).alias("h"))
    assert sent.first().h == {"A": "b"}


def test_replays_of_a_hot_parent_are_split(spark, monkeypatch):
    rows = [dict(replay_of=None if i < 2 else 2 if i > 2 else 1) for i in range(1, 61)]
    flows = stored(make(spark, *rows))[0]
    whole = {r.id: tuple(r) for r in replay.replay_pairs(flows).collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(replay, "hot_keys", lambda *a: joins.hot_keys(*a, share=10, floor=2))
    assert {r.id: tuple(r) for r in replay.replay_pairs(flows).collect()} == whole and len(whole) == 59
    assert replay._hot_parents(flows.where("replay_of is not null")).first().salts > 1
    chain = {r.id: (r.root, r.depth) for r in replay.replay_chain(flows).collect()}
    assert chain == {2: (1, 1), **{i: (1, 2) for i in range(3, 61)}}


def test_replay_lineage(spark):
    parents = {2: 1, 3: 2, 4: 3, 5: 2, 7: 6, 8: 99}
    rows = [dict(replay_of=parents.get(i), status=200 + i % 2, duration_ms=i) for i in range(1, 9)]
    flows = stored(make(spark, *rows))[0]
    chain = {r.id: (r.root, r.depth) for r in replay.replay_chain(flows).collect()}
    assert chain == {2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 2), 7: (6, 1), 8: (99, 1)}
    pairs = {r.id: r for r in replay.replay_pairs(flows).collect()}
    assert set(pairs) == {2, 3, 4, 5, 7}
    assert pairs[2].status_changed and not pairs[2].body_changed and pairs[5].duration_change_ms == 3
    # A cycle (1, 2) and what leads into it (3) have no root; others (5) are not held up.
    parents = {1: 2, 2: 1, 3: 1, 5: 4}
    looped = stored(make(spark, *(dict(replay_of=parents.get(i)) for i in range(1, 6))))[0]
    assert {r.id: (r.root, r.depth) for r in replay.replay_chain(looped).collect()} == {
        1: (None, None), 2: (None, None), 3: (None, None), 5: (4, 1)
    }


def test_postings_find_what_the_words_of_bodies_find(spark, monkeypatch):
    import random

    from wirevault.operators import postings as P

    monkeypatch.setattr(P, "RUN_BODIES", 7)
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "e", "é", "漢字", "x_1", "9"]
    # The first word is in every body.
    rows = [(f"k{i}", ["all", *rng.sample(vocabulary, rng.randrange(len(vocabulary)))]) for i in range(60)]
    index = spark.createDataFrame(rows, "sha256 string, tokens array<string>")
    posted = P.postings(index, 60).withColumn("batch_id", F.lit(0).cast("bigint"))
    assert posted.where("word = 'all'").count() > 5 and posted.where("size(keys) > 25").count() == 0
    for phrase in ("all", "ALL a", "a, b", "c d e", "é 漢字", "x_1-9", "missing", "all missing", "...", "", "a a"):
        want = sorted(r.sha256 for r in B.matching_bodies(index, phrase).collect())
        assert sorted(r.sha256 for r in P.bodies_with_words(posted, phrase).collect()) == want, phrase


def test_template_matrix(spark):
    flows = make(spark, dict(path="/a", query="q=1", req_headers={"Cookie": "c", "A": "1"}, req_body=b"x"), dict(host="other", path="/b"))
    templates = [
        {"name": "move", "url": "http://{host}:81{path}{query}#{id}", "unset_headers": ["COOKIE"], "set_headers": {"a": "2"}},
        {"name": "same"}, {"name": "post", "method": "post", "body": b""},
    ]
    rows = {(r.replay_of, r.template): r for r in replay.request_matrix(flows, templates).collect()}
    assert len(rows) == 6
    moved = rows[1, "move"]
    assert (moved.url, moved.host, moved.port, moved.path, moved.query) == ("http://h.example.com:81/a?q=1#1", "h.example.com", 81, "/a", "q=1")
    assert moved.req_headers == {"a": "2"} and bytes(moved.req_body) == b"x"
    assert rows[2, "move"].url == "http://other:81/b#2" and rows[2, "move"].query is None
    assert rows[1, "same"].req_headers == {"Cookie": "c", "A": "1"}
    assert rows[2, "post"].method == "POST" and bytes(rows[2, "post"].req_body) == b""
    many = [{"name": f"t{k}", "set_headers": {"n": str(k)}} for k in range(replay.TEMPLATES + 5)]
    found = replay.request_matrix(flows, many)
    assert found.count() == 2 * len(many) and found.where("req_headers['n'] = substr(template, 2)").count() == 2 * len(many)
    for wrong in ([], [{"name": "a"}, {"name": "a"}], [{"name": "a", "status": 1}]):
        with pytest.raises(ValueError):
            replay.request_matrix(flows, wrong)


def test_many_mutations_of_one_flow_are_split(spark, monkeypatch):
    flows = make(spark, *(dict(path=f"/{k}") for k in range(5)))
    data = [(1, "put", f"http://x/{k}", {}, [], None) for k in range(300)] + [(k, None, None, {"a": str(k)}, None, b"") for k in (2, 3, 99)]
    mutations = spark.createDataFrame(data, schemas.MUTATION)
    monkeypatch.setattr(replay, "hot_keys", lambda counts, key, n: joins.hot_keys(counts, key, n, share=10, floor=20))
    rows = replay.request_variants(flows, mutations).collect()
    assert sorted(r.url for r in rows if r.replay_of == 1) == sorted(f"http://x/{k}" for k in range(300))
    assert sorted((r.replay_of, r.req_headers["a"]) for r in rows if r.replay_of != 1) == [(2, "2"), (3, "3")]
    counts = mutations.groupBy(F.col("flow_id").alias("id")).agg(F.count("*").alias("n"))
    assert joins.hot_keys(counts, "id", "n", share=10, floor=20).count() == 1


def test_a_python_rule_is_called_once_per_distinct_input(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def match(status, headers, body):
        with open(calls, "a") as file:
            file.write(f"{status}|{sorted(headers.items())}|{body}\n")
        return status == 200 and "x" in body

    kinds = [
        dict(resp_body=b"x", resp_headers={"A": "1", "B": "2"}), dict(resp_body=b"x", resp_headers={"b": "2", "a": "1"}),
        dict(resp_body=b"y"), dict(resp_body=None), dict(resp_body=b"x", status=None), dict(resp_body=b"x", resp_content_type="image/png"),
    ]
    flows = B.with_body_keys(make(spark, *(kinds[k % 6] for k in range(120))))
    content = B.distinct_content(B.observations(flows))
    found = {r.id: r.fingerprints for r in tag_flows(flows, content, RuleSet([PythonRule("has-x", match)])).collect()}
    # The first body of that key was text, so a later image of equal bytes is tested like it.
    assert found == {k + 1: (["has-x"] if k % 6 in (0, 1, 5) else []) for k in range(120)}
    with open(calls) as file:
        lines = file.read().splitlines()
    assert len(lines) == len(set(lines)) == 5


def test_earliest_row_of_a_shape(spark):
    rows = [dict(program=f"p{k % 7}", source_tool=f"t{k % 2}", ts=at(5 - k % 3), path=f"/{k % 4}", status=None if k % 4 == 3 else 200) for k in range(200)]
    rows += [dict(program="old", path="/0", ts=at(0).replace(year=1960)), dict(program=None, path="/9"), dict(program="p", path="/9")]
    flows = B.with_body_keys(make(spark, *rows)).orderBy("path")
    want = {}
    for k, row in enumerate(rows, 1):
        key = (row["path"], row.get("status", 200))
        n, first = want.get(key, (0, None))
        mine = (row.get("ts", at(0)), k, row.get("program"), row.get("source_tool", "t"))
        want[key] = (n + 1, mine if first is None else min(first, mine, key=lambda m: m[:2]))
    parts = [rollup.shape_stats(flows.where(F.col("id") % 3 == r)) for r in range(3)]
    for stats_ in (rollup.shape_stats(flows), rollup.merge_shape_stats(parts[0].union(parts[1]).union(parts[2]))):
        found = {(r.path, r.status): (r.hit_count, (r.first_id, r.program, r.source_tool)) for r in stats_.collect()}
        assert found == {key: (n, first[1:]) for key, (n, first) in want.items()}
