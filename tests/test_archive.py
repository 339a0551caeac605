"""The stored archive: batches, retries, compaction, generations, streams."""

import gzip
import json
import os

import pytest
from flows import at, make
from pyspark.sql import functions as F

from wirevault import RULES, Archive, Rule, RuleSet
from wirevault.operators.rollup import rollup
from wirevault.session import new_scratch_dir, path_exists
from wirevault.sources.jsonl import read_jsonl, spread_lines, stream_jsonl
from wirevault.streaming.ingest import ingest_jsonl_stream


@pytest.fixture
def archive(spark):
    return Archive(spark, new_scratch_dir(spark, "test"))


def rows_of(df, *drop):
    return sorted((r.asDict() for r in df.drop("batch_id", *drop).collect()), key=str)


def sample(spark, n=40):
    kinds = ["image/png", "text/html", ""]
    return make(
        spark,
        *(
            dict(ts=at(i % 7), host=f"h{i % 3}", resp_body=None if i % 5 == 4 else b'"fault" %d' % (i % 6),
                 req_body=b"req" if i % 4 == 0 else None, resp_content_type=kinds[i % 3],
                 collapse=i % 8 == 0, resp_headers={"Server": "nginx"} if i % 2 else {})
            for i in range(n)
        ),
    )


def test_batches_equal_one_batch(spark, archive):
    flows = sample(spark)
    archive.ingest(flows, batch_id=0)
    parts = Archive(spark, new_scratch_dir(spark, "test"))
    for n in range(3):
        low, high = 1 + n * 14, 15 + n * 14
        parts.ingest(flows.where(F.col("id").between(low, high - 1)), batch_id=n)
    for table in ("flows", "bodies", "body_text", "flow_agg"):
        assert rows_of(getattr(parts, table)()) == rows_of(getattr(archive, table)()), table
    assert parts.counts() == archive.counts() == (40, 0)
    # Each body once, every observation counted, collapsed flows only in the roll-up.
    assert parts.bodies().select("sha256").distinct().count() == parts.bodies().count()
    assert parts.bodies().agg(F.sum("seen_count")).first()[0] == 32 + 10
    assert parts.flow_agg().agg(F.sum("hit_count")).first()[0] == 40
    assert parts.flows().count() == 35


def test_retry_replaces_the_batch_and_repeat_counts_twice(spark, archive):
    flows = sample(spark)
    archive.ingest(flows, batch_id=0)
    before = {t: rows_of(getattr(archive, t)()) for t in ("flows", "bodies", "body_text", "flow_agg")}
    archive.ingest(flows, batch_id=0)
    assert before == {t: rows_of(getattr(archive, t)()) for t in before}
    archive.ingest(flows, batch_id=1)
    assert rows_of(archive.bodies(), "seen_count") == [{k: v for k, v in r.items() if k != "seen_count"} for r in before["bodies"]]
    assert [r["seen_count"] for r in rows_of(archive.bodies())] == [2 * r["seen_count"] for r in before["bodies"]]
    assert rows_of(archive.body_text()) == before["body_text"]


def test_late_text_is_indexed_once(spark, archive):
    def seen_as(kind, n):
        return make(spark, dict(id=n, resp_body=b"late words", resp_content_type=kind))

    archive.ingest(seen_as("image/png", 1), batch_id=0)
    assert archive.body_text().count() == 0
    archive.ingest(seen_as("text/html", 2), batch_id=1)
    archive.ingest(seen_as("text/html", 3), batch_id=2)
    assert [r.tokens for r in archive.body_text().collect()] == [["late", "words"]]
    assert sorted((r.word, len(r.keys)) for r in archive.body_words().collect()) == [("late", 1), ("words", 1)]
    body = archive.bodies().first()
    assert (body.is_text, body.seen_count) == (False, 3)


def test_text_flag_of_history_gates_the_rules(spark, archive):
    image = dict(resp_body=b'"fault"', resp_content_type="image/png")
    archive.ingest(make(spark, {**image, "id": 1}), batch_id=0)
    archive.ingest(make(spark, {**image, "id": 2, "resp_content_type": "text/html"}), batch_id=1)
    assert [r.fingerprints for r in archive.flows().collect()] == [[], []]


def test_compaction_and_rebuild(spark, archive):
    flows = sample(spark)
    for n in range(3):
        archive.ingest(flows.where(F.col("id") % 3 == n), batch_id=n)
    agg, bodies = rows_of(archive.flow_agg()), rows_of(archive.bodies())
    archive.compact()
    assert rows_of(archive.flow_agg()) == agg and rows_of(archive.bodies()) == bodies
    archive.ingest(flows.withColumn("id", F.col("id") + 100), batch_id=3)
    assert archive.flow_agg().agg(F.sum("hit_count")).first()[0] == 80
    archive.compact()
    assert archive.flow_agg().agg(F.sum("hit_count")).first()[0] == 80
    # A rebuild knows stored flows only.
    assert archive.rebuild_flow_agg() == 70
    assert rows_of(archive.flow_agg()) == rows_of(rollup(archive.flows()))
    # ... and later compactions start from it.
    archive.compact()
    assert archive.flow_agg().agg(F.sum("hit_count")).first()[0] == 70
    archive.ingest(flows.withColumn("id", F.col("id") + 200), batch_id=4)
    archive.compact()
    archive.vacuum()
    assert archive.flow_agg().agg(F.sum("hit_count")).first()[0] == 110


def test_vacuum_keeps_every_answer(spark, archive):
    flows = sample(spark)
    for n in range(3):
        archive.ingest(flows.where(F.col("id") % 3 == n), batch_id=n)
    archive.compact()
    archive.retag()
    archive.retag()
    archive.compact()
    tables = ("flows", "bodies", "body_text", "flow_agg")
    before, counts = {t: rows_of(getattr(archive, t)()) for t in tables}, archive.counts()
    archive.vacuum()
    assert before == {t: rows_of(getattr(archive, t)()) for t in tables} and archive.counts() == counts
    assert not path_exists(spark, f"{archive.root}/body_stats/batch_id=0")
    assert not path_exists(spark, f"{archive.root}/flows/gen=1") and path_exists(spark, f"{archive.root}/flows/gen=2")
    # The last batch may still be repeated, and new batches follow.
    archive.ingest(flows.where(F.col("id") % 3 == 2), batch_id=2)
    assert rows_of(archive.bodies()) == before["bodies"] and rows_of(archive.flow_agg()) == before["flow_agg"]
    fresh = make(spark, dict(resp_body=b"fresh")).drop("id", "ingest_seq")
    archive.ingest(fresh, batch_id=3)
    assert archive.flows().agg(F.max("id")).first()[0] == 41
    assert archive.counts() == (41, 0)


def test_retag_makes_a_generation(spark, archive):
    flows = sample(spark)
    archive.ingest(flows.where("id <= 20"), batch_id=0)
    archive.ingest(flows.where("id > 20"), batch_id=1)
    first = {r.id: r.fingerprints for r in archive.flows().collect()}
    assert any("apigee" in t for t in first.values()) and any(t == ["nginx"] for t in first.values())
    assert archive.retag() == 35
    assert {r.id: r.fingerprints for r in archive.flows().collect()} == first
    more = RuleSet([*RULES, Rule("h0", lambda c: F.col("host") == "h0")])
    untagged = sum(not t for t in first.values())
    assert archive.retag(more, only_untagged=True) == untagged
    got = {r.id: (r.host, r.fingerprints) for r in archive.flows().collect()}
    for i, (host, tags) in got.items():
        assert tags == (first[i] or (["h0"] if host == "h0" else []))
    # A batch that arrives later is read next to the new generation.
    later = flows.where("host = 'h0'").limit(1).withColumns({"id": F.lit(900), "collapse": F.lit(False)})
    archive.ingest(later, batch_id=2)
    assert archive.flows().count() == 36
    # The rules of the last retag hold for it, and another process with older ones is told.
    assert "h0" in archive.flows().where("id = 900").first().fingerprints
    with pytest.warns(UserWarning, match="h0"):
        Archive(spark, archive.root).ingest(later.withColumn("id", F.lit(901)), batch_id=2)
    assert archive.retag(RuleSet([])) == 36
    assert {tuple(r.fingerprints) for r in archive.flows().collect()} == {()}


def files_below(root):
    return {
        os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns
        for at, _, names in os.walk(root) for name in names
    }


def test_tags_of_untagged_flows_touch_no_flow_file(spark, archive):
    days = [dict(ts=at(0).replace(day=1 + i % 4), host=f"h{i % 4}", resp_headers={"Server": "nginx"} if i % 8 < 4 else {}) for i in range(24)]
    archive.ingest(make(spark, *days), batch_id=0)
    before = files_below(f"{archive.root}/flows")
    one = RuleSet([*RULES, Rule("h1", lambda c: F.col("host") == "h1")])
    assert archive.retag(one, only_untagged=True) == 12
    assert files_below(f"{archive.root}/flows") == before
    tagged = files_below(f"{archive.root}/flow_tags")
    assert {p.split("dt=")[1][:10] for p in tagged if p.endswith(".parquet")} == {"2024-01-02"}
    got = {r.id: r.fingerprints for r in archive.flows().collect()}
    assert len(got) == 24 and all(got[i + 1] == (["nginx"] if i % 8 < 4 else ["h1"] if i % 4 == 1 else []) for i in range(24))
    # The next rule looks only at what is untagged still, and leaves the earlier tags as they are.
    two = RuleSet([*RULES, Rule("h1", lambda c: F.col("host") == "h1"), Rule("h2", lambda c: F.col("host").isin("h1", "h2"))])
    assert archive.retag(two, only_untagged=True) == 9
    assert {p: t for p, t in files_below(f"{archive.root}/flow_tags").items() if p in tagged and p.endswith(".parquet")} == {
        p: t for p, t in tagged.items() if p.endswith(".parquet")
    }
    got = {r.id: r.fingerprints for r in archive.flows().collect()}
    assert got[2 + 4] == ["h1"] and got[3 + 4] == ["h2"] and got[4 + 4] == []
    # A whole retag makes a generation, which takes their place.
    assert archive.retag(two) == 24
    assert {r.id: r.fingerprints for r in archive.flows().collect()}[2] == ["nginx", "h1", "h2"]
    archive.vacuum()
    assert not path_exists(spark, f"{archive.root}/flow_tags/base=0")
    assert archive.flows().count() == 24


def test_columns_of_later_writers(spark, archive):
    from pyspark.sql.types import StructType

    archive.ingest(make(spark, dict(id=1)), batch_id=0)
    newer = Archive(spark, archive.root, more=StructType().add("note", "string"))
    newer.ingest(make(spark, dict(id=2)).withColumn("note", F.lit("seen")), batch_id=1)
    newer.ingest(make(spark, dict(id=3)), batch_id=2)
    assert {r.id: r.note for r in newer.flows().collect()} == {1: None, 2: "seen", 3: None}
    assert "note" not in archive.flows().columns
    assert {r.id: r.note for r in archive.flows(all_columns=True).collect()} == {1: None, 2: "seen", 3: None}
    newer.retag()
    assert {r.id: r.note for r in newer.flows().collect()} == {1: None, 2: "seen", 3: None}


def test_ids_follow_arrival(spark, archive):
    first = make(spark, *(dict(host=f"h{i}") for i in range(10))).drop("id", "ingest_seq")
    archive.ingest(first.repartition(3), batch_id=0)
    archive.ingest(first, batch_id=1)
    ids = [r.id for r in archive.flows().select("id").collect()]
    assert sorted(ids) == list(range(1, 21))
    assert archive.flows().where("batch_id = 0").agg(F.max("id")).first()[0] == 10


def record(i, **more):
    return json.dumps({
        "timestamp": f"2024-01-01T00:{i:02d}:00Z", "url": f"http://h{i % 3}.org/p", "request": {},
        "response": {"header": {"Content-Type": "text/html"}, "raw": f"HTTP/1.1 200 OK\n\nbody {i % 4}"}, **more,
    })


def test_stream_of_files(spark, archive, tmp_path):
    incoming, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    incoming.mkdir()

    def run():
        lines = stream_jsonl(spark, str(incoming), max_files_per_trigger=1)
        ingest_jsonl_stream(archive, lines, checkpoint=checkpoint, available_now=True, program="live").awaitTermination()

    for n in range(2):
        (incoming / f"{n}.jsonl").write_text("\n".join(record(n * 10 + i) for i in range(10)) + "\nnot json\n\n")
    run()
    assert archive.counts() == (20, 2)
    (incoming / "2.jsonl").write_text("\n".join(record(20 + i) for i in range(10)))
    run()
    run()  # nothing new
    assert archive.counts() == (30, 2)
    assert sorted(r.id for r in archive.flows().collect()) == sorted({r.id for r in archive.flows().collect()})
    in_order = [r.ts for r in archive.flows().where("batch_id = 2").orderBy("id").collect()]
    assert in_order == sorted(in_order) and len(in_order) == 10
    assert archive.bodies().count() == 4 and archive.bodies().agg(F.sum("seen_count")).first()[0] == 30
    assert archive.flow_agg().agg(F.sum("hit_count")).first()[0] == 30
    assert {r.reason for r in archive.dead_letters().collect()} == {"bad_json"}
    assert {r.program for r in archive.flows().collect()} == {"live"}


def test_lines_of_packed_files_are_dealt_out(spark, tmp_path, monkeypatch):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for n in range(2):
        lines = "\n".join(record(i) for i in range(n * 30, n * 30 + 30)) + "\nnot json\n\n"
        (incoming / f"{n}.gz").write_bytes(gzip.compress(lines.encode() + b"torn \xff\n"))
        os.utime(incoming / f"{n}.gz", (1_000_000 + n, 1_000_000 + n))
    read = read_jsonl(spark, str(incoming)).coalesce(1)
    dealt = spread_lines(read, 3)
    assert dealt.rdd.getNumPartitions() == 3
    values = [[bytes(r[0]) for r in d.select(F.col("value").cast("binary")).collect()] for d in (read, dealt.orderBy("src_row"))]
    assert values[0] == values[1] and len(values[0]) == 66 and b"torn \xff" in values[1]
    places = [sorted(map(str, d.select("src_time", "src_file", "src_split").collect())) for d in (read, dealt)]
    assert places[0] == places[1]
    ends = dealt.where("value LIKE '{%'").select(F.regexp_extract("value", "body [0-9]", 0), F.spark_partition_id().alias("task"))
    assert ends.distinct().count() == 4 and ends.select("task").distinct().count() > 1  # a body goes one way

    tasks, stage = [], Archive._stage

    def counted(*args, **more):
        staged = stage(*args, **more)
        tasks.append(staged[0].select(F.input_file_name()).distinct().count())
        return staged

    monkeypatch.setattr(Archive, "_stage", counted)
    found = []
    for spread in (False, True):
        archive = Archive(spark, f"{tmp_path}/archive-{spread}")
        stream = stream_jsonl(spark, str(incoming), max_files_per_trigger=1, spread=spread)
        ingest_jsonl_stream(archive, stream, checkpoint=f"{tmp_path}/c-{spread}", available_now=True).awaitTermination()
        in_order = [(r.ts, r.url, r.resp_body_sha) for r in archive.flows().orderBy("id").collect()]
        assert archive.flows().select("id").distinct().count() == 60 and archive.counts() == (60, 4)
        found.append((in_order, rows_of(archive.bodies()), rows_of(archive.flow_agg())))
    assert found[0] == found[1] and found[0][0] == sorted(found[0][0])
    assert tasks[:2] == [1, 1] and min(tasks[2:]) > 1  # tasks that parse the one file of a trigger


def test_stream_from_the_end_skips_older_files(spark, archive, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for name, age in (("old", 1_000_000), ("new", 2_000_000)):
        path = incoming / f"{name}.jsonl"
        path.write_text(record(1, url=f"http://{name}.org/"))
        os.utime(path, (age, age))
    lines = stream_jsonl(spark, str(incoming), since=F.timestamp_seconds(F.lit(1_500_000)))
    ingest_jsonl_stream(archive, lines, checkpoint=str(tmp_path / "c"), available_now=True).awaitTermination()
    assert [r.host for r in archive.flows().collect()] == ["new.org"]


def test_replays_are_stored_with_their_parent(spark, archive):
    flows = make(spark, dict(replay_of=7, source_tool="repeater"), dict()).drop("id", "ingest_seq")
    archive.ingest(flows, batch_id=0)
    got = {r.id: r.replay_of for r in archive.flows().collect()}
    assert sorted(got) == [1, 2] and set(got.values()) == {7, None}


def test_older_files_without_a_column_read_as_null(spark, archive):
    flows = sample(spark)
    archive.ingest(flows, batch_id=0)
    old = archive.flows().drop("replay_of", "batch_id", "dt").where("id < 5").withColumn("id", F.col("id") + 500)
    old.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(f"{archive.root}/flows/gen=0/batch_id=1")
    got = archive.flows().where("id > 500").select("replay_of").collect()
    assert got and all(r.replay_of is None for r in got)


def test_ids_come_back_for_the_records_that_asked(spark, archive):
    archive.ingest(sample(spark), batch_id=0)
    named = sample(spark, 10).withColumn("request", F.concat(F.lit("r"), "id")).drop("id", "ingest_seq")
    archive.ingest(named.withColumn("replay_of", F.lit(3)), batch_id=1, returning="request")
    back = {r.key: r.id for r in archive.returned_ids(1).collect()}
    assert sorted(back) == sorted(f"r{k}" for k in range(1, 11)) and len(set(back.values())) == 10 and min(back.values()) == 41
    hosts = {r.id: r.host for r in archive.flows().where("batch_id = 1").collect()}
    assert all(hosts[back[f"r{k}"]] == f"h{(k - 1) % 3}" for k in range(1, 11) if (k - 1) % 8)
    assert archive.returned_ids(0).count() == 0


def test_metrics_keep_the_last_row_of_a_repeated_batch(spark):
    from types import SimpleNamespace

    from wirevault.streaming.metrics import OBSERVED, IngestMetrics, metrics_table

    folder = new_scratch_dir(spark, "metrics")
    assert metrics_table(spark, folder).count() == 0
    listener = IngestMetrics(spark, folder, every=2)

    def progress(batch, written, seen_at, metrics=True):
        seen = {OBSERVED: {"written": written, "rejected": 1}} if metrics else {}
        return SimpleNamespace(progress=SimpleNamespace(
            name="q", runId="run", batchId=batch, numInputRows=9, timestamp=f"2024-01-01T00:00:0{seen_at}.000Z", observedMetrics=seen,
        ))

    for event in (progress(0, 5, 0), progress(1, 6, 1), progress(1, 7, 2), progress(2, 8, 3, metrics=False)):
        listener.onQueryProgress(event)
    assert metrics_table(spark, folder).count() == 2
    listener.onQueryTerminated(None)
    rows = {r.batch_id: (r.written, r.rejected, r.input_rows) for r in metrics_table(spark, folder).collect()}
    assert rows == {0: (5, 1, 9), 1: (7, 1, 9)}
