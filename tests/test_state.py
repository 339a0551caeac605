"""Totals in streaming state: restarts, repeated batches, odd rows, plans."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wirevault.schemas import FLOW
from wirevault.session import new_scratch_dir
from wirevault.streaming import state

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def flow(second, path="/", body=b"x", program="p", host="h", status=200, req=None):
    given = {
        "ts": DAY.replace(second=second), "method": "GET", "host": host, "path": path, "status": status,
        "resp_body": body, "req_body": req, "program": program, "source_tool": "t",
    }
    return tuple(given.get(name) for name in FLOW.names)


@pytest.fixture
def waves(spark):
    """Feeds waves of flows to a stateful stream that is restarted for each of them."""
    root = new_scratch_dir(spark, "test-state")

    def feed(start, rows, *, forget=False, **options):
        spark.createDataFrame(rows, FLOW).coalesce(1).write.mode("append").parquet(f"{root}/incoming")
        flows = spark.readStream.schema(FLOW).parquet(f"{root}/incoming")
        query = start(flows, f"{root}/totals", checkpoint=f"{root}/checkpoint", available_now=True, **options)
        query.awaitTermination()
        batch = query.lastProgress["batchId"]
        if forget:
            commits = f"{root}/checkpoint/commits"
            for name in (f"{batch}", f".{batch}.crc"):
                if os.path.exists(f"{commits}/{name}"):
                    os.remove(f"{commits}/{name}")
        return f"{root}/totals", batch

    feed.root = root
    return feed


def test_shapes_survive_restarts_and_a_repeated_batch(spark, waves):
    first = [flow(5, program="late"), flow(7), flow(9, path="/other"), flow(3, host=None, status=None, body=None)]
    folder, batch = waves(state.stream_shapes, first, forget=True)
    before = spark.read.parquet(folder).where(F.col("batch") == batch).count()
    written = set(os.listdir(f"{folder}/batch={batch}"))
    folder, last = waves(state.stream_shapes, [flow(2, program="early"), flow(8), flow(3, host=None, status=None, body=None)])
    again = {n for n in os.listdir(f"{folder}/batch={batch}") if n.endswith(".parquet")}
    assert last > batch and again and not again & written  # the batch was repeated and replaced its rows
    assert spark.read.parquet(folder).where(F.col("batch") == batch).count() == before
    rows = {(r.host, r.path): r for r in state.shapes(spark, folder).collect()}
    assert {k: r.hit_count for k, r in rows.items()} == {("h", "/"): 4, ("h", "/other"): 1, (None, "/"): 2}
    hot = rows["h", "/"]
    assert hot.program == "early" and (hot.first_seen.second, hot.last_seen.second) == (2, 8)
    assert rows[None, "/"].status is None and rows[None, "/"].resp_body_sha is None
    # Only the shapes that a batch touches are written.
    assert spark.read.parquet(folder).where(F.col("batch") == last).where("path = '/other'").count() == 0


def test_equal_first_times_go_by_program(spark, waves):
    folder, _ = waves(state.stream_shapes, [flow(4, program="b"), flow(4, program="a"), flow(4, program="c")])
    row = state.shapes(spark, folder).collect()
    assert [(r.program, r.hit_count) for r in row] == [("a", 3)]


def test_bodies_are_counted_on_both_sides(spark, waves):
    waves(state.stream_body_counts, [flow(5), flow(6, req=b"x"), flow(7, body=b"")], forget=True)
    folder, _ = waves(state.stream_body_counts, [flow(1, body=b"y"), flow(2), flow(3, body=None)])
    found = {r["size"]: [] for r in state.body_counts(spark, folder).collect()}
    for r in state.body_counts(spark, folder).collect():
        found[r["size"]].append((r.seen_count, r.first_seen.second))
    assert {k: sorted(v) for k, v in found.items()} == {0: [(1, 7)], 1: [(1, 1), (4, 2)]}


def test_new_bodies_are_named_once(spark, waves):
    waves(state.stream_new_bodies, [flow(5), flow(6), flow(7, body=b"y")], forget=True)
    folder, _ = waves(state.stream_new_bodies, [flow(1), flow(2, body=b"z", req=b"y")])
    named = spark.read.parquet(folder).groupBy("sha256").count().collect()
    assert len(named) == 3 and {r["count"] for r in named} == {1}
    assert state.new_bodies(spark, folder).count() == 3


def test_state_is_kept_in_rocksdb_and_the_setting_is_restored(spark, waves):
    before = spark.conf.get(state._PROVIDER, None)
    waves(state.stream_shapes, [flow(5)])
    assert spark.conf.get(state._PROVIDER, None) == before
    stores = [n for _, _, names in os.walk(f"{waves.root}/checkpoint/state") for n in names]
    assert any(n.endswith((".zip", ".changelog")) for n in stores), stores


def test_totals_are_hash_aggregated(spark, waves):
    folder, _ = waves(state.stream_body_counts, [flow(5)])
    text = state.body_counts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text
