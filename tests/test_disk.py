"""What is written and shuffled: bodies once per task, keys beside words once, packed lines."""

import os
import time

from flows import make
from pyspark.sql import functions as F

from wirevault import RULES, Archive, Rule, RuleSet
from wirevault.operators import bodies as B
from wirevault.operators import postings as P
from wirevault.plans import queries as Q
from wirevault.plans.capture_view import capture_flows
from wirevault.session import new_scratch_dir


def test_a_task_keeps_a_body_once(spark):
    rows = [dict(resp_body=b"one"), dict(resp_body=b"one"), dict(req_body=b"one", resp_body=b"two"), dict(resp_body=b"two"), dict()]
    keyed = B.with_body_keys(make(spark, *rows).coalesce(1))
    lean = B.content_once(keyed, where=F.col("id") > 1)
    kept = [(r.id, r.req_body, r.resp_body) for r in lean.orderBy("id").collect()]
    # The first row is left out, so the second has the first copy.
    assert kept == [(1, None, None), (2, None, b"one"), (3, None, b"two"), (4, None, None), (5, None, None)]
    assert [r[0] for r in lean.select("resp_body_sha").collect()] == [r[0] for r in keyed.select("resp_body_sha").collect()]
    assert B.content_once(keyed, where=F.lit(True), sides=["req"]).where("resp_body IS NOT NULL").count() == 4
    # A task that forgets keeps copies, never loses one.
    again = B.content_once(keyed, where=F.lit(True), remembered=1)
    assert {bytes(r[0]) for r in again.where("resp_body IS NOT NULL").select("resp_body").collect()} == {b"one", b"two"}
    for flows in (lean.where("id > 1"), keyed.where("id > 1")):
        found = B.dedup_bodies(B.observations(flows)).collect()
        assert {(bytes(r.content), r.size, r.seen_count) for r in found} == {(b"one", 3, 2), (b"two", 3, 2)}


def test_staged_copies_hold_a_body_once_and_raw_text_of_rejected_records_only(spark, monkeypatch):
    archive = Archive(spark, new_scratch_dir(spark, "lean"), RuleSet([*RULES, Rule("empty", lambda c: c.body_test(lambda t: F.coalesce(F.length(t), F.lit(0)) == 0))]))
    rows = [dict(resp_body=b"bad only"), *(dict(resp_body=b"page") for _ in range(9))]
    parsed = make(spark, *rows).coalesce(1).withColumns(
        {"raw": F.concat(F.lit("line "), "id"), "reason": F.when(F.col("id") <= 2, "bad_json")}
    )
    staged = {}
    number = archive._number

    def look(good, *more):
        whole = spark.read.parquet(f"{archive.root}/staging/batch_id=0")
        staged["raw"] = sorted(r[0] for r in whole.where("raw IS NOT NULL").select("raw").collect())
        staged["bodies"] = [bytes(r[0]) for r in whole.where("resp_body IS NOT NULL").select("resp_body").collect()]
        return number(good, *more)

    monkeypatch.setattr(archive, "_number", look)
    assert archive.ingest(parsed, batch_id=0) == (8, 2)
    assert staged == {"raw": ["line 1", "line 2"], "bodies": [b"page"]}
    # Left-out copies do not count as empty text.
    assert [(bytes(r.content), r.size, r.seen_count) for r in archive.bodies().collect()] == [(b"page", 4, 8)]
    assert archive.flows().where(F.array_contains("fingerprints", "empty")).count() == 0
    assert sorted(r.raw for r in archive.dead_letters().collect()) == ["line 1", "line 2"]


def test_keys_of_postings_are_shuffled_once_a_body(spark):
    index = spark.createDataFrame([(f"k{i}", ["a", "b"]) for i in range(9)], "sha256 string, tokens array<string>")
    plan = P.postings(index, 9)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert plan.count("Exchange") == 1 and "hashpartitioning(run" in plan and "rangepartitioning" not in plan


def test_chosen_events_are_those_of_a_join_on_ids(spark, small):
    ids = spark.createDataFrame([(3,), (5,), (5,), (None,), (10**9,)], "id bigint")
    names = ["id", "url", "status", "resp_body"]
    want = capture_flows(spark, small).join(ids, "id").select(*names)
    got = capture_flows(spark, small, ids).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_lines_are_packed(spark, tmp_path):
    folder = f"{tmp_path}/lines"
    lines = spark.range(2000).select(F.concat(F.lit("x" * 500), F.col("id")).alias("value")).coalesce(1)
    for part in ("id < 900", "id >= 900"):
        Q.write_lines(lines.withColumn("id", F.substring("value", 501, 9).cast("int")).where(part), folder)
    size = sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))
    assert size < 100_000
    assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(r.value for r in lines.collect())


def test_logs_grow_without_a_shuffle_and_finish_every_torn_line(spark, tmp_path):
    folder = f"{tmp_path}/logs"
    steps = [(["a1", "a2", "b1", "b2"], 2, True), (["a3"], 1, True), (["a4"], 1, False)]
    for values, parts, torn in steps:
        made = spark.createDataFrame(spark.sparkContext.parallelize([(v,) for v in values], parts), "value string")
        Q.append_lines(made, folder, torn=torn)
    found = {n: open(f"{folder}/{n}").read() for n in sorted(os.listdir(folder)) if n.endswith(".log")}
    assert found == {"0.log": "a1\na2\na3\na4\n", "1.log": "b1\nb2\n"}


def _plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_of_many_copies_of_a_body_one_moves(spark, monkeypatch):
    # Ids repeat, so copies are told by the number of the row.
    rows = [dict(id=1, req_body=b"a", resp_body=b"b"), dict(id=1, resp_body=b"a"), dict(id=2, resp_body=b"c"), dict(id=3), dict(id=3, resp_body=b"b")]
    flows = B.with_body_keys(make(spark, *rows)).withColumn("src_row", F.monotonically_increasing_id())
    obs = B.observations(flows, row="src_row")
    stats = B.body_stats(obs, F.min("copy").alias("copy")).where("seen_count > 1").select("sha256", "size", "copy")
    for limit in (0, 10):
        monkeypatch.setattr(B, "BROADCAST_ROWS", limit)
        content = B.chosen_content(obs, stats, 2)
        assert sorted((bytes(r.content), r.size) for r in content.collect()) == [(b"a", 1), (b"b", 1)]
    # The few chosen rows go to the content, which stays where it is.
    assert "BroadcastHashJoin" in _plan(content) and content.columns == ["sha256", "content", "size"]


def test_a_body_that_was_binary_is_indexed_from_the_batch_that_serves_it_as_text(spark, monkeypatch):
    for limit in (0, 10):
        monkeypatch.setattr(B, "BROADCAST_ROWS", limit)
        archive = Archive(spark, new_scratch_dir(spark, "late"))
        image = dict(resp_body=b"late words", resp_content_type="image/png")
        archive.ingest(make(spark, image, image, dict(resp_body=b"early words")).drop("id"), batch_id=0)
        page = dict(resp_body=b"late words", resp_content_type="text/html")
        archive.ingest(make(spark, page, page, dict(resp_body=b"early words"), dict(resp_body=b"other")).drop("id"), batch_id=1)
        assert sorted(bytes(r.content) for r in archive.body_content().collect()) == [b"early words", b"late words", b"other"]
        assert sorted(r.tokens for r in archive.body_text().collect()) == [["early", "words"], ["late", "words"], ["other"]]


def test_shapes_are_folded_in_one_pass(spark):
    flows = B.with_body_keys(make(spark, dict(program="b"), dict(program="a"), dict(path="/x", ts=None), dict(program="c", ts=None)))
    from wirevault.operators import rollup

    stats = rollup.shape_stats(flows)
    assert "Join" not in _plan(stats)
    # Flows without a time count, but a shape needs one flow that has it.
    assert [(r.program, r.hit_count, r.first_id) for r in stats.collect()] == [("b", 3, 1)]


def test_empty_lists_of_words_make_no_postings(spark):
    index = spark.createDataFrame([("k1", ["a"]), ("k2", []), ("k3", None)], "sha256 string, tokens array<string>")
    assert [(r.word, r["keys"]) for r in P.postings(index, 3).collect()] == [("a", ["k1"])]


def test_a_task_makes_the_lists_of_one_run_after_the_other(spark, monkeypatch):
    rows = [(f"k{i:02}", [f"w{j}" for j in range(9) if (i + j) % 3] + ["all", "é", "漢"]) for i in range(40)]
    index = spark.createDataFrame(rows, "sha256 string, tokens array<string>")
    want = {}
    for key, tokens in rows:
        for word in tokens:
            want.setdefault(word, []).append(key)
    for batch_keys in (1, 7, 10**6):
        monkeypatch.setattr(P, "BATCH_KEYS", batch_keys)
        assert {r.word: r["keys"] for r in P.postings(index, 40).coalesce(1).collect()} == want
    # Long bodies make more runs; nothing sorts or aggregates a key beside every word, which spilled.
    monkeypatch.setattr(P, "RUN_WORDS", 50)
    posted = P.postings(index, 40, sum(len(t) for _, t in rows))
    assert posted.select("run").distinct().count() > 3
    found = [(r.run, r.word) for r in posted.coalesce(1).collect()]
    assert found == sorted(found, key=lambda f: ([g[0] for g in found].index(f[0]), f[1].encode()))
    assert "Aggregate" not in _plan(posted) and _plan(posted).count("Sort") == 1


def test_lines_of_all_waves_are_written_at_once_without_a_sort(spark, tmp_path):
    folder = f"{tmp_path}/waves"
    lines = spark.range(40).select("id", F.col("id").cast("string").alias("value"), F.when(F.col("id") % 4 == 0, 2).otherwise(0).alias("wave"))
    before = spark.conf.get(Q._OPEN_FILES, None)
    Q.write_waves(lines.coalesce(1), folder)
    assert spark.conf.get(Q._OPEN_FILES, None) == before
    # One task wrote a file for each wave that has lines; lines kept their order, so nothing sorted them.
    assert [len([n for n in os.listdir(f"{folder}/wave={w}") if n.endswith(".gz")]) for w in range(Q.WAVES)] == [1, 0, 1]
    read = [[r.value for r in spark.read.text(Q.waves_upto(folder, w)).collect()] for w in range(Q.WAVES)]
    assert read[0] == read[1] == [str(i) for i in range(40) if i % 4] and len(read[2]) == 40


def test_columns_of_chosen_ids_come_along(spark, small):
    ids = spark.createDataFrame([(3, 1), (5, 0)], "id bigint, wave int")
    lines = Q.jsonl_lines(spark, small, ids)
    assert sorted((r.id, r.wave) for r in lines.collect()) == [(3, 1), (5, 0)] and lines.columns == ["id", "wave", "value"]


def test_stored_steps_leave_no_shuffle_files_and_the_setting_as_it_was(spark):
    from wirevault.llm.common import stored
    from wirevault.session import _DROP_SHUFFLES, shuffles_dropped, stored_once

    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {n for top in folders for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(_DROP_SHUFFLES, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    assert stored(counts, "counts").sparkSession is not None
    assert stored_once(counts, "counts")[1] == 7
    deadline = time.monotonic() + 20  # the files go in the background
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before
    with shuffles_dropped(spark), shuffles_dropped(spark):
        assert spark.conf.get(_DROP_SHUFFLES) == "true"
    assert spark.conf.get(_DROP_SHUFFLES, None) == setting
    assert sorted(r.n for r in counts.collect()) == sorted(r.n for r in counts.collect())


def test_postings_of_a_stored_index_move_nothing(spark, monkeypatch):
    rows = [(f"k{i:02}", [f"w{j}" for j in range(9) if (i + j) % 3] + ["all", "é"]) for i in range(40)] + [("none", []), ("null", None)]
    index = spark.createDataFrame(rows, "sha256 string, tokens array<string>").repartition(3)
    want = {}
    for key, tokens in rows[:40]:
        for word in tokens:
            want.setdefault(word, []).append(key)
    small = P.local_postings(index, 40)
    # The exchange is that of the test's own three parts.
    assert _plan(small).count("Exchange") == 1 and "Sort" not in _plan(small)
    assert {r.word: r["keys"] for r in small.collect()} == want  # one task, one run
    for bodies, words in ((7, 10**6), (10**6, 30)):
        monkeypatch.setattr(P, "RUN_BODIES", bodies)
        monkeypatch.setattr(P, "RUN_WORDS", words)
        found = P.local_postings(index, 40, sum(len(t) for _, t in rows[:40])).collect()
        got = {}
        for r in found:
            got.setdefault(r.word, []).extend(r["keys"])
            assert r["keys"] == sorted(r["keys"]) and len(r["keys"]) <= bodies
        assert {w: sorted(k) for w, k in got.items()} == want and len({r.run for r in found}) > 3
        # A body is in one run, so lists can be intersected run by run; a word is in a run once.
        assert len({(r.run, key) for r in found for key in r["keys"]}) == 40 and len({(r.run, r.word) for r in found}) == len(found)


def test_packed_keys_are_short_and_come_back(spark):
    from wirevault.functions.keys import packed_key, unpacked_key

    keys = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", "a", "x" * 32, "y" * 33, "\x01", "é" * 16, None, "0" * 63, "0" * 64]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("p", packed_key(F.col("k")))
    found = df.select("k", "p", unpacked_key(F.col("p")).alias("u")).collect()
    assert [r.u for r in found] == keys and len({r.p and bytes(r.p) for r in found}) == len(keys)
    assert len(found[0].p) == 33


def test_keys_move_packed(spark):
    from wirevault.operators import rollup

    flows = B.with_body_keys(make(spark, dict(resp_body=b"x"), dict(resp_body=None), dict(resp_body=b"x")))
    stats = rollup.shape_stats(flows)
    assert sorted(r.hit_count for r in stats.collect()) == [1, 2]
    assert "unhex" in _plan(stats)
    assert sorted(r.hit_count for r in rollup.merge_shape_stats(stats.unionByName(stats)).collect()) == [2, 4]


def test_only_bodies_that_were_sent_move_to_requests(spark, monkeypatch):
    from wirevault.operators import detail

    rows = [dict(req_body=b"sent"), dict(req_body=b"sent", resp_body=b"page"), dict(resp_body=b"other"), dict(req_body=b"")]
    keyed = B.with_body_keys(make(spark, *rows))
    bodies = B.distinct_content(B.observations(keyed))
    want = [(1, b"sent"), (2, b"sent"), (3, None), (4, b"")]
    plans = []
    for most, size in ((10, 100), (10, 0), (0, 0)):
        monkeypatch.setattr(detail, "BROADCAST_ROWS", most)
        monkeypatch.setattr(detail, "BROADCAST_BYTES", size)
        found = detail.load_requests(keyed, bodies)
        plans.append(_plan(found))
        assert sorted((r.id, None if r.req_body is None else bytes(r.req_body)) for r in found.collect()) == want
    assert "LeftSemi" in plans[0] and "LeftSemi" in plans[1] and "LeftSemi" not in plans[2]


def test_pages_go_to_the_events(spark, small):
    assert "BroadcastHashJoin [page_key" in _plan(capture_flows(spark, small).select("id", "url"))


def test_content_of_many_new_bodies_stays_where_it_is(spark, monkeypatch):
    from wirevault import archive as A

    image = dict(resp_content_type="image/png")
    rows = [
        *(dict(resp_body=b"page %d" % i) for i in range(5)), dict(resp_body=b"image", **image), dict(resp_body=b"late", **image),
        dict(resp_body=b"late", resp_content_type="text/html"), dict(resp_body=b"page 1"), dict(req_body=b"page 2", resp_body=b"known"),
    ]
    batches = [make(spark, dict(resp_body=b"known")).drop("id"), make(spark, *rows).drop("id").repartition(3)]
    found = {}
    for limit in (200_000, 5, 0):
        monkeypatch.setattr(A, "BROADCAST_ROWS", limit)
        archive, moved = Archive(spark, new_scratch_dir(spark, "stays")), []
        monkeypatch.setattr(A, "chosen_content", lambda obs, chosen, n: moved.append(n) or B.chosen_content(obs, chosen, n))
        for n, batch in enumerate(batches):
            archive.ingest(batch, batch_id=n)
        found[limit] = sorted((bytes(r.content), r.sha256, r.size, r.is_text) for r in archive.body_content().collect())
        words = sorted(tuple(sorted(r.tokens)) for r in archive.body_text().collect())
        found[limit] += [words]
        # The last list is that of bodies which were binary before; there are none.
        assert moved == {200_000: [1, 7, 0], 5: [1, 0], 0: [7, 0]}[limit]
    assert found[5] == found[0] == found[200_000] and len(found[5]) == 9


def test_answers_about_keys_leave_a_worker_batch_by_batch():
    import pyarrow as pa

    # A worker sends 64 KB at a time. Booleans of 10,000 rows are 2.5 KB, so rows with bodies piled up before it and spilled.
    keys = pa.array([f"k{i % 7}" for i in range(10_000)])
    answers = B._new_keys(100).func(iter([(keys, keys, keys), (keys, keys, keys)]))
    found = list(answers)
    assert all(batch.nbytes >= 65_536 for batch in found)
    assert [sum(batch.field(n).to_pylist()) for batch in found for n in (0, 1)] == [7, 0, 0, 0]


def test_a_lookup_of_unknown_size_is_not_broadcast_by_the_size_of_its_files(spark, tmp_path):
    from wirevault.operators.joins import lookup

    spark.range(50).select("id", (F.col("id") * 2).alias("parent")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    table = rows.select(F.col("id").alias("key"), F.col("parent").alias("payload"))
    plans = {n: _plan(lookup(rows, table, "parent", table_key="key", table_rows=n)) for n in (None, 200_001, 200_000)}
    assert "SortMergeJoin" in plans[None] and "SortMergeJoin" in plans[200_001] and "Broadcast" not in plans[None]
    assert "BroadcastHashJoin" in plans[200_000] and "SortMergeJoin" not in plans[200_000]
    found = lookup(rows, table, "parent", table_key="key").collect()
    assert sorted((r.id, r.payload) for r in found) == [(i, 4 * i if i < 25 else None) for i in range(50)]


def test_words_of_many_bodies_are_stored_as_numbers_of_a_dictionary(spark):
    import pyarrow.parquet as pq

    words = " ".join(f"word{i:06}" for i in range(120_000))
    archive = Archive(spark, new_scratch_dir(spark, "words"))
    archive.ingest(make(spark, *(dict(resp_body=f"{words} n{n}".encode()) for n in range(8))).drop("id").coalesce(1), batch_id=0)
    folder = archive.body_text().inputFiles()
    stored = 0
    for file in folder:
        found = pq.ParquetFile(file.removeprefix("file://")).metadata
        for group in range(found.num_row_groups):
            columns = (found.row_group(group).column(c) for c in range(found.num_columns))
            stored += sum(c.total_uncompressed_size for c in columns if "tokens" in c.path_in_schema)
    # Eight times 120,000 words of 10 letters, each of which is stored in letters once a file.
    assert stored < 2_000_000 * len(folder) + 3_500_000
    assert sorted(len(r.tokens) for r in archive.body_text().collect()) == [120_001] * 8
