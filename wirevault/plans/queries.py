"""The registered queries: one per operator, over the whole test tables.

Operators that build tables run on the captured records themselves. Operators that read
tables run on an archive that is ingested once per session into the shared scratch folder,
as a user of the archive would run them.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..archive import Archive
from ..functions.headers import ordered_entries
from ..functions.keys import content_key, shape_key
from ..functions.ranking import all_match_offsets
from ..functions.text import utf8_text
from ..functions.urls import split_url
from ..operators import bodies as B
from ..operators import detail, replay, rollup, search, stats
from ..operators.tagging import RULES, PythonRule, Rule, RuleSet, tag_flows
from ..session import configure, make_folder, new_scratch_dir, remove_path, shuffles_dropped, stored_once
from ..sources.capture import parse_capture
from ..sources.common import dead_letters, good_records
from ..sources.jsonl import parse_jsonl, read_jsonl, stream_jsonl
from ..sources.tail import stream_tail
from ..streaming.ingest import ingest_jsonl_stream
from ..streaming.metrics import IngestMetrics, metrics_table
from ..streaming.state import body_counts, new_bodies, shapes, stream_body_counts, stream_new_bodies, stream_shapes
from .capture_view import capture_flows

# Per session and folder: what was derived and stored in the shared scratch folder.
_archives: dict[tuple[str, str], Archive] = {}
_files: dict[tuple[str, str], str] = {}
# Fixed value: the setting for the files that a task may have open when it writes to several folders.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def archive_of(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive of the captured records, ingested on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _archives:
        archive = Archive(spark, new_scratch_dir(spark, "archive"))
        archive.ingest(capture_flows(spark, sf_dir), batch_id=0)
        _archives[key] = archive
    return _archives[key]


# -- presentation: arrays, maps and zoned times as plain values ------------------------


def tags(column: str = "fingerprints") -> Column:
    return F.array_join(column, ",").alias("tags")


def local_time(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def header_text(column: str) -> Column:
    lines = F.transform(ordered_entries(F.col(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(lines, ";").alias(column)


def _summary(found: DataFrame) -> DataFrame:
    return found.withColumn("ts", local_time("ts")).withColumn("fingerprints", tags())


# -- bodies ------------------------------------------------------------------------------


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.observations(B.with_body_keys(capture_flows(configure(spark), sf_dir)))


def bodies_dedup(spark, sf_dir):
    return B.dedup_bodies(_observed(spark, sf_dir)).select(
        "sha256", "size", "is_text", "ever_text", "seen_count", local_time("first_seen"),
        F.length(utf8_text(F.col("content"))).alias("n_chars"),
    )


def body_text_index(spark, sf_dir):
    index = B.text_index(B.dedup_bodies(_observed(spark, sf_dir)))
    return index.select(
        "sha256", F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens_md5"),
    )


def stored_bodies(spark, sf_dir):
    """The bodies table as an archive keeps it."""
    return archive_of(spark, sf_dir).bodies().select(
        "sha256", "size", "is_text", "seen_count", local_time("first_seen"),
        F.length(utf8_text(F.col("content"))).alias("n_chars"),
    )


# -- roll-up -----------------------------------------------------------------------------


def _shapes(agg: DataFrame) -> DataFrame:
    return agg.select(
        "shape_sha", "program", "source_tool", "method", "host", "path", "status", "resp_body_sha",
        "hit_count", local_time("first_seen"), local_time("last_seen"), tags(),
    )


def flow_agg_rollup(spark, sf_dir):
    return _shapes(rollup.rollup(archive_of(spark, sf_dir).flows()))


def stored_flow_agg(spark, sf_dir):
    return _shapes(archive_of(spark, sf_dir).flow_agg())


def _collapsed_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """Purchases are collapsed: they count in the roll-up but leave no flow row."""
    archive = Archive(spark, new_scratch_dir(spark, "collapsed"))
    flows = capture_flows(configure(spark), sf_dir)
    archive.ingest(flows.withColumn("collapse", F.col("method") == "POST"), batch_id=0)
    return archive


def collapse_routing(spark, sf_dir):
    archive = _collapsed_archive(spark, sf_dir)
    key = shape_key(*(F.col(c) for c in ("host", "method", "path", "status", "resp_body_sha")))
    stored = archive.flows().groupBy(key.alias("shape_sha")).agg(F.count("*").alias("stored_flows"))
    return archive.flow_agg().select("shape_sha", "hit_count").join(stored, "shape_sha", "left").na.fill(0)


def archive_rebuild(spark, sf_dir):
    """The roll-up after a rebuild from stored flows and a later compaction: kept flows only."""
    archive = _collapsed_archive(spark, sf_dir)
    archive.rebuild_flow_agg()
    archive.compact()
    return archive.flow_agg().select("shape_sha", "hit_count")


def archive_counts(spark, sf_dir):
    """Records written and rejected, as the registry of batches has them."""
    archive = archive_of(spark, sf_dir)
    batches = archive._registry().where("kind = 'batch'")
    return batches.agg(F.sum("written").alias("written"), F.sum("rejected").alias("rejected"))


def archive_retag(spark, sf_dir):
    """A rule is added between two batches: stored flows and later ones carry its tag."""
    flows = capture_flows(configure(spark), sf_dir)
    middle = flows.agg((F.max("id") / 2).alias("m")).scalar()
    archive = Archive(spark, new_scratch_dir(spark, "retagged"))
    archive.ingest(flows.where(F.col("id") <= middle), batch_id=0)
    archive.retag(RuleSet([*RULES, PAGED]))
    archive.ingest(flows.where(F.col("id") > middle), batch_id=1)
    return archive.flows().select("id", tags())


def archive_retag_new(spark, sf_dir):
    """Flows without a tag get those of a new rule, between two batches, without new flow files."""
    flows = capture_flows(configure(spark), sf_dir)
    middle = flows.agg((F.max("id") / 2).alias("m")).scalar()
    archive = Archive(spark, new_scratch_dir(spark, "retagged-new"))
    archive.ingest(flows.where(F.col("id") <= middle), batch_id=0)
    archive.retag(RuleSet([*RULES, PAGED]), only_untagged=True)
    archive.ingest(flows.where(F.col("id") > middle), batch_id=1)
    return archive.flows().select("id", "batch_id", tags())


def schema_growth(spark, sf_dir):
    """A later batch brings a column that earlier ones and this reader do not know."""
    flows = capture_flows(configure(spark), sf_dir)
    middle = flows.agg((F.max("id") / 2).alias("m")).scalar()
    root = new_scratch_dir(spark, "grown")
    Archive(spark, root).ingest(flows.where(F.col("id") <= middle), batch_id=0)
    noted = flows.where(F.col("id") > middle).withColumn("note", F.concat(F.lit("seen "), "method"))
    Archive(spark, root, more=StructType().add("note", "string")).ingest(noted, batch_id=1)
    return Archive(spark, root).flows(all_columns=True).select("id", "note", tags())


# -- tags --------------------------------------------------------------------------------


def _tag(spark, sf_dir, rules=RULES, **options) -> DataFrame:
    a = archive_of(spark, sf_dir)
    tagged = tag_flows(
        a.flows(), a.body_content(), RuleSet(rules), hot=a.hot_bodies(), **options
    )
    return tagged.select("id", tags())


def fingerprint_all(spark, sf_dir):
    return _tag(spark, sf_dir)


PAGED = Rule("paged", lambda c: F.contains("query", F.lit("page=")))
LONG_JSON = Rule(
    "mentions-license",
    lambda c: c.body_test(lambda text: F.contains(F.lower(text), F.lit("license"))),
)


def fingerprint_untagged(spark, sf_dir):
    return _tag(spark, sf_dir, [*RULES, PAGED], only_untagged=True)


def user_rule(spark, sf_dir):
    return _tag(spark, sf_dir, [*RULES, PAGED, LONG_JSON])


def python_rule(spark, sf_dir):
    """A predicate that fails on flows without a Server header counts as no match there."""
    rule = PythonRule("short-page", lambda s, h, b: h["server"] != "" and s == 200 and 0 < len(b) < 500)
    return _tag(spark, sf_dir, [*RULES, rule])


# -- search ------------------------------------------------------------------------------


def _search(**predicates) -> Callable[[SparkSession, str], DataFrame]:
    needs_text = "grep" in predicates or "body" in predicates

    def run(spark, sf_dir):
        a = archive_of(spark, sf_dir)
        extra = {"body_words": a.body_words(), "hot": a.hot_bodies()} if needs_text else {}
        return _summary(search.search(a.flows(), **extra, **predicates))

    return run


def search_terms(spark, sf_dir):
    found = search.search_summaries(archive_of(spark, sf_dir).flows(), terms=["blog", "page=2"])
    return found.withColumn("tech", F.array_join("tech", ","))


def search_all(spark, sf_dir):
    """No limit: every flow that matches, with zoned ISO time."""
    found = search.search_summaries(archive_of(spark, sf_dir).flows(), terms=["example"], limit=None)
    return found.select("id", "ts", "host")


def search_by_id(spark, sf_dir):
    found = search.search_summaries(archive_of(spark, sf_dir).flows(), id=424)
    return found.withColumn("tech", F.array_join("tech", ","))


def search_ranked(spark, sf_dir):
    found = search.ranked_search(archive_of(spark, sf_dir).flows(), ["th", "page"])
    return _summary(found)


def live_tail(spark, sf_dir):
    return _summary(search.live_tail(archive_of(spark, sf_dir).flows()))


def match_offsets(spark, sf_dir):
    offsets = all_match_offsets(["th", "en/"], F.concat("host", "path"))
    return archive_of(spark, sf_dir).flows().select(
        "id", F.array_join(offsets.cast("array<string>"), ",").alias("offsets")
    )


def relevance_scores(spark, sf_dir):
    score = search.relevance(["th", "blog"], F.concat("host", "path"))
    return archive_of(spark, sf_dir).flows().select("id", score.cast("int").alias("score"))


# -- statistics --------------------------------------------------------------------------


def tech_facets(spark, sf_dir):
    return stats.tech_facets(archive_of(spark, sf_dir).flows())


def top_tech(spark, sf_dir):
    return stats.top_tech(archive_of(spark, sf_dir).flows())


def corpus_stats(spark, sf_dir):
    a = archive_of(spark, sf_dir)
    return stats.corpus_stats(a.flows(), a.body_stats())


def hosts_by_tech(spark, sf_dir):
    return stats.hosts_by_tech(archive_of(spark, sf_dir).flows()).withColumn("last_seen", local_time("last_seen"))


def top_shapes(spark, sf_dir):
    """The top shapes of the host with the most hits."""
    agg = archive_of(spark, sf_dir).flow_agg()
    hits = agg.groupBy("host").agg(F.sum("hit_count").alias("n"))
    busiest = hits.orderBy(F.col("n").desc(), "host").limit(1).select("host").scalar()
    return _shapes(stats.top_shapes(agg, busiest))


# -- details and replay ------------------------------------------------------------------


def _requests(spark, sf_dir) -> DataFrame:
    a = archive_of(spark, sf_dir)
    return detail.load_requests(a.flows(), a.body_content(), hot=a.hot_bodies())


def flow_request(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "id", local_time("ts"), "method", "scheme", "host", "port", "path", "query", "url", "status",
        header_text("req_headers"), content_key(F.col("req_body")).alias("req_body_sha"),
    )


def flow_full(spark, sf_dir):
    a = archive_of(spark, sf_dir)
    full = detail.load_full(a.flows(), a.body_content(), hot=a.hot_bodies())
    return full.select(
        "id", local_time("ts"), "program", "source_tool", "session_id", "method", "scheme", "host",
        "port", "path", "query", "url", "status", "duration_ms", tags(), header_text("req_headers"),
        header_text("resp_headers"), content_key(F.col("req_body")).alias("req_body_sha"),
        "req_is_text", content_key(F.col("resp_body")).alias("resp_body_sha"), "resp_is_text",
    )


def flow_detail(spark, sf_dir):
    a = archive_of(spark, sf_dir)
    d = detail.flow_details(a.flows(), a.body_content(), hot=a.hot_bodies())

    def flat(side: str) -> list[Column]:
        body = F.col(f"{side}_body")
        return [
            body["kind"].alias(f"{side}_kind"), body["size"].alias(f"{side}_size"),
            F.md5(body["text"]).alias(f"{side}_text_md5"),
        ]

    return d.select(
        "id", "ts", "program", "session_id", "method", "host", "path", "query", "url", "status",
        "duration_ms", tags("tech"), header_text("resp_headers"), *flat("req"), *flat("resp"),
    )


def flow_listing(spark, sf_dir):
    return detail.flow_listing(archive_of(spark, sf_dir).flows())


def curl_export(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", detail.curl_line().alias("curl"))


def raw_request(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", detail.request_text().alias("request"))


def body_preview(spark, sf_dir):
    a = archive_of(spark, sf_dir)
    previews = detail.flow_previews(a.flows(), a.body_content(), hot=a.hot_bodies())
    return previews.withColumn("resp_preview", F.md5("resp_preview"))


def request_variants(spark, sf_dir):
    """Every POST again as a PUT to another URL, without cookies, with a new body."""
    a = archive_of(spark, sf_dir)
    posts = search.match_flows(a.flows(), method="post")
    requests = detail.load_requests(posts, a.body_content(), hot=a.hot_bodies())
    mutations = requests.select(
        F.col("id").alias("flow_id"),
        F.lit("put").alias("method"),
        F.concat(F.lit("http://Staging.Example.com:8080/v2?id="), F.col("id").cast("string")).alias("url"),
        F.create_map(F.lit("accept"), F.lit("text/html"), F.lit("X-Replay"), F.lit("1")).alias("set_headers"),
        F.array(F.lit("COOKIE")).alias("unset_headers"),
        F.lit(b"{}").alias("body"),
    )
    variants = replay.request_variants(requests, mutations)
    return variants.select(
        "replay_of", "method", "scheme", "host", "port", "path", "query", "url",
        header_text("req_headers"), F.col("req_body").cast("string").alias("req_body"),
    )


MATRIX = (
    {"name": "plain", "url": "http://{host}:8080{path}{query}", "unset_headers": ["cookie"]},
    {"name": "method", "method": "options", "set_headers": {"X-Probe": "1", "ACCEPT": "text/html"}},
    {"name": "empty", "url": "https://probe.example.com/{id}", "body": b"[]"},
)


def request_matrix(spark, sf_dir):
    """Every request under three templates."""
    variants = replay.request_matrix(_requests(spark, sf_dir), MATRIX)
    return variants.select(
        "replay_of", "template", "method", "scheme", "host", "port", "path", "query", "url",
        header_text("req_headers"), F.col("req_body").cast("string").alias("req_body"),
    )


def stored_replays(spark, sf_dir):
    """Every POST is sent again and stored; the ids that come back lead to the pairs with the parents."""
    flows = capture_flows(configure(spark), sf_dir)
    archive = Archive(spark, new_scratch_dir(spark, "replayed"))
    archive.ingest(flows, batch_id=0)
    sent = flows.where("method = 'POST'").withColumns({
        "replay_of": F.col("id"), "request_key": F.concat(F.lit("request-"), F.col("id").cast("string")),
        "status": F.lit(200), "duration_ms": F.col("duration_ms") + 5,
    }).drop("id", "ingest_seq")
    archive.ingest(sent, batch_id=1, returning="request_key")
    pairs = replay.replay_pairs(archive.flows())
    return archive.returned_ids(1).join(pairs, "id").select(
        "key", "replay_of", "parent_status", "status", "status_changed", "body_changed", "duration_change_ms"
    )


def sendable_headers(spark, sf_dir):
    sent = archive_of(spark, sf_dir).flows().withColumn(
        "req_headers", replay.sendable_headers(F.col("req_headers"))
    )
    return sent.select("id", header_text("req_headers"))


def replay_pairs(spark, sf_dir):
    return replay.replay_pairs(archive_of(spark, sf_dir).flows())


def replay_chain(spark, sf_dir):
    return replay.replay_chain(archive_of(spark, sf_dir).flows())


# -- sources -----------------------------------------------------------------------------


def url_parts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = split_url(F.col("url"))
    return pages.select(
        "page_id", *(parts[n].alias(n) for n in ("scheme", "host", "port", "path", "query"))
    )


def jsonl_lines(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The captured records, or those with ``ids``, as JSONL lines (column ``value``), with the columns of ``ids``."""
    flows = capture_flows(configure(spark), sf_dir, ids)
    start = F.concat("method", F.lit(" "), "path", F.lit(" HTTP/1.1\r\nHost: "), "host", F.lit("\r\n\r\n"))
    status = F.coalesce(F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" Some")), F.lit("HTTP/1.1 none"))
    request = F.struct(
        F.map_concat(
            F.create_map(
                F.lit("method"), F.col("method"), F.lit("path"), F.col("path"),
                F.lit("scheme"), F.col("scheme"), F.lit("host"), F.col("host"),
            ),
            F.map_filter("req_headers", lambda k, v: k != "Host"),
        ).alias("header"),
        F.concat(start, F.coalesce(F.col("req_body").cast("string"), F.lit(""))).alias("raw"),
    )
    response = F.struct(
        F.map_concat(
            "resp_headers", F.create_map(F.lit("Content-Type"), F.col("resp_content_type"))
        ).alias("headers"),
        F.concat(
            status, F.lit("\r\nX: 1\r\n\r\n"), F.coalesce(F.col("resp_body").cast("string"), F.lit(""))
        ).alias("raw"),
    )
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "url", request.alias("request"), response.alias("response"),
    )
    more = [n for n in ids.columns if n != "id"] if ids is not None else []
    return flows.select("id", *more, F.to_json(record).alias("value"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Add the lines (column ``value``) to a folder of text files; they repeat bodies, so they are packed."""
    with shuffles_dropped(lines.sparkSession):
        lines.select("value").write.mode("append").option("compression", "gzip").text(folder)


def write_waves(lines: DataFrame, folder: str) -> None:
    """Lines (columns ``value, wave``) in one pass, packed, a folder for each of the `WAVES`: see `waves_upto`.

    A task keeps the file of every wave open, so that the lines need not be sorted by wave.
    """
    spark = lines.sparkSession
    before = spark.conf.get(_OPEN_FILES, None)
    spark.conf.set(_OPEN_FILES, str(WAVES))
    try:
        with shuffles_dropped(spark):
            lines.select("value", "wave").write.partitionBy("wave").option("compression", "gzip").text(folder)
    finally:
        if before is None:
            spark.conf.unset(_OPEN_FILES)
        else:
            spark.conf.set(_OPEN_FILES, before)
    for wave in range(WAVES):
        make_folder(spark, f"{folder}/wave={wave}")  # a wave may have no lines


def waves_upto(folder: str, wave: int) -> str:
    """The files of waves that have come by then, as a path."""
    return f"{folder}/wave=[0-{wave}]"


def jsonl_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of JSONL files with the captured records, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        folder = new_scratch_dir(spark, "jsonl")
        write_lines(jsonl_lines(spark, sf_dir), folder)
        _files[key] = folder
    return _files[key]


def parse_jsonl_records(spark, sf_dir):
    return _parsed_lines(read_jsonl(spark, jsonl_files(spark, sf_dir)))


def _parsed_lines(lines: DataFrame) -> DataFrame:
    flows = good_records(parse_jsonl(lines, program="p", session_id="s"))
    return flows.select(
        local_time("ts"), "method", "scheme", "host", "port", "path", "query", "url", "status",
        header_text("req_headers"), header_text("resp_headers"), "program", "session_id", "source_tool",
        "req_content_type", "resp_content_type",
        content_key(F.col("req_body")).alias("req_body_sha"),
        content_key(F.col("resp_body")).alias("resp_body_sha"),
    )


def dead_letter_lines(spark, sf_dir):
    """Lines are damaged by response status: torn, wrapped in an array, blank or a tunnel."""
    lines = spark.read.text(jsonl_files(spark, sf_dir))
    value = F.col("value")
    damaged = (
        F.when(F.contains(value, F.lit('"HTTP/1.1 403 ')), F.concat(F.lit("{"), value))
        .when(F.contains(value, F.lit('"HTTP/1.1 406 ')), F.concat(F.lit("["), value, F.lit("]")))
        .when(F.contains(value, F.lit('"HTTP/1.1 419 ')), F.lit("  \t "))
        .when(
            F.contains(value, F.lit('"HTTP/1.1 500 ')),
            F.replace(value, F.lit('"method":"GET"'), F.lit('"method":"CONNECT"')),
        )
        .otherwise(value)
    )
    parsed = parse_jsonl(lines.select(damaged.alias("value")))
    letters = dead_letters(parsed, source="jsonl").select(
        "source", "reason", F.regexp_extract("raw", '"timestamp":"([^"]*)"', 1).alias("seen_at")
    )
    kept = good_records(parsed).select(
        F.lit("jsonl").alias("source"), F.lit("kept").alias("reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("seen_at"),
    )
    return letters.unionByName(kept)


def normalise_capture(spark, sf_dir):
    flows = capture_flows(configure(spark), sf_dir)
    started = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ended = F.when(F.col("status").isNotNull(), started + F.col("duration_ms") / 1000.0)
    records = flows.select(
        "id",
        F.struct(
            "method", "scheme", "host", "port", "url", F.col("req_headers").alias("headers"),
            started.alias("timestamp_start"), F.col("req_body").alias("body"),
        ).alias("request"),
        F.when(
            F.col("status").isNotNull(),
            F.struct(
                F.col("status").alias("status_code"), F.col("resp_headers").alias("headers"),
                ended.alias("timestamp_end"), F.col("resp_body").alias("body"),
            ),
        ).alias("response"),
    )
    flows = good_records(parse_capture(records, program="p", session_id="s", collapse=True))
    return flows.select(
        "id", local_time("ts"), "method", "scheme", "host", "port", "path", "query", "url", "status",
        "duration_ms", header_text("req_headers"), header_text("resp_headers"), "program",
        "session_id", "source_tool", "collapse", "req_content_type", "resp_content_type",
        content_key(F.col("req_body")).alias("req_body_sha"),
        content_key(F.col("resp_body")).alias("resp_body_sha"),
    )


# -- streaming ---------------------------------------------------------------------------

_streamed: dict[tuple[str, str], Archive] = {}
WAVES = 3


def arrival_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, wave``: when a record arrives.

    The first record of a body, by id, comes with its half of the ids, and every other one a wave
    after its own half. So whatever the order inside a wave, a body is first seen where its id is least.
    """
    keyed = capture_flows(configure(spark), sf_dir).select("id", F.sha2("resp_body", 256).alias("_body"))
    flows, _ = stored_once(keyed, "arrivals")
    middle = flows.agg((F.min("id") + F.max("id")) / 2).scalar()
    first = flows.where("_body IS NOT NULL").groupBy("_body").agg(F.min("id").alias("id")).select("id", F.lit(0).alias("_later"))
    bodiless = flows.where("_body IS NULL").select("id", F.lit(0).alias("_later"))
    late = F.when(F.col("id") > middle, 1).otherwise(0)
    return flows.select("id").join(first.union(bodiless), "id", "left").select(
        "id", (late + F.coalesce("_later", F.lit(1))).alias("wave")
    )


def streamed_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """The JSONL lines stored by a file stream that is stopped and restarted between waves."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _streamed:
        configure(spark)
        root = new_scratch_dir(spark, "stream")
        archive = Archive(spark, f"{root}/archive")
        waves, _ = stored_once(arrival_waves(spark, sf_dir), "waves")
        write_waves(jsonl_lines(spark, sf_dir, waves), f"{root}/incoming")
        for wave in range(WAVES):
            stream = stream_jsonl(spark, waves_upto(f"{root}/incoming", wave), max_files_per_trigger=10_000)
            ingest_jsonl_stream(
                archive, stream, checkpoint=f"{root}/checkpoint", available_now=True, program="streamed"
            ).awaitTermination()
        _streamed[key] = archive
    return _streamed[key]


def _damaged(value: Column) -> Column:
    """Lines damaged by response status: torn, wrapped in an array, blank or a tunnel."""

    def answered(status: int) -> Column:
        return F.contains(value, F.lit(f'"HTTP/1.1 {status} '))

    tunnel = F.replace(value, F.lit('"method":"GET"'), F.lit('"method":"CONNECT"'))
    return (
        F.when(answered(403), F.concat(F.lit("{"), value)).when(answered(406), F.concat(F.lit("["), value, F.lit("]")))
        .when(answered(419), F.lit("  \t ")).when(answered(500), tunnel).otherwise(value)
    )


def stream_metrics(spark, sf_dir):
    """Records written and rejected, as the listener of a running stream stored them batch by batch."""
    configure(spark)
    root = new_scratch_dir(spark, "metrics")
    write_lines(jsonl_lines(spark, sf_dir).select(_damaged(F.col("value")).alias("value")), f"{root}/incoming")
    listener = IngestMetrics(spark, f"{root}/metrics")
    spark.streams.addListener(listener)
    try:
        stream = stream_jsonl(spark, f"{root}/incoming", max_files_per_trigger=3, spread=True)
        query = ingest_jsonl_stream(
            Archive(spark, f"{root}/archive"), stream, checkpoint=f"{root}/checkpoint", available_now=True, name="damaged"
        )
        query.awaitTermination()
        batches = len({p.batchId for p in query.recentProgress if p.numInputRows})
        deadline = time.monotonic() + 60  # progress reaches listeners a little later
        while time.monotonic() < deadline and listener.seen < batches:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
        listener.flush()
    rows = metrics_table(spark, f"{root}/metrics").where("name = 'damaged'")
    return rows.agg(F.sum("written").alias("written"), F.sum("rejected").alias("rejected"))


def tail_jsonl(spark, sf_dir):
    """Log files that grow in three steps, ending in the middle of a line twice, read by one stream."""
    configure(spark)
    root = new_scratch_dir(spark, "tail")
    folder = posix_path(f"{root}/logs")
    lines = jsonl_lines(spark, sf_dir)
    third = lines.agg((F.max("id") / 3).alias("m")).first()["m"]
    wave = F.least(F.floor(F.col("id") / F.lit(third)), F.lit(WAVES - 1)).cast("int")
    for n in range(WAVES):
        append_lines(lines.where(wave == n).select("value"), folder, torn=n < WAVES - 1)
        _parsed_lines(stream_tail(spark, folder, part_bytes=1 << 18)).writeStream.format("parquet").option(
            "checkpointLocation", f"{root}/checkpoint"
        ).trigger(availableNow=True).start(f"{root}/flows").awaitTermination()
    return spark.read.parquet(f"{root}/flows")


def _through_state(spark, sf_dir, start) -> str:
    """The folder of a stateful stream over the JSONL lines, whose records come in mixed order.

    The stream is stopped and restarted between waves; after each of them but the last, its last
    batch counts as unfinished, so the restarted stream repeats it.
    """
    configure(spark)
    root = new_scratch_dir(spark, "state")
    mixed = F.pmod(F.xxhash64("id"), F.lit(WAVES)).alias("wave")
    write_waves(jsonl_lines(spark, sf_dir).select("value", mixed), f"{root}/incoming")
    for wave in range(WAVES):
        arriving = stream_jsonl(spark, waves_upto(f"{root}/incoming", wave), max_files_per_trigger=10_000)
        flows = good_records(parse_jsonl(arriving, program="streamed"))
        query = start(flows, f"{root}/totals", checkpoint=f"{root}/checkpoint", available_now=True)
        query.awaitTermination()
        if wave < WAVES - 1:
            remove_path(spark, f"{root}/checkpoint/commits/{query.lastProgress['batchId']}")
    return f"{root}/totals"


def stream_state_rollup(spark, sf_dir):
    found = shapes(spark, _through_state(spark, sf_dir, stream_shapes))
    return found.withColumns({c: local_time(c) for c in ("first_seen", "last_seen")})


def stream_state_bodies(spark, sf_dir):
    found = body_counts(spark, _through_state(spark, sf_dir, stream_body_counts))
    return found.withColumn("first_seen", local_time("first_seen"))


def stream_new_keys(spark, sf_dir):
    """Bodies of the feed of new ones, and how often it named each."""
    folder = _through_state(spark, sf_dir, stream_new_bodies)
    named = spark.read.parquet(folder).groupBy("sha256").agg(F.count("*").alias("named"))
    return new_bodies(spark, folder).select("sha256", "size").join(named, "sha256")


def posix_path(uri: str) -> str:
    """The path of a folder on a shared disk."""
    return uri.removeprefix("file://").removeprefix("file:")


def append_lines(lines: DataFrame, folder: str, *, torn: bool) -> None:
    """Append the lines to log files, one per task, which must be on a disk that all tasks share.

    Lines are written where they are; nothing is shuffled. ``torn`` holds back the second half of the
    last line of a file for the next call. A task that runs again first cuts its file to the size that it
    had before.
    """
    os.makedirs(folder, exist_ok=True)
    sizes = {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".log")}
    before = {}
    for name in sizes:
        with open(f"{folder}/.{name}.rest", "rb") as file:
            before[name] = file.read()

    def append(name: str, values: Iterable[str]) -> None:
        last = b""
        with open(f"{folder}/{name}", "r+b" if name in sizes else "wb") as file:
            file.truncate(sizes.get(name, 0))
            file.seek(0, os.SEEK_END)
            file.write(before.get(name, b""))
            for value in values:
                file.write(last)
                last = value.encode() + b"\n"
            cut = len(last) // 2 if torn else len(last)
            file.write(last[:cut])
        with open(f"{folder}/.{name}.rest", "wb") as file:
            file.write(last[cut:])

    def write(rows) -> None:
        first = next(rows, None)
        if first is not None:
            append(f"{TaskContext.get().partitionId()}.log", (row["value"] for row in chain([first], rows)))

    lines.foreachPartition(write)
    for name in sizes:
        if os.path.getsize(f"{folder}/{name}") == sizes[name] and before[name]:
            append(name, ())  # no task had lines for this file


def stream_rollup(spark, sf_dir):
    return streamed_archive(spark, sf_dir).flow_agg().select(
        "shape_sha", "program", "source_tool", "method", "host", "path", "status", "resp_body_sha",
        "hit_count", local_time("first_seen"), local_time("last_seen"),
    )


def stream_bodies(spark, sf_dir):
    a = streamed_archive(spark, sf_dir)
    words = a.body_text().select("sha256", F.size("tokens").alias("n_tokens"))
    return a.bodies().join(words, "sha256", "left").select(
        "sha256", "size", "seen_count", local_time("first_seen"), "n_tokens",
        F.length(utf8_text(F.col("content"))).alias("n_chars"),
    )


def stream_body_types(spark, sf_dir):
    """Whether the first observation of each streamed body was text, and whether any was, folded over all batches."""
    return streamed_archive(spark, sf_dir).body_stats().select("sha256", "is_text", "ever_text")


def stream_tag_new(spark, sf_dir):
    """New flows carry tags as soon as they are stored; tags that depend on headers only."""
    by_header = F.filter("fingerprints", lambda t: ~t.isin("apigee", "graphql", "waf-generic"))
    return streamed_archive(spark, sf_dir).flows().select(
        local_time("ts"), "url", "status", F.array_join(by_header, ",").alias("tags")
    )


def stream_tag_all(spark, sf_dir):
    """All tags of new flows, those by body text too, as they are stored."""
    return streamed_archive(spark, sf_dir).flows().select(
        local_time("ts"), "url", "status", F.array_join("fingerprints", ",").alias("tags")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bodies_dedup": bodies_dedup,
        "body_text_index": body_text_index,
        "stored_bodies": stored_bodies,
        "flow_agg_rollup": flow_agg_rollup,
        "stored_flow_agg": stored_flow_agg,
        "collapse_routing": collapse_routing,
        "fingerprint_all": fingerprint_all,
        "fingerprint_untagged": fingerprint_untagged,
        "user_rule": user_rule,
        "python_rule": python_rule,
        "tech_facets": tech_facets,
        "top_tech": top_tech,
        "corpus_stats": corpus_stats,
        "search_tech": _search(tech=["nginx", "apigee"]),
        "search_host": _search(host="BLOG."),
        "search_host_pattern": _search(host="th_r%org", limit=None),
        "search_host_literal": _search(host="EXAMPLE.O", literal=True, limit=None),
        "search_status": _search(status=403),
        "search_method": _search(method="post"),
        "search_program": _search(program="prog-3"),
        "search_session": _search(session="s-8"),
        "search_since": _search(since="2024-01-20 12:00:00", limit=None),
        "search_grep": _search(grep="Access denied, the"),
        "search_grep_all": _search(grep="errors graphql", limit=None),
        "search_body_any": _search(body="k", limit=None),
        "search_combined": _search(
            tech=["waf-generic"], terms=["example"], body="denied", program="prog-1", since="2024-01-05", limit=None
        ),
        "search_terms": search_terms,
        "search_by_id": search_by_id,
        "search_all": search_all,
        "archive_counts": archive_counts,
        "archive_rebuild": archive_rebuild,
        "archive_retag": archive_retag,
        "archive_retag_new": archive_retag_new,
        "schema_growth": schema_growth,
        "search_ranked": search_ranked,
        "live_tail": live_tail,
        "match_offsets": match_offsets,
        "relevance_scores": relevance_scores,
        "flow_request": flow_request,
        "flow_full": flow_full,
        "flow_detail": flow_detail,
        "flow_listing": flow_listing,
        "curl_export": curl_export,
        "raw_request": raw_request,
        "body_preview": body_preview,
        "request_variants": request_variants,
        "request_matrix": request_matrix,
        "stored_replays": stored_replays,
        "sendable_headers": sendable_headers,
        "replay_pairs": replay_pairs,
        "replay_chain": replay_chain,
        "hosts_by_tech": hosts_by_tech,
        "top_shapes": top_shapes,
        "url_parts": url_parts,
        "parse_jsonl": parse_jsonl_records,
        "dead_letters": dead_letter_lines,
        "normalise_capture": normalise_capture,
        "tail_jsonl": tail_jsonl,
        "stream_metrics": stream_metrics,
        "stream_rollup": stream_rollup,
        "stream_state_rollup": stream_state_rollup,
        "stream_state_bodies": stream_state_bodies,
        "stream_new_keys": stream_new_keys,
        "stream_bodies": stream_bodies,
        "stream_body_types": stream_body_types,
        "stream_tag_new": stream_tag_new,
        "stream_tag_all": stream_tag_all,
    }
