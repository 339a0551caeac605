"""Request variants for replay, and the lineage between a replay and its parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.headers import EMPTY_MAP, HOP_HEADERS, or_empty, without
from ..functions.keys import packed_key
from ..functions.text import non_empty
from ..functions.urls import split_url
from ..session import new_scratch_dir
from .joins import hot_keys, lookup


def _mutated_headers(headers: Column, set_headers: Column, unset_headers: Column) -> Column:
    gone = F.transform(
        F.concat(
            F.coalesce(unset_headers, F.array().cast("array<string>")),
            F.map_keys(or_empty(set_headers)),
        ),
        lambda name: F.lower(name),
    )
    kept = F.map_filter(or_empty(headers), lambda k, v: ~F.array_contains(gone, F.lower(k)))
    return F.map_concat(kept, or_empty(set_headers))


def mutate_requests(requests: DataFrame) -> DataFrame:
    """Apply the columns ``m_method, m_url, m_set_headers, m_unset_headers, m_body``.

    The method is upper-cased; a new URL is split again and replaces port, path and query
    even when it has none; header names match in any case; a body replaces the body when
    it is not null. An empty method or URL changes nothing.
    """
    new_url = non_empty(F.col("m_url"))
    parts = split_url(new_url)
    given = new_url.isNotNull()

    def replaced(new: Column, old: str) -> Column:
        return F.when(given, new).otherwise(F.col(old))

    changed = {
        "method": F.coalesce(F.upper(non_empty(F.col("m_method"))), F.col("method")),
        "url": F.coalesce(new_url, F.col("url")),
        "scheme": F.coalesce(parts["scheme"], F.col("scheme")),
        "host": F.coalesce(parts["host"], F.col("host")),
        "port": replaced(parts["port"], "port"),
        "path": replaced(F.coalesce(non_empty(parts["path"]), F.lit("/")), "path"),
        "query": replaced(parts["query"], "query"),
        "req_headers": _mutated_headers(
            F.col("req_headers"), F.col("m_set_headers"), F.col("m_unset_headers")
        ),
        "req_body": F.coalesce("m_body", "req_body"),
    }
    kept = [c for c in requests.columns if not c.startswith("m_")]
    return requests.select(*(changed[c].alias(c) if c in changed else c for c in kept))


_MUTATED = ("method", "url", "set_headers", "unset_headers", "body")
# Templates that one expression holds; more of them are applied in several passes.
TEMPLATES = 200


def request_variants(requests: DataFrame, mutations: DataFrame) -> DataFrame:
    """One variant per row of ``mutations`` (schema `schemas.MUTATION`), joined on the flow id.

    The result keeps the flow it came from as ``replay_of``. The mutations of a flow that has
    very many of them are split over tasks.
    """
    renamed = mutations.select(
        F.col("flow_id").alias("_of"),
        *(F.col(c).alias(f"m_{c}") for c in _MUTATED),
        F.xxhash64("method", "url", F.to_json("set_headers"), "unset_headers", "body").alias("_mutation"),
    )
    counts = renamed.groupBy(F.col("_of").alias("id")).agg(F.count("*").alias("n"))
    found = lookup(
        renamed, requests.withColumn("_found", F.lit(True)), "_of", table_key="id",
        hot=hot_keys(counts, "id", "n"), row_id="_mutation",
    )
    kept = found.where("_found").withColumnRenamed("_of", "id").drop("_found", "_mutation")
    return mutate_requests(kept).withColumnRenamed("id", "replay_of")


def request_matrix(requests: DataFrame, templates: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every request under every template: one variant each, with the template's name as ``template``.

    A template is a ``name`` and any of ``method, url, set_headers, unset_headers, body`` (bytes). In its
    URL, ``{id}``, ``{host}``, ``{path}`` and ``{query}`` stand for those of the request, ``{query}``
    with its question mark. Templates are constants of the plan, so requests are neither joined nor moved.
    """
    names = [str(t["name"]) for t in templates]
    unknown = {key for t in templates for key in t} - {"name", *_MUTATED}
    if not names or len(set(names)) < len(names) or unknown:
        raise ValueError(f"templates need names that differ and no other parts than {_MUTATED}")
    result = None
    for at in range(0, len(templates), TEMPLATES):
        some = F.array(*(_template(t) for t in templates[at : at + TEMPLATES]))
        rows = requests.drop("replay_of").select("*", F.inline(some))
        query = F.coalesce(F.concat(F.lit("?"), non_empty(F.col("query"))), F.lit(""))
        url = F.col("m_url")
        for mark, value in (("{id}", F.col("id").cast("string")), ("{host}", F.col("host")), ("{path}", F.col("path")), ("{query}", query)):
            url = F.replace(url, F.lit(mark), value)
        variants = mutate_requests(rows.withColumn("m_url", url)).withColumnRenamed("id", "replay_of")
        result = variants if result is None else result.unionByName(variants)
    return result


def _template(template: Mapping[str, object]) -> Column:
    added = [F.lit(x) for item in (template.get("set_headers") or {}).items() for x in item]
    return F.struct(
        F.lit(str(template["name"])).alias("template"),
        F.lit(template.get("method")).cast("string").alias("m_method"),
        F.lit(template.get("url")).cast("string").alias("m_url"),
        F.create_map(*added).cast(EMPTY_MAP).alias("m_set_headers"),
        F.array(*(F.lit(h) for h in template.get("unset_headers") or [])).cast("array<string>").alias("m_unset_headers"),
        F.lit(template.get("body")).cast("binary").alias("m_body"),
    )


def mutate_all(
    requests: DataFrame,
    *,
    method: str | None = None,
    url: str | None = None,
    set_headers: dict[str, str] | None = None,
    unset_headers: list[str] | None = None,
    body: bytes | None = None,
) -> DataFrame:
    """Apply one and the same mutation to every request of a selection."""
    added = [F.lit(x) for item in (set_headers or {}).items() for x in item]
    columns = {
        "m_method": F.lit(method).cast("string"),
        "m_url": F.lit(url).cast("string"),
        "m_set_headers": F.create_map(*added).cast(EMPTY_MAP),
        "m_unset_headers": F.array(*(F.lit(h) for h in unset_headers or [])).cast("array<string>"),
        "m_body": F.lit(body).cast("binary"),
    }
    return mutate_requests(requests.withColumns(columns)).withColumnRenamed("id", "replay_of")


def sendable_headers(headers: Column) -> Column:
    """Headers to forward: without those the client computes or that bind to one hop."""
    return without(headers, HOP_HEADERS)


def replay_pairs(flows: DataFrame) -> DataFrame:
    """Each replay next to its parent: status, body and duration changes.

    Flows that replay nothing are dropped from one side before the join; the other side is
    cut to the four columns that are compared. Body keys are only compared, so they move packed.
    """
    child = flows.where(F.col("replay_of").isNotNull()).select(
        "id", "replay_of",
        F.col("status").alias("status"),
        packed_key(F.col("resp_body_sha")).alias("body_sha"),
        F.col("duration_ms").alias("duration_ms"),
    )
    parent = flows.select(
        F.col("id").alias("parent_id"),
        F.col("status").alias("parent_status"),
        packed_key(F.col("resp_body_sha")).alias("parent_body_sha"),
        F.col("duration_ms").alias("parent_duration_ms"),
    )
    paired = lookup(child, parent.withColumn("_found", F.lit(True)), "replay_of", table_key="parent_id", hot=_hot_parents(child))
    return paired.where("_found").select(
        "id",
        "replay_of",
        "parent_status",
        "status",
        (~F.col("status").eqNullSafe(F.col("parent_status"))).alias("status_changed"),
        (~F.col("body_sha").eqNullSafe(F.col("parent_body_sha"))).alias("body_changed"),
        (F.col("duration_ms") - F.col("parent_duration_ms")).alias("duration_change_ms"),
    )


def _hot_parents(replays: DataFrame) -> DataFrame:
    """Flows that so many others replay that one task should not own all of them."""
    counts = replays.groupBy(F.col("replay_of").alias("parent_id")).agg(F.count("*").alias("n"))
    return hot_keys(counts, "parent_id", "n")


def replay_chain(flows: DataFrame) -> DataFrame:
    """``id, root, depth`` of every replay: the first ancestor and the number of steps to it.

    A replay whose pointers run into a cycle has no first ancestor; its root and depth are null.
    It is told by a depth beyond the number of replays, which doubling reaches in a few rounds.

    Pointer doubling: every round lets a replay jump to where its target already points,
    so a chain of a million replays takes twenty rounds, not a million. Replays whose
    root is known leave the join; rounds are written to the shared scratch folder, which
    cuts the lineage and survives lost executors.
    """
    spark = flows.sparkSession
    state = flows.where(F.col("replay_of").isNotNull()).select(
        "id", "replay_of", F.lit(1).cast("bigint").alias("depth"), F.lit(False).alias("done")
    )
    folder = new_scratch_dir(spark, "replay-chain")
    for step in count():
        seen = Observation()
        state.observe(
            seen, F.count(F.lit(1)).alias("all"), F.count_if(~F.col("done")).alias("open")
        ).write.parquet(f"{folder}/round={step}")
        state = spark.read.schema(state.schema).parquet(f"{folder}/round={step}")
        endless = F.col("depth") > seen.get["all"]
        if seen.get["open"] == 0:
            return state.select(
                "id", F.when(~endless, F.col("replay_of")).alias("root"), F.when(~endless, F.col("depth")).alias("depth")
            )
        open_ends = state.where(~F.col("done"))
        target = state.select(
            F.col("id").alias("parent_id"), F.col("replay_of").alias("next"),
            F.col("depth").alias("further"), F.col("done").alias("next_done"),
        )
        reached = lookup(
            open_ends.drop("done"), target, "replay_of", table_key="parent_id",
            table_rows=seen.get["all"], hot=_hot_parents(open_ends),
        )
        moved = reached.select(
            "id",
            F.coalesce("next", "replay_of").alias("replay_of"),
            (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"),
            F.coalesce("next_done", F.lit(True)).alias("done"),
        ).withColumn("done", F.col("done") | endless)
        state = state.where("done").unionByName(moved)
