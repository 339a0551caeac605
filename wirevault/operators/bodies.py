"""Content-addressed bodies: observations, counters, distinct content, text index.

Every operator here is a map-side-combined aggregate on the content hash, so a body that
makes up a third of the traffic costs one row per map task and not one per request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_key
from ..functions.text import has_all_words, indexable_text, is_text_type, word_tokens
from .joins import BROADCAST_ROWS, hot_keys, lookup

# Most body keys that a task remembers: some 100 MB. Beyond that it starts anew.
REMEMBERED = 500_000
# Bytes of a body that go to Python beside its key.
PIECE = 1_024


def with_body_keys(flows: DataFrame) -> DataFrame:
    """Add ``req_body_sha`` and ``resp_body_sha`` to normalised flows."""
    return flows.withColumns(
        {"req_body_sha": content_key(F.col("req_body")), "resp_body_sha": content_key(F.col("resp_body"))}
    )


def _new_keys(remembered: int) -> Callable[[Column, Column, Column], Column]:
    """Which of two body keys of a row a task meets for the first time (1); the third column is not looked at.

    Until the answer for a row is back, Spark holds that row with its bodies. Keys alone fill the 10 MB that a
    socket holds with some 100,000 rows, and booleans the 64 KB that a worker hands over at once with 250,000. So a
    piece of the body goes along, and answers are long numbers: some two batches of rows are held.
    """

    @F.arrow_udf("struct<req: bigint, resp: bigint>")
    def flags(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        met: set[str] = set()
        for batch in batches:
            new: tuple[list[int], list[int]] = ([], [])
            for row in zip(*(keys.to_pylist() for keys in batch[:2])):
                if len(met) >= remembered:
                    met.clear()
                for key, found in zip(row, new):
                    found.append(int(key is not None and key not in met))
                    met.add(key)
            yield pa.StructArray.from_arrays([pa.array(found, pa.int64()) for found in new], ["req", "resp"])

    return flags.asNondeterministic()  # a second evaluation would meet no new key


def content_once(flows: DataFrame, *, where: Column, sides: Sequence[str] = ("req", "resp"), remembered: int = REMEMBERED) -> DataFrame:
    """Flows with body keys, whose bodies are left out (null) where the same task had the same body before.

    Only rows that satisfy ``where`` have bodies, so every body of those is there at least once. Keys stay.
    """
    keys = [F.when(where, F.col(f"{s}_body_sha")) if s in sides else F.lit(None).cast("string") for s in ("req", "resp")]
    piece = F.substring(F.coalesce("resp_body", "req_body"), 1, PIECE)
    marked = flows.withColumn("_new", _new_keys(remembered)(*keys, piece))
    return marked.withColumns({f"{s}_body": F.when(F.col(f"_new.{s}") == 1, F.col(f"{s}_body")) for s in sides}).drop("_new")


def observations(flows: DataFrame, *, row: str | None = None) -> DataFrame:
    """One row per body seen: ``sha256, size, is_text, seq, ts, content``.

    ``flows`` are normalised flows with body keys. Both sides of a flow come out of a
    single pass; the request is observed before the response. After `content_once` size and
    content are null in most rows of a body, and the aggregates below pass over those. ``row``, a column
    that numbers the rows uniquely, adds ``copy``, the number of the observation by it, where it has its content.
    """

    def side(name: str, order: int) -> Column:
        body = F.col(f"{name}_body")
        copy = [] if row is None else [F.when(body.isNotNull(), F.col(row) * 2 + order).alias("copy")]
        return F.struct(
            F.col(f"{name}_body_sha").alias("sha256"),
            F.octet_length(body).alias("size"),
            is_text_type(F.col(f"{name}_content_type")).alias("is_text"),
            (F.col("ingest_seq") * 2 + order).alias("seq"),
            F.col("ts"),
            body.alias("content"),
            *copy,
        )

    both = flows.select(F.inline(F.array(side("req", 0), side("resp", 1))))
    return both.where(F.col("sha256").isNotNull())


def body_stats(obs: DataFrame, *more: Column, by: Sequence[str] = ("sha256",)) -> DataFrame:
    """Counters per distinct body, without its content; ``more`` adds aggregates of the caller.

    ``is_text`` is the flag of the first observation, ``ever_text`` whether any observation
    was text: a body first served as an image and later as a page is not flagged as text,
    yet its words are searchable.
    """
    return obs.groupBy(*by).agg(
        F.max("size").alias("size"),
        F.min_by("is_text", "seq").alias("is_text"),
        F.bool_or("is_text").alias("ever_text"),
        F.count("*").alias("seen_count"),
        F.min("ts").alias("first_seen"),
        F.min("seq").alias("first_seq"),
        *more,
    )


def merge_body_stats(parts: DataFrame, *more: Column) -> DataFrame:
    """Fold counters of several batches; associative, so order and grouping do not matter."""
    return parts.groupBy("sha256").agg(
        F.max("size").alias("size"),
        F.min_by("is_text", "first_seq").alias("is_text"),
        F.bool_or("ever_text").alias("ever_text"),
        F.sum("seen_count").alias("seen_count"),
        F.min("first_seen").alias("first_seen"),
        F.min("first_seq").alias("first_seq"),
        *more,
    )


def dedup_bodies(obs: DataFrame) -> DataFrame:
    """The bodies table in one pass over the observations: counters plus ``content``.

    Map-side combining leaves up to one copy of a hot body per map task. On a large input
    those copies would all meet in one task, and unlike counters they are wide. A salt
    taken from the map partition spreads them first: of n partitions, about twice the root
    of n share a salt, and about the root of n copies of a body reach the second aggregation.
    """
    salted = obs.withColumn("_salt", F.floor(F.sqrt(F.spark_partition_id())).cast("int"))
    any_copy = F.any_value("content", True).alias("content")
    parts = body_stats(salted, any_copy, by=["sha256", "_salt"]).drop("_salt")
    return merge_body_stats(parts, any_copy)


def distinct_content(obs: DataFrame) -> DataFrame:
    """What is stored of a body for good: key, size, content and its text flags so far."""
    return dedup_bodies(obs).select("sha256", "size", "is_text", "ever_text", "content")


def chosen_content(obs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """The content of ``chosen`` bodies (one row each: ``sha256, copy`` and more), ``rows`` in number.

    ``obs`` are observations with ``copy``. One copy of a body is taken, so a hot body is one row like
    others. Few chosen rows are broadcast and no content moves; otherwise it moves once, every copy on its own.
    """
    copies = obs.where(F.col("copy").isNotNull()).select("sha256", "copy", "content")
    return copies.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, ["sha256", "copy"]).drop("copy")


def odd_copies(obs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``copy, taken, is_text, ever_text`` of the copies that are not ``chosen`` or whose text flags are not their own.

    Where tasks hold a body once, most copies are chosen, so this list is short however many bodies there are.
    Numbers and flags are joined, neither keys nor content.
    """
    own = obs.where(F.col("copy").isNotNull()).select("copy", F.col("is_text").alias("_own"))
    flags = chosen.select("copy", F.lit(True).alias("taken"), "is_text", "ever_text")
    same = F.col("_own").eqNullSafe(F.col("is_text")) & F.col("_own").eqNullSafe(F.col("ever_text"))
    odd = own.join(flags, "copy", "left").where(F.col("taken").isNull() | ~same)
    return odd.select("copy", F.coalesce("taken", F.lit(False)).alias("taken"), "is_text", "ever_text")


def content_in_place(obs: DataFrame, odd: DataFrame) -> DataFrame:
    """The content of all copies but the odd ones that are not taken, with the text flags of their body; see `odd_copies`.

    The odd copies are broadcast, and no content moves.
    """
    copies = obs.where(F.col("copy").isNotNull()).select("sha256", "size", "copy", "content", F.col("is_text").alias("_own"))
    taken = copies.join(F.broadcast(odd), "copy", "left").where(F.coalesce("taken", F.lit(True)))
    flags = (F.when(F.col("taken"), F.col(n)).otherwise(F.col("_own")).alias(n) for n in ("is_text", "ever_text"))
    return taken.select("sha256", "size", *flags, "content")


def text_index(bodies: DataFrame, *, strip_markup: bool = False, chars: int | None = None) -> DataFrame:
    """``sha256, tokens`` for every distinct body that was ever served as text."""
    text = indexable_text(F.col("content"), strip_markup=strip_markup, chars=chars)
    return bodies.where("ever_text").select("sha256", word_tokens(text).alias("tokens"))


def matching_bodies(body_text: DataFrame, phrase: str) -> DataFrame:
    """Keys of the bodies that contain all words of ``phrase``."""
    return body_text.where(has_all_words(F.col("tokens"), phrase)).select("sha256")


def hot_bodies(stats: DataFrame, **limits: int) -> DataFrame:
    """``sha256, salts`` of the bodies whose flows need splitting in a join, see `joins.hot_keys`."""
    return hot_keys(stats.select("sha256", "seen_count"), "sha256", "seen_count", **limits)


def join_bodies(
    flows: DataFrame,
    bodies: DataFrame,
    key: str,
    *,
    rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join ``flows`` to rows of ``bodies`` (unique ``sha256`` plus payload), see `joins.lookup`."""
    return lookup(flows, bodies, key, table_key="sha256", table_rows=rows, hot=hot)
