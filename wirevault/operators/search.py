"""Search over stored flows: combinable predicates, newest first, top-k."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import relevance
from ..functions.text import ilike_contains
from ..session import stored_once
from .bodies import join_bodies, matching_bodies
from .postings import bodies_with_words

SUMMARY = ("id", "ts", "method", "status", "url", "host", "fingerprints", "session_id", "program")
# Rows of a listing, of an interactive search and of the live view.
LISTING_ROWS, SEARCH_ROWS, LIVE_ROWS = 50, 300, 50


def newest_first() -> list[Column]:
    """Sort order of all listings; the id settles equal times."""
    return [F.col("ts").desc(), F.col("id").desc()]


def match_flows(
    flows: DataFrame,
    *,
    tech: Iterable[str] = (),
    host: str | None = None,
    status: int | None = None,
    method: str | None = None,
    program: str | None = None,
    session: str | None = None,
    since=None,
    id: int | None = None,
    terms: Iterable[str] = (),
    grep: str | None = None,
    body: str | None = None,
    body_text: DataFrame | None = None,
    body_words: DataFrame | None = None,
    hot: DataFrame | None = None,
    literal: bool = False,
) -> DataFrame:
    """The flows that satisfy every given predicate; empty strings are ignored.

    ``grep`` looks at response bodies, ``body`` at request and response bodies; both need
    ``body_words`` (postings, of which only those of the words are read) or ``body_text`` and look
    up the matching bodies at once, to see how many there are. Each of ``terms`` must occur in
    the host or in the URL.
    """
    kept = flows
    for name in tech:
        kept = kept.where(F.array_contains("fingerprints", name))
    if host:
        kept = kept.where(ilike_contains(F.col("host"), host, literal=literal))
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if method:
        kept = kept.where(F.col("method") == method.upper())
    if program:
        kept = kept.where(F.col("program") == program)
    if session:
        kept = kept.where(F.col("session_id") == session)
    if since:
        start = F.lit(since).cast(flows.schema["ts"].dataType)
        kept = kept.where(F.col("ts") >= start)
        if "dt" in flows.columns:
            kept = kept.where(F.col("dt") >= F.to_date(start))
    if id is not None:
        kept = kept.where(F.col("id") == id)
    for term in terms:
        in_host = ilike_contains(F.col("host"), term, literal=literal)
        kept = kept.where(in_host | ilike_contains(F.col("url"), term, literal=literal))
    if grep:
        hits, rows = stored_once(_body_hits(body_text, body_words, grep), "body-hits")
        kept = in_response(kept, hits, rows=rows, hot=hot)
    if body:
        hits, rows = stored_once(_body_hits(body_text, body_words, body), "body-hits")
        kept = in_either_body(kept, hits, rows=rows, hot=hot)
    return kept


def _body_hits(body_text: DataFrame | None, body_words: DataFrame | None, phrase: str) -> DataFrame:
    if body_words is not None:
        return bodies_with_words(body_words, phrase)
    if body_text is None:
        raise ValueError("a body search needs body_words or body_text")
    return matching_bodies(body_text, phrase)


def in_response(
    flows: DataFrame, hits: DataFrame, *, rows: int | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Flows whose response body is among ``hits``; flows without one never reach the join."""
    with_body = flows.where(F.col("resp_body_sha").isNotNull())
    marked = join_bodies(
        with_body, hits.withColumn("_hit", F.lit(True)), "resp_body_sha", rows=rows, hot=hot
    )
    return marked.where("_hit").drop("_hit")


def in_either_body(
    flows: DataFrame, hits: DataFrame, *, rows: int | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Flows whose request or response body is among ``hits``.

    One join with an OR condition would compare every flow with every hit. Two keyed joins
    that add a mark each stay hash or merge joins.
    """
    marked = flows
    for side in ("resp", "req"):
        flagged = hits.withColumn(f"_in_{side}", F.lit(True))
        marked = join_bodies(marked, flagged, f"{side}_body_sha", rows=rows, hot=hot)
    found = F.coalesce("_in_resp", F.lit(False)) | F.coalesce("_in_req", F.lit(False))
    return marked.where(found).drop("_in_resp", "_in_req")


def search(flows: DataFrame, *, limit: int | None = LISTING_ROWS, **predicates) -> DataFrame:
    """Newest matching flows as 9-column summaries; ``limit=None`` returns all of them."""
    return _newest(match_flows(flows, **predicates).select(*SUMMARY), limit)


def _newest(hits: DataFrame, limit: int | None) -> DataFrame:
    return hits if limit is None else hits.orderBy(*newest_first()).limit(limit)


def search_summaries(flows: DataFrame, *, limit: int | None = SEARCH_ROWS, **predicates) -> DataFrame:
    """Newest matching flows as 8-column summaries with ISO time and the tags as ``tech``.

    ``limit=None`` returns all of them; a limit is taken as it is.
    """
    return _newest(match_flows(flows, **predicates), limit).select(
        "id",
        iso_time(F.col("ts")).alias("ts"),
        "method",
        "status",
        "host",
        "path",
        "url",
        F.col("fingerprints").alias("tech"),
    )


def iso_time(ts: Column) -> Column:
    """ISO 8601 with the zone's offset; microseconds only where there are any."""
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == ".000000", "").otherwise(micros),
        F.date_format(ts, "xxx"),
    )


def ranked_search(
    flows: DataFrame, terms: Iterable[str], *, limit: int | None = SEARCH_ROWS, **predicates
) -> DataFrame:
    """The newest ``limit`` matches, best match in host and path first.

    Ranking happens after the cut, so old but well-matching flows do not push newer ones
    out. A term that occurs only in the query string scores 0 and keeps its row.
    """
    wanted = [t for t in terms if t]
    newest = _newest(match_flows(flows, terms=wanted, **predicates).select(*SUMMARY, "path"), limit)
    scored = newest.withColumn("score", relevance(wanted, F.concat("host", "path")))
    return scored.orderBy(F.col("score").desc(), *newest_first())


def live_tail(flows: DataFrame, *, limit: int = LIVE_ROWS) -> DataFrame:
    """The newest flows of all, with at most three tags each, for a polling view.

    Stored flows are partitioned by day. Counting rows per day reads file footers only, and
    the oldest day that is still needed prunes the scan to the newest days.
    """
    recent = flows
    if "dt" in flows.columns:
        recent = flows.where(F.col("dt") >= _oldest_day_needed(flows, limit))
    newest = recent.select(*SUMMARY).orderBy(*newest_first()).limit(limit)
    return newest.withColumn("fingerprints", F.slice("fingerprints", 1, 3))


def _oldest_day_needed(flows: DataFrame, limit: int) -> Column:
    """Scalar: the day on which the count from the newest day backwards reaches ``limit``."""
    per_day = flows.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.col("dt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    return days.where(F.col("newer") < limit).agg(F.min("dt").alias("dt")).scalar()
