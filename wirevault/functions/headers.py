"""Header-map expressions.

A map column has no defined key order. Wherever order shows in a result, entries are
ordered by key length in bytes and then by key bytes, the order in which a binary JSON
object keeps its keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recomputed by the client or meaningful for one connection only.
HOP_HEADERS = ("content-length", "transfer-encoding", "connection")
# Request-line parts that the JSONL capture format keeps among the headers.
PSEUDO_HEADERS = ("method", "path", "scheme", "host")

EMPTY_MAP = "map<string,string>"


def or_empty(headers: Column) -> Column:
    return F.coalesce(headers, F.create_map().cast(EMPTY_MAP))


def ordered_entries(headers: Column) -> Column:
    """``array<struct<n, key, value>>`` in (length, bytes) order."""
    return F.array_sort(
        F.transform(
            F.map_entries(or_empty(headers)),
            lambda e: F.struct(
                F.octet_length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")
            ),
        )
    )


def lower_keys(headers: Column) -> Column:
    """Lower-case keys; of keys that differ only in case the last in key order wins.

    The common case, no such clash, is one map transform. The clash case drops the
    earlier entries itself, so the result does not depend on the session's policy for
    duplicate map keys.
    """
    h = or_empty(headers)
    plain = F.transform_keys(h, lambda k, v: F.lower(k))
    names = F.transform(ordered_entries(h), lambda e: F.lower(e["key"]))
    last_of_name = F.filter(
        ordered_entries(h),
        lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), F.lower(e["key"])) == 0,
    )
    merged = F.map_from_entries(
        F.transform(last_of_name, lambda e: F.struct(F.lower(e["key"]), e["value"]))
    )
    clash = F.size(F.array_distinct(F.transform(F.map_keys(h), lambda k: F.lower(k)))) < F.size(h)
    return F.when(clash, merged).otherwise(plain)


def header(headers: Column, name: str) -> Column:
    """Value of a header by exact key, or null."""
    return F.try_element_at(headers, F.lit(name))


def header_any_case(headers: Column, name: str) -> Column:
    """Value of a header whatever the case of its key; the last in key order, or null."""
    hits = F.filter(ordered_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(-1))["value"]


def without(headers: Column, names: Iterable[str]) -> Column:
    """Drop headers by name in any case."""
    lowered = [n.lower() for n in names]
    return F.map_filter(or_empty(headers), lambda k, v: ~F.lower(k).isin(lowered))


def header_lines(headers: Column, *, skip: Iterable[str] = ()) -> Column:
    """``array<string>`` of ``Name: value`` in key order."""
    skipped = [n.lower() for n in skip]
    entries = ordered_entries(headers)
    if skipped:
        entries = F.filter(entries, lambda e: ~F.lower(e["key"]).isin(skipped))
    return F.transform(
        entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
    )
