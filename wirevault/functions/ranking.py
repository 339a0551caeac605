"""Relevance score and match positions of literal substrings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score: early matches and repeated matches weigh more, and a
# match at the start or right after one of these characters gets a bonus.
_BOUNDARY = ("/", ".", ":", "-", "_", "?", "&", "=")
_BASE, _FURTHEST, _BONUS = 100, 99, 20


def term_score(term: str, text: Column) -> Column:
    """Score of one term in ``text`` (any case); null when it does not occur."""
    needle, hay = F.lit(term.lower()), F.lower(text)
    at = F.instr(hay, needle)
    hits = F.floor(
        (F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.lit(len(term.lower()))
    )
    before = F.substr(hay, at - 1, F.lit(1))
    bonus = F.when((at == 1) | before.isin(*_BOUNDARY), _BONUS).otherwise(0)
    score = _BASE - F.least(at - 1, F.lit(_FURTHEST)) + hits + bonus
    return F.when(at > 0, score.cast("int"))


def relevance(terms: Iterable[str], text: Column) -> Column:
    """Sum of the term scores; 0 as soon as one term is absent, and 0 without terms."""
    total = F.lit(0)
    for term in terms:
        if term:
            total = total + term_score(term, text)
    return F.coalesce(total, F.lit(0))


def match_offsets(term: str, text: Column) -> Column:
    """Zero-based positions of every matched character, for non-overlapping matches.

    The pieces between matches give the match starts by a running length, so the work is
    linear in the number of matches rather than in the text length.
    """
    needle = term.lower()
    if not needle:
        return F.array().cast("array<int>")
    pattern = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.split(F.lower(text), pattern, -1)
    n = len(needle)
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at")),
        lambda acc, piece: F.struct(
            F.array_append(acc["found"], acc["at"] + F.length(piece)).alias("found"),
            (acc["at"] + F.length(piece) + n).alias("at"),
        ),
    )["found"]
    return F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (n - 1))))


def all_match_offsets(terms: Iterable[str], text: Column) -> Column:
    """Union of the positions of all terms, ascending; null when a term is absent."""
    wanted = [t for t in terms if t]
    found = [match_offsets(t, text) for t in wanted]
    if not found:
        return F.array().cast("array<int>")
    complete = F.lit(True)
    for offsets in found:
        complete = complete & (F.size(offsets) > 0)
    return F.when(complete, F.array_sort(F.array_distinct(F.flatten(F.array(*found)))))
