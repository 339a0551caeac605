"""Text expressions: content-type test, decoding, word tokens, substring patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A body is text when its lower-cased content type contains one of these.
TEXT_TYPE_HINTS = ("text/", "json", "xml", "javascript", "html", "x-www-form-urlencoded")

_NOT_WORD = r"[^\p{L}\p{N}_]+"


def is_text_type(content_type: Column) -> Column:
    """True when a content type announces text; null counts as an empty type."""
    return F.coalesce(F.lower(content_type), F.lit("")).rlike("|".join(TEXT_TYPE_HINTS))


def utf8_text(content: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD instead of raising."""
    return F.make_valid_utf8(content.cast("string"))


def indexable_text(content: Column, *, strip_markup: bool = False, chars: int | None = None) -> Column:
    """The part of a body that is searchable: decoded, without NUL; all of it unless ``chars`` is given.

    ``strip_markup`` leaves tag names and attributes out of the words.
    """
    text = F.replace(utf8_text(content), F.lit("\0"), F.lit(""))
    if chars is not None:
        text = F.substring(text, 1, chars)
    return F.regexp_replace(text, "<[^>]*>", " ") if strip_markup else text


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words: no stemming and no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != ""))


def has_all_words(tokens: Column, phrase: str) -> Column:
    """All words of ``phrase`` are in ``tokens``; a phrase without a word matches nothing.

    The phrase is split by the same expression as the bodies, folded to a constant by
    the optimiser, so that both sides always agree on what a word is.
    """
    words = word_tokens(F.lit(phrase))
    return (F.size(words) > 0) & (F.size(F.array_except(words, tokens)) == 0)


def ilike_contains(column: Column, text: str, *, literal: bool = False) -> Column:
    """Case-insensitive substring test.

    By default ``%``, ``_`` and backslash keep their pattern meaning inside ``text``;
    ``literal=True`` compares plain characters.
    """
    if literal:
        return F.contains(F.lower(column), F.lower(F.lit(text)))
    return column.ilike(_spark_pattern(f"%{text}%"))


def _spark_pattern(pattern: str) -> str:
    # Spark rejects a backslash before an ordinary character; SQL databases read it
    # as that character.
    out, chars = [], iter(pattern)
    for ch in chars:
        if ch == "\\":
            escaped = next(chars, "")
            out.append("\\" + escaped if escaped in ("%", "_", "\\") else escaped)
        else:
            out.append(ch)
    return "".join(out)


def shell_quote(text: Column) -> Column:
    """Single-quoted for a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def non_empty(text: Column) -> Column:
    """Null for an empty string, so that fallbacks chain with ``coalesce``."""
    return F.nullif(text, F.lit(""))
