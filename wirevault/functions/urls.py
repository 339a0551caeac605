"""URL splitting with plain expressions.

``parse_url`` follows ``java.net.URI`` and gives up on hosts with an underscore or
URLs with a space, both of which occur in captured traffic. The generic pattern of
RFC 3986, appendix B accepts every string, so it is used instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import non_empty

# RFC 3986, appendix B, with the scheme restricted to its legal characters.
_URL = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$")
# Leading control characters and spaces are ignored, tab and line breaks anywhere.
_LEADING = r"^[\x00-\x20]+"
_BREAKS = r"[\t\r\n]"
_USER_INFO = r"(?s)^.*@"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, _LEADING, ""), _BREAKS, "")


def _authority(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(u, _URL, 2), _USER_INFO, "")


def _bracketed(authority: Column) -> Column:
    return F.contains(authority, F.lit("["))


def _port_text(authority: Column) -> Column:
    return F.when(_bracketed(authority), F.regexp_extract(authority, r"\][^:]*:(.*)$", 1)).otherwise(
        F.regexp_extract(authority, r"^[^:]*:(.*)$", 1)
    )


def _parts(u: Column, authority: Column, port_text: Column) -> dict[str, Column]:
    bracketed = _bracketed(authority)
    host = F.when(bracketed, F.regexp_extract(authority, r"\[([^\]]*)", 1)).otherwise(
        F.substring_index(authority, ":", 1)
    )
    # An IPv6 zone after '%' keeps its case.
    host = F.concat(
        F.lower(F.substring_index(host, "%", 1)), F.regexp_extract(host, "%.*$", 0)
    )
    port = F.when(port_text.rlike("^[0-9]+$"), port_text.try_cast("int"))
    return {
        "scheme": non_empty(F.lower(F.regexp_extract(u, _URL, 1))),
        "host": non_empty(host),
        "port": port,
        "path": F.regexp_extract(u, _URL, 3),
        "query": non_empty(F.regexp_extract(u, _URL, 4)),
        "bad_authority": (bracketed != F.contains(authority, F.lit("]")))
        | ((port_text != "") & ~F.coalesce(port.between(0, 65535), F.lit(False))),
    }


def split_url(url: Column) -> dict[str, Column]:
    """Columns ``scheme host port path query`` plus ``bad_authority``.

    Absent parts are null, except the path, which is then empty.
    """
    u = _clean(url)
    authority = _authority(u)
    return _parts(u, authority, _port_text(authority))


def with_url_parts(rows: DataFrame, url: str, names: dict[str, str]) -> DataFrame:
    """Rows with the parts of `split_url` as columns; ``names`` says what each part is called.

    The steps are columns of their own and the parts stand behind a generator, so that a filter by
    a part, which the optimiser would copy, splits no URL again.
    """
    steps = rows.withColumn("_u", _clean(F.col(url))).withColumn("_authority", _authority(F.col("_u"))).withColumn(
        "_port_text", _port_text(F.col("_authority"))
    )
    parts = _parts(F.col("_u"), F.col("_authority"), F.col("_port_text"))
    named = F.struct(*(parts[part].alias(name) for part, name in names.items()))
    return steps.select(*rows.columns, F.inline(F.array(named)))
