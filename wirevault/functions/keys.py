"""Content and shape keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(content: Column) -> Column:
    """Lower-case hex sha256 of the bytes; null for no body, a real key for an empty one."""
    return F.sha2(content, 256)


def shape_key(host: Column, method: Column, path: Column, status: Column, body_sha: Column) -> Column:
    """Key of a distinct request shape. Scheme, port and query string take no part in it.

    Fixed format: the five parts joined by '|', a null status spelled ``None`` and a
    null body spelled as the empty string, then sha256.
    """
    parts = F.concat_ws(
        "|",
        host,
        method,
        path,
        F.coalesce(status.cast("string"), F.lit("None")),
        F.coalesce(body_sha, F.lit("")),
    )
    return F.sha2(parts, 256)


def packed_key(key: Column) -> Column:
    """A text key as bytes: hex of 256 bits in half the room, other text as it is; see `unpacked_key`."""
    hexed = key.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(key))).otherwise(F.concat(F.lit(b"\x00"), key.cast("binary")))


def unpacked_key(packed: Column) -> Column:
    """The text of a `packed_key`."""
    rest = F.substring(packed, 2, 1 << 30)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
