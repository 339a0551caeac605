"""Near-duplicate lines by a segment-partition edit join.

How many edits make two lines alike depends on the shorter one: none up to five characters, one up
to 19, two beyond. Equal lines are counted first. A distinct line is cut into one segment more than
it allows edits; two lines within so many edits share at least one of them, nearly in place. Every line
is indexed by its segments and probes those of lines that are shorter by so many characters (or of its
own length) at the few places where a shared segment can stand, given the two lengths and the edits used up on
either side. Matching keys are joined; a 64-bit parity signature of letter pairs, which an edit
changes in at most four bits, drops most false candidates inside the join. What is left is checked
by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, stored
from .neardup import components
from .wordhash import _BASE, _INVERSE, _power_table, mix

# Lengths from which on a line allows one edit more.
EDIT_STEPS = (6, 20)
MIN_CHARS = 0
_CHUNK = 1 << 18


def distinct_lines(docs: DataFrame) -> DataFrame:
    """`line, n_copies, doc_id` (the smallest that has it) of every line that is not blank."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return (
        lines.where(F.length(F.translate("line", BLANK_CHARS, "")) > 0)
        .groupBy("line").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("doc_id"))
    )


def allowed_edits(length: np.ndarray | int, edits: int | None) -> np.ndarray:
    """The edits that a line of so many characters allows: by its length, or `edits` for all."""
    if edits is None:
        return np.searchsorted(EDIT_STEPS, length, side="right")
    return np.full(np.shape(length), edits)


def segment(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the k-th of `edits + 1` segments; the last ones are longer by one."""
    parts = edits + 1
    size, longer = length // parts, length % parts
    start = k * size + np.maximum(0, k - (parts - longer))
    return start, size + (k >= parts - longer)


def _keys(codes: np.ndarray, first: np.ndarray, length: np.ndarray, most: int | None):
    """Index and probe keys of many lines at once: (line, key) arrays of both kinds.

    `codes` holds the lines' characters one after the other, `first` where each begins. The edits of a
    pair are those that the indexed line allows, which is the shorter one or as long as the other.
    """
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(codes) + 1)[: len(codes)], out=total[1:])
    inverse = _power_table(_INVERSE, len(codes) + 1)

    def key(at: np.ndarray, size: np.ndarray, of_length: np.ndarray, k: int) -> np.ndarray:
        text = (total[at + size] - total[at]) * inverse[at]
        return mix(mix(text) + of_length.astype(np.uint64) * np.uint64(64) + np.uint64(k)).view(np.int64)

    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    index, probe = [none], [none]
    own = allowed_edits(length, most)
    levels = range(1, len(EDIT_STEPS) + 1) if most is None else (most,)
    for edits, k in ((e, k) for e in levels for k in range(e + 1)):
        start, size = segment(length, k, edits)
        line = np.flatnonzero((own == edits) & (length > edits))
        index.append((line, key(first[line] + start[line], size[line], length[line], k)))
        for gap in range(edits + 1):  # the other line is shorter by so many characters
            other = length - gap
            fits = (other > edits) & (allowed_edits(other, most) == edits)
            start, size = segment(other, k, edits)
            left = edits - k
            low = np.maximum.reduce([np.zeros_like(start), start - k, start + gap - left])
            high = np.minimum.reduce([length - size, start + k, start + gap + left])
            for shift in range(-edits, 2 * edits + 1):
                at = start + shift
                ok = np.flatnonzero((at >= low) & (at <= high) & fits)
                if len(ok):
                    probe.append((ok, key(first[ok] + at[ok], size[ok], other[ok], k)))
    return tuple(tuple(np.concatenate(c) for c in zip(*rows)) for rows in (index, probe))


def _signatures(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of letter pairs in 64 bits, per line; the pair across a line's end is left out."""
    pair = mix(codes[:-1].astype(np.uint64) * np.uint64(0x1FFFFF) + codes[1:].astype(np.uint64))
    bits = np.zeros(len(codes), dtype=np.uint64)
    bits[:-1] = np.uint64(1) << (pair & np.uint64(63))
    bits[first[1:] - 1] = 0
    return np.bitwise_xor.reduceat(bits, first).view(np.int64)


def line_keys(lines: DataFrame, edits: int | None) -> DataFrame:
    """`line_id, signature, allowed, index, probe` of stored lines (line_id, line)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [np.frombuffer(t.as_py().encode("utf-32-le"), dtype=np.uint32) for t in batch.column("line")]
            begin, chars = 0, 0
            for k, text in enumerate(texts):
                chars += len(text)
                if chars < _CHUNK and k + 1 < len(texts):
                    continue
                part = texts[begin : k + 1]
                length = np.array([len(t) for t in part], dtype=np.int64)
                first, codes = np.cumsum(length) - length, np.concatenate(part)
                lists = []
                for line, key in _keys(codes, first, length, edits):
                    order = np.argsort(line, kind="stable")
                    offsets = np.searchsorted(line[order], np.arange(len(part) + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(offsets, key[order]))
                allowed = pa.array(allowed_edits(length, edits).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("line_id").slice(begin, len(part)), pa.array(_signatures(codes, first)), allowed, *lists],
                    names=["line_id", "signature", "allowed", "index", "probe"],
                )
                begin, chars = k + 1, 0

    return lines.select("line_id", "line").mapInArrow(
        batches, "line_id bigint, signature bigint, allowed int, index array<bigint>, probe array<bigint>"
    )


def within_edits(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two texts is at most `edits`.

    Common ends are cut off. The rest runs down the diagonal band of width 2 * edits + 1: one bit
    per cell tells the difference to its neighbour, one word operation does a whole column.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    lead = _common(a, b, n)
    a, b, n = a[lead:], b[lead:], n - lead
    tail = _common(a[::-1], b[::-1], n)
    a, b = sorted((a[: len(a) - tail], b[: len(b) - tail]), key=len, reverse=True)
    if len(a) <= edits:
        return True
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(a[:edits]):
        where[c] = where.get(c, 0) | 1 << k
    # Bit i of a column j stands for row j + i - edits of the table.
    plus, minus, distance = full << edits & full, 0, edits
    masks = {c: m << (edits + 1) for c, m in where.items()}
    for j, c in enumerate(b):
        masks = {k: m >> 1 for k, m in masks.items() if m >> 1}
        if j + edits < len(a):
            masks[a[j + edits]] = masks.get(a[j + edits], 0) | top
        eq = masks.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hn = (minus | ~(d0 | plus)) & full, plus & d0
        if j + edits < len(a):
            distance += not d0 & top  # the band's lower edge goes down the diagonal
        else:
            at = 1 << (len(a) - 1 - j + edits)
            distance += bool(hp & at) - bool(hn & at)
        plus, minus = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
        if distance > edits + min(len(b) - 1 - j, len(b) - len(a) + edits):
            return False  # the last row can only win back one per column
    return distance <= edits


def _common(a: str, b: str, n: int) -> int:
    """Length of the common beginning, at most n."""
    low, step = 0, 64
    while low < n and a[low : low + step] == b[low : low + step]:
        low += step
    low, high = min(low, n), min(low + step, n)
    while low < high and a[low] == b[low]:
        low += 1
    return low


def line_links(lines: DataFrame, *, edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """All pairs a < b of different stored lines (line_id, line) within the edits that the shorter one allows.

    These go by its length, or are `edits` for all lines longer than that. Only lines of `min_chars`
    characters or more are compared. Keys shared by many lines are split by the join; no group is
    gathered anywhere.
    """
    least = EDIT_STEPS[0] if edits is None else edits + 1  # shorter lines allow no edit, or have no segments
    long_lines = lines.where(F.length("line") >= max(min_chars, least))
    keys = stored(line_keys(long_lines, edits), "line-keys")
    index = keys.select(F.explode("index").alias("key"), F.col("line_id").alias("x"), F.col("signature").alias("sx"), "allowed")
    probe = keys.select(F.explode("probe").alias("key"), F.col("line_id").alias("y"), F.col("signature").alias("sy"))
    pairs = stored(
        index.join(probe, "key").where(
            (F.col("x") != F.col("y")) & (F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= 4 * F.col("allowed"))
        ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
        "line-pairs",
    )
    wanted = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    texts = stored(long_lines.select("line_id", "line").join(wanted, "line_id"), "line-texts")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist())
            near = [within_edits(a, b, int(allowed_edits(min(len(a), len(b)), edits))) for a, b in texts]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (texts.select(F.col("line_id").alias(k), F.col("line").alias(f"l{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(batches, "a bigint, b bigint")


def deduplicated_lines(docs: DataFrame, *, edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct line of `docs` (doc_id, text) that is not blank.

    `doc_id` (the smallest document that has it), `line`, `n_copies`, `n_links` (different lines
    within the edits that the shorter of both allows by EDIT_STEPS, or within `edits`), `class_line` (the smallest line reachable over links, in code point
    order) and `kept` (whether it is that line). Lines are parted by line feeds and compared
    as they are. Null and empty texts have no lines; repeated rows count as copies; a line only in
    documents without an id has a null doc_id. Other columns are not read.
    """
    lines = stored(distinct_lines(docs).withColumn("line_id", F.monotonically_increasing_id()), "lines")
    links = stored(line_links(lines, edits=edits, min_chars=min_chars), "line-links")
    degree = links.select(F.col("a").alias("line_id")).union(links.select("b")).groupBy("line_id").agg(F.count("*").alias("n_links"))
    reached = stored(components(links), "line-classes")
    named = lines.select(F.col("line_id").alias("node"), "line").join(reached, "node")
    least = named.groupBy("component").agg(F.min("line").alias("class_line"))
    linked = reached.join(least, "component").join(degree.withColumnRenamed("line_id", "node"), "node")
    out = lines.join(linked.select(F.col("node").alias("line_id"), "class_line", "n_links"), "line_id", "left")
    return out.select(
        "doc_id", "line", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("class_line", "line").alias("class_line"),
    ).withColumn("kept", F.col("line") == F.col("class_line"))
