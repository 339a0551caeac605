"""Near duplicates by MinHash bands, odd sketches and an exact check.

A text's word shingles are sampled by `BANDS * ROWS` MinHash functions. Documents that agree in
all samples of a band share a bucket. Every sample toggles one bit of a parity bitmap, the odd
sketch; the XOR of two sketches has a population count that tells the size of the difference of
the samples, and so the similarity, most precisely where it is high. Candidates whose estimate is
more than five standard errors below the threshold are dropped, all others are compared on their
full shingle sets.

No bucket is expanded into its pairs at once. Texts with equal sets are one node from the start.
Then every node is compared with the smallest node it shares a bucket with. What that links is one
component. Only buckets that still hold several components are searched further: nodes live in
homes of bounded size, homes that share such a bucket are searched pairwise, so that no task sees a
large bucket whole, and only pairs of different components are compared, likely ones first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, lookup
from .common import stored
from .wordhash import mix, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
ROWS = 6
BANDS = 42
SKETCH_BITS = 512
# The estimate's standard error at a similarity of 0.8 is 0.03: floor = 0.8 - 5 * 0.03.
ESTIMATE_MARGIN = 0.15
# A home holds about so many texts, and so many bytes of them, at most.
HOME = 512
HOME_BYTES = 8 << 20
# Rows of one set from which on they are split, in a large corpus a thousandth of all.
HOT_ROWS = 1000

_rng = np.random.default_rng(977)
_FACTOR = (_rng.integers(0, 1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _rng.integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint32)[:, None]
_PLACE = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_BAND = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(window_hashes(word_hashes(text), size))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048]
        np.minimum(best, (part[None, :] * _FACTOR + _SHIFT).min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = _BAND.copy()
    for column in samples.astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    places = (mix(samples.astype(np.uint64) ^ _PLACE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    rest = np.maximum(1 - 2 * np.asarray(differing, dtype=np.float64) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(rest)


_SKETCH = "doc_id bigint, n_bytes bigint, n_shingles bigint, digest binary, bands array<bigint>, odd array<bigint>"
_NOTHING = (0, None, np.empty(0, np.int64), np.empty(0, np.int64))


def _sketch(text: str | None, size: int) -> tuple:
    shingles = shingle_set(text, size)
    if not len(shingles):
        return _NOTHING
    samples = minhash(shingles)
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return len(shingles), digest, band_keys(samples), odd_sketch(samples)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *arrays]))


def sketches(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """Per row of `docs` (doc_id, text): bytes of the text, set size, digest of the set, band keys and odd sketch."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                seen: dict = {}
                rows = [
                    seen[t] if t in seen else seen.setdefault(t, _sketch(t, shingle))
                    for t in part.column("text").to_pylist()
                ]
                n, digest, bands, odd = zip(*rows)
                size = pc.cast(pc.binary_length(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(bands), _lists(odd)],
                    names=["doc_id", "n_bytes", "n_shingles", "digest", "bands", "odd"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, _SKETCH)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: `node, component` (the smallest node) of every node on an edge (a, b).

    Alternating large and small stars, each round written to the shared folder, until nothing
    changes. A hub is only ever reduced by partial minima and split joins.
    """
    stars = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select("b", "b").distinct()
            )
        before = state
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        stars = stored(
            small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select("b", "m")).where("a <> b").distinct(),
            "stars",
        )


def _linked(pairs: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in stream:
            keep = []
            for left, right in zip(batch.column("ta"), batch.column("tb")):
                right = right.as_py()
                if right != hub:
                    hub, hub_set = right, shingle_set(right, shingle)
                keep.append(_similar(shingle_set(left.as_py(), shingle), hub_set, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(
        batches, "a bigint, b bigint"
    )


def _differing() -> Column:
    return F.aggregate(
        F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n
    )


def _most_differing(similarity: float) -> int:
    """The largest population count whose estimate is at least `similarity`."""
    return int(np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= similarity).max())


def _cross_links(placed: DataFrame, nodes: DataFrame, *, most: int, shingle: int, percent: int) -> DataFrame:
    """Links between different components, as far as they join any.

    `placed`: bucket, node, component, home; `nodes`: node, component, home, bands, odd, text. A home
    holds about `HOME` nodes and `HOME_BYTES` of text, or one longer text. Two homes, or one with itself, are searched if they share a bucket and
    have more than one component; their nodes are gathered once, however many buckets they share.
    Pairs that share a band and differ in at most `most` sketch bits are compared on full sets, the
    likeliest first, and passed over once links have joined their components. Only links leave.
    """
    homes = placed.groupBy("bucket", "home").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = homes.groupBy("bucket").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low < _high")
    open_homes = homes.join(several.select("bucket"), "bucket", "left_semi")
    left, right = (open_homes.select("bucket", *(F.col(c).alias(f"{c}{k}") for c in ("home", "low", "high"))) for k in "12")
    pairs = left.join(right, "bucket").where(
        "home1 <= home2 AND least(low1, low2) < greatest(high1, high2)"
    ).select("home1", "home2").distinct()
    both = pairs.select("home1", "home2", F.col("home1").alias("home")).union(
        pairs.where("home1 < home2").select("home1", "home2", "home2")
    )
    fields = ("node", "component", "home", "bands", "odd", "text")
    gathered = both.join(nodes, "home").groupBy("home1", "home2").agg(F.collect_list(F.struct(*fields)).alias("nodes"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [pair for group in batch.column("nodes") for pair in _group_links(group.values, most, shingle, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return gathered.select("nodes").mapInArrow(batches, "a bigint, b bigint")


def _group_links(group: pa.StructArray, most: int, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components among the nodes of one home, or across two."""
    node, component, home = (group.field(f).to_numpy() for f in ("node", "component", "home"))
    bands, odd = (group.field(f).flatten().to_numpy().reshape(len(node), -1) for f in ("bands", "odd"))
    odd, across = odd.view(np.uint64), home.min() < home.max()
    near: list[np.ndarray] = []
    for i in range(len(node)):
        rest = np.flatnonzero((component != component[i]) & ((home > home[i]) if across else (node < node[i])))
        rest = rest[(bands[rest] == bands[i]).any(axis=1)]
        bits = np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1).astype(np.int64)
        kept = bits <= most
        near.append(np.column_stack((bits[kept], np.full(int(kept.sum()), i), rest[kept])))
    pairs = np.concatenate(near)
    pairs = pairs[np.lexsort((node[pairs[:, 2]], node[pairs[:, 1]], pairs[:, 0]))]
    up: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    texts, found = group.field("text"), []

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    for _, i, j in pairs.tolist():
        ri, rj = root(int(component[i])), root(int(component[j]))
        if ri == rj:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = shingle_set(texts[k].as_py(), shingle)
        if _similar(sets[i], sets[j], percent):
            up[max(ri, rj)] = min(ri, rj)
            found.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
    return found


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sorted sets are similar enough; sizes too different need no look."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs` (doc_id, text): `n_shingles`, `component_id` and `kept`.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of word
    shingles (A-Z lower-cased; with fewer words the whole sequence is one shingle). The component is
    the smallest doc_id reachable over links; it is the one kept. Texts that are null, empty or
    blank have no shingles and are alone. Repeated rows of an id are in one component and kept or
    not together. Rows without an id link with nothing, have a null component and are kept. No rows
    in, no rows out. Columns beside the two are not read.
    """
    sketched = stored(sketches(docs, shingle=shingle), "sketches")
    usable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    nodes = stored(
        usable.select("digest", F.col("doc_id").alias("node"), "n_bytes", "bands", "odd")
        .join(classes.select("digest", "node"), ["digest", "node"]).drop("digest"),
        "nodes",
    )
    bucketed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("_top")).where("pivot < _top")
    members = stored(bucketed.join(shared.select("bucket", "pivot"), "bucket"), "members")

    odd = nodes.select("node", "odd")
    lowest = members.groupBy("node").agg(F.min("pivot").alias("pivot"))
    sizes = lowest.join(nodes.groupBy("node").agg(F.sum("n_bytes").alias("n_bytes")), "node").groupBy("pivot").agg(
        F.ceil(F.greatest(F.count("*") / HOME, F.sum("n_bytes") / HOME_BYTES)).alias("_homes")
    )
    texts = stored(
        docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(
            lowest.join(sizes, "pivot").select(
                "node", F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.col("_homes"))).alias("home")
            ),
            "node",
        ),
        "texts",
    )
    floor = _most_differing(percent / 100 - ESTIMATE_MARGIN)
    check = {"shingle": shingle, "percent": percent}

    stars = lowest.select(F.col("node").alias("a"), F.col("pivot").alias("b")).where("b < a")
    near = (
        stars.join(odd.select(F.col("node").alias("a"), F.col("odd").alias("oa")), "a")
        .join(odd.select(F.col("node").alias("b"), F.col("odd").alias("ob")), "b")
        .where(_differing() <= floor)
    )
    links = stored(_linked(near, texts.select("node", "text"), **check), "links")
    reached = stored(components(links), "components")

    known = texts.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = members.select("bucket", "node").distinct().join(known.select("node", "component", "home").distinct(), "node")
    full = known.join(nodes.select("node", "bands", "odd"), "node")
    links = links.union(stored(_cross_links(placed, full, most=floor, **check), "links"))
    reached = stored(components(links), "components")

    of_class = classes.join(reached, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    hot = hot_keys(classes, "digest", "n", floor=HOT_ROWS)
    linked = lookup(
        usable.select("doc_id", "n_shingles", "digest"), of_class, "digest", table_key="digest", hot=hot, row_id="doc_id"
    ).drop("digest")
    alone = sketched.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of every group, with the columns it came with.

    Repeated rows of the kept id and text are one; rows without an id all stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, percent=percent)
    ids = kept.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))
