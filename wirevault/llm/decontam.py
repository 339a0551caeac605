"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of about `SHARD_WORDS` words and builds the suffix array
of each: all places where at least a shortest window of benchmark words begins, sorted by the words
that follow. Every suffix of every benchmark item is looked up by binary search, which gives the
places where its window occurs; equal words are followed to the longest verbatim match. Documents
stay where they are: nothing is shuffled.

The benchmark's words are hashed in tasks and stored in the shared folder, dealt over blocks of about
`BLOCK_WORDS` words. The driver knows the number of blocks only. A task reads the blocks one after
the other for each of its shards and holds one at a time, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_scratch_dir
from .common import stored
from .wordhash import NOT_WORD, word_hashes

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_WORDS = 1_000_000

_FOUND = T.StructType([
    T.StructField("_n_words", T.LongType()),
    T.StructField("_spans", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("_longest", T.LongType()),
    T.StructField("_matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()),
    ]))),
])
_ARROW = {
    "_n_words": pa.int64(), "_spans": pa.list_(pa.int64()), "_items": pa.list_(pa.string()), "_longest": pa.int64(),
    "_matches": pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("words", pa.int64())])),
}


class Suffixes:
    """A block of benchmark items, ready to be searched for: words as numbers, one run per item."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        hashes = [h for _, h in items]
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.vocabulary, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        ends = np.cumsum(sizes)
        self.words = np.concatenate([numbers + 1, np.zeros(window, np.int64)])
        item = np.repeat(np.arange(len(sizes)), sizes)
        width = np.minimum(sizes, window)[item]
        place = np.arange(len(item))
        whole = place + width <= ends[item]  # suffixes long enough to hold a window
        self.at, self.item, self.width = place[whole], item[whole], width[whole]
        self.begin, self.end = (ends - sizes)[self.item], ends[self.item]
        self.shortest = int(self.width.min())
        self.longest = int(sizes.max())
        step = np.arange(window)
        self.mask = step[None, :] < self.width[:, None]
        self.heads = np.where(self.mask, self.words[self.at[:, None] + step], 0)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; 0 for words that no item has."""
        k = np.searchsorted(self.vocabulary, hashes)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)


def suffix_array(words: np.ndarray, shortest: int, depth: int, highest: int) -> np.ndarray:
    """Places followed by `shortest` or more known words, sorted by the next `depth` words.

    `words` ends in `depth` zeros or more. Words are packed into 63-bit keys; only places that are
    still tied are sorted by the next key.
    """
    n = len(words) - depth
    zeros = np.flatnonzero(words == 0)
    place = np.flatnonzero(words[:n])
    place = place[zeros[np.searchsorted(zeros, place)] - place >= shortest]
    bits = int(highest).bit_length()
    each = max(1, 63 // bits)

    def key(at: np.ndarray, start: int) -> np.ndarray:
        packed = np.zeros(len(at), dtype=np.int64)
        for k in range(start, min(start + each, depth)):
            packed = (packed << bits) | words[at + k]
        return packed

    keys = key(place, 0)
    order = np.argsort(keys, kind="stable")
    array, keys = place[order], keys[order]
    new = np.ones(len(array) + 1, dtype=bool)
    new[1:-1] = keys[1:] != keys[:-1]
    for start in range(each, depth, each):
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        group, keys = np.cumsum(new[:-1])[tied], key(array[tied], start)
        order = np.lexsort((keys, group))
        array[tied], keys = array[tied][order], keys[order]
        new[tied[1:]] |= keys[1:] != keys[:-1]
    return array


def search(block: Suffixes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the block's windows in `words`: index of the suffix and place."""
    none = np.empty(0, np.int64)
    array = suffix_array(words, block.shortest, block.longest, len(block.vocabulary))
    if not len(array):
        return none, none
    step = np.arange(block.window)
    rows = np.arange(len(block.at))

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(array) - 1)
            ahead = np.where(block.mask, words[array[mid][:, None] + step], 0) - block.heads
            sign = ahead[rows, (ahead != 0).argmax(axis=1)]
            right = (sign <= 0 if after_equal else sign < 0) & (low < high)
            low = np.where(right, mid + 1, low)
            high = np.where(right, high, np.minimum(mid, high))
        return low

    first, last = bound(False), bound(True)
    count = last - first
    suffix = np.repeat(rows, count)
    turn = np.arange(len(suffix)) - np.repeat(np.cumsum(count) - count, count)
    return suffix, array[first[suffix] + turn]


def _shard(block: Suffixes, texts: list[np.ndarray]) -> list[tuple]:
    """Per document of a shard: hit words as start and end pairs, items, longest match, matches."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    words = np.zeros(total + max(block.longest, block.window), dtype=np.int64)
    words[: total] = np.concatenate([np.append(block.number(t), 0) for t in texts])
    suffix, place = search(block, words)
    out: list[tuple] = [([], [], 0, [])] * len(texts)
    if not len(place):
        return out
    doc = np.searchsorted(begin, place, side="right") - 1
    # Matches that cannot be extended to the left, followed to their end.
    at = block.at[suffix]
    starts = (at == block.begin[suffix]) | (place == begin[doc]) | (block.words[at - 1] != words[place - 1])
    length = block.width[suffix].copy()
    live = np.flatnonzero(starts)
    while len(live):
        q, t = at[live] + length[live], place[live] + length[live]
        live = live[(q < block.end[suffix[live]]) & (words[t] == block.words[q])]
        length[live] += 1
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        d = doc[part[0]]
        change = np.zeros(sizes[d] + 2, dtype=np.int64)
        local = place[part] - begin[d]
        np.add.at(change, local, 1)
        np.add.at(change, local + block.width[suffix[part]], -1)
        edges = np.diff(np.concatenate(([0], np.cumsum(change) > 0, [0])).astype(np.int8))
        spans = np.column_stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))).ravel().tolist()
        items = sorted({block.ids[i] for i in np.unique(block.item[suffix[part]])} - {None})
        kept = part[starts[part]]
        matches = sorted(
            {(block.ids[i], s, n) for i, s, n in zip(block.item[suffix[kept]].tolist(), (place[kept] - begin[d]).tolist(), length[kept].tolist())},
            key=lambda m: (m[1], -m[2], m[0] or ""),
        )
        out[d] = (spans, items, int(length[kept].max()), [dict(zip(("item_id", "start", "words"), m)) for m in matches])
    return out


def _joined(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of spans."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _hashed(benchmark: DataFrame) -> DataFrame:
    """`item_id` and the hashes of its words, for every item that has words."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            words = [word_hashes(t.as_py(), NOT_WORD).view(np.int64) for t in batch.column("text")]
            found = pa.array([w if len(w) else None for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), found], names=["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(batches, "item_id string, words array<bigint>").where("words IS NOT NULL")


class Blocks:
    """Benchmark items stored in blocks, each a folder of its own below the shared one."""

    def __init__(self, benchmark: DataFrame, window: int, block_words: int):
        spark = benchmark.sparkSession
        items = stored(_hashed(benchmark).distinct(), "benchmark-words")
        total = items.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
        self.window, self.number = window, -(-total // block_words)
        if self.number:
            folder = new_scratch_dir(spark, "benchmark-blocks")
            block = F.pmod(F.xxhash64("item_id", "words"), F.lit(self.number))
            items.withColumn("_block", block).repartition("_block").write.partitionBy("_block").parquet(folder)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            self.folder = system.makeQualified(path).toString()

    def read(self, number: int) -> Suffixes | None:
        """One block, read by a task; None for a block that no item fell into."""
        uri = self.folder
        for name in ("s3a:", "s3n:"):  # Arrow's name of the same file system
            uri = uri.replace(name, "s3:", 1) if uri.startswith(name) else uri
        system, folder = fs.FileSystem.from_uri(uri)
        found = system.get_file_info(fs.FileSelector(f"{folder}/_block={number}", allow_not_found=True))
        items: list[tuple[str | None, np.ndarray]] = []
        for file in sorted(f.path for f in found if f.base_name.endswith(".parquet")):
            with system.open_input_file(file) as source:
                part = pq.ParquetFile(source).read(columns=["item_id", "words"])
            words = (w.values.to_numpy().view(np.uint64) for w in part.column("words"))
            items += zip(part.column("item_id").to_pylist(), words)
        return Suffixes(items, self.window) if items else None


def _merged(old: tuple, new: tuple) -> tuple:
    """What two blocks found in one document."""
    matches = sorted([*old[3], *new[3]], key=lambda m: (m["start"], -m["words"], m["item_id"] or ""))
    return _joined(old[0], new[0]), sorted({*old[1], *new[1]}), max(old[2], new[2]), matches


def marked(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """All columns of `docs` (of them `text` is read) with what was found in each row.

    `_n_words`, `_n_hit` (words inside an occurrence of a window), `_items` (ids, sorted), `_longest`
    (words of the longest verbatim match), `_matches` (item_id, start, words). A window is `window`
    consecutive words of an item, or all words of a shorter one. Null or empty texts have no words
    and no hits; items without words are never found; items without an id count for hits but are
    not listed; repeated items count once. An empty benchmark finds nothing. Input columns of these
    names are replaced; no others are touched. The shared folder must be on a file system that Arrow
    can open, since tasks read the blocks there. An item is never cut, so a block is longer than
    `block_words` if one item is.
    """
    names = [f.name for f in _FOUND]
    base = docs.drop(*names, "_n_hit")

    blocks = Blocks(benchmark, window, block_words)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, block = list(range(blocks.number)), None, None

        def finish(part: pa.RecordBatch, texts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal held, block
            results: list[tuple] = [([], [], 0, [])] * len(texts)
            for k in order:
                if k != held:
                    block = None  # the old one goes before the next is read
                    held, block = k, blocks.read(k)
                if block is not None:
                    results = [_merged(*r) if r[1][2] else r[0] for r in zip(results, _shard(block, texts))]
            order.reverse()  # the next shard begins with the block at hand
            columns = [[len(t) for t in texts], *(list(c) for c in zip(*results))]
            arrays = [pa.array(c, _ARROW[k]) for k, c in zip(names, columns)]
            return pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *names])

        for batch in stream:
            texts, begin, total = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                texts.append(word_hashes(text.as_py(), NOT_WORD))
                total += len(texts[-1])
                if total >= SHARD_WORDS or k + 1 == batch.num_rows:
                    yield finish(batch.slice(begin, len(texts)), texts)
                    texts, begin, total = [], k + 1, 0

    rows = base.mapInArrow(batches, T.StructType([*base.schema.fields, *_FOUND.fields]))
    pieces = F.transform("_spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumn("_n_hit", n_hit).drop("_spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    return marked(docs, benchmark, window=window).where(F.col("_n_hit") == 0).select(*docs.columns)
