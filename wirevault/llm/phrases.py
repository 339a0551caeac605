"""Phrase collocations by direct-address tiling.

Words are counted first. The most frequent ones get ids by rank, and a task counts pairs of ranked
words in tiles of a matrix of ids: a tile that many pairs of a chunk fall into is an array that
`bincount` addresses directly, all other pairs are sorted coordinates (COO) with a count. Pairs that
are frequent enough are ranked again and take the left side of the next matrix, whose cells are
phrases of three words. So only the rank tables, whose size is bounded, are in every task; words
and pairs without a rank are counted by 64-bit keys, exactly like the others. Cells leave a task
sorted, ranked ones as one number each, which shuffles at a few bytes a cell.

A phrase cannot be more frequent than its parts. A bitmap of fixed size over the keys of frequent
parts keeps most rare phrases out of the shuffle; what passes it by chance is dropped after counting.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, lookup
from ..session import stored_once
from .common import stored
from .wordhash import _BASE, _BYTES, _INVERSE, _power_table, byte_class, mix

MIN_COUNT = 10
TOP = 2000
# A phrase goes if a longer one has so many hundredths of its occurrences.
CONTAINED = 50
RANKED = 1 << 17  # most words, and most pairs, with an id
TILE = 256  # ids on a side
TILES = 16  # arrays that a task holds at most, 8 MB
_DENSE = TILE * TILE // 32  # pairs of a chunk that make a tile an array
_CHUNK = 1 << 18  # bytes
_HELD = 1 << 18  # coordinates that are handed on once folded
_HELD_WORDS = 1 << 16
_BITS = 1 << 25
_ROWS, _OUT = 1 << 10, 1 << 16  # rows taken and handed on at a time

# Bytes that end a piece of text, and bytes that part words inside it.
_ENDS = byte_class(rb"[.,;:!?\x0A-\x0D]")
_PARTS = byte_class(rb"[\x20\x09]")
_GAP = _ENDS | _PARTS


def join_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of a phrase from those of its beginning and of its last word."""
    return mix(left * np.uint64(_BASE) + right)


def language_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


@dataclass(frozen=True)
class Words:
    """The words of a chunk of text: where they are, their keys, and the piece each stands in."""

    data: bytes
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    piece: np.ndarray


def _words(data: bytes, salt: np.uint64) -> Words:
    b = np.frombuffer(data, dtype=np.uint8)
    between = np.ones(len(b) + 2, dtype=np.int8)
    between[1:-1] = _GAP[b]
    edge = np.diff(between)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * _power_table(_BASE, len(b))[: len(b)], out=total[1:])
    keys = mix(mix((total[last] - total[first]) * _power_table(_INVERSE, len(b) + 1)[first]) ^ salt)
    piece = np.cumsum(_ENDS[b], dtype=np.int32)[first] if len(first) else first
    return Words(data, first, last, keys, piece)


def chunks(data: bytes, salt: np.uint64, size: int) -> Iterator[Words]:
    """The words of lower-cased text in chunks; each begins with the last `size - 1` words of the one before.

    So every run of `size` words lies in exactly one chunk.
    """
    begin, done = 0, 0
    while done < len(data):
        end = min(len(data), max(done, begin) + _CHUNK)
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        words = _words(data[begin:end], salt)
        yield words
        keep = min(size - 1, len(words.first))
        begin, done = (begin + int(words.first[-keep]) if keep else end), end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Language and lower-cased texts of some rows at a time, put together with line feeds, which end a piece."""
    for at in range(0, batch.num_rows, _ROWS):
        by_lang: dict[str, list[bytes]] = {}
        part = batch.slice(at, _ROWS)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
            by_lang.setdefault(lang, []).append(text.as_py().encode().lower())
        for lang in list(by_lang):
            yield lang, b"\n".join(by_lang.pop(lang))


def word_counts(docs: DataFrame) -> DataFrame:
    """`lang, word, n` of all words of `docs` (lang, text without nulls)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                rows = sorted(found.items())
                for at in range(0, len(rows), _OUT):
                    part = rows[at : at + _OUT]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([w.decode() for w, _ in part], pa.string()),
                         pa.array([n for _, n in part], pa.int64())],
                        names=["lang", "word", "n"],
                    )

        for batch in batches:
            for lang, data in _texts(batch):
                found = held.setdefault(lang, Counter())
                before = len(found)
                for words in chunks(data, language_key(lang), 1):
                    _, at, counts = np.unique(words.keys, return_index=True, return_counts=True)
                    for begin, end, n in zip(words.first[at].tolist(), words.last[at].tolist(), counts.tolist()):
                        found[words.data[begin:end]] += n
                n_held += len(found) - before
                if n_held >= _HELD_WORDS:
                    yield from flush()
                    held, n_held = {}, 0
        yield from flush()

    return docs.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_word_keys(words: DataFrame) -> DataFrame:
    """`lang, word, n` and the key by which the word is told apart."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for row, lang in enumerate(batch.column("lang").to_pylist()):
                rows.setdefault(lang, []).append(row)
            words, keys = batch.column("word").to_pylist(), np.empty(batch.num_rows, dtype=np.int64)
            for lang, at in rows.items():
                text = " ".join(words[row] for row in at).encode()
                keys[at] = np.concatenate([c.keys for c in chunks(text, language_key(lang), 1)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["lang", "word", "n", "key"])

    return words.select("lang", "word", "n").mapInArrow(keyed, "lang string, word string, n bigint, key bigint")


@dataclass(frozen=True)
class Ranks:
    """Ids of the most frequent keys, and what else is known of them."""

    keys: np.ndarray
    ids: np.ndarray
    facts: dict[str, np.ndarray]  # by id

    @staticmethod
    def of(rows: pa.Table, order: list[str]) -> Ranks:
        """From rows with `key` and `n`; ids go by the columns `order`, then by falling `n`, then by key."""
        facts = {}
        for name in rows.column_names:
            column = rows.column(name).combine_chunks()
            if pa.types.is_string(column.type):
                coded = column.dictionary_encode()  # one object for all equal names
                facts[name] = np.array(coded.dictionary.to_pylist(), dtype=object)[coded.indices.to_numpy()]
            else:
                facts[name] = column.to_numpy(zero_copy_only=False)
        by = np.lexsort((facts["key"], -facts["n"], *(np.unique(facts[c], return_inverse=True)[1] for c in reversed(order))))
        facts = {name: fact[by] for name, fact in facts.items()}
        keys = facts["key"].view(np.uint64)
        ids = np.argsort(keys)
        return Ranks(keys[ids], ids.astype(np.int32), facts)

    def bare(self) -> Ranks:
        return Ranks(self.keys, self.ids, {})

    def id_of(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys; -1 without one."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1).astype(np.int64)

    def fact(self, name: str, ids: np.ndarray, kind: pa.DataType) -> pa.Array:
        """A fact of ids; null for -1."""
        missing = ids < 0
        if missing.all():
            return pa.nulls(len(ids), kind)
        return pa.array(self.facts[name][np.where(missing, 0, ids)], kind, mask=missing)


class Tiles:
    """Counts cells of a matrix of phrase beginnings and last words."""

    def __init__(self, left: Ranks, right: Ranks):
        self.left, self.right = left, right
        self.across = -(-max(1, len(right.keys)) // TILE)
        self.arrays: dict[int, np.ndarray] = {}
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []  # both ids in one number, and how often
        self.rankless: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # both keys, and how often
        self.n_loose = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Count a cell each, by the keys of a phrase's beginning and last word."""
        i, j = self.left.id_of(left), self.right.id_of(right)
        both = (i >= 0) & (j >= 0)
        left, right = left[~both].view(np.int64), right[~both].view(np.int64)
        self.rankless.append((left, right, np.ones(len(left), dtype=np.int32)))
        i, j = i[both], j[both]
        tile = i // TILE * self.across + j // TILE
        order = np.argsort(tile, kind="stable")
        begins = np.flatnonzero(np.diff(tile[order], prepend=-1))
        loose = np.ones(len(tile), dtype=bool)
        for begin, end in zip(begins, np.append(begins[1:], len(tile))):
            t = int(tile[order[begin]])
            if t not in self.arrays and (end - begin < _DENSE or len(self.arrays) >= TILES):
                continue
            at = order[begin:end]
            loose[at] = False
            cells = np.bincount(i[at] % TILE * TILE + j[at] % TILE, minlength=TILE * TILE)
            if t in self.arrays:
                self.arrays[t] += cells
            else:
                self.arrays[t] = cells
        cells = i[loose] << 32 | j[loose]
        self.cells.append((cells, np.ones(len(cells), dtype=np.int32)))
        self.n_loose += len(left) + len(cells)

    def fold(self) -> None:
        """Sort the coordinates and add up equal ones."""
        if self.cells:
            cells, n = (np.concatenate(c) for c in zip(*self.cells))
            order = np.argsort(cells, kind="stable")
            cells, n = cells[order], n[order]
            begins = np.flatnonzero(np.diff(cells, prepend=-1))
            self.cells = [(cells[begins], np.add.reduceat(n, begins) if len(begins) else n)]
        if self.rankless:
            left, right, n = (np.concatenate(c) for c in zip(*self.rankless))
            order = np.lexsort((right, left))
            left, right, n = left[order], right[order], n[order]
            new = np.ones(len(left), dtype=bool)
            new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            begins = np.flatnonzero(new)
            self.rankless = [(left[begins], right[begins], np.add.reduceat(n, begins) if len(begins) else n)]
        self.n_loose = sum(len(c[0]) for c in (*self.cells, *self.rankless))

    def full(self) -> bool:
        if self.n_loose < 2 * _HELD:
            return False
        self.fold()
        return self.n_loose >= _HELD

    def counts(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(cell, left, right, n) of all cells counted so far, which are then forgotten.

        A cell of two ids is one number; without two ids it is -1, and the keys tell it.
        """
        for t, cells in self.arrays.items():
            at = np.flatnonzero(cells)
            i, j = t // self.across * TILE + at // TILE, t % self.across * TILE + at % TILE
            self.cells.append((i << 32 | j, cells[at]))
        self.arrays = {}
        self.fold()
        for cells, n in self.cells:
            none = np.zeros(len(cells), dtype=np.int64)
            yield cells, none, none, n.astype(np.int64)
        for left, right, n in self.rankless:
            yield np.full(len(left), -1), left, right, n.astype(np.int64)
        self.cells, self.rankless, self.n_loose = [], [], 0


def _in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame) -> np.ndarray:
    """One bit per key (column `key`) in 4 MB, whatever their number."""
    at = F.pmod("key", F.lit(_BITS)) + 1
    size = 32_768  # bits of one of Spark's bitmaps
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(_BITS // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 1,024 of 4 KB
        begin = (row["part"] - 1) * size // 8
        out[begin : begin + size // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def ranks(rows: DataFrame, limit: int, order: list[str], facts: list[str]) -> Ranks:
    """Ids of the most frequent of `rows` (key, n), at most `limit`, with the columns `facts`.

    The least number of occurrences that gets an id comes from a histogram of numbers cut to eight bits.
    """
    step = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    coarse = F.call_function("shiftleft", F.call_function("shiftright", "n", step), step)
    taken, least = 0, None
    for row in sorted(rows.groupBy(coarse.alias("least")).count().collect(), reverse=True):  # at most 8,000
        taken += row["count"]
        if taken > limit:
            break
        least = row["least"]
    frequent = rows.where(F.lit(False) if least is None else F.col("n") >= least)
    return Ranks.of(frequent.select("key", "n", *facts).toArrow(), order)


def _cells(docs: DataFrame, size: int, left: Ranks, right: Ranks, words: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """`cell, left, right, n` of phrases of `size` words whose parts are in `words` and `pairs` (column `key`)."""
    left, right = left.bare(), right.bare()
    word_bits = bitmap(words)
    pair_bits = None if pairs is None else bitmap(pairs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(left, right)

        def flush() -> Iterator[pa.RecordBatch]:
            for cells in tiles.counts():
                for at in range(0, len(cells[0]), _OUT):
                    part = [pa.array(c[at : at + _OUT]) for c in cells]
                    yield pa.RecordBatch.from_arrays(part, names=["cell", "left", "right", "n"])

        for batch in batches:
            for lang, data in _texts(batch):
                for found in chunks(data, language_key(lang), size):
                    keys, piece = found.keys, found.piece
                    known = _in_bitmap(word_bits, keys)
                    ok = (piece[1:] == piece[:-1]) & known[1:] & known[:-1]
                    if pair_bits is None:
                        at = np.flatnonzero(ok)
                        tiles.add(keys[at], keys[at + 1])
                    else:
                        joined = join_keys(keys[:-1], keys[1:])
                        ok &= _in_bitmap(pair_bits, joined)
                        at = np.flatnonzero(ok[1:] & ok[:-1])
                        tiles.add(joined[at], keys[at + 2])
                    if tiles.full():
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(counted, "cell bigint, left bigint, right bigint, n bigint")


def _named(cells: DataFrame, min_count: int, left: Ranks, right: Ranks, more: dict[str, tuple[str, str]]) -> DataFrame:
    """Frequent cells by their keys: `key, left, right, n, r` and columns `more` (name, (fact of left, type)).

    Facts come from the ranks, so that only cells without an id have to be looked up; theirs are null.
    """
    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "left", "right"))
            ranked = cell >= 0
            i, j = left.id_of(a.view(np.uint64)), right.id_of(b.view(np.uint64))
            i[ranked], j[ranked] = cell[ranked] >> 32, cell[ranked] & 0xFFFFFFFF
            a, b = a.copy(), b.copy()
            if ranked.any():
                a[ranked], b[ranked] = left.facts["key"][i[ranked]], right.facts["key"][j[ranked]]
            key = join_keys(a.view(np.uint64), b.view(np.uint64)).view(np.int64)
            facts = [left.fact(name, i, kinds[kind]) for name, kind in more.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(a), pa.array(b), batch.column("n"), right.fact("n", j, pa.int64()), *facts],
                names=["key", "left", "right", "n", "r", *more],
            )

    summed = cells.groupBy("cell", "left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    schema = "key bigint, left bigint, right bigint, n bigint, r bigint, " + ", ".join(f"{name} {kind}" for name, (_, kind) in more.items())
    return summed.mapInArrow(named, schema)


def _filled(rows: DataFrame, table: DataFrame, table_rows: int, key: str, **facts: str) -> DataFrame:
    """Look up `facts` (column = column of `table`) by `key` for the rows that lack them; hot keys are split."""
    first = next(iter(facts))
    missing = rows.where(F.col(first).isNull()).drop(*facts)
    counts = missing.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_n"))
    right = table.select(F.col("key").alias("_of"), *(F.col(c).alias(name) for name, c in facts.items()))
    hot = hot_keys(counts, "_of", "_n")
    found = lookup(missing, right, key, table_key="_of", table_rows=table_rows, hot=hot, row_id="right")
    return rows.where(F.col(first).isNotNull()).unionByName(found.select(rows.columns))


def phrase_pairs(docs: DataFrame, words: DataFrame, n_words: int, by_word: Ranks, *, min_count: int) -> DataFrame:
    """`key, lang, left, right, n, l, r` of pairs with `min_count` occurrences: keys and counts of both words."""
    cells = _cells(docs, 2, by_word, by_word, words, None)
    found = stored(_named(cells, min_count, by_word, by_word, {"lang": ("lang", "string"), "l": ("n", "bigint")}), "phrase-pair-cells")
    found = _filled(found, words, n_words, "left", lang="lang", l="n")
    return _filled(found, words, n_words, "right", r="n")


def phrase_triples(
    docs: DataFrame, words: DataFrame, n_words: int, by_word: Ranks, pairs: DataFrame, n_pairs: int, *, min_count: int, ranked: int
) -> DataFrame:
    """The same of three words: `key, lang, first, middle, right, left, rest, n` and `l1, r1, l2, r2` at both cuts.

    `left` and `rest` are the keys of the phrase without its last and its first word.
    """
    by_pair = ranks(pairs, ranked, [], ["lang", "left", "right", "l"])
    cells = _cells(docs, 3, by_pair, by_word, words, pairs)
    facts = {"lang": ("lang", "string"), "first": ("left", "bigint"), "middle": ("right", "bigint"), "l1": ("l", "bigint"), "l2": ("n", "bigint")}
    found = stored(_named(cells, min_count, by_pair, by_word, facts), "phrase-triple-cells").withColumnRenamed("r", "r2")
    found = _filled(found, pairs, n_pairs, "left", lang="lang", first="left", middle="right", l1="l", l2="n")
    found = stored(_filled(found, words, n_words, "right", r2="n"), "phrase-triple-counts")
    halves = Ranks(by_pair.keys, by_pair.ids, {c: f for c, f in by_pair.facts.items() if c == "n"})

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middle, right = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("middle", "right"))
            rest = join_keys(middle, right)
            r1 = halves.fact("n", halves.id_of(rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rest.view(np.int64)), r1], names=[*batch.schema.names, "rest", "r1"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", rest bigint, r1 bigint"
    return _filled(stored(found.mapInArrow(halved, schema), "phrase-triple-halves"), pairs, n_pairs, "rest", r1="n")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: products have up to 37 digits."""
    wide = [c.cast("decimal(14,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(
    docs: DataFrame, *, min_count: int = MIN_COUNT, contained: int = CONTAINED, top: int | None = TOP, ranked: int = RANKED
) -> DataFrame:
    """The strongest phrases of two and three words per language of `docs` (lang, text).

    `lang, rank, phrase, a, l, r, n, score`: the phrase's occurrences, those of its two parts at the
    weakest cut (the first of equal ones), all words of the language, and
    floor(1000000 a a / (l r)). Phrases have `min_count` occurrences and lie inside pieces of text
    between `.,;:!?` and line ends; one that is found inside a longer phrase with `contained` hundredths of its
    occurrences is left out. `top=None` gives all; ranks are by score, occurrences and phrase.

    Texts are lower-cased (A-Z). A null language is `und`, as is that name itself; null and empty
    texts have no words; repeated rows count each. Other columns are not read. Words are told apart
    by 64-bit keys. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    all_words = stored(word_counts(texts), "phrase-words")
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("_total"))
    words, n_words = stored_once(with_word_keys(all_words.where(F.col("n") >= min_count)), "phrase-frequent-words")
    by_word = ranks(words, ranked, ["lang"], ["lang"])  # a language's words stand together, so that tiles fill
    pairs, n_pairs = stored_once(phrase_pairs(texts, words, n_words, by_word, min_count=min_count), "phrase-pairs")
    triples = stored(
        phrase_triples(texts, words, n_words, by_word, pairs, n_pairs, min_count=min_count, ranked=ranked), "phrase-triples"
    )
    longer = triples.select(F.explode(F.array_distinct(F.array("left", "rest"))).alias("key"), "n").groupBy("key").agg(F.max("n").alias("_most"))
    two = pairs.join(longer, "key", "left").where(
        F.col("_most").isNull() | (100 * F.col("_most") < contained * F.col("n"))
    ).select("key", "lang", F.array("left", "right").alias("_words"), F.col("n").alias("a"), "l", "r",
             score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    weakest = F.array_min(F.array(*(
        F.struct(score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)
    )))
    three = triples.select(
        "key", "lang", F.array("first", "middle", "right").alias("_words"), F.col("n").alias("a"), weakest.alias("_cut")
    ).select("key", "lang", "_words", "a", "_cut.l", "_cut.r", "_cut.score")
    best = stored(_best(two.unionByName(three), top), "phrase-best")
    spelled = best.select("key", F.posexplode("_words").alias("at", "of")).join(words.select(F.col("key").alias("of"), "word"), "of")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    named = best.join(spelled.groupBy("key").agg(phrase.alias("phrase")), "key")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    place = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        place = place.where(F.col("rank") <= top)
    return place.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_total").alias("n"), "score")


def _best(phrases: DataFrame, top: int | None, salts: int = 64) -> DataFrame:
    """The `top` phrases of each language and those equal to the last; first those of parts of a language."""
    if top is None:
        return phrases
    for part in (["lang", F.pmod("key", F.lit(salts))], ["lang"]):
        ranked = F.rank().over(Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("a").desc()))
        phrases = phrases.withColumn("_rank", ranked).where(F.col("_rank") <= top).drop("_rank")
    return phrases
