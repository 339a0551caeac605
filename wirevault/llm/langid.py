"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by its code point; the blank between words has
one too. An n-gram is the product of its letters' vectors, each shifted by its distance from the
end (binding by permutation); a text is the sum of its n-grams (bundling). The prototype of a
language is the sum over its training texts. A text gets the language of the prototype with the
largest cosine. Sums are of whole numbers, so prototypes do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
NGRAM = 3
UNKNOWN = "und"
FOLDS = 5
# Three standard errors of the cosine of unrelated vectors: below it a text resembles no language.
MIN_SCORE = 3 / DIMENSIONS**0.5

_SLICE = 1 << 20
_BATCH_CHARS = 1 << 20
_tables: dict[str, np.ndarray] = {}
_letters: dict[int, np.ndarray] = {}


def _folded() -> np.ndarray:
    """Per code point its lower-case letter; 0 for what is no letter."""
    if "folded" not in _tables:
        table = np.zeros(0x110000, dtype=np.int32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _tables["folded"] = table
    return _tables["folded"]


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        bits = np.random.default_rng([31, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _letters[code] = bits * np.int8(2) - np.int8(1)
    return _letters[code]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of letters and single blanks, with counts. None without a letter."""
    parts: list[np.ndarray] = []
    tail = np.zeros(1, dtype=np.int64)  # a text starts after a blank
    text = text or ""
    for start in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[start : start + _SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        symbols = np.concatenate([tail, _folded()[codes]])
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols = symbols[keep]
        parts.append(_packed(symbols))
        tail = symbols[-(NGRAM - 1):]
    if len(tail) > 1 and tail[-1]:
        parts.append(_packed(np.append(tail, 0)))  # ... and ends before one
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64),) * 2


def _packed(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols) - NGRAM + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    for k in range(NGRAM):
        out = (out << 21) | symbols[k : k + n]
    return out


def ngram_vectors(packed: np.ndarray) -> np.ndarray:
    """One row per n-gram: its letters' vectors, shifted by place and multiplied."""
    out = np.ones((len(packed), DIMENSIONS), dtype=np.int8)
    for k in range(NGRAM):
        codes, which = np.unique((packed >> (21 * k)) & 0x1FFFFF, return_inverse=True)
        table = np.array([np.roll(letter_vector(int(c)), k) for c in codes], dtype=np.int8)
        out *= table[which]
    return out


def bundles(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vector of every text, from blocks of the n-grams that occur in any of them."""
    out = np.zeros((len(counted), DIMENSIONS), dtype=np.float32)
    grams = np.concatenate([g for g, _ in counted])
    if not len(grams):
        return out
    counts = np.concatenate([c for _, c in counted]).astype(np.float32)
    row = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
    every, which = np.unique(grams, return_inverse=True)
    for start in range(0, len(every), 4096):
        vectors = ngram_vectors(every[start : start + 4096]).astype(np.float32)
        inside = (which >= start) & (which < start + 4096)
        weights = np.zeros((len(counted), len(vectors)), dtype=np.float32)
        weights[row[inside], which[inside] - start] = counts[inside]
        out += weights @ vectors
    return out


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts are moderate together."""
    start, chars = 0, 0
    for k, size in enumerate(batch.column("_chars").to_pylist()):
        chars += size
        if chars >= _BATCH_CHARS or k - start >= 511 or k + 1 == batch.num_rows:
            yield start, k + 1
            start, chars = k + 1, 0


def _with_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)))


def prototypes(docs: DataFrame) -> DataFrame:
    """`lang, profile` learned from all rows of `docs` (text, lang) that have a language.

    Every task sums n-gram counts per language before it bundles them, so a hot language is one
    short row per batch. Whole numbers are summed, so reruns agree exactly.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end in _groups(batch):
                counted = [ngram_counts(t.as_py()) for t in texts[start:end]]
                names = sorted(set(langs[start:end]))
                merged = []
                for name in names:
                    own = [counted[k] for k in np.flatnonzero(langs[start:end] == name)]
                    grams, which = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                    merged.append((grams, np.bincount(which, np.concatenate([c for _, c in own]), len(grams))))
                sums = bundles(merged).astype(np.float64).round().astype(np.int64)
                offsets = np.arange(len(names) + 1, dtype=np.int32) * DIMENSIONS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, sums.ravel())], names=["lang", "part"]
                )

    parts = _with_chars(docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")).mapInArrow(
        batches, "lang string, part array<bigint>"
    )
    return (
        parts.select("lang", F.posexplode("part").alias("_k", "_v"))
        .groupBy("lang", "_k").agg(F.sum("_v").alias("_v"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_p"))
        .select("lang", F.transform("_p", lambda x: x["_v"]).alias("profile"))
    )


def identified(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """All columns of `docs` (of them `text` is read) with `_lang` and `_score`.

    `profiles` (lang, profile) has one row per language. The score is the cosine, at least 0. Null
    texts and texts without a letter, and all texts if nothing was learned, are `und` with score 0.
    Of equal cosines the language first in code point order wins. Input columns named `_lang`,
    `_score` or `_chars` are replaced; no others are touched.
    """
    learned = sorted((r["lang"], r["profile"]) for r in profiles.collect())
    langs = [name for name, _ in learned]
    matrix = np.array([p for _, p in learned], dtype=np.float64).reshape(len(langs), DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column("text")
            names: list[str] = []
            scores: list[float] = []
            for start, end in _groups(batch):
                counted = [ngram_counts(t.as_py()) for t in texts[start:end]]
                vectors = bundles(counted).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                known = np.array([len(g) > 0 for g, _ in counted]) & (len(langs) > 0)
                if len(langs):
                    cosine = vectors @ matrix.T / np.where(size > 0, size, 1)[:, None]
                    cosine = cosine.round(9)
                    best = cosine.argmax(axis=1)
                    top = np.clip(cosine.max(axis=1), 0, 1)
                for k, ok in enumerate(known):
                    names.append(langs[best[k]] if ok else UNKNOWN)
                    scores.append(float(top[k]) if ok else 0.0)
            rest = [c for c in batch.schema.names if c != "_chars"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest, "_lang", "_score"],
            )

    base = docs.drop("_lang", "_score", "_chars")
    out = T.StructType([*base.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return _with_chars(base).mapInArrow(batches, out)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def accepted(docs: DataFrame, profiles: DataFrame, *, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a known language, with the columns they came with."""
    found = identified(docs, profiles)
    return found.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score)).select(*docs.columns)
