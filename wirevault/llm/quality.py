"""Quality rules: hashed n-gram likelihood ratio of trusted text against the whole corpus.

Uni- and bigrams of words are hashed into `buckets` classes. One pass over all documents
counts each class in the corpus and in the trusted documents. A document scores the mean
log ratio of the two smoothed multinomials over its n-grams, so its length does not matter. The
ratios are shifted so that the trusted n-grams have mean 0, which makes scores of small and large
corpora alike, and a fixed threshold decides about every document. The ratio table has `buckets` entries
whatever the size of the corpus; that is the only thing that reaches all tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, words

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
THRESHOLD = -0.17
SMOOTHING = 10.0
WINDOW = 5
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _neighbours(left: Column, right: Column, gap: int, n: Column) -> Column:
    """Hashes of left[i] with right[i + gap], `n` of them at most."""
    size = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(1 + gap), size), lambda a, b: F.xxhash64(a, b))


def pair_hashes(w: Column) -> Column:
    """A hash of every word with the next."""
    return _neighbours(w, w, 1, F.size(w) - 1)


def ngram_classes(w: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Hash classes of the words and of the pairs of neighbours."""
    def wrap(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")

    return F.concat(F.transform(w, lambda x: wrap(F.xxhash64(x))), F.transform(pairs, wrap))


def trusted_ids(labels: DataFrame, *, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most `rows` ids labelled as good, the same on every run: the bounded fitting sample."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(
    docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row with the array `ratios`, indexed by class. `trusted` holds at most `TRUSTED_ROWS` ids.

    The mean over the trusted n-grams is 0. Without any, all ratios are 0.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("_trusted"))), "doc_id", "left"
    )
    split = marked.select("_trusted", words(F.col("text")).alias("_w")).withColumn("_pairs", pair_hashes(F.col("_w")))
    counts = (
        split.select("_trusted", F.explode(ngram_classes(F.col("_w"), F.col("_pairs"), buckets)).alias("_class"))
        .groupBy("_class")
        .agg(F.count("*").alias("_corpus"), F.count("_trusted").alias("_good"))
    )
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("_class"))
    full = every.join(counts, "_class", "left").na.fill(0)
    totals = full.agg(
        F.array_sort(F.collect_list(F.struct("_class", "_corpus", "_good"))).alias("_rows"),
        F.sum("_corpus").alias("_all"), F.sum("_good").alias("_all_good"),
    )
    spread = smoothing * buckets
    shift = F.log(F.col("_all") + spread) - F.log(F.col("_all_good") + spread)

    def ratio(c: Column) -> Column:
        return F.log(c["_good"] + F.lit(smoothing)) - F.log(c["_corpus"] + F.lit(smoothing)) + shift

    mean = F.aggregate("_rows", F.lit(0.0), lambda acc, c: acc + c["_good"] * ratio(c)) / F.col("_all_good")
    centred = totals.withColumn("_mean", F.when(F.col("_all_good") > 0, mean))
    return centred.select(
        F.transform("_rows", lambda c: F.when(F.col("_mean").isNotNull(), ratio(c) - F.col("_mean")).otherwise(F.lit(0.0))).alias("ratios")
    )


def window_hashes(w: Column, pairs: Column) -> Column:
    """A hash of every run of `WINDOW` words: two pairs and the word after them."""
    n = F.size(w)
    return _neighbours(_neighbours(pairs, pairs, 2, n - 3), w, WINDOW - 1, n - WINDOW + 1)


def placed_repeats(windows: Column) -> Column:
    """Hashes with places, sorted, of texts in which a window repeats; nothing for others."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, placed).otherwise(F.expr("CAST(array() AS array<struct<h: bigint, i: int>>)"))


def repeated_words(placed: Column) -> Column:
    """Number of words inside windows that occur twice or more; `placed` is a stored column."""
    twice = F.filter(
        placed,
        lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places, start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    buckets: int = BUCKETS,
    trusted_rows: int = TRUSTED_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts, `base_failed`, `llr` (mean log ratio) and `kept`.

    A null or blank text has no words and fails. Equal rows get equal verdicts. No rows in, no
    rows out. Labels of unknown documents, null and repeated labels do no harm. Other columns of
    the input are not read, whatever their names.
    """
    fitted = log_ratios(docs, trusted_ids(labels, rows=trusted_rows), buckets=buckets).first()["ratios"]
    ratios = F.from_json(F.lit(json.dumps(fitted)), "array<double>")  # a constant of `buckets` numbers
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(without(line, BLANK_CHARS)) > 0)
    counted = docs.select(
        "doc_id",
        words(F.col("text")).alias("_w"),
        F.length(without(text, BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    ).withColumn("_pairs", pair_hashes(F.col("_w"))).select(
        "doc_id", "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("_w"), F.col("_pairs")).alias("_windows"),
        ngram_classes(F.col("_w"), F.col("_pairs"), buckets).alias("_classes"),
    )
    counted = counted.withColumn("_placed", placed_repeats(F.col("_windows")))
    total = F.aggregate("_classes", F.lit(0.0), lambda acc, c: acc + F.get(ratios, c))
    row = F.struct(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("_placed")).alias("n_repeat_words"),
        F.when(F.size("_classes") > 0, total / F.size("_classes")).alias("llr"),
    )
    # Behind a generator, so that a later filter on a verdict does not compute it all once more.
    scored = counted.select(F.inline(F.array(row)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    )
