"""Word postings: which bodies hold a word, for searches that read those words only.

A posting list is cut into runs by a hash of the body key. A run holds the same bodies for every
word, so lists are intersected run by run and no list is ever put together; a word that is in all
bodies has as many short lists as there are runs. Bodies are dealt out by run, so the words of a body move
beside one copy of its key, and a file, which holds few runs, stores their keys once as a dictionary. A task
turns one run after the other into lists, which bounds its memory and sorts no keys beside words. Rows are sorted
by word run by run and carry a Bloom filter, so a search opens the row groups and pages of its words. An index that
is stored already is cut into runs where it lies (`local_postings`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens

# Bodies of a run, on average; the longest list a row can hold is about as long.
RUN_BODIES = 10_000
# Words of the bodies of a run, on average, each counted once a body: what a task holds at once.
RUN_WORDS = 4_000_000
# Keys that a task hands over at once: some 6 MB.
BATCH_KEYS = 100_000
# Fixed value: dictionary of a row group, in bytes; room for the keys of some 20 runs, or a million words.
DICTIONARY = 16 << 20


def _lists(batch_keys: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of one run (`run, sha256, words`) as sorted rows `word, run, keys`."""

    def lists(bodies: pa.Table) -> pa.Table:
        bodies = bodies.sort_by("sha256")
        keys = bodies["sha256"].combine_chunks()
        tokens = pc.split_pattern(bodies["words"].combine_chunks(), " ")
        words = pc.list_flatten(tokens).dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[words.indices.to_numpy()]
        # Entries come in order of keys, which a stable sort by word keeps.
        body = pc.list_parent_indices(tokens).to_numpy()[np.argsort(codes, kind="stable")]
        ends = np.cumsum(np.bincount(codes, minlength=len(order)))
        names, batches, first, start = words.dictionary.take(order), [], 0, 0
        while first < len(names):
            last = max(first + 1, int(np.searchsorted(ends, start + batch_keys, "right")))
            offsets = np.concatenate([[start], ends[first:last]]) - start
            found = keys.take(pa.array(body[start : ends[last - 1]]))
            batches.append(pa.RecordBatch.from_arrays(
                [names[first:last], pa.repeat(bodies["run"][0], last - first), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)],
                ["word", "run", "keys"],
            ))
            first, start = last, int(ends[last - 1])
        return pa.Table.from_batches(batches)

    return lists


def postings(index: DataFrame, bodies: int, words: int = 0) -> DataFrame:
    """`word, run, keys` of a text index (`sha256, tokens`) of so many bodies and words in all; keys are sorted."""
    runs = max(1, -(-bodies // RUN_BODIES), -(-words // RUN_WORDS))
    run = F.pmod(F.xxhash64("sha256"), F.lit(runs)).cast("int").alias("run")
    # As one text the words take half the room of a list; no word holds a blank.
    dealt = index.where(F.size("tokens") > 0).select(run, "sha256", F.array_join("tokens", " ").alias("words"))
    return dealt.groupBy("run").applyInArrow(_lists(BATCH_KEYS), "word string, run int, keys array<string>")


def local_postings(index: DataFrame, bodies: int, words: int = 0) -> DataFrame:
    """`postings` of a stored index where its bodies lie: nothing is shuffled, runs are cut inside the tasks.

    There are no more tasks than runs are needed, so a small index makes one run. No run has more than `RUN_BODIES`
    bodies or, but for a single body, `RUN_WORDS` words, which bounds the memory of a task.
    """
    tasks = max(1, -(-bodies // RUN_BODIES), -(-words // RUN_WORDS))
    lists, most_bodies, most_words = _lists(BATCH_KEYS), RUN_BODIES, RUN_WORDS

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, kept, held = TaskContext.get().partitionId(), 0, [], [0, 0]

        def posted() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept)
            run = pa.array(np.full(len(table), task + n * tasks, np.int32))
            return iter(lists(table.append_column("run", run)).to_batches())

        for batch in batches:
            at, ends = 0, np.cumsum(batch["n"].to_numpy())
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                end = min(at + most_bodies - held[0], int(np.searchsorted(ends, before + most_words - held[1], "right")))
                if end <= at and kept:
                    yield from posted()
                    n, kept, held = n + 1, [], [0, 0]
                    continue
                end = min(len(batch), max(end, at + 1))  # a body with more words is a run of its own
                kept.append(batch.slice(at, end - at).select(["sha256", "words"]))
                held, at = [held[0] + end - at, held[1] + int(ends[end - 1]) - before], end
        if kept:
            yield from posted()

    near = index.where(F.size("tokens") > 0).coalesce(tasks)
    texts = near.select("sha256", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("n"))
    return texts.mapInArrow(runs, "word string, run int, keys array<string>")


def phrase_words(postings: DataFrame, phrase: str) -> list[str]:
    """The words of a phrase, told by the same expression as those of bodies."""
    return postings.sparkSession.range(1).select(word_tokens(F.lit(phrase)).alias("w")).first()["w"]


def bodies_with_words(postings: DataFrame, phrase: str, *, by: tuple[str, ...] = ("batch_id", "run")) -> DataFrame:
    """`sha256` of the bodies that hold all words of ``phrase``; a phrase without a word matches nothing.

    The words are pushed into the scan. Within a run, intersection starts from the shortest list.
    """
    words = phrase_words(postings, phrase)
    if not words:
        return postings.where(F.lit(False)).select(F.lit("").alias("sha256"))
    rows = postings.where(F.col("word").isin(words))
    if len(words) == 1:
        return rows.select(F.explode("keys").alias("sha256"))
    sized = F.struct(F.size("keys").alias("n"), F.col("keys"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(sized)).alias("lists")).where(F.size("lists") == len(words))
    common = F.aggregate(
        F.slice("lists", 2, len(words) - 1), F.col("lists")[0]["keys"], lambda kept, other: F.array_intersect(kept, other["keys"])
    )
    return lists.select(F.explode(common).alias("sha256"))
