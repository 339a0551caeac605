"""Token counts under a unigram model, with scores shared along a trie of pre-tokens.

Every task gathers the distinct pre-tokens (words with a mark in front) of its documents. In sorted
order they are the trie's leaves, depth first: two neighbours share the nodes of their common
prefix. The best score and its number of tokens are kept per node of the current path, so they are
computed once for every shared prefix; the last node's number is the pre-token's. Documents add up
the numbers of their words. Nothing is shuffled.

The vocabulary comes from a file of a public tokenizer, given by its path. Its pieces are in order
of frequency and get the probabilities of Zipf's law by rank. A character that no piece covers
costs one byte token per byte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Distinct pre-tokens a task keeps with their counts before it starts anew; a matter of memory only.
REMEMBERED = 500_000


def unigram_scores(path: str) -> dict[str, float]:
    """Log probability of every normal piece of a sentencepiece file; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / rank for rank in range(1, len(pieces) + 1)))
    return {piece: -math.log(rank) - total for rank, piece in enumerate(pieces, 1)}


def trie_counts(words: list[str], scores: dict[str, float]) -> dict[str, int]:
    """Number of tokens of each distinct word; of equally likely splits the one with fewest tokens."""
    longest = max(map(len, scores), default=1)
    byte = min(scores.values(), default=0.0) - 10.0  # an uncovered byte is less likely than any piece
    lookup = scores.get
    out: dict[str, int] = {}
    best, count, path = [0.0], [0], ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, tokens = best[end - 1] + n * byte, count[end - 1] + n
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                score = lookup(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or score == top and count[start] + 1 < tokens:
                        top, tokens = score, count[start] + 1
            best.append(top)
            count.append(tokens)
        path = word
        out[word] = count[-1]
    return out


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of `docs` (doc_id, text): `n_words` and `n_tokens`.

    Words are parted by ASCII blanks, which cost nothing themselves. Null, empty and blank texts have
    0 of both. Repeated rows are repeated, other columns are not read.
    """
    scores = unigram_scores(vocabulary)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in stream:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                split = [Counter((t.as_py() or "").encode().split()) for t in part.column("text")]
                new = set().union(*split) - known.keys()
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, set().union(*split)
                counts = trie_counts([MARK + w.decode() for w in new], scores)
                known.update((w[1:].encode(), n) for w, n in counts.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([c.total() for c in split], pa.int64()),
                        pa.array([sum(known[w] * n for w, n in c.items()) for c in split], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id bigint, n_words bigint, n_tokens bigint"
    )
