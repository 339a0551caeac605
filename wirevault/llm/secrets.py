"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text: the base kinds by fixed patterns, and opaque tokens that look
random. Their values are hashed and counted over the whole corpus by distinct repositories and
distinct owners. A copy of a text, edited or not, says nothing new about the values in it: what
stands around a value tells where it came from, so equal surroundings count for one owner only, that
of their first repository. A value that several owners hold in surroundings of their own is a copied
example; any other that looks random is taken for live. Opaque tokens become findings only if they are live.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, lookup
from ..session import stored_once
from .common import stored

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as `+` gives them, without the short ones
KINDS = ("assign", "access", "hex", "opaque")

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.0
# An example has so many owners over distinct surroundings and so many repositories, both.
WIDE_OWNERS, WIDE_REPOSITORIES = 2, 3
# Words on either side that make up the surroundings, and the characters that are searched for them.
AROUND_WORDS, AROUND_CHARS = 4, 200

_CANDIDATES = "array<struct<kind: int, start: bigint, stop: bigint, value: string, random: boolean, around: string>>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes >= 2 and entropy(value) >= MIN_ENTROPY


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points, by start, then kind."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = _merged(sorted((start, end) for _, start, end, _ in found))
    ends = [end for _, end in taken]
    for m in OPAQUE.finditer(text):
        at = bisect_left(ends, m.start() + 1)  # the first that ends behind the token's start
        if looks_random(m[0]) and not (at < len(taken) and taken[at][0] < m.end()):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda f: (f[1], f[0]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap put together, so that ends are sorted too."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def surroundings(text: str, start: int, end: int) -> str:
    """A hash of the words around a span."""
    before = text[max(0, start - AROUND_CHARS) : start].split()[-AROUND_WORDS:]
    after = text[end : end + AROUND_CHARS].split()[:AROUND_WORDS]
    return hashlib.sha256("\0".join([*before, "", *after]).encode()).hexdigest()[:32]


def with_candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per row: `row` (a number of its own), doc_id, repository, owner and candidates.

    Values and what stands around them leave the task as hashes only.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = [
                [
                    {"kind": k, "start": s, "stop": e, "value": hashlib.sha256(v.encode()).hexdigest()[:32],
                     "random": looks_random(v), "around": surroundings(t, s, e)}
                    for k, s, e, v in candidates(t)
                ]
                for t in batch.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([
                ("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("random", pa.bool_()),
                ("around", pa.string()),
            ]))
            rest = ["doc_id", "repository", "owner"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(out, kind)], names=[*rest, "candidates"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"), "text",
    ).mapInArrow(batches, f"doc_id bigint, repository string, owner string, candidates {_CANDIDATES}")
    return rows.withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """Per hashed value: `n`, `n_repositories`, `n_owners` and `own_owners`, over the whole corpus.

    `own_owners` counts equal surroundings for one owner, that of their smallest repository. Counted
    in steps with partial sums, so a value or a text in a third of all documents is a few rows.
    Repositories and owners that are null count as one each.
    """
    each = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("_n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("_repositories"), F.sum("_n").alias("_n"))
    counted = by_owner.groupBy("value").agg(
        F.sum("_n").alias("n"), F.sum("_repositories").alias("n_repositories"), F.count("*").alias("n_owners")
    )
    texts = found.groupBy("value", "around").agg(F.min(F.struct("repository", "owner")).alias("_first"))
    credited = texts.select("value", F.col("_first.owner").alias("owner")).groupBy("value", "owner").agg(F.lit(1).alias("_one"))
    return counted.join(credited.groupBy("value").agg(F.count("*").alias("own_owners")), "value")


def secrets(docs: DataFrame, *, repository: Column, owner: Column, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """Per row of `docs` (doc_id, text and what the two columns read): `findings`, by place.

    A finding has kind, start, stop (code points, end exclusive), the value's hash, `n_repositories`,
    `n_owners` and verdict: `example` from `wide_owners` owners over distinct surroundings together with
    WIDE_REPOSITORIES repositories on, else `live` if the value looks random, else `plain`. Base kinds stay whatever their verdict; opaque tokens stay if live. Null
    and empty texts have no findings; repeated rows are repeated; rows without an id are kept. Other
    columns are not read.
    """
    rows = stored(with_candidates(docs, repository, owner), "secret-candidates")
    each = rows.select("row", "doc_id", "repository", "owner", F.explode("candidates").alias("c"))
    seen = each.select("repository", "owner", F.col("c.value").alias("value"), F.col("c.around").alias("around"))
    owned, n_values = stored_once(ownership(seen), "secret-owners")
    wide = (F.col("own_owners") >= wide_owners) & (F.col("n_repositories") >= WIDE_REPOSITORIES)
    verdict = F.when(wide, "example").when(F.col("c.random"), "live").otherwise("plain")
    places = each.select("row", "doc_id", "c", F.col("c.value").alias("value"))
    # The places of a value that very many rows hold are split over tasks.
    known = lookup(
        places, owned.withColumnRenamed("value", "_value").drop("n"), "value", table_key="_value", table_rows=n_values,
        hot=hot_keys(owned.withColumnRenamed("value", "_value"), "_value", "n"), row_id="row",
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    judged = (
        known
        .withColumn("verdict", verdict)
        .where((F.col("c.kind") < KINDS.index("opaque")) | (F.col("verdict") == "live"))
        .groupBy("row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("c.start").alias("start"), F.col("c.kind").alias("_kind"), F.col("c.stop").alias("stop"),
            F.get(names, F.col("c.kind")).alias("kind"), "value", "n_repositories", "n_owners", "verdict",
        ))).alias("findings"))
    )
    return rows.select("row", "doc_id").join(judged.select("row", "findings"), "row", "left").select(
        "doc_id", F.coalesce("findings", F.expr("CAST(array() AS array<struct<start: bigint, _kind: int, stop: bigint, "
        "kind: string, value: string, n_repositories: bigint, n_owners: bigint, verdict: string>>)")).alias("findings"),
    )
