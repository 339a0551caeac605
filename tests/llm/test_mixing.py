from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirevault.llm import mixing, queries


def brute_targets(sizes, cap=3):
    """Share by weight; whoever passes the cap stops there, the rest is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit >= cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def taken_by_source(rows, source_of):
    out = defaultdict(int)
    for r in rows:
        out[source_of[r.doc_id]] += r.taken
    return out


def test_mix_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    source_of = {d.doc_id: d.source for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(d.text.encode().split())
    want = brute_targets(sizes)
    rows = queries.op8_mixing(spark, small).collect()
    assert len(rows) == len(docs)
    taken = taken_by_source(rows, source_of)
    for r in rows:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(rows) == sorted(queries.op8_mixing(spark, small).collect())


def test_small_sources_stop_at_the_cap(spark, frame):
    rows = [(i, "w " * 50, None, "big") for i in range(100)] + [(200 + i, "w w", None, s) for i, s in enumerate("abcdef")] + [(300, "x " * 9)]
    got = mixing.mixed(frame(rows), block_docs=4).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])).collect()
    sizes = Counter()
    for _, text, *rest in [(*r, None, None)[:4] for r in rows]:
        sizes[rest[1]] += len(text.split())
    want = brute_targets(sizes)
    source_of = {r[0]: (*r, None, None)[3] for r in rows}
    assert {source_of[r.doc_id]: r.target for r in got} == pytest.approx(want)
    assert any(want[s] == 3 * sizes[s] for s in want)
    taken = taken_by_source(got, source_of)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_splitting_tree_is_exact():
    quotas = [1000, 7, 0, 333, 12_345]
    parts = np.array(mixing.split_quotas(quotas, 11))
    assert parts.shape == (11, 5) and parts.sum(axis=0).tolist() == quotas and (parts >= 0).all()
    assert np.ptp(parts.sum(axis=1)) <= 4  # shards get equal numbers of blocks
    assert parts.tolist() == mixing.split_quotas(quotas, 11)
    assert mixing.split_quotas([], 4) == [[], [], [], []]


def test_shards_are_disjoint_and_mixed(spark, frame):
    rows = [(i, f"t{i} " * 10, None, "abc"[i % 3]) for i in range(900)]
    out = mixing.mixed(frame(rows), block_docs=10, shards=4).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").collect()
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    per_shard = Counter((r.shard, rows[r.doc_id][3]) for r in out)
    assert len(per_shard) == 12  # every shard has all sources


def test_shards_and_order_come_from_the_tree(spark, frame):
    rows = [(i, f"t{i} " * 10, None, "abc"[i % 3]) for i in range(300)]
    one, four = (
        mixing.mixed(frame(rows), block_docs=10, shards=n).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").collect()
        for n in (1, 4)
    )
    words = lambda draws: sorted((r.doc_id, r.epoch, r.words) for r in draws)
    assert words(one) == words(four)
    assert {r.shard for r in one} == {0} and {r.shard for r in four} == {0, 1, 2, 3}
    assert [r.doc_id for r in sorted(one, key=lambda r: r.order)] != sorted(r.doc_id for r in one)
    out = mixing.shuffled(mixing.mixture(frame(rows), block_docs=10, shards=4)).collect()
    assert [(r._shard, r._order) for r in out] == sorted((r._shard, r._order) for r in out)
    assert sorted((r.doc_id, r._shard, r._order) for r in out) == sorted((r.doc_id, r.shard, r.order) for r in four)


def test_mixture_returns_documents(spark, frame, odd_rows):
    docs = frame(odd_rows)
    out = mixing.mixture(docs)
    assert [c for c in out.columns if c not in ("_shard", "_order")] == docs.columns
    known = {(i, t) for i, t, *_ in odd_rows}
    for r in out.collect():
        whole = (r.doc_id, r.text) in known
        assert whole or any(i == r.doc_id and " ".join((t or "").split()).startswith(r.text) for i, t in known)
    assert mixing.mixture(frame([])).count() == 0
    assert mixing.mixed(docs).count() == len(odd_rows)
    # Texts without a word: nothing to take, nothing to divide by.
    assert [r.draws for r in mixing.mixed(frame([(1, None), (2, "")])).collect()] == [[], []]
