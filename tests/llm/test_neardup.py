import random
import re

import numpy as np
import pytest

from wirevault.llm import neardup
from wirevault.llm.wordhash import BLANK, window_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def brute_components(rows, size, percent=80):
    sets = [(i, brute_set(t, size)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def family(rng, n, words=40, edits=3):
    """Texts that differ from one base by a few words each, so that some are linked and some are not."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


def test_components_match_brute_force(spark, frame):
    rng = random.Random(5)
    texts = [t for _ in range(3) for t in family(rng, 45)] + ["A b c", "a B C", "a b", "same same"] * 2
    texts += [" ".join(f"n{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(rows), shingle=4).collect()}
    want = brute_components(rows, 4)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_large_buckets_are_cut_into_homes(spark, frame, monkeypatch):
    """With tiny homes the cross-component search gives the same links."""
    monkeypatch.setattr(neardup, "HOME", 3)
    rows = list(enumerate(family(random.Random(8), 70, edits=5)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


def test_homes_are_bounded_by_bytes(spark, frame, monkeypatch):
    """Long texts are gathered a few at a time, with the same links; one longer than a home has its own."""
    rng = random.Random(11)
    texts = family(rng, 12, words=3000, edits=150) + family(rng, 12, words=400, edits=20) + family(rng, 40, edits=5)
    rows = list(enumerate(texts))
    gathered = []
    cross = neardup._cross_links

    def spied(placed, nodes, **options):
        gathered.extend(nodes.groupBy("home").agg({"node": "count"}).collect())
        return cross(placed, nodes, **options)

    monkeypatch.setattr(neardup, "HOME_BYTES", 30_000)
    monkeypatch.setattr(neardup, "_cross_links", spied)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)
    assert len(gathered) > 12


def test_rows_of_a_hot_set_are_split(spark, frame, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 10)
    rows = [(k, "Copied by a great many sites") for k in range(3, 60)] + [(k, f"text number {k}") for k in range(60, 70)]
    rows += [(None, "Copied by a great many sites"), (3, "copied BY a great many sites")]
    found = neardup.near_duplicates(frame(rows))
    assert found.count() == len(rows)
    by_id = {r.doc_id: r.component_id for r in found.collect()}
    assert {by_id[k] for k in range(3, 60)} == {3} and by_id[None] is None
    assert all(by_id[k] == k for k in range(60, 70))


def test_odd_rows(spark, frame, odd_rows):
    rows = neardup.near_duplicates(frame(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by_id[i].component_id for i in (5, 6)] == [5, 5] and not by_id[6].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(frame([])).count() == 0
    docs = frame(odd_rows)
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8]


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.7, 0.8, 0.9, 1.0):
        common, each = int(1000 * similarity), int(1000 * (1 - similarity) / 2)
        errors = []
        for _ in range(20):
            parts = rng.integers(0, 1 << 63, size=common + 2 * each, dtype=np.uint64)
            a, b = np.unique(parts[: common + each]), np.unique(np.concatenate((parts[:common], parts[common + each :])))
            x, y = (neardup.odd_sketch(neardup.minhash(s)) for s in (a, b))
            bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(float(neardup.estimate(np.array([bits]))[0]) - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < neardup.ESTIMATE_MARGIN


def test_hub_components(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 460)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(300)} | {i: 400 for i in range(400, 461)}
    assert neardup.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", " \n", "a", "A  b\tc d\n\x0be", "é É ß" * 3, "x" * 3_000_000 + " y z"])
def test_word_hashes(text):
    words = WORD.findall(text.translate(LOWER))
    hashes = word_hashes(text, BLANK)
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    assert len(window_hashes(hashes, 4)) == (max(1, len(words) - 3) if words else 0)
