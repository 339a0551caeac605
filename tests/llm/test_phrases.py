import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from wirevault.llm import phrases
from wirevault.llm.phrases import Ranks, Tiles, chunks, language_key


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, contained=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for at in range(len(words) - size + 1):
                    f[lang, *words[at : at + size]] += 1
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    most = Counter()
    for g, a in candidates.items():
        if len(g) == 4:
            for inner in ((g[0], *g[1:3]), (g[0], *g[2:4])):
                most[inner] = max(most[inner], a)
    out = []
    for g, a in candidates.items():
        if len(g) == 3 and g in most and 100 * most[g] >= contained * a:
            continue
        cuts = []
        for k in range(1, len(g) - 1):
            left, right = f[g[: 1 + k]], f[(g[0], *g[1 + k :])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((g[0], -score, -a, " ".join(g[1:]).encode(), left, right))
    found, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


def check(frame, rows, **options):
    found = phrases.collocations(frame, **options).collect()
    names = {"min_count": "least", "ranked": None}
    want = brute(rows, **{names.get(k, k): v for k, v in options.items() if names.get(k, k)})
    assert sorted(tuple(r) for r in found) == sorted(want)
    return want


def random_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "of", "new", "york", "city", "é", "漢字", "😀", "x-y", "\xa0"] + [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(40))
        gaps = rng.choices([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b", "?!"], k=len(words))
        rows.append((rng.choice(["en", "fr", None, "und", ""]), "".join(w + g for w, g in zip(words, gaps))))
    return rows


def test_odd_rows(frame):
    rows = random_rows(1, 900) + [("en", None), ("en", ""), (None, " \t\n.,"), ("xx", None)] + [("de", "New York City. " * 30)] * 4
    table = frame([(None if k % 7 == 0 else k, text, lang) for k, (lang, text) in enumerate(rows)])
    want = check(table, rows)
    assert {r[0] for r in want} >= {"en", "fr", "und", "", "de"}
    assert phrases.collocations(table.limit(0)).count() == 0


@pytest.mark.parametrize("ranked", [1, 7, 1000])
def test_ranks_and_rankless_words_count_alike(frame, ranked):
    rows = random_rows(2, 500)
    check(frame([(k, text, lang) for k, (lang, text) in enumerate(rows)]), rows, min_count=3, ranked=ranked)


def test_top_and_contained(frame):
    rows = random_rows(3, 600)
    table = frame([(k, text, lang) for k, (lang, text) in enumerate(rows)])
    for contained, top in ((1, 5), (101, 3), (50, 1)):
        check(table, rows, min_count=2, contained=contained, top=top)
    everything = phrases.collocations(table, min_count=2, top=None).count()
    assert everything == len(brute(rows, 2, 50, 10**9))


def test_one_very_long_text_and_a_hot_language(frame):
    rng = random.Random(5)
    long = " ".join(rng.choice(["aa", "bb", "cc", "dd", "e."]) for _ in range(700_000))
    rows = [("en", long)] + [("en", "aa bb cc")] * 2000 + [("fr", "aa bb " * 9)]
    table = frame([(k, text, lang) for k, (lang, text) in enumerate(rows)], extra=False)
    check(table, rows)


@settings(max_examples=200, deadline=None)
@given(st.text("ab .,\t\né", max_size=200), st.integers(1, 40), st.integers(1, 3))
def test_every_run_of_words_lies_in_one_chunk(text, size, width):
    old, phrases._CHUNK = phrases._CHUNK, size
    try:
        salt = language_key("en")
        found = Counter()
        for words in chunks(text.encode(), salt, width):
            for at in range(len(words.first) - width + 1):
                if words.piece[at] == words.piece[at + width - 1]:
                    found[tuple(words.keys[at : at + width].tolist())] += 1
    finally:
        phrases._CHUNK = old
    key = {}
    want = Counter()
    for piece in re.split(r"[.,\n]", text):
        run = re.findall(r"[^ \t]+", piece)
        for w in run:
            key[w] = next(iter(chunks(w.encode(), salt, 1))).keys[0].item()
        for at in range(len(run) - width + 1):
            want[tuple(key[w] for w in run[at : at + width])] += 1
    assert found == want


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_arrays_and_coordinates_agree(monkeypatch, dense):
    monkeypatch.setattr(phrases, "_DENSE", dense)
    monkeypatch.setattr(phrases, "TILES", 3)
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 60, size=900, dtype=np.uint64)
    ranks = Ranks.of(pa.table({"key": keys[:700].view(np.int64), "n": np.arange(700)}), [])
    tiles, want = Tiles(ranks, ranks), Counter()
    found = Counter()
    for _ in range(6):
        i, j = (np.minimum(rng.zipf(1.3, 4000) - 1, 899) for _ in range(2))
        tiles.add(keys[i], keys[j])
        want.update(zip(keys[i].tolist(), keys[j].tolist()))
    assert bool(tiles.arrays) == (dense < 10**9)
    for cell, left, right, n in tiles.counts():
        left, right, ranked = left.copy(), right.copy(), cell >= 0
        left[ranked], right[ranked] = (ranks.facts["key"][c[ranked]] for c in (cell >> 32, cell & 0xFFFFFFFF))
        for a, b, c in zip(left.tolist(), right.tolist(), n.tolist()):
            found[a, b] += c
    assert found == want


def test_word_counts(frame):
    rows = random_rows(8, 200)
    docs = frame([(k, text, lang) for k, (lang, text) in enumerate(rows)])
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = Counter({(r.lang, r.word): r.n for r in phrases.word_counts(texts).collect()})
    want = Counter()
    for lang, text in rows:
        want.update((("und" if lang is None else lang), w) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", lower(text)))
    assert counted == want


def test_score_is_exact(spark):
    rng = random.Random(4)
    rows = [(a, rng.randrange(a, 10**13), rng.randrange(a, 10**13)) for a in (rng.randrange(10, 10**13) for _ in range(300))]
    rows += [(10**13, 10**13, 10**13), (3, 3, 10**12), (10, 10, 10)]
    frame = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    for r in frame.select("*", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect():
        assert r.s == 1_000_000 * r.a * r.a // (r.l * r.r)


def test_bitmap_has_no_misses(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, size=5000)
    bits = phrases.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key bigint"))
    assert phrases._in_bitmap(bits, keys.view(np.uint64)).all()
    others = rng.integers(-(1 << 63), (1 << 63) - 1, size=5000).view(np.uint64)
    assert phrases._in_bitmap(bits, others).sum() < 50


@pytest.mark.parametrize("limit", [0, 1, 5, 40, 1000])
def test_ranks_are_bounded_and_in_order(spark, limit):
    rng = random.Random(limit)
    rows = [(k, rng.choice([10, 11, 5000, 10**6 + k, 2**40 + k])) for k in range(60)]
    found = phrases.ranks(spark.createDataFrame(rows, "key bigint, n bigint"), limit, [], []).facts["key"].tolist()
    n = dict(rows)
    assert len(found) <= limit and [n[k] for k in found] == sorted((n[k] for k in found), reverse=True)
    assert all(n[k] >= max((n[j] for j in n if j not in found), default=0) for k in found)
