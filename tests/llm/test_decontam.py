import random

import numpy as np
from pyspark.sql import functions as F

from wirevault.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids, longest = split(text), set(), set(), 0
        for item_id, item in items:
            b = split(item)
            m = min(window, len(b))
            for p in range(len(b) - m + 1) if m else ():
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == b[p : p + m]:
                        hit.update(range(k, k + m))
                        ids |= {item_id} - {None}
                        n = m
                        while k + n < len(w) and p + n < len(b) and w[k + n] == b[p + n]:
                            n += 1
                        longest = max(longest, n)
        out.append((doc_id, len(w), len(hit), sorted(ids), longest))
    return sorted(out, key=repr)


def found(docs, benchmark, **options):
    rows = decontam.marked(docs, benchmark, **options).select("doc_id", "_n_words", "_n_hit", "_items", "_longest").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def corpus(rng):
    vocabulary = [f"v{k}" for k in range(12)] + ["É", "x1"]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for k in range(14)]
    items += [("i3", items[3][1]), ("none", None), ("blank", " ,;"), (None, items[5][1])]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            part = split(rng.choice(items)[1])
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[rng.randrange(len(part) + 1):]
        docs.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs, items


def test_hits_match_brute_force(spark, frame, monkeypatch):
    docs, items = corpus(random.Random(2))
    benchmark = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("clash"))
    want = brute(docs, items)
    assert any(r[2] for r in want) and any(not r[2] for r in want)
    assert found(frame(docs), benchmark) == want
    # The same in many small blocks of the benchmark.
    assert found(frame(docs), benchmark, block_words=40) == want


def test_blocks_are_read_by_tasks_in_one_step(spark, frame):
    docs, items = corpus(random.Random(5))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    words = sum(len(split(t)) for t in {t for _, t in items})
    blocks = decontam.Blocks(benchmark, 10, words // 4)
    assert blocks.number >= 5
    stored = [blocks.read(k) for k in range(blocks.number)]
    ids = [i for b in stored if b is not None for i in b.ids]
    assert len(ids) == len(set(ids)) == len({i for i, t in items if split(t)})
    marked = decontam.marked(frame(docs), benchmark, block_words=words // 4)
    assert marked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    whole = decontam.marked(frame(docs), benchmark)
    assert sorted(marked.collect(), key=repr) == sorted(whole.collect(), key=repr)


def test_matches_give_places(spark, frame):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = frame([(1, f"zero {passage} end"), (2, "nothing here"), (3, passage.replace("six", "6"))])
    benchmark = spark.createDataFrame([(7, f"start {passage}")], "item_id long, text string")
    rows = {r.doc_id: r._matches for r in decontam.marked(docs, benchmark).collect()}
    assert [tuple(m) for m in rows[1]] == [("7", 1, 12)] and rows[2] == rows[3] == []
    assert [r.doc_id for r in decontam.decontaminated(docs, benchmark).orderBy("doc_id").collect()] == [2, 3]
    assert decontam.decontaminated(docs, benchmark).columns == docs.columns


def test_odd_rows(spark, frame, odd_rows):
    benchmark = spark.createDataFrame([(1, "the same text the same text the same text the"), (2, "w5")], "item_id long, text string")
    docs = [(i, t) for i, t, *_ in odd_rows]
    assert found(frame(odd_rows), benchmark) == brute(docs, [("1", "the same text the same text the same text the"), ("2", "w5")])
    assert all(r[2:] == (0, [], 0) for r in found(frame(odd_rows), benchmark.limit(0)))
    assert decontam.marked(frame([]), benchmark).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    words = np.concatenate([rng.integers(0, 4, 3000), np.zeros(40, np.int64)])
    array = decontam.suffix_array(words, 5, 40, 3)
    suffixes = [tuple(words[p : p + 40]) for p in array]
    assert suffixes == sorted(suffixes)
    assert set(array) == {p for p in range(3000) if (words[p : p + 5] != 0).all()}
