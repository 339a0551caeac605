import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirevault.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, edits):
    assert lines.within_edits(a, b, edits) == (distance(a, b) <= edits)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(t) + 1), rng.randrange(3)
        if kind == 0:
            t.insert(k, rng.choice("abé😀"))
        elif t and kind == 1:
            t.pop(min(k, len(t) - 1))
        elif t:
            t[min(k, len(t) - 1)] = rng.choice("abé😀")
    return "".join(t)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_no_link_is_lost(spark, frame, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    texts = base + [edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(90)]
    docs = [(k, t) for k, t in enumerate(texts)]
    got = {r.line: r for r in lines.deduplicated_lines(frame(docs), edits=edits, min_chars=6).collect()}
    distinct = sorted({t for t in texts if t.strip(" \t\n\x0b\x0c\r")})
    assert sorted(got) == distinct
    near = {a: [b for b in distinct if b != a and min(len(a), len(b)) >= 6 and distance(a, b) <= edits] for a in distinct}
    assert {a: r.n_links for a, r in got.items()} == {a: len(n) for a, n in near.items()}
    copies = Counter(texts)
    for a in distinct:
        reach, open_ = {a}, [a]
        while open_:
            new = set(near[open_.pop()]) - reach
            reach |= new
            open_ += new
        assert got[a].class_line == min(reach) and got[a].kept == (a == min(reach))
        assert got[a].n_copies == copies[a] and got[a].doc_id == texts.index(a)


def test_short_lines_are_compared_as_registered(spark, frame):
    rng = random.Random(7)
    base = ["Le treque.", "The anhely eran.", *("".join(rng.choice("abcdefghé .") for _ in range(rng.randrange(1, 24))) for _ in range(60))]
    texts = ["Le  treque.", "The, anhely eran.", "ab", "abc", "cat", "cow", "no.", *base, *(edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(120))]
    got = {r.line: r for r in lines.deduplicated_lines(frame(list(enumerate(texts)))).collect()}
    distinct = {t for t in texts if t.strip(" \t\n\x0b\x0c\r")}
    allowed = lambda n: 0 if n < 6 else 1 if n < 20 else 2
    near = {a: sum(b != a and distance(a, b) <= allowed(min(len(a), len(b))) for b in distinct) for a in distinct}
    assert {a: r.n_links for a, r in got.items()} == near
    assert got["Le treque."].class_line == got["Le  treque."].class_line
    assert sum(near[a] > 0 for a in distinct if len(a) < 20) > 10 and sum(near[a] > 0 for a in distinct if len(a) >= 20) > 5
    # Two edits make any two very short lines equal, so these allow none.
    assert all(r.kept and not r.n_links for line, r in got.items() if len(line) < 6)


def test_lines_of_all_lengths_against_brute_force(spark, frame):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) + "z" for n in range(24) for _ in range(3)]
    texts = base + [edited(rng, t, rng.randrange(1, 4)) for t in base for _ in range(2)]
    got = {r.line: r.n_links for r in lines.deduplicated_lines(frame(list(enumerate(texts)))).collect()}
    distinct = {t for t in texts if t.strip(" ")}
    want = {a: sum(b != a and distance(a, b) <= sum(min(len(a), len(b)) >= s for s in lines.EDIT_STEPS) for b in distinct) for a in distinct}
    assert got == want


def test_hardly_any_short_line_of_the_table_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lines.deduplicated_lines(docs).selectExpr("length(line) AS n", "kept").collect()
    dropped = Counter(r.n for r in rows if not r.kept)
    total = Counter(r.n for r in rows)
    assert not any(dropped[n] for n in range(6))
    # One edit joins some invented words of six to nine letters, but no length loses most of its lines.
    assert all(dropped[n] <= 0.6 * total[n] for n in total if total[n] >= 20), (dropped, total)


def test_odd_rows(spark, frame, odd_rows):
    rows = lines.deduplicated_lines(frame([*odd_rows, (9, "one\n\none\r\n \nno id at all")])).collect()
    got = {r.line: (r.doc_id, r.n_copies) for r in rows}
    assert got["one"] == (4, 2) and got["one\r"] == (9, 1) and got["no id at all"] == (9, 2)
    assert "" not in got and " " not in got
    assert lines.deduplicated_lines(frame([])).count() == 0
