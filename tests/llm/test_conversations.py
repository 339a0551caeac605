import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirevault.llm import conversations, queries
from wirevault.llm.conversations import MOVES, NEXT, TAIL, Survivors

LEGAL = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def every_way(rows):
    """Cheapest (cost, audit) of (initial, fault) rows by trying all edits, two inserts at a place."""
    inserts = [""] + ["u", "a", "ua", "au"]
    best = None
    options = []
    for initial, fault in rows:
        late = fault == "truncated"
        found = [("D", "", 3)]
        if fault not in ("blank", "duplicate"):
            found += [("K", initial or "?", late), ("R", "u", 2 + late), ("R", "a", 2 + late)]
        options.append(found)
    for choice in itertools.product(*options):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for extra, (letter, role, price) in zip(added, [*choice, ("", "", 0)]):
                roles += extra + role
                audit += "I" * len(extra) + letter
                cost += 2 * len(extra) + price
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain_search(rows):
    """The same by dynamic programming that keeps whole strings and drops nothing."""
    best = {0: (0, "")}

    def offer(found, state, cost, audit):
        found[state] = min(found.get(state, (cost, audit)), (cost, audit))

    def insert():
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                offer(best, NEXT[state], cost + 2, audit + "I")

    for initial, fault in rows:
        insert()
        found, late = {}, fault == "truncated"
        for state, (cost, audit) in best.items():
            offer(found, state, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                offer(found, NEXT[state], cost + 2 + late, audit + "R")
                if (state, initial) in MOVES:
                    offer(found, MOVES[state, initial], cost + late, audit + "K")
        best = found
    return min((cost + 2 * len(TAIL[s]), audit + TAIL[s]) for s, (cost, audit) in best.items())


ROWS = st.tuples(st.sampled_from("suax") | st.just(""), st.sampled_from(["", "", "truncated", "blank", "duplicate"]))


def searched(rows):
    search = Survivors()
    for row in rows:
        search.step(*row)
    return search.finished()


@settings(max_examples=60, deadline=None)
@given(st.lists(ROWS, max_size=3))
def test_cheapest_edits_by_trying_all(rows):
    assert searched(rows) == every_way(rows) == plain_search(rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROWS, max_size=40))
def test_cheapest_edits_of_longer_conversations(rows):
    assert searched(rows) == plain_search(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ROWS, max_size=6), min_size=1, max_size=6))
def test_blocks_chain_to_the_same_edits(blocks):
    segments = [conversations._searched(1, k, ((1, i, f) for i, f in b)) for k, b in enumerate(blocks)]
    ways = list(conversations._chained([(k, s["_costs"], s["_ranks"]) for k, s in enumerate(segments)]))
    audit = "".join(segments[k]["_edits"][4 * entry + state] + tail for k, entry, state, tail in ways)
    cost = sum(segments[k]["_costs"][4 * entry + state] + 2 * len(tail) for k, entry, state, tail in ways)
    assert (cost, audit) == plain_search([row for b in blocks for row in b])


def test_edits_are_emitted_while_a_conversation_runs():
    rng, search, most = random.Random(5), Survivors(), 0
    for _ in range(20_000):
        search.step(rng.choice("uuaas"), rng.choice(["", "", "", "truncated", "blank"]))
        deepest = max(node.depth for _, node in search.best.values())
        most = max(most, deepest - search.root.depth)
    assert len(search.final) > 15_000 and most < 200


def expected(rows):
    """Report by conversation of (conv_id, turn, role, text) rows that are in their place."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    out = {}
    for conv, group in groups.items():
        group = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in group]
        group.sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1].encode(), g[2].encode()))
        seen, marked = set(), []
        for _, role, text in group:
            rest = text.strip(BLANKS)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = plain_search(marked)
        lines, state, k = [], 0, 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else group[k][1:]
            k += letter != "I"
            if letter in "IR":
                state = NEXT[state]
                role = {2: "user", 3: "assistant"}[state]
            elif letter == "K":
                state = MOVES[state, role[:1]]
            if letter != "D":
                lines.append(f"{role}:{text}")
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        turns = {t for t, _, _ in group if t is not None}
        initials = [i for i, _ in marked]
        faults = Counter(f for _, f in marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
            faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.fixture
def table(spark):
    def make(rows):
        frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        return frame.selectExpr("*", "'x' AS _block", "'x' AS _turn", "'x' AS cost", "1 AS _copies", "'y' AS edit")

    return make


def check(frame, rows):
    found = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(frame).collect()}
    assert found == expected(rows)


def random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations_)]:
        for _ in range(rng.randrange(1, most)):
            turn = rng.choice([None, *range(9)])
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice([None, "", " \n", "Yes.", "No", "Why? ", "é…", "So!\n", "long " * rng.randrange(30) + "."])
            rows.append((conv, turn, role, text))
    return rows


def test_report_on_odd_rows(table):
    rows = random_rows(1, 60, 14)
    check(table(rows), rows)
    assert conversations.repair_report(table([])).count() == 0
    assert conversations.repaired_turns(table([])).count() == 0


def test_one_hot_conversation_is_cut_into_blocks(spark, table):
    rng = random.Random(7)
    rows = random_rows(3, 20, 6)
    hot = [(7, rng.choice([None, *range(3000)]), rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Text {k}", f"Text {k % 50}."])) for k in range(4000)]
    rows += hot + [(7, 17, "user", "Same.")] * 500
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(table(rows).repartition(5), rows)
        turns = conversations.repaired_turns(table(rows)).where("conv_id = 7").orderBy("position").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    report = expected(rows)[7]
    assert "".join(t.edit for t in turns) == report[6]
    lines = "\n".join(f"{t.role}:{t.text}" for t in turns if t.edit != "D")
    assert hashlib.sha256(lines.encode()).hexdigest() == report[7]


def test_very_long_text_and_far_turns(table):
    rows = [(1, 0, "user", "word " * 1_200_000 + "."), (1, 1, "assistant", "Yes."), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    found = {r.conv_id: r for r in conversations.repair_report(table(rows)).collect()}
    assert found[1].audit == "KK" and found[1].cost == 0
    assert found[1].repaired_sha256 == hashlib.sha256(f"user:{rows[0][3]}\nassistant:Yes.".encode()).hexdigest()
    assert found[2].gaps is None and found[2].audit == "KK"


def test_copies_of_none_leave_an_empty_conversation(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 0, "user", "x", 0), (1, 1, "user", "y", 0)], "conv_id int, turn int, role string, text string, n int")
    row = conversations.repair_report(frame, copies=F.col("n")).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_registered_query_against_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet").collect()
    rows, ids = [], set()
    for r in table:
        ids.add(r.conv_id)
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        role = "user" if kind == 4 else r.role
        rows += [(r.conv_id, r.turn, role, text)] * (2 if kind == 3 else 1)
    want = expected(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r.conv_id: tuple(r)[1:] for r in queries.op11_survivor_viterbi(spark, small).collect()}
    assert found == {i: want.get(i, empty) for i in ids}
