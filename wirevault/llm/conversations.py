"""Repair of the turn structure of conversations by a survivor-coalescence Viterbi search.

A repaired conversation has role initials `(s?(ua)+)?`. Rows are kept (K, free), get another role
(R, 2), are deleted (D, 3, a must for blank and repeated rows), or empty turns are inserted (I, 2);
a truncated row that stays costs 1 more. The cheapest edits are wanted, among equals the least by
their letters.

The search runs over four states: nothing yet, after a system row, after a user row, after an
assistant row. Each state's survivor is a leaf of a tree of back pointers; nodes count their
references and die with the last one, and as soon as all survivors share an ancestor the edits up
to it are final and leave the tree. Equal costs compare the whole unresolved branches.

Rows are dealt out by ranges of conversation and turn. A conversation that lies inside one task is
repaired there. One that is cut by a border, or is longer than a buffer, goes on in blocks: each
block is searched from every state it may be entered in, the small tables of costs are chained
per conversation, and only then does a block know which of its edits hold. So a conversation may
hold any share of all rows; but its text digest is one chain, which one task streams through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.joins import hot_keys, lookup
from ..session import stored_once
from .common import BLANK_CHARS, stored

# The states with the moves that rows of a role may make, the role that leads on
# from a state, and what has to be inserted at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FOLLOWS = {"su", "ua", "au"}
BUFFER_CHARS = 1 << 22
# Only the beginnings of role and text are sampled for the borders of ranges; rows sort by all of both.
_KEY_CHARS = 32
_BATCH = 2048


class _Node:
    """An edit in the tree of back pointers; it lives while it is a survivor or has children."""

    __slots__ = ("up", "letter", "depth", "children", "survivors")

    def __init__(self, up: _Node | None, letter: str):
        self.up, self.letter, self.depth = up, letter, up.depth + 1 if up else 0
        self.children: list[_Node] = []
        self.survivors = 0


def _precedes(a: _Node, a_more: str, b: _Node, b_more: str) -> bool:
    """Whether the branch of `a` and then `a_more` sorts before that of `b` and `b_more`."""
    left, right = list(a_more[::-1]), list(b_more[::-1])
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.letter)
            a = a.up
        else:
            right.append(b.letter)
            b = b.up
    return left[::-1] < right[::-1]


class Survivors:
    """The cheapest edits that lead from one entry state to each state, row by row."""

    def __init__(self, entry: int = START):
        self.root = _Node(None, "")
        self.root.survivors = 1
        self.best: dict[int, tuple[int, _Node]] = {entry: (0, self.root)}
        self.final: list[str] = []

    def step(self, initial: str, fault: str) -> None:
        """Take one row: its role's initial and `blank`, `duplicate`, `truncated` or nothing."""
        self._insert()
        offers: dict[int, tuple[int, _Node, str]] = {}
        late = fault == "truncated"
        for state, (cost, node) in self.best.items():
            self._offer(offers, state, cost + 3, node, "D")
            if fault not in ("blank", "duplicate"):
                if (state, initial) in MOVES:
                    self._offer(offers, MOVES[state, initial], cost + late, node, "K")
                self._offer(offers, NEXT[state], cost + 2 + late, node, "R")
        self._survive(offers)

    def _insert(self) -> None:
        offers = {state: (cost, node, "") for state, (cost, node) in self.best.items()}
        for state in (START, SYSTEM, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(offers, USER, cost + 2, node, "I")
        if USER in offers:
            cost, node, letters = offers[USER]
            self._offer(offers, ASSISTANT, cost + 2, node, letters + "I")
        self._survive(offers)

    @staticmethod
    def _offer(offers: dict, state: int, cost: int, node: _Node, letters: str) -> None:
        have = offers.get(state)
        if have is None or cost < have[0] or (cost == have[0] and _precedes(node, letters, have[1], have[2])):
            offers[state] = (cost, node, letters)

    def _survive(self, offers: dict[int, tuple[int, _Node, str]]) -> None:
        """Grow the offers, let go of the rest, and emit what all survivors share.

        What follows after nothing or a system row can be had after an assistant row too: a kept
        system row becomes a deleted one, for 3 more, the rest costs the same. So these two
        states end where they are dearer by more than that; else the branch that deletes
        everything would live on for good.
        """
        if ASSISTANT in offers:
            bound = offers[ASSISTANT][0]
            for state, more in ((START, 3), (SYSTEM, 0)):
                if state in offers and offers[state][0] > bound + more:
                    del offers[state]
        before = [node for _, node in self.best.values()]
        best = {}
        for state, (cost, node, letters) in offers.items():
            for letter in letters:
                child = _Node(node, letter)
                node.children.append(child)
                node = child
            node.survivors += 1
            best[state] = (cost, node)
        self.best = best
        for node in before:
            node.survivors -= 1
            while node is not self.root and not node.survivors and not node.children:
                node.up.children.remove(node)
                node = node.up
        while not self.root.survivors and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.final.append(self.root.letter)
            self.root.up = None

    def exits(self) -> dict[int, tuple[int, str]]:
        """Cost and edits by the state that is reached; no inserts at the end."""
        return {state: (cost, "".join(self.final) + self._branch(node)) for state, (cost, node) in self.best.items()}

    def _branch(self, node: _Node) -> str:
        letters = []
        while node is not self.root:
            letters.append(node.letter)
            node = node.up
        return "".join(reversed(letters))

    def finished(self) -> tuple[int, str]:
        """Cost and edits of the whole conversation."""
        cost, node, tail = None, None, ""
        for state, (c, n) in self.best.items():
            c += 2 * len(TAIL[state])
            if cost is None or c < cost or (c == cost and _precedes(n, TAIL[state], node, tail)):
                cost, node, tail = c, n, TAIL[state]
        return cost, "".join(self.final) + self._branch(node) + tail


def text_fault(text: str) -> str:
    rest = text.rstrip(BLANK_CHARS)
    return "blank" if not rest else "" if rest[-1] in ".!?" else "truncated"


class Turns:
    """Applies edits to rows as they come; yields (edit, role, text), deleted rows with their own role."""

    def __init__(self, entry: int, edits: str):
        self.state, self.edits = entry, iter(edits)

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield self._apply(edit, role, text)
            if edit != "I":
                return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield self._apply(edit, "", "")

    def _apply(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if edit == "D":
            return edit, role, text
        if edit == "K":
            self.state = MOVES[self.state, role[:1]]
            return edit, role, text
        self.state = NEXT[self.state]
        return edit, ROLES[self.state], text if edit == "R" else ""


class Digest:
    """The sha256 of `role:text` lines, fed line by line."""

    def __init__(self):
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(f"{role}:{text}".encode())


# -- one conversation inside a task ----------------------------------------------------------


def _gaps(turns: set) -> int:
    known = turns - {None}
    gap = max(known) - min(known) + 1 - len(known) if known else 0
    return gap if gap < 1 << 63 else None


def _repaired(rows: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and turns of a whole conversation: rows (turn, role, text, copies) in order."""
    search, seen = Survivors(), set()
    count = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    initials = []
    for _, role, text, copies in rows:
        for _ in range(copies):
            fault = text_fault(text)
            if fault != "blank" and (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
            count[fault] += 1
            initials.append(role[:1])
            search.step(role[:1], fault)
    cost, audit = search.finished()
    turns, apply = [], Turns(START, audit)
    for _, role, text, copies in rows:
        for _ in range(copies):
            turns.extend(apply.row(role, text))
    turns.extend(apply.rest())
    report = {
        "gaps": _gaps({turn for turn, _, _, copies in rows if copies}),
        "blank": count["blank"], "duplicate": count["duplicate"], "truncated": count["truncated"],
        "illegal": sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit,
    }
    return report, turns


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()),
           T.StructField("repaired_sha256", T.StringType())]
_TURNS = [T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
          T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
_OPEN = [T.StructField("_block", T.IntegerType()), T.StructField("_pos", T.LongType()), T.StructField("_turn", T.LongType()),
         T.StructField("_role", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("_copies", T.LongType())]


def _result(conv_id, report: dict, turns, want: str) -> Iterator[dict]:
    if want == "turns":
        for position, (edit, role, text) in enumerate(turns):
            yield {"conv_id": conv_id, "position": position, "edit": edit, "role": role, "text": text}
        return
    digest = Digest()
    for edit, role, text in turns:
        if edit != "D":
            digest.add(role, text)
    yield {"conv_id": conv_id, **report, "repaired_sha256": digest.hash.hexdigest()}


def _batched(rows: Iterator[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Record batches of dictionaries, cut by number and by characters."""
    arrow = to_arrow_schema(schema)
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= _BATCH or chars >= BUFFER_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _prepared(conversations: DataFrame, copies: Column | None) -> DataFrame:
    """`conv_id, _turn, _role, _text, _copies` of distinct rows, in order and dealt out by ranges."""

    def given(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias(f"_{column}")

    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("_turn"), given("role"), given("text"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("_copies"),
    )
    # Repeated rows become one with a count before anything is sorted.
    order = ["conv_id", "_turn", "_role", "_text"]
    counted = rows.groupBy(*order).agg(F.sum("_copies").alias("_copies"))
    short = [F.substring(c, 1, _KEY_CHARS) for c in ("_role", "_text")]
    return counted.repartitionByRange("conv_id", "_turn", *short).sortWithinPartitions(*order)


def _local_pass(prepared: DataFrame, want: str) -> DataFrame:
    """Results of conversations inside one task, and the rows (`_block` is set) of all others."""
    conv_id = T.StructField("conv_id", prepared.schema["conv_id"].dataType)
    fields = _REPORT if want == "report" else _TURNS
    schema = T.StructType([conv_id, *fields, *_OPEN])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block, pos = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        current, is_open, chars = None, True, 0  # the first conversation may have begun elsewhere

        def still_open(rows: list[tuple]) -> Iterator[dict]:
            nonlocal pos
            for turn, role, text, copies in rows:
                yield {"conv_id": current, "_block": block, "_pos": pos, "_turn": turn, "_role": role, "_text": text, "_copies": copies}
                pos += 1

        started = False
        for conv, *row in _rows(batches):
            if started and conv != current:
                if is_open:
                    yield from still_open(held)
                else:
                    yield from _result(current, *_repaired(held), want)
                held, chars, is_open = [], 0, False
            started, current = True, conv
            held.append(tuple(row))
            chars += len(row[1]) + len(row[2]) + 64 * max(1, row[3])
            if is_open or chars > BUFFER_CHARS:
                is_open = True
                yield from still_open(held)
                held = []
        yield from still_open(held)  # the last one may go on elsewhere

    return prepared.mapInArrow(lambda b: _batched(repaired(b), schema), schema)


# -- conversations cut by borders: in blocks -------------------------------------------------


def _with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows with their fault; a row is a duplicate if an earlier one has its role and text."""
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    size = F.length("_role").cast("string")
    keyed = rows.select(
        "conv_id", "_block", "_pos", "_turn", "_copies", F.substring("_role", 1, 1).alias("_initial"),
        F.substring(F.rtrim("_text", F.lit(BLANK_CHARS)), -1, 1).alias("_last"),
        F.sha2(F.concat_ws(":", name, size, "_role", "_text"), 256).alias("_same"),
    )
    copies = keyed.where("_copies > 0").groupBy("_same").agg(F.min(F.struct("_block", "_pos")).alias("_first"), F.count("*").alias("_n"))
    several, n = stored_once(copies.where("_n > 1").withColumnRenamed("_same", "_copy_of"), "conversation-copies")
    hot = hot_keys(several.select("_copy_of", "_n"), "_copy_of", "_n")
    found = lookup(keyed, several.drop("_n"), "_same", table_key="_copy_of", table_rows=n, hot=hot, row_id="_pos")
    fault = (
        F.when(F.col("_last") == "", "blank").when(F.struct("_block", "_pos") > F.col("_first"), "duplicate")
        .when(~F.col("_last").isin(".", "!", "?"), "truncated").otherwise("")
    )
    return found.select("conv_id", "_block", "_pos", "_turn", "_copies", "_initial", fault.alias("_fault"))


_SEGMENT = [
    T.StructField("_block", T.IntegerType()),
    *(T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal")),
    T.StructField("_begin", T.StringType()), T.StructField("_end", T.StringType()),
    T.StructField("_costs", T.ArrayType(T.LongType())), T.StructField("_ranks", T.ArrayType(T.LongType())),
    T.StructField("_edits", T.ArrayType(T.StringType())),
]


def _searched(conv_id, block: int, rows: Iterator[tuple]) -> dict:
    """One block from every entry state: 16 costs, ranks of the edits per entry, and the edits."""
    searches = [Survivors(entry) for entry in range(4)]
    count = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    illegal, begin, end = 0, None, None
    for copies, initial, fault in rows:
        for k in range(copies):
            now = fault if not k or fault == "blank" else "duplicate"
            count[now] += 1
            if end is not None:
                illegal += end + initial not in FOLLOWS
            begin, end = initial if begin is None else begin, initial
            for search in searches:
                search.step(initial, now)
    costs, ranks, edits = [], [], []
    for search in searches:
        found = search.exits()
        ranked = sorted(found, key=lambda state: found[state][1])
        for state in range(4):
            cost, letters = found.get(state, (None, None))
            costs.append(cost)
            ranks.append(ranked.index(state) if state in found else None)
            edits.append(letters)
    return {
        "conv_id": conv_id, "_block": block, "blank": count["blank"], "duplicate": count["duplicate"],
        "truncated": count["truncated"], "illegal": illegal, "_begin": begin, "_end": end,
        "_costs": costs, "_ranks": ranks, "_edits": edits,
    }


def _segments(faults: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("conv_id", faults.schema["conv_id"].dataType), *_SEGMENT])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (conv, block), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            yield _searched(conv, block, (r[2:] for r in rows))

    narrow = faults.repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", "_pos")
    return narrow.select("conv_id", "_block", "_copies", "_initial", "_fault").mapInArrow(
        lambda b: _batched(searched(b), schema), schema
    )


def _chained(blocks: list[tuple]) -> Iterator[tuple[int, int, int, str]]:
    """(segment, entry, exit, tail) of every block on the cheapest way through all of them.

    Two ways that end in different states differ in a letter before either ends, so their order in
    one block decides for good, and ranks stand for the edits themselves.
    """
    ways: dict[int, tuple[int, int]] = {START: (0, 0)}
    steps = []
    for _, costs, ranks in blocks:
        best: dict[int, tuple[int, int, int]] = {}
        for entry, (cost, rank) in ways.items():
            for state in range(4):
                more = costs[4 * entry + state]
                if more is not None and (state not in best or (cost + more, rank) < best[state][:2]):
                    best[state] = (cost + more, rank, entry)
        order = sorted(best, key=lambda s: (best[s][1], ranks[4 * best[s][2] + s]))
        ways = {state: (best[state][0], order.index(state)) for state in best}
        steps.append({state: best[state][2] for state in best})
    state = min(ways, key=lambda s: (ways[s][0] + 2 * len(TAIL[s]), ways[s][1]))
    tail, picked = TAIL[state], []
    for (segment, _, _), step in zip(reversed(blocks), reversed(steps)):
        picked.append((segment, step[state], state, tail))
        state, tail = step[state], ""
    return reversed(picked)


def _picked(segments: DataFrame) -> DataFrame:
    """`_segment, _entry, _edits` (the edits that hold), and what is to add at the borders of blocks."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            rows = list(rows)  # one narrow row per block
            between, end = [], None
            for _, _, _, _, begin, last in rows:
                between.append(int(end is not None and begin is not None and end + begin not in FOLLOWS))
                end = last if last is not None else end
            ways = _chained([(r[1], r[2], r[3]) for r in rows])
            for (segment, entry, state, tail), extra, row in zip(ways, between, rows):
                cost = (row[2][4 * entry + state] or 0) + 2 * len(tail)
                yield {"_segment": segment, "_entry": entry, "_way": 4 * entry + state, "_tail": tail, "cost": cost, "_between": extra}

    schema = T.StructType.fromDDL("_segment bigint, _entry int, _way int, _tail string, cost bigint, _between bigint")
    narrow = segments.select("conv_id", "_block", "_segment", "_costs", "_ranks", "_begin", "_end")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "_block").drop("_block")
    ways = ordered.mapInArrow(lambda b: _batched(chained(b), schema), schema)
    return segments.join(ways, "_segment").select(
        "conv_id", "_block", "_entry", F.concat(F.element_at("_edits", F.col("_way") + 1), "_tail").alias("audit"),
        "cost", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("_between")).alias("illegal"),
    )


def _streamed(rows: DataFrame, picked: DataFrame, want: str) -> DataFrame:
    """The repaired turns, or their digest, of cut conversations: rows in order behind their edits."""
    conv_id = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([conv_id, *(_TURNS if want == "turns" else [_REPORT[-1]])])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, of_conv in groupby(_rows(batches), key=lambda r: r[0]):
            digest, position, turns = Digest(), 0, Turns(START, "")

            def out(found) -> Iterator[dict]:
                nonlocal position
                for edit, role, text in found:
                    if want == "turns":
                        yield {"conv_id": conv, "position": position, "edit": edit, "role": role, "text": text}
                    elif edit != "D":
                        digest.add(role, text)
                    position += 1

            for _, entry, edits, role, text, copies in of_conv:
                if edits is not None:
                    yield from out(turns.rest())
                    turns = Turns(entry, edits)
                    continue
                for _ in range(copies):
                    yield from out(turns.row(role, text))
            yield from out(turns.rest())
            if want == "report":
                yield {"conv_id": conv, "repaired_sha256": digest.hash.hexdigest()}

    heads = picked.select(
        "conv_id", "_block", F.lit(-1).cast("bigint").alias("_pos"), "_entry", "audit",
        *(F.lit(None).cast(kind).alias(c) for c, kind in (("_role", "string"), ("_text", "string"), ("_copies", "bigint"))),
    )
    bodies = rows.select(
        "conv_id", "_block", "_pos", F.lit(None).cast("int").alias("_entry"), F.lit(None).cast("string").alias("audit"),
        "_role", "_text", "_copies",
    )
    ordered = heads.union(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "_block", "_pos").drop("_block", "_pos")
    return ordered.mapInArrow(lambda b: _batched(streamed(b), schema), schema)


def _repair(conversations: DataFrame, copies: Column | None, want: str) -> DataFrame:
    done = stored(_local_pass(_prepared(conversations, copies), want), "conversations")
    rows = done.where("_block IS NOT NULL")
    fields = ["conv_id", *(f.name for f in (_REPORT if want == "report" else _TURNS))]
    faults = stored(_with_faults(rows), "conversation-faults")
    segments = stored(_segments(faults).withColumn("_segment", F.monotonically_increasing_id()), "conversation-blocks")
    picked = stored(_picked(segments), "conversation-edits")
    streamed = _streamed(rows, picked, want)
    inside = done.where("_block IS NULL").select(*fields)
    if want == "turns":
        return inside.unionByName(streamed)
    present = F.when(F.col("_copies") > 0, F.col("_turn"))
    span = F.try_subtract(F.try_subtract(F.max(present), F.min(present)), F.count_distinct(present) - 1)
    gaps = faults.groupBy("conv_id").agg(F.when(F.count(present) == 0, F.lit(0)).otherwise(span).alias("gaps"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "audit")))
    counts = picked.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in _COUNTS[1:]), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")
    )

    def by(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnRenamed("conv_id", f"_conv{suffix}")

    cut = counts.join(by(gaps, "1"), F.col("conv_id").eqNullSafe(F.col("_conv1"))).join(
        by(streamed, "2"), F.col("conv_id").eqNullSafe(F.col("_conv2"))
    )
    return inside.unionByName(cut.select(*fields))


def repair_report(conversations: DataFrame, *, copies: Column | None = None) -> DataFrame:
    """One row per conversation of `conversations` (conv_id, turn, role, text): faults and cheapest edits.

    `gaps` (missing turn numbers), `blank`, `duplicate`, `truncated` (rows by first fault),
    `illegal` (neighbours whose roles do not alternate), `cost` and `audit` of the edits, and
    `repaired_sha256` of the repaired `role:text` lines. `copies` says how often a row stands at
    its place; a conversation of none has zeros, no edits and the hash of nothing.

    Rows go by turn, nulls first, and where turns are equal by role and text; repeated rows stand
    side by side, and all but the first are duplicates. A null role or text is one space, which no
    role begins with; an empty role fits nowhere either. A null conv_id is a conversation of its
    own. Turn numbers too far apart for 64 bits give null gaps. Very long conversations are
    searched in blocks. An empty table gives no rows; other columns are not read.
    """
    return _repair(conversations, copies, "report")


def repaired_turns(conversations: DataFrame, *, copies: Column | None = None) -> DataFrame:
    """Every row and inserted turn of `conversations` after its edit: `conv_id, position, edit, role, text`.

    Deleted rows keep their role and text, and `edit` tells them (D) from kept (K), renamed (R) and
    inserted (I) ones; without them the turns in order of `position` are the repaired
    conversation. Odd rows are treated as by `repair_report`.
    """
    return _repair(conversations, copies, "turns")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in by a checksum of `conv_id:turn`, and how often a row stands.

    Of twenty rows one is dropped, emptied, robbed of its sentence ends, repeated and given to the user.
    """

    def given(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", given("conv_id"), given("turn"))) % 20
    text = (
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(given("text"), ".!?", "")).otherwise(given("text"))
    )
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(given("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times"))
    return rows, F.col("_times")
