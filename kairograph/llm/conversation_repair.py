"""Cheapest edits that give a conversation the order of turns ``(system? (user assistant)+)?``.

A conversation's rows become one byte each (role and fault) and are cut into
segments of at most ``SEGMENT`` rows.  In a segment the search walks backwards over
the rows, keeps the vector of costs (one for each state of the order) only at every
square root of its length, and then walks forwards block by block, computing a
block's vectors again from its checkpoint and taking the ASCII-least of the cheapest
edits.  A conversation that lies in several segments is joined by their cost
matrices: min-plus products from the last one give what each segment has to reach,
and the states in which segments are left, taken from the first one, give where each
begins.  So no task holds a conversation, whatever its length, but for its own
result: the digest of the repaired text runs over the rows in order, as a stream.

Defined results: null role and text are one space, and so is a null ``conv_id`` or
``turn`` in the key of the damage; rows without ``conv_id`` are one conversation;
rows without turn come first; rows of equal turn are ordered by the md5 of length of
role, role and text; repeated rows are rows; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Batches, join_same, materialize

#: Rows in one segment.
SEGMENT = 65_536
SPACE = " \t\n\x0b\x0c\r"
INF = math.inf

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERT = (2, 2, 3, 2)
SAYS = ("user", "user", "assistant", "user")
ROLES = "sua?"
FAULTS = ("none", "blank", "duplicate", "truncated")
DELETE, EDIT, UNFINISHED = 4, 3, 3
END = (0, 6, 3, 0)
TAIL = ("", "II", "I", "")

Vector = tuple[float, ...]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: each row after the damage that its key names; none of a dropped row."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), (F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    gone = lambda c: F.when(kind != 0, c)
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", gone(F.col("turn")).alias("turn"), gone(F.when(kind == 4, "user").otherwise(F.col("role"))).alias("role"), gone(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The same columns of rows that nothing has damaged."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), F.lit(1).alias("copies"))


def _key() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("key")


def _coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, key, cls, fault, n, fresh``: equal rows of a turn put together, without texts.

    ``fresh`` tells that role and text are not seen earlier; of its ``n`` rows that holds for the first.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    small = rows.select("conv_id", "turn", _key(), cls.alias("cls"), fault.alias("fault"), "copies")
    groups = materialize(small.groupBy("conv_id", "turn", "key", "cls", "fault").agg(F.sum("copies").alias("n")), "turns")
    first = groups.groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"))
    joined = join_same(groups, first, "conv_id", "key")
    return joined.select("conv_id", "turn", "key", "cls", "fault", "n", F.col("turn").eqNullSafe(F.col("first.turn")).alias("fresh"))


@lru_cache(1 << 16)
def _before(code: int, after: Vector) -> tuple[Vector, float]:
    """Costs before a row from those after it, less their least, and that."""
    cls, fault = ROLES[code & 3], code >> 2
    more = UNFINISHED if fault == 3 else 0
    costs = [DELETE + after[s] for s in range(4)]
    if fault in (0, 3):
        for s in range(4):
            costs[s] = min(costs[s], EDIT + more + after[INSERT[s]])
            if cls in NEXT[s]:
                costs[s] = min(costs[s], more + after[NEXT[s][cls]])
    for _ in range(2):
        costs = [min(costs[s], EDIT + costs[INSERT[s]]) for s in range(4)]
    low = min(costs)
    return tuple(c - low for c in costs), low


@lru_cache(1 << 16)
def _move(code: int, after: Vector, state: int) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits at a row in a state, up to the one that takes the row; the state then; their cost."""
    costs, low = _before(code, after)
    cls, fault = ROLES[code & 3], code >> 2
    more, out, spent = UNFINISHED if fault == 3 else 0, "", 0
    while True:
        left = costs[state] + low
        if left == DELETE + after[state]:
            return out + "D", state, spent + DELETE
        if left == EDIT + costs[INSERT[state]] + low:
            out, state, spent = out + "I", INSERT[state], spent + EDIT
        elif cls in NEXT[state] and fault in (0, 3) and left == more + after[NEXT[state][cls]]:
            return out + "K", NEXT[state][cls], spent + more
        else:
            return out + "R", INSERT[state], spent + EDIT + more


def walk(codes: bytes, state: int, goal: Vector, last: bool) -> tuple[str, int, int]:
    """Edits of a segment entered in ``state``, the state in which it is left, and their cost.

    Only every square root of the rows has its vector kept.
    """
    step = math.isqrt(len(codes)) + 1
    kept: dict[int, Vector] = {len(codes): tuple(goal)}
    vector = kept[len(codes)]
    for i in range(len(codes) - 1, -1, -1):
        vector = _before(codes[i], vector)[0]
        if i % step == 0:
            kept[i] = vector
    out, cost = [], 0
    for begin in range(0, len(codes), step):
        end = min(begin + step, len(codes))
        block = [kept[end]]
        for i in range(end - 1, begin, -1):
            block.append(_before(codes[i], block[-1])[0])
        for i in range(begin, end):
            edits, state, spent = _move(codes[i], block[end - 1 - i], state)
            out.append(edits)
            cost += spent
    if last:
        out.append(TAIL[state])
        cost += END[state]
        state = -1
    return "".join(out), state, cost


def matrix(codes: bytes) -> list[float]:
    """Cheapest costs from each state before a segment to each state after it, row by row."""
    columns = []
    for goal in range(4):
        vector, base = tuple(0.0 if s == goal else INF for s in range(4)), 0.0
        for code in reversed(codes):
            vector, low = _before(code, vector)
            base += low
        columns.append([v + base for v in vector])
    return [columns[t][s] for s in range(4) for t in range(4)]


def _segments(coded: DataFrame) -> DataFrame:
    """``conv_id, turn, key, skip, codes, border``: stretches of the rows in order.

    ``turn``, ``key`` and ``skip`` name a stretch's first row and its place among
    equal ones.  A stretch of a task's first or last conversation, or of one that is
    cut, may have neighbours: it is a ``border``; others are whole conversations.
    """
    order = ["conv_id", "turn", "key"]

    def cut(batches: Batches) -> Batches:
        rows: list[tuple] = []
        now: list | None = None
        codes = bytearray()
        first = True

        def close(border: bool) -> None:
            rows.append((*now, bytes(codes), border))
            codes.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["conv_id", "turn", "key", "skip", "codes", "border"])
            rows.clear()
            return out

        whole = True
        for batch in batches:
            for conv, turn, key, cls, fault, n, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close(first or not whole)
                        first = False
                    now, whole = [conv, turn, key, 0], True
                left, used = n, 0
                while left:
                    if len(codes) == SEGMENT:
                        close(True)
                        whole = False
                        now = [conv, turn, key, used]
                    if fresh and not used:
                        codes.append(cls | fault << 2)
                        took = 1
                    else:
                        took = min(left, SEGMENT - len(codes))
                        codes.extend(bytes([cls | (fault if fault == 1 else 2) << 2]) * took)
                    left -= took
                    used += took
            if len(rows) > 5000:
                yield flush()
        if now is not None:
            close(True)
        if rows:
            yield flush()

    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "cls", "fault", "n", "fresh")
    return ordered.mapInArrow(cut, "conv_id long, turn long, key binary, skip long, codes binary, border boolean")


PLACE = "struct<turn: bigint, key: binary, skip: bigint>"


def _fold(table: DataFrame, value: str, fold, out: str) -> DataFrame:
    """``conv_id, place`` and what ``fold`` makes of the values of a conversation's segments in order."""
    lists = table.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", value))).alias("all"))
    lists = lists.select("conv_id", F.col("all.place").alias("places"), F.col(f"all.{value}").alias("values"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = [fold(v) for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("places"), pa.array(made, pa.list_(INNER[out]))], ["conv_id", "places", "made"])

    found = lists.mapInArrow(run, f"conv_id long, places array<{PLACE}>, made array<{out}>")
    return found.select("conv_id", F.explode(F.arrays_zip("places", "made")).alias("x")).select("conv_id", F.col("x.places").alias("place"), F.col("x.made").alias("made"))


INNER = {"array<double>": pa.list_(pa.float64()), "int": pa.int32()}


def _goals(matrices: list[list[float]]) -> list[list[float]]:
    """What each segment has to reach: costs after it, from the last segment on."""
    out, vector = [], [float(x) for x in END]
    for m in reversed(matrices):
        out.append(vector)
        vector = [min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
        vector = [v - min(vector) for v in vector]
    return out[::-1]


def _entries(moves: list[list[int]]) -> list[int]:
    """The state in which each segment begins."""
    out, state = [], 0
    for m in moves:
        out.append(state)
        state = m[state]
    return out


def _audits(segments: DataFrame) -> DataFrame:
    """``conv_id, place, edits, cost, blank, duplicate, truncated`` of every segment."""
    place = F.struct("turn", "key", "skip").alias("place")
    segments = segments.select("conv_id", place, "codes", "border")
    border = segments.filter("border")

    def matrices(batches: Batches) -> Batches:
        for b in batches:
            found = [matrix(c) for c in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array(found, pa.list_(pa.float64()))], ["conv_id", "place", "matrix"])

    goals = materialize(_fold(border.mapInArrow(matrices, f"conv_id long, place {PLACE}, matrix array<double>"), "matrix", _goals, "array<double>"), "goals")
    aimed = join_same(border, goals, "conv_id", "place").select("conv_id", "place", "codes", F.col("made").alias("goal"))

    def moves(batches: Batches) -> Batches:
        for b in batches:
            found = [[walk(c, s, tuple(g), False)[1] for s in range(4)] for c, g in zip(b.column("codes").to_pylist(), b.column("goal").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "place", "moves"])

    entries = _fold(aimed.mapInArrow(moves, f"conv_id long, place {PLACE}, moves array<int>"), "moves", _entries, "int")
    ends = border.groupBy("conv_id").agg(F.max("place").alias("end"))
    known = join_same(join_same(goals.withColumnRenamed("made", "goal"), entries.withColumnRenamed("made", "entry"), "conv_id", "place"), ends, "conv_id")
    known = known.select("conv_id", "place", "goal", "entry", F.col("place").eqNullSafe(F.col("end")).alias("last"))
    todo = join_same(segments, known, "conv_id", "place", how="left").select("conv_id", "place", "codes", "goal", "entry", "last")

    def audit(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for codes, goal, entry, last in zip(*(b.column(c).to_pylist() for c in ("codes", "goal", "entry", "last")), strict=True):
                edits, _, cost = walk(codes, 0, END, True) if goal is None else walk(codes, entry, tuple(goal), last)
                faults = [0, 0, 0, 0]
                for code in range(16):
                    faults[code >> 2] += codes.count(code)
                out.append((edits, int(cost), *faults[1:]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["conv_id", "place", "edits", "cost", "blank", "duplicate", "truncated"])

    return todo.mapInArrow(audit, f"conv_id long, place {PLACE}, edits string, cost long, blank long, duplicate long, truncated long")


class _Conversation:
    """What a stream of a conversation's segments and rows adds up to."""

    def __init__(self) -> None:
        self.edits: deque[Iterator[str]] = deque()
        self.audit: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.digest, self.said, self.state = hashlib.sha256(), False, 0
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.role: str | None = None

    def segment(self, edits: str, *counts: int) -> None:
        self.audit.append(edits)
        self.edits.append(iter(edits))
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def _op(self) -> str | None:
        while self.edits:
            op = next(self.edits[0], None)
            if op is not None:
                return op
            self.edits.popleft()
        return None

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * self.said}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.said = True

    def _insert(self, text: str = "") -> None:
        self._say(SAYS[self.state], text)
        self.state = INSERT[self.state]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if self.role is not None and (self.role + role[:1]) not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role[:1]
        while (op := self._op()) == "I":
            self._insert()
        if op == "K":
            self._say(role, text)
            self.state = NEXT[self.state][role[0]]
        elif op == "R":
            self._insert(text)

    def result(self) -> tuple:
        while self._op():
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, blank, duplicate, truncated = self.counts
        return gaps, blank, duplicate, truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text of every conversation.

    ``rows`` has ``conv_id, turn, role, text, copies``, as `damaged` or `as_they_are`
    give it.  Texts move once, to the task that digests their conversation; it reads
    them in order and keeps none.
    """
    segments = materialize(_segments(_coded(rows)), "segments")
    edits = _audits(segments)
    zero = F.lit(None)
    texts = rows.select("conv_id", "turn", F.when(F.col("copies") > 0, _key()).alias("key"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("skip"), "role", "text", "copies", *(zero.cast("long").alias(c) for c in ("cost", "blank", "duplicate", "truncated")))
    plans = edits.select("conv_id", "place.turn", "place.key", F.lit(0).alias("kind"), "place.skip", zero.cast("string").alias("role"), F.col("edits").alias("text"), F.lit(0).alias("copies"), "cost", "blank", "duplicate", "truncated")
    both = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "key", "kind", "skip")

    def run(batches: Batches) -> Batches:
        now, conv, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = [x.split()[0] for x in RESULT.split(", ")]
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names)
            out.clear()
            return made

        for batch in batches:
            for c, turn, kind, role, text, copies, *counts in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "kind", "role", "text", "copies", "cost", "blank", "duplicate", "truncated")), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    now, conv = _Conversation(), c
                if kind == 0:
                    now.segment(text, *counts)
                else:
                    for _ in range(copies):
                        now.row(turn, role, text)
            if len(out) > 2000:
                yield flush()
        if now is not None:
            out.append((conv, *now.result()))
        if out:
            yield flush()

    return both.mapInArrow(run, RESULT)
