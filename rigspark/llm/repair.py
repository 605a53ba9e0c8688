"""Repair of the structure of conversations by iterative-deepening A*.

A whole conversation reads ``(system? (user assistant)+)?``. Every row is kept, given another role or deleted, rows may be put in, each at a
cost; wanted is the cheapest list of edits, and of equally cheap ones the first in ASCII order. A search goes depth first through the
edits in that order under a bound of cost plus a lower estimate of what is to come; the bound rises to the least cost met beyond it. A
table of failed (row, state) pairs, with what was left to spend there, keeps a bound's search linear. The first accepting path is the answer.

A conversation may be any part of the table. Rows are sorted by conversation and turn over ranges, so one conversation may lie in several
tasks; it is cut into stretches of bounded length, each searched once for every state it may begin and end in, and the stretches are joined
from left to right by cost and edits. Two edit lists of a stretch never begin with one another, so the best of each part is the best of the
whole. A conversation of up to one stretch is searched whole. No step holds the rows of a conversation together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import SPACES, bounded_batches, query, store, table

STRETCH = 64  # rows searched at once
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role so far
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5  # costs
TRUNCATED = 5  # of a truncated row that is not deleted
HOPELESS = 1 << 60
#: Faults of a row, of which the first counts.
FINE, BLANK, DUPLICATE, CUT = range(4)
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def step(edit: str, initial: str, state: int) -> int | None:
    """The state after an edit, or None where it is not allowed."""
    if edit == "D":
        return state
    return KEEPS.get((initial, state)) if edit == "K" else ASSISTANT if state == USER else USER


def search(rows: list[tuple[str, int]], begin: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cheapest edits of (role initial, fault) rows from ``begin``: cost and initials (D, I, K, R), the first in ASCII order.

    They end in ``goal`` with an edit of the last row; without a goal in a whole conversation, with rows put in at the end if need be.
    None: the goal can't be reached.
    """
    n = len(rows)
    if goal == START != begin or goal == SYSTEM != begin and (
            begin != START or not any(r[0] == "s" and r[1] not in (BLANK, DUPLICATE) for r in rows)):
        return None
    ahead = [0] * (n + 1)  # at least so much for rows i and on
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        ahead[i] = ahead[i + 1] + (DELETE if fault else REROLE if initial not in "sua" or not initial else KEEP)
    failed: dict[tuple[int, int], tuple[int, int]] = {}

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", DELETE, i + 1, state
        if i < n or goal is None:
            yield "I", INSERT, i, step("I", "", state)
        if i < n and rows[i][1] not in (BLANK, DUPLICATE):
            more = TRUNCATED if rows[i][1] == CUT else 0
            kept = step("K", rows[i][0], state)
            if kept is not None:
                yield "K", KEEP + more, i + 1, kept
            yield "R", REROLE + more, i + 1, step("R", rows[i][0], state)

    def ends(i: int, state: int) -> bool:
        return i == n and (state == goal if goal is not None else state in (START, ASSISTANT))

    bound = ahead[0]
    while True:
        if ends(0, begin):
            return 0, ""
        # a frame: row, state, left to spend, moves to try, least missing of what failed below
        path, stack = [], [[0, begin, bound, moves(0, begin), None]]
        while stack:
            i, state, left, todo, missing = stack[-1]
            for edit, cost, i2, state2 in todo:
                left2 = left - cost
                short = ahead[i2] - left2
                if short <= 0 and (old := failed.get((i2, state2))) and old[0] >= left2:
                    short = old[1] - left2  # what it needs at least, as found there
                if short > 0:
                    missing = short if missing is None else min(missing, short)
                    continue
                stack[-1][4] = missing
                path.append((edit, cost))
                if ends(i2, state2):
                    return sum(c for _, c in path), "".join(e for e, _ in path)
                stack.append([i2, state2, left2, moves(i2, state2), None])
                break
            else:
                stack.pop()
                # at the end, in the wrong state, no budget helps
                missing = HOPELESS if missing is None else missing
                failed[i, state] = left, left + missing
                if stack:
                    path.pop()
                    up = stack[-1][4]
                    stack[-1][4] = missing if up is None else min(up, missing)
                else:
                    bound += missing


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, told by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 takes its
    ``[.!?]`` out, 3 repeats it, 4 sets the role user. Nulls read as one space, in the hashed text too; ids and turns stay null."""
    blank = F.lit(" ")
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("_kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    rows = rows.filter("_kind <> 0").withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("_kind", "_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``_late`` (an equal row stands in an earlier turn), ``_fault`` without duplicates, and ``_turn``, which sorts nulls first."""
    who = F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull()
    rows = rows.withColumns({"_h1": F.xxhash64(*who, "role", "text"), "_h2": F.xxhash64(F.lit(17), *who, "role", "text"),
                             "_turn": F.coalesce("turn", F.lit(-2 ** 63))})
    rows = store(rows)
    first = rows.groupBy("_h1", "_h2").agg(F.min("_turn").alias("_first"), F.max("_turn").alias("_last")).filter("_first < _last")
    rows = rows.join(first.select("_h1", "_h2", "_first"), ["_h1", "_h2"], "left")
    bare = F.btrim("text", F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    return rows.select("conv_id", "turn", "role", "text", "_turn", F.coalesce(F.col("_turn") > F.col("_first"), F.lit(False)).alias("_late"), fault.alias("_fault"))


ORDER = ["conv_id", "_turn", "role", "text"]
STRETCHES = ("conv_id bigint, _task int, _no bigint, _head string, _tail string, _n bigint, low bigint, high bigint, _distinct bigint, "
             "blank bigint, duplicate bigint, truncated bigint, illegal bigint, _ways array<struct<begin:int,end:int,cost:bigint,audit:string>>")
AUDITS = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
PAIRS = ("su", "ua", "au")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += 200 + (len(r[-1]) if r[-1] else 0)
        if len(some) >= size or held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _stretches(rows: DataFrame, length: int) -> DataFrame:
    """One row per stretch: its place, counts, first and last role initial, and the cheapest edits by first and last state."""
    longs = pa.int64()
    way = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", longs), ("audit", pa.string())])
    schema = pa.schema([("conv_id", longs), ("_task", pa.int32()), ("_no", longs), ("_head", pa.string()), ("_tail", pa.string())]
                       + [(c, longs) for c in ("_n", "low", "high", "_distinct", "blank", "duplicate", "truncated", "illegal")] + [("_ways", pa.list_(way))])

    def cut(records: Iterator[tuple]) -> Iterator[tuple[int | None, bool, list[tuple]]]:
        """Conversation, whether its first rows may lie in an earlier task, and its next rows."""
        first = True
        for conv, mine in groupby(records, key=lambda r: r[0]):
            part, last = [], None
            for _, turn, role, text, late, fault in mine:
                again = fault != BLANK and (late or last == (turn, role, text))
                part.append((role[:1], DUPLICATE if again else fault, turn))
                last = (turn, role, text)
                if len(part) == length:
                    yield conv, first, part
                    part, first = [], False
            if part:
                yield conv, first, part
            first = False

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, known = TaskContext.get().partitionId(), {}

        def ways(rows: tuple, begins: tuple) -> list[dict]:
            if (rows, begins) not in known:
                if len(known) > 50_000:
                    known.clear()
                known[rows, begins] = [{"begin": b, "end": e, "cost": got[0], "audit": got[1]} for b in begins for e in range(4)
                                       if (got := search(list(rows), b, e)) is not None]
            return known[rows, begins]

        def out() -> Iterator[tuple]:
            conv, no = None, 0
            for conv_id, open_, part in cut(_records(batches)):
                goes_on = no > 0 and conv_id == conv
                begins = (START, SYSTEM, USER, ASSISTANT) if open_ or goes_on else (START,)
                conv, no = conv_id, no + 1 if goes_on else 1
                turns = [t for _, _, t in part if t is not None]
                faults = [f for _, f, _ in part]
                steps = [a[0] + b[0] for a, b in zip(part, part[1:])]
                yield (conv_id, task, no, part[0][0], part[-1][0], len(part), min(turns, default=None), max(turns, default=None),
                       len(set(turns)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                       sum(s not in PAIRS for s in steps), ways(tuple(r[:2] for r in part), begins))
        yield from _batches(out(), schema, 512)

    sorted_rows = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return sorted_rows.select("conv_id", "turn", "role", "text", "_late", "_fault").mapInArrow(solve, STRETCHES)


def audits_of(rows: DataFrame, length: int = STRETCH) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: ``gaps``, numbers of ``blank``, ``duplicate``, ``truncated`` rows and ``illegal``
    neighbours, ``cost`` and ``audit`` of the cheapest edits. Turns order a conversation, nulls first, then role and text."""
    return _audits(_faults(rows), length)


def _audits(faults: DataFrame, length: int) -> DataFrame:
    longs = pa.int64()
    schema = pa.schema([(c, longs) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, parts in groupby(_records(batches), key=lambda r: r[0]):
                best, tail, counts, distinct, low, high = {START: (0, "")}, None, [0] * 4, 0, None, None
                for _, _, _, head, last, _, first, final, new, *more, ways in parts:
                    steps: dict[int, tuple[int, str]] = {}
                    for w in ways:
                        if w["begin"] in best:
                            cost, audit = best[w["begin"]]
                            way = cost + w["cost"], audit + w["audit"]
                            steps[w["end"]] = min(way, steps.get(w["end"], way))
                    best = steps
                    counts = [a + b for a, b in zip(counts, more)]
                    counts[3] += tail is not None and tail + head not in PAIRS
                    tail = last
                    distinct += new - (first is not None and high == first)  # a turn that goes on from the part before
                    low, high = first if low is None else low, high if final is None else final
                ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
                cost, audit = min((c + INSERT * len(ends[s]), a + ends[s]) for s, (c, a) in best.items())
                yield conv, high - low + 1 - distinct if low is not None else 0, *counts, cost, audit
        yield from _batches(out(), schema)

    place = ["conv_id", "_task", "_no"]
    return _stretches(faults, length).repartition("conv_id").sortWithinPartitions(*place).mapInArrow(fold, AUDITS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation, and an iterator of its repaired rows (turn, role, text, edit); a conversation's audit comes before its rows."""
    for conv, mine in groupby(_records(batches), key=lambda r: r[0]):
        head = next(mine)

        def repaired(mine=mine, audit=head[4]):
            state = START
            for e in audit or "":
                turn, role, text = (None, "", "") if e == "I" else next(mine)[1:4]
                state = step(e, role[:1], state)
                if e != "D":
                    yield turn, role if e == "K" else ROLES[state], text, e
        yield conv, head, repaired()
        for _ in mine:
            pass


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of every conversation in order, its audit first."""
    mine = rows.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.col("_turn"), F.lit(1).alias("_row"))
    heads = audits.select("conv_id", F.lit(None).cast("bigint"), F.lit(""), F.lit(""), "audit", F.lit(-2 ** 63), F.lit(0))
    both = mine.unionAll(heads).repartition("conv_id").sortWithinPartitions("conv_id", "_row", "_turn", "role", "text")
    return both.select("conv_id", "turn", "role", "text", "audit")


def repair_conversations(conversations: DataFrame, length: int = STRETCH) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``turn`` (null where put in), ``role``, ``text``, ``edit`` (K, R or I).

    * Null role or text reads as one space. Null ids are one conversation. Null turns come first; equal turns go by role, then text.
    * A repeated row is a duplicate and goes. A conversation that loses all its rows is not in the result. An empty table stays empty.
    * Extra columns are left out. Neither rows nor texts of a conversation are held together, however many there are.
    """
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = store(_faults(rows))
    audits = store(_audits(rows, length))
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("edit", pa.string()), ("text", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((conv, i, turn, role, edit, text) for conv, _, mine in _edited(batches)
                             for i, (turn, role, text, edit) in enumerate(mine)), schema)

    out = _with_audits(rows, audits).mapInArrow(write, "conv_id bigint, place bigint, turn bigint, role string, edit string, text string")
    return out.select("conv_id", "place", "turn", "role", "text", "edit")


def repair_report(ids: DataFrame, rows: DataFrame, length: int = STRETCH) -> DataFrame:
    """One row per ``conv_id`` of ``ids``: the audit of its ``rows`` (see ``audits_of``) and ``repaired_sha256`` over ``role:text`` lines.

    The hash reads a conversation row by row, in order, in one task: it holds a row at a time.
    A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    bounded_batches(rows.sparkSession)
    faults = store(_faults(rows))
    audits = store(_audits(faults, length))
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, _, mine in _edited(batches):
                total, between = hashlib.sha256(), b""
                for _, role, text, _ in mine:
                    total.update(between + f"{role}:{text}".encode())
                    between = b"\n"
                yield conv, total.hexdigest()
        yield from _batches(out(), schema)

    hashes = _with_audits(faults, audits).mapInArrow(digest, "conv_id bigint, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = audits.alias("a").join(hashes.alias("h"), F.col("a.conv_id").eqNullSafe(F.col("h.conv_id"))).select("a.*", "repaired_sha256")
    every = ids.select(F.col("conv_id").cast("bigint").alias("_of")).distinct()
    out = every.join(found, F.col("_of").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_of").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


@query("op12_conversation_structure_repair")
def op12_conversation_structure_repair(spark, sf):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(given, damage(given))
