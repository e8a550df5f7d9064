"""Conversation structure repair by iterative-deepening A*.

The roles of a conversation are to read: a system turn or none, then user and assistant in turn,
ending with the assistant; or nothing at all. A depth-first search tries the edits of
each row in ASCII order (Delete, Insert, Keep, Rerole) under a bound on the cost; a table holds for
every state the largest remaining budget that has failed there. The first path that a bound
lets through is the answer: the cheapest, and of equal ones the ASCII-least. The estimate of
the cost to go is exact for the problem without the rule that a user follows the system turn.

A conversation is searched in blocks of rows, so that none has to fit one task. The cheapest costs
between the four states, of every block, give what each state costs at a block's end; a block
is then searched from every state it may begin in, and the chain of blocks picks one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import stage

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LEGAL = ("su", "ua", "au")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
# A conversation of more rows or characters is cut into blocks; the result is the same.
BLOCK_ROWS = 1_024
BLOCK_CHARS = 1 << 24

# What has been read so far: nothing, the system turn, up to a user turn, up to an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
TURN = (USER, USER, ASSISTANT, USER)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Cost to end a conversation after its last row: inserts of the turns that are missing.
END = (0, 2 * INSERT, INSERT, 0)

# Rows to delete in any case, or else the initial of the role and whether the text is cut off.
Step = tuple[int, str, bool]


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` with faults by crc32 of `conv_id:turn`, nulls as one space, modulo 20: 0 drops a row, 1 empties
    its text, 2 removes [.!?] from it, 3 repeats the row, 4 makes it the user's."""

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = (
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return (
        rows.where(kind != 0)
        .select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
        .drop("copy")
    )


def relaxed(steps: list[Step], leave: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For every place the least cost from each state to the end, where a system turn may stand before
    any turn of the user or none: never more than the true cost."""
    after = min(leave[SYSTEM], leave[ASSISTANT])
    out = [(leave[START], after, leave[USER], after)]
    for deletes, initial, cut in reversed(steps):
        start, user_next, assistant_next, _ = out[-1]
        if deletes:
            base = [c + deletes * DELETE for c in (start, user_next, assistant_next)]
        else:
            turn = (assistant_next, assistant_next, user_next)
            base = [
                min(c + DELETE, t + cut * TRUNCATED + (0 if initial == own else REROLE))
                for c, t, own in zip((start, user_next, assistant_next), turn, "uua", strict=True)
            ]
            if initial == "s":
                base[0] = min(base[0], user_next + cut * TRUNCATED)
        first = min(base[0], INSERT + base[2], 2 * INSERT + base[1])
        second, third = min(base[1], INSERT + base[2]), min(base[2], INSERT + base[1])
        out.append((first, second, third, second))
    return out[::-1]


def _options(step: Step, place: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, next place, next state) in ASCII order of the edits."""
    deletes, initial, cut = step
    if deletes:
        # An insert between rows that go either way would only come earlier than it has to.
        yield "D" * deletes, deletes * DELETE, place + 1, state
        yield "I", INSERT, place, TURN[state]
        return
    yield "D", DELETE, place + 1, state
    yield "I", INSERT, place, TURN[state]
    kept = KEEP[state].get(initial)
    if kept is not None:
        yield "K", cut * TRUNCATED, place + 1, kept
    if kept != TURN[state]:
        yield "R", REROLE + cut * TRUNCATED, place + 1, TURN[state]


def search(steps: list[Step], entry: int = START, leave: tuple[int, ...] = END) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest way through `steps`; of equal ones the ASCII-least edits.

    `leave` is the cost to go on from every state behind the last step; it is part of the cost.
    """
    if not steps:
        return leave[entry], "", entry
    estimate = relaxed(steps, leave)
    failed: dict[tuple[int, int], int] = {}
    bound = estimate[0][entry]
    while True:
        path: list[str] = []
        frames = [(0, entry, 0, _options(steps[0], 0, entry))]
        while frames:
            place, state, spent, options = frames[-1]
            for edit, cost, at, then in options:
                left = bound - spent - cost
                if at == len(steps):
                    if leave[then] <= left:
                        return bound - left + leave[then], "".join([*path, edit]), then
                elif estimate[at][then] <= left and failed.get((at, then), -1) < left:
                    path.append(edit)
                    frames.append((at, then, spent + cost, _options(steps[at], at, then)))
                    break
            else:
                failed[place, state] = max(bound - spent, failed.get((place, state), -1))
                frames.pop()
                if path:
                    path.pop()
        bound += 1


def costs_between(steps: list[Step]) -> list[list[int | None]]:
    """The least cost from each state before `steps` to each state right behind the last of them."""
    table = []
    for entry in STATES:
        best: list[int | None] = [0 if s == entry else None for s in STATES]
        for place, step in enumerate(steps):
            then: list[int | None] = [None] * len(STATES)
            # Two inserts reach every state that inserts can reach.
            for _ in range(2):
                for s in STATES:
                    if best[s] is not None and (best[TURN[s]] is None or best[TURN[s]] > best[s] + INSERT):
                        best[TURN[s]] = best[s] + INSERT
            for s in STATES:
                if best[s] is not None:
                    for _, cost, at, to in _options(step, place, s):
                        if at > place and (then[to] is None or then[to] > best[s] + cost):
                            then[to] = best[s] + cost
            best = then
        table.append(best)
    return table


def apply_edits(
    turns: list[tuple[str | None, str | None]], steps: list[Step], edits: str, entry: int
) -> tuple[list[dict], int]:
    """The turns that `edits` leave, and their cost; `turns` has one (role, text) a step."""
    out: list[dict] = []
    state, at, cost = entry, 0, 0
    for (role, text), (deletes, initial, cut) in zip(turns, steps, strict=True):
        while edits[at] == "I":
            state = TURN[state]
            out.append({"role": NAMES[state], "text": ""})
            at, cost = at + 1, cost + INSERT
        if deletes or edits[at] == "D":
            at, cost = at + max(1, deletes), cost + DELETE * max(1, deletes)
            continue
        if edits[at] == "K":
            state = KEEP[state][initial]
        else:
            state, role = TURN[state], NAMES[TURN[state]]
            cost += REROLE
        out.append({"role": role, "text": text})
        at, cost = at + 1, cost + cut * TRUNCATED
    for _ in edits[at:]:
        state = TURN[state]
        out.append({"role": NAMES[state], "text": ""})
        cost += INSERT
    return out, cost


def steps_of(rows: list[dict], seen: set | None) -> tuple[list[Step], list[tuple], dict[str, int]]:
    """Steps, the turns behind them and the number of faults.

    A row stands for n equal ones; all but the first are duplicates. `seen` has the earlier turns; None
    if rows tell that themselves.
    """
    steps: list[Step] = []
    turns: list[tuple] = []
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(step: Step, turn: tuple) -> None:
        steps.append(step)
        turns.append(turn)

    for row in rows:
        role, text, n = row["role"], row["text"], row["n"]
        end = (text or "").rstrip(BLANKS)
        earlier = row["seen"] if seen is None else (role, text) in seen
        if seen is not None:
            seen.add((role, text))
        if not end or earlier:
            faults["duplicate" if end else "blank"] += n
            add((n, "", False), (None, None))
            continue
        cut = end[-1] not in ".!?"
        faults["truncated"] += cut
        add((0, (role or "")[:1], cut), (role, text))
        if n > 1:
            faults["duplicate"] += n - 1
            add((n - 1, "", False), (None, None))
    return steps, turns, faults


def summary(rows: list[dict], faults: dict[str, int]) -> dict:
    """Counts of a block, and what is needed to count across its ends."""
    initials = [(r["role"] or "")[:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    illegal = sum(r["n"] - 1 for r in rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return faults | {
        "illegal": illegal,
        "first": initials[0],
        "last": initials[-1],
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(set(turns)),
    }


PLACE = "conv_id {id}, pid int, sub long"
COUNTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
REPAIRED = "cost long, audit string, repaired array<struct<role string, text string>>"


def _mapped(
    batches: Iterator[pa.RecordBatch], work: Callable[[dict], dict], keys: list[str], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A block at a time: a batch may hold many long ones.
        out = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            out.append({k: row[k] for k in keys} | work(row))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _map_rows(df: DataFrame, work: Callable[[dict], dict], columns: str) -> DataFrame:
    """`work` on every row of `df`; conv_id, pid and sub stay."""
    keys = ["conv_id", "pid", "sub"]
    schema = f"{PLACE.format(id=df.schema['conv_id'].dataType.simpleString())}, {columns}"
    empty = df.sparkSession.createDataFrame([], schema)
    return df.mapInArrow(partial(_mapped, work=work, keys=keys, schema=empty.toArrow().schema), schema)


def _repair_whole(row: dict) -> dict:
    steps, turns, faults = steps_of(row["rows"], set())
    _, edits, last = search(steps)
    edits += "I" * (END[last] // INSERT)
    repaired, cost = apply_edits(turns, steps, edits, START)
    return summary(row["rows"], faults) | {"cost": cost, "audit": edits, "repaired": repaired}


def _block_costs(row: dict) -> dict:
    steps, _, _ = steps_of(row["rows"], None)
    return {"costs": costs_between(steps)}


def _search_block(row: dict) -> dict:
    steps, _, _ = steps_of(row["rows"], None)
    leave = tuple(row["leave"])
    found = [search(steps, s, leave) for s in STATES]
    return {"audits": [f[1] for f in found], "exits": [f[2] for f in found]}


def _repair_block(row: dict) -> dict:
    steps, turns, faults = steps_of(row["rows"], None)
    edits = row["edits"]
    if row["is_last"]:
        edits += "I" * (END[row["exit"]] // INSERT)
    repaired, cost = apply_edits(turns, steps, edits, row["entry"])
    return summary(row["rows"], faults) | {"cost": cost, "audit": edits, "repaired": repaired}


def _costs_to_go(blocks: pd.DataFrame) -> pd.DataFrame:
    """The cost to go on behind every block of one conversation, from each state."""
    blocks = blocks.sort_values(["pid", "sub"])
    leave, out = list(END), []
    for costs in reversed(list(blocks["costs"])):
        out.append(leave)
        leave = [min(c + end for c, end in zip(row, leave, strict=True) if c is not None and c == c) for row in costs]
    return blocks[["conv_id", "pid", "sub"]].assign(leave=out[::-1])


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which every block of one conversation begins; its last block."""
    blocks = blocks.sort_values(["pid", "sub"])
    state, entries = START, []
    for exits in blocks["exits"]:
        entries.append(state)
        state = int(exits[state])
    last = [False] * (len(blocks) - 1) + [True]
    return blocks[["conv_id", "pid", "sub"]].assign(entry=entries, is_last=last)


def _same(left: str, right: str, *columns: str) -> Column:
    """Null-safe equality of the columns of two aliased tables."""
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def _blocks(merged: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """(conv_id, pid, sub, rows): the rows of long conversations in blocks; by pid and sub they are in order."""
    firsts = merged.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    marked = (
        merged.alias("m")
        .join(firsts.alias("f"), _same("m", "f", "conv_id", "role", "text"))
        .select("m.*", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"))
    )
    order = ["turn", "role", "text"]
    # The place of a row is fixed once it is written.
    placed = stage(
        marked.repartitionByRange("conv_id", *order).withColumn("pid", F.spark_partition_id()),
        "conversation-rows",
    )
    so_far = Window.partitionBy("conv_id", "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.count(F.lit(1)).over(so_far)
    chars_before = F.coalesce(F.sum(F.length("text")).over(so_far), F.lit(0))
    # Both only grow, so their sum tells blocks apart, in order.
    sub = F.floor(rows_before / block_rows) + F.floor(chars_before / block_chars)
    return placed.withColumn("sub", sub.cast("bigint")).groupBy("conv_id", "pid", "sub").agg(_in_order())


def _in_order() -> Column:
    return F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n", "seen"))).alias("rows")


def _repair_in_blocks(merged: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    place = ["conv_id", "pid", "sub"]
    ids = merged.schema["conv_id"].dataType.simpleString()
    blocks = stage(_blocks(merged, block_rows, block_chars), "conversation-blocks")
    costs = _map_rows(blocks, _block_costs, "costs array<array<int>>")
    leave = costs.groupBy("conv_id").applyInPandas(_costs_to_go, f"{PLACE.format(id=ids)}, leave array<int>")
    with_leave = blocks.alias("b").join(leave.alias("l"), _same("b", "l", *place)).select("b.*", "leave")
    found = stage(
        _map_rows(with_leave, _search_block, "audits array<string>, exits array<int>"), "block-edits"
    )
    entries = found.select(*place, "exits").groupBy("conv_id").applyInPandas(
        _chained, f"{PLACE.format(id=ids)}, entry int, is_last boolean"
    )
    chosen = (
        found.alias("f")
        .join(entries.alias("e"), _same("f", "e", *place))
        .select("f.conv_id", "f.pid", "f.sub", "entry", "is_last", F.expr("audits[entry]").alias("edits"), F.expr("exits[entry]").alias("exit"))
    )
    ready = (
        blocks.alias("b")
        .join(chosen.alias("c"), _same("b", "c", *place))
        .select("b.*", "entry", "is_last", "edits", "exit")
    )
    return _map_rows(ready, _repair_block, f"{COUNTS}, {REPAIRED}")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The repaired conversations of `rows` (conv_id, turn, role, text), in blocks by conv_id, pid and sub.

    Each block has the turns that stay or come in (`repaired`), the edits (`audit`) and their cost, and counts
    of its faults. A conversation of ordinary length is one block; `report` adds up the others'. The rows of a conversation are taken by turn, then role, then text, nulls first; so
    ties have one order. Equal rows are counted before they are shuffled on.

    A row's first fault counts: blank (no text but white space, or null), duplicate (role and text occurred earlier in
    the conversation), truncated (the text ends in none of . ! ?). Blank and duplicate rows are deleted; other deletions
    cost 3 as well, inserts and new roles 2, truncated rows that stay 1. A null role has no initial, so
    a row that has one stays only with a new role. Rows without a conv_id are one conversation. Other columns are
    left out; an empty table gives no rows. Texts of any length are taken whole.
    """
    merged = stage(
        rows.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("n")),
        "conversation-turns",
    )
    sizes = merged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("text")).alias("chars"))
    long = stage(
        sizes.where((F.col("size") > block_rows) | (F.col("chars") > block_chars)).select("conv_id"),
        "long-conversations",
    )
    same = _same("m", "l", "conv_id")
    short = merged.alias("m").join(long.alias("l"), same, "left_anti")
    whole = (
        short.withColumn("seen", F.lit(None).cast("boolean"))
        .groupBy("conv_id")
        .agg(_in_order())
        .select("conv_id", F.lit(0).alias("pid"), F.lit(0).cast("bigint").alias("sub"), "rows")
    )
    out = _map_rows(whole, _repair_whole, f"{COUNTS}, {REPAIRED}")
    if long.isEmpty():
        return out
    in_blocks = merged.alias("m").join(long.alias("l"), same, "left_semi")
    return out.unionByName(_repair_in_blocks(in_blocks, block_rows, block_chars))


class _Report:
    """Adds up the blocks of one conversation, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.totals = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, block: dict) -> None:
        for k in self.totals:
            self.totals[k] += block[k]
        self.totals["illegal"] += self.last is not None and self.last + block["first"] not in LEGAL
        self.last = block["last"]
        if block["low"] is not None:
            # A turn may lie in two blocks.
            self.turns += block["turns"] - (self.high is not None and self.high == block["low"])
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        self.audit.append(block["audit"])
        for turn in block["repaired"]:
            self.digest.update((("\n" if self.lines else "") + f"{turn['role']}:{turn['text']}").encode())
            self.lines += 1

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv_id": self.conv_id,
            "gaps": gaps,
            **self.totals,
            "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


def _reports(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    report, done = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1).to_pylist()[0]
            if report is None or report.conv_id != block["conv_id"]:
                if report is not None:
                    done.append(report.row())
                report = _Report(block["conv_id"])
            report.add(block)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if report is not None:
        done.append(report.row())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def report(originals: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for every conv_id of `originals`: gaps, faults, illegal neighbours, cost, audit and digest.

    The blocks of a conversation pass through one task in order, a block at a time. A conversation without
    blocks has zeros, no edits and the digest of the empty string.
    """
    id_type = blocks.schema["conv_id"].dataType.simpleString()
    columns = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    empty = blocks.sparkSession.createDataFrame([], columns).toArrow().schema
    reports = (
        blocks.repartition("conv_id")
        .sortWithinPartitions("conv_id", "pid", "sub")
        .mapInArrow(partial(_reports, schema=empty), columns)
    )
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return (
        originals.select("conv_id")
        .distinct()
        .alias("o")
        .join(reports.alias("r"), _same("o", "r", "conv_id"), "left")
        .select(
            "o.conv_id",
            *[
                F.coalesce(F.col(f"r.{c}"), nothing.get(c, F.lit(0).cast("bigint"))).alias(c)
                for c in empty.names
                if c != "conv_id"
            ],
        )
    )
