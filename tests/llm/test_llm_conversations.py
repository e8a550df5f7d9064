import hashlib
import itertools
import random
import re
import zlib

import pytest

from feedloom.llm import conversations as c

ROWS = "conv_id bigint, turn bigint, role string, text string, rows string, pid int, sub string, n int, seen string, audit int"


def rows_of(spark, rows):
    """Rows of (conv_id, turn, role, text), with more columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], ROWS)


def nulls_first(value):
    return (value is not None, value if value is not None else 0)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2 and text is not None:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def text_key(value):
    return (value is not None, value or "")


def brute_repair(rows):
    """All ways to edit, row by row; for short conversations."""
    rows = sorted(rows, key=lambda r: (nulls_first(r[1]), text_key(r[2]), text_key(r[3])))
    faults, seen = [], set()
    for _, _, role, text in rows:
        if re.search(r"[^\x20\x09-\x0D]", text or "") is None:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) is None:
            faults.append("truncated")
        else:
            faults.append(None)
        seen.add((role, text))
    best = (3 * len(rows), "D" * len(rows), [])

    def walk(i, initials, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, list(out)), key=lambda b: b[:2])
        for name in ("user", "assistant"):
            walk_if(i, initials + name[0], cost + 2, audit + "I", [*out, (name, "")])
        if i == len(rows):
            return
        walk_if(i + 1, initials, cost + 3, audit + "D", out)
        if faults[i] in ("blank", "duplicate"):
            return
        _, _, role, text = rows[i]
        more = int(faults[i] == "truncated")
        walk_if(i + 1, initials + (role or " ")[:1].ljust(1), cost + more, audit + "K", [*out, (role, text)])
        for name in ("user", "assistant"):
            walk_if(i + 1, initials + name[0], cost + 2 + more, audit + "R", [*out, (name, text)])

    def walk_if(i, initials, cost, audit, out):
        if re.fullmatch("s?(ua)*u?", initials):
            walk(i, initials, cost, audit, out)

    walk(0, "", 0, "", [])
    starts = [(r[2] or "")[:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"),
        faults.count("duplicate"),
        faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(starts)),
        best[0],
        best[1],
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    )


def random_rows(rng, convs=120, longest=6):
    texts = ["Yes.", "no", "Why? ", "", " \t", None, "End!\x0b", "cut .x", "x" * 30_000 + "."]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(longest + 1)):
            at = rng.choice([turn, turn, turn, None, 3 * turn, 1])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            row = (conv, at, role, rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows[: rng.randrange(len(rows) // 2, len(rows))]


def result(spark, originals, rows, **sizes):
    found = c.report(rows_of(spark, originals), c.repair(rows_of(spark, rows), **sizes)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 1}, {"block_rows": 2}, {"block_chars": 40}])
def test_repair_against_all_edits(llm_spark, sizes):
    rng = random.Random(len(sizes) + sum(sizes.values()))
    rows = random_rows(rng, longest=4)
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    expected = {conv: brute_repair(found) for conv, found in by_conv.items()}
    assert result(llm_spark, rows, rows, **sizes) == expected


def test_damage(llm_spark):
    rows = random_rows(random.Random(3), convs=200, longest=9)
    found = c.damaged(rows_of(llm_spark, rows)).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=order) == sorted(brute_damage(rows), key=order)


def test_long_conversations_in_blocks_and_whole(llm_spark):
    """Two conversations of many rows, one of them without an id and with one text throughout."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"t{t}", f"{t}!"])) for t in range(400)]
    rows += [(None, rng.choice([None, 7]), "user", rng.choice(["Same.", ""])) for _ in range(3000)]
    whole = result(llm_spark, rows, rows)
    assert result(llm_spark, rows, rows, block_rows=16) == whole
    assert whole[None][5] == whole[None][6].count("D") * 3 + whole[None][6].count("I") * 2 + 2 * whole[None][6].count("R")
    assert re.fullmatch("[DIKR]+", whole[1][6])


def test_search_equals_costs_between():
    """The search's cost is that of the exact table, whatever the states at both ends."""
    rng = random.Random(6)
    for _ in range(300):
        steps = [
            (rng.choice([0, 0, 0, 2]), rng.choice("suaat"), rng.random() < 0.3) for _ in range(rng.randrange(1, 30))
        ]
        leave = tuple(rng.randrange(6) for _ in c.STATES)
        for entry, costs in enumerate(c.costs_between(steps)):
            least = min(x + y for x, y in zip(costs, leave, strict=True) if x is not None)
            cost, _, last = c.search(steps, entry, leave)
            assert cost == least == min(costs[last] + leave[last], cost)


def test_conversations_without_rows(llm_spark):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(llm_spark, [], []) == {}
    assert result(llm_spark, [(4, 0, "user", "Hi."), (None, 0, "user", "Hi.")], []) == {4: nothing, None: nothing}
