"""Conversation repair against a plain dynamic programme, an enumeration of edits, and the whole contract."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from mnemoframe.llm import queries, repair
from mnemoframe.llm.repair import Turn

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SHAPE = re.compile(r"(s?(ua)+)?")


def played(turns, audit):
    """(cost, role initials) of the edits, or None where they do not fit the rows."""
    cost, roles, left = 0, "", list(turns)
    for edit in audit:
        wanted = "a" if roles[-1:] == "u" else "u"
        if edit == "I":
            cost, roles = cost + 2, roles + wanted
            continue
        if not left:
            return None
        turn = left.pop(0)
        if edit == "D":
            cost += 3
        elif turn.gone:
            return None
        else:
            cost += turn.extra + 2 * (edit == "R")
            roles += turn.initial if edit == "K" else wanted
    return None if left or not SHAPE.fullmatch(roles) else (cost, roles)


def enumerated(turns, most_inserts):
    best = None
    for edits in itertools.product("DKR", repeat=len(turns)):
        for inserts in itertools.product(range(most_inserts + 1), repeat=len(turns) + 1):
            audit = "".join("I" * k + e for k, e in zip(inserts, (*edits, ""), strict=True))
            done = played(turns, audit)
            if done and (best is None or (done[0], audit) < best):
                best = (done[0], audit)
    return best


def relaxed(turns):
    """The same by relaxing all edges of the lattice until nothing changes."""
    n = len(turns)
    ways = {(0, "0"): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, state), (cost, audit) in list(ways.items()):
            wanted = "a" if state == "u" else "u"
            nexts = [((i, wanted), cost + 2, audit + "I")]
            if i < n:
                t = turns[i]
                nexts.append(((i + 1, state), cost + 3, audit + "D"))
                if not t.gone:
                    nexts.append(((i + 1, wanted), cost + t.extra + 2 * (t.initial != wanted), audit + "RK"[t.initial == wanted]))
                    if state == "0" and t.initial == "s":
                        nexts.append(((i + 1, "s"), cost + t.extra, audit + "K"))
            for node, c, a in nexts:
                if node not in ways or (c, a) < ways[node]:
                    ways[node] = (c, a)
                    changed = True
    return min(ways[n, x] for x in "0a" if (n, x) in ways)


def some_turns(rng, n):
    return [Turn(rng.choice("uaus "), rng.random() < 0.15, int(rng.random() < 0.2)) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            turns = some_turns(rng, n)
            assert repair.cheapest(turns) == enumerated(turns, 2)


def test_search_against_relaxation():
    rng = random.Random(6)
    for _ in range(400):
        turns = some_turns(rng, rng.randrange(14))
        found = repair.cheapest(turns)
        assert found == relaxed(turns) and played(turns, found[1])[0] == found[0]


def test_blocks_put_together_give_the_same():
    rng = random.Random(7)
    for _ in range(150):
        turns = some_turns(rng, rng.randrange(1, 30))
        rows = [{"conv_id": 1, "part": 0, "turn": i, "initial": t.initial, "blank": t.gone, "truncated": t.extra > 0, "first": True, "copies": 1} for i, t in enumerate(turns)]
        size = rng.randrange(1, 9)
        blocks = list(repair._search(iter(rows), size))
        (plan,) = repair._put_together(iter(blocks))
        clean = [Turn(t.initial, t.gone, 0 if t.gone else t.extra) for t in turns]
        assert len(blocks) == -(-len(turns) // size) and (plan["cost"], plan["audit"]) == relaxed(clean)
        assert plan["illegal"] == sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))


def test_long_clean_conversation():
    assert repair.cheapest([Turn("ua"[i % 2], False, 0) for i in range(1000)]) == (0, "K" * 1000)


def plain(rows):
    """The contract's rows from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv_id, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, turns = set(), [], []
        for _, role, text in found:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            turns.append(Turn(role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = relaxed(turns)
        numbers = {t for t, _, _ in found if t is not None}
        lines, left, roles = [], list(found), ""
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else left.pop(0)
            if edit != "D":
                if edit != "K":
                    role = "assistant" if roles[-1:] == "u" else "user"
                roles += role[:1]
                lines.append(f"{role}:{text}")
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_query_against_a_plain_version(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = queries.op11_repair(spark, sf)
    assert got.columns == list(COLUMNS) and dict(got.dtypes)["cost"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def odd_rows():
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice([None, "", " \t", "Yes.", "No", "What?\n", "é", "x" * 50_000 + "."])) for c in [None, *range(40)] for _ in range(rng.randrange(1, 12))]
    rows += rows[::7]
    rows += [(99, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(300)]
    # A conversation of which the damage leaves nothing.
    rows += [(next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "gone.")]
    return rows


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_odd_rows_and_small_blocks(spark, monkeypatch, block):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string")
    monkeypatch.setattr(repair.plan_repairs, "__defaults__", (block,))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, repair.repair_damaged(df.repartition(3)).collect()), key=repr) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(df).count() == 0 and repair.repaired_rows(df).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "user", "And"), (2, 5, "assistant", "Well."), (2, None, "assistant", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repaired_rows(df).orderBy("conv_id", "position").collect()]
    assert got == [(1, 1, "K", "system", "Be kind."), (1, 2, "K", "user", "Hi?"), (1, 3, "R", "assistant", "And"), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Well.")]
