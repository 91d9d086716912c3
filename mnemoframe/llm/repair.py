"""Repair of conversations: the cheapest edits that give an optional system turn and then user and assistant by turns.

The edits of n rows are paths in a lattice of n + 1 places and four states (nothing yet, after system, after user,
after assistant). The cheapest path is found by Dijkstra's search from both ends at once; where the two meet, all
crossings of equal cost are finished, and the one whose edits joined to a string are least in ASCII wins.

A conversation may be any share of the table, so the lattice is cut into blocks: rows are dealt by ranges of
(conversation, turn), each task searches its blocks for the best way from each state to each state, and what then
meets in one place for a conversation is a few strings for each block. Texts stay out of all that: they are shuffled
once, and a task streams them past the edits without holding a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain as chained
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise

#: Costs of edits; a row that is kept or gets another role adds TRUNCATED if its text is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. A repaired conversation ends in one of GOAL.
START, SYSTEM, USER, ASSISTANT = range(4)
GOAL = (START, ASSISTANT)
NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
BEFORE = {START: (), SYSTEM: (), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a block of the lattice.
BLOCK = 1000
#: Fixed value: white space of the texts.
SPACE = " \t\n\x0b\x0c\r"

Way = tuple[int, str]  # cost, edits


class Turn(NamedTuple):
    """What the search needs of a row: its role's first letter, whether it has to go, what keeping it costs."""

    initial: str
    gone: bool
    extra: int


def _steps(turns: Sequence[Turn], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, place, state, cost) of all edits that leave a node."""
    after, wanted = NEXT[state]
    yield "I", at, after, INSERT
    if at < len(turns):
        initial, gone, extra = turns[at]
        yield "D", at + 1, state, DELETE
        if not gone:
            yield ("K", at + 1, after, extra) if initial == wanted else ("R", at + 1, after, REROLE + extra)
            if state == START and initial == "s":
                yield "K", at + 1, SYSTEM, extra


def _steps_back(turns: Sequence[Turn], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, place, state, cost) of all edits that lead to a node, with the node that they leave."""
    for before in BEFORE[state]:
        yield "I", at, before, INSERT
    if at:
        initial, gone, extra = turns[at - 1]
        yield "D", at - 1, state, DELETE
        if not gone and state == SYSTEM and initial == "s":
            yield "K", at - 1, START, extra
        for before in () if gone else BEFORE[state]:
            yield ("K", at - 1, before, extra) if initial == NEXT[before][1] else ("R", at - 1, before, REROLE + extra)


def cheapest(turns: Sequence[Turn], entry: int = START, exits: Iterable[int] = GOAL) -> Way | None:
    """The cheapest edits from ``entry`` to one of ``exits``, and of these the least in ASCII; None if there is no way.

    Only keeping a row may cost nothing, and it moves on by a row. So among nodes of one cost the search from the start
    takes the earlier row first and the one from the end the later row, and a node's edits are final when it is taken.
    Of two cheapest ways to a node none begins the other (what follows would be insertions that lead back, which
    cost), so the least way through a node is the least to it followed by the least from it.
    """
    n = len(turns)
    ahead: dict[tuple[int, int], Way] = {(0, entry): (0, "")}
    back: dict[tuple[int, int], Way] = {(n, x): (0, "") for x in exits}
    sides = (
        (ahead, [(0, 0, entry)], set(), _steps, 1),
        (back, [(0, -n, x) for _, x in sorted(back)], set(), _steps_back, -1),
    )
    best = 0 if (0, entry) in back else float("inf")
    taken_first = 0
    while all(heap for _, heap, *_ in sides) and (sides[0][1][0][0] + sides[1][1][0][0] <= best or taken_first < 2):
        # Each side takes one node before they go by cost, so the ends count as taken whatever follows.
        side = taken_first if taken_first < 2 else int(sides[1][1][0][0] < sides[0][1][0][0])
        taken_first += taken_first < 2
        ways, heap, taken, steps, sign = sides[side]
        other = sides[1 - side][0]
        cost, at, state = heapq.heappop(heap)
        node = (sign * at, state)
        if node in taken:
            continue
        taken.add(node)
        edits = ways[node][1]
        for edit, place, to, price in steps(turns, *node):
            way = (cost + price, edits + edit if sign > 0 else edit + edits)
            if (place, to) not in taken and way < ways.get((place, to), (float("inf"), "")):
                ways[place, to] = way
                heapq.heappush(heap, (way[0], sign * place, to))
                if (place, to) in other:
                    best = min(best, way[0] + other[place, to][0])
    if best == float("inf"):
        return None
    reached, ended = sides[0][2] | {(0, entry)}, sides[1][2] | {(n, x) for x in exits}
    found = [ahead[x][1] + back[x][1] for x in reached & ended if ahead[x][0] + back[x][0] == best]
    for node in reached:
        cost, edits = ahead[node]
        found += [edits + e + back[p, to][1] for e, p, to, price in _steps(turns, *node) if (p, to) in ended and cost + price + back[p, to][0] == best]
    return int(best), min(found)


WAY = "struct<entry:int,exit:int,cost:long,edits:string>"
BLOCKS = f"conv_id long, part int, block int, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long, ways array<{WAY}>"
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"
DIGEST = "conv_id long, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated")

Rows = Iterable[dict[str, Any]]


def _mapped(df: DataFrame, make: Callable[[Rows], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """``make`` over the rows of each task, one after another, with exact integers and nulls."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in make(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            size += 100 + sum(len(x) for x in row.values() if isinstance(x, str))
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def _by_conversation(rows: Rows) -> Iterator[tuple[int | None, Iterator[dict[str, Any]]]]:
    return groupby(rows, key=lambda r: r["conv_id"])


class _Block:
    """Rows of one conversation, in order, and what is counted over them."""

    def __init__(self, conv_id: int | None, part: int, number: int):
        self.key = {"conv_id": conv_id, "part": part, "block": number}
        self.rows: list[Turn] = []
        self.counts, self.illegal = dict.fromkeys((*COUNTS, None), 0), 0
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, initial: str, fault: str | None, turn: int | None) -> None:
        if self.rows:
            self.illegal += self.rows[-1].initial + initial not in LEGAL
        self.rows.append(Turn(initial, fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")))
        self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn

    def row(self, whole: bool) -> dict[str, Any]:
        """``whole``: nothing of the conversation is elsewhere, so one search does."""
        if whole:
            ways = [(START, ASSISTANT, *cheapest(self.rows))]
        else:
            ways = [(e, x, *way) for e in NEXT for x in NEXT if (way := cheapest(self.rows, e, [x]))]
        ways = [dict(zip(("entry", "exit", "cost", "edits"), w, strict=True)) for w in ways]
        seen = {k: getattr(self, k) for k in ("illegal", "first_turn", "last_turn", "turns")}
        return self.key | {k: self.counts[k] for k in COUNTS} | seen | {"first": self.rows[0].initial, "last": self.rows[-1].initial, "ways": ways}


def _search(rows: Rows, size: int) -> Iterator[dict[str, Any]]:
    """Blocks of at most ``size`` rows of the conversations in one task, whose rows come in order."""
    held: list[_Block] = []  # a block waits until it is known whether its conversation goes on
    for nth, (conv_id, group) in enumerate(_by_conversation(rows)):
        # A task's first conversation may have begun before it, its last one may go on after it.
        yield from (b.row(whole=nth > 1 and b.key["block"] == 0) for b in held)
        held = []
        number = 0
        for r in group:
            fault = "blank" if r["blank"] else "duplicate" if not r["first"] else "truncated" if r["truncated"] else None
            # Only the first of equal rows is no duplicate.
            for fault_now in chained([fault], (fault if fault == "blank" else "duplicate" for _ in range(r["copies"] - 1))):
                if held and len(held[0].rows) >= size:
                    yield held.pop().row(whole=False)
                    number += 1
                if not held:
                    held = [_Block(conv_id, r["part"], number)]
                held[0].add(r["initial"], fault_now, r["turn"])
    yield from (b.row(whole=False) for b in held)


Chain = tuple[Any, str] | None  # the blocks before, the edits of the last block


def _letters(chain: Chain, until: Chain = None) -> str:
    parts = []
    while chain is not until:
        parts.append(chain[1])
        chain = chain[0]
    return "".join(reversed(parts))


def _less(a: Chain, b: Chain) -> bool:
    """Whether ``a`` spells less than ``b``; both have as many blocks, so only what they do not share is looked at."""
    x, y = a, b
    while x is not y:
        x, y = x[0], y[0]
    return _letters(a, x) < _letters(b, x)


def _put_together(rows: Rows) -> Iterator[dict[str, Any]]:
    """The plan of each conversation from its blocks, which come in order."""
    for conv_id, blocks in _by_conversation(rows):
        ways: dict[int, tuple[int, Chain]] = {START: (0, None)}
        sums, last, first_turn, last_turn, turns = dict.fromkeys((*COUNTS, "illegal"), 0), None, None, None, 0
        for b in blocks:
            now: dict[int, tuple[int, Chain]] = {}
            for w in b["ways"]:
                if w["entry"] in ways:
                    cost, before = ways[w["entry"]]
                    way, known = (cost + w["cost"], (before, w["edits"])), now.get(w["exit"])
                    if known is None or way[0] < known[0] or (way[0] == known[0] and _less(way[1], known[1])):
                        now[w["exit"]] = way
            ways = now
            for k in sums:
                sums[k] += b[k]
            sums["illegal"] += last is not None and last + b["first"] not in LEGAL
            last = b["last"]
            if b["turns"]:
                turns += b["turns"] - (b["first_turn"] == last_turn)
                first_turn, last_turn = b["first_turn"] if first_turn is None else first_turn, b["last_turn"]
        cost, audit = min((cost, _letters(chain)) for x, (cost, chain) in ways.items() if x in GOAL)
        yield {"conv_id": conv_id, "gaps": last_turn - first_turn + 1 - turns if turns else 0, **sums, "cost": cost, "audit": audit}


def _trimmed(text: str = "text") -> Column:
    return F.rtrim(F.col(text), F.lit(SPACE))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) with one blank for a null role or text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


ORDER = ("conv_id", "turn", "role", "digest")


def plan_repairs(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation: counts of what is wrong, the cost of the cheapest edits, and the edits (PLAN).

    Rows are taken by turn, those without one first, equal turns by role and by the SHA-256 of their text; equal rows
    are next to each other. A null role or text is one blank; rows without a conv_id are one conversation; other columns
    are not looked at. ``gaps`` counts turns that are missing between the first and the last. A row's first fault
    counts: blank, a duplicate of an earlier role and text, truncated (does not end in a full stop, question or
    exclamation mark). ``illegal`` counts neighbours whose roles cannot follow each other.
    """
    rows = _turns(conversations)
    trimmed = _trimmed()
    marks = [(F.length(trimmed) == 0).alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")]
    # Equal rows are one row with a count from here on; texts do not go any further.
    slim = materialise(rows.select(*ORDER, *marks).groupBy(*ORDER).agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("copies")), "turns")
    # The earliest turn of each role and text. Both sides have one row a key, so no key is hot in the join.
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    first = slim.where("not blank").groupBy("conv_id", "role", "digest").agg(earliest.alias("at"))
    first = first.select(*[F.col("at.turn" if c == "turn" else c).alias(f"first_{c}") for c in ORDER])
    on = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ORDER]
    marked = slim.join(first, on, "left").select(*ORDER, "blank", "truncated", "copies", F.col("first_digest").isNotNull().alias("first"))
    dealt = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    narrow = dealt.select("conv_id", F.spark_partition_id().alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "first", "copies")
    blocks = _mapped(narrow, lambda found: _search(found, block), BLOCKS)
    return _mapped(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"), _put_together, PLAN)


def _edited(conv_id: int | None, audit: str, turns: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """The rows of a repaired conversation, one after another."""
    state, position = START, 0
    for edit in audit:
        turn = None if edit == "I" else next(turns)
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and state == START and turn["role"][:1] == "s" else NEXT[state][0]
        position += 1
        yield {"conv_id": conv_id, "position": position, "edit": edit, "role": turn["role"] if edit == "K" else ROLE[state], "text": "" if edit == "I" else turn["text"]}


def _repaired(rows: Rows, make: Callable[..., Iterator[dict[str, Any]]]) -> Iterator[dict[str, Any]]:
    """``make`` for each conversation of a task: its plan comes first, then its rows in order."""
    for conv_id, group in _by_conversation(rows):
        yield from make(conv_id, next(group)["audit"], group)


def _digest(conv_id: int | None, audit: str, turns: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    said, begun = hashlib.sha256(), False
    for row in _edited(conv_id, audit, turns):
        said.update(f"{'\n' * begun}{row['role']}:{row['text']}".encode())
        begun = True
    yield {"conv_id": conv_id, "repaired_sha256": said.hexdigest()}


def _streamed(conversations: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows in order, a conversation in one task that need not hold it."""
    rows = _turns(conversations).select(*ORDER, F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("audit"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("turn", "long"), ("role", "string"), ("digest", "string"))]
    heads = plan.select("conv_id", *nothing, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    return both.select("conv_id", "audit", "role", "text")


def repaired_rows(conversations: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations (REPAIRED): positions from 1, the edit that gave each row, its role and text."""
    plan = plan_repairs(conversations) if plan is None else plan
    return _mapped(_streamed(conversations, plan), lambda rows: _repaired(rows, _edited), REPAIRED)


def repair_digests(conversations: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The plan of each conversation with the SHA-256 of its repaired ``role:text`` lines.

    A digest reads its conversation from the first row to the last, so one task streams each; it holds the edits and a
    batch of rows.
    """
    plan = materialise(plan_repairs(conversations) if plan is None else plan, "repairs")
    digests = _mapped(_streamed(conversations, plan), lambda rows: _repaired(rows, _digest), DIGEST)
    digests = digests.select(F.col("conv_id").alias("of"), "repaired_sha256")
    return plan.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


#: Damages, by the checksum of ``conv_id:turn`` modulo 20; other remainders leave a row as it is.
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a quarter of the rows damaged, for tests of the repair; nulls are one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(kind == EMPTY, "").when(kind == UNSTOP, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1)
    out = conversations.select("conv_id", "turn", F.when(kind == AS_USER, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, repair them, and give a row for every original conv_id; zeros where nothing is left."""
    found = repair_digests(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    columns = [F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in (*(x.split()[0] for x in PLAN.split(", ")[1:]), "repaired_sha256")]
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *columns)
