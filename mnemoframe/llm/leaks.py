"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

A text that holds an item of n characters with at most e edits shares at least (q-grams looked for) - q * e of
them with it, all on at most e + 1 neighbouring diagonals (text position minus item position). Diagonals are
cut into bands of 2(e + 1) that overlap by half, so some band has them all. Bands that reach the bound are
aligned, within the band, and kept if the edits stay in the budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Characters of a q-gram; items for which the lemma needs shorter ones (of 13 to 15 characters) have SHORT_Q.
Q = 8
SHORT_Q = 6
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Characters of benchmark text in one index; a larger benchmark is searched in several passes.
BLOCK_CHARS = 2_000_000
#: Cells of a row of the alignments that are made together.
CELLS = 200_000
#: Characters of text looked at together.
CHUNK_CHARS = 1_500_000
#: q-grams in more item positions than this are left out of the count where an item has enough others.
COMMON = 2

_BASE = 0x9E3779B97F4A7C15
_TABLE_BITS = 20
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to what is compared: letters and digits in lower case, anything else a blank."""
    if not _fold:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000)]
        _fold.append(np.array([ord(low) if c.isalnum() and len(low := c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in chars], dtype=np.uint32))
    return _fold[0]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, positions): folded characters with runs of blanks as one, and where each was in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    folded = np.where(codes < 0x10000, fold_table()[np.minimum(codes, 0xFFFF)], codes)
    blank = folded == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    return folded[at], at


def q_gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the ``q`` characters from each position, put together from those of powers of two."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    h, power, width = codes.astype(np.uint64) + np.uint64(1), _BASE, 1
    out, done = np.zeros(len(codes), dtype=np.uint64), 0
    while True:
        if q & width:
            n = len(codes) - done - width + 1
            out, done = out[:n] * np.uint64(power) + h[done : done + n], done + width
        if done == q:
            return out
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), width * 2


def gram_size(chars: int) -> int:
    """The q-gram size for an item: with Q or, where its budget makes that useless, with SHORT_Q, at least one q-gram has
    to be left whatever the edits: n - q + 1 - q * edits >= 1."""
    edits = int(EDIT_RATE * chars)
    q = Q if chars >= Q * (edits + 1) else SHORT_Q
    if chars < q * (edits + 1):
        raise ValueError(f"no q-gram size for {chars} characters and {edits} edits")
    return q


class _Grams:
    """The q-grams of one size of some items: hash to (item, position), with each item's bound."""

    def __init__(self, q: int, items: np.ndarray, codes: list[np.ndarray], edits: np.ndarray):
        self.q = q
        hashes = [q_gram_hashes(codes[i], q) for i in items]
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = counts[inverse]
        self.bound = np.zeros(len(codes), dtype=np.int64)
        rows, at = [], 0
        for i, h in zip(items.tolist(), hashes, strict=True):
            here = often[at : at + len(h)]
            at += len(h)
            needed = min(len(h), int(q * edits[i] + max(8, len(h) // 5)))
            limit = max(COMMON, int(np.partition(here, needed - 1)[needed - 1]))
            kept = np.flatnonzero(here <= limit)
            self.bound[i] = len(kept) - q * edits[i]
            rows.append(np.column_stack([h[kept], np.full(len(kept), i, np.uint64), kept.astype(np.uint64)]))
        table = np.concatenate(rows)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.hash, self.first, self.count = np.unique(table[:, 0], return_index=True, return_counts=True)
        self.item, self.pos = table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)
        self.seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.seen[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of the bands that reach their item's bound."""
        h = q_gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        slot = np.searchsorted(self.hash, h[at])
        slot[slot == len(self.hash)] = 0
        found = self.hash[slot] == h[at]
        at, slot = at[found], slot[found]
        counts = self.count[slot]
        which = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else np.empty(0, np.int64)
        item = self.item[which]
        band = (np.repeat(at, counts) - self.pos[which]) // (edits[item] + 1)
        # Bands are numbered from a little below 0; both bands of a diagonal get its count.
        span = len(codes) + 4096
        keys, n = np.unique(np.concatenate([item * span + band + 2048, item * span + band + 2047]), return_counts=True)
        item = keys // span
        good = n >= self.bound[item]
        return item[good], keys[good] % span - 2048


class Index:
    """The items with their edit budgets, and their q-grams by size."""

    def __init__(self, items: Sequence[tuple[object, str]]):
        # A blank end says nothing.
        codes = [(key, c.strip().codes) for key, text in items if len(c := _Codes(text)) >= Q]
        self.ids = [key for key, _ in codes]
        self.codes = [x for _, x in codes]
        self.edits = np.array([int(EDIT_RATE * len(c)) for c in self.codes], dtype=np.int64)
        sizes = np.array([gram_size(len(c)) for c in self.codes], dtype=np.int64)
        self.grams = [_Grams(q, some, self.codes, self.edits) for q in (Q, SHORT_Q) if len(some := np.flatnonzero(sizes == q))]

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of the bands that reach their item's bound."""
        found = [g.candidates(codes, self.edits) for g in self.grams]
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True))


class _Codes:
    """Normalised text without blanks at its ends."""

    def __init__(self, text: str):
        self.codes, _ = normalise(text or "")

    def strip(self) -> _Codes:
        inner = np.flatnonzero(self.codes != 32)
        self.codes = self.codes[inner[0] : inner[-1] + 1] if len(inner) else self.codes[:0]
        return self

    def __len__(self) -> int:
        return len(self.strip().codes)


_STEP = np.int64(1) << np.int64(32)


def align(items: list[np.ndarray], text: np.ndarray, low: np.ndarray, width: int, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each item within its band, with where that match starts and ends in ``text``.

    Cells are edits * 2^32 + start; a row holds one item character for every candidate. ``low`` is a band's first
    diagonal, ``width`` the number of diagonals. It ends early, with edits over the budget, once no candidate can keep to
    its own.
    """
    m, offsets = len(items), np.arange(width, dtype=np.int64)
    sizes = np.array([len(x) for x in items])
    padded = np.zeros((m, sizes.max()), dtype=np.uint32)
    for i, x in enumerate(items):
        padded[i, : len(x)] = x
    far = np.int64(1 << 20) * _STEP
    column = low[:, None] + offsets  # text position at row 0
    inside = (column >= 0) & (column <= len(text))
    cells = np.where(inside, np.clip(column, 0, len(text)), far)
    ramp = offsets * _STEP
    best, start, end = budgets + 1, np.zeros(m, np.int64), np.zeros(m, np.int64)
    for row in range(1, sizes.max() + 1):
        if row % 64 == 0 and (cells.min(axis=1) // _STEP > budgets)[sizes >= row].all():
            break
        column = column + 1
        inside = (column >= 1) & (column <= len(text))
        char = text[np.clip(column - 1, 0, len(text) - 1)]
        same = np.where(inside & (char == padded[:, row - 1 : row]), cells, np.where(inside, cells + _STEP, far))
        gap = np.full_like(cells, far)
        gap[:, :-1] = cells[:, 1:] + _STEP
        gap = np.where((column >= 0) & (column <= len(text)), gap, far)
        cells = np.minimum(same, gap)
        cells = np.where(inside | (column == 0), np.minimum.accumulate(cells - ramp, axis=1) + ramp, far)
        if (done := sizes == row).any():
            which = np.argmin(cells[done], axis=1)
            value = cells[done][np.arange(len(which)), which]
            best[done], start[done], end[done] = value // _STEP, value % _STEP, column[done][np.arange(len(which)), which]
    return best, start, end


def find_in(index: Index, texts: Sequence[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of every item found; overlapping finds of one item once."""
    parts, places, owners, at = [], [], [], 0
    for t in texts:
        codes, pos = normalise(t)
        parts += [codes, np.zeros(1, np.uint32)]  # a code that no item has keeps texts apart
        places.append(pos)
        owners.append(at)
        at += len(codes) + 1
    if not parts or not index.ids:
        return []
    codes, owners = np.concatenate(parts), np.array(owners)
    item, band = index.candidates(codes)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    order = np.argsort(index.edits[item], kind="stable")
    item, band = item[order], band[order]
    at = 0
    while at < len(item):
        # The budget that is 256 places on bounds the width of all before it.
        widest = 4 * (int(index.edits[item[min(at + 255, len(item) - 1)]]) + 1)
        many = max(1, min(256, CELLS // widest))
        some, bands = item[at : at + many], band[at : at + many]
        at += many
        step = index.edits[some] + 1
        low = bands * step - step
        best, start, end = align([index.codes[i] for i in some], codes, low, int(4 * step.max()), index.edits[some])
        for i, cost, a, b in zip(some, best, start, end, strict=True):
            if cost <= index.edits[i] and b > a:
                text = int(np.searchsorted(owners, a, side="right") - 1)
                found.setdefault((text, int(i)), []).append((int(cost), int(a), int(b)))
    rows = []
    for (text, i), hits in found.items():
        kept: list[tuple[int, int, int]] = []
        for cost, a, b in sorted(hits):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((cost, a, b))
                pos, base = places[text], owners[text]
                rows.append((text, i, int(pos[a - base]), int(pos[min(b - base, len(pos)) - 1]) + 1, cost))
    return sorted(rows)


def distinct_items(benchmark: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, members): the distinct texts (key, text, item_id, copies) and which items have each (key, item_id), so
    that a text that many items repeat is collected and looked for once."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col("item_id").cast("long"), F.col(text_col).alias("text"))
    texts = items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()), "items")
    repeated = texts.where("copies > 1").select("text", "key")
    return texts, materialise(items.join(repeated, "text").select("key", "item_id"), "members")


def benchmark_blocks(texts: DataFrame) -> Iterator[list[tuple[tuple[int, int | None, int], str]]]:
    """((key, item_id, copies), text) of distinct texts in blocks of about BLOCK_CHARS characters, at least one block."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        yield [((r["key"], r["item_id"], r["copies"]), r["text"]) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("text").collect()]


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, Sequence[str]]]:
    """(number of the first, texts) of about CHUNK_CHARS characters at a time."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_CHARS or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_chars): every benchmark item found in every whole text.

    Case, punctuation and runs of blanks do not count. start and end are code points of the original text. Items of any
    length are found as a whole within their whole budget; a comparison costs the square of an item's length.
    Null and empty texts hold nothing; items of fewer than Q letters and blanks are never found; repeated documents and
    items are found each; a null item_id stays null. The distinct items are collected in blocks of about BLOCK_CHARS
    characters and each block is one pass over the texts without a shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    schema = "doc_id long, key long, item_id long, copies long, start long, end long, edits int, item_chars int"
    items, members = distinct_items(benchmark, text_col)
    out, repeated = None, False
    for rows in benchmark_blocks(items):
        repeated = repeated or any(copies > 1 for (_, _, copies), _ in rows)

        def search(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            index = Index(rows)
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), [t or "" for t in batch["text"]]
                made = [(ids[first + d], *index.ids[k], s, e, c, len(index.codes[k])) for first, some in chunks(texts) for d, k, s, e, c in find_in(index, some)]
                yield pd.DataFrame(made, columns=["doc_id", "key", "item_id", "copies", "start", "end", "edits", "item_chars"]).astype({"item_id": "Int64", "doc_id": "Int64"})

        part = texts.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    columns = ["doc_id", "item_id", "start", "end", "edits", "item_chars"]
    if not repeated:
        return out.select(columns)
    found = materialise(out, "found")
    several = found.where("copies > 1").drop("item_id").join(members, "key")
    return found.where("copies = 1").select(columns).unionByName(several.select(columns))


def holds_item(rows: list[tuple[object, str]]):
    """A column function: whether a text holds one of the items. A worker builds the index once per task."""
    ready: list[Index] = []

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Index(rows))
        out = np.zeros(len(texts), dtype=bool)
        for first, some in chunks([t or "" for t in texts]):
            out[[first + d for d, *_ in find_in(ready[0], some)]] = True
        return pd.Series(out)

    return holds


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; nothing is shuffled."""
    items, _ = distinct_items(benchmark)
    for rows in benchmark_blocks(items):
        docs = docs.where(~holds_item(rows)("text"))
    return docs
