"""Periodic runs: stretches of words that repeat with a period at least three times, found by seeds on diagonals.

Two places that are a lag apart lie on that lag's diagonal. A run of period q and length max(24, 3q) or more has at
least max(16, 2q) matching places on the diagonal of lag q, so some k-gram of each k up to that starts there and once
more q words on. Periods up to 16 are looked for with k = 16, those in (k / 2, k] with k = 32, 64, ...: k is then at
most the guaranteed overlap and at least the period, so the next occurrence of the run's first k-gram is exactly one
smallest period on. Only such neighbouring occurrences have to be enumerated, at most n for each k. k-grams are indexed
exactly, by doubling: a 2k-gram is the pair of two k-grams, and places whose k-gram occurs once leave the index.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words, and least number of periods in it.
LEAST_WORDS = 24
LEAST_PERIODS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, words long, dropped long"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of ``a`` and ``b``, equally long, agree; looks at chunks that double."""
    at, size = 0, 64
    while at < len(a):
        differ = a[at : at + size] != b[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, min(size * 2, 1 << 20)
    return len(a)


def _stretches(codes: np.ndarray, places: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, end, lag) of the longest matching stretch around each seed: ``codes[i] == codes[i + lag]`` in it.

    Seeds are taken lag by lag from left to right; how far a lag is covered lets the seeds inside go unextended.
    """
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    bounds = [*np.flatnonzero(np.diff(lags, prepend=-1)).tolist(), len(lags)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        lag, own, at = int(lags[lo]), places[lo:hi], 0
        while at < len(own):
            seed = int(own[at])
            end = seed + _common(codes[seed:-lag], codes[seed + lag :])
            first = seed - _common(codes[:seed][::-1], codes[lag : seed + lag][::-1])
            yield first, end, lag
            at = int(np.searchsorted(own, end))  # the furthest place that this lag covers


def find_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of ``codes`` by start, then period: longest stretches whose smallest period is q and whose length is at
    least ``least_words`` and ``least_periods`` (3 or more) times q. Linear up to logarithms in their number."""
    n, out = len(codes), []
    if n < least_words:
        return out
    # The least of max(least_words, least_periods * q) - q over q: what any run matches with itself one period on.
    overlap = max(1, least_words - -(-least_words // least_periods))
    places, rank, k = np.arange(n), codes.astype(np.int64), 1
    narrow = 1 << (overlap.bit_length() - 1)  # the shortest k-gram that seeds; a power of two up to the overlap
    while True:
        if k >= narrow:
            order = np.argsort(rank[places], kind="stable")
            at = places[order]
            same = rank[at[1:]] == rank[at[:-1]]
            seeds, lags = at[:-1][same], np.diff(at)[same]
            fits = (lags <= k) & ((lags > k // 2) | (k == narrow))
            for first, end, lag in _stretches(codes, seeds[fits], lags[fits]):
                length = end - first + lag
                if length >= max(least_words, least_periods * lag):
                    out.append((first, length, lag))
        # 2k-grams from pairs of k-grams, for places whose both halves occur more than once.
        counts = np.bincount(rank[places])
        often = np.zeros(n + 1, dtype=bool)
        often[places] = counts[rank[places]] > 1
        places = places[often[places] & often[np.minimum(places + k, n)]]
        if len(places) < 2 or (k >= narrow and least_periods * k > n):
            return sorted(out, key=lambda r: (r[0], r[2]))
        _, named = np.unique(rank[places] * (n + 1) + rank[places + k], return_inverse=True)
        rank = np.zeros(n, dtype=np.int64)
        rank[places], k = named, 2 * k


def word_codes(words: list[str]) -> np.ndarray:
    """A number below the count of words for each, equal for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a repeat planted in one of ten documents, by the checksum of the id; none where the id is null."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _strongest(runs: list[Run]) -> Run | None:
    """The run of most periods, compared exactly; ties go to the smaller start, then the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(docs: DataFrame, plant: bool = False, with_text: bool = True) -> DataFrame:
    """The runs of every whole text and the text without their repeats.

    One row for each row of (doc_id, text), whatever repeats; other columns are not looked at. A null text has no
    words, a null doc_id stays null. ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the run of
    most periods (all null without runs); digests of the list of runs and of the kept words joined by one blank; the
    counts of words and of dropped ones. ``with_text`` adds the list of ``runs`` and the ``collapsed`` text itself.
    ``plant`` first puts repeats into one of ten documents, as a check of recall.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if key is None else int(key)
                words = WORD.findall(text or "")
                if plant:
                    words = planted(words, doc_id)
                runs = find_runs(word_codes(words))
                kept = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep] if runs else words
                collapsed = " ".join(kept)
                top = _strongest(runs)
                said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, collapsed)]
                row = (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests, len(words), len(words) - len(kept))
                rows.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed) if with_text else row)
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype(dict.fromkeys(("doc_id", "start", "length", "period", "exponent_milli"), "Int64"))

    schema = SCHEMA + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_text else "")
    columns = [c.split()[0] for c in SCHEMA.split(", ")] + (["runs", "collapsed"] if with_text else [])
    # The id as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(scan, schema)
