"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokens are cut into pieces, then every task packs its share of the pieces online into a fixed number of open
bins. A bitset (one integer) has bit f set when an open bin has f tokens free; best fit is the lowest set bit
at or above the piece's length. When a new bin is needed and all are in use, the fullest one closes first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 1024
END = 2
OPEN_BINS = 8192
#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE = 200_000
#: White space in a row from which on a text goes to the tokenizer itself: the other encoder's pattern recurses there.
LONG_SPACE = re.compile(r"\s{2000}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordCache(dict):
    """Text between blanks (with its leading blank) to its ids as little-endian 32-bit bytes."""

    def __init__(self, encode: Callable[[str], list[int]], limit: int = CACHE):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = np.asarray(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= 40:
            self[word] = ids
        return ids


_ENCODERS: dict[tuple[str, bool], Callable[[str], bytes]] = {}


def encoder(name: str = "byte_bpe_50k", remember: bool = True) -> Callable[[str], bytes]:
    """Text to ids (as bytes), equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of ``<name>.json``.

    A single blank between two other characters always begins a new pre-token, so the words between single
    blanks are encoded on their own and remembered, unless ``remember`` is false, which suits texts of many different
    words. Texts with other runs of blanks are encoded whole, those that name a special token or hold a very long run of
    white space by the tokenizer itself.
    """
    if (name, remember) in _ENCODERS:
        return _ENCODERS[name, remember]
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path, full = public_tokenizers.path(f"{name}.json"), []
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = WordCache(plain.encode_ordinary)

    def encode(text: str) -> bytes:
        if any(s in text for s in special) or LONG_SPACE.search(text):
            if not full:  # seldom needed and large
                full.append(Tokenizer.from_file(path))
            return np.asarray(full[0].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not remember:
            return np.asarray(plain.encode_ordinary(text), dtype="<u4").tobytes()
        parts = text.split(" ")
        # An empty part is a double blank; a part that starts or ends with white space is a mixed run.
        if not all(parts) or any(p[0].isspace() or p[-1].isspace() for p in parts):
            return np.asarray(plain.encode_ordinary(text), dtype="<u4").tobytes()
        return words[parts[0]] + b"".join([words[" " + p] for p in parts[1:]])

    _ENCODERS[name, remember] = encode
    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but the first holds what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of every whole text (null: empty), with their ids unless only lengths and checksums are needed."""
    tail = np.asarray([end], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + tail
                for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * s : 4 * (s + n)]
                    rows.append((key, i, s, n, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype("i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pieces, PIECES + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Bounded-space best fit: at most ``limit`` open bins, found by their free space through a bitset."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.bits >> length
        if fitting:
            space = length + ((fitting & -fitting).bit_length() - 1)
            which = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
            space, which = self.capacity, self.made
            self.made += 1
        if left := space - length:
            self.free[left].append(which)
            self.bits |= 1 << left
            self.open += 1
        return which, self.capacity - space

    def _take(self, space: int) -> int:
        which = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return which


def plan_packing(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces.

    The pieces (without their ids) are dealt evenly and sorted by length, longest first, inside each task, so
    that online best fit also has the small ones to fill up with; a task keeps only its open bins in memory.
    Sequence ids are the task's number in the upper bits and its own count in the lower 40.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            put = [bins.put(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = batch["task"] * (1 << 40) + [w for w, _ in put]
            batch["offset"] = [o for _, o in put]
            yield batch.drop(columns="task")

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    # Dealt by all columns and a row number, so that rows of one or of no doc_id do not meet in one task.
    numbered = pieces.withColumn("deal", F.xxhash64(*pieces.columns, F.monotonically_increasing_id()))
    dealt = numbered.repartition("deal").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "deal").drop("deal")
    return dealt.withColumn("task", F.spark_partition_id().cast("long")).mapInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Where every piece of every document goes, with its checksum: the packing without the tokens.

    Null and empty texts are one piece of the end token; repeated rows are packed each. The pieces are written
    to the shared folder first, so a task that runs again packs the same rows.
    """
    return plan_packing(materialise(tokenize_pieces(docs, capacity, with_ids=False), "pieces"), capacity, open_bins)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """The sequences themselves: (sequence_id, input_ids, doc_ids of the pieces in order). At most ``capacity`` ids a row."""
    plan = pack_documents(docs, capacity, open_bins).select("doc_id", "piece", "sequence_id", "offset", "ids_crc32").dropDuplicates(["sequence_id", "offset"])
    ids = tokenize_pieces(docs, capacity).dropDuplicates(["doc_id", "piece", "ids_crc32"])
    part = F.struct("offset", "ids", "doc_id")
    grouped = plan.join(ids, ["doc_id", "piece", "ids_crc32"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.doc_id").alias("doc_ids"))
