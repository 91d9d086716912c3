"""Token ids in ORC: whole texts encoded, written in ascending doc_id order, read back by stripes.

A document is one or more rows of at most PIECE ids, so no batch of a reader or writer grows with the longest text.
ORC stores the ids in its integer run-length encoding, in stripes that are read by themselves; every stripe has row
indexes and a Bloom filter of document ids, so a look-up reads only the row groups that may hold an id.

Documents are dealt by ranges of their id before they are encoded: the encoder runs once a text, the shuffle moves
text, and each write task sees its documents in order and counts ids as it goes. Where a document starts among all ids
is its place in its task's part plus the ids of all parts before, one number for each write task.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .packing import encoder

END = 0
#: Ids in a row of a file.
PIECE = 2048
#: Rows of a row group, ORC's least; bytes of a stripe before compression; share of false hits of the Bloom filters.
ROW_GROUP = 1000
STRIPE_BYTES = 32 << 20
FALSE_HITS = 0.01
#: Rows after which the writer looks whether a stripe is full: about a megabyte of ids.
STRIPE_CHECK = 250
#: Ids that the encoder collects before it hands them on.
BATCH_IDS = 1 << 20

PIECES = "part int, doc long, doc_id long, piece int, start long, length int, ids array<int>"
PARTIAL = "part int, doc long, doc_id long, piece int, start long, n long, crc long"


def _pieces(batches: Iterable[pa.RecordBatch], tokenizer: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES with at most ``most`` ids for (part, doc_id, text) rows that come in order."""
    encode, tail = encoder(tokenizer, remember=False), np.asarray([end], dtype="<u4").tobytes()
    rows: list[tuple] = []
    held: list[bytes] = []
    doc = start = size = 0

    def batch() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int32)
        part, number, doc_id, piece, first, length = zip(*rows, strict=True)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(ids))
        columns = [pa.array(part, pa.int32()), pa.array(number, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(length, pa.int32()), lists]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    for texts in batches:
        for part, doc_id, text in zip(*(texts[c].to_pylist() for c in ("part", "doc_id", "text")), strict=True):
            ids = encode(text) + tail
            for piece, at in enumerate(range(0, len(ids), 4 * most)):
                cut = ids[at : at + 4 * most]
                rows.append((part, doc, doc_id, piece, start, len(cut) // 4))
                held.append(cut)
                start, size = start + len(cut) // 4, size + len(cut) // 4
                if size >= BATCH_IDS:
                    yield batch()
                    rows, held, size = [], [], 0
            doc += 1
    if rows:
        yield batch()


def write_tokens(docs: DataFrame, path: str, end: int = END, piece: int = PIECE, stripe_bytes: int = STRIPE_BYTES, tokenizer: str = "byte_bpe_50k") -> None:
    """Write the ids of every row of (doc_id, text) and ``end`` after each text as ORC files under ``path``.

    Ids ascend over the files in the order of their part numbers; rows without a doc_id come first, rows of one doc_id
    in the order of their text's hash, equal rows are written each. A null or empty text is ``end`` alone. Other
    columns are not looked at. Rows of one doc_id may be any share of the table: they are dealt by hash and row as well.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    pieces = dealt.mapInArrow(lambda batches: _pieces(batches, tokenizer, end, piece), PIECES)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_HITS, "orc.row.index.stride": ROW_GROUP, "orc.stripe.size": stripe_bytes, "orc.rows.between.memory.checks": STRIPE_CHECK}
    pieces.write.options(**options).orc(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Rows of PIECES with ``start`` counted over all files. Filters on doc_id reach stripes and row groups."""
    rows = spark.read.schema(PIECES).orc(path)
    parts = rows.groupBy("part").agg(F.sum("length").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each write task.
    offsets = F.broadcast(parts.select("part", before.alias("before")))
    return rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("before")).select(*[c.split()[0] for c in PIECES.split(", ")])


def look_up(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, piece, ids) of some documents: equality filters that ORC answers from its Bloom filters and indexes."""
    return spark.read.schema(PIECES).orc(path).where(F.col("doc_id").isin(*map(int, doc_ids))).select("doc_id", "doc", "piece", "ids")


def joined_crc(parts: Iterable[tuple[int, int]]) -> int:
    """The checksum of byte strings put together, from each one's (number of bytes, crc32).

    crc32 is affine: what a prefix changes is what it changes in front of as many zero bytes.
    """
    crc, zeros = 0, bytes(1 << 16)
    for size, own in parts:
        with_prefix, without = crc, 0
        for at in range(0, size, len(zeros)):
            some = zeros[: size - at]
            with_prefix, without = zlib.crc32(some, with_prefix), zlib.crc32(some, without)
        crc = with_prefix ^ without ^ own
    return crc


def _partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of a document's pieces that a task reads one after another."""
    open_row: list | None = None
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out, ids = [], batch["ids"]
        values, bounds = ids.values.to_numpy(zero_copy_only=True), ids.offsets.to_numpy()
        for i, (part, doc, doc_id, piece, start) in enumerate(zip(*(batch[c].to_pylist() for c in ("part", "doc", "doc_id", "piece", "start")), strict=True)):
            data = values[bounds[i] : bounds[i + 1]].astype("<u4").tobytes()
            if open_row and open_row[:2] == [part, doc] and open_row[-1] == piece:
                open_row[5:] = open_row[5] + len(data) // 4, zlib.crc32(data, open_row[6]), piece + 1
            else:
                if open_row:
                    out.append(open_row[:-1])
                open_row = [part, doc, doc_id, piece, start, len(data) // 4, zlib.crc32(data), piece + 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if open_row:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_row[:-1], types, strict=True)], names=names)


def _joined(parts: Column) -> Column:
    @F.pandas_udf("long")
    def join(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: joined_crc((4 * r["n"], r["crc"]) for r in rows))

    return join(parts)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``.

    Tasks read stripes on their own and check what they read; a document that stripes divide is put together from the
    checksums of its parts, so the ids themselves are never shuffled.
    """
    partial = read_pieces(spark, path).select("part", "doc", "doc_id", "piece", "start", "ids").mapInArrow(_partials, PARTIAL)
    parts = F.array_sort(F.collect_list(F.struct("piece", "n", "crc")))
    docs = partial.groupBy("part", "doc", "doc_id").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), parts.alias("parts"))
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(_joined(F.col("parts")))
    return docs.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_documents(spark, path)
