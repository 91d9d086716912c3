"""WARC archives in Zstandard: writer with revisit records, and a reader that checks every record.

An archive is a leading skippable frame with the dictionary, then one frame per record. Tasks only produce the
frames; Spark's text sink writes them (a row's bytes and, as line separator, an empty skippable frame), so the
commit protocol of the file system applies and a task that runs again leaves no half-written archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Fixed values of the formats: magic numbers of Zstandard frames, skippable frames and dictionary frames.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE = 0x184D2A50
DICTIONARY = 0x184D2A5D
#: An empty skippable frame; its bytes are ASCII, as a line separator has to be.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
DICT_BYTES = 32 << 10
DICT_SAMPLES = 256
DICT_SAMPLE_CHARS = 16 << 10
#: Rows of an archive file, its dictionary frame included, and bytes of payload in one, about.
FILE_ROWS = 2000
FILE_BYTES = 128 << 20
#: Repeated payloads up to which their list is broadcast.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes | None


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    if not name.startswith("<urn:page:") or name[-1] != ">":
        raise ValueError(f"not a record id: {name!r}")
    return int(name[10:-1]) if name[10:-1] else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, which states the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes, first: str) -> dict[str, str]:
    lines = text.decode().split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"expected {first}, found {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[key.strip().lower()] = value.strip(" ")
    return out


def parse_record(data: bytes) -> Record:
    """The record in ``data``; raises ValueError where headers, lengths or digests do not agree."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    head = _headers(data[:end], "WARC/1.1")
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if k not in head]:
        raise ValueError(f"missing headers: {missing}")
    block = data[end + 4 : -4]
    if data[-4:] != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise ValueError(f"content-length {head['content-length']}, block of {len(block)} bytes")
    http_end = block.find(b"\r\n\r\n")
    if http_end < 0:
        raise ValueError("no end of HTTP headers")
    size = int(_headers(block[:http_end], "HTTP/1.")["content-length"])
    payload, (algorithm, _, digest) = block[http_end + 4 :], head["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(digest) != 40:
        raise ValueError(f"unknown digest {head['warc-payload-digest']!r}")
    kind, refers = head["warc-type"], head.get("warc-refers-to")
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind != "revisit" or payload or refers is None or head.get("warc-profile") != PROFILE:
        raise ValueError(f"not a valid {kind} record")
    url = head.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return Record(_page_id(head["warc-record-id"]), url, size, digest, kind, None if refers is None else _page_id(refers), payload if kind == "response" else None)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("archive ends inside a frame")
    return at


def read_archive(content: bytes) -> Iterator[Record]:
    """All records of one archive. The dictionary frame has to come before the first record that needs it."""
    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("archive ends inside a frame")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if end > len(data):
                raise ValueError("archive ends inside a frame")
            if magic == DICTIONARY:
                raw = bytes(data[at + 8 : end])
                if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == ZSTD_MAGIC:
            end = frame_end(data, at)
            yield parse_record(reader.decompressobj().decompress(data[at:end]))
        else:
            raise ValueError(f"unknown frame {magic:#x} at {at}")
        at = end


def train_dictionary(pages: DataFrame, rows: int, html: str = "html", id_col: str = "page_id") -> bytes:
    """A dictionary from a bounded sample: at most DICT_SAMPLES pages by hash order, DICT_SAMPLE_CHARS of each.

    A filter on the id's hash leaves a few times as many of the ``rows``, so that tasks do not each send that many.
    """
    share = min(1.0, 4 * DICT_SAMPLES / max(1, rows))
    some = pages.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).where(F.length(html) > 0)
    sample = some.orderBy(F.xxhash64(id_col), F.xxhash64(html)).limit(DICT_SAMPLES)
    texts = [r[0].encode() for r in sample.select(F.substring(html, 1, DICT_SAMPLE_CHARS)).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b"".join(texts)[:DICT_BYTES].ljust(64, b" ")


def _digest() -> Column:
    return F.sha1(F.encode("html", "UTF-8"))


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(payload_digest, last): one row for each payload of at least LEAST_REVISIT bytes that several pages have, with
    their largest page_id. Only ids and digests are shuffled."""
    digests = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", _digest().alias("payload_digest"))
    return digests.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")


def write_archives(pages: DataFrame, path: str) -> None:
    """One record for each row of (page_id, url, html). A null html is an empty payload.

    Of equal payloads of at least LEAST_REVISIT bytes the row with the largest page_id is the response; rows with that
    same id and payload are responses all, those without an id revisit it, and if none has an id all are responses. A
    file holds FILE_ROWS records, or fewer where pages are large: about FILE_BYTES of payload by their mean.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    size = pages.agg(F.count("*").alias("rows"), F.sum(F.octet_length("html")).alias("bytes")).first()
    file_rows = max(2, min(FILE_ROWS, FILE_BYTES * size["rows"] // max(1, size["bytes"] or 0)))
    dictionary = train_dictionary(pages, size["rows"])
    lead = struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary
    repeated = materialise(repeated_payloads(pages), "repeated")
    # The list of repeated payloads is small beside the pages, so pages are shuffled only if it is not.
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    long_digest = F.when(F.octet_length("html") >= LEAST_REVISIT, F.col("digest"))
    keyed = pages.withColumn("digest", _digest()).withColumn("payload_digest", long_digest)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    typed = keyed.join(repeated, "payload_digest", "left").withColumn("refers_to", refers)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        rows = 0
        for batch in batches:
            out = []
            for page_id, url, html, digest, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"], strict=True):
                if rows % file_rows == 0:
                    out.append(lead)
                    rows += 1
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers)]
                out.append(writer.compress(build_record(ids[0], url, html.encode(), digest, ids[1])))
                rows += 1
            yield pd.DataFrame({"value": out})

    # Ids as strings: pandas would turn longs with nulls into doubles.
    narrow = typed.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    made = narrow.mapInPandas(frames, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", file_rows).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record under ``path``, checked; a record that is not valid fails the read with the archive's name."""
    columns = RECORD if with_payload else RECORD.rpartition(",")[0]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                try:
                    for r in read_archive(content):
                        rows.append(r if with_payload else r[:-1])
                        held += len(r.payload or b"") if with_payload else 0
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield _frame(rows, with_payload)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield _frame(rows, with_payload)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(records, columns)


def _frame(rows: list, with_payload: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=Record._fields if with_payload else Record._fields[:-1])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path, with_payload=False)
