"""WARC round trip, record checks, and the URL filter against a plain version."""

import hashlib
import struct
import uuid

import pytest
import zstandard

from mnemoframe.llm import queries, urls, warc
from mnemoframe.llm.common import shared_dir

PAGE = "page_id long, url string, html string, refers_to string"


def plain(rows):
    last = {}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            last[data] = max(last.get(data, page_id), page_id)
    out = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        top = last.get(data)
        revisit = top is not None and (page_id is None or page_id < top)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html, "x") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(10**6 + i, "http://a/é\r\n%0A", "é" * 500 if i % 2 else "x" * 999, "x") for i in range(6)]
    rows += [(2 * 10**6, None, None, "x"), (None, "u", "z" * 2000, "x"), (2 * 10**6 + 1, "u", "y" * 300_000, "x"), (2 * 10**6 + 2, "u", "", "x")]
    rows += [(3 * 10**6, "u", "q" * 1500, "x")] * 2 + [(3 * 10**6 - 1, "v", "q" * 1500, "x")]
    df = spark.createDataFrame(rows, PAGE)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == plain(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r.url == by_id[r.page_id][1]
        assert r.record_type == "revisit" or bytes(r.payload).decode() == (by_id[r.page_id][2] or "")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_small_files_all_lead_with_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 7)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 50) as html"), path)
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert len(files) > 7 and all(struct.unpack_from("<I", f.content)[0] == warc.DICTIONARY for f in files)
    assert warc.read_archives(spark, path).select("page_id").distinct().count() == 50


def archive(*records, dictionary=b"dictionary " * 20):
    packed = zstandard.ZstdCompressor().compress(dictionary)
    data = zstandard.ZstdCompressionDict(dictionary)
    frames = b"".join(zstandard.ZstdCompressor(dict_data=data, write_checksum=True).compress(r) for r in records)
    return struct.pack("<II", warc.DICTIONARY, len(packed)) + packed + frames


def good(payload=b"p" * 100):
    return warc.build_record(4, "http://u", payload, hashlib.sha1(payload).hexdigest(), None)


def test_reader_takes_compressed_dictionaries_and_checksums():
    assert [r.page_id for r in warc.read_archive(archive(good(), good(b"")))] == [4, 4]


@pytest.mark.parametrize(
    "data",
    [
        archive(good()[:-1]),
        archive(good().replace(b"WARC/1.1", b"WARD/1.1")),
        archive(good().replace(b"WARC-Date", b"WARC-Dote")),
        archive(good().replace(b"ppp", b"pqp", 1)),
        archive(good().replace(b"Type: response", b"Type: revisit")),
        archive(good())[:-3],
        archive(good()) + b"junkjunk",
        archive(good())[9:],
    ],
)
def test_reader_rejects_damage(data):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(data))


RULES = queries.URL_RULES


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail.split("#")[0].split("?")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if url in listed else "allow"


def test_urls_match_plain_version(spark):
    cases = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/71?x#y", "http://xexample.com/en/7", "http://net/de/8", "http://example.net/de/81", "http://a.b.org/es/", "https://x.org?q=/es/", "http://e.org#a", "http://É.NET/de/", "a://b://c/d", "http://bad.example.org/x/?ref=1&utm_source=2", "http://bad.example.org/x", "http://bad.example.org/x?b=2&a=1", "http://bad.example.org/x?a=1&b=2#f", "http://fine.example.org/x\ny"]
    listed = {"http://bad.example.org/x/?ref=1&utm_source=2", "http://bad.example.org/x", "http://bad.example.org/x?b=2&a=1", "http://bad.example.org/x?a=1&b=2#f"}
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    block = spark.createDataFrame([("bad.example.org/x",), ("bad.example.org/x?a=1&b=2",), (None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, block, RULES).collect()}
    assert got == {i: plain_verdict(u, listed) for i, u in enumerate(cases)}


def test_bloom_keeps_every_listed_url_and_few_others(spark):
    listed = spark.range(4000).selectExpr("concat('h/', id) as canonical")
    probe = spark.range(20_000).selectExpr("concat('h/', id) as canonical")
    assert urls.listed_urls(probe, listed).count() == 4000
    blocks = 4000 * urls.BITS_PER_KEY // 512
    bloom = {r.block: r for r in urls.bloom_table(listed, "canonical", blocks).collect()}
    passed = sum(r.block in bloom and all(bloom[r.block][f"w{j}"] & r[f"m{j}"] == r[f"m{j}"] for j in range(8)) for r in urls._hashed(probe.where("true"), "canonical", blocks).collect())
    assert 4000 <= passed <= 4000 + 16_000 * 0.02
    assert urls.listed_urls(probe, listed.where("false")).count() == 0


def test_revisits_of_pages_without_an_id(spark):
    """Pages without an id revisit the one with the largest; equal largest ids are responses all; without any id all are."""
    same, other = "x" * 1000, "y" * 1000
    rows = [(5, same), (None, same), (3, same), (5, same), (None, other), (None, other), (1, "x" * 999), (2, "x" * 999)]
    pages = spark.createDataFrame([(i, None, h, "c") for i, h in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    want = [(0, 1000, "response", 0), (0, 1000, "response", 0), (0, 1000, "revisit", 5), (1, 999, "response", 0), (2, 999, "response", 0), (3, 1000, "revisit", 5), (5, 1000, "response", 0), (5, 1000, "response", 0)]
    assert got == want


def test_large_pages_make_small_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * (20_000 + i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    assert len([f for f in (tmp_path / "a").glob("part*")]) >= 10
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 40


def test_a_list_that_is_too_large_to_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.fr/p{i % 50}", "z") for i in range(600)] + [(600 + i, "http://bad.fr/x", "z") for i in range(300)] + [(None, None, "z")], "page_id long, url string, listed string")
    block = spark.createDataFrame([("bad.fr/x",), ("h3.fr/p3",), ("bad.fr/x",), ("",)], "canonical string")
    rows = lambda: sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_urls(pages, block, RULES).collect())
    small = rows()
    assert sum(r[4] == "block" for r in small) == 300 + len({i for i in range(600) if i % 7 == 3 and i % 50 == 3})
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert rows() == small and len(small) == 901
