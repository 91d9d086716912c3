"""Periodic runs against a plain scan of all periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from mnemoframe.llm import queries, runs

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(words, least=24, periods=3):
    out = set()
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    digests = ["".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)]
    return (doc_id, len(found), *top, top[1] * 1000 // top[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def made(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(4)):
        period = [rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(1, 40))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (period * rng.randrange(2, 6))[: rng.randrange(200)]
    return words


def test_runs_are_those_of_a_plain_scan():
    rng, some = random.Random(3), 0
    for _ in range(800):
        words = made(rng)
        expected = plain_runs(words)
        some += len(expected)
        assert runs.find_runs(runs.word_codes([str(w) for w in words])) == expected
    assert some > 400


@pytest.mark.parametrize(("least", "periods"), [(1, 3), (9, 3), (30, 3), (24, 5), (100, 4)])
def test_other_thresholds(least, periods):
    rng = random.Random(least)
    for _ in range(150):
        words = made(rng)
        assert runs.find_runs(runs.word_codes([str(w) for w in words]), least, periods) == plain_runs(words, least, periods)


def test_the_thresholds_themselves():
    for q in (1, 5, 7, 8, 9, 16, 17, 33):
        period = [f"w{i}" for i in range(q)]
        needed = max(24, 3 * q)
        words = ["x", *(period * 30)[:needed], "y"]
        assert runs.find_runs(runs.word_codes(words)) == [(1, needed, q)]
        assert runs.find_runs(runs.word_codes(words[:needed])) == []


def test_a_period_that_repeats_inside_itself():
    inner = [f"a{i}" for i in range(20)] * 2
    words = (inner + ["b"]) * 4
    assert runs.find_runs(runs.word_codes(words)) == plain_runs(words) == [(0, 164, 41)]


def test_long_texts_take_no_quadratic_time():
    first, second = ["a"], ["a", "b"]
    while len(second) < 200_000:
        first, second = second, second + first
    start = time.time()
    assert runs.find_runs(np.zeros(400_000, dtype=np.int64)) == [(0, 400_000, 1)]
    assert len(runs.find_runs(runs.word_codes(second))) > 1000
    assert time.time() - start < 20


def test_whole_query_against_a_plain_version(spark, sf):
    expected = [plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_runs(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and any(r[1] for r in got)


def test_odd_rows(spark):
    rows = [(None, "a " * 30), (1, None), (1, None), (2, ""), (3, " \t\r\n"), (4, "x y\x1c " * 30), (5, "é　 b\x0bc\x0c" * 50), (6, "a b " * 12 + "z " * 24)]
    df = spark.createDataFrame([(*r, i, "u") for i, r in enumerate(rows)], "doc_id long, text string, n_runs int, words string")
    got = [tuple(r[c] for c in COLUMNS) for r in runs.collapse_runs(df, plant=True).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_the_text_without_repeats(spark):
    df = spark.createDataFrame([(1, "say " + "la la lo " * 20 + "end")], "doc_id long, text string")
    row = runs.collapse_runs(df).first()
    assert row.collapsed == "say la la lo end" and [tuple(r) for r in row.runs] == [(1, 60, 3)] and (row.words, row.dropped) == (62, 57)
