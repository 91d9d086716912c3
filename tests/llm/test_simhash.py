"""SimHash links against all pairs, fingerprints against a plain version."""

import random
import re

import pytest
import xxhash

from mnemoframe.llm import simhash
from mnemoframe.llm.common import connected_components

DOC = "doc_id long, text string, component_id string"


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, limit):
    """Smallest index reachable, by all pairs."""
    top = list(range(len(values)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= limit:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_near_duplicates_match_all_pairs(spark, sf):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(80).collect()]
    texts += [None, "", " \t\n", "One", "one two", "É É É É", "a\u00a0b c d", "é" * 50_000, texts[3], texts[3].upper()]
    long = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    for _ in range(40):
        copy = list(long)
        copy[rng.randrange(900)] = "changed"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps, 2)
    out = {r.doc_id: r for r in simhash.near_duplicates(df).select("doc_id", simhash.fingerprint_text("fp").alias("f"), "component_id").collect()}
    assert {i: r.f for i, r in out.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert [out[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 30


@pytest.mark.parametrize(("limit", "paired"), [(2, 64), (2, 1), (4, 64), (4, 1)])
def test_links_lose_nothing(spark, monkeypatch, limit, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(limit * 100 + paired)
    values = set()
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(6):
            values.add(value)
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), limit)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components([v & (1 << 64) - 1 for v in values], limit)
    assert [got.get(v, v) for v in values] == [values[w] for w in want]


def test_no_rows_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    out = simhash.near_duplicates(spark.createDataFrame([(7, "a b c d", "x")] * 3 + [(None, "a b c d", "x")], DOC)).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(out, key=lambda r: r.doc_id or 0)] == [(None, 7), (7, 7), (7, 7), (7, 7)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 40)] + [(3, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(10, 40)}


def plain_groups(texts, similarity, k=5):
    """Groups over all pairs of whole shingle sets, as the least index reachable."""
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def test_large_groups_whose_copies_are_unlike_each_other(spark):
    """Copies link only through their original, which has the greatest id, and through copies of copies."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    original, passage = fresh(400), fresh(120)
    copies = [edited(rng, original, 7) for _ in range(150)]
    further = [edited(rng, copies[i], 7) for i in range(20)]
    sharing = [fresh(60) + passage + fresh(60) for _ in range(100)]
    again = [edited(rng, sharing[i], 2) for i in range(10)]
    short = [passage[:50] + fresh(9) for _ in range(80)]
    texts = [" ".join(w) for w in copies + further + sharing + again + short + [original]]
    want = plain_groups(texts, 0.8)
    assert want[-1] == 0 and len({want[i] for i in range(170)}) == 1
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_texts_of_one_repeated_line_are_not_alike(spark):
    """One line repeated gives all texts the same fingerprint; only those that share the rest are near-duplicates."""
    rng = random.Random(3)
    line = [f"w{rng.randrange(10**9)}" for _ in range(9)]
    rest = [[f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 150))] for _ in range(12)]
    rest += [edited(rng, rest[i], 1) for i in range(4)]
    texts = [" ".join(line * rng.randint(60, 100) + r) for r in rest]
    fps = [plain_fingerprint(t, 5) for t in texts]
    assert max(bin(a ^ b).count("1") for a in fps for b in fps) <= 2
    want = plain_groups(texts, 0.8)
    assert want == [*range(12), *range(4)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_truncated_copies_of_crowded_sections(spark):
    """Texts put together from common sections, and their first four fifths: what a pair shares, many others have."""
    rng = random.Random(8)
    sections = [[f"w{rng.randrange(10**9)}" for _ in range(150)] for _ in range(16)]
    picks = []
    while len(picks) < 120:
        pick = rng.sample(range(16), 6)
        if all(len(set(pick) & set(p)) < 5 for p in picks):
            picks.append(pick)
    whole = [[w for i in p for w in sections[i]] for p in picks]
    texts = [" ".join(w) for w in whole] + [" ".join(w[: 4 + -(-(len(w) - 4) * 4 // 5)]) for w in whole]
    want = plain_groups(texts, 0.8)
    assert all(want[i] == want[i + 120] for i in range(120)) and len(set(want)) > 100
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    assert sum(got[i] != w for i, w in enumerate(want)) == 0


def test_keep_first_tells_rows_apart_by_id_and_text(spark):
    rng = random.Random(9)
    a, b = ([f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(2))
    near = " ".join(edited(rng, a, 1))
    rows = [(1, " ".join(a), "x"), (1, " ".join(b), "x"), (1, " ".join(a), "x"), (2, near, "y"), (3, " ".join(b), "y"), (None, near, "z"), (None, near, "z"), (4, None, "n"), (5, "", "n"), (5, "", "n")]
    out = simhash.keep_first(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(0, near), (0, near), (1, " ".join(a)), (1, " ".join(b)), (4, "")])
    assert out[0].__fields__ == ["doc_id", "text", "component_id"]


def test_a_large_group_of_near_copies(spark):
    """5,000 copies that are alike to their original and mostly not to each other: one group, without pairs of them."""
    rng = random.Random(12)
    original = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    texts = [" ".join(edited(rng, original, 5)) for _ in range(5000)] + [" ".join(original)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    compared = []
    plain = simhash.cross_pairs
    simhash.cross_pairs = lambda *a: compared.append(out := plain(*a)) or out
    try:
        groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
        assert set(groups.values()) == {0} and sum(c.count() for c in compared) < 5000
    finally:
        simhash.cross_pairs = plain
