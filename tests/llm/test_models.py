"""Licenses, decontamination, quality, personal data and nearest neighbours against plain versions or held-out rows."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import ann, leaks, licenses, pii, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)


# Licenses


def test_license_notices(spark):
    mit = licenses.TEMPLATES["MIT"]
    long = licenses.TEMPLATES["MIT-text"]
    edited = long.replace("charge, to any", "charge, hereby to every").replace("sublicense", "relicense")
    texts = ["prose " * 3000 + mit, f"{mit}\n{mit}", f"x {edited} y", None, "", "the license is unclear", "license " * 5000, licenses.TEMPLATES["Apache-2.0-header"]]
    found = {}
    for r in licenses.find_licenses(docs_of(spark, texts)).collect():
        found.setdefault(r.doc_id, []).append((r.license, texts[r.doc_id][r.start : r.end], r.coverage))
    assert [x[:2] for x in found[0]] == [("MIT", mit[:-1])]
    assert len(found[1]) == 2 and [x[0] for x in found[2]] == ["MIT-text"] and 0.8 < found[2][0][2] < 1
    assert [x[0] for x in found[7]] == ["Apache-2.0-header"] and set(found) == {0, 1, 2, 7}
    assert licenses.find_licenses(docs_of(spark, [])).count() == 0
    assert licenses.find_licenses(docs_of(spark, ["nothing"])).count() == 0


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(50):
        values = rng.sample(range(20), 8)
        got = licenses.increasing(list(enumerate(values)))
        assert all(a[1] < b[1] and a[0] < b[0] for a, b in zip(got, got[1:], strict=False))
        best = [1] * 8
        for i in range(8):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        assert len(got) == max(best)


# Decontamination


def plain_distance(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_match_all_alignments(spark, sf):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    filler = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    texts, planted = [], []
    for n, (key, item) in enumerate(items):
        for rate in (0.0, 0.05, 0.3):
            t = list(item)
            for _ in range(int(rate * len(item))):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["z"], [t[at], "q"]])
            planted.append((len(texts), key, rate))
            texts.append(f"{filler[n][:400]} {''.join(t)} {filler[-n][:300]}")
    texts += [items[0][1].upper().replace(" ", "!!  "), None, "", "short", items[1][1] + " " + items[1][1], "x" * 100_000]
    bench = spark.createDataFrame([(k, t, "e") for k, t in items] + [(900, None, "e"), (901, "tiny", "e"), (None, "a passage without any id at all", "e")], "item_id long, text string, edits string")
    rows = leaks.find_leaks(docs_of(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    for d, text in enumerate(texts):
        codes = leaks.normalise(text or "")[0].tolist()
        if len(codes) > 5000:
            continue
        for key, item in items:
            own = leaks._Codes(item).strip().codes.tolist()
            assert ((d, key) in got) == (plain_distance(own, codes) <= int(leaks.EDIT_RATE * len(own))), (d, key)
    assert all((d, k) in got for d, k, rate in planted if rate <= 0.05) and not any((d, k) in got for d, k, rate in planted if rate > 0.1)
    assert sum(r.doc_id == len(texts) - 2 for r in rows) == 2
    kept = leaks.drop_leaks(docs_of(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got} and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_leaks_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    bench = spark.createDataFrame([(i, f"passage number {i} of some benchmark set {i * 7}") for i in range(6)], "item_id long, text string")
    texts = [f"before passage number {i} of some benchmark set {i * 7} after" for i in range(3)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(docs_of(spark, texts), bench).where("edits = 0").collect()) == [(0, 0), (1, 1), (2, 2)]
    assert leaks.find_leaks(docs_of(spark, []), bench).count() == 0
    assert leaks.find_leaks(docs_of(spark, texts), bench.where("false")).count() == 0
    assert leaks.drop_leaks(docs_of(spark, texts), bench.where("false")).count() == 3


# Quality


def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = quality.score_documents(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark):
    texts = [None, "", " ", "x" * 50_000, "ok words here", "ok words here"]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_documents(docs_of(spark, texts), empty).collect()] == [0.5] * 6
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)] * 2 + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs_of(spark, texts), labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id > 3}) == 1
    assert quality.score_documents(docs_of(spark, []), labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 2, 1, 3]), np.ones(4)).tolist() == [0, 1.5, 1.5, 3]
    assert quality.isotonic(np.array([3.0, 1, 0]), np.array([1.0, 1, 2])).tolist() == [1, 1, 1]


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    found = [(m.start(), list(PATTERNS).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return ",".join(x[2] for x in sorted(found))


def test_pii_matches_plain_version(spark, sf):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [None, "", "a@b.c@d.e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "+1 (361) 555-8283 190.137.223.204", "4111 1111-1111 1111 5", "+12 345", "é@x.de ä1@x.de", "9" * 30_000, "a" * 100_000 + "@x.org"]
    texts += ["".join(rng.choice("0123459@.+- ()ab%\n") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    rows = pii.find_personal_data(docs_of(spark, texts).selectExpr("*", "'x' as spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (texts[r.doc_id] or "")[:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pii.KINDS)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def net(spark):
    return pii.train(pii.sample_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def test_net_finds_held_out_spans(spark, net):
    """Spans it was never shown: other numbers and names in other sentences."""
    rng = random.Random(4)
    hit = total = 0
    for _ in range(150):
        words = lambda: " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(6))
        number = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(number + c for c in "0123456789" if pii.luhn(number + c))
        value = rng.choice([f"{rng.randint(10, 99)}{words().split()[0]}@mail{rng.randint(0, 9)}.example.org", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", card, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"])
        text = f"{words()} {value} {words()}"
        at = text.index(value)
        total += 1
        hit += any(s == at and e == at + len(value) for s, e, _ in pii.decoded_spans(net, [text])[0])
    assert hit / total >= 0.85
    assert all(not m for _, m in pii.scan_texts(net, ["In 1999 there were 12 of 345 left.", "v1.2.3 of 2024-01-02, 10:30", "no digits at all"]))


def test_net_gradient(net):
    rng = np.random.default_rng(0)
    small = pii.Net({k: v.astype(np.float64) for k, v in pii.Net.new(rng).p.items()})
    x, y = rng.integers(0, pii.CLASSES, (3, pii.WINDOW)), rng.integers(0, len(pii.TAGS), (3, pii.WINDOW))
    loss, grad = small.gradient(x, y)
    for name, at in (("t", (1, 2)), ("s", (3,)), ("o", (5, 1)), ("b", (0,)), ("x", (0, int(x[0, 5]), 7)), ("x", (1, int(x[1, 9]), 30)), ("h", (0, 2, 40)), ("h", (1, 4, 3))):
        old, step = small.p[name][at], 1e-2
        losses = []
        for s in (step, -step):
            small.p[name][at] = old + s
            losses.append(small.gradient(x, y)[0])
        small.p[name][at] = old
        assert (losses[0] - losses[1]) / (2 * step) * pii.WINDOW == pytest.approx(grad[name][at], rel=0.05, abs=2e-3)


def test_masking(spark, net):
    assert pii.mask("mail a@b.cd now", [(5, 11, "email")]) == "mail <email> now"
    assert pii.mask("0123456789", [(1, 5, "ip"), (3, 8, "card")]) == "0<ip>89" and pii.mask(None, []) is None
    docs = docs_of(spark, ["write to a.b@mail.org now", None, "clean", ""])
    out = {r.doc_id: r for r in pii.mask_documents(docs).collect()}
    assert (out[0].text, out[0].n_chars) == ("write to <email> now", 20) and out[1].text is None and out[2].text == "clean"
    assert pii.mask_documents(docs_of(spark, [])).count() == 0


# Nearest neighbours


def plain_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, dtype=np.float64)
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float(good[c] @ good[q]), c) for c in good if c != q and len(good[c]) == len(good[q]))[:k]
            out[q] = [(c, -s) for s, c in scored]
    return out


def test_ann_recall_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # one common vector
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] * 16), (3020, []), (3040, [1.0, 2.0]), (3060, [2.0, 1.0]), (None, [1.0] * 16), rows[7], rows[40]]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, label int")
    want = plain_nearest(rows, 20)
    got = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, 20, shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / max(1, len(want[q])) for q in want if want[q]]
    assert np.mean(hits) >= 0.9
    assert [c for c, _ in got[0]] == list(range(2000, 2020)) and [c for c, _ in got[2000]][0] == 0  # ties by id, never itself
    assert [c for c, _ in got[3040]] == [3060] and len(got[20]) == 20
    for q in got:
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[c], abs=1e-9) for c, s in got[q] if c in exact)


def test_ann_small_and_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, one).count() == 0


def brute_force(vectors, own, k):
    """The k largest inner products of one vector with all others, in double precision, ties to the smaller id."""
    scores = [(-float(np.dot(np.asarray(v, float), np.asarray(vectors[own], float))), i) for i, v in vectors.items() if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_recall_on_unclustered_vectors_of_many_shards(spark):
    rng = np.random.default_rng(4)
    vectors = dict(enumerate(rng.normal(size=(10_000, 64))))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, rank string")
    found: dict[int, list] = {}
    for r in ann.nearest(df.where("vec_id % 100 = 0"), df, 20, shard=1000).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(found) == 100 and all(len(v) == 20 for v in found.values())
    hits = 0
    for own, got in found.items():
        hits += len({i for i, _ in got} & {i for i, _ in brute_force(vectors, own, 20)})
        assert all(abs(s - float(np.dot(vectors[own], vectors[i]))) <= 1e-12 * 64 for i, s in got)
    assert hits / 2000 >= 0.95


def test_the_graph_leads_to_all_of_a_large_group_of_near_copies():
    rng = np.random.default_rng(6)
    lone = rng.normal(size=(900, 64))
    copies = lone[0] + 0.09 * rng.normal(size=(600, 64))  # the original is nearer to each than any other copy
    points = ann.lifted(np.concatenate([lone, copies]))
    graph, entry = ann.build_graph(points)
    asked = ann.asked_points(copies[::10])
    true = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :21]
    found, _ = ann.beam_search(points, graph, entry, asked, ann.SEARCH_BEAM)
    assert np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) >= 0.9
    assert ann.beam_for(points, graph, entry, copies[::10], 21, ann.SEARCH_BEAM) <= 2 * ann.SEARCH_BEAM


def test_no_beam_is_wider_than_its_bound_before_a_shard_is_searched_whole(monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(3000, 8))
    points, tried, search = ann.lifted(vectors), [], ann.beam_search
    monkeypatch.setattr(ann, "beam_search", lambda p, g, e, q, beam: tried.append(beam) or search(p, g, e, q, beam))
    bare = np.full((3000, 4), -1, dtype=np.int64)  # no edges: no beam can find anything
    assert ann.beam_for(points, bare, 0, vectors[:8], 21, 64) == 3000 and max(tried) <= 256
    index = {"points": points, "exact": vectors, "graph": bare, "start": np.array([0, 3000]), "members": np.arange(3000)[:, None]}
    got = ann.best_in_shard(index, np.arange(5), vectors[:5], 20)
    for own in range(5):
        want = brute_force(dict(enumerate(vectors)), own, 20)
        assert got.loc[got["query_id"] == own, "vec_id"].tolist() == [i for i, _ in want]


def test_very_large_and_very_small_vectors_take_part(spark):
    rng = np.random.default_rng(5)
    vectors = {i: (rng.normal(size=8) * 10.0 ** [25, -25, 0][i % 3]).tolist() for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    out = ann.nearest(df.where("vec_id < 3"), df, 20).orderBy("query_id", "rank").collect()
    for own in range(3):
        got = [(r["vec_id"], r["score"]) for r in out if r["query_id"] == own]
        assert [i for i, _ in got] == [i for i, _ in brute_force(vectors, own, 20)]


def test_ties_repeated_rows_and_lengths(spark):
    rows = [(i, [1.0, 0.0], "a") for i in (40, 10, 30, 20, 0)] * 2 + [(50, [0.5, 0.5], "b"), (60, [1.0, 0.0, 0.0], "c"), (70, [1.0, 1.0, 0.0], "c"), (80, [float("nan"), 1.0], "d"), (90, [0.0, 0.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = ann.nearest(df.where("vec_id % 20 = 0"), df, 3).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 60, 80)}
    assert got[0] == [(10, 1.0), (20, 1.0), (30, 1.0)] and got[20] == [(0, 1.0), (10, 1.0), (30, 1.0)]
    assert got[60] == [(70, 1.0)] and got[80] == []


def some_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeated_and_long_items(spark):
    """A text that many items repeat is found for each; a very long item is found whole or not at all."""
    rng = random.Random(2)
    passage, long = some_words(rng, 30), some_words(rng, 1500)
    changed = list(long)
    for at in rng.sample(range(0, len(long), 20), 300):
        changed[at] = rng.choice([" z ", "", "q"])
    bench = spark.createDataFrame([(i, passage) for i in range(50)] + [(None, passage), (99, long), (100, some_words(rng, 30))], "item_id long, text string")
    docs = docs_of(spark, [f"before {passage} after", f"before {long[:5000]} after", some_words(rng, 200), f"before {long} after", f"before {''.join(changed)} after"])
    assert len(long) > 8000
    rows = leaks.find_leaks(docs, bench).collect()
    assert sorted((r.item_id if r.item_id is not None else -1) for r in rows if r.doc_id == 0) == [-1, *range(50)]
    own = len(leaks._Codes(long))
    assert [(r.item_id, r.item_chars, r.edits) for r in rows if r.doc_id == 3] == [(99, own, 0)]
    (near,) = [r for r in rows if r.doc_id == 4]
    assert near.item_id == 99 and 100 < near.edits <= int(leaks.EDIT_RATE * own)
    assert sorted(r.doc_id for r in leaks.drop_leaks(docs, bench).collect()) == [1, 2]


def test_every_one_edit_change_of_short_items():
    """Items of 8 to 40 characters with each of their letters changed, dropped or doubled, against full alignment."""
    rng = random.Random(4)
    for chars in range(8, 41):
        item = some_words(rng, 20)[:chars].strip().ljust(chars, "x")
        index = leaks.Index([(0, item)])
        texts = [f"say {item[:i]}{new}{item[i + 1 :]} ok now" for i in range(chars) for new in ("0", "", item[i] * 2)]
        found = {t for t, *_ in leaks.find_in(index, texts)}
        own = leaks._Codes(item).strip().codes.tolist()
        for n, text in enumerate(texts):
            assert (n in found) == (plain_distance(own, leaks.normalise(text)[0].tolist()) <= int(leaks.EDIT_RATE * chars)), (chars, text)
    assert leaks.find_in(leaks.Index([(0, "hello world ok")]), ["say hello w0rld ok now"])


def test_every_length_has_a_q_gram_size():
    assert {n for n in range(leaks.Q, 200_000) if leaks.gram_size(n) == leaks.SHORT_Q} == {13, 14, 15}


def test_q_grams_of_any_size():
    codes = np.random.default_rng(0).integers(0, 3, 500).astype(np.uint32)
    for q in (1, 3, 6, 8):
        h, seen = leaks.q_gram_hashes(codes, q).tolist(), {}
        assert len(h) == 500 - q + 1
        for i, x in enumerate(h):
            assert seen.setdefault(tuple(codes[i : i + q]), x) == x
        assert len(set(seen.values())) == len(seen)


def test_viterbi_against_all_tag_sequences():
    rng = np.random.default_rng(1)
    small = pii.Net({"t": rng.normal(size=(3, 3)), "s": rng.normal(size=3)})
    scores = [rng.normal(size=(n, 3)) for n in (1, 5, 0, 4, 5)]
    for score, tags in zip(scores, small.decode(scores), strict=True):
        paths = list(itertools.product(range(3), repeat=len(score)))
        total = lambda p, e=score: (small.p["s"][p[0]] if p else 0) + sum(e[i, t] for i, t in enumerate(p)) + sum(small.p["t"][a, b] for a, b in zip(p, p[1:], strict=False))
        assert tuple(tags.tolist()) == max(paths, key=total)


def test_net_finds_values_written_otherwise(net):
    """Forms that no base pattern knows, in contexts that the net has not seen; numbers of other kinds are left alone."""
    rng = np.random.default_rng(77)
    words = "the house of that were under with many people who came late and saw nothing".split()
    prose = lambda: " ".join(rng.permutation(words)[:8])
    found, false = dict.fromkeys(pii.KINDS, 0), 0
    for i in range(160):
        kind = pii.KINDS[i % 4]
        value = pii.written_otherwise(kind, rng)
        text = f"{prose()} {value} {prose()}"
        assert not pii.base_spans(text)
        spans = [text[s:e] for s, e, _ in pii.scan_texts(net, [text])[0][1]]
        found[kind] += value in spans
        false += sum(x not in value and value not in x for x in spans)
        false += len(pii.scan_texts(net, [f"{prose()} {pii.harmless(rng)} {prose()}"])[0][1])
    assert min(found.values()) >= 20 and false <= 8, (found, false)


def test_net_on_forms_and_phrases_that_the_generator_does_not_make(net):
    """Real names and hosts in other sentences, telephone numbers after other words; numbers in prose are left alone."""
    rng = np.random.default_rng(5)
    digits = lambda *sizes: ["".join(map(str, rng.integers(0, 10, n))) for n in sizes]
    cases = [(v, v) for n in "jane tom.miller a_berg kim77 lee".split() for h in "example mail.acme web-shop uni".split() for v in (f"{n} at {h} dot com", f"{n} (at) {h} (dot) org", f"{n}[at]{h}.net", f"{n} [at] {h} [dot] de")]
    for _ in range(20):
        a, b, c = digits(3, 3, 4)
        cases += [(v, v) for v in (f"1-800-{b}-{c}", f"0{a}-{b}{c}", f"(0{a}) {b}{c}", f"0049 {a} {b}{c}")]
        cases += [(f"{lead} {a}-{b}-{c}", f"{a}-{b}-{c}") for lead in ("hotline:", "you may dial", "our mobile is")]
    carriers = ("%s", "Please use %s if needed.", "We can be found under %s these days", "Ask (%s) about it", "no blanks: %s")
    texts = [carriers[i % 5] % said for i, (said, _) in enumerate(cases)]
    found = [value in [t[s:e] for s, e, _ in more] for t, (_, value), (_, more) in zip(texts, cases, pii.scan_texts(net, texts), strict=True)]
    assert np.mean(found[:80]) >= 0.7 and np.mean(found) >= 0.85
    prose = ["between 1990 2000 2010", "values 123 456 7890", "coordinates 048 512 3344", "score 100 200 3000", "lot 333-444-5555", "account 123.456.7890"]
    for _ in range(40):
        a, b, c, d = digits(3, 3, 4, 4)
        prose += [f"between {c} {d} {c}", f"values {a} {b} {c}", f"lot {a}-{b}-{c}", f"account {a}.{b}.{c}", f"population {a} {b} {a}", f"{d} - {c}, {d} - {c}", f"isbn {a}-{b}-{d}-{c}"]
    assert not [t for t, (base, more) in zip(prose, pii.scan_texts(net, prose), strict=True) if more and not base]


def test_names_of_addresses():
    for text, name in (("under a.b at c dot de", "a.b at c dot de"), ("x y (dot) z (at) c.de", "y (dot) z (at) c.de"), ("a dot b at c dot de", "a dot b at c dot de")):
        assert text[pii.name_start(text, 0, len(text)) :] == name


def test_many_spans_in_one_text_are_not_compared_with_each_other(net):
    start = time.time()
    text = " ".join(f"a{i}@mail.org" for i in range(20_000))
    (base, _), = pii.scan_texts(net, [text])
    assert len(base) == 20_000 and list(pii.training_windows(text, np.random.default_rng(0))) and time.time() - start < 60


@pytest.mark.parametrize("share", [1.0, 0.2])
def test_summed_equations_against_a_direct_solution(spark, share):
    """The ridge from equations that partitions sum is that of all rows at once; the calibration is isotonic over scores of
    ridges that have not seen the row. The same for few labels as for more."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < int(100 * share))
    model = quality.fit(docs.repartition(7), labels)
    teach = labels.where("quality is not null").join(docs, "doc_id").where(~quality.held_out(F.col("doc_id")))
    fold = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(quality.FOLDS)).alias("fold")
    rows = teach.select("text", "quality", fold).collect()
    x, y, folds = np.array([quality.statistics(r.text) for r in rows]), np.array([float(r.quality) for r in rows]), np.array([r.fold for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-9)

    def direct(fit):
        z = model.features(x[fit])
        penalty = quality.RIDGE * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-6
        return np.linalg.lstsq(np.vstack([z, np.sqrt(penalty)]), np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]

    z = model.features(x)
    assert np.allclose(z @ model.beta, z @ direct(folds >= 0), atol=1e-6)
    raw = np.zeros(len(x))
    for k in range(quality.FOLDS):
        raw[folds == k] = z[folds == k] @ direct(folds != k)
    bins = np.clip(raw * quality.BINS / 2 + quality.BINS / 4, 0, quality.BINS - 1).astype(int)
    means = sorted((raw[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in set(bins))
    assert np.allclose(model.edges, [m[0] for m in means], atol=1e-6)
    assert np.allclose(model.values, quality.isotonic(np.array([m[1] for m in means]), np.array([m[2] for m in means], float)), atol=1e-6)


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_alignment_against_a_plain_one():
    """The alignment is one, never longer than the longest, and equal to it where edits are few."""
    rng = random.Random(7)
    template = licenses.words_of(licenses.TEMPLATES["MIT-text"])[0]
    for n in range(60):
        text = list(template)
        for _ in range(n % 12):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [rng.choice(["x", "the", "of"])] * rng.randint(0, 2)
        pairs = licenses.patience(text, template)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False)) and all(text[i] == template[j] for i, j in pairs)
        assert longest_common(text, template) * 0.98 <= len(pairs) <= longest_common(text, template)
    a, b = ([rng.choice("pqrs") for _ in range(400)] for _ in range(2))  # no unique word at all
    assert len(licenses.patience(a, b)) == longest_common(a, b)


def test_no_window_is_lost_to_a_changed_word():
    """Any fifth of a template's words may be the changed ones: the rest is still found, where a plain alignment of the
    whole text finds it."""
    rng = random.Random(13)
    ready = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = licenses.words_of(text)[0]
        for _ in range(15):
            changed = list(words)
            for i in rng.sample(range(len(words)), int(0.2 * len(words) + 1e-9)):
                changed[i] = f"zz{i}"
            found = licenses.scan_text("aa bb " + " ".join(changed) + " cc dd", ready)
            best = max(len(licenses.patience(changed, w)) / len(w) for w in ready.words.values())
            assert len(licenses.patience(changed, words)) < 0.8 * len(words) or (found and found[0][1] >= 0.8), (name, changed, found, best)
    assert [x[0] for x in licenses.scan_text("Released under the MIT terms", ready)] == ["MIT"]


def test_licenses_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "x Released under the MIT License. y", "a", 0)] * 2 + [(None, "Released under the MIT License.", "b", 1), (2, None, "c", 2), (3, "", "c", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    out = sorted((r.doc_id or 0, r.license, r.start) for r in licenses.find_licenses(df).collect())
    assert out == [(0, "MIT", 0), (1, "MIT", 2), (1, "MIT", 2)]


def test_quality_with_clashing_columns_and_repeated_rows(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    odd = docs.unionByName(docs.limit(3)).withColumns({"score": F.lit("s"), "y": F.lit(1), "quality": F.lit(7), "held_out": F.lit(0)})
    out = quality.score_documents(odd, labels.withColumn("text", F.lit("no input")))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count() + 3
    assert quality.keep_good(odd, labels).columns == odd.columns
