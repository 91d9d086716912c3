"""The corpus pipeline: each stage on its own input, and the whole on odd rows."""

import random

import corpus_pipeline
from mnemoframe.llm import pii, simhash
from mnemoframe.llm.common import materialise

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_duplicate_groups_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for n in range(40):
        base = [word() for _ in range(rng.choice([30, 200, 800]))]
        texts.append(" ".join(base))
        for edits in (0, 1, max(1, len(base) // 60), len(base) // 3):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    big = [word() for _ in range(400)]
    for _ in range(150):  # more near copies than a bucket compares in pairs
        copy = list(big)
        for _ in range(3):
            copy[rng.randrange(400)] = word()
        texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(60))  # a passage in many unrelated texts
    texts += [" ".join(word() for _ in range(300)) + " " + shared for _ in range(120)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    linked = missed = false = 0
    for i in range(len(texts)):
        for j in range(i):
            same = got[i] == got[j]
            if i < 200 and j < 200:
                if i // 5 == j // 5:
                    if jaccard(texts[i], texts[j]) >= 0.8:
                        linked += 1
                        missed += not same
                else:
                    false += same
    assert linked > 100 and missed / linked <= 0.02 and not false
    copies = [got[i] for i in range(200, 350)]
    assert max(copies.count(c) for c in set(copies)) >= 145
    assert len({got[i] for i in range(350, 470)}) == 120


def test_stages_keep_the_columns_and_their_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "some text without an id that is long enough", "en", "s", 0)], DOC)
    now = docs.unionByName(odd).unionByName(docs.limit(3))
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, now, sf), f"test-{name}")
        assert out.columns == docs.columns, name
        now = out
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > counts[0] / 3
    assert all(not pii.base_spans(r.text or "") for r in now.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.where("piece = 0").count() == counts[4]


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
