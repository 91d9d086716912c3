"""Exact top-k search and the stored index against plain scoring and a fresh index."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import scratch
from mnemoframe.operators import retrieval
from mnemoframe.operators.retrieval import top_k
from mnemoframe.operators.stored_index import StoredIndex


@pytest.fixture(scope="module")
def corpus(spark):
    """Words by rank: few are common. Some documents are equal, so scores tie."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{int(1.25 ** rng.randrange(40))}x" for _ in range(n))
    docs = [(i, words(rng.randrange(1, 40))) for i in range(600)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]
    queries = [(i, words(rng.randrange(1, 8)).split()) for i in range(40)] + [(90, ["none"]), (91, ["w1x", "none"]), (92, [])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, terms array<string>")


def rows_of(df, *columns):
    return sorted(tuple(round(r[c], 6) if c == "score" else r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("k", "prefix"), [(1, False), (10, False), (10, True), (1000, False)])
def test_best_rows_are_those_of_full_scoring(spark, corpus, k, prefix):
    docs, queries = corpus
    index, measure = retrieval.build_index(docs, {"text": 1.0}), {}
    full = top_k(retrieval.bm25(queries, index, prefix=prefix), k, [F.col("score"), F.col("doc_id")])
    best = retrieval.bm25_best(queries, index, k, prefix=prefix, measure=measure)
    assert rows_of(best, "query_id", "doc_id", "score", "rank") == rows_of(full, "query_id", "doc_id", "score", "rank")
    assert measure["scored"] < measure["all"] or k > 1


def test_filter_comes_before_the_limit(spark, corpus):
    docs, queries = corpus
    index = retrieval.build_index(docs, {"text": 1.0})
    odd = lambda rows: rows.where("doc_id % 3 = 1")
    full = top_k(odd(retrieval.bm25(queries, index)), 5, [F.col("score"), F.col("doc_id")])
    assert rows_of(retrieval.bm25_best(queries, index, 5, keep=odd), "query_id", "doc_id", "score", "rank") == rows_of(full, "query_id", "doc_id", "score", "rank")


def test_documents_with_all_terms(spark, corpus):
    docs, queries = corpus
    index = retrieval.build_index(docs, {"text": 1.0})
    sizes = queries.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"))
    full = retrieval.bm25(queries, index).join(sizes, "query_id").where("matched = wanted")
    found = retrieval.bm25_all(queries, index)
    assert full.count() > 20 and rows_of(found, "query_id", "doc_id", "score", "matched") == rows_of(full, "query_id", "doc_id", "score", "matched")


def postings_of(index):
    return rows_of(index.postings, "token", "doc_id", "tf", "doc_len"), [tuple(r) for r in index.stats.collect()]


def test_stored_index_after_changes_equals_a_fresh_one(spark):
    pages = lambda rows: spark.createDataFrame(rows, "doc_id long, title string, body string")
    first = [(i, f"title {i}", f"body of page {i % 4}") for i in range(20)] + [(50, None, None), (51, "a", "bc"), (52, "ab", "c")]
    kept = StoredIndex(spark, scratch(spark, "index"), ("title", "body"))
    weights = {"title": 2.0, "body": 1.0}
    assert kept.version() == (0, []) and kept.live().count() == 0
    assert kept.update(pages(first)) == 23
    assert kept.update(pages(first)) == 0  # nothing changed, nothing is tokenised
    now = {r[0]: r for r in first}
    now |= {3: (3, "title 3", "another body"), 60: (60, "new", "page")}
    gone = pages([(5, "", ""), (6, "", ""), (999, "", "")])
    assert kept.update(pages(list(now.values())), removed=gone) == 2
    now.pop(5), now.pop(6)
    assert kept.update(pages([first[5]])) == 1  # comes back
    now[5] = first[5]
    fresh = retrieval.build_index(pages(list(now.values())), weights)
    assert postings_of(kept.as_index(weights)) == postings_of(fresh)
    segments = kept.version()[1]
    kept.merge()
    assert len(segments) > 1 and len(kept.version()[1]) == 1 and postings_of(kept.as_index(weights)) == postings_of(fresh)
    asked = spark.createDataFrame([(1, ["another", "body", "title"])], "query_id long, terms array<string>")
    assert rows_of(retrieval.bm25_best(asked, kept.as_index(weights), 5), "doc_id", "score") == rows_of(retrieval.bm25_best(asked, fresh, 5), "doc_id", "score")


def test_many_updates_are_merged_and_a_lost_update_is_not_seen(spark, monkeypatch):
    kept = StoredIndex(spark, scratch(spark, "index"), ("text",))
    for i in range(9):
        kept.update(spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string"))
    assert len(kept.version()[1]) < 8 and kept.live().count() == 9
    before = kept.version()

    def lost(*_):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(StoredIndex, "_publish", lost)
        with pytest.raises(RuntimeError):
            kept.update(spark.createDataFrame([(100, "more")], "doc_id long, text string"))
    assert kept.version() == before and kept.live().count() == 9
    assert kept.update(spark.createDataFrame([(100, "more")], "doc_id long, text string")) == 1 and kept.live().count() == 10
