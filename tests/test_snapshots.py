"""Snapshots of logs, the store of vectors and failing detectors against whole recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import embedder, scratch
from mnemoframe.operators import govern, ledger
from mnemoframe.operators.snapshots import Snapshot, keep_flow_rows, keep_latest_rows
from mnemoframe.operators.vectors import VectorStore

FLOW = "problem_id string, block_id string, seq long, op string, type string, label string, confidence double, created_at string, target_id string, reason string, kind string, body_hash string, body_bytes long"


def flow_log(spark, n=300):
    rng = random.Random(6)
    rows = []
    for seq in range(n):
        op = rng.choice(["block-add", "block-supersede", "relation-add", "relation-add", "cue-card-regen"])
        rows.append((f"p{rng.randrange(3)}", f"b{rng.randrange(6)}", seq, op, "Cause", f"l{seq}", 0.5, None, f"b{rng.randrange(6)}", f"r{seq}", "causes", f"h{seq}", seq))
    return spark.createDataFrame(rows, FLOW)


@pytest.mark.parametrize("cuts", [[0], [1, 150], [299], [40, 41, 200, 200]])
def test_snapshot_of_any_prefix_and_its_tail_fold_like_the_whole_flow_log(spark, cuts):
    log = flow_log(spark)
    kept = Snapshot(spark, scratch(spark, "snapshot"), keep_flow_rows, log.schema)
    for cut in cuts:
        kept.advance(log.where(F.col("seq") <= cut))
    rows = kept.rows(log)
    assert sorted(map(str, ledger.fold_flow(rows).collect())) == sorted(map(str, ledger.fold_flow(log).collect()))
    cue = ["problem_id", "cue_hash", "cue_bytes"]
    assert sorted(map(str, ledger.flow_meta(rows).select(cue).collect())) == sorted(map(str, ledger.flow_meta(log).select(cue).collect()))
    assert rows.count() <= log.count()


def test_snapshot_of_revisions(spark, monkeypatch):
    log = spark.range(200).select((F.col("id") % 7).alias("id"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37) % 100).alias("version"), F.col("id").alias("seq"))
    kept = Snapshot(spark, scratch(spark, "snapshot"), keep_latest_rows("id", "version"), log.schema)
    assert sorted(kept.rows(log).collect(), key=str) == sorted(log.collect(), key=str)  # none yet
    assert kept.advance(log.where("seq < 100")) == 7
    assert kept.advance(log.where("seq < 100")) == 0 and kept.advance(log.limit(0)) == 0
    before = kept._last()[:2]

    def lost(*_):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError):
            kept.advance(log)
    assert kept._last()[:2] == before
    assert sorted(ledger.reduce_latest(kept.rows(log), "id", "version").collect(), key=str) == sorted(ledger.reduce_latest(log, "id", "version").collect(), key=str)
    assert kept.rows(log).count() == 7 + 100


def test_texts_are_embedded_once_and_other_dimensions_left_out(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other text"), (4, None), (5, "")], "doc_id long, text string")
    path = scratch(spark, "vectors")
    store = VectorStore(spark, path, "ngrams", 64, embedder(64))
    assert store.vectors(docs).count() == 0
    assert store.fill(docs.where("doc_id < 3")) == 1 and store.fill(docs) == 2 and store.fill(docs) == 0
    wide = VectorStore(spark, path, "ngrams", 128, embedder(128))
    assert wide.stored().count() == 0 and wide.fill(docs.limit(1)) == 1
    wrong = VectorStore(spark, path, "wrong", 64, embedder(32))
    wrong.fill(docs)
    assert wrong.vectors(docs).count() == 0
    got = {r.doc_id: r.vec for r in store.vectors(docs).collect()}
    expected = {r.doc_id: r.vec for r in docs.select("doc_id", embedder(64)("text").alias("vec")).collect()}
    assert got == expected and len(got[4]) == 64


def test_a_detector_that_raises_on_a_row_costs_its_own_findings_only(spark):
    claims = spark.createDataFrame([(1, "accepted", 0.1, "a", 7, None, None, ["e"])], "candidate_id long, status string, confidence double, proposed_text string, block_id long, superseded_by long, invalid_at string, evidence array<string>").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))

    def own(claims, now):
        return claims.select(F.lit("own").alias("detector_id"), F.lit("info").alias("severity"), F.lit("s").alias("subject"), F.array(F.lit("e")).alias("evidence"), F.lit(1).alias("more"))

    def raises(claims, now):
        return own(claims, now).withColumn("subject", F.raise_error(F.lit("row 1")).cast("string"))

    def lacks(claims, now):
        return claims.select(F.lit("lacks").alias("detector_id"))

    found, failed = govern.findings_and_failures(claims, F.lit("2024-02-01").cast("timestamp"), (govern.low_confidence, raises, own, lacks))
    assert sorted(r.detector_id for r in found.collect()) == ["low-confidence", "own"]
    assert [name for name, _ in failed] == ["raises", "lacks"] and "row 1" in failed[0][1]
