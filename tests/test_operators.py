"""Operators on small literal inputs."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.operators import consolidate, flow, govern, graph, ledger, metrics, retrieval, router, sessions
from mnemoframe.plans import graph_queries

NOW = datetime(2026, 4, 28)


def at(when=NOW):
    return F.lit(when)


def test_latest_revision(spark):
    t = lambda m: datetime(2026, 1, 1, 0, m)
    rows = [("a", "accepted", t(5), 1), ("a", "pending", t(0), 2), ("b", "accepted", t(5), 1), ("b", "pending", None, 2), ("c", "pending", None, 1), ("c", "accepted", None, 2)]
    df = spark.createDataFrame(rows, "id string, status string, recorded_at timestamp, seq int")
    assert [r.status for r in ledger.reduce_latest(df, "id", "recorded_at").collect()] == ["accepted"] * 3
    merged = ledger.merge_ledgers(df, df.where("seq = 2"), ["id"])
    assert merged.count() == 6 and ledger.reduce_latest(merged, "id", "recorded_at").where("status = 'accepted' and id <> 'c'").count() == 2


def test_flow_log(spark):
    schema = "seq int, op string, problem_id string, block_id string, type string, label string, confidence double, created_at timestamp, target_id string, reason string, kind string, body_hash string, body_bytes int"
    add = lambda seq, b, p="p": (seq, "block-add", p, b, "Cause", b, 0.5, NOW, None, None, None, None, None)
    sup = lambda seq, b, to: (seq, "block-supersede", "p", b, None, None, None, None, to, "r", None, None, None)
    rel = lambda seq, b, to: (seq, "relation-add", "p", b, None, None, None, None, to, None, "causes", None, None)
    cue = (9, "cue-card-regen", "p", None, None, None, None, None, None, None, None, "abc123", 500)
    df = spark.createDataFrame([sup(0, "b", "a"), add(1, "a"), add(2, "b"), sup(3, "a", "b"), rel(4, "b", "a"), add(5, "x", "q"), add(6, "c"), sup(7, "c", "b"), add(8, "c"), cue], schema)
    out = {r.block_id: r for r in ledger.fold_flow(df).collect()}
    assert (out["a"].status, out["a"].superseded_by) == ("superseded", "b")
    assert (out["b"].status, [tuple(x) for x in out["b"].relations]) == ("confirmed", [("causes", "a")])
    assert out["c"].status == "confirmed" and out["x"].problem_id == "q"
    meta = {r.problem_id: r for r in ledger.flow_meta(df, stale_after=9).collect()}
    assert (meta["p"].cue_hash, meta["p"].cue_bytes, meta["p"].stale, meta["q"].stale) == ("abc123", 500, True, False)


def test_redaction_order_and_audit(spark):
    df = spark.createDataFrame([(1, "sk-ant-" + "a" * 25 + " Password: hunter22 token=abcdefgh1"), (2, "fine")], "id int, text string")
    out = {r.id: r for r in ledger.redact(df, "text").collect()}
    assert out[1].text == "<REDACTED:anthropic-key> <REDACTED:password-field> <REDACTED:generic-secret>" and out[2].redactions == []
    assert sorted(r.pattern for r in ledger.redaction_audit(df, "text").collect()) == ["anthropic-key", "generic-secret", "password-field"]


def test_observations(spark):
    rows = [("tool-post", '{"toolName":"Edit","toolInput":{"file_path":"/a"}}'), ("tool-post", '{"toolName":"Bash","toolInput":{"command":"x password=abcdef"},"toolOutput":{"exitCode":2}}'), ("tool-post", '{"toolName":"Odd"}'), ("prompt-submit", '{"message":"hi"}'), ("stop", "{}")]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session_id string, seq int, stage string, payload string")
    out = {r.seq: r for r in ledger.normalize_observations(df).collect()}
    assert '"filesTouched":["/a"]' in out[0].data and '"exitCode":2' in out[1].data and "REDACTED" in out[1].data
    assert [out[i].needs_analysis for i in range(4)] == [False, False, True, True] and 4 not in out


def test_queue_and_ttl(spark):
    df = spark.createDataFrame([("a", True, 1, "s"), ("a", False, 2, "s"), ("b", False, 3, "s"), ("c", False, 4, "s")], "id string, tombstone boolean, seq int, session_id string")
    assert sorted(r.id for r in ledger.live_queue(df).collect()) == ["b", "c"]
    assert [r.id for r in ledger.oldest_items(ledger.live_queue(df)).collect()] == ["b"]
    items = spark.createDataFrame([(NOW - timedelta(days=7),), (NOW - timedelta(days=7, seconds=-1),)], "t timestamp")
    assert [r.expired for r in ledger.sweep_ttl(items, at(), "t").collect()] == [True, False]
    assert [r.expired for r in ledger.sweep_ttl(items, at(), "t", inclusive=False).collect()] == [False, False]


def test_turns_and_bundles(spark):
    rows = [("s", i, p) for i, p in enumerate([0, 0, 1, 0, 1, 1])]
    df = spark.createDataFrame(rows, "session_id string, seq int, is_prompt int")
    t = sessions.turn_ordinals(df, order=("seq",))
    assert [r.turn_ordinal for r in t.orderBy("seq").collect()] == [1, 1, 1, 1, 2, 3]
    parts = sessions.bundle_turns(t.withColumn("problem_id", F.lit(None).cast("string")), 3)
    assert [r.part for r in parts.orderBy("seq").collect()] == [1, 1, 1, 2, None, None]


def test_haystack(spark):
    rows = [("q", f"s{i}", i, d) for i, d in enumerate(["2023/01/10 (Tue)", "2023/03/05 (Sun)", "2023/02/01 (Wed)", "2023/04/20 (Thu)"], 1)]
    df = spark.createDataFrame(rows, "question_id string, session_id string, seq int, date string")
    ordered = sessions.order_haystack(df)
    assert [r.session_id for r in ordered.orderBy("place").collect()] == ["s1", "s3", "s2", "s4"]
    sliced = sessions.slice_at(ordered)
    got = {f: sorted(r.session_id for r in sliced.where(F.col("fraction") == f).collect()) for f in (0.25, 0.5)}
    assert got == {0.25: ["s1"], 0.5: ["s1", "s3"]}
    usable = sessions.usable_checkpoints(sliced, spark.createDataFrame([("q", "s4")], "question_id string, session_id string"))
    assert [(float(r.fraction), r.usable, r.in_cohort) for r in usable.orderBy("fraction").collect()] == [(0.25, False, False), (0.5, False, False), (0.75, False, False), (1.0, True, False)]


def test_near_duplicates(spark):
    base = "We planned the garden harvest carefully and stored ripe tomatoes, green beans, dried herbs for several long winter years"
    rows = [("a", base + ".", "2023/01/10 (Tue)"), ("b", base + "!", "2023/02/15 (Wed)"), ("c", base.replace("years", "year") + ".", "2023/03/05 (Sun)"), ("d", "Quarterly budget meeting notes about invoices", None), ("e", "lone copy text words", None), ("f", "lone copy text words", None), ("g", "", None)]
    df = spark.createDataFrame([(i, t, d, n) for n, (i, t, d) in enumerate(rows)], "id string, text string, date string, seq int")
    out = {r.id: r.superseded_by for r in consolidate.near_duplicates(df).collect()}
    assert out == {"a": "c", "b": "c", "c": None, "d": None, "e": "f", "f": None, "g": None}
    stats = metrics.consolidation_stats(consolidate.distill(consolidate.near_duplicates(df).select("id", "text", "superseded_by"))).first()
    assert (stats.total, stats.superseded) == (7, 3)


def test_distill(spark):
    text = " ".join(f"Sentence number {w} about gardens." for w in "one two three four five six seven eight nine ten eleven twelve".split())
    df = spark.createDataFrame([("a", text), ("b", "One. Two. Three."), ("c", None)], "id string, text string")
    out = {r.id: r.core for r in consolidate.distill(df).collect()}
    assert out["b"] == "One. Two. Three." and out["c"] is None
    kept = [s.strip() for s in out["a"].split(".") if s.strip()]
    assert len(kept) == 4 and kept == [s for s in map(str.strip, text.split(".")) if s in kept]


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, body_user string")


def test_search_weights_and_tiers(spark):
    rows = [("long", "camera flash " + "filler words " * 40, ""), ("short", "notes", "I upgraded my camera flash"), ("other", "garden", None), *((f"x{i}", f"noise {i}", "") for i in range(6))]
    index = retrieval.build_index(pages(spark, rows), {"text": 1.0, "body_user": 2.0})
    ask = lambda q: spark.createDataFrame([("q", q)], "query_id string, question string")
    assert [r.doc_id for r in retrieval.search(ask("camera flash"), index).orderBy("rank").collect()] == ["short", "long"]
    tiers = {q: {r.tier for r in retrieval.search(ask(q), index).collect()} for q in ("camera flash", "where is the camera", "ca fl")}
    assert tiers == {"camera flash": {1}, "where is the camera": {2}, "ca fl": {3}}


def ranked(spark, ids):
    return spark.createDataFrame([("q", d, i) for i, d in enumerate(ids, 1)], "query_id string, doc_id string, rank int")


def test_fusion(spark):
    text, vector = ranked(spark, ["a", "b", "c", "d", "e"]), ranked(spark, ["e", "z", "a"])
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert order(retrieval.fuse_rescue(text, vector)) == ["a", "b", "c", "d", "e", "z"]
    assert order(retrieval.fuse_rerank(text, vector)) == ["a", "b", "c", "e", "d", "z"]
    assert order(retrieval.fuse_rrf(text, vector))[:2] == ["a", "e"]
    scores = {r.doc_id: r.score for r in retrieval.fuse_rescue(text, vector).collect()}
    assert scores["a"] == pytest.approx(1 / 61) and scores["z"] == pytest.approx(1 / (60 + 5 + 1 + 2))


def test_window_promotion(spark):
    hits = ranked(spark, ["feb", "may1", "x", "may2"])
    days = spark.createDataFrame([("feb", 10), ("may1", 100), ("may2", 110), ("x", None)], "doc_id string, epoch_day int")
    win = lambda a, b: spark.createDataFrame([("q", a, b)], "query_id string, start_day int, end_day int")
    order = lambda w: [r.doc_id for r in retrieval.promote_in_window(hits, days, w).orderBy("rank").collect()]
    assert order(win(95, 120)) == ["may1", "may2", "feb", "x"] and order(win(500, 600)) == ["feb", "may1", "x", "may2"]


def test_vectors_and_external_rankers(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [1.0, 0.0, 0.0]), ("e", [0.0, 0.0])], "doc_id string, vec array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vec array<float>")
    assert [r.doc_id for r in retrieval.rank_by_vector(q, docs, 5).orderBy("rank").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("q1", "?", "s1", "t"), ("q1", "?", "s2", "t"), ("q2", "boom", "s3", "t")], "query_id string, question string, session_id string, text string")

    def ranker(question, sessions):
        if question == "boom":
            raise RuntimeError("no")
        return ["s2", "gone", "s2", "s1"]

    out = {(r.query_id, r["rank"]): (r.session_id, r.error) for r in retrieval.rank_external(rows, ranker).collect()}
    assert out == {("q1", 1): ("s2", None), ("q1", 2): ("s1", None), ("q2", 0): (None, "RuntimeError: no")}


def test_gap_scores(spark):
    rel = "array<struct<kind:string,target_id:string>>"
    schema = f"problem_id string, block_id string, type string, status string, label string, confidence double, created_at timestamp, last_confirmed_at timestamp, stale_after timestamp, polarity string, relations {rel}"
    blocks = spark.createDataFrame([("p", "h", "Hypothesis", "confirmed", "h", 1.0, NOW, NOW, None, None, [])], schema)
    found = spark.createDataFrame([("p", "g1", "h", 1.0, NOW), ("p", "g2", "gone", 0.0, NOW)], "problem_id string, detector_id string, subject_id string, severity double, created_at timestamp")
    out = {r.detector_id: r.voi for r in flow.voi(found, blocks, at()).collect()}
    assert out == pytest.approx({"g1": 0.5, "g2": 0.225})

    def broken(blocks, relations, now):
        raise RuntimeError("bad detector")

    rows, failed = flow.gaps(blocks, at(), [flow.unsupported_hypothesis, broken])
    assert [r.detector_id for r in rows.collect()] == ["rule:unsupported-hypothesis"] and failed == [("broken", "RuntimeError: bad detector")]


@pytest.mark.parametrize(
    ("pairs", "reach", "cycles"),
    [
        ("ab bc cd", {"ab": 1, "bc": 1, "cd": 1, "ac": 2, "bd": 2, "ad": 3}, []),
        ("ab ac bd cd", {"ab": 1, "ac": 1, "bd": 1, "cd": 1, "ad": 2}, []),
        ("ab ba", {"ab": 1, "ba": 1}, ["ab"]),
        ("ab bc ca", {"ab": 1, "bc": 1, "ca": 1, "ac": 2, "ba": 2, "cb": 2}, ["abc"]),
        ("ab ba cd dc", {"ab": 1, "ba": 1, "cd": 1, "dc": 1}, ["ab", "cd"]),
    ],
)
def test_delegation(spark, pairs, reach, cycles):
    df = spark.createDataFrame([tuple(p) for p in pairs.split()], "a string, b string")
    assert {r.a + r.b: r.depth for r in graph.compose_closure(df).collect()} == reach
    assert sorted("".join(r.cycle) for r in graph.delegation_cycles(df).collect()) == cycles


def test_graph_projection(spark, tmp_path):
    import json

    from mnemoframe.sources.logs import read_skills
    from tests.test_sources import skill

    other = skill(slug="b", structural=[], logical=[], protocols=[{"id": "b#p1", "delegate_to": "nowhere"}])
    (tmp_path / "s.json").write_text(json.dumps([skill(), other]))
    docs, _ = read_skills(spark, str(tmp_path / "s.json"))
    nodes, edges = graph.project_graph(docs)
    edges = graph.resolve_edges(edges, nodes)
    assert {r.node_type for r in nodes.collect()} == {"scheduling", "structural", "logical", "protocol", "canonical-action"}
    assert [r.to_id for r in graph.dangling_edges(edges).collect()] == ["nowhere"]
    assert [(r.from_skill, r.condition) for r in graph.reverse_delegators(edges, "b").collect()] == [("a", "late")]
    stats = graph.kg_stats(nodes, edges).first()
    assert (stats.skills, stats.dangling) == (2, 1)
    assert govern.skill_stats(docs).first().skills == 2


def test_claims(spark):
    schema = "candidate_id string, status string, confidence double, proposed_text string, block_id string, created_at timestamp, invalid_at timestamp, superseded_by string, evidence array<string>"
    days = lambda n: NOW - timedelta(days=n)
    rows = [
        ("a", "accepted", 0.9, "Same text", "b1", days(60), None, None, ["e"]), ("b", "pending", 0.9, " same TEXT ", "b2", days(7), None, None, ["e"]),
        ("c", "rejected", 0.9, "same text", "b3", days(90), None, None, []), ("d", "accepted", 0.4, "other", "b1", days(1), None, None, []),
        ("e", "pending", 0.9, "more", "b4", days(14), None, None, ["e"]), ("f", "accepted", 0.9, "x", "b5", days(1), days(0), None, ["e"]), ("g", "accepted", 0.9, "y", "b5", days(1), None, None, ["e"]),
    ]
    df = spark.createDataFrame(rows, schema)
    found = {(r.detector_id, r.severity, tuple(r.evidence)) for r in govern.findings(df, at()).collect()}
    assert found == {("duplicate-candidates", "warning", ("a", "b")), ("stale-claims", "info", ("a",)), ("contradictions", "warning", ("a", "d")), ("low-confidence", "info", ("d",)), ("low-confidence", "warning", ("d",)), ("review-queue", "info", ("b",)), ("review-queue", "warning", ("e",))}


def test_router(spark):
    df = spark.createDataFrame([("1", "Please verify ADR-7 and fix `a.ts`"), ("2", "hello"), ("3", "x" * 40), ("4", None)], "request_id string, text string")
    out = {r.request_id: r for r in router.classify_requests(df).collect()}
    assert out["1"].categories == ["PROJECT", "VERIFY", "CODE"] and out["2"].categories == ["QUICK"] and out["3"].categories == ["DEEP"] and out["4"].categories == ["QUICK"]
    assert out["1"].lanes == ["current", "project", "decision", "evidence", "code"]
    rules = [(1, r"(?i)\bADR-?\d+", ["decision"], ["index.md"], r"(?i)\bADR-?(\d+)", "records/%s-*.md", "records"), (2, r"`\w", ["code", "decision"], ["index.md", "src"], None, None, "code"), (3, r"(?i)\bverifies\b", ["x"], [], None, None, "no part of a word")]
    got = {r.request_id: r for r in router.resolve_mappings(df, spark.createDataFrame(rules, router.RULE_SCHEMA)).collect()}
    assert got["1"].files == ["index.md", "records/007-*.md", "src"] and got["1"].lanes == ["decision", "code"] and got["1"].matched == ["records", "code"]
    assert got["2"].lanes == got["4"].lanes == []


def test_router_drops_no_rule_of_a_large_table(spark):
    rules = [(i, f"^r{i}$", ["l"], [f"f{i}"], None, None, f"d{i}") for i in range(1500)]
    df = spark.createDataFrame([(f"r{i}",) for i in range(1500)], "request_id string").withColumn("text", F.col("request_id"))
    got = router.resolve_mappings(df, spark.createDataFrame(rules, router.RULE_SCHEMA)).where("size(files) = 1")
    assert got.count() == 1500


def test_canonical_samples_gather_no_ids(spark):
    """The least distinct ids of each signature, without a group that holds all of them."""
    rows = [(f"i{n % 500:03}", f"s{n % 7}", "READ", ["B", "A"], None) for n in range(1000)] + [(None, "s", "WRITE", ["A"], None)] * 3 + [("z", "s", "WRITE", ["C"], None)] * 2
    rows += [("i", "s", "WRITE", ["D"], "ref")] * 3 + [("i", "s", "WRITE", ["K"], None)] * 3
    df = spark.createDataFrame(rows, "logical_id string, skill string, action string, resources array<string>, action_ref string")
    out = govern.canonical_candidates(df, spark.createDataFrame([("WRITE|K",)], "signature string"))
    assert {r.signature: (r.n, r.skills, r.samples) for r in out.collect()} == {"READ|A,B": (1000, 7, ["i000", "i001", "i002"]), "WRITE|A": (3, 1, [])}
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_metrics(spark):
    ranks = metrics.evidence_ranks(ranked(spark, ["a", "b", "c"]), spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "query_id string, doc_id string"))
    rows = ranks.withColumns({"mode": F.lit("m"), "type": F.lit("t")})
    out = {(r.scope, r.type): r for r in metrics.retrieval_metrics(rows.where("query_id = 'q'"), (1, 2)).collect()}
    assert (out["all", None].recall_1, out["all", None].recall_2, out["all", None].mrr) == (0.5, 1.0, 1.0)
    answers = spark.createDataFrame([("t", "Blue", "blue", None), ("t", "no", "red", None)], "type string, answer string, truth string, correct boolean")
    (total,) = (r for r in metrics.qa_scores(answers).collect() if r.type is None)
    assert (total.exact, total.f1, total.accuracy) == (0.5, 0.5, None)
    cases = spark.createDataFrame([(["a"], ["a", "b"], ["f"], ["f"]), (["c"], [], [], ["g"])], "expect_lanes array<string>, lanes array<string>, expect_files array<string>, files array<string>")
    b = metrics.router_bench(cases).first()
    assert (b.lane_hit, b.precision, b.recall, b.file_hit) == (0.5, 0.25, 0.5, 1.0)


def test_skill_pages(spark):
    body = "# Deploy\n## Setup\nuse `git` and `npm`\n## Run steps\nif it fails retry `npm`\n## Verify\n"
    df = spark.createDataFrame([("deploy", "Ship code. Fast; safe", body)], "slug string, description string, body string")
    (r,) = govern.normalize_skills(df).collect()
    assert r.intents == ["Ship code", "Fast", "safe"] and r.dependencies == ["git", "npm"] and "branching" in r.features
    assert [(s.scene, s.transitions_to) for s in r.scenes] == [("PREPARE", ["deploy#s2"]), ("ACT", ["deploy#s3"]), ("VERIFY", [])]


def test_skill_pages_are_made_row_by_row(spark):
    df = spark.createDataFrame([("a", "One", "## Setup\n## Other\n"), ("a", "Two", "## Check\n"), ("b", "Three", "no heading"), ("c", None, None)], "slug string, description string, body string")
    skills = govern.normalize_skills(df)
    out = {(r.slug, *r.intents): r.scenes and [(s.id, s.scene, s.transitions_to) for s in r.scenes] for r in skills.collect()}
    # Pages of one name each keep their own scenes, and no page meets another.
    assert out == {("a", "One"): [("a#s1", "PREPARE", ["a#s2"]), ("a#s2", "REASON", [])], ("a", "Two"): [("a#s1", "VERIFY", [])], ("b", "Three"): None, ("c",): None}
    assert "Exchange" not in skills._jdf.queryExecution().executedPlan().toString()


def test_pending_questions_are_ordered_as_in_sql(spark, tmp_path):
    # 0.29 / 200 is 0.0014 with four places on the binary number, and 0.27 / 200 is 0.0014 too.
    rows = [(1, NOW.replace(year=2024, month=2, day=2), 0.29), (2, NOW.replace(year=2024, month=2, day=1), 0.27), (3, None, 0.27)]
    events = [(i * 10, ts, 1, "view", value, '{"k": 2}') for i, ts, value in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = graph_queries.t2_pending_questions(spark, str(tmp_path))
    assert [r.block_id for r in out.orderBy("place").collect()] == ["20", "10", "30"]


def test_decay(spark):
    now = datetime(2026, 7, 24)
    rows = [("p1", "draft", 15), ("p2", "draft", 14), ("p3", "active", 91), ("p4", "active", 91), ("p5", "active", 50)]
    df = spark.createDataFrame([(i, s, str(now - timedelta(days=d))) for i, s, d in rows] + [("p6", "active", "soon")], "page_id string, status string, updated_at string")
    recalls = spark.createDataFrame([("p4", 1, now - timedelta(days=5))], "page_id string, recalls long, last_recall timestamp")
    out = {r.page_id: r.tier for r in govern.page_decay(df, recalls, at(now)).collect()}
    assert out == {"p1": "stale-draft", "p2": "fresh", "p3": "decay-candidate", "p4": "aging", "p5": "aging", "p6": "unknown"}


def test_page_search_filters_and_windows(spark):
    pages = [(f"p{i}", "concept" if i % 2 else "note", "active" if i < 8 else "draft", "alpha", "beta words", "beta" if i == 5 else None, i) for i in range(10)]
    pages = spark.createDataFrame(pages, "page_id string, type string, status string, tags string, body string, body_user string, epoch_day int")
    queries = spark.createDataFrame([("q", "beta words"), ("r", "nothing of this")], "query_id string, question string")
    hits = retrieval.search_pages(queries, pages, 3, ["concept"], ["active"]).collect()
    assert [r.doc_id for r in sorted(hits, key=lambda r: r["rank"])] == ["p5", "p1", "p3"] and {r.query_id for r in hits} == {"q"}
    windows = spark.createDataFrame([("q", 3, 3)], "query_id string, start_day int, end_day int")
    moved = retrieval.search_pages(queries, pages, 2, ["concept"], ["active"], windows).collect()
    assert [r.doc_id for r in sorted(moved, key=lambda r: r["rank"])] == ["p3", "p5"]


def test_vector_ranking_against_a_plain_one(spark, monkeypatch):
    """Several chunks and blocks, ties by id, vectors of two lengths, zero and null ones."""
    monkeypatch.setattr(retrieval, "CHUNK", 50)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = random.Random(3)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(4 if i % 5 else 3)] for i in range(300)}
    df = spark.createDataFrame([*vectors.items(), (999, None)], "doc_id long, vec array<double>")
    asked = df.where("doc_id % 10 = 1 or doc_id = 5").withColumnRenamed("doc_id", "query_id")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {}
    for q in [i for i in vectors if i % 10 == 1 or i == 5]:
        scored = [(-round(sum(a * b for a, b in zip(vectors[q], v, strict=True)) / (norm(vectors[q]) * norm(v)), 12), i) for i, v in vectors.items() if len(v) == len(vectors[q]) and norm(v) and norm(vectors[q])]
        want[q] = [i for s, i in sorted(scored) if s < 0][:5]
    got = {}
    for r in sorted(retrieval.rank_by_vector(asked, df, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: ids for q, ids in want.items() if ids}


def test_token_f1_counts_repeated_words(spark):
    df = spark.createDataFrame([("a a b", "a b b"), ("", ""), (None, "x"), ("A, b!", "b a")], "answer string, truth string")
    assert [round(r[0], 6) for r in df.select(T.token_f1(F.col("answer"), F.col("truth"))).collect()] == [round(2 / 3, 6), 1.0, 0.0, 1.0]


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        base = [f"word{rng.randrange(60)}" for _ in range(rng.choice([5, 40, 120]))]
        texts.append(base)
        for edits in (1, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"word{rng.randrange(60)}"
            texts.append(copy)
    counts = [Counter(t) for t in texts]
    norm = lambda c: sum(n * n for n in c.values()) ** 0.5
    want = {(i, j) for i, a in enumerate(counts) for j, b in enumerate(counts) if i < j and sum(n * b[w] for w, n in a.items()) / (norm(a) * norm(b)) >= 0.9 - 1e-9}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, text string")
    assert {(r.a, r.b) for r in consolidate.similar_pairs(df).collect()} == want and len(want) > 20


def test_similar_pairs_meet_within_tasks(spark):
    """Several blocks, and groups of which none meets another, give all pairs; no pair that is not found is dealt."""
    rng = random.Random(5)
    base = [[f"word{rng.randrange(300)}" for _ in range(30)] for _ in range(12)]
    texts = [" ".join([*words[: 30 - cut], *(f"own{i}x{j}x{cut}" for j in range(cut))]) for i, words in enumerate(base) for cut in (0, 1, 2, 9)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]

    def cosine(x, y):
        x, y = Counter(x.split()), Counter(y.split())
        return sum(n * y[w] for w, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5

    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and cosine(x, y) >= 0.9 - 1e-9}
    df = spark.createDataFrame(rows, "id long, text string, grp int")
    found = consolidate.similar_pairs(df.drop("grp"), words=300)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want) and len(want) > 12
    grouped = consolidate.similar_pairs(df, words=300).collect()
    assert sorted((r.a, r.b) for r in grouped) == sorted((a, b) for a, b in want if a % 2 == b % 2)
