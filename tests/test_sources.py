import json

from pyspark.sql import functions as F

from mnemoframe.sources import logs, pages


def test_ledger_drops_blank_lines_and_sets_bad_ones_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n<<<<<<< ours\n{"id": "y"\n{"id": "z", "n": 3}\n')
    good, bad = logs.read_ledger(spark, str(tmp_path), "id string, n long")
    assert [(r.id, r.n, r.seq) for r in good.orderBy("seq").collect()] == [("x", 1, 1), ("z", 3, 2)]
    assert sorted((r.line, r.is_conflict_marker) for r in bad.collect()) == [("<<<<<<< ours", True), ('{"id": "y"', False)]


def test_hook_events(spark):
    rows = [
        json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s", "cwd": "/w", "prompt_text": "hi"}),
        json.dumps({"type": "PostToolUse", "session_id": "s", "cwd": "/w", "tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_output": {"exitCode": 1}}),
        json.dumps({"type": "Nothing"}),
        "no json",
    ]
    raw = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, value string")
    good, bad = logs.map_hook_events(raw, F.lit("2024-01-01T00:00:00Z"))
    out = {r.seq: (r.stage, json.loads(r.payload)) for r in good.collect()}
    assert out[0] == ("prompt-submit", {"stage": "prompt-submit", "message": "hi"})
    assert out[1][1]["toolInput"] == {"command": "ls"} and out[1][0] == "tool-post"
    assert sorted(r.seq for r in bad.collect()) == [2, 3]
    assert all(len(r.hash) == 16 for r in logs.with_hash(good).collect())


def test_append_raw_by_day(spark, tmp_path):
    e = spark.createDataFrame([("tool-pre", "s", "2024-01-02T03:04:05Z", "{}")], "stage string, session_id string, timestamp_iso string, payload string")
    logs.append_raw(e, str(tmp_path / "out"))
    assert (tmp_path / "out" / "yyyy=2024" / "mm=01" / "dd=02").is_dir()


def test_transcripts_and_manifest(spark):
    lines = [
        {"type": "user", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello"}},
        {"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-01T00:01:00Z", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}},
        {"type": "system", "timestamp": "2024-01-01T00:02:00Z"},
        {"type": "user", "message": {"content": "  "}},
    ]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)], "file string, seq long, value string")
    (row,) = logs.import_transcripts(df).collect()
    assert (row.session_id, row.started_at, row.ended_at) == ("s1", "2024-01-01T00:00:00Z", "2024-01-01T00:02:00Z")
    assert [(t.role, t.content) for t in row.turns] == [("user", "hello"), ("assistant", "a\n\nb")]
    sessions = spark.createDataFrame([("s1", "password = hunter22"), ("s2", "fine")], "session_id string, body string")
    first = logs.import_new(sessions, spark.createDataFrame([], "sha256 string, imported_at string, seq long"))
    assert {r.session_id: r.body for r in first.collect()} == {"s1": "<REDACTED:password-field>", "s2": "fine"}
    manifest = first.where("session_id = 's2'").select("sha256", F.lit("2024").alias("imported_at"), F.lit(1).cast("long").alias("seq"))
    assert [r.session_id for r in logs.import_new(sessions, manifest).collect()] == ["s1"]


def test_questions(spark, tmp_path):
    good = {"question_id": "q1", "question": "what?", "haystack_session_ids": ["a", "b"], "haystack_dates": ["2023/01/10 (Tue)", "2023/03/05 (Sun)"], "haystack_sessions": [[{"role": "user", "content": "x"}], []], "answer_session_ids": ["a"]}
    bad = [good | {"question_id": "../../etc/passwd"}, good | {"question_id": "q3", "haystack_dates": ["x"]}, {"question_id": "q4"}]
    (tmp_path / "q.json").write_text(json.dumps([good, *bad]))
    rows, rejected = logs.read_questions(spark, str(tmp_path / "q.json"))
    assert [(r.question_id, r.seq, r.session_id, r.question_type) for r in rows.orderBy("seq").collect()] == [("q1", 0, "a", "unknown"), ("q1", 1, "b", "unknown")]
    assert {r.question_id: r.reject for r in rejected.collect()} == {"../../etc/passwd": "bad id", "q3": "arrays of unequal length", "q4": "missing field"}


def skill(**more):
    return {
        "ssl_version": "0.3.1", "slug": "a", "seq": 1, "scheduling": {"id": "a#scheduling", "skill_name": "A", "control_flow_features": ["loop"]},
        "structural": [{"id": "a#s1", "scene": "ACT", "summary": "do", "contains_logical_ids": ["a#l1"], "transitions_to": []}],
        "logical": [{"id": "a#l1", "action": "WRITE", "resources": ["NETWORK"], "action_ref": "canon.post"}], "protocols": [{"id": "a#p1", "delegate_to": "b", "when": "late"}],
    } | more


def test_skills(spark, tmp_path):
    bad = skill(slug="b", ssl_version="0.2", structural=[{"id": "b#s1", "scene": "NOWHERE", "contains_logical_ids": ["gone"], "transitions_to": ["gone"]}])
    bad["interactions"] = [{"id": "b#i1", "prompt": "?", "expected_response_type": "selection", "scope_ref": "gone"}]
    (tmp_path / "s.json").write_text(json.dumps([skill(), bad]))
    good, errors = logs.read_skills(spark, str(tmp_path / "s.json"))
    assert [r.slug for r in good.collect()] == ["a"]
    (row,) = errors.collect()
    assert len(row.errors) == 6 and row.slug == "b"
    canonical = spark.createDataFrame([("canon.post", "READ", ["NETWORK", "MEMORY"])], "action_ref string, action string, resources array<string>")
    _, errors = logs.read_skills(spark, str(tmp_path / "s.json"), canonical)
    assert [len(r.errors) for r in errors.where("slug = 'a'").collect()] == [2]


def test_changed_sources(spark):
    files = spark.createDataFrame([("a", "one", None), ("b", "two", ["odd"]), ("c", "old", None)], "path string, content string, warnings array<string>")
    prior = spark.createDataFrame([("old",)], "c string").select(F.sha2("c", 256).alias("sha256"))
    direct, review = logs.changed_sources(files, prior)
    assert [r.path for r in direct.collect()] == ["a"] and [r.path for r in review.collect()] == ["b"]


def test_pages(spark, tmp_path):
    (tmp_path / "concepts" / "_old").mkdir(parents=True)
    head = "---\nid: concept.a\ntype: concept\nstatus: active\nupdatedAt: '2024-01-01'\ntags: [x, y]\n---\n"
    (tmp_path / "concepts" / "a.md").write_text(head + "# Title A\n\n## Summary\nFirst one. Second.\n\nSee [[concept.b]] and [[gone]].\n\n## Evidence list\n- one\n- two\n\n## Next\n- no\n<!-- claim:cl-7 -->\n")
    (tmp_path / "concepts" / "b.md").write_text(head.replace("concept.a", "concept.b") + "# B\n")
    (tmp_path / "concepts" / "bad.md").write_text("---\nid: only\n---\nx")
    (tmp_path / "concepts" / "_old" / "c.md").write_text(head.replace("concept.a", "concept.c"))
    (tmp_path / "README.md").write_text("note")
    (tmp_path / "my note.md").write_text("intro\n## One\nx\n## \n\n## Two\ny")
    df = pages.read_pages(spark, str(tmp_path))
    ids = {r.page_id: r for r in df.collect()}
    assert set(ids) == {"concept.a", "concept.b", "note.my-note", "note.README"}  # Spark reads no folder named _...
    assert ids["concept.a"].tags == ["x", "y"] and ids["note.my-note"].status == "draft"
    scoped = pages.index_scope(pages.chunk_notes(df))
    assert sorted(r.page_id for r in scoped.collect()) == ["concept.a", "concept.b", "note.my-note.1", "note.my-note.2", "note.my-note.3", "note.my-note.4"]
    relative = df.withColumn("path", F.regexp_extract("path", r"(concepts/.*|[^/]+)$", 1)).where("page_id like 'concept.%'")
    docs = {r.page_id: r for r in pages.exchange_documents(relative, only_live=True).collect()}
    a = docs["concept.a"]
    assert (a.title, a.description, a.dir) == ("Title A", "First one.", "concepts")
    assert "[concept.b](/concepts/b.md)" in a.body and "[[gone]]" in a.body
    pages.export_bundle(relative, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "root")).first().n == 2


def test_questions_in_parts(spark, tmp_path):
    """One array without line ends is split at its records' starts; quotes inside strings are no starts."""
    odd = 'says {"question_id": "no"} and }, {'
    rows = [{"question_id": f"q{i}", "question": odd, "haystack_session_ids": ["a"], "haystack_sessions": [[{"role": "user", "content": odd * (i % 3)}]], "answer_session_ids": []} for i in range(50)]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    whole, _ = logs.read_questions(spark, str(tmp_path / "q.json"))
    parts, rejected = logs.read_questions(spark, str(tmp_path / "q.json"), logs.RECORD_START)
    key = lambda df: sorted((r.question_id, r.question, r.turns[0].content) for r in df.collect())
    assert key(parts) == key(whole) and len(key(whole)) == 50 and rejected.count() == 0


def test_skills_as_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join(json.dumps(x) for x in (skill(), skill(slug="c"), skill(slug="b", ssl_version="0.2"))))
    good, errors = logs.read_skills(spark, str(tmp_path / "s.json"), lines=True)
    assert sorted(r.slug for r in good.collect()) == ["a", "c"] and [r.slug for r in errors.collect()] == ["b"]
