"""Queries over sources and documents: files are written from the given tables by Spark and read back by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.functions.helpers import saved, scratch
from mnemoframe.operators import flow, govern, graph, ledger, metrics, retrieval
from mnemoframe.sources import logs, pages

from .base import EVENTS, PAIRS, delegation_pairs, events, query, table

TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


@query(f"""WITH {EVENTS} SELECT event_id AS seq, user_id, event_type, NULL AS line, NULL AS is_conflict_marker, 1 AS n FROM ev WHERE event_id % 50 <> 0 AND event_id % 41 <> 0 AND event_id % 37 <> 0
UNION ALL SELECT NULL, NULL, NULL, '<<<<<<< ours', true, count(*) FROM ev WHERE event_id % 50 <> 0 AND event_id % 41 = 0 HAVING count(*) > 0
UNION ALL SELECT NULL, NULL, NULL, '{{"seq": ', false, count(*) FROM ev WHERE event_id % 50 <> 0 AND event_id % 41 <> 0 AND event_id % 37 = 0 HAVING count(*) > 0""")
def s1_read_ledger(spark, sf_dir):
    e = events(spark, sf_dir)
    at = F.col("event_id")
    line = F.when(at % 50 == 0, "  ").when(at % 41 == 0, "<<<<<<< ours").when(at % 37 == 0, '{"seq": ').otherwise(F.to_json(F.struct(at.alias("seq"), "user_id", "event_type")))
    path = scratch(spark, "ledger")
    e.select(line.alias("value")).write.text(path)
    good, bad = logs.read_ledger(spark, path, "seq long, user_id long, event_type string")
    bad = bad.groupBy("line", "is_conflict_marker").agg(F.count("*").alias("n"))
    return good.select("seq", "user_id", "event_type", F.lit(1).cast("long").alias("n")).unionByName(bad, allowMissingColumns=True)


HOOKS = (
    EVENTS
    + """, hooks AS (SELECT event_id, user_id, ts, k, event_type,
 CASE event_type WHEN 'signup' THEN 'session-start' WHEN 'click' THEN 'tool-post' WHEN 'view' THEN 'prompt-submit' END AS stage,
 CASE WHEN event_type = 'click' THEN CASE k % 3 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' ELSE 'Other' END END AS tool FROM ev)"""
)


def _payloads(spark, sf_dir):
    """A raw payload for each event: known and unknown types, and text that is no JSON."""
    e = events(spark, sf_dir)
    session = F.concat(F.lit("s"), "user_id")
    name = F.when(F.col("event_type") == "signup", "SessionStart").when(F.col("event_type") == "click", "PostToolUse").when(F.col("event_type") == "view", "UserPromptSubmit").otherwise("Nothing")
    tool = F.when(F.col("k") % 3 == 0, "Bash").when(F.col("k") % 3 == 1, "Read").otherwise("Other")
    body = F.struct(
        name.alias("hook_event_name"), session.alias("session_id"), F.lit("/w").alias("cwd"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("ask "), "k", F.lit(" password=abcd"), "k")).alias("prompt_text"),
        F.when(F.col("event_type") == "click", tool).alias("tool_name"),
        F.when(F.col("event_type") == "click", F.struct(F.concat(F.lit("run "), "k").alias("command"), F.concat(F.lit("/f"), "k").alias("file_path"))).alias("tool_input"),
        F.when(F.col("event_type") == "click", F.struct((F.col("k") % 2).alias("exitCode"))).alias("tool_output"),
    )
    return e.select("event_id", "ts", F.when(F.col("event_type") == "error", "oops {").otherwise(F.to_json(body)).alias("value"))


def _hooks(spark, sf_dir):
    return logs.map_hook_events(_payloads(spark, sf_dir), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query(f"WITH {HOOKS} SELECT event_id, stage, CASE WHEN stage IS NOT NULL THEN 's' || user_id END AS session_id, CASE WHEN stage = 'prompt-submit' THEN 'ask ' || k || ' password=abcd' || k END AS message, tool, CASE WHEN stage = 'tool-post' THEN 'run ' || k END AS command, CASE WHEN stage IS NOT NULL THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS made_at FROM hooks")
def s2_map_hook_events(spark, sf_dir):
    good, bad = _hooks(spark, sf_dir)
    part = lambda p: F.get_json_object("payload", f"$.{p}")
    rows = good.select("event_id", "stage", "session_id", part("message").alias("message"), part("toolName").alias("tool"), part("toolInput.command").alias("command"), F.col("timestamp_iso").alias("made_at"))
    return rows.unionByName(bad.select("event_id"), allowMissingColumns=True)


@query(f"""WITH {EVENTS}, x AS (SELECT 'tool-pre' AS stage, 's' || user_id AS session_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS made_at, strftime(ts, '%Y-%m-%d') AS day, k FROM ev)
SELECT session_id, made_at, day, left(sha256('{{"stage":"tool-pre","session_id":"' || session_id || '","timestamp_iso":"' || made_at || '","payload":"' || k || '"}}'), 16) AS hash FROM x""")
def s3_append_raw(spark, sf_dir):
    e = events(spark, sf_dir).select(F.lit("tool-pre").alias("stage"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_iso"), F.col("k").cast("string").alias("payload"))
    path = scratch(spark, "raw")
    logs.append_raw(e.where("cast(payload as long) % 2 = 0"), path)
    logs.append_raw(e.where("cast(payload as long) % 2 = 1"), path)
    read = spark.read.schema("session_id string, timestamp_iso string, hash string, yyyy string, mm string, dd string").json(path)
    return read.select("session_id", F.col("timestamp_iso").alias("made_at"), F.concat_ws("-", "yyyy", "mm", "dd").alias("day"), "hash")


@query("""WITH p AS (SELECT *, page_id % 7 = 0 AS note, page_id % 11 = 0 AS broken FROM pages)
SELECT CASE WHEN note THEN 'note.p' || page_id ELSE 'page.' || page_id END AS id, CASE WHEN note THEN 'note' ELSE 'concept' END AS type, CASE WHEN note THEN 'draft' ELSE 'active' END AS status, CASE WHEN note THEN '' ELSE '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS updated_at,
 CASE WHEN note THEN '' ELSE 't' || (page_id % 3) || ',all' END AS tags, CASE WHEN NOT note THEN (page_id % 10) / 10 END AS confidence, md5(coalesce(html, '')) AS body FROM p WHERE note OR NOT broken""")
def s4_read_pages(spark, sf_dir):
    """Markdown with heads made from web pages; every seventh is a note, every eleventh lacks a member of its head."""
    at = F.col("page_id")
    head = F.concat(
        F.lit("---\n"), F.when(at % 11 != 0, F.concat(F.lit("id: page."), at, F.lit("\n"))).otherwise(""), F.lit("type: concept\nstatus: active\nupdatedAt: '2024-01-"), F.lpad((at % 28 + 1).cast("string"), 2, "0"),
        F.lit("'\ntags: [t"), at % 3, F.lit(", all]\nconfidence: "), (at % 10) / 10, F.lit("\n---\n"),
    )
    raw = table(spark, sf_dir, "pages").select(F.concat(F.lit("concepts/p"), at, F.lit(".md")).alias("path"), F.concat(F.when(at % 7 == 0, "").otherwise(head), F.coalesce("html", F.lit(""))).alias("value"))
    return pages.parse_pages(raw).select(F.col("page_id").alias("id"), "type", "status", "updated_at", F.array_join("tags", ",").alias("tags"), "confidence", F.md5("body").alias("body"))


def _notes(spark, sf_dir):
    """A note of four parts (one blank), a note of one part and another page in turn, from conversations' turns."""
    c = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 1000 + F.col("turn")
    many = F.concat(F.lit("start "), at, F.lit("\n## One\n"), F.lit("x"), at, F.lit("\n## \n \n## Two\ny"))
    return c.select(F.concat(F.lit("n"), at).alias("page_id"), F.when(at % 3 == 2, "concept").otherwise("note").alias("type"), F.when(at % 3 == 1, F.concat(F.lit("start "), at)).otherwise(many).alias("body"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS x FROM conversations) SELECT 'n' || x || '.1' AS page_id, 'start ' || x AS body FROM c WHERE x % 3 = 0 UNION ALL SELECT 'n' || x || '.2', E'## One\\nx' || x FROM c WHERE x % 3 = 0
UNION ALL SELECT 'n' || x || '.3', E'## \\n ' FROM c WHERE x % 3 = 0 UNION ALL SELECT 'n' || x || '.4', E'## Two\\ny' FROM c WHERE x % 3 = 0 UNION ALL SELECT 'n' || x, 'start ' || x FROM c WHERE x % 3 = 1
UNION ALL SELECT 'n' || x, 'start ' || x || E'\\n## One\\nx' || x || E'\\n## \\n \\n## Two\\ny' FROM c WHERE x % 3 = 2""")
def s5_chunk_notes(spark, sf_dir):
    return pages.chunk_notes(_notes(spark, sf_dir)).select("page_id", "body")


@query(r"""WITH p AS (SELECT doc_id, (['concepts', 'drafts', 'decisions', '_old/concepts', 'patterns'])[doc_id % 5 + 1] || '/' || (['a', '_b', 'README', 'c'])[doc_id % 4 + 1] || '.md' AS path, doc_id % 6 = 0 AS note FROM documents)
SELECT doc_id, path FROM p WHERE (note OR regexp_matches(path, '(^|/)(concepts|decisions|projects|profile|evidence|patterns)/')) AND NOT regexp_matches(path, '(^|/)_') AND NOT regexp_matches(path, '(?i)(^|/)readme\.md$')""")
def s6_index_scope(spark, sf_dir):
    at = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    path = F.concat(pick(["concepts", "drafts", "decisions", "_old/concepts", "patterns"]), F.lit("/"), pick(["a", "_b", "README", "c"]), F.lit(".md"))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.when(at % 6 == 0, "note").otherwise("concept").alias("type"))
    return pages.index_scope(rows).select("doc_id", "path")


@query("""WITH l AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE trim(text || chr(10) || chr(10) || 'more') END AS content FROM conversations)
SELECT 'f' || conv_id AS file, 's' || conv_id AS session_id, '2024-01-01T' || lpad(CAST(min(turn) AS VARCHAR), 5, '0') AS started_at, '2024-01-01T' || lpad(CAST(max(turn) AS VARCHAR), 5, '0') AS ended_at,
 count(*) FILTER (role IN ('user', 'assistant') AND content <> '') AS n, string_agg(role || ': ' || content, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant') AND content <> '') AS turns FROM l GROUP BY conv_id HAVING count(*) FILTER (role IN ('user', 'assistant') AND content <> '') > 0""")
def s7_import_transcripts(spark, sf_dir):
    """Transcript lines from conversations; every second turn's content is an array of blocks."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("tool_use", F.lit("no")), block("text", F.lit("more")))
    at = F.concat(F.lit("2024-01-01T"), F.lpad(F.col("turn").cast("string"), 5, "0"))
    head = [F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), at.alias("timestamp")]
    value = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(*head, F.struct(F.col("text").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(*head, F.struct(blocks.alias("content")).alias("message"))))
    found = logs.import_transcripts(c.select(F.concat(F.lit("f"), "conv_id").alias("file"), F.col("turn").alias("seq"), value.alias("value")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    return found.select("file", "session_id", "started_at", "ended_at", F.size("turns").cast("long").alias("n"), lines.alias("turns"))


REDACTED = r"""red AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)password\s*[=:]\s*["'']?[^\s"'']{4,}', '<REDACTED:password-field>', 'g'), '(?i)(?:secret|token|apikey|api_key)\s*[=:]\s*["'']?[^\s"'']{8,}', '<REDACTED:generic-secret>', 'g') AS body FROM documents)"""


@query(f"WITH {REDACTED} SELECT doc_id AS session_id, sha256(body) AS sha256, length(body) AS n FROM red WHERE sha256(body) NOT IN (SELECT sha256(body) FROM red WHERE doc_id % 3 = 0)")
def s8_import_new(spark, sf_dir):
    sessions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("body"))
    known = logs.redact(sessions.where("session_id % 3 = 0"), "body")
    manifest = known.select(F.sha2("body", 256).alias("sha256"), F.lit("2024-01-01").alias("imported_at"), F.col("session_id").alias("seq"))
    return logs.import_new(sessions, manifest).select("session_id", "sha256", F.length("body").alias("n"))


@query("""WITH q AS (SELECT b.item_id, d.doc_id, d.text FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS seq FROM q)
SELECT 'q' || item_id AS question_id, seq, 'd' || doc_id AS session_id, text, CAST(NULL AS VARCHAR) AS reject FROM n WHERE item_id % 5 <> 0 UNION ALL SELECT DISTINCT 'q/' || item_id, NULL, NULL, NULL, 'bad id' FROM n WHERE item_id % 5 = 0""")
def s9_read_questions(spark, sf_dir):
    """A question file: arrays written by Spark without line ends, read in parts at the records' starts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    n = b.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("item_id"), "doc_id", "text")
    own = docs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("s"))
    record = F.struct(
        F.concat(F.when(F.col("item_id") % 5 == 0, "q/").otherwise("q"), "item_id").alias("question_id"), F.col("question"), F.transform("s", lambda x: F.concat(F.lit("d"), x["doc_id"])).alias("haystack_session_ids"),
        F.transform("s", lambda x: F.array(F.struct(F.lit("user").alias("role"), x["text"].alias("content")))).alias("haystack_sessions"),
    )
    path = scratch(spark, "questions")
    b.join(own, "item_id").select(F.to_json(record).alias("value")).write.option("lineSep", ", ").text(path)
    good, rejected = logs.read_questions(spark, path, logs.RECORD_START)
    rows = good.select("question_id", F.col("seq").cast("long").alias("seq"), "session_id", F.col("turns")[0]["content"].alias("text"))
    return rows.unionByName(rejected.select("question_id", "reject"), allowMissingColumns=True)


def _skills(spark, sf_dir):
    """Skill documents from suppliers, with faults in some."""
    s, at = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    slug = F.concat(F.lit("skill"), at)
    own = lambda x: F.concat(slug, F.lit(f"#{x}"))
    texts = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    structural = F.array(
        F.struct(own("s1").alias("id"), F.lit("PREPARE").alias("scene"), F.lit("get ready").alias("summary"), F.array(own("l1")).alias("contains_logical_ids"), F.array(own("s2")).alias("transitions_to")),
        F.struct(own("s2").alias("id"), F.when(at % 8 == 0, "NOWHERE").otherwise("ACT").alias("scene"), F.lit("do it").alias("summary"), F.array(F.when(at % 6 == 0, "gone").otherwise(own("l2"))).alias("contains_logical_ids"), texts().alias("transitions_to")),
    )
    logical = F.array(
        F.struct(own("l1").alias("id"), F.lit("READ").alias("action"), texts("MEMORY").alias("resources"), F.lit("read").alias("description"), F.lit(None).cast("string").alias("instructions"), F.lit(None).cast("string").alias("action_ref")),
        F.struct(own("l2").alias("id"), F.lit("WRITE").alias("action"), texts("NETWORK").alias("resources"), F.lit("write").alias("description"), F.lit(None).cast("string").alias("instructions"), F.when(at % 4 == 0, "canon.post").alias("action_ref")),
    )
    some = lambda condition, item: F.when(condition, F.array(item)).otherwise(F.array().cast("array<void>"))
    columns = {
        "ssl_version": F.when(at % 10 == 0, "0.2").otherwise("0.3.1"), "slug": slug, "seq": at.cast("long"),
        "scheduling": F.struct(own("scheduling").alias("id"), F.col("s_name").alias("skill_name"), F.lit(None).cast("string").alias("intent_signature"), F.array(F.when(at % 9 == 0, "warp").otherwise("loop")).alias("control_flow_features")),
        "structural": structural, "logical": logical,
        "decisions": some(at % 5 == 0, F.struct(own("d1").alias("id"), F.lit("which?").alias("question"), texts().alias("branches"), own("s1").alias("scope_ref"))),
        "interactions": F.array().cast("array<struct<id:string,prompt:string,expected_response_type:string,options:array<string>,scope_ref:string>>"),
        "evidence": some(at % 3 == 0, F.struct(own("e1").alias("id"), F.lit("case").alias("case_label"), texts().alias("success_criteria"), own("l1").alias("scope_ref"))),
        "protocols": some(at % 2 == 0, F.struct(own("p1").alias("id"), F.concat(F.lit("skill"), at * 2).alias("delegate_to"), F.lit("late").alias("when"), F.lit(None).cast("string").alias("scope_ref"))),
    }
    return s.select(*(c.alias(n) for n, c in columns.items()))


#: What is wrong with each skill document, in the order of the checks.
FAULTS = """f AS (SELECT s_suppkey AS k, list_filter([CASE WHEN s_suppkey % 10 = 0 THEN 'version is not 0.3.x: 0.2' END, CASE WHEN s_suppkey % 9 = 0 THEN 'unknown control flow feature warp' END,
 CASE WHEN s_suppkey % 8 = 0 THEN 'structural skill' || s_suppkey || '#s2: unknown scene NOWHERE' END, CASE WHEN s_suppkey % 6 = 0 THEN 'structural skill' || s_suppkey || '#s2: dangling logical gone' END,
 CASE WHEN s_suppkey % 5 = 0 THEN 'decision skill' || s_suppkey || '#d1: no branches' END{more}], lambda x: x IS NOT NULL) AS e FROM supplier)"""
CANON = ", CASE WHEN s_suppkey % 4 = 0 THEN 'logical skill' || s_suppkey || '#l2: action ref canon.post misses [QUEUE] and adds []' END"


@query(f"WITH {FAULTS.format(more='')} SELECT 'skill' || k AS slug, array_to_string(e, '; ') AS errors FROM f")
def s10_read_skills(spark, sf_dir):
    path = scratch(spark, "skills")
    _skills(spark, sf_dir).write.json(path)
    good, bad = logs.read_skills(spark, path, lines=True)
    return good.select("slug", F.lit("").alias("errors")).unionByName(bad.select("slug", F.array_join("errors", "; ").alias("errors")))


@query(f"WITH {FAULTS.format(more=CANON)} SELECT 'skill' || k AS slug, array_to_string(e, '; ') AS errors FROM f")
def p8_validate_skills(spark, sf_dir):
    canonical = spark.range(1).select(F.lit("canon.post").alias("action_ref"), F.lit("WRITE").alias("action"), F.array(F.lit("NETWORK"), F.lit("QUEUE")).alias("resources"))
    return govern.validate_skills(_skills(spark, sf_dir), canonical).select("slug", F.array_join("errors", "; ").alias("errors"))


@query("SELECT count(*) AS skills, 2 * count(*) AS structural, 2 * count(*) AS logical, round(count(*) FILTER (s_suppkey % 4 = 0) * 100 / (2 * count(*)), 1) AS ref_percent, round(avg(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END), 6) AS decisions_fill, 0.0 AS interactions_fill, round(avg(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END), 6) AS evidence_fill, round(avg(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END), 6) AS protocols_fill FROM supplier")
def a13_skill_stats(spark, sf_dir):
    out = govern.skill_stats(_skills(spark, sf_dir))
    return out.select("skills", "structural", "logical", "ref_percent", *(F.round(c, 6).alias(c) for c in out.columns if c.endswith("_fill")))


@query("""WITH k AS (SELECT s_suppkey AS k, 'skill' || s_suppkey AS s, s_name FROM supplier) SELECT 'node' AS kind, s || '#scheduling' AS a, s AS b, 'scheduling' AS c, s_name AS d FROM k
UNION ALL SELECT 'node', s || '#s1', s, 'structural', 'get ready' FROM k UNION ALL SELECT 'node', s || '#s2', s, 'structural', 'do it' FROM k UNION ALL SELECT 'node', s || '#l1', s, 'logical', 'read' FROM k UNION ALL SELECT 'node', s || '#l2', s, 'logical', 'write' FROM k
UNION ALL SELECT 'node', s || '#d1', s, 'decision', 'which?' FROM k WHERE k % 5 = 0 UNION ALL SELECT 'node', s || '#e1', s, 'evidence', 'case' FROM k WHERE k % 3 = 0 UNION ALL SELECT 'node', s || '#p1', s, 'protocol', 'skill' || (k * 2) FROM k WHERE k % 2 = 0
UNION ALL SELECT DISTINCT 'node', 'canon.post', '', 'canonical-action', 'canon.post' FROM k WHERE k % 4 = 0
UNION ALL SELECT 'edge', s || '#scheduling', s || '#s1', 'HAS_SCENE', NULL FROM k UNION ALL SELECT 'edge', s || '#scheduling', s || '#s2', 'HAS_SCENE', NULL FROM k UNION ALL SELECT 'edge', s || '#s1', s || '#l1', 'CONTAINS', NULL FROM k UNION ALL SELECT 'edge', s || '#s2', CASE WHEN k % 6 = 0 THEN 'gone' ELSE s || '#l2' END, 'CONTAINS', NULL FROM k
UNION ALL SELECT 'edge', s || '#s1', s || '#s2', 'TRANSITIONS_TO', NULL FROM k UNION ALL SELECT 'edge', s || '#l2', 'canon.post', 'USES_ACTION', NULL FROM k WHERE k % 4 = 0 UNION ALL SELECT 'edge', s || '#d1', s || '#s1', 'SCOPED_TO', NULL FROM k WHERE k % 5 = 0
UNION ALL SELECT 'edge', s || '#e1', s || '#l1', 'SCOPED_TO', NULL FROM k WHERE k % 3 = 0 UNION ALL SELECT 'edge', s || '#p1', 'skill' || (k * 2), 'DELEGATES_TO', '{"whenCondition":"late"}' FROM k WHERE k % 2 = 0""")
def g1_project_graph(spark, sf_dir):
    nodes, edges = graph.project_graph(_skills(spark, sf_dir))
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("slug").alias("b"), F.col("node_type").alias("c"), F.col("label").alias("d"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("relation").alias("c"), F.col("properties").alias("d")))


EXPORTED = "x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'gone' END AS status, (['concepts', 'decisions'])[page_id % 2 + 1] AS dir FROM pages), live AS (SELECT * FROM x WHERE status <> 'gone')"


def _exported(spark, sf_dir):
    at = F.col("page_id")
    folder = F.when(at % 2 == 0, "concepts").otherwise("decisions")
    body = F.concat(F.lit("# Title "), at, F.lit("\n\n## Summary\nFirst "), at, F.lit(". Second.\n\nSee [[page."), at + 1, F.lit("]] and [[gone]].\n"))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page."), at).alias("page_id"), F.concat(folder, F.lit("/p"), at, F.lit(".md")).alias("path"), F.lit("concept").alias("type"), F.when(at % 3 == 0, "active").when(at % 3 == 1, "draft").otherwise("gone").alias("status"),
        F.lit("2024-01-01").alias("updated_at"), F.array(F.lit("t")).alias("tags"), body.alias("body"),
    )


@query(f"WITH {EXPORTED} SELECT 'page.' || page_id AS page_id, dir, 'Title ' || page_id AS title, 'First ' || page_id || '.' AS description, status AS x_status, (SELECT count(*) FROM live y WHERE y.dir = live.dir) AS in_dir FROM live")
def s11_export_bundle(spark, sf_dir):
    path = scratch(spark, "bundle")
    pages.export_bundle(_exported(spark, sf_dir), path, only_live=True)
    docs = spark.read.schema("page_id string, title string, description string, x_status string, dir string").json(f"{path}/documents")
    return docs.join(spark.read.schema("dir string, n long").json(f"{path}/root").withColumnRenamed("n", "in_dir"), "dir").select("page_id", "dir", "title", "description", "x_status", "in_dir")


@query("SELECT doc_id, doc_id % 4 = 1 AS review FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def s12_changed_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("odd"))).alias("warnings"))
    direct, review = logs.changed_sources(files, d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256")))
    return direct.select("doc_id", F.lit(False).alias("review")).unionByName(review.select("doc_id", F.lit(True).alias("review")))


@query(f"WITH {HOOKS} SELECT event_id, stage FROM hooks WHERE stage IS NOT NULL AND event_id % 6 <> 0 AND event_id % 10 <> 0")
def p1_valid_events(spark, sf_dir):
    """Canonical events of which some lack a required member."""
    good, _ = _hooks(spark, sf_dir)
    faulty = good.withColumns({"cwd": F.when(F.col("event_id") % 6 != 0, F.col("cwd")), "payload": F.when(F.col("event_id") % 10 != 0, F.col("payload"))})
    return ledger.valid_events(faulty).select("event_id", "stage")


@query(f"""WITH {HOOKS} SELECT 's' || user_id AS session_id, event_id AS seq, CASE stage WHEN 'tool-post' THEN 'tool:' || tool WHEN 'prompt-submit' THEN 'user-intent' ELSE stage END AS type, stage = 'prompt-submit' OR coalesce(tool = 'Other', false) AS needs_analysis,
 CASE WHEN tool = 'Bash' THEN 'run ' || k END AS command, CASE WHEN tool = 'Bash' THEN k % 2 END AS exit_code, CASE WHEN tool = 'Read' THEN '/f' || k END AS file, CASE WHEN stage = 'prompt-submit' THEN 'ask ' || k || ' <REDACTED:password-field>' END AS intent FROM hooks WHERE stage IS NOT NULL""")
def p2_normalize_observations(spark, sf_dir):
    good, _ = _hooks(spark, sf_dir)
    part = lambda p: F.get_json_object("data", f"$.{p}")
    out = ledger.normalize_observations(good.withColumn("seq", F.col("event_id")))
    return out.select("session_id", "seq", "type", "needs_analysis", part("command").alias("command"), part("exitCode").cast("long").alias("exit_code"), part("filesRead[0]").alias("file"), part("userIntentRaw").alias("intent"))


@query("""SELECT p_partkey AS slug, 'Makes ' || p_partkey || ',Fast' AS intents, CASE WHEN p_partkey % 2 = 0 THEN 'branching,' ELSE '' END || 'scheduled_retry' AS features, 'git,t' || (p_partkey % 5) AS dependencies, 'PREPARE>' || p_partkey || '#s2,ACT>' || p_partkey || '#s3,' || CASE WHEN p_partkey % 3 = 0 THEN 'VERIFY>' ELSE 'REASON>' END AS scenes FROM part""")
def p19_normalize_skills(spark, sf_dir):
    at = F.col("p_partkey")
    body = F.concat(F.lit("# Title\n## Setup\nuse `git`\n## Run steps\n"), F.when(at % 2 == 0, "if so ").otherwise(""), F.lit("retry `t"), at % 5, F.lit("`\n## "), F.when(at % 3 == 0, "Check").otherwise("Other"), F.lit("\n"))
    rows = table(spark, sf_dir, "part").select(at.alias("slug"), F.concat(F.lit("Makes "), at, F.lit(". Fast")).alias("description"), body.alias("body"))
    scenes = F.array_join(F.transform("scenes", lambda s: F.concat_ws(">", s["scene"], F.array_join(s["transitions_to"], ","))), ",")
    return govern.normalize_skills(rows).select("slug", *(F.array_join(c, ",").alias(c) for c in ("intents", "features", "dependencies")), scenes.alias("scenes"))


@query("SELECT d.doc_id AS question_id, d.lang AS type, l.quality = 1 AS correct FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 7 <> 0")
def j9_join_judgments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    questions = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("type"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("correct"))
    return metrics.join_judgments(d.select(F.col("doc_id").alias("question_id"), F.col("text").alias("answer")), judged, questions).select("question_id", "type", "correct")


@query(f"WITH {EVENTS} SELECT event_id AS bundle_id, CASE WHEN k % 3 = 0 THEN 'attach' WHEN k % 3 = 1 THEN 'discard' ELSE 'open' END AS action, CASE WHEN k % 3 = 0 THEN user_id END AS new_problem_id FROM ev WHERE user_id % 4 = 0 AND event_type <> 'error'")
def j13_attribute_orphans(spark, sf_dir):
    e = events(spark, sf_dir)
    bundles = e.select(F.col("event_id").alias("bundle_id"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("problem_id"), F.when(F.col("event_type") == "error", F.col("ts")).alias("processed_at"))
    mapping = e.where("k % 3 = 0").select(F.col("event_id").alias("bundle_id"), F.col("user_id").alias("new_problem_id"))
    discard = e.where("k % 3 = 1").select(F.col("event_id").alias("bundle_id"), F.lit("noise").alias("reason"))
    return flow.orphan_bundles(bundles, mapping, discard).select("bundle_id", "action", "new_problem_id")


@query(f"WITH {EVENTS} SELECT event_type AS mode, count(*) AS n, round(avg(CASE WHEN k % 4 = 0 THEN 0 WHEN k % 7 + 1 <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN k % 4 = 0 THEN 0 WHEN k % 7 + 1 <= 3 THEN 1 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN k % 4 = 0 THEN 0 WHEN k % 7 + 1 <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN k % 4 = 0 THEN 0 ELSE 1 / (k % 7 + 1) END), 6) AS mrr FROM ev GROUP BY 1")
def a17_search_bench(spark, sf_dir):
    """Events as queries: the relevant result is at rank k % 7 + 1, or nowhere."""
    e = events(spark, sf_dir)
    ranked = e.select(F.col("event_type").alias("mode"), F.col("event_id").alias("query_id"), F.when(F.col("k") % 4 != 0, "good").otherwise("other").alias("doc_id"), (F.col("k") % 7 + 1).cast("int").alias("rank"))
    evidence = e.select(F.col("event_id").alias("query_id"), F.lit("good").alias("doc_id"))
    out = metrics.search_bench(metrics.evidence_ranks(ranked, evidence, ("mode", "query_id")))
    return out.select("mode", "n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")))


LANES = "l AS (SELECT event_id, k, CASE k % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS want, CASE k % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['b', 'c'] WHEN 2 THEN ['a', 'b', 'c'] ELSE CAST([] AS VARCHAR[]) END AS got FROM ev)"


def _lanes(spark, sf_dir):
    arrays = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    k = F.col("k")
    want = F.when(k % 3 == 0, arrays("a")).when(k % 3 == 1, arrays("a", "b")).otherwise(arrays())
    got = F.when(k % 4 == 0, arrays("a")).when(k % 4 == 1, arrays("b", "c")).when(k % 4 == 2, arrays("a", "b", "c")).otherwise(arrays())
    return events(spark, sf_dir).select("event_id", want.alias("expect_lanes"), got.alias("lanes"), F.when(k % 2 == 0, arrays("f")).otherwise(arrays()).alias("expect_files"), F.when(k % 6 == 0, arrays("f", "g")).otherwise(arrays("g")).alias("files"))


@query(f"WITH {EVENTS}, {LANES}, x AS (SELECT *, len(list_intersect(want, got)) AS s FROM l) SELECT count(*) AS n, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS lane_hit, round(avg(CASE WHEN len(got) > 0 THEN s / len(got) ELSE 0 END), 6) AS precision, round(avg(CASE WHEN len(want) > 0 THEN s / len(want) ELSE 1 END), 6) AS recall, round(avg(CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END END), 6) AS file_hit FROM x")
def a18_router_bench(spark, sf_dir):
    out = metrics.router_bench(_lanes(spark, sf_dir))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("lane_hit", "precision", "recall", "file_hit")))


@query(f"WITH {EVENTS}, {LANES} SELECT event_id, array_to_string(list_filter(want, lambda x: list_contains(got, x)), ',') AS right_lanes, array_to_string(list_filter(want, lambda x: NOT list_contains(got, x)), ',') AS missing_lanes, array_to_string(list_filter(got, lambda x: NOT list_contains(want, x)), ',') AS extra_lanes FROM l")
def u3_lane_sets(spark, sf_dir):
    out = metrics.lane_sets(_lanes(spark, sf_dir))
    return out.select("event_id", *(F.array_join(c, ",").alias(c) for c in ("right_lanes", "missing_lanes", "extra_lanes")))


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag || '|' || l_linestatus AS signature FROM lineitem WHERE l_returnflag || '|' || l_linestatus NOT IN (SELECT DISTINCT 'R|' || o_orderstatus FROM orders)")
def u3_unknown_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("signature"))
    known = table(spark, sf_dir, "orders").select(F.concat(F.lit("R|"), "o_orderstatus").alias("signature"))
    return govern.unknown_signatures(rows, known).select("order_id", "line", "signature")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS superseded, round(avg(CASE WHEN doc_id % 5 <> 0 AND length(text) > 0 THEN ceil(least(length(text), 40 + doc_id % 60) / 4) / ceil(length(text) / 4) END), 6) AS mean_ratio FROM documents")
def a22_consolidation_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("text", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).alias("superseded_by"), F.col("text").substr(F.lit(1), (40 + F.col("doc_id") % 60).cast("int")).alias("core"))
    return metrics.consolidation_stats(rows).select("total", "superseded", F.round("mean_ratio", 6).alias("mean_ratio"))


@query("SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f4_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", "embedding").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("SELECT doc_id, 'cl-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ',cl-a_' || doc_id ELSE '' END AS claims, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'one ' || doc_id || '|two' END AS bullets FROM documents")
def f13_claims_and_evidence(spark, sf_dir):
    at = F.col("doc_id")
    body = F.concat(
        F.translate("text", "<#", ""), F.lit("\n<!-- claim:cl-"), at, F.lit(" -->\n## Evidence list\n"), F.when(at % 3 == 0, "none\n").otherwise(F.concat(F.lit("- one "), at, F.lit("\ntext\n * two\n"))),
        F.lit("## Next\n- no\n"), F.when(at % 2 == 0, F.concat(F.lit("<!--claim:cl-a_"), at, F.lit("-->"))).otherwise(""),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return d.select("doc_id", F.array_join(T.claim_ids(F.col("body")), ",").alias("claims"), F.array_join(T.evidence_bullets(F.col("body")), "|").alias("bullets"))


@query(f"WITH {EXPORTED}, ids AS (SELECT page_id, (['concepts', 'decisions'])[page_id % 2 + 1] || '/p' || page_id || '.md' AS path FROM pages) SELECT 'page.' || x.page_id AS page_id, 'Title ' || x.page_id AS title, 'First ' || x.page_id || '.' AS description, '# Title ' || x.page_id || E'\\n\\n## Summary\\nFirst ' || x.page_id || E'. Second.\\n\\nSee ' || CASE WHEN i.path IS NULL THEN '[[page.' || (x.page_id + 1) || ']]' ELSE '[page.' || i.page_id || '](/' || i.path || ')' END || E' and [[gone]].\\n' AS body FROM x LEFT JOIN ids i ON i.page_id = x.page_id + 1")
def f14_rewrite_and_describe(spark, sf_dir):
    p = _exported(spark, sf_dir)
    return govern.describe_pages(govern.rewrite_links(p, p.select("page_id", "path"))).select("page_id", "title", "description", "body")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(generate_series(0, 100), lambda i: strlen(left(text, i)) <= 100))) || '...' END AS short FROM documents")
def f15_truncate_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 100, "...").alias("short"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def f16_safe_json(spark, sf_dir):
    """Every fourth text has lost its end."""
    e = table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 4 == 0, F.expr("substring(props, 1, 3)")).otherwise(F.col("props"))
    return e.select("event_id", T.safe_json(broken, "$.k").alias("k"))


SNIPPET = rf"""w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents), hit AS (SELECT *, coalesce(list_position(list_transform(words, lambda x: list_has_any({TOKENS.format("x")}, ['the', 'und', 'les', 'que'])), true), 0) AS place FROM w)"""


@query(rf"WITH {SNIPPET} SELECT doc_id, CASE WHEN place > 0 THEN CASE WHEN place > 1 THEN '... ' ELSE '' END || array_to_string(list_transform(words[place:place + 11], lambda x: CASE WHEN list_has_any({TOKENS.format('x')}, ['the', 'und', 'les', 'que']) THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN len(words) >= place + 12 THEN ' ...' ELSE '' END ELSE left(text, 120) END AS snippet FROM hit")
def f17_snippet(spark, sf_dir):
    terms = F.array(*map(F.lit, ["the", "und", "les", "que"]))
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), terms).alias("snippet"))


@query("""WITH q AS (SELECT b.item_id, b.text AS question, d.doc_id, d.text FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(text) DESC, 'd' || doc_id) AS rank FROM q WHERE item_id % 4 <> 3)
SELECT item_id AS query_id, 'd' || doc_id AS session_id, rank, CAST(NULL AS VARCHAR) AS error FROM r WHERE rank <= 10 UNION ALL SELECT DISTINCT item_id, NULL, 0, 'ValueError: no answer' FROM q WHERE item_id % 4 = 3""")
def r17_rank_external(spark, sf_dir):
    """A user's ranker by length, which fails on some requests and names an unknown session."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n = b.agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("item_id"), F.concat(F.lit("d"), "doc_id").alias("session_id"), "text")
    requests = d.join(b.select("item_id", F.concat_ws(" ", F.col("item_id") % 4, "text").alias("question")), "item_id").withColumnRenamed("item_id", "query_id")

    def by_length(question, sessions):
        if question.startswith("3"):
            raise ValueError("no answer")
        return ["unknown", *(i for i, _ in sorted(sessions, key=lambda s: (-len(s[1]), s[0])))]

    return retrieval.rank_external(requests.select("query_id", "question", "session_id", "text"), by_length).select("query_id", "session_id", F.col("rank").cast("long").alias("rank"), "error")


CHAINS = rf"""two AS (SELECT a, b FROM pairs UNION SELECT x.a, y.b FROM pairs x JOIN pairs y ON x.b = y.a WHERE x.a <> y.b),
words AS (SELECT s_suppkey AS doc_id, unnest({TOKENS.format("s_name || ' w' || (s_suppkey % 7)")}) AS token FROM supplier), postings AS (SELECT doc_id, token, count(*) AS tf FROM words GROUP BY ALL), lens AS (SELECT doc_id, count(*) AS doc_len FROM words GROUP BY doc_id), stats AS (SELECT count(*) AS n, avg(doc_len) AS al FROM lens),
goals AS (SELECT n_nationkey AS query_id, 'w' || (n_nationkey % 7) AS term FROM nation UNION SELECT n_nationkey, 'supplier' FROM nation), per AS (SELECT g.query_id, g.term, doc_id, sum(tf) AS tf FROM goals g JOIN postings ON starts_with(token, g.term) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM per GROUP BY term), scored AS (SELECT query_id, doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / al))), 9) AS score, count(*) AS matched FROM per JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL),
hit AS (SELECT query_id, doc_id AS skill, abs(score) AS hit FROM scored WHERE matched = 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) <= 20), roots AS (SELECT DISTINCT query_id, coalesce(a, skill) AS root FROM hit LEFT JOIN two ON b = skill),
chain AS (SELECT query_id, root, b AS skill FROM roots JOIN two ON a = root UNION SELECT query_id, root, root FROM roots), total AS (SELECT query_id, root, sum(hit) AS total, max(hit) AS max_hit, count(*) AS matched FROM chain JOIN hit USING (query_id, skill) GROUP BY ALL)"""


@query(f"WITH {PAIRS}, {CHAINS} SELECT query_id, root, round(total, 6) AS total, round(max_hit, 6) AS max_hit, matched FROM total QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(total, 7) DESC, matched DESC, root) <= 5")
def g5_find_chains(spark, sf_dir):
    text = F.concat_ws(" ", "s_name", F.concat(F.lit("w"), F.col("s_suppkey") % 7))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    goals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("supplier w"), F.col("n_nationkey") % 7).alias("question"))
    closure = saved(graph.compose_closure(delegation_pairs(spark, sf_dir), depth=2))
    out = graph.find_chains(goals, retrieval.build_index(docs, {"text": 1.0}), closure)
    return out.select("query_id", "root", F.round("total", 6).alias("total"), F.round("max_hit", 6).alias("max_hit"), "matched")
