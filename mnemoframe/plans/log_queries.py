"""Queries over logs: ledgers, queues, usage, sessions, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import scratch
from mnemoframe.operators import govern, ledger, sessions, snapshots

from .base import CLAIMS, DELTAS, EVENTS, claims, deltas, events, joined, now, query

LOG = EVENTS + ", log AS (SELECT user_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS version, event_id AS seq, event_type AS state FROM ev)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("version"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


@query(f"WITH {LOG} SELECT id, seq, state FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, seq DESC) = 1")
def w1_reduce_latest(spark, sf_dir):
    return ledger.reduce_latest(_log(spark, sf_dir), "id", "version").select("id", "seq", "state")


def _thirds(log):
    """The log up to a third, up to two thirds and whole, as it grows."""
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    return [log.where(F.col("seq") <= first + (last - first) * i // 3) for i in (1, 2)] + [log]


@query(f"WITH {LOG} SELECT id, seq, state FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, seq DESC) = 1")
def w1_snapshot_and_tail(spark, sf_dir):
    """A snapshot that was advanced twice, and the tail behind it, reduce to what the whole log does."""
    log = _log(spark, sf_dir)
    kept = snapshots.Snapshot(spark, scratch(spark, "snapshot"), snapshots.keep_latest_rows("id", "version"), log.schema)
    some, more, whole = _thirds(log)
    kept.advance(some)
    kept.advance(more)
    return ledger.reduce_latest(kept.rows(whole), "id", "version").select("id", "seq", "state")


def _queue(spark, sf_dir):
    return events(spark, sf_dir).select((F.col("user_id") * 100 + F.col("k")).alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), (F.col("event_type") == "error").alias("tombstone"), "ts")


QUEUE = EVENTS + ", queue AS (SELECT user_id * 100 + k AS id, event_id AS seq, user_id AS session_id, event_type = 'error' AS tombstone, ts FROM ev), live AS (SELECT * FROM queue WHERE NOT tombstone AND id NOT IN (SELECT id FROM queue WHERE tombstone))"


@query(f"WITH {QUEUE} SELECT id, seq, session_id FROM live")
def w2_live_queue(spark, sf_dir):
    return ledger.live_queue(_queue(spark, sf_dir)).select("id", "seq", "session_id")


@query(f"WITH {QUEUE} SELECT session_id, id, seq FROM live QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1")
def w2_oldest_items(spark, sf_dir):
    return ledger.oldest_items(ledger.live_queue(_queue(spark, sf_dir))).select("session_id", "id", "seq")


@query(f"WITH {QUEUE} SELECT (SELECT count(*) FROM queue) AS total, (SELECT count(*) FROM live) AS kept, (SELECT count(*) FROM queue) - (SELECT count(*) FROM live) AS removed")
def w2_compaction_counts(spark, sf_dir):
    return ledger.compaction_counts(_queue(spark, sf_dir))


@query(f"WITH {EVENTS}, u AS (SELECT user_id AS id, ts, event_type AS state FROM ev WHERE user_id % 3 <> 0 UNION SELECT user_id, ts, event_type FROM ev WHERE user_id % 3 <> 1) SELECT id, state, row_number() OVER (PARTITION BY id ORDER BY ts, state) AS seq FROM u")
def u1_merge_ledgers(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    return ledger.merge_ledgers(e.where("id % 3 <> 0"), e.where("id % 3 <> 1"), ["id"]).select("id", "state", "seq")


@query(f"WITH {DELTAS} SELECT problem_id, block_id, type, label, status, superseded_by, (SELECT string_agg(kind || '>' || target_id, ',' ORDER BY seq) FROM rel WHERE rel.problem_id = b.problem_id AND rel.block_id = b.block_id) AS relations FROM blocks b")
def w3_fold_flow(spark, sf_dir):
    folded = ledger.fold_flow(deltas(spark, sf_dir))
    text = F.array_join(F.transform("relations", lambda r: F.concat(r["kind"], F.lit(">"), r["target_id"])), ",")
    return folded.select("problem_id", "block_id", "type", "label", "status", "superseded_by", F.nullif(text, F.lit("")).alias("relations"))


@query(f"WITH {DELTAS} SELECT problem_id, block_id, type, label, status, superseded_by, (SELECT string_agg(kind || '>' || target_id, ',' ORDER BY seq) FROM rel WHERE rel.problem_id = b.problem_id AND rel.block_id = b.block_id) AS relations FROM blocks b")
def w3_snapshot_and_tail(spark, sf_dir):
    log = deltas(spark, sf_dir)
    kept = snapshots.Snapshot(spark, scratch(spark, "snapshot"), snapshots.keep_flow_rows, log.schema)
    some, more, whole = _thirds(log)
    kept.advance(some)
    kept.advance(more)
    folded = ledger.fold_flow(kept.rows(whole))
    text = F.array_join(F.transform("relations", lambda r: F.concat(r["kind"], F.lit(">"), r["target_id"])), ",")
    return folded.select("problem_id", "block_id", "type", "label", "status", "superseded_by", F.nullif(text, F.lit("")).alias("relations"))


@query(f"WITH {DELTAS} SELECT problem_id, count(*) AS n_deltas, count(*) >= 100 AS stale, arg_max(body_hash, seq) FILTER (op = 'cue-card-regen') AS cue_hash, arg_max(body_bytes, seq) FILTER (op = 'cue-card-regen') AS cue_bytes FROM deltas GROUP BY problem_id")
def w3_flow_meta(spark, sf_dir):
    return ledger.flow_meta(deltas(spark, sf_dir))


@query(f"""WITH {DELTAS}, batch AS (SELECT *, row_number() OVER (PARTITION BY problem_id, type, label ORDER BY seq) AS nth FROM deltas WHERE op = 'block-add'),
live AS (SELECT DISTINCT problem_id, type, label FROM blocks WHERE status = 'confirmed' AND problem_id % 2 = 0)
SELECT problem_id, block_id, seq, CASE WHEN live.label IS NOT NULL THEN 'already-live' WHEN nth > 1 THEN 'repeated-in-batch' END AS reason FROM batch LEFT JOIN live USING (problem_id, type, label)""")
def j1_dedup_blocks(spark, sf_dir):
    d = deltas(spark, sf_dir)
    history = ledger.fold_flow(d).where("problem_id % 2 = 0").select("problem_id", "type", "label", (F.col("status") == "superseded").alias("superseded"))
    return ledger.dedup_blocks(d.where("op = 'block-add'"), history).select("problem_id", "block_id", "seq", "reason")


@query(f"""WITH {DELTAS} SELECT problem_id, seq, CASE WHEN op = 'block-add' AND (confidence IS NULL OR confidence NOT BETWEEN 0 AND 1) THEN 'confidence outside [0,1]' WHEN op = 'block-add' AND type = 'Outcome' AND k > 50 THEN 'polarity is neither + nor -' END AS reject
FROM (SELECT deltas.*, ev.k FROM deltas JOIN ev ON seq = event_id)""")
def p4_valid_deltas(spark, sf_dir):
    d = deltas(spark, sf_dir).withColumns({"detector_id": F.lit(None).cast("string"), "subject_id": F.lit(None).cast("string"), "gap_id": F.lit(None).cast("string"), "polarity": F.when(F.col("body_bytes") > 50, "?").otherwise("+")})
    return ledger.valid_deltas(d).select("problem_id", "seq", "reject")


TURNS = EVENTS + ", turns AS (SELECT *, greatest(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS turn_ordinal FROM ev)"


def _turns(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), "event_type", "k", "value")
    return sessions.turn_ordinals(e.withColumn("is_prompt", F.col("event_type") == "view"))


@query(f"WITH {TURNS} SELECT user_id AS session_id, event_id AS seq, CAST(turn_ordinal AS BIGINT) AS turn_ordinal FROM turns")
def w4_turn_ordinals(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "seq", F.col("turn_ordinal").cast("long").alias("turn_ordinal"))


def _observations(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.withColumns({
        "problem_id": F.when(F.col("session_id") % 4 != 0, F.col("session_id") % 10),
        "tool": F.when(F.col("event_type") != "view", F.col("event_type")),
        "type": F.when(F.col("event_type") == "view", "user-intent").otherwise("tool"),
        "exit_code": F.when(F.col("event_type") == "click", F.col("k") % 2),
        "file": F.when(F.col("event_type") == "signup", F.concat(F.lit("file"), F.col("k"))),
        "data": F.col("k").cast("string"),
    })


@query(f"""WITH {TURNS}, t AS (SELECT *, count(*) OVER (PARTITION BY user_id, turn_ordinal) AS n, row_number() OVER (PARTITION BY user_id, turn_ordinal ORDER BY event_id) AS pos FROM turns)
SELECT user_id AS session_id, event_id AS seq, CASE WHEN n > 5 THEN CAST((pos - 1) // 5 + 1 AS INT) END AS part, user_id % 4 = 0 AS is_orphan FROM t""")
def w5_bundle_turns(spark, sf_dir):
    return sessions.bundle_turns(_observations(spark, sf_dir), size=5).select("session_id", "seq", "part", "is_orphan")


@query(f"""WITH {TURNS} SELECT user_id AS session_id, CAST(turn_ordinal AS BIGINT) AS turn_ordinal, count(*) FILTER (event_type = 'click' AND k % 2 = 0) AS exit_success, count(*) FILTER (event_type = 'click' AND k % 2 = 1) AS exit_failure,
count(*) FILTER (event_type = 'view') AS prompts, coalesce(string_agg(DISTINCT 'file' || k, ',' ORDER BY 'file' || k) FILTER (event_type = 'signup'), '') AS files, count(*) FILTER (event_type = 'error') AS errors FROM turns GROUP BY ALL""")
def a6_bundle_metrics(spark, sf_dir):
    m = sessions.bundle_metrics(_observations(spark, sf_dir))
    return m.select("session_id", F.col("turn_ordinal").cast("long").alias("turn_ordinal"), "exit_success", "exit_failure", "prompts", F.array_join("files", ",").alias("files"), F.coalesce(F.try_element_at("tool_counts", F.lit("error")), F.lit(0)).alias("errors"))


@query(f"WITH {TURNS} SELECT user_id AS session_id, CAST(turn_ordinal AS BIGINT) AS turn_ordinal, event_type AS tool, count(*) AS calls FROM turns WHERE event_type <> 'view' GROUP BY ALL HAVING count(*) >= 3")
def p9_promotion_candidates(spark, sf_dir):
    m = sessions.bundle_metrics(_observations(spark, sf_dir))
    return sessions.promotion_candidates(m, 3).select("session_id", F.col("turn_ordinal").cast("long").alias("turn_ordinal"), "tool", "calls")


@query(f"""WITH {TURNS}, t AS (SELECT *, user_id % 10 AS problem_id FROM turns WHERE user_id % 4 <> 0), c AS (SELECT problem_id, event_type, count(*) AS n FROM t WHERE event_type <> 'view' GROUP BY ALL),
tools AS (SELECT problem_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS tools FROM c GROUP BY problem_id)
SELECT problem_id, count(*) FILTER (event_type = 'click' AND k % 2 = 0) AS exit_success, count(*) FILTER (event_type = 'view') AS prompts, any_value(tools) AS tools FROM t JOIN tools USING (problem_id) GROUP BY problem_id""")
def a7_activity_card(spark, sf_dir):
    m = sessions.bundle_metrics(_observations(spark, sf_dir), ("problem_id", "session_id", "turn_ordinal")).where("problem_id is not null")
    card = sessions.activity_card(m.withColumn("sealed_at", F.col("turn_ordinal")))
    return card.select("problem_id", "exit_success", "prompts", F.array_join(F.transform("tools", lambda x: F.concat_ws(":", x["value"], x["n"])), ",").alias("tools"))


@query(f"WITH {EVENTS} SELECT user_id AS session_id, count(*) AS n, substr(string_agg('- ' || CASE WHEN event_type = 'view' THEN 'user-intent' ELSE 'tool' END || ' ' || k, chr(10) ORDER BY event_id), 1, 32768) AS source FROM ev GROUP BY user_id HAVING count(*) >= 3")
def p20_capture_sessions(spark, sf_dir):
    return sessions.capture_sessions(_observations(spark, sf_dir))


USAGE = EVENTS + ", usage AS (SELECT ts, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'ask' END AS tool, 'query ' || (k % 37) AS query, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS context_tokens, [user_id, user_id % 10] AS pages FROM ev)"


def _usage(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("ts", F.when(F.col("event_type").isin("view", "click"), "search").otherwise("ask").alias("tool"), F.concat(F.lit("query "), F.col("k") % 37).alias("query"), F.when(F.col("event_type") == "purchase", F.floor("value").cast("long")).alias("context_tokens"), F.array(F.col("user_id"), F.col("user_id") % 10).alias("top_page_ids"))


AT = "TIMESTAMP '2024-01-20 00:00:00'"


def _at():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query(f"WITH {USAGE} SELECT count(*) FILTER (tool = 'search') AS searches, count(*) FILTER (tool = 'ask') AS asks, count(DISTINCT query) AS unique_queries, CAST(coalesce(sum(context_tokens), 0) AS BIGINT) AS tokens FROM usage WHERE ts > {AT} - INTERVAL 7 DAY AND ts <= {AT}")
def a1_usage_summary(spark, sf_dir):
    return ledger.usage_summary(_usage(spark, sf_dir), _at(), 0)


@query(f"WITH {USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (tool = 'search') AS searches, count(*) FILTER (tool = 'ask') AS asks FROM usage GROUP BY 1")
def a2_usage_by_day(spark, sf_dir):
    return ledger.usage_by_day(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT page_id, count(*) AS recalls, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_recall FROM (SELECT ts, unnest(pages) AS page_id FROM usage WHERE ts > {AT} - INTERVAL 30 DAY AND ts <= {AT}) GROUP BY page_id")
def a3_page_recalls(spark, sf_dir):
    r = ledger.page_recalls(_usage(spark, sf_dir), _at())
    return r.withColumn("last_recall", F.date_format("last_recall", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {USAGE} SELECT count(*) AS calls, CAST(sum(context_tokens) AS BIGINT) AS used, count(*) * 5000 AS full_tokens, round((1 - sum(context_tokens) / (count(*) * 5000)) * 100, 1) AS saved_percent FROM usage WHERE context_tokens IS NOT NULL")
def a4_token_savings(spark, sf_dir):
    return ledger.token_savings(_usage(spark, sf_dir), 5000).withColumn("full_tokens", F.col("full_tokens").cast("long"))


@query(f"WITH {USAGE} SELECT query, count(*) AS n FROM usage GROUP BY query ORDER BY n DESC, query LIMIT 5")
def t1_top_queries(spark, sf_dir):
    return ledger.top_values(_usage(spark, sf_dir), "query")


@query(f"WITH {EVENTS}, c AS (SELECT 'd' || k AS detector_id, count(*) FILTER (event_type = 'click') AS accepted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'view') AS superseded, count(*) FILTER (event_type = 'signup') AS invalidated FROM ev GROUP BY k) SELECT *, (accepted + 2) / (accepted + rejected + superseded + invalidated + 4) AS weight, CASE WHEN accepted + rejected + superseded + invalidated > 0 THEN accepted / (accepted + rejected + superseded + invalidated) END AS rate FROM c")
def a5_detector_weights(spark, sf_dir):
    decision = F.create_map(*(F.lit(x) for x in ("click", "accepted", "error", "rejected", "view", "superseded", "signup", "invalidated", "purchase", "other")))
    return ledger.detector_weights(events(spark, sf_dir).select(F.concat(F.lit("d"), "k").alias("detector_id"), decision[F.col("event_type")].alias("decision")))


JOBS = EVENTS + ", jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, k % 4 AS attempts, 3 AS max_attempts, CASE WHEN event_type = 'click' AND k % 10 <> 0 THEN ts + INTERVAL 1 HOUR END AS lease, 'loc' || (user_id % 3) AS location FROM ev)"


def _jobs(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    lease = F.when((F.col("event_type") == "click") & (F.col("k") % 10 != 0), F.col("ts") + F.expr("interval 1 hour"))
    return events(spark, sf_dir).select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("k") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), lease.alias("lease_expires_at"), F.concat(F.lit("loc"), F.col("user_id") % 3).alias("location"))


@query(f"WITH {JOBS} SELECT location, status, count(*) AS n FROM jobs GROUP BY ROLLUP (location, status)")
def a14_queue_counts(spark, sf_dir):
    return ledger.queue_counts(_jobs(spark, sf_dir))


@query(f"WITH {JOBS}, j AS (SELECT *, status = 'running' AND (lease IS NULL OR lease <= {AT}) AS is_stale FROM jobs) SELECT job_id, is_stale, CASE WHEN is_stale THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, attempts FROM j")
def p14_reap_jobs(spark, sf_dir):
    return ledger.job_transitions(_jobs(spark, sf_dir), _at(), "reap").select("job_id", "is_stale", "status", "attempts")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status, CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts FROM jobs")
def p14_claim_jobs(spark, sf_dir):
    return ledger.job_transitions(_jobs(spark, sf_dir), _at(), "claim").select("job_id", "status", "attempts")


@query(f"WITH {EVENTS} SELECT event_id, epoch({AT}) - epoch(ts) >= 7 * 86400 AS expired FROM ev")
def p12_sweep_ttl(spark, sf_dir):
    return ledger.sweep_ttl(events(spark, sf_dir), _at(), "ts").select("event_id", "expired")


@query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-04-14 00:00:00' - INTERVAL 90 DAY")
def p13_rotation_candidates(spark, sf_dir):
    p = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "purchase", "resolved").otherwise("open").alias("status"), F.col("ts").alias("resolved_at"))
    return ledger.rotation_candidates(p, F.lit("2024-04-14").cast("timestamp")).select("event_id")


FINDING_SQL = {
    "low-confidence": "SELECT 'low-confidence' AS detector_id, 'info' AS severity, CAST(candidate_id AS VARCHAR) AS subject, CAST(candidate_id AS VARCHAR) AS evidence FROM claims WHERE status = 'accepted' AND confidence < 0.5 UNION ALL SELECT 'low-confidence', 'warning', CAST(candidate_id AS VARCHAR), CAST(candidate_id AS VARCHAR) FROM claims WHERE status = 'accepted' AND evidence IS NULL",
    "stale-claims": "SELECT 'stale-claims' AS detector_id, 'info' AS severity, CAST(candidate_id AS VARCHAR) AS subject, CAST(candidate_id AS VARCHAR) AS evidence FROM claims WHERE status = 'accepted' AND floor((epoch(TIMESTAMP '2024-03-05') - epoch(created_at)) / 86400) >= 60",
    "review-queue": "SELECT 'review-queue' AS detector_id, CASE WHEN floor((epoch(TIMESTAMP '2024-03-05') - epoch(created_at)) / 86400) >= 14 THEN 'warning' ELSE 'info' END AS severity, CAST(candidate_id AS VARCHAR) AS subject, CAST(candidate_id AS VARCHAR) AS evidence FROM claims WHERE status = 'pending' AND floor((epoch(TIMESTAMP '2024-03-05') - epoch(created_at)) / 86400) >= 7",
    "duplicate-candidates": "SELECT 'duplicate-candidates' AS detector_id, 'warning' AS severity, trim(lower(proposed_text)) AS subject, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY CAST(candidate_id AS VARCHAR)) AS evidence FROM claims WHERE status IN ('pending', 'accepted') GROUP BY 3 HAVING count(*) >= 2",
    "contradictions": "SELECT 'contradictions' AS detector_id, 'warning' AS severity, CAST(block_id AS VARCHAR) AS subject, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY CAST(candidate_id AS VARCHAR)) AS evidence FROM claims WHERE status = 'accepted' AND invalid_at IS NULL GROUP BY block_id HAVING count(*) >= 2 AND NOT bool_and(coalesce(superseded_by IN (candidate_id), false))",
}


def _findings(name, f):
    def run(spark, sf_dir):
        return f(claims(spark, sf_dir), now()).withColumn("evidence", F.array_join("evidence", ","))

    run.__name__ = name
    return query(f"WITH {CLAIMS} {FINDING_SQL[{'p16': 'low-confidence', 'p17': 'stale-claims', 'p18': 'review-queue', 'a9_': 'duplicate-candidates', 'a10': 'contradictions'}[name[:3]]]}")(run)


p16_low_confidence = _findings("p16_low_confidence", govern.low_confidence)
p17_stale_claims = _findings("p17_stale_claims", govern.stale_claims)
p18_review_queue = _findings("p18_review_queue", govern.review_queue)
a9_duplicate_claims = _findings("a9_duplicate_claims", govern.duplicate_claims)
a10_contradictions = _findings("a10_contradictions", govern.contradictions)


@query(f"WITH {CLAIMS} SELECT detector_id, count(*) AS n FROM (" + " UNION ALL ".join(f"({s})" for s in FINDING_SQL.values()) + ") GROUP BY detector_id")
def a11_governance_counts(spark, sf_dir):
    return govern.governance_counts(claims(spark, sf_dir), now())


@query(f"""WITH {EVENTS}, pages AS (SELECT event_id AS page_id, CASE WHEN event_type = 'signup' THEN 'draft' ELSE 'active' END AS status, CASE WHEN k % 11 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS updated_at, date_trunc('second', ts) AS t, k FROM ev),
recalls AS (SELECT event_id AS page_id, 2 AS recalls, ts + INTERVAL 50 DAY AS last_recall FROM ev WHERE user_id % 3 = 0),
p AS (SELECT *, floor((epoch(TIMESTAMP '2024-04-25') - epoch(t)) / 86400) AS age FROM pages LEFT JOIN recalls USING (page_id))
SELECT page_id, coalesce(recalls, 0) AS recalls, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN status = 'draft' AND age > 14 THEN 'stale-draft'
 WHEN status = 'active' AND age > 90 AND NOT coalesce(epoch(TIMESTAMP '2024-04-25') - epoch(last_recall) <= 30 * 86400, false) THEN 'decay-candidate' WHEN status = 'active' AND age > 45 THEN 'aging' ELSE 'fresh' END AS tier FROM p""")
def j7_page_decay(spark, sf_dir):
    e = events(spark, sf_dir)
    pages = e.select(F.col("event_id").alias("page_id"), F.when(F.col("event_type") == "signup", "draft").otherwise("active").alias("status"), F.when(F.col("k") % 11 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("updated_at"))
    recalls = e.where("user_id % 3 = 0").select(F.col("event_id").alias("page_id"), F.lit(2).alias("recalls"), (F.col("ts") + F.expr("interval 50 days")).alias("last_recall"))
    return govern.page_decay(pages, recalls, F.lit("2024-04-25").cast("timestamp")).select("page_id", "recalls", "tier")


@query(f"WITH {DELTAS} SELECT 'claim-cand-' || block_id AS candidate_id, problem_id, type AS proposed_type, label AS proposed_text FROM blocks WHERE type IN ('Outcome', 'Rule') AND status = 'confirmed' AND confidence >= 0.7")
def p10_claim_candidates(spark, sf_dir):
    found = ledger.claim_candidates(ledger.fold_flow(deltas(spark, sf_dir)))
    problem = F.regexp_extract(F.col("evidence")[0]["source"], "flow:([0-9]+)/", 1).cast("long")
    return found.select("candidate_id", problem.alias("problem_id"), "proposed_type", "proposed_text")


@query(f"WITH {EVENTS} SELECT event_id AS request_id, slot, seq, place FROM (SELECT user_id AS event_id, event_type AS slot, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM ev) WHERE place <= CASE slot WHEN 'view' THEN 3 WHEN 'click' THEN 3 WHEN 'signup' THEN 2 ELSE 0 END")
def w10_context_budget(spark, sf_dir):
    r = events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("slot"), F.col("event_id").alias("seq"))
    return sessions.context_budget(r, {"view": 3, "click": 3, "signup": 2}).select("request_id", "slot", "seq", "place")


@query(f"""WITH {EVENTS}, days AS (SELECT *, strftime(ts, '%Y/%m/%d') AS date FROM ev), o AS (SELECT user_id AS question_id, event_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN date END NULLS LAST, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM days),
f AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS fraction) SELECT question_id, CAST(fraction AS DOUBLE) AS fraction, count(*) AS n, sum(session_id) AS checksum FROM o, f WHERE place <= greatest(1, ceil(fraction * n)) GROUP BY ALL""")
def w6_slices(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("question_id"), F.col("event_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy/MM/dd")).alias("date"))
    return sessions.slice_at(sessions.order_haystack(e)).groupBy("question_id", F.col("fraction").cast("double").alias("fraction")).agg(F.count("*").alias("n"), F.sum("session_id").alias("checksum"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id AS q, event_id AS s, event_type = 'purchase' AS evidence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
f AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS fraction), u AS (SELECT q, fraction, count(*) FILTER (evidence) AS wanted, count(*) FILTER (evidence AND place <= greatest(1, ceil(fraction * n))) AS found FROM e, f GROUP BY ALL)
SELECT q AS question_id, CAST(fraction AS DOUBLE) AS fraction, wanted > 0 AND found = wanted AS usable, min(CASE WHEN wanted > 0 AND found = wanted THEN 1 ELSE 0 END) OVER (PARTITION BY q) = 1 AS in_cohort FROM u""")
def w6_usable_checkpoints(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("question_id"), F.col("event_id").alias("session_id"), F.col("event_id").alias("seq"), "event_type")
    sliced = sessions.slice_at(sessions.order_haystack(e, by_date=False))
    evidence = e.where("event_type = 'purchase'").select("question_id", "session_id")
    return sessions.usable_checkpoints(sliced, evidence).withColumn("fraction", F.col("fraction").cast("double"))


@query(f"WITH {EVENTS} SELECT user_id, k, event_id AS seq, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1")
def w7_first_seen(spark, sf_dir):
    return sessions.first_seen(events(spark, sf_dir).select("user_id", "k", F.col("event_id").alias("seq"), "event_type"), ["user_id", "k"])


@query("SELECT doc_id, text, redactions FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)password\\s*[=:]\\s*[\"'']?[^\\s\"'']{4,}', '<REDACTED:password-field>', 'g'), '(?i)(?:secret|token|apikey|api_key)\\s*[=:]\\s*[\"'']?[^\\s\"'']{8,}', '<REDACTED:generic-secret>', 'g') AS text, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)password\\s*[=:]\\s*[\"'']?[^\\s\"'']{4,}') THEN 'password-field' END, CASE WHEN regexp_matches(text, '(?i)(?:secret|token|apikey|api_key)\\s*[=:]\\s*[\"'']?[^\\s\"'']{8,}') THEN 'generic-secret' END], lambda x: x IS NOT NULL), ',') AS redactions FROM documents)")
def p3_redact(spark, sf_dir):
    from .base import table

    return ledger.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").withColumn("redactions", joined("redactions"))


def _broken(claims, now):
    """A detector that raises on its first row."""
    return claims.select(F.lit("broken").alias("detector_id"), F.raise_error(F.lit("no evidence here")).cast("string").alias("severity"), F.lit("").alias("subject"), F.array(F.lit("")).alias("evidence"))


@query(f"WITH {CLAIMS} SELECT detector_id, count(*) AS n FROM (" + " UNION ALL ".join(f"({s})" for s in FINDING_SQL.values()) + ") GROUP BY detector_id UNION ALL SELECT '_broken failed', 1")
def a11_failing_detector(spark, sf_dir):
    """A detector that raises on a row is reported; the others' findings stay."""
    found, failed = govern.findings_and_failures(claims(spark, sf_dir), now(), (*govern.DETECTORS, _broken))
    counts = found.groupBy("detector_id").agg(F.count("*").alias("n"))
    told = spark.createDataFrame([(f"{name} failed", 1) for name, message in failed if "no evidence here" in message], "detector_id string, n long")
    return counts.unionByName(told)


@query(f"WITH {EVENTS}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM ev) SELECT strftime(day + CAST(d AS INT), '%Y-%m-%d') AS until, count(DISTINCT user_id) AS users, true AS within FROM days, range(0, 7) r(d) GROUP BY 1")
def a2_distinct_users(spark, sf_dir):
    """Distinct users of rolling weeks, exact, and whether the estimate from merged daily sketches is within its error."""
    e = events(spark, sf_dir)
    merged = ledger.distinct_in_windows(ledger.daily_sketches(e, "user_id"))
    days = e.select(F.to_date("ts").alias("day"), "user_id").distinct()
    exact = days.select(F.explode(F.sequence("day", F.date_add("day", 6))).alias("until"), "user_id").groupBy("until").agg(F.count_distinct("user_id").alias("users"))
    within = F.abs(F.col("estimate") - F.col("users")) <= F.col("error")
    return exact.join(merged, "until").select(F.date_format("until", "yyyy-MM-dd").alias("until"), "users", within.alias("within"))
