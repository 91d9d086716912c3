"""Queries over graphs: flow graphs, skill graphs, structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions.helpers import saved
from mnemoframe.operators import flow, govern, graph, ledger

from .base import DELTAS, EVENTS, PAIRS, blocks, deltas, delegation_pairs, events, joined, now, query, table

GAPS = (
    DELTAS
    + """, c AS (SELECT * FROM blocks WHERE status = 'confirmed'),
outcomes AS (SELECT r.problem_id, r.block_id, o.polarity FROM rel r JOIN c o ON o.problem_id = r.problem_id AND o.block_id = r.target_id AND o.type = 'Outcome' WHERE kind = 'followsFrom'),
mitigated AS (SELECT r.problem_id, r.block_id FROM rel r JOIN c o ON o.problem_id = r.problem_id AND o.block_id = r.target_id AND o.type = 'Action' WHERE kind = 'mitigatedBy'),
gaps AS (
 SELECT problem_id, 'rule:orphan-action' AS detector_id, block_id AS subject_id, 0.7 AS severity FROM c WHERE type = 'Action' AND (problem_id, block_id) NOT IN (SELECT (problem_id, block_id) FROM outcomes)
 UNION ALL SELECT problem_id, 'rule:unsupported-hypothesis', block_id, 1.0 FROM c WHERE type = 'Hypothesis' AND (problem_id, block_id) NOT IN (SELECT (problem_id, target_id) FROM rel WHERE kind = 'evidencedBy')
 UNION ALL SELECT problem_id, 'rule:stale-confirmed', block_id, 0.6 FROM c WHERE type NOT IN ('Gap', 'Question') AND TIMESTAMP '2024-03-05' > created_at + INTERVAL 7 DAY
 UNION ALL SELECT problem_id, 'rule:uncaused-problem', block_id, 0.85 FROM c WHERE type = 'Problem' AND (problem_id, block_id) NOT IN (SELECT (problem_id, target_id) FROM rel WHERE kind = 'causes')
 UNION ALL SELECT problem_id, 'rule:low-confidence-critical', block_id, 0.5 FROM c WHERE type IN ('Hypothesis', 'Cause', 'Outcome') AND confidence < 0.5
 UNION ALL SELECT c.problem_id, 'rule:conflicting-outcomes', c.block_id, 0.9 FROM c JOIN outcomes o USING (problem_id, block_id) WHERE type = 'Action' GROUP BY ALL HAVING count(DISTINCT o.polarity) = 2
 UNION ALL SELECT problem_id, 'rule:dangling-evidence', block_id, 0.4 FROM c WHERE type = 'Evidence' AND (problem_id, block_id) NOT IN (SELECT (problem_id, target_id) FROM rel WHERE kind IN ('evidencedBy', 'validatedBy'))
 UNION ALL SELECT problem_id, 'rule:unmitigated-cause', block_id, 0.75 FROM c WHERE type = 'Cause' AND (problem_id, block_id) NOT IN (SELECT (problem_id, block_id) FROM mitigated))"""
)


@query(f"WITH {GAPS} SELECT problem_id, detector_id, subject_id, CAST(severity AS DOUBLE) AS severity FROM gaps")
def g7_gaps(spark, sf_dir):
    found, _ = flow.gaps(blocks(spark, sf_dir), now())
    return found.select("problem_id", "detector_id", "subject_id", "severity")


def _broken(blocks, relations, now):
    """A detector that raises on its first row."""
    return blocks.select("problem_id", F.lit("broken").alias("detector_id"), F.raise_error(F.lit("no relation here")).cast("string").alias("subject_id"), F.lit(1.0).alias("severity"))


@query(f"WITH {GAPS} SELECT problem_id, detector_id, subject_id, CAST(severity AS DOUBLE) AS severity FROM gaps UNION ALL SELECT NULL, '_broken', 'failed', NULL")
def g7_failing_detector(spark, sf_dir):
    """A detector that raises on a row is reported; the others' gaps stay."""
    found, failed = flow.gaps(blocks(spark, sf_dir), now(), (*flow.DETECTORS, _broken))
    told = spark.createDataFrame([(None, name, "failed", None) for name, message in failed if "no relation here" in message], "problem_id long, detector_id string, subject_id string, severity double")
    return found.select(*flow.GAP_COLUMNS).unionByName(told)


VOI = (
    GAPS
    + """, outs AS (SELECT b.problem_id, b.block_id, b.confidence, b.created_at, count(rel.seq) AS od FROM blocks b LEFT JOIN rel USING (problem_id, block_id) GROUP BY ALL),
ins AS (SELECT problem_id, target_id AS block_id, count(*) AS id FROM rel GROUP BY ALL),
mean AS (SELECT problem_id, sum(od) / (count(*) + (SELECT count(*) FROM gaps g WHERE g.problem_id = outs.problem_id)) AS m FROM outs GROUP BY problem_id),
voi AS (SELECT g.problem_id, g.detector_id, g.subject_id, 0.35 * severity + 0.2 * CASE WHEN m > 0 THEN least(1, (od + coalesce(id, 0)) / (m * 2)) ELSE 0 END
   + 0.15 / (1 + (epoch(TIMESTAMP '2024-03-05') - epoch(o.created_at)) / 86400) + 0.15 * greatest(0, 1 - o.confidence) AS voi
 FROM gaps g JOIN outs o ON o.problem_id = g.problem_id AND o.block_id = g.subject_id JOIN mean ON mean.problem_id = g.problem_id LEFT JOIN ins ON ins.problem_id = g.problem_id AND ins.block_id = g.subject_id)"""
)


@query(f"WITH {VOI} SELECT problem_id, detector_id, subject_id, round(greatest(0, least(1, voi)), 6) AS voi FROM voi")
def g8_voi(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("confidence", F.col("confidence"))
    found, _ = flow.gaps(b, now())
    return flow.voi(found.drop("label"), b, now()).select("problem_id", "detector_id", "subject_id", F.round("voi", 6).alias("voi"))


QUESTIONS = (
    EVENTS
    + """, q AS (SELECT user_id AS problem_id, CAST(event_id AS VARCHAR) AS block_id, ts AS created_at, CASE WHEN k % 6 = 0 THEN 'superseded' ELSE 'confirmed' END AS status,
 CASE WHEN k % 6 = 0 THEN CAST(event_id - 1 AS VARCHAR) END AS superseded_by, CASE WHEN k % 4 <> 1 THEN CAST(event_id AS VARCHAR) ELSE 'none' END AS gap_id, round(value / 200, 4) AS voi FROM ev WHERE event_type = 'view'),
asked AS (SELECT CAST(event_id AS VARCHAR) AS question_id, ts + INTERVAL 1 HOUR AS asked_at, CASE WHEN k % 4 <> 1 THEN CAST(event_id AS VARCHAR) ELSE 'none' END AS gap_id FROM ev WHERE event_type = 'view' AND k % 5 = 0),
life AS (SELECT q.*, CASE WHEN status = 'superseded' THEN 'answered' WHEN q.gap_id = 'none' OR TIMESTAMP '2024-02-10' > created_at + INTERVAL 30 DAY THEN 'stale' WHEN question_id IS NOT NULL THEN 'asked' ELSE 'pending' END AS lifecycle FROM q LEFT JOIN asked ON block_id = question_id)"""
)


def _questions(spark, sf_dir):
    """Questions from views. The value is rounded as the SQL does, on the binary number: 0.29 / 200 times 10,000 is under
    14.5, while Spark's round to four places takes the decimal 0.00145 for a half."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    text = F.col("event_id").cast("string")
    return e.select(
        F.col("user_id").alias("problem_id"), text.alias("block_id"), F.lit("Question").alias("type"), F.col("ts").alias("created_at"),
        F.when(F.col("k") % 6 == 0, "superseded").otherwise("confirmed").alias("status"), F.when(F.col("k") % 6 == 0, (F.col("event_id") - 1).cast("string")).alias("superseded_by"),
        F.when(F.col("k") % 4 != 1, text).otherwise("none").alias("gap_id"), (F.round(F.col("value") / 200 * 10000) / 10000).alias("voi"), F.concat(F.lit("b"), "user_id").alias("bundle_id"), F.lit("why?").alias("label"),
    )


def _asked(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'view' and k % 5 = 0")
    text = F.col("event_id").cast("string")
    return e.select(text.alias("question_id"), (F.col("ts") + F.expr("interval 1 hour")).alias("asked_at"), F.when(F.col("k") % 4 != 1, text).otherwise("none").alias("gap_id"), F.lit(None).cast("string").alias("resolution"))


def _then():
    return F.lit("2024-02-10").cast("timestamp")


@query(f"WITH {QUESTIONS} SELECT problem_id, block_id, lifecycle FROM life")
def j11_question_lifecycle(spark, sf_dir):
    return flow.question_lifecycle(_questions(spark, sf_dir), _asked(spark, sf_dir), _then()).select("problem_id", "block_id", "lifecycle")


@query(f"WITH {QUESTIONS} SELECT problem_id, block_id, row_number() OVER (PARTITION BY problem_id ORDER BY voi DESC, created_at, block_id) AS place FROM life WHERE lifecycle = 'pending'")
def t2_pending_questions(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return flow.pending_questions(q, flow.question_lifecycle(q, _asked(spark, sf_dir), _then())).select("problem_id", "block_id", "place")


@query(f"WITH {EVENTS}, q AS (SELECT user_id * 10 + k % 10 AS gap_id, max(event_id) AS question_id FROM ev WHERE event_type = 'view' GROUP BY 1) SELECT event_id AS found_id, question_id, question_id IS NOT NULL AS has_question FROM ev LEFT JOIN q ON gap_id = user_id * 10 + k % 10 WHERE event_type = 'error'")
def t2_current_gaps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("gap_id", F.col("user_id") * 10 + F.col("k") % 10)
    questions = e.where("event_type = 'view'").select("gap_id", F.col("event_id").alias("block_id"), F.col("event_id").alias("seq"))
    found = e.where("event_type = 'error'").select("gap_id", F.col("event_id").alias("found_id"))
    return flow.current_gaps(found, questions).select("found_id", "question_id", "has_question")


@query(f"WITH {QUESTIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY voi DESC, created_at, block_id) AS place FROM life WHERE lifecycle = 'pending' AND block_id NOT IN (SELECT question_id FROM asked) AND gap_id NOT IN (SELECT gap_id FROM asked GROUP BY gap_id HAVING max(asked_at) > TIMESTAMP '2024-02-10' - INTERVAL 1440 MINUTE)) SELECT problem_id, block_id FROM p WHERE place = 1")
def j12_next_question(spark, sf_dir):
    q, asked = _questions(spark, sf_dir), _asked(spark, sf_dir)
    pending = flow.pending_questions(q, flow.question_lifecycle(q, asked, _then()))
    return flow.next_question(pending, asked, _then()).select("problem_id", "block_id")


@query(f"WITH {DELTAS} SELECT r.problem_id, r.block_id, r.kind, r.target_id, count(*) AS n FROM rel r ANTI JOIN blocks b ON b.problem_id = r.problem_id AND b.block_id = r.target_id GROUP BY ALL")
def j14_relation_targets(spark, sf_dir):
    return flow.relation_targets(blocks(spark, sf_dir)).groupBy("problem_id", "block_id", "kind", "target_id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {DELTAS}, w AS (SELECT problem_id, block_id AS start, superseded_by AS pos, 1 AS d, block_id AS least FROM blocks WHERE superseded_by IS NOT NULL
UNION ALL SELECT w.problem_id, w.start, b.superseded_by, d + 1, least(w.least, b.block_id) FROM w JOIN blocks b ON b.problem_id = w.problem_id AND b.block_id = w.pos WHERE b.superseded_by IS NOT NULL AND w.pos <> w.start AND d < 13)
SELECT problem_id, start AS block_id, least AS cycle FROM w WHERE pos = start""")
def g9_supersede_cycles(spark, sf_dir):
    return flow.supersede_cycles(blocks(spark, sf_dir))


@query(f"WITH {DELTAS} SELECT 'broken-supersede-chain' AS rule_id, problem_id, block_id FROM blocks b WHERE superseded_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocks x WHERE x.problem_id = b.problem_id AND x.block_id = b.superseded_by) UNION ALL SELECT 'cause-needs-provenance', problem_id, block_id FROM blocks WHERE type = 'Cause' AND status = 'confirmed' UNION ALL SELECT 'hypothesis-needs-provenance', problem_id, block_id FROM blocks WHERE type = 'Hypothesis' AND status = 'confirmed'")
def p5_structural_violations(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumns({"gap_id": F.lit(None).cast("string"), "supported_by": F.lit(None).cast("array<string>")})
    return govern.structural_violations(b, govern.STRUCTURAL_RULES).drop("severity")


@query(f"WITH {DELTAS} SELECT problem_id, block_id, 'stale-decay' AS reason FROM blocks WHERE status = 'confirmed' AND created_at + INTERVAL 45 DAY <= TIMESTAMP '2024-03-05'")
def p11_decay_blocks(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("stale_after", F.col("created_at") + F.expr("interval 45 days"))
    return ledger.decay_blocks(b, now()).select("problem_id", "block_id", "reason")


@query(f"WITH {DELTAS}, m AS (SELECT DISTINCT problem_id % 5 AS module_id FROM blocks), n AS (SELECT problem_id % 5 AS module_id, type, count(*) AS n FROM blocks GROUP BY ALL UNION ALL SELECT module_id, 'Cause', 10 FROM m), s AS (SELECT module_id, type, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL) SELECT module_id, module_id >= 3 AS promote, string_agg(type || '=' || n, ',' ORDER BY type) AS patterns FROM s GROUP BY ALL")
def a15_ontology_counts(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("module_id", F.col("problem_id") % 5)
    modules = b.select("module_id").distinct().select("module_id", F.create_map(F.lit("Cause"), F.lit(10).cast("long")).alias("patterns"), F.col("module_id").alias("resolved_runs"), F.lit(False).alias("promoted"))
    out = flow.ontology_counts(b, modules)
    pairs = F.array_sort(F.transform(F.map_entries("patterns"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return out.select("module_id", "promote", F.array_join(pairs, ",").alias("patterns"))


@query(f"WITH RECURSIVE {PAIRS}, walk AS (SELECT a, b, 1 AS depth, [a, b] AS path FROM pairs UNION ALL SELECT walk.a, pairs.b, depth + 1, list_append(path, pairs.b) FROM walk JOIN pairs ON walk.b = pairs.a WHERE depth < 4 AND pairs.b <> walk.a) SELECT a, b, min(depth) AS depth, array_to_string(arg_min(path, (depth, path)), ',') AS path FROM walk GROUP BY ALL")
def g3_compose_closure(spark, sf_dir):
    return graph.compose_closure(delegation_pairs(spark, sf_dir), depth=4).select("a", "b", "depth", joined("path").alias("path"))


@query(f"WITH RECURSIVE {PAIRS}, walk AS (SELECT a AS id, a AS node_id, 0 AS depth FROM pairs UNION SELECT id, pairs.b, depth + 1 FROM walk JOIN pairs ON node_id = pairs.a WHERE depth < 3), m AS (SELECT id, node_id, min(depth) AS depth FROM walk GROUP BY ALL) SELECT * FROM m WHERE depth > 0")
def g2_reachable(spark, sf_dir):
    p = delegation_pairs(spark, sf_dir)
    edges = p.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("DELEGATES_TO").alias("relation"), F.lit(True).alias("resolved"))
    return graph.reachable(edges, p.select(F.col("a").alias("id")).distinct(), 3)


@query(f"WITH RECURSIVE {PAIRS}, p AS (SELECT a AS start, [a, b] AS path, b AS last FROM pairs WHERE a < b UNION ALL SELECT start, list_append(path, b), b FROM p JOIN pairs ON last = a WHERE b > start AND NOT list_contains(path, b) AND len(path) < 6) SELECT DISTINCT array_to_string(path, ',') AS cycle FROM p JOIN pairs ON last = a AND b = start")
def g4_delegation_cycles(spark, sf_dir):
    return graph.delegation_cycles(delegation_pairs(spark, sf_dir), longest=6).select(joined("cycle").alias("cycle"))


USES = "uses AS (SELECT DISTINCT l_partkey AS action, l_suppkey AS skill FROM lineitem)"


def _uses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("action"), F.col("l_suppkey").alias("skill"))


@query(f"WITH {USES} SELECT action, count(*) AS n, string_agg(skill, ',' ORDER BY skill) AS skills FROM uses GROUP BY action HAVING count(*) >= 2")
def a23_shared_actions(spark, sf_dir):
    return graph.shared_actions(_uses(spark, sf_dir)).select("action", "n", joined("skills").alias("skills"))


@query(f"WITH {PAIRS}, {USES}, two AS (SELECT a, b FROM pairs UNION SELECT x.a, y.b FROM pairs x JOIN pairs y ON x.b = y.a WHERE x.a <> y.b), u AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM two), t AS (SELECT action, count(*) AS n FROM uses GROUP BY action HAVING count(*) >= 2), l AS (SELECT l.action, count(*) AS in_chain FROM u JOIN uses l ON l.skill = x JOIN uses r ON r.skill = y AND r.action = l.action GROUP BY l.action) SELECT action, coalesce(in_chain, 0) AS in_chain, n * (n - 1) // 2 - coalesce(in_chain, 0) AS cross_skill FROM t LEFT JOIN l USING (action)")
def g6_chain_duplicates(spark, sf_dir):
    return graph.chain_duplicates(_uses(spark, sf_dir), graph.compose_closure(delegation_pairs(spark, sf_dir), depth=2))


def _kg(spark, sf_dir):
    """Suppliers as skill nodes, orders' customers as canonical ones; delegation edges from lineitem, some dangling."""
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("node_id"), F.lit("scheduling").alias("node_type"), F.concat(F.lit("skill"), "s_suppkey").alias("slug"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    to = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("n"), F.col("l_partkey") % 150)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("skill"), F.col("l_partkey") % 150)).otherwise(F.concat(F.lit("gone"), F.col("l_partkey") % 150))
    edges = li.select(F.concat(F.lit("n"), "l_suppkey").alias("from_id"), to.alias("to_id"), F.when(F.col("l_linenumber") % 2 == 0, "DELEGATES_TO").otherwise("USES_ACTION").alias("relation"), F.concat(F.lit("skill"), "l_suppkey").alias("from_skill"), F.concat(F.lit('{"whenCondition":"c'), "l_linenumber", F.lit('"}')).alias("properties")).distinct()
    return nodes, graph.resolve_edges(edges, nodes)


KG = """nodes AS (SELECT 'n' || s_suppkey AS node_id, 'skill' || s_suppkey AS slug FROM supplier),
edges AS (SELECT DISTINCT 'n' || l_suppkey AS from_id, CASE l_partkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'skill' ELSE 'gone' END || (l_partkey % 150) AS to_id, CASE WHEN l_linenumber % 2 = 0 THEN 'DELEGATES_TO' ELSE 'USES_ACTION' END AS relation, 'skill' || l_suppkey AS from_skill, 'c' || l_linenumber AS cond FROM lineitem),
res AS (SELECT e.*, CASE WHEN relation = 'DELEGATES_TO' THEN coalesce(b.slug, a.slug) ELSE a.slug END AS to_skill FROM edges e LEFT JOIN nodes a ON a.node_id = to_id LEFT JOIN nodes b ON b.slug = to_id)"""


@query(f"WITH {KG} SELECT from_id, to_id, relation, to_skill, count(*) AS n FROM res GROUP BY ALL")
def j2_resolve_edges(spark, sf_dir):
    _, edges = _kg(spark, sf_dir)
    return edges.groupBy("from_id", "to_id", "relation", "to_skill").agg(F.count("*").alias("n"))


@query(f"WITH {KG}, sides AS (SELECT from_id AS id, to_id AS node_id FROM res WHERE to_skill IS NOT NULL UNION SELECT to_id, from_id FROM res WHERE to_skill IS NOT NULL), r AS (SELECT id, node_id, row_number() OVER (PARTITION BY id ORDER BY node_id) AS n FROM sides WHERE id IN (SELECT node_id FROM nodes)) SELECT id, r.node_id, slug FROM r JOIN nodes USING (node_id) WHERE n <= 100")
def j3_neighbors(spark, sf_dir):
    nodes, edges = _kg(spark, sf_dir)
    return graph.neighbors(nodes, edges, nodes.select(F.col("node_id").alias("id")), direction="both").select("id", "node_id", "slug")


@query(f"""WITH {KG} SELECT 'delegations out' AS question, from_id AS id, to_id AS neighbour, relation, 'out' AS direction, count(*) AS n FROM res WHERE relation = 'DELEGATES_TO' AND from_id IN (SELECT node_id FROM nodes) GROUP BY ALL
UNION ALL SELECT 'actions in', to_id, from_id, relation, 'in', count(*) FROM res WHERE relation = 'USES_ACTION' AND to_id IN (SELECT node_id FROM nodes) AND to_skill IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'all', from_id, to_id, relation, 'out', count(*) FROM res WHERE from_id IN (SELECT node_id FROM nodes) AND to_skill IS NOT NULL GROUP BY ALL UNION ALL SELECT 'all', to_id, from_id, relation, 'in', count(*) FROM res WHERE to_id IN (SELECT node_id FROM nodes) AND to_skill IS NOT NULL GROUP BY ALL""")
def j4_incident_edges(spark, sf_dir):
    nodes, edges = _kg(spark, sf_dir)
    edges, ids = saved(edges), nodes.select(F.col("node_id").alias("id"))
    asked = {"delegations out": ("DELEGATES_TO", "out", False), "actions in": ("USES_ACTION", "in", True), "all": (None, "both", True)}
    parts = [graph.incident_edges(edges, ids, *how).withColumn("question", F.lit(name)) for name, how in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("question", "id", "neighbour", "relation", "direction").agg(F.count("*").alias("n"))


@query(f"WITH {KG} SELECT node_id, slug FROM nodes WHERE CAST(substr(node_id, 2) AS BIGINT) % 3 = 0 OR CAST(substr(node_id, 2) AS BIGINT) % 5 = 0")
def j4_nodes_of(spark, sf_dir):
    nodes, _ = _kg(spark, sf_dir)
    at = F.substring("node_id", 2, 20).cast("long")
    return graph.nodes_of(nodes, nodes.where(at % 3 == 0).select(F.col("node_id").alias("id")), nodes.where(at % 5 == 0).select("slug")).select("node_id", "slug")


@query(f"WITH {KG} SELECT from_skill, from_id, cond AS condition FROM res WHERE relation = 'DELEGATES_TO' AND to_skill = 'skill7'")
def j5_reverse_delegators(spark, sf_dir):
    return graph.reverse_delegators(_kg(spark, sf_dir)[1], "skill7")


@query(f"WITH {KG} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT slug) FROM nodes) AS skills, count(*) AS edges, count(*) FILTER (to_skill IS NULL) AS dangling FROM res")
def a12_kg_stats(spark, sf_dir):
    return graph.kg_stats(*_kg(spark, sf_dir))


@query(f"WITH {KG} SELECT from_id, to_id, relation, cond AS condition FROM res WHERE to_skill IS NULL")
def j6_dangling_edges(spark, sf_dir):
    return graph.dangling_edges(_kg(spark, sf_dir)[1]).select("from_id", "to_id", "relation", F.get_json_object("properties", "$.whenCondition").alias("condition"))


LOGICAL = "logical AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS logical_id, l_suppkey AS skill, CASE WHEN l_quantity > 25 THEN 'WRITE' ELSE 'READ' END AS action, CASE WHEN l_partkey % 5 = 0 THEN ['NETWORK'] WHEN l_partkey % 7 = 0 THEN ['CREDENTIALS', 'MEMORY'] ELSE ['MEMORY'] END AS resources, l_returnflag AS flag FROM lineitem), scenes AS (SELECT *, CASE flag WHEN 'R' THEN 'ACT' WHEN 'A' THEN 'REASON' ELSE 'VERIFY' END AS scene FROM logical)"


def _logical(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    resources = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit("NETWORK"))).when(F.col("l_partkey") % 7 == 0, F.array(F.lit("CREDENTIALS"), F.lit("MEMORY"))).otherwise(F.array(F.lit("MEMORY")))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("logical_id"), F.col("l_suppkey").alias("skill"), F.when(F.col("l_quantity") > 25, "WRITE").otherwise("READ").alias("action"), resources.alias("resources"), F.col("l_returnflag").alias("flag"), F.lit(None).cast("string").alias("action_ref"))


@query(f"WITH {LOGICAL} SELECT rule, severity, skill, count(*) AS n FROM (SELECT 'credentials' AS rule, 'critical' AS severity, skill FROM logical WHERE list_contains(resources, 'CREDENTIALS') UNION ALL SELECT 'write-network', 'warning', skill FROM logical WHERE action = 'WRITE' AND list_contains(resources, 'NETWORK') UNION ALL SELECT 'write-outside-scene', 'warning', skill FROM scenes WHERE action = 'WRITE' AND scene <> 'ACT' UNION ALL SELECT 'many-scopes', 'info', skill FROM (SELECT skill, unnest(resources) AS s FROM logical) GROUP BY skill HAVING count(DISTINCT s) >= 3) GROUP BY ALL")
def p15_skill_risks(spark, sf_dir):
    lo = _logical(spark, sf_dir)
    scene = F.when(F.col("flag") == "R", "ACT").when(F.col("flag") == "A", "REASON").otherwise("VERIFY")
    structural = lo.select("skill", scene.alias("scene"), F.col("logical_id").alias("seq"), F.array("logical_id").alias("logical_ids"))
    return govern.skill_risks(lo, structural).groupBy("rule", "severity", "skill").agg(F.count("*").alias("n"))


@query(f"WITH {LOGICAL}, s AS (SELECT skill, logical_id, action || '|' || array_to_string(list_sort(resources), ',') AS signature FROM logical) SELECT signature, count(*) AS n, count(DISTINCT skill) AS skills FROM s WHERE signature <> 'READ|MEMORY' GROUP BY signature HAVING count(*) >= 3")
def a8_canonical_candidates(spark, sf_dir):
    known = spark.range(1).select(F.lit("READ|MEMORY").alias("signature"))
    return govern.canonical_candidates(_logical(spark, sf_dir), known).select("signature", "n", "skills")


@query("SELECT coalesce(b.name, a.name) AS name, coalesce(b.definition, a.definition) AS definition FROM (SELECT p_partkey AS name, 'part' || p_partkey AS definition FROM part) a FULL JOIN (SELECT s_suppkey * 3 AS name, 'ext' || s_suppkey AS definition FROM supplier) b USING (name)")
def u2_canonical_vocab(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.concat(F.lit("part"), "p_partkey").alias("definition"))
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("name"), F.concat(F.lit("ext"), "s_suppkey").alias("definition"))
    return govern.canonical_vocab(items, more)


@query(f"WITH {VOI} SELECT problem_id, 'Gap' AS type, detector_id || ':' || subject_id AS block_id, round(greatest(0, least(1, voi)), 6) AS voi, CAST(NULL AS VARCHAR) AS lifecycle FROM voi")
def g10_project_flow(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumns({"gap_id": F.lit(None).cast("string"), "bundle_id": F.lit(None).cast("string")})
    return flow.project_flow(b, _asked(spark, sf_dir), now()).select("problem_id", "type", "block_id", F.round("voi", 6).alias("voi"), "lifecycle")
