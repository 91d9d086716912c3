"""Skill graphs: projection, neighbours, reachability, closure, cycles, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.retrieval import Index, bm25
from mnemoframe.functions import text as T
from mnemoframe.functions.helpers import saved

DELEGATES = "DELEGATES_TO"


def project_graph(skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of skill documents (slug, seq, scheduling, structural[], logical[], decisions[], interactions[],
    evidence[], protocols[]). A node that two documents define is the later one's."""
    slug, none = F.col("slug"), F.lit(None).cast("string")

    def node(kind: str, items: str, scene, action, label) -> DataFrame:
        x = skills.select("slug", "seq", F.explode(items).alias("x"))
        return x.select(F.col("x.id").alias("node_id"), F.lit(kind).alias("node_type"), "slug", scene.alias("scene"), action.alias("action"), label.alias("label"), "seq")

    x = F.col
    nodes = skills.select(F.concat(slug, F.lit("#scheduling")).alias("node_id"), F.lit("scheduling").alias("node_type"), "slug", none.alias("scene"), none.alias("action"), F.col("scheduling.skill_name").alias("label"), "seq")
    for part in (
        node("structural", "structural", x("x.scene"), none, x("x.summary")),
        node("logical", "logical", none, x("x.action"), x("x.description")),
        node("decision", "decisions", none, none, x("x.question")),
        node("interaction", "interactions", none, none, x("x.prompt")),
        node("evidence", "evidence", none, none, x("x.case_label")),
        node("protocol", "protocols", none, none, x("x.delegate_to")),
    ):
        nodes = nodes.unionByName(part)
    refs = skills.select("slug", "seq", F.explode("logical").alias("x")).where("x.action_ref is not null")
    nodes = nodes.unionByName(refs.select(x("x.action_ref").alias("node_id"), F.lit("canonical-action").alias("node_type"), F.lit("").alias("slug"), none.alias("scene"), x("x.action").alias("action"), x("x.action_ref").alias("label"), "seq"))
    nodes = nodes.groupBy("node_id").agg(F.max_by(F.struct("node_type", "slug", "scene", "action", "label"), "seq").alias("n")).select("node_id", "n.*")

    def edges_of(rows: DataFrame, relation: str, start, end, properties=None) -> DataFrame:
        return rows.select(start.alias("from_id"), end.alias("to_id"), F.lit(relation).alias("relation"), F.col("slug").alias("from_skill"), (properties if properties is not None else none).alias("properties"))

    structural = skills.select("slug", F.explode("structural").alias("x"))
    edges = edges_of(structural, "HAS_SCENE", F.concat(slug, F.lit("#scheduling")), x("x.id"))
    edges = edges.unionByName(edges_of(structural.select("slug", "x", F.explode("x.contains_logical_ids").alias("to")), "CONTAINS", x("x.id"), x("to")))
    edges = edges.unionByName(edges_of(structural.select("slug", "x", F.explode("x.transitions_to").alias("to")), "TRANSITIONS_TO", x("x.id"), x("to")))
    edges = edges.unionByName(edges_of(refs.select("slug", "x"), "USES_ACTION", x("x.id"), x("x.action_ref")))
    for items in ("decisions", "interactions", "evidence"):
        rows = skills.select("slug", F.explode(items).alias("x")).where("x.scope_ref is not null")
        edges = edges.unionByName(edges_of(rows, "SCOPED_TO", x("x.id"), x("x.scope_ref")))
    protocols = skills.select("slug", F.explode("protocols").alias("x"))
    edges = edges.unionByName(edges_of(protocols, DELEGATES, x("x.id"), x("x.delegate_to"), F.to_json(F.struct(x("x.when").alias("whenCondition")))))
    return nodes, edges


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Delegations whose target is a known node or slug get ``to_skill`` and ``resolved``; others resolve by node."""
    by_id = nodes.groupBy(F.col("node_id").alias("to_id")).agg(F.max("slug").alias("skill_of_node"))
    by_slug = nodes.where("slug <> ''").select(F.col("slug").alias("to_id")).distinct().withColumn("own_slug", F.col("to_id"))
    found = edges.join(by_id, "to_id", "left").join(by_slug, "to_id", "left")
    skill = F.when(F.col("relation") == DELEGATES, F.coalesce("own_slug", "skill_of_node")).otherwise(F.col("skill_of_node"))
    return found.withColumns({"to_skill": skill, "resolved": skill.isNotNull()}).drop("skill_of_node", "own_slug")


def incident_edges(edges: DataFrame, ids: DataFrame, relation: str | None = None, direction: str = "both", resolved_only: bool = True) -> DataFrame:
    """(id, neighbour, relation, direction) of the edges at ``ids`` (column id). "both" is a union of two joins."""
    rows = edges if relation is None else edges.where(F.col("relation") == relation)
    rows = rows.where("resolved") if resolved_only else rows
    out = rows.select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    back = rows.select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbour"), "relation", F.lit("in").alias("direction"))
    wanted = {"out": [out], "in": [back], "both": [out, back]}[direction]
    joined = [d.join(ids.select("id").distinct(), "id") for d in wanted]
    return joined[0] if len(joined) == 1 else joined[0].unionByName(joined[1])


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, relation: str | None = None, direction: str = "out", resolved_only: bool = True, limit: int = 100) -> DataFrame:
    """Distinct neighbour nodes of each id, at most ``limit`` by node id."""
    pairs = incident_edges(edges, ids, relation, direction, resolved_only).select("id", F.col("neighbour").alias("node_id")).distinct()
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("node_id"))).where(F.col("_n") <= limit).drop("_n")
    return ranked.join(nodes, "node_id")


def nodes_of(nodes: DataFrame, ids: DataFrame | None = None, slugs: DataFrame | None = None) -> DataFrame:
    """Nodes by id or by skill."""
    parts = []
    if ids is not None:
        parts.append(nodes.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi"))
    if slugs is not None:
        parts.append(nodes.join(slugs.select("slug").distinct(), "slug", "left_semi"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def reverse_delegators(edges: DataFrame, slug: str) -> DataFrame:
    """Who delegates to a skill, and on what condition."""
    rows = edges.where((F.col("relation") == DELEGATES) & (F.col("to_skill") == slug))
    return rows.select("from_skill", "from_id", F.get_json_object("properties", "$.whenCondition").alias("condition"))


def dangling_edges(edges: DataFrame) -> DataFrame:
    return edges.where("not resolved")


def kg_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.agg(F.count("*").alias("edges"), F.count_if(~F.col("resolved")).alias("dangling"))
    return nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.nullif("slug", F.lit(""))).alias("skills")).crossJoin(counts)


def reachable(edges: DataFrame, ids: DataFrame, depth: int, relations: Sequence[str] | None = None, limit: int = 200) -> DataFrame:
    """(id, node_id, depth): nodes within ``depth`` hops of each id over resolved edges, the start left out; at most
    ``limit`` for each id by (depth, node). A frontier loop: only new nodes go on, so work is bounded by edges x ids."""
    usable = edges.where("resolved") if relations is None else edges.where("resolved").where(F.col("relation").isin(list(relations)))
    steps = usable.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("next")).distinct()
    seen = ids.select("id", F.col("id").alias("node_id"), F.lit(0).alias("depth")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        new = saved(front.join(steps, "node_id").select("id", F.col("next").alias("node_id")).distinct().join(seen, ["id", "node_id"], "left_anti").withColumn("depth", F.lit(hop)))
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    found = seen.where("depth > 0")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("depth", "node_id"))).where(F.col("_n") <= limit).drop("_n")


def delegations(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) skill pairs that resolved delegations link, self loops out."""
    return edges.where((F.col("relation") == DELEGATES) & F.col("resolved") & (F.col("from_skill") != F.col("to_skill"))).select(F.col("from_skill").alias("a"), F.col("to_skill").alias("b")).distinct()


def compose_closure(pairs: DataFrame, depth: int = 10) -> DataFrame:
    """(a, b, depth, path): skills that reach each other over (a, b) pairs, with the shortest, then smallest path.

    Breadth first on pairs, not on paths: a round keeps one path for each new pair.
    """
    steps = pairs.select(F.col("a").alias("mid"), F.col("b").alias("next"))
    seen = pairs.select("a", "b", F.lit(1).alias("depth"), F.array("a", "b").alias("path"))
    front = seen
    for hop in range(2, depth + 1):
        longer = front.select("a", F.col("b").alias("mid"), "path").join(steps, "mid").where("a <> next")
        longer = longer.groupBy("a", F.col("next").alias("b")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        new = saved(longer.join(seen.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(hop).alias("depth"), "path"))
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen


def cycle_core(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """``pairs`` without nodes that cannot be on a cycle: those without a way in or out are peeled off in rounds."""
    count = pairs.count()
    for _ in range(rounds):
        inner = pairs.select("a").intersect(pairs.select("b")).withColumnRenamed("a", "n")
        pairs = saved(pairs.join(inner.withColumnRenamed("n", "a"), "a", "left_semi").join(inner.withColumnRenamed("n", "b"), "b", "left_semi"))
        left = pairs.count()
        if left == count:
            break
        count = left
    return pairs


def delegation_cycles(pairs: DataFrame, longest: int = 11) -> DataFrame:
    """(cycle): simple cycles of up to ``longest`` skills, each once, from its smallest skill."""
    core = cycle_core(pairs)
    steps = core.select(F.col("a").alias("last"), F.col("b").alias("next"))
    paths = core.where("a < b").select(F.array("a", "b").alias("path"), F.col("a").alias("start"), F.col("b").alias("last"))
    cycles = None
    for size in range(2, longest + 1):
        ahead = paths.join(steps, "last")
        closed = ahead.where("next = start").select(F.col("path").alias("cycle"))
        cycles = closed if cycles is None else cycles.unionByName(closed)
        if size == longest:
            break
        paths = saved(ahead.where("next > start and not array_contains(path, next)").select(F.concat("path", F.array("next")).alias("path"), "start", F.col("next").alias("last")))
        if paths.isEmpty():
            break
    return cycles.distinct()


def shared_actions(uses: DataFrame, least: int = 2) -> DataFrame:
    """(action, skills, n): actions that at least ``least`` skills use, from distinct (action, skill) rows."""
    counts = uses.select("action", "skill").distinct().groupBy("action").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("skill")).alias("skills"))
    return counts.where(F.col("n") >= least)


def chain_duplicates(uses: DataFrame, closure: DataFrame) -> DataFrame:
    """(action, in_chain, cross_skill): pairs of skills that share an action, split by whether one composes the other.

    In-chain pairs start from the closure and join the users of each end; all pairs of an action are only counted,
    n(n-1)/2, never made.
    """
    users = uses.select("action", "skill").distinct()
    pairs = closure.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    left, right = users.withColumnRenamed("skill", "x"), users.withColumnRenamed("skill", "y")
    linked = pairs.join(left, "x").join(right, ["action", "y"]).groupBy("action").agg(F.count("*").alias("in_chain"))
    totals = users.groupBy("action").agg(F.count("*").alias("n")).where("n >= 2")
    rows = totals.join(linked, "action", "left").withColumn("in_chain", F.coalesce("in_chain", F.lit(0)))
    return rows.select("action", "in_chain", (F.col("n") * (F.col("n") - 1) / 2 - F.col("in_chain")).cast("long").alias("cross_skill"))


def find_chains(goals: DataFrame, index: Index, closure: DataFrame, top: int = 5, hits: int = 20) -> DataFrame:
    """(query_id, root, total, max_hit, matched, rank): chains of skills whose members match all words of a goal.

    ``index`` has skills as documents. Roots are the skills that compose a hit, or the hit itself if none does.
    """
    asked = goals.select("query_id", T.plain_terms(F.col("question")).alias("terms"))
    sizes = asked.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"))
    found = bm25(asked, index, prefix=True).join(sizes, "query_id").where("matched = wanted")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "doc_id"))).where(F.col("_n") <= hits)
    hit = best.select("query_id", F.col("doc_id").alias("skill"), F.abs("score").alias("hit"))
    up = closure.select(F.col("b").alias("skill"), F.col("a").alias("root"))
    roots = hit.join(up, "skill", "left").select("query_id", F.coalesce("root", "skill").alias("root")).distinct()
    members = closure.select(F.col("a").alias("root"), F.col("b").alias("skill"))
    chain = roots.join(members, "root").select("query_id", "root", "skill").unionByName(roots.select("query_id", "root", F.col("root").alias("skill"))).distinct()
    scored = chain.join(hit, ["query_id", "skill"]).groupBy("query_id", "root").agg(F.sum("hit").alias("total"), F.max("hit").alias("max_hit"), F.count("*").alias("matched"))
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), F.desc("matched"), "root")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
