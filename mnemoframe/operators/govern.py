"""Governance: detectors over claims, pages, skills and blocks. "Now" is always given."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.functions.helpers import isolated

#: The vocabulary of skill documents.
SCENES = ["PREPARE", "ACQUIRE", "REASON", "ACT", "VERIFY", "RECOVER", "FINALIZE"]
ACTIONS = ["READ", "WRITE", "CALL_TOOL", "INFER", "EMIT", "WAIT", "BRANCH", "SCHEDULE", "TRANSFORM"]
SCOPES = ["MEMORY", "LOCAL_FS", "CREDENTIALS", "NETWORK", "DATABASE", "QUEUE"]
FLOW_FEATURES = ["branching", "loop", "scheduled_retry", "network_access", "credential_access", "long_running", "stateful"]
RESPONSES = ["free-text", "yes-no", "selection", "structured", "none"]
WRITING_SCENES = ["ACT", "RECOVER", "FINALIZE"]


def whole_days(now: Column, then: Column) -> Column:
    return F.floor((now.cast("double") - then.cast("double")) / 86400)


def _finding(rows: DataFrame, detector: str, severity: Column | str, subject: Column, evidence: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(detector).alias("detector_id"), level.alias("severity"), subject.cast("string").alias("subject"), evidence.alias("evidence"))


def low_confidence(claims: DataFrame, now: Column | None = None) -> DataFrame:
    """Accepted claims below 0.5 (info) or without evidence (warning); one claim may give both."""
    accepted = claims.where("status = 'accepted'")
    ids = F.array(F.col("candidate_id").cast("string"))
    weak = _finding(accepted.where("confidence < 0.5"), "low-confidence", "info", F.col("candidate_id"), ids)
    return weak.unionByName(_finding(accepted.where("evidence is null or size(evidence) = 0"), "low-confidence", "warning", F.col("candidate_id"), ids))


def stale_claims(claims: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Accepted claims created at least ``days`` whole days ago."""
    rows = claims.where((F.col("status") == "accepted") & (whole_days(now, F.col("created_at")) >= days))
    return _finding(rows, "stale-claims", "info", F.col("candidate_id"), F.array(F.col("candidate_id").cast("string")))


def review_queue(claims: DataFrame, now: Column, days: int = 7, warn: int = 14) -> DataFrame:
    """Claims pending for ``days`` or more; a warning from ``warn``."""
    age = whole_days(now, F.col("created_at"))
    rows = claims.where((F.col("status") == "pending") & (age >= days))
    return _finding(rows, "review-queue", F.when(age >= warn, "warning").otherwise("info"), F.col("candidate_id"), F.array(F.col("candidate_id").cast("string")))


def duplicate_claims(claims: DataFrame, now: Column | None = None, text: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Live claims with the same text in lower case, trimmed; ``text`` may apply NFKC first."""
    live = claims.where("status in ('pending', 'accepted')").withColumn("norm", F.trim(F.lower(text(F.col("proposed_text")))))
    groups = live.groupBy("norm").agg(F.array_sort(F.collect_list(F.col("candidate_id").cast("string"))).alias("ids")).where(F.size("ids") >= 2)
    return _finding(groups, "duplicate-candidates", "warning", F.col("norm"), F.col("ids"))


def contradictions(claims: DataFrame, now: Column | None = None) -> DataFrame:
    """Blocks with several accepted claims that are not invalidated, unless each is superseded by one of them."""
    rows = claims.where("status = 'accepted' and invalid_at is null")
    member = F.struct(F.col("candidate_id").cast("string").alias("id"), F.col("superseded_by").cast("string").alias("by"))
    groups = rows.groupBy("block_id").agg(F.array_sort(F.collect_list(member)).alias("m")).where(F.size("m") >= 2)
    chained = F.forall("m", lambda x: x["by"].isNotNull() & F.array_contains(F.col("m.id"), x["by"]))
    return _finding(groups.where(~chained), "contradictions", "warning", F.col("block_id"), F.col("m.id"))


DETECTORS = (duplicate_claims, stale_claims, contradictions, low_confidence, review_queue)


FINDING_COLUMNS = ("detector_id", "severity", "subject", "evidence")


def findings(claims: DataFrame, now: Column, detectors: Sequence = DETECTORS) -> DataFrame:
    """All findings of the detectors; a user's detector is a function of (claims, now) with the same columns."""
    return findings_and_failures(claims, now, detectors)[0]


def findings_and_failures(claims: DataFrame, now: Column, detectors: Sequence = DETECTORS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The findings, and the user's detectors that failed with their messages; each of these runs on its own."""
    tasks = [(getattr(d, "__name__", str(d)), partial(d, claims, now)) for d in detectors if d not in DETECTORS]
    found, failed = isolated(claims.sparkSession, tasks, FINDING_COLUMNS)
    for rows in (d(claims, now) for d in detectors if d in DETECTORS):
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no detector left")
    return found, failed


def governance_counts(claims: DataFrame, now: Column, detectors: Sequence = DETECTORS) -> DataFrame:
    return findings(claims, now, detectors).groupBy("detector_id").agg(F.count("*").alias("n"))


def page_decay(pages: DataFrame, recalls: DataFrame, now: Column, aging: int = 45, stale: int = 90, draft: int = 14, recall_days: int = 30) -> DataFrame:
    """``pages`` with age_days, recalls, last_recall and tier; an unparsable date is ``unknown``."""
    rows = pages.join(recalls, "page_id", "left")
    updated = F.try_to_timestamp(F.col("updated_at").cast("string"))
    age = whole_days(now, updated)
    recent = F.coalesce((now.cast("double") - F.col("last_recall").cast("double")) <= recall_days * 86400, F.lit(False))
    active = F.col("status") == "active"
    tier = (
        F.when(updated.isNull(), "unknown")
        .when((F.col("status") == "draft") & (age > draft), "stale-draft")
        .when(active & (age > stale) & ~recent, "decay-candidate")
        .when(active & (age > aging), "aging")
        .otherwise("fresh")
    )
    return rows.withColumns({"age_days": age, "recalls": F.coalesce("recalls", F.lit(0)), "tier": tier})


def skill_risks(logical: DataFrame, structural: DataFrame) -> DataFrame:
    """Risks from (skill, logical_id, action, resources[]) and (skill, scene, logical_ids[], seq): credentials; writing
    to the network; writing outside the writing scenes (the last containing scene counts); three scopes or more."""
    def risk(rows: DataFrame, rule: str, severity: str) -> DataFrame:
        return rows.select("skill", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "logical_id")

    scenes = structural.select("skill", "scene", "seq", F.explode("logical_ids").alias("logical_id")).groupBy("skill", "logical_id").agg(F.max_by("scene", "seq").alias("scene"))
    writes = logical.where("action = 'WRITE'")
    wide = logical.select("skill", F.explode("resources").alias("scope")).groupBy("skill").agg(F.count_distinct("scope").alias("n")).where("n >= 3").withColumn("logical_id", F.lit(None).cast(logical.schema["logical_id"].dataType))
    out = risk(logical.where(F.array_contains("resources", "CREDENTIALS")), "credentials", "critical")
    out = out.unionByName(risk(writes.where(F.array_contains("resources", "NETWORK")), "write-network", "warning"))
    out = out.unionByName(risk(writes.join(scenes.where(~F.col("scene").isin(WRITING_SCENES)), ["skill", "logical_id"]), "write-outside-scene", "warning"))
    return out.unionByName(risk(wide, "many-scopes", "info"))


def unknown_signatures(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` whose ``signature`` is not in ``known``."""
    return rows.join(known.select("signature").distinct(), "signature", "left_anti")


#: Parts of a signature whose least ids are taken on their own.
SAMPLE_PARTS = 64


def canonical_candidates(logical: DataFrame, known: DataFrame, least: int = 3, samples: int = 3) -> DataFrame:
    """Action and sorted resources that ``least`` logical nodes share without a reference and that are not known.

    A few signatures may cover all nodes, so ids are never gathered: the least of each of SAMPLE_PARTS parts of a
    signature are taken first.
    """
    signature = F.concat(F.col("action"), F.lit("|"), F.array_join(F.array_sort("resources"), ","))
    rows = unknown_signatures(logical.where("action_ref is null").withColumn("signature", signature), known)
    grouped = rows.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("skill").alias("skills")).where(F.col("n") >= least)
    ids = rows.where("logical_id is not null").select("signature", "logical_id").distinct().withColumn("part", F.pmod(F.xxhash64("logical_id"), F.lit(SAMPLE_PARTS)))
    for keys in (["signature", "part"], ["signature"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("logical_id"))).where(F.col("rank") <= samples)
    first = ids.groupBy(F.col("signature").alias("of")).agg(F.array_sort(F.collect_list("logical_id")).alias("samples"))
    none = F.array().cast(first.schema["samples"].dataType)
    return grouped.join(first, F.col("signature").eqNullSafe(F.col("of")), "left").select("signature", "n", "skills", F.coalesce("samples", none).alias("samples"))


def canonical_vocab(items: DataFrame, extensions: DataFrame) -> DataFrame:
    """The union of (name, definition) tables; an extension replaces an item of its name."""
    both = items.withColumn("p", F.lit(0)).unionByName(extensions.withColumn("p", F.lit(1)))
    return both.groupBy("name").agg(F.max_by("definition", "p").alias("definition"))


def structural_violations(blocks: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """(rule_id, severity, problem_id, block_id) of rules given as data: required-block-type (block_type, min_count),
    orphan-check (block_type, field), supersede-chain, provenance-check (block_type)."""
    known = blocks.select("problem_id", F.col("block_id").alias("_ref"))
    parts = []
    for rule in rules:
        kind = rule["type"]
        own = blocks.where("status = 'confirmed'").where(F.col("type") == rule.get("block_type", ""))
        if kind == "required-block-type":
            counts = blocks.groupBy("problem_id").agg(F.count_if((F.col("status") == "confirmed") & (F.col("type") == rule["block_type"])).alias("n"))
            rows = counts.where(F.col("n") < rule["min_count"]).select("problem_id", F.lit(None).cast("string").alias("block_id"))
        elif kind == "orphan-check":
            rows = own.withColumn("_ref", F.col(rule["field"])).join(known, ["problem_id", "_ref"], "left_anti")
        elif kind == "supersede-chain":
            rows = blocks.where("superseded_by is not null and superseded_by <> 'stale-decay'").withColumn("_ref", F.col("superseded_by")).join(known, ["problem_id", "_ref"], "left_anti")
        elif kind == "provenance-check":
            rows = own.where("supported_by is null or size(supported_by) = 0")
        else:
            raise ValueError(f"unknown rule type {kind!r}")
        parts.append(rows.select(F.lit(rule["id"]).alias("rule_id"), F.lit(rule["severity"]).alias("severity"), "problem_id", F.col("block_id").cast("string").alias("block_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The rules that every graph has to meet.
STRUCTURAL_RULES = [
    {"id": "orphan-question", "type": "orphan-check", "block_type": "Question", "field": "gap_id", "severity": "error"},
    {"id": "broken-supersede-chain", "type": "supersede-chain", "severity": "error"},
    {"id": "cause-needs-provenance", "type": "provenance-check", "block_type": "Cause", "severity": "warning"},
    {"id": "hypothesis-needs-provenance", "type": "provenance-check", "block_type": "Hypothesis", "severity": "warning"},
]


def validate_skills(docs: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(slug, errors): what is wrong with each skill document; valid ones have an empty array.

    ``docs`` as for project_graph; ``canonical`` is (action_ref, action, resources[]).
    """
    text = F.concat
    structural_ids, logical_ids = F.col("structural.id"), F.col("logical.id")

    def errors(items: str, check: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(F.coalesce(F.col(items), F.array()), lambda x: F.array_compact(check(x))))

    def bad(condition: Column, *message) -> Column:
        return F.when(condition, text(*(F.coalesce(m.cast("string"), F.lit("null")) if isinstance(m, Column) else F.lit(m) for m in message)))

    def missing(items: Column, known: Column, *message) -> Column:
        return F.transform(F.array_except(F.coalesce(items, F.array().cast("array<string>")), known), lambda r: text(*(m if isinstance(m, Column) else F.lit(m) for m in message), r))

    scopes = F.array_union(structural_ids, logical_ids)
    dangling = lambda kind, x: bad(x["scope_ref"].isNotNull() & ~F.array_contains(scopes, x["scope_ref"]), f"{kind} ", x["id"], ": dangling scope ", x["scope_ref"])
    every = [
        F.array_compact(F.array(bad(~F.coalesce(F.col("ssl_version").startswith("0.3"), F.lit(False)), "version is not 0.3.x: ", F.col("ssl_version")))),
        missing(F.col("scheduling.control_flow_features"), F.array(*map(F.lit, FLOW_FEATURES)), "unknown control flow feature "),
        errors("structural", lambda x: F.array(bad(~x["scene"].isin(SCENES), "structural ", x["id"], ": unknown scene ", x["scene"]))),
        F.flatten(F.transform("structural", lambda x: missing(x["contains_logical_ids"], logical_ids, "structural ", x["id"], ": dangling logical "))),
        F.flatten(F.transform("structural", lambda x: missing(x["transitions_to"], structural_ids, "structural ", x["id"], ": dangling transition "))),
        errors("decisions", lambda x: F.array(bad(x["id"].isNull(), "decision without id"), bad(F.coalesce(F.size(x["branches"]), F.lit(0)) <= 0, "decision ", x["id"], ": no branches"), dangling("decision", x))),
        errors("interactions", lambda x: F.array(bad(x["prompt"].isNull(), "interaction ", x["id"], ": no prompt"), bad(~F.coalesce(x["expected_response_type"].isin(RESPONSES), F.lit(False)), "interaction ", x["id"], ": unknown response type"), bad((x["expected_response_type"] == "selection") & (F.coalesce(F.size(x["options"]), F.lit(0)) <= 0), "interaction ", x["id"], ": no options"), dangling("interaction", x))),
        errors("evidence", lambda x: F.array(bad(x["case_label"].isNull(), "evidence ", x["id"], ": no case label"), dangling("evidence", x))),
        errors("protocols", lambda x: F.array(bad(F.coalesce(x["delegate_to"], F.lit("")) == "", "protocol ", x["id"], ": no target"), dangling("protocol", x))),
        errors("logical", lambda x: F.array(bad(~F.coalesce(x["action"].isin(ACTIONS), F.lit(False)), "logical ", x["id"], ": unknown action ", x["action"]), bad(F.trim(x["instructions"]) == "", "logical ", x["id"], ": empty instructions"))),
        F.flatten(F.transform("logical", lambda x: missing(x["resources"], F.array(*map(F.lit, SCOPES)), "logical ", x["id"], ": unknown resource "))),
    ]
    out = docs.select("slug", F.concat(*every).alias("errors"))
    if canonical is None:
        return out
    refs = docs.select("slug", F.explode("logical").alias("x")).where("x.action_ref is not null").select("slug", F.col("x.action_ref").alias("action_ref"), "x")
    known = canonical.select("action_ref", F.col("action").alias("c_action"), F.col("resources").alias("c_resources"))
    joined = refs.join(known, "action_ref", "left")
    less, more = F.array_except("c_resources", F.col("x.resources")), F.array_except(F.col("x.resources"), F.col("c_resources"))
    head = text(F.lit("logical "), F.col("x.id"), F.lit(": action ref "), F.col("action_ref"))
    problems = F.when(F.col("c_action").isNull(), F.array(text(head, F.lit(" is not known")))).otherwise(
        F.array_compact(F.array(F.when(F.col("c_action") != F.col("x.action"), text(head, F.lit(" is of action "), F.col("c_action"))), F.when((F.size(less) > 0) | (F.size(more) > 0), text(head, F.lit(" misses ["), F.array_join(less, ","), F.lit("] and adds ["), F.array_join(more, ","), F.lit("]")))))
    )
    by_slug = joined.select("slug", F.explode(problems).alias("e")).groupBy("slug").agg(F.array_sort(F.collect_list("e")).alias("more"))
    return out.join(by_slug, "slug", "left").select("slug", F.concat("errors", F.coalesce("more", F.array().cast("array<string>"))).alias("errors"))


#: Words of headings that name a scene, and words that show a control-flow feature.
SCENE_WORDS = [("PREPARE", "prepare|setup|prerequisite|before"), ("ACQUIRE", "gather|collect|read|fetch|input"), ("VERIFY", "verify|test|check|validat"), ("RECOVER", "recover|error|fail|rollback|troubleshoot"), ("FINALIZE", "final|finish|output|report|summary"), ("REASON", "analy|plan|decide|design|think"), ("ACT", "act|run|execute|implement|apply|step|usage")]
FLOW_WORDS = [("branching", r"\bif\b|otherwise|depending"), ("loop", r"repeat|for each|until|iterate"), ("scheduled_retry", r"retry|cron|schedule"), ("network_access", r"https?://|\bapi\b|fetch|download"), ("credential_access", r"credential|api key|token|secret|password"), ("long_running", r"background|long-running|daemon"), ("stateful", r"\bstate\b|persist|cache|checkpoint")]


def normalize_skills(pages: DataFrame) -> DataFrame:
    """(slug, intents, features, dependencies, scenes): skill markdown (slug, description, body) as a skill document.

    Each ``## `` heading is a scene by the first keyword that it has (else REASON) and leads to the next; backticked
    words of a section are its tools, at most 20 over the document.
    """
    def step(seq: Column) -> Column:
        return F.concat_ws("#", "slug", F.concat(F.lit("s"), seq))

    def scene(part: Column, i: Column, number: Column) -> Column:
        title = F.trim(F.substring_index(part, "\n", 1))
        kind = lambda low: F.coalesce(*(F.when(low.rlike(w), F.lit(s)) for s, w in SCENE_WORDS), F.lit("REASON"))
        tools = F.array_distinct(F.regexp_extract_all(part, F.lit(r"`([A-Za-z][\w./-]*)`"), F.lit(1)))
        following = F.array_compact(F.array(F.when(i + 1 < number, step(i + 2))))
        return F.struct(step(i + 1).alias("id"), F.transform(F.array(F.lower(title)), kind)[0].alias("scene"), title.alias("summary"), tools.alias("tools"), following.alias("transitions_to"))

    # Within the row: no page waits for another, nor is it dealt or joined again. An array of one binds what is split once.
    parts = F.array(F.split("body", r"(?m)^##\s+"))
    scenes = F.transform(parts, lambda s: F.when(F.size(s) > 1, F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda part, i: scene(part, i, F.size(s) - 1))))[0]
    text = F.lower(F.coalesce("body", F.lit("")))
    features = F.array_compact(F.array(*(F.when(text.rlike(w), F.lit(f)) for f, w in FLOW_WORDS)))
    intents = F.slice(F.transform(F.filter(F.split(F.coalesce("description", F.lit("")), r"[.;]\s*"), lambda x: F.trim(x) != ""), lambda x: F.substring(F.trim(x), 1, 200)), 1, 5)
    dependencies = F.slice(F.array_distinct(F.regexp_extract_all("body", F.lit(r"`([A-Za-z][\w./-]*)`"), F.lit(1))), 1, 20)
    return pages.select("slug", intents.alias("intents"), features.alias("features"), dependencies.alias("dependencies"), scenes.alias("scenes"))


def skill_stats(skills: DataFrame) -> DataFrame:
    """One row over skill documents: sizes, share of logical nodes with an action ref, share of documents that fill
    each of four node kinds. Null collections count as empty."""
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    refs = F.size(F.filter("logical", lambda x: x["action_ref"].isNotNull()))
    fill = {f"{k}_fill": F.avg((n(k) > 0).cast("double")) for k in ("decisions", "interactions", "evidence", "protocols")}
    return skills.agg(
        F.count("*").alias("skills"),
        F.sum(n("structural")).alias("structural"),
        F.sum(n("logical")).alias("logical"),
        F.when(F.sum(n("logical")) > 0, F.round(F.sum(refs) * 100 / F.sum(n("logical")), 1)).alias("ref_percent"),
        *(v.alias(k) for k, v in fill.items()),
    )


def rewrite_links(pages: DataFrame, exported: DataFrame) -> DataFrame:
    """``pages`` (page_id, body) with ``[[target]]`` as relative links where the target is in ``exported`` (page_id, path)."""
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1)))).alias("target"))
    known = links.join(exported.select(F.col("page_id").alias("target"), "path"), "target").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("target", "path"))).alias("known"))
    rows = pages.join(known, "page_id", "left").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<struct<target:string,path:string>>)")))
    body = F.aggregate("known", F.col("body"), lambda b, k: F.replace(b, F.concat(F.lit("[["), k["target"], F.lit("]]")), F.concat(F.lit("["), k["target"], F.lit("](/"), k["path"], F.lit(")"))))
    return rows.withColumn("body", body).drop("known")


def describe_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"title": T.page_title(F.col("body")), "description": T.page_description(F.col("body"))})
