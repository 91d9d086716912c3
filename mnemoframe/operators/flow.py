"""Problem graphs: gap detectors, value of information, question life cycle, claims and orphans.

``blocks`` has (problem_id, block_id, type, status, label, confidence, created_at, last_confirmed_at, stale_after,
superseded_by, polarity, relations array<struct<kind, target_id>>, ...); all problems are handled at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import isolated, saved

KEY = ["problem_id", "block_id"]
#: Weights of the value score, days until a confirmed block or a pending question is stale.
VOI_WEIGHTS = {"severity": 0.35, "centrality": 0.2, "recency": 0.15, "confidence": 0.15, "boost": 0.15}
STALE_DAYS = 7
QUESTION_DAYS = 30

Detector = Callable[[DataFrame, DataFrame, Column], DataFrame]


def relations_of(blocks: DataFrame) -> DataFrame:
    """(problem_id, block_id, kind, target_id), exploded once for all that follows."""
    return blocks.select(*KEY, F.explode("relations").alias("r")).select(*KEY, "r.kind", "r.target_id")


def _gap(blocks: DataFrame, detector: str, severity: float) -> DataFrame:
    return blocks.select("problem_id", F.lit(f"rule:{detector}").alias("detector_id"), F.col("block_id").alias("subject_id"), F.lit(severity).alias("severity"), "label")


def _confirmed(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.where((F.col("status") == "confirmed") & F.col("type").isin(list(types)))


def _with_target(relations: DataFrame, blocks: DataFrame, kind: str, target: str) -> DataFrame:
    """Relations of a kind whose target is a confirmed block of a type in the same problem."""
    targets = _confirmed(blocks, target).select("problem_id", F.col("block_id").alias("target_id"), F.col("polarity"))
    return relations.where(F.col("kind") == kind).join(targets, ["problem_id", "target_id"])


def _targeted(relations: DataFrame, *kinds: str) -> DataFrame:
    return relations.where(F.col("kind").isin(list(kinds))).select("problem_id", F.col("target_id").alias("block_id")).distinct()


def orphan_action(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Action").join(_with_target(relations, blocks, "followsFrom", "Outcome"), KEY, "left_anti"), "orphan-action", 0.7)


def unsupported_hypothesis(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Hypothesis").join(_targeted(relations, "evidencedBy"), KEY, "left_anti"), "unsupported-hypothesis", 1.0)


def stale_confirmed(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    last = F.col("last_confirmed_at")
    over = F.when(F.col("stale_after").isNotNull(), now > F.col("stale_after")).otherwise(now > last + F.expr(f"interval {STALE_DAYS} days"))
    return _gap(blocks.where((F.col("status") == "confirmed") & ~F.col("type").isin("Gap", "Question") & last.isNotNull() & over), "stale-confirmed", 0.6)


def uncaused_problem(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Problem").join(_targeted(relations, "causes"), KEY, "left_anti"), "uncaused-problem", 0.85)


def low_confidence_critical(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Hypothesis", "Cause", "Outcome").where("confidence < 0.5"), "low-confidence-critical", 0.5)


def conflicting_outcomes(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    both = _with_target(relations, blocks, "followsFrom", "Outcome").where("polarity in ('+', '-')").groupBy(*KEY).agg(F.count_distinct("polarity").alias("n")).where("n = 2")
    return _gap(_confirmed(blocks, "Action").join(both, KEY, "left_semi"), "conflicting-outcomes", 0.9)


def dangling_evidence(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Evidence").join(_targeted(relations, "evidencedBy", "validatedBy"), KEY, "left_anti"), "dangling-evidence", 0.4)


def unmitigated_cause(blocks: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    return _gap(_confirmed(blocks, "Cause").join(_with_target(relations, blocks, "mitigatedBy", "Action"), KEY, "left_anti"), "unmitigated-cause", 0.75)


DETECTORS: tuple[Detector, ...] = (orphan_action, unsupported_hypothesis, stale_confirmed, uncaused_problem, low_confidence_critical, conflicting_outcomes, dangling_evidence, unmitigated_cause)


GAP_COLUMNS = ("problem_id", "detector_id", "subject_id", "severity")


def gaps(blocks: DataFrame, now: Column, detectors: Sequence[Detector] = DETECTORS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All gaps, one for each (problem, detector, subject), and the detectors that failed with their messages.

    The own detectors are one plan. Each other one is a write of its own, so that one which raises on any row is reported
    and the others' gaps stay.
    """
    relations = relations_of(blocks)
    own = [d for d in detectors if d in DETECTORS]
    tasks = [(getattr(d, "__name__", str(d)), partial(d, blocks, relations, now)) for d in detectors if d not in DETECTORS]
    found, failed = isolated(blocks.sparkSession, tasks, GAP_COLUMNS)
    for rows in (d(blocks, relations, now).select(*GAP_COLUMNS) for d in own):
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no detector left")
    return found.dropDuplicates(["problem_id", "detector_id", "subject_id"]), failed


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def voi(found: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
    """``found`` gaps (with optional ``boost``, ``created_at``) with ``voi``; the gaps count as members of the graph.

    Degrees are counted once by a groupBy, not looked up for each gap.
    """
    relations = relations_of(blocks)
    in_degree = relations.groupBy("problem_id", F.col("target_id").alias("block_id")).agg(F.count("*").alias("in_degree"))
    members = blocks.groupBy("problem_id").agg(F.count("*").alias("n"), F.sum(F.size("relations")).alias("out"))
    n_gaps = found.groupBy("problem_id").agg(F.count("*").alias("g"))
    mean = members.join(n_gaps, "problem_id", "left").select("problem_id", (F.col("out") / (F.col("n") + F.coalesce("g", F.lit(0)))).alias("mean_out"))
    subjects = blocks.select("problem_id", F.col("block_id").alias("subject_id"), F.size("relations").alias("out_degree"), "confidence", F.coalesce("last_confirmed_at", "created_at").alias("seen"), F.lit(True).alias("has"))
    in_degree = in_degree.withColumnRenamed("block_id", "subject_id")
    rows = found.join(subjects, ["problem_id", "subject_id"], "left").join(in_degree, ["problem_id", "subject_id"], "left").join(mean, "problem_id", "left")
    degree = F.coalesce("in_degree", F.lit(0)) + F.col("out_degree")
    centrality = F.when(F.col("has") & (F.col("mean_out") > 0), clamp01(degree / (F.col("mean_out") * 2))).otherwise(0.0)
    own = F.col("created_at") if "created_at" in found.columns else now
    days = F.greatest(F.lit(0.0), (now.cast("double") - F.coalesce("seen", own).cast("double")) / 86400)
    boost = clamp01(F.coalesce("boost", F.lit(0.0))) if "boost" in found.columns else F.lit(0.0)
    w = VOI_WEIGHTS
    score = w["severity"] * clamp01(F.col("severity")) + w["centrality"] * centrality + w["recency"] / (1 + days) + w["confidence"] * F.when(F.col("has"), clamp01(1 - F.col("confidence"))).otherwise(0.5) + w["boost"] * boost
    return rows.select(*found.columns, clamp01(score).alias("voi"))


def question_lifecycle(blocks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(problem_id, block_id, lifecycle, asked_at, answer_id, answer_bundle_id) of every Question block."""
    first = asked.groupBy(F.col("question_id").alias("block_id")).agg(F.min("asked_at").alias("first_asked"))
    known = blocks.select("problem_id", F.col("block_id").alias("gap_id"), F.lit(True).alias("has_gap"))
    answers = blocks.select("problem_id", F.col("block_id").alias("superseded_by"), F.col("bundle_id").alias("answer_bundle"))
    q = blocks.where("type = 'Question'").join(first, "block_id", "left").join(known, ["problem_id", "gap_id"], "left").join(answers, ["problem_id", "superseded_by"], "left")
    answered = (F.col("status") == "superseded") & F.col("superseded_by").isNotNull()
    state = (
        F.when(answered, "answered")
        .when(F.col("has_gap").isNull() | (now > F.col("created_at") + F.expr(f"interval {QUESTION_DAYS} days")), "stale")
        .when(F.col("first_asked").isNotNull(), "asked")
        .otherwise("pending")
    )
    return q.select("problem_id", "block_id", state.alias("lifecycle"), F.col("first_asked").alias("asked_at"), F.when(answered, F.col("superseded_by")).alias("answer_id"), F.when(answered, F.col("answer_bundle")).alias("answer_bundle_id"))


def pending_questions(blocks: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Pending questions with a total order: voi desc, creation, id, nulls last; ``place`` counts within a problem."""
    rows = blocks.join(lifecycle.where("lifecycle = 'pending'").select(*KEY), KEY, "left_semi")
    order = Window.partitionBy("problem_id").orderBy(F.desc("voi"), F.asc_nulls_last("created_at"), F.asc_nulls_last("block_id"))
    return rows.withColumn("place", F.row_number().over(order))


def current_gaps(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Gaps with the id of the last question about each (by seq), and whether there is one."""
    last = questions.groupBy("gap_id").agg(F.max_by("block_id", "seq").alias("question_id"))
    return found.join(last, "gap_id", "left").withColumn("has_question", F.col("question_id").isNotNull())


def next_question(pending: DataFrame, asked: DataFrame, now: Column, per_day: int = 3, pause_minutes: int = 1440, label_bytes: int = 500) -> DataFrame:
    """The first question of each problem that may be asked now: none if ``per_day`` were asked on this UTC day; no
    question that was asked, no gap whose latest ask is resolved or younger than the pause, no label too long."""
    today = asked.where(F.to_date("asked_at") == F.to_date(now)).agg(F.count("*").alias("today"))
    latest = asked.groupBy("gap_id").agg(F.max_by(F.struct("asked_at", "resolution"), "asked_at").alias("last"))
    blocked = latest.where(F.col("last.resolution").isNotNull() | (F.col("last.asked_at") > now - F.expr(f"interval {pause_minutes} minutes"))).select("gap_id")
    free = pending.join(asked.select(F.col("question_id").alias("block_id")).distinct(), "block_id", "left_anti").join(blocked, "gap_id", "left_anti")
    free = free.where(F.octet_length("label") <= label_bytes).crossJoin(F.broadcast(today)).where(F.col("today") < per_day).drop("today")
    order = Window.partitionBy("problem_id").orderBy("place")
    return free.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def relation_targets(blocks: DataFrame) -> DataFrame:
    """Relations that point at a block missing from the same problem."""
    known = blocks.select("problem_id", F.col("block_id").alias("target_id"))
    return relations_of(blocks).join(known, ["problem_id", "target_id"], "left_anti")


def orphan_bundles(bundles: DataFrame, mapping: DataFrame, discard: DataFrame | None = None) -> DataFrame:
    """Bundles without a problem that were not processed: ``attach`` (with the problem) by ``mapping`` (bundle_id,
    new_problem_id), ``discard`` (with the reason) or ``open``."""
    open_ = bundles.where("problem_id is null and processed_at is null").join(mapping, "bundle_id", "left")
    if discard is not None:
        open_ = open_.join(discard.select("bundle_id", F.col("reason").alias("discard_reason")), "bundle_id", "left")
    else:
        open_ = open_.withColumn("discard_reason", F.lit(None).cast("string"))
    return open_.withColumn("action", F.when(F.col("new_problem_id").isNotNull(), "attach").when(F.col("discard_reason").isNotNull(), "discard").otherwise("open"))


def supersede_cycles(blocks: DataFrame, rounds: int = 32) -> DataFrame:
    """Blocks on a cycle of superseded_by pointers, with the smallest id of their cycle. Pointer doubling: after k
    rounds a pointer and the least id on its way cover 2^k steps, so log2(longest chain) joins are enough."""
    at = blocks.where("superseded_by is not null").select("problem_id", "block_id", F.col("superseded_by").alias("to"), F.least("block_id", "superseded_by").alias("least"))
    known = at.select("problem_id", F.col("block_id").alias("to"))
    at = at.join(known, ["problem_id", "to"], "left_semi")  # a chain that ends is no cycle
    count = at.count()
    for _ in range(rounds):
        # Drop chains that end, then jump.
        step = at.select("problem_id", F.col("block_id").alias("to"), F.col("to").alias("next"), F.col("least").alias("more"))
        at = saved(at.join(step, ["problem_id", "to"]).select("problem_id", "block_id", F.col("next").alias("to"), F.least("least", "more").alias("least")))
        left = at.count()
        if left == count:
            break
        count = left
    # What is left leads to a cycle; those that something on the cycle points back to are on it.
    return at.join(at.select("problem_id", F.col("to").alias("block_id")).distinct(), ["problem_id", "block_id"], "left_semi").select("problem_id", "block_id", F.col("least").alias("cycle"))


def project_flow(blocks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Gaps of folded blocks with voi, and each question with its gap's voi and life cycle."""
    found, _ = gaps(blocks, now)
    scored = saved(voi(saved(found), blocks, now))
    rows = scored.select("problem_id", F.lit("Gap").alias("type"), F.concat_ws(":", "detector_id", "subject_id").alias("block_id"), "voi", F.lit(None).cast("string").alias("lifecycle"))
    life = question_lifecycle(blocks, asked, now)
    subject = blocks.where("type = 'Question'").select(*KEY, "gap_id")
    by_gap = scored.select("problem_id", F.concat_ws(":", "detector_id", "subject_id").alias("gap_id"), "voi")
    questions = subject.join(life, KEY).join(by_gap, ["problem_id", "gap_id"], "left")
    return rows.unionByName(questions.select("problem_id", F.lit("Question").alias("type"), "block_id", "voi", "lifecycle"))


def ontology_counts(blocks: DataFrame, modules: DataFrame, least: int = 3) -> DataFrame:
    """Modules (module_id, patterns map, resolved_runs, promoted) with block-type counts added and ``promote``."""
    new = blocks.groupBy("module_id", "type").agg(F.count("*").alias("n"))
    old = modules.select("module_id", F.explode("patterns").alias("type", "n"))
    summed = new.unionByName(old).groupBy("module_id", "type").agg(F.sum("n").alias("n"))
    maps = summed.groupBy("module_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("patterns"))
    return modules.drop("patterns").join(maps, "module_id", "left").withColumn("promote", (F.col("resolved_runs") >= least) & ~F.col("promoted"))
