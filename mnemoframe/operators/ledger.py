"""Append-only logs: reducing, deduplicating and folding them, queues, usage counts, row rules.

The order of a log is data: every log has a ``seq`` column. "Now" is always a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["session-start", "prompt-submit", "tool-pre", "tool-post", "compact-pre", "session-end", "stop"]
#: Patterns of secrets in the order in which they are applied.
SECRET_PATTERNS = [
    ("anthropic-key", r"sk-ant-[a-zA-Z0-9_-]{20,}"),
    ("openai-key", r"sk-[a-zA-Z0-9]{20,}"),
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("jwt", r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]*"),
    ("password-field", r"(?i)password\s*[=:]\s*[\"']?[^\s\"']{4,}"),
    ("generic-secret", r"(?i)(?:secret|token|apikey|api_key)\s*[=:]\s*[\"']?[^\s\"']{8,}"),
]


def reduce_latest(log: DataFrame, key: Sequence[str] | str, version: str | None = None) -> DataFrame:
    """The last revision of each key: the greatest version, one with a version before one without, ties by seq.

    ``max_by`` on a struct combines before the shuffle, so one key with many revisions is not gathered. The order
    of the rows in the log does not matter.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.col("seq")) if version else F.struct("seq")
    rest = F.struct(*[c for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(rest, order).alias("row")).select(*keys, "row.*").select(*log.columns)


def live_queue(log: DataFrame) -> DataFrame:
    """Items of (id, tombstone, ...) that no tombstone names, wherever it stands."""
    return log.where("not tombstone").join(log.where("tombstone").select("id").distinct(), "id", "left_anti")


def oldest_items(live: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The first item of each session by seq."""
    return live.groupBy(*by).agg(F.min_by(F.struct(*[c for c in live.columns if c not in by]), "seq").alias("row")).select(*by, "row.*")


def compaction_counts(log: DataFrame) -> DataFrame:
    """One row: how many rows there are, how many stay and how many a compaction removes."""
    live = live_queue(log).agg(F.count("*").alias("kept"))
    return log.agg(F.count("*").alias("total")).crossJoin(live).withColumn("removed", F.col("total") - F.col("kept"))


def merge_ledgers(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of two logs with what they share once, in an order that depends on content only."""
    both = a.drop("seq").unionByName(b.drop("seq"), allowMissingColumns=True).dropDuplicates()
    content = F.struct(*[F.col(c) for c in both.columns if c not in keys])
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(content)))


def dedup_blocks(batch: DataFrame, history: DataFrame, kind: str = "type", label: str = "label") -> DataFrame:
    """``batch`` (problem_id, block_id, seq, type, label) with ``keep`` and ``reason``.

    A block is skipped if its (problem, type, label) is live in ``history`` (with ``superseded``) or an earlier row of
    the batch has it. The caller brings labels into one form (content_hash, NFKC).
    """
    key = ["problem_id", kind, label]
    live = history.where("not superseded").select(*key).distinct().withColumn("live", F.lit(True))
    marked = batch.join(live, key, "left").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("seq")))
    reason = F.when(F.col("live"), "already-live").when(F.col("nth") > 1, "repeated-in-batch")
    return marked.select(*[c for c in batch.columns if c not in ("keep", "reason")], reason.isNull().alias("keep"), reason.alias("reason"))


def fold_flow(deltas: DataFrame) -> DataFrame:
    """Current blocks of (problem_id, block_id, seq, op, ...): the last block-add resets a block, and only later
    supersedes (the last wins) and relations (in order) apply. Keyed by block, so a huge problem still spreads."""
    key = ["problem_id", "block_id"]
    last = deltas.where("op = 'block-add'").groupBy(*key).agg(F.max("seq").alias("added"), F.max_by(F.struct("type", "label", "confidence", "created_at"), "seq").alias("block"))
    later = deltas.join(last.select(*key, "added"), key).where("seq > added")
    supersedes = later.where("op = 'block-supersede'").groupBy(*key).agg(F.max_by("target_id", "seq").alias("superseded_by"), F.max_by("reason", "seq").alias("reason"), F.lit(True).alias("superseded"))
    relation = F.struct("seq", F.col("kind").alias("kind"), F.col("target_id").alias("target_id"))
    relations = later.where("op = 'relation-add'").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(relation)), lambda r: F.struct(r["kind"].alias("kind"), r["target_id"].alias("target_id"))).alias("relations"))
    out = last.join(supersedes, key, "left").join(relations, key, "left")
    status = F.when(F.col("superseded"), "superseded").otherwise("confirmed")
    empty = F.expr("cast(array() as array<struct<kind:string,target_id:string>>)")
    return out.select(*key, "block.*", status.alias("status"), "superseded_by", "reason", F.coalesce("relations", empty).alias("relations"))


def flow_meta(deltas: DataFrame, stale_after: int = 100) -> DataFrame:
    """Per problem: number of deltas, whether it is stale, and the latest cue card's hash and size."""
    cue = F.when(F.col("op") == "cue-card-regen", F.col("seq"))
    return deltas.groupBy("problem_id").agg(F.count("*").alias("n_deltas"), (F.count("*") >= stale_after).alias("stale"), F.max_by("body_hash", cue).alias("cue_hash"), F.max_by("body_bytes", cue).alias("cue_bytes"))


def valid_events(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Rows with all required strings, a known stage and a payload."""
    return events.where(F.col("platform").isNotNull() & F.col("session_id").isNotNull() & F.col("cwd").isNotNull() & F.col("timestamp_iso").isNotNull() & F.col("stage").isin(list(stages)) & F.col("payload").isNotNull())


def normalize_observations(events: DataFrame) -> DataFrame:
    """Canonical events to observations; other stages are dropped. ``needs_analysis`` is true for prompts and for
    tools that are not known; prompts and commands are redacted."""
    stage, tool = F.col("stage"), F.get_json_object("payload", "$.toolName")

    def inp(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object("payload", f"$.toolInput.{n}") for n in names))

    kind = F.when(stage == "tool-post", F.concat(F.lit("tool:"), tool)).when(stage == "prompt-submit", "user-intent").when(stage.isin("session-start", "session-end"), stage)
    path = F.array(F.coalesce(inp("file_path", "filePath"), F.lit("unknown")))
    secret = F.when(stage == "prompt-submit", F.get_json_object("payload", "$.message")).when(tool == "Bash", inp("command"))
    rows = redact(events.where(kind.isNotNull()).withColumn("_secret", secret), "_secret").drop("redactions")
    output = F.coalesce(F.get_json_object("payload", "$.toolOutput"), F.lit(""))
    # A tool's output may be an object or the text of one.
    exit_code = F.coalesce(F.get_json_object("payload", "$.toolOutput.exitCode"), F.get_json_object(output, "$.exitCode")).try_cast("int")
    data = F.to_json(
        F.struct(
            F.when(tool.isin("Edit", "Write"), path).alias("filesTouched"),
            F.when(tool.isin("Edit", "Write"), F.lower(tool)).alias("action"),
            F.when(tool == "Read", path).alias("filesRead"),
            F.when(tool == "Bash", F.coalesce("_secret", F.lit(""))).alias("command"),
            F.when(tool == "Bash", F.coalesce(exit_code, F.lit(0))).alias("exitCode"),
            F.when(tool == "Bash", F.substring(output, 1, 200)).alias("outputSnippet"),
            F.when(tool.isin("Grep", "Glob"), F.coalesce(inp("pattern", "glob"), F.lit(""))).alias("searchPattern"),
            F.when(stage == "prompt-submit", F.col("_secret")).alias("userIntentRaw"),
        )
    )
    known = F.coalesce(tool.isin("Edit", "Write", "Bash", "Read", "Glob", "Grep"), F.lit(False))
    return rows.select("session_id", "seq", kind.alias("type"), data.alias("data"), ((stage == "prompt-submit") | ((stage == "tool-post") & ~known)).alias("needs_analysis"))


def redact(df: DataFrame, col: str, patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS) -> DataFrame:
    """``df`` with ``col`` redacted pattern by pattern and ``redactions``: the patterns that matched the running text."""
    text, hits = F.col(col), []
    for name, pattern in patterns:
        hits.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, f"<REDACTED:{name}>")
    return df.withColumns({col: text, "redactions": F.array_compact(F.array(*hits))})


def redaction_audit(df: DataFrame, col: str, patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS) -> DataFrame:
    """One row for each pattern that matched a row, with the first 100 characters of the input."""
    return redact(df.withColumn("_input", F.substring(col, 1, 100)), col, patterns).withColumn("pattern", F.explode("redactions")).withColumnRenamed("_input", "input").drop("redactions", col)


DELTA_OPS = ["block-add", "block-supersede", "relation-add", "cue-card-regen"]


def valid_deltas(deltas: DataFrame) -> DataFrame:
    """``deltas`` with ``reject``: why a row cannot be applied, null if it can."""
    op, kind = F.col("op"), F.col("type")
    add = op == "block-add"
    reject = (
        F.when(~op.isin(DELTA_OPS) | op.isNull(), "unknown op")
        .when(add & (F.col("block_id").isNull() | kind.isNull()), "block without id or type")
        .when(add & (F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)), "confidence outside [0,1]")
        .when(add & (kind == "Gap") & (F.col("detector_id").isNull() | F.col("subject_id").isNull()), "gap without detector or subject")
        .when(add & (kind == "Gap") & F.col("detector_id").startswith("rule:"), "gap of a rule")
        .when(add & (kind == "Question") & F.col("gap_id").isNull(), "question without gap")
        .when(add & (kind == "Outcome") & ~F.col("polarity").isin("+", "-"), "polarity is neither + nor -")
        .when((op == "block-supersede") & (F.col("block_id").isNull() | F.col("target_id").isNull()), "supersede without blocks")
        .when((op == "relation-add") & (F.col("block_id").isNull() | F.col("kind").isNull() | F.col("target_id").isNull()), "relation without members")
        .when((op == "cue-card-regen") & F.col("body_hash").isNull(), "cue card without hash")
    )
    return deltas.withColumn("reject", reject)


def claim_candidates(blocks: DataFrame, least: float = 0.7) -> DataFrame:
    """Confirmed outcomes and rules of enough confidence as pending claims."""
    good = blocks.where(F.col("type").isin("Outcome", "Rule") & (F.col("status") == "confirmed") & (F.col("confidence") >= least))
    evidence = F.array(F.struct(F.concat(F.lit("flow:"), F.col("problem_id"), F.lit("/"), F.col("block_id")).alias("source"), F.col("label").alias("quote")))
    return good.select(F.concat(F.lit("claim-cand-"), "block_id").alias("candidate_id"), "block_id", F.col("type").alias("proposed_type"), F.col("label").alias("proposed_text"), "confidence", F.lit("pending").alias("status"), evidence.alias("evidence"))


def decay_blocks(blocks: DataFrame, now: Column) -> DataFrame:
    """A supersede delta for each confirmed block whose ``stale_after`` has passed."""
    return blocks.where((F.col("status") == "confirmed") & (F.col("stale_after") <= now)).select("problem_id", "block_id", F.lit("block-supersede").alias("op"), F.lit("stale-decay").alias("target_id"), F.lit("stale-decay").alias("reason"))


def sweep_ttl(items: DataFrame, now: Column, at: str, days: int = 7, inclusive: bool = True) -> DataFrame:
    """``items`` with ``expired``: age of at least ``days`` (inclusive, queues) or more (orphan bundles)."""
    age = (now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")) / 86400
    return items.withColumn("expired", age >= days if inclusive else age > days)


def rotation_candidates(problems: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Problems resolved at least ``days`` ago."""
    return problems.where((F.col("status") == "resolved") & (F.col("resolved_at") <= now - F.expr(f"interval {days} days")))


def job_transitions(jobs: DataFrame, now: Column, op: str, lease_minutes: int = 60) -> DataFrame:
    """Jobs after ``claim`` (pending ones are leased), ``reap`` (expired leases go back, or fail at their last
    attempt) or ``requeue`` (failed ones go back), with ``is_stale``: a lease that is over or cannot be read."""
    stale = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    status, attempts, lease = F.col("status"), F.col("attempts"), F.col("lease_expires_at")
    if op == "claim":
        take = status == "pending"
        new = (F.when(take, "running").otherwise(status), F.when(take, attempts + 1).otherwise(attempts), F.when(take, now + F.expr(f"interval {lease_minutes} minutes")).otherwise(lease))
    elif op == "reap":
        new = (F.when(stale, F.when(attempts >= F.col("max_attempts"), "failed").otherwise("pending")).otherwise(status), attempts, F.when(~stale, lease))
    elif op == "requeue":
        new = (F.when(status == "failed", "pending").otherwise(status), F.when(status == "failed", 0).otherwise(attempts), F.when(status != "failed", lease))
    else:
        raise ValueError(f"unknown transition {op!r}")
    return jobs.withColumns({"is_stale": stale, "status": new[0], "attempts": new[1], "lease_expires_at": new[2]})


def usage_window(usage: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Rows with a time in the last ``days`` (7 if not positive)."""
    return usage.where((F.col("ts") > now - F.expr(f"interval {days if days > 0 else 7} days")) & (F.col("ts") <= now))


def usage_summary(usage: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Searches, asks, distinct queries and tokens (missing: 0) of the last days."""
    return usage_window(usage, now, days).agg(
        F.count_if(F.col("tool") == "search").alias("searches"),
        F.count_if(F.col("tool") == "ask").alias("asks"),
        F.count_distinct("query").alias("unique_queries"),
        F.coalesce(F.sum(F.coalesce("context_tokens", F.lit(0))), F.lit(0)).alias("tokens"),
    )


def usage_by_day(usage: DataFrame) -> DataFrame:
    return usage.where("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("tool") == "search").alias("searches"), F.count_if(F.col("tool") == "ask").alias("asks"))


#: Buckets of a sketch as a power of two, and the share by which an estimate may be off: three standard errors.
SKETCH_LG = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_LG / 2)


def daily_sketches(log: DataFrame, what: str, ts: str = "ts") -> DataFrame:
    """(day, sketch): a mergeable state of the distinct values of ``what`` for each UTC day; some kilobytes a day."""
    return log.where(F.col(what).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(F.col(what), F.lit(SKETCH_LG)).alias("sketch"))


def distinct_in_windows(sketches: DataFrame, days: int = 7) -> DataFrame:
    """(until, estimate, error) for the window of ``days`` days that ends with each day that has a sketch or follows one:
    how many distinct values it has, within ``error``. The log is not read again."""
    ends = sketches.select(F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("until"), "sketch")
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return ends.groupBy("until").agg(estimate.alias("estimate")).withColumn("error", F.ceil(F.col("estimate") * SKETCH_ERROR))


def page_recalls(usage: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """How often and when last each page was among the results."""
    return usage_window(usage, now, days).select("ts", F.explode("top_page_ids").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("recalls"), F.max("ts").alias("last_recall"))


def token_savings(usage: DataFrame, corpus_tokens: int) -> DataFrame:
    """Tokens of answers against reading the corpus each time; the percentage has one decimal, null without data."""
    used = usage.where("context_tokens is not null").agg(F.count("*").alias("calls"), F.coalesce(F.sum("context_tokens"), F.lit(0)).alias("used"))
    full = F.col("calls") * F.lit(corpus_tokens)
    return used.select("calls", "used", full.alias("full_tokens"), F.when(full > 0, F.round((1 - F.col("used") / full) * 100, 1)).alias("saved_percent"))


def top_values(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The most frequent values; equal counts by value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def detector_weights(learning: DataFrame) -> DataFrame:
    """Per detector the four counts, the smoothed weight (a+2)/(d+4) and the raw rate."""
    counts = learning.groupBy("detector_id").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "superseded", "invalidated")))
    decided = F.col("accepted") + F.col("rejected") + F.col("superseded") + F.col("invalidated")
    return counts.withColumns({"weight": (F.col("accepted") + 2) / (decided + 4), "rate": F.when(decided > 0, F.col("accepted") / decided)})


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by location and status, with totals per location and over all."""
    return jobs.rollup("location", "status").agg(F.count("*").alias("n"))


def import_new(sessions: DataFrame, manifest: DataFrame, body: str = "body") -> DataFrame:
    """Sessions, redacted and hashed, whose content the reduced manifest does not have."""
    hashed = redact(sessions, body).withColumn("sha256", F.sha2(body, 256))
    return hashed.join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def reduce_manifest(manifest: DataFrame) -> DataFrame:
    return reduce_latest(manifest, "sha256", "imported_at")
