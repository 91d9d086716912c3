"""JSON ledgers, raw event payloads, transcripts, question sets and skill documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from mnemoframe.operators.ledger import reduce_manifest, redact

CORRUPT = "_bad"
#: Names of hook events and the stages they are.
EVENT_STAGES = {
    "SessionStart": "session-start", "UserPromptSubmit": "prompt-submit", "PreToolUse": "tool-pre", "PostToolUse": "tool-post",
    "PreCompact": "compact-pre", "SessionEnd": "session-end", "Stop": "stop",
}

QUESTION_SCHEMA = (
    "question_id string, question_type string, question string, question_date string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)
SKILL_SCHEMA = (
    "ssl_version string, slug string, seq long, scheduling struct<id:string,skill_name:string,intent_signature:string,control_flow_features:array<string>>, "
    "structural array<struct<id:string,scene:string,summary:string,contains_logical_ids:array<string>,transitions_to:array<string>>>, "
    "logical array<struct<id:string,action:string,resources:array<string>,description:string,instructions:string,action_ref:string>>, "
    "decisions array<struct<id:string,question:string,branches:array<string>,scope_ref:string>>, "
    "interactions array<struct<id:string,prompt:string,expected_response_type:string,options:array<string>,scope_ref:string>>, "
    "evidence array<struct<id:string,case_label:string,success_criteria:array<string>,scope_ref:string>>, "
    "protocols array<struct<id:string,delegate_to:string,when:string,scope_ref:string>>"
)


def read_ledger(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``seq``, quarantine) of JSON lines. Blank lines are dropped, unparsable ones set aside with a mark on
    those that are left from a merge conflict.

    Without a stored ``seq`` column the order is (file, block, place in the block).
    """
    base = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*base.fields]).add(CORRUPT, StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    raw = lines.withColumn("_row", F.from_json("value", full, options)).select("_row.*", "_file", "_block", "_place")
    good = raw.where(F.col(CORRUPT).isNull())
    if "seq" not in base.fieldNames():
        good = good.withColumn("seq", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_place")))
    bad = raw.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col("_file").alias("file"), F.col(CORRUPT).rlike(r"^(<{7}|={7}|>{7})").alias("is_conflict_marker"))
    return good.drop("_file", "_block", "_place", CORRUPT), bad


def map_hook_events(raw: DataFrame, at: Column, col: str = "value", platform: str = "agent") -> tuple[DataFrame, DataFrame]:
    """(canonical events, quarantine) from raw JSON payloads: unknown types and text that is no JSON are set aside."""
    get = lambda *names: F.coalesce(*(F.get_json_object(col, f"$.{n}") for n in names))
    stages = F.create_map(*(F.lit(x) for pair in EVENT_STAGES.items() for x in pair))
    rows = raw.withColumn("stage", F.try_element_at(stages, get("hook_event_name", "type")))
    stage = F.col("stage")
    tool = stage.isin("tool-pre", "tool-post")
    payload = F.to_json(
        F.struct(
            stage.alias("stage"),
            F.when(stage == "prompt-submit", F.coalesce(get("prompt_text", "message"), F.lit(""))).alias("message"),
            F.when(tool, F.coalesce(get("tool_name"), F.lit(""))).alias("toolName"),
            F.when(tool, F.from_json(get("tool_input"), "map<string,string>")).alias("toolInput"),
            F.when(stage == "tool-post", get("tool_result", "tool_output")).alias("toolOutput"),
            F.when(stage == "compact-pre", get("turn_count").try_cast("int")).alias("turnCount"),
        )
    )
    kept = [c for c in raw.columns if c != col]
    good = rows.where(stage.isNotNull()).select(*kept, F.lit(platform).alias("platform"), "stage", F.coalesce(get("session_id"), F.lit("")).alias("session_id"), F.coalesce(get("cwd"), F.lit("")).alias("cwd"), at.cast("string").alias("timestamp_iso"), payload.alias("payload"))
    return good, rows.where(stage.isNull()).drop("stage")


def with_hash(events: DataFrame) -> DataFrame:
    """``hash``: the first 16 hex digits of SHA-256 over stage, session, time and payload."""
    text = F.to_json(F.struct("stage", "session_id", "timestamp_iso", "payload"))
    return events.withColumn("hash", F.substring(F.sha2(text, 256), 1, 16))


def append_raw(events: DataFrame, path: str) -> None:
    """Append hashed events under yyyy/mm/dd; a day's rows go to a few tasks by session, so files stay large."""
    day = F.to_date("timestamp_iso")
    out = with_hash(events).withColumns({"yyyy": F.date_format(day, "yyyy"), "mm": F.date_format(day, "MM"), "dd": F.date_format(day, "dd")})
    out.repartition("yyyy", "mm", "dd", F.pmod(F.xxhash64("session_id"), F.lit(16))).write.mode("append").partitionBy("yyyy", "mm", "dd").json(path)


TRANSCRIPT = "type string, sessionId string, timestamp string, message struct<role:string,content:string>"


def import_transcripts(lines: DataFrame) -> DataFrame:
    """One session for each file of (file, seq, value) transcript lines: first id, first and last time, ordered turns.

    Content is text or an array of blocks, of which the text ones count, joined by a blank line.
    """
    content = F.get_json_object("value", "$.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    text = F.when(content.startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n\n")).otherwise(content)
    role = F.get_json_object("value", "$.type")
    rows = lines.select("file", "seq", F.get_json_object("value", "$.sessionId").alias("session_id"), F.get_json_object("value", "$.timestamp").alias("ts"), role.alias("role"), F.trim(text).alias("content"))
    turn = F.when(F.col("role").isin("user", "assistant") & (F.col("content") != ""), F.struct("seq", "role", "content"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    known = F.col("session_id").isNotNull()
    return rows.groupBy("file").agg(F.min_by("session_id", F.when(known, F.col("seq"))).alias("session_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), turns.alias("turns")).where(F.size("turns") > 0)


def import_new(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions (with ``body``) redacted and hashed, without those whose content the manifest has."""
    hashed = redact(sessions, "body").withColumn("sha256", F.sha2("body", 256))
    return hashed.join(reduce_manifest(manifest).select("sha256"), "sha256", "left_anti")


#: How a record of a question file starts, if its first member is the id. Inside a string the quotes would be escaped.
RECORD_START = '{"question_id"'


def read_questions(spark: SparkSession, path: str, record_start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, rejected) of a JSON array of questions, one row for each question and session.

    Rejected: a missing field, an id with other characters than ``[A-Za-z0-9_-]``, arrays of unequal length. An array
    as such cannot be split, so one file is one task. With ``record_start`` (see RECORD_START) a file is split into
    parts at the records' starts like lines are, whatever its size.
    """
    if record_start is None:
        q = spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(path)
    else:
        # What follows a record (a comma, the end of the array) is left out by the parser.
        parts = spark.read.option("lineSep", record_start).text(path).where(F.col("value").startswith(":"))
        q = parts.select(F.from_json(F.concat(F.lit(record_start), "value"), QUESTION_SCHEMA).alias("q")).select("q.*")
    q = q.withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    n = F.size("haystack_sessions")
    reason = (
        F.when(F.col("question_id").isNull() | F.col("question").isNull() | F.col("haystack_sessions").isNull() | F.col("haystack_session_ids").isNull(), "missing field")
        .when(~F.col("question_id").rlike(r"^[A-Za-z0-9_-]+$") | F.exists("haystack_session_ids", lambda x: ~x.rlike(r"^[A-Za-z0-9_-]+$")), "bad id")
        .when((F.size("haystack_session_ids") != n) | (F.col("haystack_dates").isNotNull() & (F.size("haystack_dates") != n)), "arrays of unequal length")
    )
    marked = q.withColumn("reject", reason)
    dates = F.coalesce("haystack_dates", F.transform("haystack_session_ids", lambda x: F.lit(None).cast("string")))
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), dates.alias("date"), F.col("haystack_sessions").alias("turns"))
    good = marked.where("reject is null")
    rows = good.select("question_id", "question_type", "question", "question_date", "answer", "answer_session_ids", F.posexplode(zipped).alias("seq", "x"))
    return rows.select("*", F.col("x.session_id").alias("session_id"), F.col("x.date").alias("date"), F.col("x.turns").alias("turns")).drop("x"), marked.where("reject is not null").select("question_id", "reject")


def read_skills(spark: SparkSession, path: str, canonical: DataFrame | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid documents, errors): invalid ones are rows (slug, errors). ``lines``: one document a line, which splits."""
    from mnemoframe.operators.govern import validate_skills

    docs = spark.read.schema(SKILL_SCHEMA).option("multiLine", not lines).json(path)
    arrays = [f for f in docs.schema.fields if f.dataType.typeName() == "array"]
    docs = docs.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in arrays})
    checked = validate_skills(docs, canonical)
    return docs.join(checked.where(F.size("errors") == 0).select("slug"), "slug", "left_semi"), checked.where(F.size("errors") > 0)


def changed_sources(files: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct, review) of files (path, content, warnings) whose content hash ``prior`` (sha256) does not have."""
    new = files.withColumn("sha256", F.sha2("content", 256)).join(prior.select("sha256").distinct(), "sha256", "left_anti")
    flagged = F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0
    return new.where(~flagged), new.where(flagged)
