"""Registry of queries with their SQL, and the stand-in tables that both sides derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-03-05 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def joined(col, sep: str = ","):
    """An array as text, so that results are flat."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from events: the type gives the status, the value the confidence."""
    status = F.create_map(*(F.lit(x) for x in ("signup", "pending", "click", "accepted", "view", "accepted", "purchase", "rejected", "error", "superseded")))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("candidate_id"),
        status[F.col("event_type")].alias("status"),
        (F.col("value") / 200).alias("confidence"),
        F.concat_ws(" ", F.lit("  Claim"), F.col("user_id") % 50, F.col("k"), "event_type").alias("proposed_text"),
        (F.col("user_id") * 100 + F.col("k")).alias("block_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("k") % 5 == 0, F.col("ts")).alias("invalid_at"),
        F.when(F.col("k") % 3 == 0, F.col("event_id")).alias("superseded_by"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("quote"))).alias("evidence"),
    )


CLAIMS = (
    EVENTS
    + """, claims AS (
  SELECT event_id AS candidate_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'rejected' WHEN 'error' THEN 'superseded' ELSE 'accepted' END AS status,
         value / 200 AS confidence, '  Claim ' || (user_id % 50) || ' ' || k || ' ' || event_type AS proposed_text,
         user_id * 100 + k AS block_id, ts AS created_at, CASE WHEN k % 5 = 0 THEN ts END AS invalid_at,
         CASE WHEN k % 3 = 0 THEN event_id END AS superseded_by, CASE WHEN user_id % 2 = 0 THEN ['quote'] END AS evidence
  FROM ev)"""
)


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow log from events: the user is the problem, k % 12 the block, the type of event the operation."""
    e = events(spark, sf_dir)
    op = F.when(F.col("event_type").isin("signup", "view"), "block-add").when(F.col("event_type") == "click", "relation-add").when(F.col("event_type") == "error", "block-supersede").otherwise("cue-card-regen")
    kinds = F.array(*map(F.lit, ["Problem", "Cause", "Hypothesis", "Evidence", "Action", "Outcome", "Rule"]))
    relation = F.array(*map(F.lit, ["causes", "evidencedBy", "followsFrom", "mitigatedBy", "validatedBy"]))
    return e.select(
        F.col("user_id").alias("problem_id"),
        (F.col("k") % 12).cast("string").alias("block_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.element_at(kinds, (F.col("k") % 7 + 1).cast("int")).alias("type"),
        F.concat(F.lit("label "), F.col("k")).alias("label"),
        (F.col("value") / 200).alias("confidence"),
        F.col("ts").alias("created_at"),
        F.element_at(relation, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"),
        ((F.col("k") * 7 + 3) % 12).cast("string").alias("target_id"),
        F.lit("answered").alias("reason"),
        F.concat(F.lit("hash"), F.col("k")).alias("body_hash"),
        F.col("k").alias("body_bytes"),
    )


DELTAS = (
    EVENTS
    + """, deltas AS (
  SELECT user_id AS problem_id, CAST(k % 12 AS VARCHAR) AS block_id, event_id AS seq,
         CASE WHEN event_type IN ('signup', 'view') THEN 'block-add' WHEN event_type = 'click' THEN 'relation-add' WHEN event_type = 'error' THEN 'block-supersede' ELSE 'cue-card-regen' END AS op,
         (['Problem', 'Cause', 'Hypothesis', 'Evidence', 'Action', 'Outcome', 'Rule'])[k % 7 + 1] AS type,
         'label ' || k AS label, value / 200 AS confidence, ts AS created_at,
         (['causes', 'evidencedBy', 'followsFrom', 'mitigatedBy', 'validatedBy'])[event_id % 5 + 1] AS kind,
         CAST((k * 7 + 3) % 12 AS VARCHAR) AS target_id, 'answered' AS reason, 'hash' || k AS body_hash, k AS body_bytes
  FROM ev), added AS (
  SELECT problem_id, block_id, max(seq) AS added, arg_max(type, seq) AS type, arg_max(label, seq) AS label, arg_max(confidence, seq) AS confidence, arg_max(created_at, seq) AS created_at
  FROM deltas WHERE op = 'block-add' GROUP BY ALL), sup AS (
  SELECT d.problem_id, d.block_id, arg_max(target_id, seq) AS superseded_by FROM deltas d JOIN added a ON d.problem_id = a.problem_id AND d.block_id = a.block_id AND seq > added
  WHERE op = 'block-supersede' GROUP BY ALL), rel AS (
  SELECT d.problem_id, d.block_id, seq, kind, target_id FROM deltas d JOIN added a ON d.problem_id = a.problem_id AND d.block_id = a.block_id AND seq > added WHERE op = 'relation-add'), blocks AS (
  SELECT a.problem_id, a.block_id, a.type, a.label, a.confidence, a.created_at, CASE WHEN s.superseded_by IS NULL THEN 'confirmed' ELSE 'superseded' END AS status, s.superseded_by,
         CASE WHEN ascii(right(a.label, 1)) % 2 = 0 THEN '+' ELSE '-' END AS polarity
  FROM added a LEFT JOIN sup s USING (problem_id, block_id))"""
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded log with what detectors need."""
    from mnemoframe.operators.ledger import fold_flow

    folded = fold_flow(deltas(spark, sf_dir))
    polarity = F.when(F.ascii(F.substring("label", -1, 1)) % 2 == 0, "+").otherwise("-")
    return saved(folded.withColumns({"last_confirmed_at": F.col("created_at"), "stale_after": F.lit(None).cast("timestamp"), "polarity": polarity}))


def delegation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill pairs from suppliers by fixed arithmetic, self loops out."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"))
    n = s.agg(F.count("*").alias("n"))
    pairs = s.crossJoin(F.broadcast(n)).select("a", F.explode(F.array((F.col("a") * 2) % F.col("n"), (F.col("a") * 3 + 1) % F.col("n"))).alias("b"))
    return pairs.where("a <> b").distinct()


PAIRS = "n AS (SELECT count(*) AS n FROM supplier), pairs AS (SELECT DISTINCT a, b FROM (SELECT s_suppkey AS a, unnest([(s_suppkey * 2) % n, (s_suppkey * 3 + 1) % n]) AS b FROM supplier, n) WHERE a <> b)"
