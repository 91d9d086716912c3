"""Streaming jobs over tables derived from the given ones: a stream is drained into a table of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.helpers import scratch
from mnemoframe.streaming import jobs

from .base import EVENTS, events, query
from .log_queries import LOG, QUEUE, USAGE, _log, _queue, _usage
from .source_queries import HOOKS, _payloads

STORE = "spark.sql.streaming.stateStore.providerClass"


#: Micro-batches of a stream, and how late a row may come: less than the shortest watermark's delay.
BATCHES = 8
LATE_SECONDS = 3300


def _spans(rows: DataFrame, ts: str = "ts") -> tuple[list[DataFrame], int | None]:
    """``rows`` by the spans of time in which they arrive, and the second of the last one.

    Every row comes up to LATE_SECONDS after its time, by a hash of the row, so neighbours in time come in other orders
    and in other spans.
    """
    seconds = F.unix_seconds(ts)
    arrival = seconds + F.pmod(F.xxhash64(*rows.columns), F.lit(LATE_SECONDS))
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        return [rows], None
    span = (last - first + LATE_SECONDS) // BATCHES + 1
    return [rows.where(F.floor((arrival - F.lit(first)) / span) == i) for i in range(BATCHES)], last


def _parts(spark) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _stream(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` as a stream of several micro-batches that are not in the order of ``ts``.

    Files are written one arrival span after the other and read in that order.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "stream")
    parts = _parts(spark)
    for here in _spans(rows, ts)[0]:
        here.repartition(parts).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


#: How far the streams' watermark of an hour has come when they are drained.
SEALED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM ev)"


@contextmanager
def _stateful(spark):
    """The state store that the stateful jobs need, for as long as a query runs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def _drained(df: DataFrame, arrivals: Iterable[None] = (None,)) -> DataFrame:
    """What a stream gives once its source is used up. A batch that runs again replaces its own folder.

    ``arrivals`` adds to the source each time it is asked; the stream then goes on from its checkpoint.
    """
    spark, path, made = df.sparkSession, scratch(df.sparkSession, "drained"), []
    progress = scratch(spark, "progress")

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        made.append(target)

    for _ in arrivals:
        q = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.schema(df.schema).parquet(*dict.fromkeys(made)).select(df.columns) if made else spark.createDataFrame([], df.schema)


#: The end of a stream is dated so long after its last row: longer than any window and its watermark's delay together.
END_SECONDS = 30 * 86400


def _all_windows(job: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """Every window of ``job`` over the dated ``rows``, those that are open at the last row too.

    A span that arrives is one micro-batch, however few its rows or files are, so none is behind the watermark. Then the
    end of the stream arrives, a row of nulls but for its time: it takes the watermark past all windows, which leave the
    state as they close, and its own window never closes.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "stream")
    parts = _parts(spark)

    def arrive() -> Iterator[None]:
        spans, last = _spans(rows.where("ts IS NOT NULL"))
        if last is None:
            return
        ts = F.timestamp_seconds(F.lit(last + END_SECONDS))
        end = spark.range(1).select(*((ts if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
        for i, here in enumerate([*(s.repartition(parts) for s in spans), end]):
            here.write.parquet(f"{path}/{i}")
            yield

    return _drained(job(spark.readStream.schema(rows.schema).parquet(f"{path}/*")), arrive())


@query(f"WITH {HOOKS} SELECT event_id, stage, 's' || user_id AS session_id, CASE WHEN stage = 'prompt-submit' THEN 'ask ' || k || ' <REDACTED:password-field>' END AS message, strftime(ts, '%Y-%m-%d') AS day FROM hooks WHERE stage IS NOT NULL")
def st1_ingest(spark, sf_dir):
    ingested = jobs.ingest(_stream(_payloads(spark, sf_dir)), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    path = scratch(spark, "ledger")
    q = jobs.write_ledger(ingested, path, scratch(spark, "progress"))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    read = spark.read.schema("event_id long, stage string, session_id string, payload string, yyyy string, mm string, dd string").json(path)
    return read.select("event_id", "stage", "session_id", F.get_json_object("payload", "$.message").alias("message"), F.concat_ws("-", "yyyy", "mm", "dd").alias("day"))


@query(f"WITH {EVENTS} SELECT DISTINCT user_id, event_type, k % 10 AS k, epoch(ts)::BIGINT // 604800 AS week FROM ev")
def st2_dedup(spark, sf_dir):
    """Content comes again within a week, when it is dropped, and four weeks later, when it is new, however far a micro-batch
    reaches. Events without a time never leave the stream's watermark; they are of no week."""
    week = F.floor(F.unix_seconds("ts") / (7 * 86400))
    e = events(spark, sf_dir).select("ts", "user_id", "event_type", (F.col("k") % 10).alias("k"), week.alias("week"))
    # Named fields, so that no null lets two contents spell the same.
    hashed = e.withColumn("hash", F.sha2(F.to_json(F.struct("user_id", "event_type", "k", (F.col("week") % 4).alias("turn"))), 256))
    columns = ["user_id", "event_type", "k", "week"]
    dated = _drained(jobs.dedup(_stream(hashed.where("ts IS NOT NULL")), period=F.col("week"))).select(columns)
    return dated.unionByName(hashed.where("ts IS NULL").select(columns).distinct())


STREAM_TURNS = (
    EVENTS.replace("FROM events)", "FROM events), sealed AS (SELECT * FROM ev WHERE ts <= " + SEALED + ")")
    + """, n AS (SELECT *, greatest(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS turn FROM sealed), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, turn ORDER BY ts, event_id) - 1) // 50 + 1 AS part FROM n),
c AS (SELECT user_id, turn, part, event_type, count(*) AS c FROM p GROUP BY ALL), g AS (SELECT user_id, turn, part, sum(c) AS n, sum(c) FILTER (event_type = 'view') AS prompts, coalesce(string_agg(event_type || ':' || c, ',' ORDER BY event_type) FILTER (event_type <> 'view'), '') AS tools FROM c GROUP BY ALL),
l AS (SELECT user_id, max(turn) AS last_turn FROM p GROUP BY user_id), lp AS (SELECT user_id, turn, max(part) AS last_part FROM p GROUP BY ALL), t AS (SELECT user_id, max(ts) AS last_ts FROM sealed GROUP BY user_id)"""
)


@query(f"""WITH {STREAM_TURNS} SELECT 's' || user_id AS session_id, turn AS turn_ordinal, part, n, coalesce(prompts, 0) AS prompts, tools, CASE WHEN part < last_part THEN 'size' WHEN turn < last_turn THEN 'prompt' ELSE 'timeout' END AS closed_by
FROM g JOIN l USING (user_id) JOIN lp USING (user_id, turn) JOIN t USING (user_id) WHERE part < last_part OR turn < last_turn OR last_ts + INTERVAL 7 DAY <= {SEALED}""")
def st3_close_turns(spark, sf_dir):
    """Turns that a later prompt, their size or seven days without a row close, as far as the watermark has come; the
    ordinals are those of w4, whatever order the rows come in."""
    view = F.col("event_type") == "view"
    e = events(spark, sf_dir).select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.when(view, "prompt-submit").otherwise("tool-post").alias("stage"), F.when(~view, F.col("event_type")).alias("tool")).where("session_id IS NOT NULL")
    with _stateful(spark):
        out = _drained(jobs.close_turns(_stream(e)))
    longs = [F.col(c).cast("long").alias(c) for c in ("turn_ordinal", "part", "n", "prompts")]
    return out.select("session_id", *longs, "tools", "closed_by")


@query(f"WITH {USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (tool = 'search') AS searches, count(*) FILTER (tool = 'ask') AS asks FROM usage GROUP BY 1")
def st4_usage_daily(spark, sf_dir):
    """All days. Usage without a time is of no day; it is counted under null."""
    usage = _usage(spark, sf_dir).select("ts", "tool")
    days = _all_windows(jobs.usage_daily, usage).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    undated = usage.where("ts IS NULL").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.unionByName(undated.agg(*(F.count_if(F.col("tool") == tool).alias(name) for tool, name in (("search", "searches"), ("ask", "asks")))))


@query(f"WITH {USAGE} SELECT strftime(date_trunc('day', ts) + to_days(CAST(d AS INT)), '%Y-%m-%d') AS until, count(*) FILTER (tool = 'search') AS searches, count(*) FILTER (tool = 'ask') AS asks FROM usage, range(1, 8) r(d) GROUP BY 1")
def st4_usage_rolling(spark, sf_dir):
    """All windows. Usage without a time is in none; like any other it counts for seven days, whose dates are null."""
    usage = _usage(spark, sf_dir).select("ts", "tool")
    windows = _all_windows(jobs.usage_rolling, usage).withColumn("until", F.date_format("until", "yyyy-MM-dd"))
    undated = usage.where("ts IS NULL").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("until"))
    return windows.unionByName(undated.agg(*((7 * F.count_if(F.col("tool") == tool)).alias(name) for tool, name in (("search", "searches"), ("ask", "asks")))))


@query(f"WITH {LOG} SELECT id, seq, state FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, seq DESC) = 1")
def st5_keep_latest(spark, sf_dir):
    log, path = _log(spark, sf_dir), scratch(spark, "latest")
    q = jobs.keep_latest(_stream(log.withColumn("ts", F.timestamp_seconds(F.col("seq") * 600)).select("id", "version", "seq", "state", "ts")).drop("ts"), path, scratch(spark, "progress"), "id", "version")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return jobs.read_latest(spark, path, log.schema).select("id", "seq", "state")


@query(f"""WITH RECURSIVE {QUEUE}, rows AS (SELECT * FROM queue WHERE ts <= {SEALED}), lives(id, first_ts) AS (
  SELECT id, min(ts) FROM rows GROUP BY id
  UNION ALL SELECT l.id, min(r.ts) FROM lives l JOIN rows r ON r.id = l.id AND r.ts > l.first_ts + INTERVAL 7 DAY GROUP BY l.id, l.first_ts
), i AS (SELECT l.id, first_ts, bool_or(NOT tombstone) AS pending, bool_or(tombstone) AS done FROM lives l JOIN rows r ON r.id = l.id AND r.ts BETWEEN first_ts AND first_ts + INTERVAL 7 DAY GROUP BY ALL)
SELECT 'i' || id AS id, CASE WHEN done THEN 'dequeued' ELSE 'expired' END AS outcome FROM i WHERE pending AND (done OR first_ts + INTERVAL 7 DAY <= {SEALED})""")
def st6_expire_queue(spark, sf_dir):
    """An item's life is seven days from its first row; what comes later is a new item."""
    log = _queue(spark, sf_dir).select(F.concat(F.lit("i"), "id").alias("id"), "tombstone", "ts").where("id IS NOT NULL")
    with _stateful(spark):
        return _drained(jobs.expire_queue(_stream(log)))


@query(f"WITH {EVENTS}, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM s) SELECT 's' || user_id AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS n FROM n GROUP BY user_id, nr")
def st7_sessions(spark, sf_dir):
    """All sessions. An event without a time is a session of its own, without dates.

    Spark's window takes in an event exactly a gap after the last one; the SQL does not, so the gap is a microsecond less.
    """
    e = events(spark, sf_dir).select(F.concat(F.lit("s"), "user_id").alias("session_id"), "ts")
    spans = _all_windows(partial(jobs.sessions, gap="5 hours 59 minutes 59.999999 seconds"), e)
    spans = spans.withColumn("ended_at", F.col("ended_at") + F.expr("INTERVAL 1 MICROSECOND"))
    undated = e.where("ts IS NULL").select("session_id", F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.lit(1).cast("long").alias("n"))
    return spans.unionByName(undated).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "ended_at")})
