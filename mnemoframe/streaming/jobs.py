"""Structured Streaming jobs. Batch and stream share the row rules; event time is bounded by watermarks.

The stateful jobs use transformWithStateInPandas, which needs the RocksDB state store provider
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mnemoframe.operators.ledger import reduce_latest, redact, valid_events
from mnemoframe.sources.logs import map_hook_events, with_hash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def ingest(raw: DataFrame, at: Column) -> DataFrame:
    """Raw payloads to valid, redacted, hashed events with day columns for the ledger's folders."""
    events, _ = map_hook_events(raw, at)
    good = with_hash(redact(valid_events(events), "payload").drop("redactions"))
    day = F.to_date("timestamp_iso")
    return good.withColumns({"yyyy": F.date_format(day, "yyyy"), "mm": F.date_format(day, "MM"), "dd": F.date_format(day, "dd")})


def write_ledger(events: DataFrame, path: str, checkpoint: str):
    """Append the stream of ingest under yyyy/mm/dd, exactly once by the file sink's log."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("yyyy", "mm", "dd").trigger(availableNow=True).start()


def dedup(events: DataFrame, ts: str = "ts", within: str = "7 days", period: Column | None = None) -> DataFrame:
    """The first event of each content hash within the watermark; state is bounded by it.

    When a hash is forgotten depends on the micro-batches. With a ``period`` content counts anew in each of them, whatever
    batches it came in; a period should be no longer than the watermark's delay.
    """
    if period is None:
        return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(["hash"])
    return events.withColumn("period", period).withWatermark(ts, within).dropDuplicatesWithinWatermark(["hash", "period"]).drop("period")


def usage_daily(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """Searches and asks by UTC day."""
    rows = usage.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"))
    return rows.agg(F.count_if(F.col("tool") == "search").alias("searches"), F.count_if(F.col("tool") == "ask").alias("asks")).select(F.col("w.start").alias("day"), "searches", "asks")


def usage_rolling(usage: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Counts over the last ``days`` days, every day."""
    rows = usage.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"))
    return rows.agg(F.count_if(F.col("tool") == "search").alias("searches"), F.count_if(F.col("tool") == "ask").alias("asks")).select(F.col("w.end").alias("until"), "searches", "asks")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Spans of activity for each session id where no end event arrives."""
    rows = events.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


MANIFEST = "batch long, bucket int, folder string"


def _published(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last published batch and the folder of each bucket in it; (-1, {}) before the first. At most ``buckets`` rows."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch finds no table
            raise
        return -1, {}
    last = rows.agg(F.max("batch")).first()[0]
    found = rows.where(F.col("batch") == last).collect() if last is not None else []
    return (last if last is not None else -1), {r["bucket"]: r["folder"] for r in found if r["bucket"] is not None}


def read_latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The reduced table as the last manifest names it: always that of a whole batch."""
    _, folders = _published(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())])


def merge_latest(batch: DataFrame, batch_id: int, path: str, key: str, version: str, buckets: int = 32) -> None:
    """Reduce a batch together with the buckets that it touches, and publish the table that has them in place.

    New buckets go to a folder of their own, nothing is overwritten. Then one file, the manifest, names the folder of
    every bucket; it appears as a whole or not at all. Until then readers see the table of the batch before, and a
    batch that runs again after a failure starts from that table too; one that was published already does nothing.
    """
    spark = batch.sparkSession
    last, folders = _published(spark, path)
    if last >= batch_id:
        return
    fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    if old := [f"{folders[b]}/bucket={b}" for b in touched if b in folders]:
        kept = spark.read.schema(batch.schema).parquet(*old)
        fresh = fresh.unionByName(kept.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    folder = f"{path}/data/{batch_id:020}-{uuid.uuid4().hex}"
    reduce_latest(fresh, [key, "bucket"], version).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    now = folders | dict.fromkeys(touched, folder)
    rows = [(batch_id, b, f) for b, f in sorted(now.items())] or [(batch_id, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def keep_latest(log: DataFrame, path: str, checkpoint: str, key: str, version: str, buckets: int = 32):
    """Keep the reduced table under ``path`` current; ``read_latest`` reads it. An older revision that comes late never
    wins, as every batch is reduced together with what it touches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_latest(batch, batch_id, path, key, version, buckets)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the data folders that the last manifest does not name; how many went. Not while a batch or a reader runs."""
    _, folders = _published(spark, path)
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {f.rsplit("/", 1)[-1] for f in folders.values()}
    gone = [s.getPath() for s in files.listStatus(root) if s.getPath().getName() not in named]
    for old in gone:
        files.delete(old, True)
    return len(gone)


#: Groups of keys that have one state: a task's calls grow with these and the batches, not with the keys.
BUCKETS = 512


class InOrder(StatefulProcessor):
    """Rows of each key by event time, whatever micro-batches they came in.

    Keys are dealt into buckets, whose rows and states are kept and woken together, as a call for each key costs far more
    than its rows do. Rows wait in state until the watermark passes them, when none before them can come any more; a timer
    at the earliest one wakes the bucket. ``step`` then gets the rows of each key that has some, or wants to be woken, in
    the order of (us, seq) and gives its output, its new state and the time at which it wants to be woken without rows. So
    results depend on event times and the final watermark, not on batches. State holds what came within the watermark's
    delay, and the keys' own states; a task holds those of one bucket.
    """

    key: str
    row_columns: tuple[str, ...]
    out_schema: str

    def step(self, key: Any, state: list | None, rows: list[tuple], until: int) -> tuple[list, list | None, int | None]:
        """(output, new state, wake-up time) for rows in order; all rows up to ``until`` are known. Times in microseconds."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Pickled lists of (key, us, seq, ...), one for each time that rows came, and of (key, state, wake-up time).
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getValueState("states", "states binary")

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.out_schema.split(", ")])

    def _wake(self, us: int, after: int = -1) -> None:
        """One timer, at the earliest time asked for; those up to ``after`` are going off now."""
        at, timers = -(-us // 1000), [t for t in self.handle.listTimers() if t > after]
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            columns = [batch[c].astype(object) for c in (self.key, *self.row_columns)]
            fresh += zip(*(c.where(c.notna(), None) for c in columns), strict=True)
        if fresh:
            self.waiting.appendValue((pickle.dumps(fresh),))
            self._wake(min(r[1] for r in fresh))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        known = [r for (chunk,) in self.waiting.get() for r in pickle.loads(chunk)] if self.waiting.exists() else []
        states = {k: (state, wake) for k, state, wake in pickle.loads(self.states.get()[0])} if self.states.exists() else {}
        ready = {k: [] for k, (_, wake) in states.items() if wake <= until}
        for r in known:
            if r[1] <= until:
                ready.setdefault(r[0], []).append(r[1:])
        rest = [r for r in known if r[1] > until]
        if len(rest) < len(known):
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        found = []
        for k, rows in ready.items():
            out, state, wake = self.step((k,), states.pop(k, (None, None))[0], sorted(rows, key=lambda r: r[:2]), until)
            found += out
            if state:
                states[k] = (list(state), wake)
        if ready:
            self.states.update((pickle.dumps([(k, *s) for k, s in states.items()]),)) if states else self.states.clear()
        times = [r[1] for r in rest] + [wake for _, wake in states.values()]
        if times:
            self._wake(max(min(times), until + 1), until // 1000)
        yield self._frame(found)

    def close(self) -> None:
        pass


TURN_SCHEMA = "session_id string, turn_ordinal int, part int, n int, prompts int, tools string, closed_by string"


class TurnCloser(InOrder):
    """Closes a session's turn at the next prompt, at the session's end or after seven days, in parts of ``size``.

    As in the batch operator, what comes before a session's first prompt is part of that prompt's turn, and prompts alone
    count turns: what follows seven silent days without a prompt is another part of the same turn. A session is forgotten
    after a year; its turns would count from 1 again.
    """

    size = 50
    silent_us = 7 * DAY_US
    forget_us = 365 * DAY_US
    key, row_columns = "session_id", ("us", "seq", "stage", "tool")
    out_schema = TURN_SCHEMA

    def step(self, key, state, rows, until):
        ordinal, part, n, prompts, tools, last, prompted = state or [1, 1, 0, 0, "", 0, False]
        counts = Counter({k: int(v) for k, v in (x.rsplit(":", 1) for x in tools.split(",") if x)})
        out = []

        def spelled() -> str:
            return ",".join(f"{k}:{v}" for k, v in sorted(counts.items()))

        def close(why: str) -> None:
            nonlocal n, prompts
            if n:
                out.append((key[0], ordinal, part, n, prompts, spelled(), why))
            n = prompts = 0
            counts.clear()

        for us, _, stage, tool in rows:
            if n and us > last + self.silent_us:
                close("timeout")
                part += 1
            if stage == "prompt-submit" and prompted:
                close("prompt")
                ordinal, part, prompted = ordinal + 1, 1, False
            elif n >= self.size:
                close("size")
                part += 1
            prompted = prompted or stage == "prompt-submit"
            n, prompts, last = n + 1, prompts + (stage == "prompt-submit"), us
            if tool:
                counts[tool] += 1
            if stage == "session-end":
                close("end")
                ordinal, part, prompted = ordinal + 1, 1, False
        if n and last + self.silent_us <= until:
            close("timeout")
            part += 1
        if last + self.forget_us <= until:
            return out, None, None
        return out, [ordinal, part, n, prompts, spelled(), last, prompted], last + (self.silent_us if n else self.forget_us)


def _in_order(rows: DataFrame, delay: str, processor: InOrder, schema: str, buckets: int) -> DataFrame:
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(processor.key), F.lit(buckets)))
    return dealt.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def close_turns(events: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Sealed turns of (session_id, seq, ts, stage, tool) events, which may come in any order within ``delay``; abandoned
    ones close by event time after 7 days."""
    rows = events.select("session_id", F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("us"), "stage", "tool")
    return _in_order(rows, delay, TurnCloser(), TURN_SCHEMA, buckets)


EXPIRY_SCHEMA = "id string, outcome string"


class QueueExpirer(InOrder):
    """An item leaves by its tombstone, which may come first, or seven days after its first row. Rows after that are an
    item of their own."""

    life_us = 7 * DAY_US
    key, row_columns = "id", ("us", "seq", "tombstone")
    out_schema = EXPIRY_SCHEMA

    def step(self, key, state, rows, until):
        first, pending, done = state or [None, False, False]
        out = []

        def expire() -> None:
            nonlocal first, pending, done
            if pending and not done:
                out.append((key[0], "expired"))
            first, pending, done = None, False, False

        for us, _, tombstone in rows:
            if first is not None and us > first + self.life_us:
                expire()
            first = us if first is None else first
            left = pending and done
            pending, done = pending or not tombstone, done or bool(tombstone)
            if pending and done and not left:
                out.append((key[0], "dequeued"))
        if first is not None and first + self.life_us <= until:
            expire()
        return (out, None, None) if first is None else (out, [first, pending, done], first + self.life_us)


def expire_queue(log: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """What became of each item of (id, tombstone, ts), whose rows may come in any order within ``delay``."""
    rows = log.select("id", "tombstone", "ts", F.unix_micros("ts").alias("us"), F.lit(0).cast("long").alias("seq"))
    return _in_order(rows, delay, QueueExpirer(), EXPIRY_SCHEMA, buckets)
