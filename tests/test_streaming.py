import contextlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mnemoframe.plans import stream_queries
from mnemoframe.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def stream(spark, tmp_path, batches, schema):
    """A file stream of one batch for each list of rows."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
        for f in (source / f"b{i}").glob("part*"):
            f.rename(source / f"{i:03}-{f.name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source / "*.parquet"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_ingest_and_dedup(spark, tmp_path):
    rows = [(json.dumps({"type": "UserPromptSubmit", "session_id": "s", "cwd": "/", "message": f"password = abcd{i % 2}"}), T0) for i in range(4)]
    df = stream(spark, tmp_path, [rows[:2], rows[2:]], "value string, ts timestamp")
    events = jobs.ingest(df, F.lit("2024-01-01T00:00:00Z")).withColumn("at", F.col("timestamp_iso").cast("timestamp"))
    q = jobs.write_ledger(events.drop("at"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 4 and out.where("payload like '%REDACTED:password%'").count() == 4
    assert len(run(jobs.dedup(events, "at"), "dedup")) == 1  # redacted, the texts are the same


def test_usage_windows_and_sessions(spark, tmp_path):
    rows = [("search" if i % 3 else "ask", T0 + timedelta(hours=9 * i), f"s{i % 2}") for i in range(20)]
    df = stream(spark, tmp_path, [rows], "tool string, ts timestamp, session_id string")
    days = run(jobs.usage_daily(df), "daily", "complete")
    assert sum(r.searches + r.asks for r in days) == 20
    rolling = run(jobs.usage_rolling(df), "rolling", "complete")
    assert max(r.searches + r.asks for r in rolling) == 19
    spans = run(jobs.sessions(df), "spans", "complete")
    assert len(spans) == 20 and all(r.n == 1 for r in spans)


def test_turns_close(spark, tmp_path):
    def row(minute, stage, tool=None, session="s", seq=0):
        return (session, seq or minute, T0 + timedelta(minutes=minute), stage, tool)

    first = [row(0, "session-start"), row(1, "prompt-submit"), row(2, "tool-post", "Bash"), row(3, "tool-post", "Bash"), row(4, "prompt-submit"), row(5, "tool-post", "Read")]
    second = [row(6, "session-end"), row(7, "prompt-submit", session="left")]
    later = [row(60 * 24 * 9, "prompt-submit", session="other")]
    last = [row(60 * 24 * 9 + 1, "prompt-submit", session="other2")]
    df = stream(spark, tmp_path, [first, second, later, last], "session_id string, seq int, ts timestamp, stage string, tool string")
    out = {(r.session_id, r.turn_ordinal): r for r in run(jobs.close_turns(df), "turns")}
    # The session's start is part of the first prompt's turn, as in turn_ordinals.
    assert (out["s", 1].closed_by, out["s", 1].n, out["s", 1].tools) == ("prompt", 4, "Bash:2")
    assert (out["s", 2].closed_by, out["s", 2].n, out["s", 2].tools) == ("end", 3, "Read:1")
    assert out["left", 1].closed_by == "timeout"


def test_queue_expires(spark, tmp_path):
    rows = [[("a", False, T0), ("b", True, T0), ("c", False, T0)], [("b", False, T0 + timedelta(minutes=1)), ("a", True, T0 + timedelta(minutes=2))], [("d", False, T0 + timedelta(days=9))], [("e", False, T0 + timedelta(days=9, minutes=1))]]
    df = stream(spark, tmp_path, rows, "id string, tombstone boolean, ts timestamp")
    assert sorted((r.id, r.outcome) for r in run(jobs.expire_queue(df), "queue")) == [("a", "dequeued"), ("b", "dequeued"), ("c", "expired")]


def test_latest_is_kept_whatever_comes_late(spark, tmp_path):
    rows = [[("k", T0, 1, "old"), ("m", None, 2, "none")], [("k", T0 + timedelta(days=2), 3, "new")], [("k", T0 + timedelta(days=1), 4, "late"), ("m", T0, 5, "some")]]
    df = stream(spark, tmp_path, rows, "id string, version timestamp, seq long, state string")
    q = jobs.keep_latest(df, str(tmp_path / "table"), str(tmp_path / "ck"), "id", "version")
    q.awaitTermination(180)
    out = jobs.read_latest(spark, str(tmp_path / "table"), df.schema)
    assert sorted((r.id, r.state) for r in out.collect()) == [("k", "new"), ("m", "some")]
    assert jobs.drop_replaced(spark, str(tmp_path / "table")) >= 1
    assert sorted((r.id, r.state) for r in jobs.read_latest(spark, str(tmp_path / "table"), df.schema).collect()) == [("k", "new"), ("m", "some")]


def test_a_batch_that_fails_half_way_leaves_the_table_before_it(spark, tmp_path):
    marker, table, schema = tmp_path / "mended", str(tmp_path / "table"), "id long, version long, seq long, state string"

    @F.udf("string")
    def fragile(state):
        import os

        if state == "broken" and not os.path.exists(marker):
            raise RuntimeError("lost")
        return state

    batches = [[(i, 1, 1, "first") for i in range(50)], [(i, 2, 2, "broken" if i == 40 else "second") for i in range(0, 50, 2)], [(i, 1, 3, "late") for i in range(50)]]
    df = stream(spark, tmp_path, batches, schema).withColumn("state", fragile("state"))

    def drain():
        q = jobs.keep_latest(df, table, str(tmp_path / "ck"), "id", "version")
        with contextlib.suppress(StreamingQueryException):
            q.awaitTermination(180)
        return q.exception(), {r.id: r.state for r in jobs.read_latest(spark, table, df.schema).collect()}

    failed, rows = drain()
    assert failed is not None and rows == dict.fromkeys(range(50), "first")
    marker.touch()
    failed, rows = drain()
    expected = {i: "late" if i % 2 else "broken" if i == 40 else "second" for i in range(50)}
    assert failed is None and rows == expected
    # A batch that was published does nothing when it runs again.
    before = jobs._published(spark, table)
    jobs.merge_latest(spark.createDataFrame([(1, 9, 9, "again")], schema), 1, table, "id", "version")
    assert jobs._published(spark, table) == before


def test_turns_do_not_depend_on_batches(spark, tmp_path):
    def row(minute, stage, tool=None, session="s"):
        return (session, minute, T0 + timedelta(minutes=minute), stage, tool)

    rows = [row(0, "prompt-submit"), row(10, "tool-post", "Read"), row(20, "prompt-submit"), row(30, "tool-post", "Bash"), row(40, "prompt-submit")]
    rows += [row(60 * 24 * 8, "tool-post", "Late"), row(60 * 24 * 8 + 1, "prompt-submit"), row(60 * 24 * 30, "prompt-submit", session="clock")]
    # The second row comes last but one, within the hour; one that comes after the watermark is left out.
    batches = [[rows[0], rows[2]], [rows[4], rows[3], row(55, "tool-post", "Edit")], [rows[1]], [rows[5]], [rows[6]], [row(5, "tool-post", "TooLate"), rows[7]]]
    df = stream(spark, tmp_path, batches, "session_id string, seq int, ts timestamp, stage string, tool string")
    out = [(r.turn_ordinal, r.part, r.n, r.prompts, r.tools, r.closed_by) for r in run(jobs.close_turns(df), "late_turns") if r.session_id == "s"]
    assert sorted(out) == [(1, 1, 2, 1, "Read:1", "prompt"), (2, 1, 2, 1, "Bash:1", "prompt"), (3, 1, 2, 1, "Edit:1", "timeout"), (3, 2, 1, 0, "Late:1", "prompt"), (4, 1, 1, 1, "", "timeout")]


def test_queue_lives_do_not_depend_on_batches(spark, tmp_path):
    day = timedelta(days=1)
    batches = [[("a", True, T0 + timedelta(minutes=30)), ("b", False, T0)], [("a", False, T0)], [("b", True, T0 + 8 * day), ("b", False, T0 + 8 * day)], [("z", False, T0 + 40 * day)]]
    df = stream(spark, tmp_path, batches, "id string, tombstone boolean, ts timestamp")
    assert sorted((r.id, r.outcome) for r in run(jobs.expire_queue(df), "lives")) == [("a", "dequeued"), ("b", "dequeued"), ("b", "expired")]


def odd_events(spark, tmp_path):
    """A row long before the others, many within two hours, two of a user exactly six hours apart, two without a time and one without a user."""
    times = [T0 - timedelta(days=200)] + [T0 + timedelta(minutes=3 * i) for i in range(40)] + [T0 + timedelta(days=8, hours=3 * i) for i in range(3)] + [None, None]
    rows = [(i, ts, None if i == 5 else i % 2, ("view", "click", "error")[i % 3], 1.0, '{"k": 1}') for i, ts in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return rows


def usage_counts(rows, dates):
    """(date, searches, asks) for each date that a row counts for."""
    counts = {}
    for _, ts, _, kind, *_ in rows:
        for date in dates(ts):
            searches, asks = counts.get(date, (0, 0))
            counts[date] = (searches + (kind != "error"), asks + (kind == "error"))
    return {(date, *n) for date, n in counts.items()}


def test_rolling_usage_has_the_windows_that_are_open_at_the_end(spark, tmp_path):
    rows = odd_events(spark, tmp_path)
    expected = usage_counts(rows, lambda ts: [ts and f"{ts + timedelta(days=d):%Y-%m-%d}" for d in range(1, 8)])
    out = [tuple(r) for r in stream_queries.st4_usage_rolling(spark, str(tmp_path)).collect()]
    assert len(out) == len(expected) and set(out) == expected


def test_daily_usage_has_the_days_that_are_open_at_the_end(spark, tmp_path):
    expected = usage_counts(odd_events(spark, tmp_path), lambda ts: [ts and f"{ts:%Y-%m-%d}"])
    out = [tuple(r) for r in stream_queries.st4_usage_daily(spark, str(tmp_path)).collect()]
    assert len(out) == len(expected) and set(out) == expected


def test_sessions_has_those_that_are_open_at_the_end(spark, tmp_path):
    gap, users, expected = timedelta(hours=6), {}, []
    for _, ts, user, *_ in odd_events(spark, tmp_path):
        users.setdefault(user, []).append(ts)
    for user, times in users.items():
        spans = [(None, None, 1)] * times.count(None)
        for ts in sorted(t for t in times if t):
            if spans and spans[-1][1] and ts < spans[-1][1]:
                spans[-1] = (spans[-1][0], ts + gap, spans[-1][2] + 1)
            else:
                spans.append((ts, ts + gap, 1))
        expected += [(None if user is None else f"s{user}", a and str(a), b and str(b), n) for a, b, n in spans]
    out = [tuple(r) for r in stream_queries.st7_sessions(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)


def test_dedup_does_not_depend_on_batches(spark, tmp_path):
    """Five years of rows, so that one arrival holds many months, and rows without a time, a user or a number."""
    times = [T0 + timedelta(days=d) for d in (0, 1, 27, 28, 29, 400, 1800)] + [None, None]
    rows = [(i, ts, user, kind, 1.0, props) for i, (ts, (user, kind, props)) in enumerate((t, c) for t in times for c in ((1, "view", '{"k": 3}'), (None, "view", '{"k": 3}'), (1, "view", "{}"), (1, None, '{"k": 3}')))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    week = lambda ts: ts and int((ts - datetime(1970, 1, 1)).total_seconds() // 604800)
    expected = {(user, kind, 3 if "3" in props else None, week(ts)) for _, ts, user, kind, _, props in rows}
    out = [tuple(r) for r in stream_queries.st2_dedup(spark, str(tmp_path)).collect()]
    assert len(out) == len(expected) and set(out) == expected


def test_keys_of_a_bucket_keep_their_own_states(spark, tmp_path):
    day = timedelta(days=1)
    rows = [[(f"i{i}", i % 3 == 0, T0 + timedelta(minutes=i)) for i in range(40)], [(f"i{i}", i % 2 == 0, T0 + day + timedelta(minutes=i)) for i in range(40)], [("i1", False, T0 + 20 * day)], [("z", False, T0 + 40 * day)]]
    df = stream(spark, tmp_path, rows, "id string, tombstone boolean, ts timestamp")
    expired = jobs.expire_queue(df, buckets=2)
    # Two groups are called in a batch, not forty.
    assert "bucket" in expired._jdf.queryExecution().analyzed().toString()
    expected = [(f"i{i}", "dequeued" if (i % 3 == 0) or (i % 2 == 0) else "expired") for i in range(40) if i % 6] + [("i1", "expired")]
    assert sorted((r.id, r.outcome) for r in run(expired, "buckets")) == sorted(expected)
