"""Shared helpers of the training-data operators: shared folders, span digests, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset and
    gets a folder of its own; on a cluster that would be a folder that other machines cannot see, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mnemoframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows and bytes of an Arrow batch: texts may be long, so a Python worker holds few of them at once.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once. These are settings of the session; the operators give the same
    rows whatever they are, but need them for bounded memory on long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key, where a few keys may have most of the rows.

    Keys of more than one in ``share`` of all rows are at most ``share``, whatever the input: their rows of ``side``
    are broadcast, the other rows are joined by a shuffle. ``rows`` is read several times and should be a table.
    """
    total = rows.count()
    hot = [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 64) & (F.col("n") * share > total)).select(key).collect()]
    if not hot:
        return rows.join(side, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    common = rows.where(is_hot).join(F.broadcast(side.where(is_hot)), key, how)
    return rows.where(~is_hot).join(side.where(~is_hot), key, how).unionByName(common)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


Span = tuple[int, int, str]  # start, end (exclusive), kind


def span_text(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` joined by commas, ordered by start, then by the kind's place in ``kinds``."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def span_digest(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    return hashlib.sha256(span_text(spans, kinds).encode()).hexdigest()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star steps. Every round is written to the shared folder, so lost
    executors cost one round at most, and a hub's edges are never gathered: each step is a ``min`` (combined
    before the shuffle) and an equi-join that AQE may split.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    pairs = materialise(pairs, "edges")
    last = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: the neighbours above a node point to the smallest of its neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: what a node points to (all smaller) and the node itself point to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        pairs = materialise(small.where("a <> b").distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
