"""Snapshots of append-only logs: what a log's rows up to a mark reduce to, so that only the tail is folded again.

A snapshot is a shorter log that folds to the same state: of rows that a later row makes pointless none is kept. The fold
of snapshot and tail is therefore the fold of the whole log, whatever prefix the snapshot covers. It relies on ``seq``
growing as rows are appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemoframe.operators.ledger import reduce_latest

MANIFEST = "version long, mark long, folder string"


def keep_latest_rows(key: str, version: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """What a reduce to the latest revision needs of a log: one row for each key."""
    return lambda log: reduce_latest(log, key, version)


def keep_flow_rows(deltas: DataFrame) -> DataFrame:
    """What a flow log's fold needs: of each block the last block-add and, after it, the last supersede and all relations;
    of each problem the last cue card. Rows of a block before its last block-add never apply again."""
    key = ["problem_id", "block_id"]
    row = F.struct(*deltas.columns)
    last = deltas.where("op = 'block-add'").groupBy(*key).agg(F.max("seq").alias("added"))
    after = deltas.join(last, key).where("seq >= added")
    adds = after.where("op = 'block-add' and seq = added").select(*deltas.columns)
    supersedes = after.where("op = 'block-supersede'").groupBy(*key).agg(F.max_by(row, "seq").alias("r")).select("r.*")
    relations = after.where("op = 'relation-add'").select(*deltas.columns)
    cues = deltas.where("op = 'cue-card-regen'").groupBy("problem_id").agg(F.max_by(row, "seq").alias("r")).select("r.*")
    return adds.unionByName(supersedes).unionByName(relations).unionByName(cues)


class Snapshot:
    """A log's snapshot under ``path``: ``keep`` says which rows stay, a manifest of one file says which is the last."""

    def __init__(self, spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame], schema: StructType):
        self.spark, self.path, self.keep, self.schema = spark, path, keep, schema

    def _last(self) -> tuple[int, int | None, DataFrame]:
        """(version, mark, kept rows); version 0 and no mark before the first."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, None, self.spark.createDataFrame([], self.schema)
        last = rows.orderBy(F.desc("version")).first()
        return last["version"], last["mark"], self.spark.read.schema(self.schema).parquet(last["folder"])

    def rows(self, log: DataFrame) -> DataFrame:
        """A log that folds like ``log``: the snapshot and the rows behind its mark, which is a filter on the scan."""
        _, mark, kept = self._last()
        return log if mark is None else kept.unionByName(log.where(F.col("seq") > mark))

    def advance(self, log: DataFrame) -> int:
        """Take the tail of ``log`` into the snapshot; how many rows it keeps. Written in full before the manifest names it,
        so a run that is lost half-way leaves the snapshot before it, and one that runs again gives the same."""
        version, mark, _ = self._last()
        new = log.agg(F.max("seq")).first()[0]
        if new is None or (mark is not None and new <= mark):
            return 0
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        self.keep(self.rows(log.where(F.col("seq") <= new))).write.parquet(folder)
        self.spark.createDataFrame([(version + 1, new, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self.spark.read.schema(self.schema).parquet(folder).count()
