"""A table of embedded texts, keyed by content, model and dimensions: a text is embedded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, vec array<float>, model string, dims int"


class VectorStore:
    """Vectors under ``path`` by (model, dims) folders. ``embed`` is a column function from text to vector."""

    def __init__(self, spark: SparkSession, path: str, model: str, dims: int, embed: Callable[[str], Column]):
        self.spark, self.path, self.model, self.dims, self.embed = spark, path, model, dims, embed

    def stored(self) -> DataFrame:
        """(hash, vec) of this model and these dimensions; vectors of others, or of a wrong length, are left out."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "hash string, vec array<float>")
        return rows.where((F.col("model") == self.model) & (F.col("dims") == self.dims) & (F.size("vec") == self.dims)).select("hash", "vec")

    def fill(self, texts: DataFrame, text: str = "text") -> int:
        """Embed the distinct texts that are not stored yet; how many these were. A null text is an empty one. A run that is
        lost half-way stores nothing, as the write is committed at its end."""
        rows = texts.select(F.coalesce(text, F.lit("")).alias("text")).distinct().withColumn("hash", F.sha2("text", 256))
        new = rows.join(self.stored(), "hash", "left_anti")
        before = self.stored().count()
        made = new.select("hash", self.embed("text").alias("vec"), F.lit(self.model).alias("model"), F.lit(self.dims).alias("dims"))
        made.write.mode("append").partitionBy("model", "dims").parquet(self.path)
        return self.stored().count() - before

    def vectors(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``vec``; rows whose text is not stored with these dimensions are left out."""
        keyed = docs.withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256))
        # Two runs at once may store a text twice.
        once = self.stored().groupBy("hash").agg(F.first("vec").alias("vec"))
        return keyed.join(once, "hash").drop("hash")
