"""Markdown pages: reading, splitting notes, index scope, exchange documents."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.operators.govern import describe_pages, rewrite_links

REQUIRED = ("id", "type", "status", "updatedAt")
HEAD = "id string, type string, status string, updatedAt string, tags array<string>, confidence double"
CANONICAL_DIRS = ["concepts", "decisions", "projects", "profile", "evidence", "patterns"]


def _parse_heads():
    """A column function from the YAML block of a page to its members; bad YAML has none."""

    @F.pandas_udf(HEAD)
    def parse(heads: pd.Series) -> pd.DataFrame:
        import yaml

        rows = []
        for text in heads:
            try:
                data = yaml.safe_load(text) if text else {}
            except yaml.YAMLError:
                data = {}
            data = data if isinstance(data, dict) else {}
            tags = data.get("tags")
            number = data.get("confidence")
            rows.append([*(None if data.get(k) is None else str(data[k]) for k in REQUIRED), [str(t) for t in tags] if isinstance(tags, list) else [], float(number) if isinstance(number, int | float) else None])
        return pd.DataFrame(rows, columns=["id", "type", "status", "updatedAt", "tags", "confidence"])

    return parse


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, path, type, status, updated_at, tags, confidence, body) of markdown files.

    A head between ``---`` lines needs id, type, status and updatedAt, or the page is dropped. A page without a head
    is a note: id ``note.<path>``, status draft. Spark's readers leave out folders and files named ``_...``.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parse_pages(files.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value")))


def parse_pages(raw: DataFrame) -> DataFrame:
    """read_pages for markdown that already is in a table of (path, value)."""
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    rows = raw.withColumn("has_head", F.col("value").rlike(r"(?s)\A---\r?\n.*?\r?\n---\r?\n")).withColumn("body", F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""))
    rows = rows.withColumn("h", _parse_heads()(head))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.md$", 1), r"\s+", "-")
    pages = rows.select(
        F.when(F.col("has_head"), F.col("h.id")).otherwise(F.concat(F.lit("note."), name)).alias("page_id"), "path",
        F.when(F.col("has_head"), F.col("h.type")).otherwise("note").alias("type"), F.when(F.col("has_head"), F.col("h.status")).otherwise("draft").alias("status"),
        F.when(F.col("has_head"), F.col("h.updatedAt")).otherwise("").alias("updated_at"), F.col("h.tags").alias("tags"), F.col("h.confidence").alias("confidence"), "body",
    )
    return pages.where("page_id is not null and type is not null and status is not null and updated_at is not null")


def chunk_notes(pages: DataFrame) -> DataFrame:
    """Notes split at ``## `` headings into pages ``<id>.<i>``: i counts all parts from 1, blank ones are skipped. Other
    pages, and notes of one part, stay."""
    parts = F.split("body", r"\n(?=##\s)")
    some = pages.withColumn("parts", F.when(F.col("type") == "note", parts).otherwise(F.array("body")))
    exploded = some.select("*", F.posexplode("parts").alias("i", "part"))
    many = F.size("parts") > 1
    kept = exploded.where(~many | (F.trim(F.regexp_replace("part", r"\s+", " ")) != ""))
    new_id = F.when(many, F.concat_ws(".", "page_id", F.col("i") + 1)).otherwise(F.col("page_id"))
    return kept.withColumns({"page_id": new_id, "body": F.col("part")}).drop("parts", "part", "i")


def index_scope(pages: DataFrame, dirs: Sequence[str] = CANONICAL_DIRS, with_notes: bool = True) -> DataFrame:
    """Pages in the canonical folders, and notes; no path with a part that starts with ``_``, no README."""
    inside = F.col("path").rlike(rf"(^|/)({'|'.join(dirs)})/")
    keep = inside | (F.col("type") == "note") if with_notes else inside
    return pages.where(keep & ~F.col("path").rlike(r"(^|/)_") & ~F.col("path").rlike(r"(?i)(^|/)readme\.md$"))


def exchange_documents(pages: DataFrame, only_live: bool = False) -> DataFrame:
    """Pages (page_id, path, type, status, updated_at, tags, body) as exchange documents with links rewritten."""
    rows = pages.where(F.col("status").isin("active", "draft")) if only_live else pages
    docs = describe_pages(rewrite_links(rows, rows.select("page_id", "path")))
    return docs.select(
        F.element_at(F.split("path", "/"), 1).alias("dir"), "page_id", "type", F.coalesce("title", "page_id").alias("title"), "description", F.col("path").alias("resource"),
        "tags", F.col("updated_at").alias("timestamp"), F.col("status").alias("x_status"), "body",
    )


def bundle_indexes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one index text for each folder, root rows with counts)."""
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("](/"), F.col("resource"), F.lit(")"))
    by_dir = documents.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("index"), F.count("*").alias("n"))
    return by_dir, by_dir.select("dir", "n")


def export_bundle(pages: DataFrame, path: str, only_live: bool = False) -> None:
    """Write documents by folder, with the indexes beside them."""
    documents = exchange_documents(pages, only_live)
    documents.write.mode("overwrite").partitionBy("dir").json(f"{path}/documents")
    by_dir, root = bundle_indexes(documents)
    by_dir.write.mode("overwrite").json(f"{path}/indexes")
    root.write.mode("overwrite").json(f"{path}/root")
