"""The few vectorised helpers that built-in functions cannot express."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it
    unset and gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mnemoframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: computed once, lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def isolated(spark: SparkSession, tasks: Sequence[tuple[str, Callable[[], DataFrame]]], columns: Sequence[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(rows, failures): each task's ``columns`` from a write of its own, so one that raises, while it is planned or on any
    row, costs its own rows only and is listed with its error."""
    found, failed = None, []
    for name, make in tasks:
        path = scratch(spark, "isolated")
        try:
            rows = make().select(*columns)
            rows.write.parquet(path)
            part = spark.read.schema(rows.schema).parquet(path)
            found = part if found is None else found.unionByName(part)
        except Exception as e:  # a user's function may raise anything
            failed.append((name, f"{type(e).__name__}: {e}"))
    return found, failed


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(IntegerType())
def shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many words two texts of words between single blanks share, as multisets. Built-in functions would compare
    each word with all others, which takes minutes on whole documents."""
    return pd.Series([sum((Counter(x.split(" ")) & Counter(y.split(" "))).values()) for x, y in zip(a, b, strict=True)], dtype="int32")


def nfkc_where_needed(col: Column) -> Column:
    """NFKC; ASCII texts, for which it changes nothing, do not leave the JVM's branch."""
    return F.when(col.rlike(r"^\p{ASCII}*$"), col).otherwise(nfkc(col))


def embedder(dims: int = 256, n: int = 3, normalise: Callable[[str], str] | None = None) -> Callable:
    """Texts to unit vectors of hashed character n-grams (FNV-1a over code points, modulo ``dims``)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_embed(t, dims, n) for t in texts])

    return embed


def _embed(text: str | None, dims: int, n: int) -> np.ndarray:
    folded = unicodedata.normalize("NFKC", text or "").lower()
    words = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else " " for c in folded).split()
    out = np.zeros(dims, dtype=np.float32)
    if not words:
        return out
    codes = np.array([ord(c) for c in f" {' '.join(words)} "], dtype=np.uint64)
    width = min(n, len(codes))
    h = np.full(len(codes) - width + 1, 0x811C9DC5, dtype=np.uint64)
    for i in range(width):
        h = ((h ^ codes[i : len(codes) - width + 1 + i]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    counts = np.bincount((h % np.uint64(dims)).astype(np.int64), minlength=dims).astype(np.float64)
    return (counts / np.sqrt((counts**2).sum())).astype(np.float32)
