"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FEATURES = 256
#: Kernel width: standardised statistics of two texts differ by about twice their number in the sum of squares, so the
#: kernel is about 0.2 for unrelated texts. Penalty: that of one row, so it fades as rows come in.
GAMMA = 0.04
RIDGE = 1.0
SEED = 7
#: Labelled rows used for fitting, at most about (chosen by hash of doc_id).
TRAIN_ROWS = 200_000
#: Parts of the teaching documents; each is scored for the calibration by a ridge of the others.
FOLDS = 5
#: Score bins that the calibration sees.
BINS = 2000
THRESHOLD = 0.3

_SYMBOLS = "#$%&*|!@^~<>{}[]=+\\/_`"
_ENDS = ".?!"
_STATISTICS = 18


def changed_by_lower(text: str, lower: str) -> int:
    """How many characters of the whole text are upper case; ``lower`` is the text in lower case."""
    if len(lower) != len(text):  # a few characters become two
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (text, lower))
    return int(np.count_nonzero(a != b))


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text: sizes, shares of kinds of characters, words and lines. Empty: all zero."""
    text = text or ""
    if not text:
        return [0.0] * _STATISTICS
    n = len(text)
    words = text.split()
    m = len(words) or 1
    lines = text.split("\n")
    sizes = list(map(len, words)) or [0]
    symbols = [text.count(c) for c in _SYMBOLS]
    distinct = set(words)
    lower = text.lower()
    upper = sum(map(str.isupper, words))
    counts = Counter(lines)
    ends = sum(text.count(c) for c in _ENDS)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        sum(sizes) / m,
        sum(s <= 3 for s in sizes) / m,
        max(sizes) / (sum(sizes) / m + 1) / 10,
        sum(symbols) / n * 10,
        max(symbols) / n * 10,
        sum(map(str.isalpha, words)) / m,
        upper / m,
        changed_by_lower(text, lower) / n * 4,
        len(re.findall(r"\d", text)) / n * 10,
        ends / m * 4,
        text.count(",") / m * 4,
        len(distinct) / m,
        1 - len(counts) / len(lines),
        max(counts.values()) / len(lines),
        math.log1p(m / len(lines)) / 3,
        len(text.encode()) / n - 1,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, with a constant column."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phase
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit with least weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; such rows never teach. A null id: true."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on labelled rows outside the held-out fifth; None if there are none.

    Several labels of one document count as their mean. The chosen labels are at most about ``rows`` (by hash of
    doc_id), so they are broadcast and only labelled texts are looked at. What reaches the driver has a fixed
    size: means, the sums of the normal equations by fold (added up on the executors first) and BINS calibration bins.
    The calibration is isotonic over scores from the ridge of the other folds, whatever the number of labels. It has as
    many steps as the labels support; scores between two bins are interpolated.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y")).where(~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["y", "fold"]].assign(x=[statistics(t) for t in batch["text"]])[["x", "y", "fold"]]

    fold = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y", fold)
    train = materialise(labelled.mapInPandas(count, "x array<double>, y double, fold int"), "train")
    sums = train.agg(F.count("*").alias("n"), *(F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(_STATISTICS)), *(F.stddev_pop(F.col("x")[j]).alias(f"s{j}") for j in range(_STATISTICS))).first()
    if not sums["n"]:
        return None
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array([sums[f"m{j}"] for j in range(_STATISTICS)]),
        np.array([sums[f"s{j}"] or 1.0 for j in range(_STATISTICS)]) + 1e-9,
        rng.normal(0, math.sqrt(2 * GAMMA), (_STATISTICS, FEATURES)),
        rng.uniform(0, 2 * math.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.zeros(1),
        np.zeros(1),
    )
    size = FEATURES + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            if len(batch):
                z = np.column_stack([model.features(np.stack(batch["x"].to_numpy())), batch["y"].to_numpy(float)])
                for fold in range(FOLDS):
                    own = z[batch["fold"].to_numpy() == fold]
                    total[fold] += own[:, :-1].T @ own
        for fold in range(FOLDS):
            yield pd.DataFrame({"fold": fold, "i": np.arange(size), "row": list(total[fold])})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": group["fold"][:1], "i": group["i"][:1], "row": [np.sum(np.stack(group["row"].to_numpy()), axis=0)]})

    shape = "fold int, i int, row array<double>"
    parts = np.zeros((FOLDS, size, size + 1))
    for r in train.mapInPandas(equations, shape).groupBy("fold", "i").applyInPandas(add, shape).collect():
        parts[r["fold"], r["i"]] = r["row"]
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-6

    def solved(system: np.ndarray) -> np.ndarray:
        return np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    # Scores of rows that a ridge has seen are too sure, so each fold is scored by the sums without its own.
    model.beta = solved(parts.sum(axis=0))
    betas = np.stack([solved(parts.sum(axis=0) - own) for own in parts])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.einsum("ij,ij->i", model.features(np.stack(batch["x"].to_numpy())), betas[batch["fold"].to_numpy()])
                yield pd.DataFrame({"bin": np.clip(raw * BINS / 2 + BINS / 4, 0, BINS - 1).astype(int), "raw": raw, "y": batch["y"]})

    bins = train.mapInPandas(scored, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    bins.sort(key=lambda r: r["raw"])
    model.edges = np.array([r["raw"] for r in bins])
    model.values = isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    return model


def scorer(model: Model | None):
    """A column function from text to score; 0.5 for all without a model."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the text is an input of a score: null and empty texts have the statistics of an empty text, repeated
    rows are scored each, and without any labels every score is 0.5. Other columns are not read.
    """
    score = scorer(fit(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    return docs.where(scorer(fit(docs, labels))("text") >= THRESHOLD)
