"""Retrieval and answer quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import text as T


def evidence_ranks(ranked: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("query_id",), item: str = "doc_id") -> DataFrame:
    """Per query: ranks of its evidence in the list, how much evidence there is, the reciprocal of the first rank."""
    wanted = evidence.select("query_id", item).distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    found = ranked.join(wanted, ["query_id", item]).groupBy(*keys).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    lists = ranked.select(*keys).distinct().join(total, "query_id", "right") if list(keys) != ["query_id"] else total
    out = lists.join(found, list(keys), "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    return out.withColumn("rr", F.coalesce(1.0 / F.try_element_at("ranks", F.lit(1)), F.lit(0.0)))


def _recalls(ks: Sequence[int]):
    def recall(k: int):
        return F.avg(F.size(F.filter("ranks", lambda r: r <= k)) / F.col("n_evidence")).alias(f"recall_{k}")

    return [recall(k) for k in ks]


def retrieval_metrics(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Macro recall@k and MRR by mode and by (mode, type), over all questions and without ``_abs`` ones.

    ``ranks`` has (mode, type, query_id, ranks, n_evidence, rr).
    """
    scoped = ranks.withColumn("scope", F.explode(F.when(F.col("query_id").cast("string").endswith("_abs"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("no_abstention")))))
    grouped = scoped.groupingSets([["scope", "mode"], ["scope", "mode", "type"]], "scope", "mode", "type")
    return grouped.agg(F.count("*").alias("n"), *_recalls(ks), F.avg("rr").alias("mrr"))


def search_bench(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Recall@k (any relevant result in k) and MRR per mode, from (mode, query_id, ranks, rr)."""
    first = F.try_element_at("ranks", F.lit(1))
    hits = [F.avg(F.coalesce(first <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy("mode").agg(F.count("*").alias("n"), *hits, F.avg("rr").alias("mrr"))


def mode_changes(ranks: DataFrame, base: str, other: str) -> DataFrame:
    """Queries that only one of two modes answers: ``rescued`` by ``other`` or ``lost``."""
    a = ranks.where(F.col("mode") == base).select("query_id", (F.size("ranks") > 0).alias("a"))
    b = ranks.where(F.col("mode") == other).select("query_id", (F.size("ranks") > 0).alias("b"))
    return a.join(b, "query_id").where("a <> b").select("query_id", F.when(F.col("b"), "rescued").otherwise("lost").alias("change"))


def lane_sets(cases: DataFrame) -> DataFrame:
    """``cases`` (expect_lanes, lanes) with the lanes that are right, missing and too many."""
    return cases.withColumns({"right_lanes": F.array_intersect("expect_lanes", "lanes"), "missing_lanes": F.array_except("expect_lanes", "lanes"), "extra_lanes": F.array_except("lanes", "expect_lanes")})


def router_bench(cases: DataFrame) -> DataFrame:
    """Lane hit rate, macro precision and recall, file hit rate of (expect_lanes, lanes, expect_files, files)."""
    cases = lane_sets(cases)
    shared = F.size("right_lanes")
    files = F.when(F.size("expect_files") > 0, (F.size(F.array_intersect("expect_files", "files")) > 0).cast("double"))
    return cases.agg(
        F.count("*").alias("n"),
        F.avg((shared > 0).cast("double")).alias("lane_hit"),
        F.avg(F.when(F.size("lanes") > 0, shared / F.size("lanes")).otherwise(0.0)).alias("precision"),
        F.avg(F.when(F.size("expect_lanes") > 0, shared / F.size("expect_lanes")).otherwise(1.0)).alias("recall"),
        F.avg(files).alias("file_hit"),
    )


def rot_curve(cases: DataFrame) -> DataFrame:
    """Hit@5, MRR and mean top-5 tokens by checkpoint and condition, and by type too, with skipped cases counted.

    ``cases`` has (fraction, condition, type, usable, first_rank, top5_tokens).
    """
    hit = F.when(F.col("usable"), F.coalesce(F.col("first_rank") <= 5, F.lit(False)).cast("double"))
    rr = F.when(F.col("usable"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    grouped = cases.groupingSets([["fraction", "condition"], ["fraction", "condition", "type"]], "fraction", "condition", "type")
    return grouped.agg(F.count_if("usable").alias("evaluated"), F.count_if(~F.col("usable")).alias("skipped"), F.avg(hit).alias("hit_5"), F.avg(rr).alias("mrr"), F.avg(F.when(F.col("usable"), F.col("top5_tokens"))).alias("top5_tokens"))


def ceiling_diagnosis(text: DataFrame, vector: DataFrame, evidence: DataFrame, depth: int = 100) -> DataFrame:
    """How many queries have evidence in the first ``depth`` of text, vectors, both or neither."""
    def reached(ranked: DataFrame, name: str) -> DataFrame:
        return ranked.where(F.col("rank") <= depth).join(evidence, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(True))

    rows = evidence.select("query_id").distinct().join(reached(text, "t"), "query_id", "left").join(reached(vector, "v"), "query_id", "left")
    where = F.when(F.col("t") & F.col("v"), "both").when(F.col("t"), "text").when(F.col("v"), "vector").otherwise("neither")
    return rows.groupBy(where.alias("reached")).agg(F.count("*").alias("n"))


def join_judgments(answers: DataFrame, judgments: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers of known questions with their judgment, if any."""
    return answers.join(questions, "question_id").join(judgments, "question_id", "left")


def qa_scores(answers: DataFrame) -> DataFrame:
    """Exact, contains, token F1 and judge accuracy (null if nothing was judged), overall and per type.

    ``answers`` has (type, answer, truth, correct); NFKC is applied by the caller where texts need it.
    """
    a, t = T.normalize_answer(F.col("answer")), T.normalize_answer(F.col("truth"))
    rows = answers.select("type", ((a == t) & (t != "")).alias("exact"), ((t != "") & a.contains(t)).alias("contains"), T.token_f1(F.col("answer"), F.col("truth")).alias("f1"), "correct")
    return rows.rollup("type").agg(F.count("*").alias("n"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("contains").cast("double")).alias("contains"), F.avg("f1").alias("f1"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def consolidation_stats(sessions: DataFrame) -> DataFrame:
    """Sessions, superseded ones and the mean share of tokens that the core text keeps."""
    share = F.when(F.col("superseded_by").isNull() & (T.estimate_tokens(F.col("text")) > 0), T.estimate_tokens(F.col("core")) / T.estimate_tokens(F.col("text")))
    return sessions.agg(F.count("*").alias("total"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.avg(share).alias("mean_ratio"))
