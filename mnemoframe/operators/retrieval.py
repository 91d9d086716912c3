"""Batch text and vector retrieval: many queries over many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.functions.helpers import saved

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF = 60
#: Bytes up to which a query side is broadcast after its size was looked at.
BROADCAST_ROWS = 200_000
#: Tokens up to which a search names them in the scan of a stored index.
PUSHED = 200
#: Top-k search: rows of the lists that name promising documents and how many of these are scored in full for the
#: threshold, as multiples of k; slack for sums in other orders.
SEEDS = 50
PROMISING = 4
SLACK = 1e-7


@dataclass
class Index:
    """Postings (grp, token, doc_id, tf, doc_len) and one row per group with document count and average length. A stored
    index also has a ``bucket`` column and the function that gives a token's bucket."""

    postings: DataFrame
    stats: DataFrame
    bucket: Callable[[Column], Column] | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The postings of the tokens in ``wanted`` (grp, token, ...), joined with it. Of a stored index only the buckets
        and, for a few tokens, the row groups that may hold them are read."""
        if self.bucket is None:
            return self.postings.join(_small(wanted), ["grp", "token"])
        keyed = saved(wanted.withColumn("bucket", self.bucket(F.col("token"))))
        rows = self.postings
        if (few := keyed.select("token").distinct().limit(PUSHED + 1).collect()) and len(few) <= PUSHED:
            rows = rows.where(F.col("token").isin([r["token"] for r in few]))
        # Broadcast buckets prune the partitions of the scan at run time.
        return rows.join(_small(keyed), ["grp", "token", "bucket"]).drop("bucket")


def build_index(docs: DataFrame, fields: dict[str, float], group: Column | None = None, doc_id: str = "doc_id") -> Index:
    """Tokens of all ``fields`` with their weights. tf is the weighted count, length counts every token once.

    Each document is tokenised in one row and exploded; the count per (document, token) combines before its only
    shuffle. An empty or null field adds nothing.
    """
    grp = F.lit(0) if group is None else group

    def weighted(field: str, weight: float) -> Column:
        return F.transform(T.tokens(F.col(field)), lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("w")))

    parts = [weighted(f, w) for f, w in fields.items()]
    rows = docs.select(grp.alias("grp"), F.col(doc_id).alias("doc_id"), F.concat(*parts).alias("words"))
    rows = rows.withColumn("doc_len", F.size("words"))
    counted = rows.select("grp", "doc_id", "doc_len", F.explode("words").alias("x")).groupBy("grp", F.col("x.token").alias("token"), "doc_id").agg(F.sum("x.w").alias("tf"), F.max("doc_len").alias("doc_len"))
    # Written once: every term of every tier reads it again.
    return Index(saved(counted), saved(rows.groupBy("grp").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a side that was counted and is small; leave a larger one to a shuffle join. ``df`` is counted, so it
    should be saved or cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, token): the distinct tokens that start with each distinct term, as an equi-join on their prefixes."""
    heads = vocabulary.select("token").distinct().select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.col("token").substr(F.lit(1), i))).alias("term"))
    return heads.join(terms.select("term").distinct(), "term")


def term_gains(queries: DataFrame, index: Index, terms: str = "terms", prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """(asked, gains): (grp, query_id, term) of all queries, and (grp, term, doc_id, gain) once for each distinct term,
    whatever number of queries has it. Arguments as in bm25."""
    q = queries.select(F.col("grp") if "grp" in queries.columns else F.lit(0).alias("grp"), "query_id", F.explode(F.array_distinct(F.col(terms))).alias("term"))
    wanted = q.select("grp", "term").distinct()
    if prefix:
        known = index.postings.join(_small(q.select(F.substring("term", 1, 1).alias("head")).distinct()), F.substring("token", 1, 1) == F.col("head"), "left_semi")
        wanted = saved(wanted.join(prefix_terms(wanted, known), "term"))
    else:
        wanted = wanted.withColumn("token", F.col("term"))
    found = index.of(wanted)
    per_doc = found.groupBy("grp", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len")) if prefix else found.select("grp", "term", "doc_id", "tf", "doc_len")
    df = per_doc.groupBy("grp", "term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(index.stats) if "grp" not in queries.columns else index.stats, "grp")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = weights.select("grp", "term", "avg_len", idf.alias("idf"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return q, per_doc.join(weights, ["grp", "term"]).withColumn("gain", gain).select("grp", "term", "doc_id", "gain")


def bm25(queries: DataFrame, index: Index, terms: str = "terms", prefix: bool = False) -> DataFrame:
    """(grp, query_id, doc_id, score, matched): negated BM25 of every document that has a term; lower is better.

    ``queries`` has query_id, an array column ``terms`` and, for grouped indexes, grp. With ``prefix`` a term
    stands for all tokens that start with it: its counts are summed per document before scoring. Scores have nine
    decimals, so that equal documents tie whatever order the sums ran in.
    """
    q, gains = term_gains(queries, index, terms, prefix)
    scored = gains.join(_small(q), ["grp", "term"])
    return scored.groupBy("grp", "query_id", "doc_id").agg(F.round(-F.sum("gain"), 9).alias("score"), F.count("*").alias("matched"))


def _lists(q: DataFrame, gains: DataFrame) -> DataFrame:
    """(grp, query_id, term, most, n): each query's terms that occur, with the length and the best gain of their lists."""
    return saved(q.join(gains.groupBy("grp", "term").agg(F.max("gain").alias("most"), F.count("*").alias("n")), ["grp", "term"]))


def _with(pairs: DataFrame, lists: DataFrame, gains: DataFrame) -> DataFrame:
    """(grp, query_id, doc_id, more, found): what the terms of ``lists`` add to the documents of ``pairs``."""
    asked = pairs.select("grp", "query_id", "doc_id").join(lists.select("grp", "query_id", "term"), ["grp", "query_id"])
    return asked.join(gains, ["grp", "term", "doc_id"]).groupBy("grp", "query_id", "doc_id").agg(F.sum("gain").alias("more"), F.count("*").alias("found"))


def bm25_best(queries: DataFrame, index: Index, k: int, terms: str = "terms", prefix: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None, measure: dict[str, int] | None = None) -> DataFrame:
    """The first ``k`` rows of bm25 for each query by score, then doc_id, ranked from 1, without scoring all postings.

    A document's score is at most the sum of the best gains of the terms that it has. The lists of the highest gains name
    promising documents first, whose full scores give a threshold that k documents reach. Terms whose best gains together stay below it cannot lift a
    document to it, so their lists, which are the long ones of common words, bring in no documents; they are only looked
    up for documents that can still reach the threshold with them. Exact: sums are compared with a slack, and the rows
    left are scored in full. ``keep`` filters documents before the limit. ``measure`` gets the counts of scored rows.
    """
    q, gains = term_gains(queries, index, terms, prefix)
    df_gains = saved(gains)
    gains = keep(df_gains) if keep else df_gains
    lists = _lists(q, gains)
    by_query = Window.partitionBy("grp", "query_id")
    down = by_query.orderBy(F.desc("most"), "term")
    before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = saved(lists.withColumn("seed", before < SEEDS * k))
    first = gains.join(_small(marked.where("seed").select("grp", "query_id", "term")), ["grp", "term"]).groupBy("grp", "query_id", "doc_id").agg(F.sum("gain").alias("sure"))
    # The most promising documents are scored in full; the k-th best of them is reached by k documents.
    first = saved(first.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("sure"), "doc_id"))).where(F.col("place") <= PROMISING * k))
    whole = first.join(_with(first, marked.where("not seed"), gains), ["grp", "query_id", "doc_id"], "left").withColumn("sure", F.col("sure") + F.coalesce("more", F.lit(0.0)))
    kth = whole.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("sure"), "doc_id"))).where(F.col("place") <= k).groupBy("grp", "query_id").agg(F.max("place").alias("places"), F.min("sure").alias("least"))
    kth = kth.select("grp", "query_id", F.when(F.col("places") == k, F.col("least")).otherwise(0.0).alias("least"))
    up = by_query.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = lists.join(_small(saved(kth)), ["grp", "query_id"]).withColumn("needed", F.sum("most").over(up) >= F.col("least") - SLACK)
    split = saved(split.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).over(by_query)))
    entering = gains.join(_small(split.where("needed").select("grp", "query_id", "term", "rest", "least")), ["grp", "term"])
    pairs = entering.groupBy("grp", "query_id", "doc_id").agg(F.sum("gain").alias("sure"), F.first("rest").alias("rest"), F.first("least").alias("least"))
    pairs = saved(pairs.where(F.col("sure") + F.col("rest") >= F.col("least") - SLACK).select("grp", "query_id", "doc_id", "sure"))
    rest = split.where("not needed")
    scored = pairs.join(_with(pairs, rest, gains), ["grp", "query_id", "doc_id"], "left").select("grp", "query_id", "doc_id", F.round(-(F.col("sure") + F.coalesce("more", F.lit(0.0))), 9).alias("score"))
    if measure is not None:
        measure["all"] = lists.agg(F.sum("n")).first()[0] or 0
        measure["scored"] = (split.where("needed").agg(F.sum("n")).first()[0] or 0) + _with(pairs, rest, gains).agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    return top_k(scored, k, [F.col("score"), F.col("doc_id")], by=("grp", "query_id"))


def bm25_all(queries: DataFrame, index: Index, terms: str = "terms") -> DataFrame:
    """The rows of bm25 for documents that have all terms of a query: those of its rarest term are looked up in the others'
    lists. Queries with a term that no document has are left out before."""
    q, gains = term_gains(queries, index, terms)
    gains = saved(gains)
    wanted = q.groupBy("grp", "query_id").agg(F.count("*").alias("wanted"))
    by_query = Window.partitionBy("grp", "query_id")
    lists = _lists(q, gains).join(wanted, ["grp", "query_id"]).withColumns({"place": F.row_number().over(by_query.orderBy("n", "term")), "known": F.count("*").over(by_query)})
    lists = saved(lists.where(F.col("known") == F.col("wanted")))
    rarest = lists.where("place = 1").select("grp", "query_id", "term", "wanted")
    pairs = saved(gains.join(_small(rarest), ["grp", "term"]).select("grp", "query_id", "doc_id", "wanted", F.col("gain").alias("sure")))
    full = pairs.join(_with(pairs, lists.where("place > 1"), gains), ["grp", "query_id", "doc_id"], "left").where(F.col("wanted") == 1 + F.coalesce("found", F.lit(0)))
    return full.select("grp", "query_id", "doc_id", F.round(-(F.col("sure") + F.coalesce("more", F.lit(0.0))), 9).alias("score"), F.col("wanted").alias("matched"))


def top_k(scores: DataFrame, k: int, order: list[Column], by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query in a total order, ranked from 1."""
    ranked = scores.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def search(queries: DataFrame, index: Index, k: int = 20, keep: Callable[[DataFrame], DataFrame] | None = None, loose_only: bool = False) -> DataFrame:
    """Tiered search of (query_id, question): all plain words, else content terms, else any word.

    The first tier that returns rows answers, so a tier is only run for the queries that no tier before answered;
    ``keep`` filters documents before the limit.
    """
    left = saved(queries.select(*[c for c in ("grp",) if c in queries.columns], "query_id", T.plain_terms(F.col("question")).alias("plain"), T.content_terms(F.col("question")).alias("content")))
    out = None
    for tier in (3,) if loose_only else (1, 2, 3):
        if tier == 1:
            rows = bm25_all(left, index, "plain").drop("matched")
            rows = top_k(keep(rows) if keep else rows, k, [F.col("score"), F.col("doc_id")], by=("grp", "query_id"))
        else:
            rows = bm25_best(left, index, k, "content" if tier == 2 else "plain", prefix=True, keep=keep)
        found = saved(rows.withColumn("tier", F.lit(tier)))
        out = found if out is None else out.unionByName(found)
        if tier < 3:
            left = saved(left.join(found.select("query_id").distinct(), "query_id", "left_anti"))
            if left.isEmpty():
                break
    return out


#: Fields and weights of pages, claims and skills.
PAGE_FIELDS = {"type": 1.0, "status": 1.0, "tags": 1.0, "body": 1.0, "body_user": 2.0}
CLAIM_FIELDS = {"type": 1.0, "text": 1.0, "detector": 1.0, "status": 1.0}
SKILL_FIELDS = {"scheduling": 3.0, "structural": 1.5, "logical": 1.0}


def search_pages(queries: DataFrame, pages: DataFrame, k: int = 20, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None, windows: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(query_id, doc_id, score, tier, rank) over pages (page_id, the columns of PAGE_FIELDS, epoch_day).

    Type and status filter before the limit. With ``windows`` (query_id, start_day, end_day) max(3k, 30) pages are
    fetched, those inside their query's window move ahead, and k stay. ``index`` may be given where it is kept.
    """
    index = index or build_index(pages, PAGE_FIELDS, doc_id="page_id")
    allowed = pages if types is None else pages.where(F.col("type").isin(list(types)))
    allowed = allowed if statuses is None else allowed.where(F.col("status").isin(list(statuses)))
    ids = None if types is None and statuses is None else saved(allowed.select(F.col("page_id").alias("doc_id")))
    keep = None if ids is None else lambda rows: rows.join(ids, "doc_id", "left_semi")
    if windows is None:
        return search(queries, index, k, keep)
    hits = search(queries, index, max(3 * k, 30), keep)
    moved = promote_in_window(hits, pages.select(F.col("page_id").alias("doc_id"), "epoch_day"), windows)
    return moved.where(F.col("rank") <= k)


def search_claims(queries: DataFrame, claims: DataFrame, k: int = 20) -> DataFrame:
    """As search_pages, over claims (claim_id and the columns of CLAIM_FIELDS)."""
    return search(queries, build_index(claims, CLAIM_FIELDS, doc_id="claim_id"), k)


def search_skills(queries: DataFrame, skills: DataFrame, k: int = 20) -> DataFrame:
    """As search_pages, over skills (slug and the columns of SKILL_FIELDS), by any word at once."""
    return search(queries, build_index(skills, SKILL_FIELDS, doc_id="slug"), k, loose_only=True)


#: Vectors that a task holds as one matrix, about, and queries that meet it at once.
CHUNK = 8192
BLOCK = 512


def rank_by_vector(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine above 0, best first, ids break ties. Vectors of equal length only.

    Queries are a stated set. Vectors are dealt into chunks, and blocks of queries go to every chunk, where they meet
    in one matrix product; each chunk keeps k rows of a query.
    """
    stored = vectors.select("doc_id", "vec").where("vec is not null and size(vec) > 0").withColumn("dims", F.size("vec"))
    asked = queries.select("query_id", "vec").where("vec is not null and size(vec) > 0").withColumn("dims", F.size("vec"))
    stored = saved(stored)
    chunks, blocks = max(1, -(-stored.count() // CHUNK)), max(1, -(-asked.count() // BLOCK))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks))
    groups = asked.groupBy("dims", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "vec")).alias("asked"))
    sent = groups.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "block", "asked")
    held = stored.select("dims", chunk.alias("chunk"), "doc_id", "vec")
    dealt = held.unionByName(sent, allowMissingColumns=True).repartition(chunks, "dims", "chunk").sortWithinPartitions("dims", "chunk", F.col("block").asc_nulls_first())
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, rows, matrix, length = None, [], [], None, None
        for batch in batches:
            for dims, chunk, doc_id, vec, queries in zip(batch["dims"], batch["chunk"], batch["doc_id"], batch["vec"], batch["asked"], strict=True):
                if (dims, chunk) != now:
                    now, ids, rows, matrix = (dims, chunk), [], [], None
                if queries is None:
                    ids.append(doc_id)
                    rows.append(vec)
                    continue
                if not rows:
                    continue
                if matrix is None:
                    matrix = np.stack(rows).astype(np.float64)
                    length, names = np.linalg.norm(matrix, axis=1), np.array(ids)
                q = np.array([r["vec"] for r in queries], dtype=np.float64)
                norms = np.linalg.norm(q, axis=1)[:, None] * length[None, :]
                # Twelve decimals, so that equal vectors tie wherever they stand in a matrix.
                cos = np.round(np.divide(q @ matrix.T, norms, out=np.zeros_like(norms), where=norms > 0), 12)
                out = []
                for r, scores in zip(queries, cos, strict=True):
                    # All that tie with the k-th stay until they are ordered by id.
                    least = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
                    some = np.flatnonzero((scores >= least) & (scores > 0))
                    best = some[np.lexsort((names[some], -scores[some]))[:k]]
                    if len(best):
                        out.append(pd.DataFrame({"query_id": pd.Series([r["query_id"]] * len(best), dtype=object), "doc_id": pd.Series(names[best].tolist(), dtype=object), "score": scores[best]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    found = dealt.select("dims", "chunk", "doc_id", "vec", "asked").mapInPandas(ranked, schema)
    return top_k(found, k, [F.desc("score"), F.col("doc_id")])


def fuse_rrf(text: DataFrame, vector: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank): the sum of 1 / (60 + rank), ids break ties."""
    both = text.select("query_id", "doc_id", "rank").unionByName(vector.select("query_id", "doc_id", "rank"))
    scored = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def fuse_rescue(text: DataFrame, vector: DataFrame) -> DataFrame:
    """Text order first, then what only the vectors found: 1/(60+i), then 1/(60+n+1+i) with i from the vector list."""
    sizes = text.groupBy("query_id").agg(F.max("rank").alias("n"))
    head = text.select("query_id", "doc_id", F.col("rank").alias("place"), (1.0 / (RRF + F.col("rank"))).alias("score"))
    tail = vector.join(text, ["query_id", "doc_id"], "left_anti").join(sizes, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail = tail.select("query_id", "doc_id", (F.col("n") + F.col("rank")).alias("place"), (1.0 / (RRF + F.col("n") + 1 + F.col("rank"))).alias("score"))
    return head.unionByName(tail).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id"))).drop("place")


def fuse_rerank(text: DataFrame, vector: DataFrame, pin: int = 3) -> DataFrame:
    """The first ``pin`` of the text list stay; its rest is ordered by both ranks; vector-only rows come last."""
    both = text.select("query_id", "doc_id", F.col("rank").alias("t")).join(vector.select("query_id", "doc_id", F.col("rank").alias("v")), ["query_id", "doc_id"], "full")
    rrf = F.coalesce(1.0 / (RRF + F.col("t")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("v")), F.lit(0.0))
    part = F.when(F.col("t") <= pin, 0).when(F.col("t").isNotNull(), 1).otherwise(2)
    key = F.when(F.col("t") <= pin, -F.col("t").cast("double")).otherwise(rrf)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(part, key.desc(), "doc_id")))
    return ranked.select("query_id", "doc_id", (1.0 / (RRF + F.col("rank"))).alias("score"), "rank")


FUSIONS = {"rescue": fuse_rescue, "rerank": fuse_rerank, "rrf": fuse_rrf}


def promote_in_window(hits: DataFrame, days: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits whose document's day is in the query's window move ahead, both parts in their order.

    ``days`` has (doc_id, epoch_day), ``windows`` (query_id, start_day, end_day). Without a window, or without
    a hit inside it, the order stays.
    """
    dated = hits.join(windows, "query_id", "left").join(days, "doc_id", "left")
    inside = F.coalesce(F.col("epoch_day").between(F.col("start_day"), F.col("end_day")), F.lit(False)).cast("int")
    order = Window.partitionBy("query_id").orderBy(inside.desc(), "rank")
    return dated.withColumn("new_rank", F.row_number().over(order)).select(*[c for c in hits.columns if c != "rank"], F.col("new_rank").alias("rank"))


def search_hybrid(queries: DataFrame, index: Index, vectors: DataFrame | None, k: int = 20, fusion: str = "rescue", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Text and vector search (queries with ``vec``), fused; max(3k, 30) candidates of each; text only without vectors."""
    wide = max(3 * k, 30)
    text = search(queries, index, wide, keep)
    if vectors is None:
        return text.where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    vector = rank_by_vector(queries, vectors, wide)
    fused = FUSIONS[fusion](text, vector)
    if keep:
        fused = keep(fused)
    return top_k(fused.drop("rank"), k, [F.desc("score"), F.col("doc_id")])


def prf_terms(feedback: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, terms) from (query_id, question, text): the most frequent terms of the texts that are not in the
    question, of four characters or more, no number and no stopword; equal counts by term."""
    words = feedback.select("query_id", "question", F.explode(T.tokens(F.col("text"))).alias("term"))
    kept = words.where((F.length("term") >= 4) & ~F.col("term").isin(T.FEEDBACK_STOPWORDS) & ~F.col("term").rlike("^[0-9]+$") & ~F.array_contains(T.tokens(F.col("question")), F.col("term")))
    counts = kept.groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    best = top_k(counts, n, [F.desc("tf"), F.col("term")])
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def prf_search(queries: DataFrame, docs: DataFrame, index: Index, vectors: DataFrame | None, k: int = 10, fusion: str = "rerank", pin: int = 3, feedback: int = 3) -> DataFrame:
    """Search, widen the question by terms of the first results, search again; the first ``pin`` stay, the rest is
    ordered by reciprocal ranks in both lists. ``docs`` has (doc_id, text)."""
    first = saved(search_hybrid(queries, index, vectors, max(3 * k, 30), fusion))
    seen = first.where(F.col("rank") <= feedback).join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "question"), "query_id")
    more = prf_terms(seen).select("query_id", F.array_join("terms", " ").alias("more"))
    wider = saved(queries.join(more, "query_id", "left").withColumn("question", F.concat_ws(" ", "question", "more")).drop("more"))
    second = search_hybrid(wider, index, vectors, max(3 * k, 30), fusion)
    both = fuse_rrf(first, second).select("query_id", "doc_id", "score")
    joined = both.join(first.where(F.col("rank") <= pin).select("query_id", "doc_id", F.col("rank").alias("pinned")), ["query_id", "doc_id"], "left")
    order = [F.col("pinned").asc_nulls_last(), F.desc("score"), F.col("doc_id")]
    return top_k(joined, k, order).select("query_id", "doc_id", "score", "rank")


def ground_bundle(hits: DataFrame, pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with their page's claim ids and a snippet, and the tokens of each bundle as a share of the corpus.

    ``pages`` has (doc_id, body), ``queries`` (query_id, question).
    """
    corpus = pages.agg(F.sum(T.estimate_tokens(F.col("body"))).alias("corpus_tokens"))
    rows = hits.join(pages.select("doc_id", "body"), "doc_id").join(queries.select("query_id", T.content_terms(F.col("question")).alias("terms")), "query_id")
    rows = rows.withColumn("snippet", T.snippet(F.col("body"), F.col("terms"))).withColumn("claim_ids", T.claim_ids(F.col("body")))
    bundle = F.sum(T.estimate_tokens(F.col("snippet"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("bundle_tokens", bundle).crossJoin(F.broadcast(corpus)).withColumn("share", F.col("bundle_tokens") / F.col("corpus_tokens")).drop("body", "terms")


def turns_to_sessions(hits: DataFrame, depth: int = 10) -> DataFrame:
    """Ranked turns (query_id, session_id, rank) to ranked sessions by their best turn."""
    best = hits.groupBy("query_id", "session_id").agg(F.min("rank").alias("best"))
    return top_k(best, depth, [F.col("best"), F.col("session_id")]).drop("best")


def rank_external(requests: DataFrame, ranker: Callable[[str, list[tuple[str, str]]], list[str]], depth: int = 10) -> DataFrame:
    """(query_id, session_id, rank, error) from a user's ranker over (query_id, question, session_id, text) rows.

    An exception or an answer that is no list of strings gives no rows and one error row (rank 0); ids that are not
    in the request are dropped. A request's sessions are one group, as the ranker needs them together.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group["query_id"].iloc[0]
        try:
            answer = ranker(group["question"].iloc[0], sorted(zip(group["session_id"], group["text"], strict=True)))
            if not isinstance(answer, list) or not all(isinstance(x, str) for x in answer):
                raise TypeError("not a list of ids")
        except Exception as e:  # a user's code may raise anything
            return pd.DataFrame({"query_id": [own], "session_id": [None], "rank": [0], "error": [f"{type(e).__name__}: {e}"]})
        known = set(group["session_id"])
        ids = list(dict.fromkeys(x for x in answer if x in known))[:depth]
        return pd.DataFrame({"query_id": [own] * len(ids), "session_id": ids, "rank": range(1, len(ids) + 1), "error": [None] * len(ids)})

    kind = requests.schema["query_id"].dataType.simpleString()
    return requests.groupBy("query_id").applyInPandas(run, f"query_id {kind}, session_id string, rank int, error string")
