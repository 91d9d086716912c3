"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard of vectors.

Greedy searches from the medoid propose neighbours of each new point; relaxed distance pruning keeps a few
diverse edges of bounded number, with their reverse edges; beam search then answers the queries. Places that pruning
leaves free go to the nearest of the pruned: in a large group of near copies a few points prune all the others, which
hardly any edge would lead to. Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2).
A query has 0 there, so each new point is also searched for as a query is: without those neighbours recall on
unclustered vectors falls to a half. Every shard measures its recall on a few probes and takes the smallest beam that
reaches a target; where none of bounded width does, all its vectors are compared. All steps work on many points at
once, on vectors scaled to length 1 at most; scores are taken from the original vectors in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Components of a shard's vectors, about (16,384 vectors of 64): bounds a shard's memory and its building time.
SHARD_FLOATS = 1 << 20
#: Edges of a point; beam while building; least and largest beam while searching. Over 10,256 vectors of 64, 256 queries
#: took about 2, 6 and 18 s with beams of 256, 512 and 1,024 (five runs side by side), and 1 s against all vectors.
DEGREE = 48
BUILD_BEAM = 64
SEARCH_BEAM = 64
LARGEST_BEAM = 256
#: A candidate goes if a kept neighbour is nearer to it by this factor than the owner is. At 1.2 hardly any of 32
#: neighbours went on Gaussian vectors of 64 dimensions, and recall was 0.53 instead of 0.83.
ALPHA = 1.05
#: Recall that a shard's beam has to reach on its probes, and how many probes there are at most.
TARGET = 0.97
PROBES = 64
#: Points inserted, and queries searched, at once.
BATCH = 256
#: Queries in a block, about, and blocks that one copy of a shard answers.
BLOCK = 1024
BLOCKS_A_COPY = 64
SEED = 3


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` best points met from ``entry``, for each query; -1 and inf fill up."""
    m, n = len(queries), len(points)
    norms = np.einsum("ij,ij->i", points, points)
    ids = np.full((m, beam), -1, dtype=np.int64)
    far = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    seen = np.zeros((m, n), dtype=bool)
    seen[:, entry] = True
    ids[:, 0], done[:, 0] = entry, False
    far[:, 0] = norms[entry] - 2 * queries @ points[entry]
    rows = np.arange(m)
    while len(rows):
        open_ = ~done[rows]
        active = open_.any(axis=1)
        rows = rows[active]
        if not len(rows):
            break
        at = open_[active].argmax(axis=1)  # beams are sorted: the first open one is the nearest
        done[rows, at] = True
        near = graph[ids[rows, at]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(fresh, near, entry)] = True
        d = norms[near] - 2 * np.einsum("ij,ikj->ik", queries[rows], points[near])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([far[rows], d], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        part = np.take_along_axis(all_d, order, axis=1)
        inner = np.argsort(part, axis=1, kind="stable")
        order = np.take_along_axis(order, inner, axis=1)
        far[rows] = np.take_along_axis(part, inner, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), order, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), order, axis=1) | ~np.isfinite(far[rows])
    return np.where(np.isfinite(far), ids, -1), far


def robust_prune(points: np.ndarray, owners: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of the candidates ``near`` (-1: none) of each owner: nearest first, dropping those that a
    kept one is nearer to than the owner by the factor ``alpha``; then the nearest of those dropped, as far as there
    is room."""
    cand = points[near]
    size = np.einsum("ijk,ijk->ij", cand, cand)
    between = size[:, :, None] + size[:, None, :] - 2 * (cand @ cand.transpose(0, 2, 1))
    mine = points[owners]
    d = np.einsum("ij,ij->i", mine, mine)[:, None] + size - 2 * np.einsum("ij,ikj->ik", mine, cand)
    alive = (near >= 0) & (near != owners[:, None])
    # The same candidate twice: the first stays.
    order = np.argsort(np.where(alive, near, np.iinfo(np.int64).max), axis=1, kind="stable")
    sorted_near = np.take_along_axis(near, order, axis=1)
    twice = np.zeros_like(alive)
    twice[:, 1:] = sorted_near[:, 1:] == sorted_near[:, :-1]
    again = np.zeros_like(alive)
    np.put_along_axis(again, order, twice, axis=1)
    d = np.where(alive & ~again, np.maximum(d, 0), np.inf)
    place = d.copy()  # kept ones before all others, which go by distance
    rows = np.arange(len(owners))
    for k in range(degree):
        pick = d.argmin(axis=1)
        good = np.isfinite(d[rows, pick])
        if not good.any():
            break
        place[rows[good], pick[good]] = k - degree
        d = np.where(good[:, None] & (alpha * alpha * between[rows, pick] <= d), np.inf, d)
        d[rows, pick] = np.inf
    order = np.argsort(place, axis=1, kind="stable")[:, :degree]
    out = np.full((len(owners), degree), -1, dtype=np.int64)
    out[:, : order.shape[1]] = np.where(np.isfinite(np.take_along_axis(place, order, axis=1)), np.take_along_axis(near, order, axis=1), -1)
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, int]:
    """(graph, entry): ``degree`` edges of each point (-1: none) and the medoid. The last coordinate is the added one."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, dtype=np.int64)
    asking = points.copy()
    asking[:, -1] = 0
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        graph[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    for rows in np.array_split(rng.permutation(n), max(1, -(-n // BATCH))):
        found = [beam_search(points, graph, entry, x[rows], min(beam, n))[0] for x in (points, asking)]
        graph[rows] = robust_prune(points, rows, np.concatenate([*found, graph[rows]], axis=1), degree, alpha)
        # Reverse edges, grouped by the point that gets them; full lists are pruned again.
        source, target = np.repeat(rows, degree), graph[rows].ravel()
        source, target = source[target >= 0], target[target >= 0]
        owners, place, counts = np.unique(target, return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(counts, kind="stable"))  # owners by how many they get: chunks of like width
        order = np.argsort(rank[place], kind="stable")
        source, place = source[order], rank[place][order]
        owners, counts = owners[np.argsort(rank)], np.sort(counts)
        first = np.cumsum(counts) - counts
        for s in range(0, len(owners), BATCH):
            some, many = owners[s : s + BATCH], counts[s : s + BATCH]
            more = np.full((len(some), many[-1]), -1, dtype=np.int64)
            edges = slice(first[s], first[s] + many.sum())
            more[place[edges] - s, np.arange(edges.start, edges.stop) - first[place[edges]]] = source[edges]
            used = int((graph[some] >= 0).sum(axis=1).max())
            graph[some] = robust_prune(points, some, np.concatenate([graph[some][:, :used], more], axis=1), degree, alpha)
    return graph, entry


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by one common factor (the largest length), which changes no order and keeps squares finite."""
    top = np.abs(vectors).max()
    part = vectors / top
    return part / np.sqrt(np.einsum("ij,ij->i", part, part).max())


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 at most with the coordinate that makes them that long."""
    part = scaled(vectors)
    return np.column_stack([part, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", part, part), 0))]).astype(np.float32)


def asked_points(vectors: np.ndarray) -> np.ndarray:
    """Queries, each scaled on its own, with 0 as the added coordinate."""
    part = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.column_stack([part, np.zeros(len(part))]).astype(np.float32)


def beam_for(points: np.ndarray, graph: np.ndarray, entry: int, probes: np.ndarray, k: int, beam: int, target: float = TARGET, largest: int = LARGEST_BEAM) -> int:
    """The smallest of beam, 2 beam, 4 beam, ... with which the probes find ``target`` of their true ``k`` nearest; the
    number of points, which asks for all of them, if none up to ``largest`` does."""
    asked, n = asked_points(probes), len(points)
    true = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :k]
    largest = max(largest, beam)
    while beam < n and beam <= largest:
        found, _ = beam_search(points, graph, entry, asked, beam)
        if np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) >= target:
            return beam
        beam *= 2
    return n


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def vector_classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, members): distinct vectors with their ``keep`` smallest ids. No more of a class can be among a
    query's nearest, as equal scores go by id."""
    spread = Window.partitionBy("vector").orderBy("vec_id")
    # Copies are cut to ``keep`` for each part first, so one common vector is never gathered.
    parted = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = parted.withColumn("rank", F.row_number().over(Window.partitionBy("vector", "part").orderBy("vec_id"))).where(F.col("rank") <= keep)
    least = some.withColumn("rank", F.row_number().over(spread)).where(F.col("rank") <= keep)
    return least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def build_index(vectors: DataFrame, k: int, probes: dict[int, np.ndarray], shard: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """(shard, dims, shards, index): every usable distinct vector in exactly one shard's graph. ``probes`` holds a few
    queries by their number of dimensions; a shard without any probes with its own first points. A shard has about
    ``shard`` vectors, or SHARD_FLOATS components."""
    classes = materialise(vector_classes(vectors, k + 1).withColumn("dims", F.size("vector")), "vectors")
    # One row for each length of vector.
    sizes = classes.groupBy("dims").agg(F.ceil(F.count("*") / (F.lit(shard) if shard else F.greatest(F.lit(SHARD_FLOATS) / F.col("dims"), F.lit(1)))).alias("shards"))
    total = sizes.agg(F.sum("shards")).first()[0] or 1

    def build(group: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(group["vector"].to_numpy()).astype(np.float64)
        dims, shards = int(group["dims"].iloc[0]), group["shards"].iloc[0]
        points = lifted(exact)
        graph, entry = build_graph(points)
        wide = beam_for(points, graph, entry, probes.get(dims, exact[:PROBES]), k + 1, max(beam, k + 1))
        members = np.full((len(group), k + 1), -1, dtype=np.int64)
        for i, ids in enumerate(group["members"]):
            members[i, : len(ids)] = ids
        blob = _pack(points=points, exact=exact, graph=graph.astype(np.int32), start=np.array([entry, wide]), members=members)
        return pd.DataFrame({"shard": group["shard"][:1], "dims": [dims], "shards": [shards], "index": [blob]})

    placed = classes.join(F.broadcast(sizes), "dims").withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]), F.col("shards")))
    return placed.repartition(int(total), "dims", "shard").groupBy("dims", "shard").applyInPandas(build, "shard long, dims int, shards long, index binary")


def best_in_shard(index: dict[str, np.ndarray], ids: np.ndarray, asked: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the ``k`` best of one shard for each query; a shard no larger than its beam is
    searched whole."""
    points, exact, members = index["points"], index["exact"], index["members"]
    entry, beam = index["start"].tolist()
    out = []
    for s in range(0, len(ids), BATCH):
        part = asked[s : s + BATCH]
        if beam >= len(points):
            found = np.broadcast_to(np.arange(len(points)), (len(part), len(points)))
        else:
            found, _ = beam_search(points, index["graph"], entry, asked_points(part), beam)
        for own, vector, hits in zip(ids[s : s + BATCH], part, found, strict=True):
            hits = hits[hits >= 0]
            scores = exact[hits] @ vector
            every = members[hits]
            valid = (every >= 0) & (every != own)
            flat, value = every[valid], np.broadcast_to(scores[:, None], every.shape)[valid]
            best = np.lexsort((flat, -value))[:k]
            out.append((np.full(len(best), own), flat[best], value[best]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row.

    Both tables have (vec_id, embedding). Vectors that are null, empty, zero or hold null or non-finite
    components take no part on either side, and only vectors of equal length are compared. A query never finds
    its own id; of rows that repeat a query's id the least vector asks. Equal vectors are indexed once and all answer;
    ties go to the smaller id; fewer than k candidates give all of them; repeated rows count once, and an id with
    several vectors answers with its best. Other columns are not read.

    Blocks of queries go to the shards, not shards to the queries: a copy of a shard answers BLOCKS_A_COPY blocks.
    """
    named = [d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull()) for d in (queries, vectors)]
    asked = named[0].groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    asked = materialise(asked, "asked")
    probes: dict[int, list] = {}
    for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect():
        probes.setdefault(r["dims"], []).append(r["vector"])
    index = materialise(build_index(named[1].distinct(), k, {d: np.array(v, dtype=np.float64) for d, v in probes.items()}, shard, beam), "graphs")
    blocks = max(1, -(-asked.count() // BLOCK))
    copies = -(-blocks // BLOCKS_A_COPY)
    grouped = asked.groupBy("dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    shards = index.groupBy("dims").agg(F.max("shards").alias("shards"))  # one row for each length of vector
    sent = grouped.join(F.broadcast(shards), "dims").select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.col("block").alias("at"), F.lit(None).cast("binary").alias("index"), "queries")
    sent = sent.withColumn("copy", F.col("at") % copies)
    held = index.select("dims", "shard", F.lit(-1).cast("long").alias("at"), "index", F.lit(None).cast(grouped.schema["queries"].dataType).alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
    work = held.unionByName(sent).repartition(int(index.count() or 1) * copies, "dims", "shard", "copy").sortWithinPartitions("dims", "shard", "copy", "at")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, loaded = None, None
        for batch in batches:
            for dims, shard, copy, blob, rows in zip(batch["dims"], batch["shard"], batch["copy"], batch["index"], batch["queries"], strict=True):
                if blob is not None:
                    with np.load(io.BytesIO(blob)) as stored:
                        now, loaded = (dims, shard, copy), {name: stored[name] for name in stored.files}
                    loaded["graph"] = loaded["graph"].astype(np.int64)
                elif now == (dims, shard, copy):  # else the shard has no vectors
                    ids = np.array([r["vec_id"] for r in rows])
                    yield best_in_shard(loaded, ids, np.stack([np.asarray(r["vector"], dtype=np.float64) for r in rows]), k)

    found = work.select("dims", "shard", "copy", "index", "queries").mapInPandas(search, "query_id long, vec_id long, score double")
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
