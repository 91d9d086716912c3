"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into segments on a ring. By the pigeonring principle two fingerprints within the limit have a
segment from which on every chain of l consecutive segments differs in at most l * limit / segments bits. Short
chains have no budget for a difference, so they are the join key; longer chains prune before the full Hamming check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_spread, materialise

WORDS = 3
BITS = 2
SEED = 42
#: Segments of a chain that has no budget for a difference: the join key.
KEY_SEGMENTS = 4
#: Fingerprints of one key that are compared in pairs; larger buckets go another, exact way.
PAIRED = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; the whole sequence if it is shorter."""
    # bytes.lower() and bytes.split() know ASCII only, as the definition of a word asks.
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), dtype=np.uint64, count=len(parts) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where more than half of the hashes have it; as a signed long."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a long."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [fingerprint(shingle_hashes(t, words)) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(hashed, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(offset, width) of ``count`` segments of 64 bits, as even as can be."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(fp: Column, offset: int, width: int) -> Column:
    """``width`` bits from ``offset`` on, round the ring of 64."""
    turned = F.shiftrightunsigned(fp, offset).bitwiseOR(F.shiftleft(fp, 64 - offset)) if offset else fp
    return turned.bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fp: Column, limit: int) -> Column:
    """For each segment the bits of the chain of KEY_SEGMENTS segments that starts there."""
    parts = segments(KEY_SEGMENTS * limit + 1)
    width = lambda s: sum(parts[(s + l) % len(parts)][1] for l in range(KEY_SEGMENTS))
    return F.array(*(_bits(fp, offset, width(s)) for s, (offset, _) in enumerate(parts)))


def chain_condition(differing: Column, start: int, limit: int) -> Column:
    """Whether every chain of segments from ``start`` on stays within its share of ``limit``.

    Differences only add up, so of all chains with one budget the longest decides. The chains without a budget are
    the key, the whole ring is the Hamming check.
    """
    parts = segments(KEY_SEGMENTS * limit + 1)
    longest = {l * limit // len(parts): l for l in range(1, len(parts))}
    width = {b: sum(parts[(start + i) % len(parts)][1] for i in range(l)) for b, l in longest.items() if b}
    return reduce(Column.__and__, (F.bit_count(_bits(differing, parts[start][0], w)) <= b for b, w in width.items()))


def linked(fps: DataFrame, limit: int = BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose components are those of all links.

    Of KEY_SEGMENTS * limit + 1 segments on a ring, two fingerprints within the limit have one from which on every
    chain of l segments differs in at most l * limit / segments bits. Chains of up to KEY_SEGMENTS have no budget for
    a difference, so their bits (28 of 64 for a limit of 2) are the join key; the longer chains prune before the full
    Hamming check. As many bits keep buckets small for hundreds of millions of fingerprints; those that near copies
    crowd (over PAIRED members) are joined through the points within half the limit of each member: two fingerprints
    share such a point exactly if they are within the limit, so an edge to the least fingerprint at each point loses
    no link and makes no false one, and work is linear.
    """
    if limit not in (2, 4):
        raise ValueError("the limit has to be 2 or 4 bits")
    keyed = fps.select("fp", F.posexplode(chain_keys(F.col("fp"), limit)).alias("i", "chain"))
    sizes = keyed.groupBy("i", "chain").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, ["i", "chain"]), "chains")
    cold = shared.where(F.col("n") <= PAIRED).drop("n")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    chains = reduce(lambda rest, s: F.when(F.col("i") == s, chain_condition(differing, s, limit)).otherwise(rest), range(KEY_SEGMENTS * limit + 1), F.lit(False))
    left, right = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    pairs = left.join(right, ["i", "chain"]).where((F.col("a") < F.col("b")) & chains & (F.bit_count(differing) <= limit)).select("a", "b")
    crowded = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    masks = [sum(1 << b for b in bits) for r in range(limit // 2 + 1) for bits in combinations(range(64), r)]
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    points = crowded.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least doc_id reachable over links of at most ``limit`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows are returned each; a
    null doc_id keeps its row and never names a component. Only doc_id and text are read. Equal fingerprints
    are collapsed (combined before the shuffle) before any pair is looked at.
    """
    rows = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = connected_components(linked(distinct.select("fp"), limit))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return join_spread(rows, named.select("fp", "group").join(ids, "group").drop("group"), "fp")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Sizes of the sketch that near_duplicate_groups completes SimHash with: least hashes kept, and those used as keys.
SKETCH = 128
KEYS = 16
#: Estimates from cut sketches between these distances below and above the limit are counted on the whole sets. A
#: standard error at a similarity of 0.8 is 0.035, so they are eight and four of them.
BELOW, ABOVE = 0.3, 0.15
#: Counters by which the shingles of texts in crowded hashes are put in order, the rare ones first.
COUNTERS = 1 << 20
#: Ids of texts up to which they are broadcast.
BROADCAST_IDS = 500_000
#: Partners of a text that are compared with one copy of it, about, where it has very many.
PARTNERS = 64
#: Stands for a missing doc_id where a text is read again; it is found by its hash too.
NO_ID = -1


def _read_by(docs: DataFrame) -> DataFrame:
    """(id, h, text): what a text is read again by; doc_id alone may be repeated or missing."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, id, h, fp, size, sketch): fingerprint, count and SKETCH least of the distinct shingle hashes, in order."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch["text"]]
            fps = [fingerprint(h) for h in hashes]
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            yield batch[["id", "h"]].assign(fp=fps, size=[len(x) for x in sets], sketch=[x[:SKETCH] for x in sets])

    made = _read_by(docs).mapInPandas(hashed, "id long, h long, fp long, size int, sketch array<long>")
    return made.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "*")


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard similarity from two sketches: exact if neither was cut, else over the SKETCH least of the union."""
    both = F.array_sort(F.array_union(a, b))
    least = F.when((F.size(a) < SKETCH) & (F.size(b) < SKETCH), both).otherwise(F.slice(both, 1, SKETCH))
    return F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.greatest(F.size(least), F.lit(1))


def whole_sets(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the members (node, id, h): all distinct shingle hashes of each text. Only these texts move."""
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["node"]].assign(hashes=[np.unique(shingle_hashes(t, words).view(np.int64)) for t in batch["text"]])

    texts = _read_by(docs).join(members, ["id", "h"]).select("node", "text")
    return materialise(texts.mapInPandas(hashed, "node long, hashes array<long>"), "sets")


def alike_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike.

    Each ``b`` goes with its partners to one task, which holds it while they pass; a ``b`` with more than a thousandth
    of all pairs (at most a thousand have) is copied once for about PARTNERS of them.
    """
    pairs = materialise(pairs, "compared")
    total = pairs.count()
    many = pairs.groupBy("b").agg(F.count("*").alias("n")).where((F.col("n") > PARTNERS) & (F.col("n") * 1000 > total))
    units = pairs.join(F.broadcast(many), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.coalesce("n", F.lit(1)) / PARTNERS)).alias("part"))
    held = units.select("b", "part").distinct().join(sets.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "hashes")
    partners = units.join(sets.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "hashes")
    dealt = held.unionByName(partners).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.empty(0, dtype=np.int64)
        for batch in batches:
            good = []
            for a, b, hashes in zip(batch["a"], batch["b"], batch["hashes"], strict=True):
                if pd.isna(a):
                    mine = np.asarray(hashes, dtype=np.int64)
                    continue
                at = np.searchsorted(mine, hashes)
                common = np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == hashes) if len(mine) else 0
                if common >= similarity * (len(mine) + len(hashes) - common):
                    good.append((int(a), b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return dealt.select("a", "b", "hashes").mapInPandas(check, "a long, b long").distinct()


def alike_pairs(candidates: DataFrame, texts: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) that are alike: by their sketches where these decide, else by whole shingle sets."""
    sides = [texts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    both = join_spread(candidates, sides[1], "b").join(sides[0], "a").where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6)
    cut = (F.size("sketch_a") == SKETCH) | (F.size("sketch_b") == SKETCH)
    estimated = both.select("a", "b", resemblance(F.col("sketch_a"), F.col("sketch_b")).alias("alike"), cut.alias("cut"))
    estimated = materialise(estimated.where(F.col("alike") >= F.when(F.col("cut"), similarity - BELOW).otherwise(similarity)), "estimated")
    close = F.col("cut") & (F.col("alike") < similarity + ABOVE)
    sure, unsure = estimated.where(~close).select("a", "b"), estimated.where(close).select("a", "b")
    named = unsure.select(F.col("a").alias("node")).unionByName(unsure.select(F.col("b").alias("node"))).distinct()
    sets = whole_sets(texts.join(named, "node", "left_semi").select("node", "id", "h"), docs, words)
    return materialise(sure.unionByName(alike_sets(unsure, sets, similarity)), "alike")


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def hash_counts(sets: DataFrame, column: str) -> Broadcast:
    """How many sets (arrays in ``column``) have a hash of each counter: at most COUNTERS numbers, whatever the input."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for hashes in batch["hashes"]:
                np.add.at(total, _counter(np.asarray(hashes, dtype=np.int64)), 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"counter": used, "n": total[used]})

    counts = sets.select(F.col(column).alias("hashes")).mapInPandas(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(COUNTERS, dtype=np.int64)
    totals[counts["counter"].to_numpy()] = counts["n"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(totals)


def commonness(texts: DataFrame) -> DataFrame:
    """(node, weight): the mean logarithm of how many of ``texts`` share each hash of a sketch. What copies have in
    common is in their original whole, so it has the greatest weight of its group."""
    shared = hash_counts(texts, "sketch")

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = [float(np.log(shared.value[_counter(np.asarray(x, dtype=np.int64))]).mean()) for x in batch["sketch"]]
            yield batch[["node"]].assign(weight=np.round(weights, 9))

    return texts.select("node", "sketch").mapInPandas(weighed, "node long, weight double")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, size, keys): the rarest hashes of each set, of which two alike sets share at least one.

    Any order that is one for all sets loses no pair, so counters that several hashes share may give it: alike sets
    have at least ``similarity`` of each in common, and the first common one is no later than the last key.
    """
    shared = hash_counts(sets, "hashes")

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys = [], []
            for hashes in batch["hashes"]:
                hashes = np.asarray(hashes, dtype=np.int64)
                sizes.append(len(hashes))
                order = np.lexsort((hashes, shared.value[_counter(hashes)]))
                keys.append(hashes[order[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]])
            yield batch[["node"]].assign(size=sizes, keys=keys)

    return sets.mapInPandas(rarest, "node long, size int, keys array<long>")


def cross_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (key, place, size, node, component) with one key and different components.

    Keys whose members are of one component make none. Of others, the members outside the key's largest component
    meet all members: what is linked already is never paired again, and no pair between components is left out.
    Hashes before the first common one of two sets are not shared, so ``place`` and ``size`` rule out pairs whose
    rest is too short for ``similarity``; alike sets pass at their first common key.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    bodies = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("body"), F.count("*").alias("components")).where("components > 1")
    open_ = materialise(members.join(bodies.drop("components"), "key"), "open")
    a = open_.where("component <> body").select("key", *(F.col(c).alias(f"{c}_a") for c in ("place", "size", "node", "component")))
    b = open_.select(F.col("key").alias("key_b"), *(F.col(c).alias(f"{c}_b") for c in ("place", "size", "node", "component")))
    needed = (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6
    fits = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= needed
    pairs = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("component_a") != F.col("component_b")) & fits)
    return pairs.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def grouped(docs: DataFrame, words: int, similarity: float, limit: int) -> DataFrame:
    """(doc_id, id, h, node) of every row: ``node`` names its group. See near_duplicate_groups."""
    made = sketches(docs, words).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(made.withColumn("same", F.concat_ws(":", "fp", F.xxhash64("sketch"))), "sketches")
    # Equal texts are one node from here on, named by one of their rows.
    one = F.min(F.struct("row", "id", "h")).alias("one")
    texts = materialise(rows.groupBy("same").agg(one, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch")).select("same", F.col("one.row").alias("node"), "one.id", "one.h", "fp", "size", "sketch"), "texts")
    distinct = materialise(texts.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    ends = linked(distinct.select("fp"), limit).join(distinct.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same_fp = join_spread(texts.select("node", "fp"), distinct, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close_bits = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).unionByName(same_fp)
    keys = texts.select("node", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, "key"), "keys")
    cold = shared.where(F.col("n") <= PAIRED)
    pairs = cold.select("key", F.col("node").alias("a")).join(cold.select("key", F.col("node").alias("b")), "key").where("a > b").select("a", "b")
    crowded = shared.where(F.col("n") > PAIRED).select("key", "node")
    weights = commonness(materialise(texts.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "common"))
    crowded = materialise(crowded.join(weights, "node"), "crowded")
    pivots = crowded.groupBy("key").agg(F.max_by("node", F.struct("weight", F.negative("node"))).alias("b"))
    stars = join_spread(crowded.select("key", F.col("node").alias("a")), pivots, "key").where("a <> b").select("a", "b")
    candidates = materialise(close_bits.unionByName(pairs).unionByName(stars).distinct(), "candidates")
    alike = alike_pairs(candidates, texts, docs, words, similarity)
    merged = connected_components(alike)

    def placed(members: DataFrame) -> DataFrame:
        return members.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))

    several = placed(crowded.select("key", "node")).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    unsettled = materialise(join_spread(crowded.select("key", "node"), several.select("key"), "key").select("node").distinct(), "unsettled")
    if not unsettled.isEmpty():
        sets = whole_sets(texts.join(unsettled, "node", "left_semi").select("node", "id", "h"), docs, words)
        rare = placed(prefixes(sets, similarity).select("node", "size", F.posexplode("keys").alias("place", "key")))
        alike = alike.unionByName(alike_sets(cross_pairs(materialise(rare, "rare"), similarity), sets, similarity))
        merged = connected_components(alike)
    return join_spread(rows.select("doc_id", "id", "h", "same"), placed(texts.select("node", "same")).select("same", F.col("component").alias("node")), "same").drop("same")


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, limit: int = BITS) -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts whose ``words``-word shingles are alike.

    Fingerprints within ``limit`` bits are candidates and no more: they count repeated shingles, so texts of one
    repeated line have the same whatever else they hold. A similarity of 0.8 is about ten bits of 64, which no
    segment survives, so all distinct texts are compared by least shingle hashes too: documents that share one of
    their KEYS least are candidates. Only candidates that agree to ``similarity`` are linked. The documents of a
    hash that over PAIRED share are first compared with the one among them whose hashes are the most shared: the
    text that copies have in common. Where such a hash still has documents of several groups, these are compared by
    an exact prefix filter: all pairs between different groups that share one of the rarest of their whole sets.
    Texts without words form one group. Repeated rows are returned each; a group is named by its least doc_id, which
    is null only if none of its rows has one.
    """
    rows = materialise(grouped(docs, words, similarity, limit), "grouped")
    return join_spread(rows.select("doc_id", "node"), rows.groupBy("node").agg(F.min("doc_id").alias("component_id")), "node").drop("node")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the least doc_id.

    Rows are told apart by doc_id and text, so different texts of one doc_id are different documents; of rows with
    equal doc_id and text one stays. Rows without a doc_id are kept. Texts are shuffled only to join with more than
    BROADCAST_IDS dropped documents, or where rows are repeated.
    """
    named = docs.where("doc_id is not null")
    rows = materialise(grouped(named, words, similarity, BITS), "grouped")
    firsts = rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("first"))
    marked = join_spread(rows, firsts, "node")
    dropped = materialise(marked.where(F.struct("id", "h") != F.col("first")).select("id", "h").distinct(), "dropped")
    repeated = materialise(rows.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").join(dropped, ["id", "h"], "left_anti").select("id", "h"), "repeated")
    keyed = named.select("*", F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"))

    def meeting(some: DataFrame, how: str) -> DataFrame:
        side = some.select(F.col("id").alias("__id"), F.col("h").alias("__h"))
        return keyed.join(F.broadcast(side) if some.count() <= BROADCAST_IDS else side, ["__id", "__h"], how)

    if repeated.isEmpty():
        kept = meeting(dropped, "left_anti")
    else:
        kept = meeting(dropped.unionByName(repeated), "left_anti").unionByName(meeting(repeated, "left_semi").dropDuplicates(["__id", "__h"]))
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
