"""URL filter: rules by host and path, then a blocked Bloom filter before an exact join with a list.

DataFrame functions only. The Bloom filter is a table of 512-bit blocks (eight longs). A URL's hash names one
block and one bit in each of its words, so a probe reads a single row. What passes is joined exactly with the
list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_spread, materialise

WORDS = 8
BITS_PER_KEY = 16
#: Bytes of the filter up to which it is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 32 << 20

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query. Null, or no ``://``: all empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a trailing slash, query without tracking keys, its keys in order."""
    host, path, query = split_url(url)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)=")))
    tail = F.array_join(kept, "&")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls. Rules are a short list of parameters."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _hashed(df: DataFrame, url: str, blocks: int) -> DataFrame:
    bits = F.xxhash64(F.lit("bits"), F.col(url))
    masks = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * j}) & 63 as int))").alias(f"m{j}") for j in range(WORDS)]
    return df.withColumn("bits", bits).select("*", F.pmod(F.xxhash64(F.col(url)), F.lit(blocks)).alias("block"), *masks).drop("bits")


def bloom_table(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0..w7) of the distinct URLs in ``listed``."""
    return _hashed(listed.select(url), url, blocks).groupBy("block").agg(*(F.bit_or(f"m{j}").alias(f"w{j}") for j in range(WORDS)))


def mark_listed(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """``urls`` with ``listed``: whether their URL is in ``listed`` (column ``canonical``).

    Every row probes the Bloom filter where it is; only possible hits meet the exact list. A list that is too large to
    broadcast is joined with the written possible hits by a shuffle, all other rows stay where they are.
    """
    exact = materialise(listed.select("canonical").where("canonical <> ''").distinct(), "listed")
    size = exact.agg(F.count("*").alias("n"), F.sum(F.length("canonical") + 40).alias("bytes")).first()
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // (64 * WORDS)))
    bloom = bloom_table(exact, "canonical", blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for j in range(WORDS):
        hit = hit & (F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}"))
    probed = _hashed(urls, url, blocks).join(bloom, "block", "left").withColumn("possible", F.coalesce(hit, F.lit(False))).select(*urls.columns, "possible")
    known = exact.select(F.col("canonical").alias("listed_url"))
    found = F.col("listed_url").isNotNull().alias("listed")
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        marked = probed.join(F.broadcast(known), F.when(F.col("possible"), F.col(url)) == F.col("listed_url"), "left")
        return marked.select(*urls.columns, found)
    hits = join_spread(materialise(probed.where("possible").drop("possible"), "hits"), known.withColumn(url, F.col("listed_url")), url, "left")
    return hits.select(*urls.columns, found).unionByName(probed.where("not possible").select(*urls.columns, F.lit(False).alias("listed")))


def listed_urls(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """Rows of ``urls`` whose URL is in ``listed``."""
    return mark_listed(urls, listed, url).where("listed").drop("listed")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: host, path, rule, verdict.

    The longest fitting rule decides; without one, a canonical URL in ``listed`` is blocked and any other is
    allowed. A null or malformed URL has an empty host and path, fits no rule and is never listed. Repeated rows
    are judged each; other columns are not read. Only possible hits of the filter are joined, so no page is shuffled
    while the list can be broadcast.
    """
    host, path, _ = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), canonical_url(F.col(url_col)).alias("canonical"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    # What a rule decides need not be looked up.
    judged = parts.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.when(rule.isNull() & (F.col("canonical") != ""), F.col("canonical")).alias("canonical"))
    return mark_listed(judged, listed).select(id_col, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
