"""Token files: round trip against the tokenizer, stripes, Bloom filters and pruning."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoframe.llm import queries, token_files
from mnemoframe.llm.common import shared_dir


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in their order."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def folder(spark):
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def files(path):
    import glob

    return sorted(glob.glob(f"{path.removeprefix('file://')}/*.orc"))


def test_whole_query_against_the_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op13_token_files(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "é　 " * 20_000), (5, "x"), (5, "x"), (7, "  \n")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, start int")
    got = token_files.round_trip(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    assert token_files.round_trip(df.limit(0)).count() == 0


def test_a_hot_document_id_is_dealt_over_parts(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = spark.read.orc(path).where("doc_id = 7").select("part").distinct().count()
    got = sorted(token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens").collect(), key=lambda r: r.start)
    assert hot > 1 and len(got) == 3000
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(3000)] and [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_stripes_are_read_apart_and_documents_over_them_joined(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(2000)))) for i in range(60)]
    path, before = folder(spark), spark.conf.get("spark.sql.files.maxPartitionBytes")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, piece=7, stripe_bytes=20_000)
    stripes = [pyarrow.orc.ORCFile(f).nstripes for f in files(path)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        pieces = token_files.read_pieces(spark, path)
        tasks = pieces.select("part", "doc", F.spark_partition_id().alias("task")).groupBy("part", "doc").agg(F.count_distinct("task").alias("n"))
        assert max(stripes) > 3 and tasks.where("n > 1").count() > 0
        assert sorted(map(tuple, token_files.read_documents(spark, path).collect())) == plain(rows)
        ids = pieces.groupBy("start").agg(F.first("ids").alias("ids")).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(a.start + len(a.ids) == b.start for a, b in zip(ids, ids[1:], strict=False))


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def test_look_up_reads_few_row_groups(spark):
    # Ids far apart and, in one file, out of order: only the Bloom filter can tell that a group lacks one.
    path = folder(spark)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": token_files.FALSE_HITS, "orc.row.index.stride": token_files.ROW_GROUP}
    docs = spark.range(20_000).select((F.col("id") * 10).alias("doc_id"), F.lit("w").alias("text"))
    token_files.write_tokens(docs, path)
    found = token_files.look_up(spark, path, [50_000])
    assert [r.doc_id for r in found.collect()] == [50_000] and rows_read(found) <= 2000
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id" in found._jdf.queryExecution().toString()
    shuffled = folder(spark)
    spark.read.orc(path).orderBy(F.xxhash64("doc_id")).coalesce(1).write.options(**options).orc(shuffled)
    missing = token_files.look_up(spark, shuffled, [50_001])
    assert missing.count() == 0 and rows_read(missing) <= 3000
    no_filter = folder(spark)
    spark.read.orc(path).orderBy(F.xxhash64("doc_id")).coalesce(1).write.option("orc.row.index.stride", token_files.ROW_GROUP).orc(no_filter)
    assert rows_read(token_files.look_up(spark, no_filter, [50_001])) == 20_000


def test_checksums_of_parts():
    rng = random.Random(2)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice([0, 1, 5, 70_000, 200_000])) for _ in range(rng.randrange(1, 5))]
        assert token_files.joined_crc((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(b"".join(parts))
