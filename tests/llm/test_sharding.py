import random
import zlib

from pyspark.sql import functions as F

from fleetframe.llm.sharding import op10_shards, shard_contiguous
from tests.conftest import SF_SMALL


def brute(rows, shards):
    """rows: (key, size) in order -> [(key, size, shard, slot)]"""
    total, at, slots, out = sum(s or 0 for _, s in rows), 0, {}, []
    for k, s in rows:
        mid = 2 * at + (s or 0)
        sh = min(shards - 1, mid * shards // (2 * total)) if total else 0
        out.append((k, s, sh, slots.setdefault(sh, 0)))
        slots[sh] += 1
        at += s or 0
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 5, 900, None])) for i in range(3000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, s long").repartition(7)
    got = sorted(map(tuple, shard_contiguous(df, ["k"], "s", 11).collect()))
    assert got == brute(rows, 11)


def test_ties_nulls_empty_and_zero(spark):
    df = spark.createDataFrame([(1, 10)] * 400 + [(None, 10)] * 100, "k long, s long")
    got = shard_contiguous(df, ["k"], "s", 5)
    assert sorted(map(tuple, got.groupBy("shard").agg(F.count("*"), F.min("slot"), F.max("slot")).collect())) == [
        (i, 100, 0, 99) for i in range(5)]
    assert got.filter("k is null").select("shard").distinct().collect()[0][0] == 0
    assert shard_contiguous(df.limit(0), ["k"], "s", 5).count() == 0
    zero = shard_contiguous(df.withColumn("s", F.lit(0).cast("long")), ["k"], "s", 5)
    assert zero.select("shard").distinct().collect()[0][0] == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, 10, f"p{i}", i, "s", "t") for i in range(20)],
                               "k long, size long, part string, row long, shard string, tie string")
    got = shard_contiguous(df, ["k"], "size", 4)
    assert got.columns == ["k", "size", "part", "row", "tie", "shard", "slot"]
    assert sorted((r.k, r.part, r.row, r.tie, r.shard, r.slot) for r in got.collect()) == [
        (i, f"p{i}", i, "t", i // 5, i % 5) for i in range(20)]


def test_query(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()))
    want = {k: (s, sh, sl) for k, s, sh, sl in brute([(i, len((t or "").encode()) + 16) for i, t in docs], 40)}
    got = op10_shards(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.size, r.shard, r.slot) for r in got} == want and len(got) == len(docs)
    texts = dict(docs)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" for r in got)
