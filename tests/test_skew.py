"""Hot-key behaviour on data derived from the driver's ``events`` table.

A third of all events are re-keyed to one user.  The ordered operators must
give the same answer as a plain one-window formulation (acceptable as an
oracle at this size) while spreading the hot user's rows over many tasks.
"""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetframe.operators import aggs, windows
from fleetframe.operators.scan import running, time_chunk

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def hot_events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))


def _w():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def test_hot_key_is_spread(spark, hot_events):
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running(hot_events, ["user_id"], ["ts", "event_id"], time_chunk("ts", 86400),
                      rank="rk")
        per_task = (out.where(F.col("user_id") == -1)
                       .groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    hot = sum(r["count"] for r in per_task)
    assert hot > hot_events.count() / 4
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < hot / 2


def test_context_and_ranges_match_plain_windows(spark, hot_events):
    e = hot_events
    got_ctx = {r["event_id"] for r in windows.context(e, ["user_id"], ["ts", "event_id"],
                                                      F.col("event_type") == "error", 2)
               .where("in_context").collect()}
    plain = e.withColumn("hit", F.max((F.col("event_type") == "error").cast("int"))
                         .over(_w().rowsBetween(-2, 0)))
    assert got_ctx == {r["event_id"] for r in plain.where("hit = 1").collect()}

    got_kept = {r["event_id"] for r in windows.drop_ranges(
        e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup",
        F.col("event_type") == "purchase").collect()}
    mk = F.when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "purchase", "E")
    p = (e.withColumn("mk", mk)
          .withColumn("prev", F.last("mk", ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, -1))))
    exp = {r["event_id"] for r in p.where(~F.coalesce((F.col("mk") == "S") | (F.col("prev") == "S"),
                                                       F.lit(False))).collect()}
    assert got_kept == exp


def test_retry_and_lists_match_plain_windows(spark, hot_events):
    e = hot_events
    got = {r["user_id"]: (r["outcome"], r["attempts"], r["polls"]) for r in
           windows.retry_outcome(e, ["user_id"], ["ts", "event_id"],
                                 F.col("event_type") == "purchase", 40).collect()}
    r = e.withColumn("rn", F.row_number().over(_w()))
    f = r.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rn"))).alias("at"),
                                 F.count(F.lit(1)).alias("n")).collect()
    exp = {x["user_id"]: (("EXITED", x["at"]) if x["at"] is not None and x["at"] <= 40
                          else ("TIMEOUT", min(x["n"], 40))) + (x["n"],) for x in f}
    assert got == exp

    lists = {x["user_id"]: x["ids"] for x in
             aggs.ordered_list(e, ["user_id"], "event_id", "event_id", out="ids", chunk_width=256).collect()}
    plain = {x["user_id"]: ",".join(str(i) for i in sorted(x["ids"])) for x in
             e.groupBy("user_id").agg(F.collect_list("event_id").alias("ids")).collect()}
    assert lists == plain
