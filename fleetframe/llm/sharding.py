"""Contiguous shards of equal byte size from global prefix sums (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import materialize, prefix_offsets, table

_LOCAL = "part int, rows_upto long, bytes_upto long"


def _running_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the partition number and the running row and byte counts."""
    import numpy as np
    part = TaskContext.get().partitionId()
    rows = size = 0
    for b in batches:
        n = b.num_rows
        sizes = b.column("size").to_numpy(zero_copy_only=False).astype("int64")
        upto = np.cumsum(sizes) + size
        yield pa.RecordBatch.from_arrays(
            b.columns + [pa.array(np.full(n, part, "int32")), pa.array(np.arange(1, n + 1) + rows),
                         pa.array(upto)],
            names=b.schema.names + ["part", "rows_upto", "bytes_upto"])
        rows, size = rows + n, int(upto[-1]) if n else size


def shard_contiguous(df: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """Cut ``df`` into ``shards`` contiguous runs of nearly equal total ``size``.

    The rows are put in one global order (``order``, ties in the order in
    which the input is read) by a range partitioning; each partition adds up
    its own rows, the totals of the partitions give each one's offset, and a
    row's shard is ``floor(middle of its bytes * shards / all bytes)``.  The
    middle rises along the order, so shards are contiguous, and a shard is
    off the mean by less than the largest row.  Only one row per partition
    goes through a single task.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 within a shard),
    in place of columns of these names if ``df`` has any.  Pass narrow rows
    (keys, sizes): they are written twice and shuffled once.

    Defined cases: null sizes count as 0; null order values come first;
    repeated rows each get their own slot; an order value that a third of
    the rows share is split like any other (the read order breaks the tie);
    with all sizes 0, every row is in shard 0; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    # all columns as one struct, so that no name can clash; written once: the
    # tie-break must not change between the sampling pass and the
    # partitioning pass, or when a task is run again
    keys = [f"key{i}" for i in range(len(order))]
    rows = materialize(df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)],
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("tie")), "shard-rows")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(
        rows.repartitionByRange(n, *keys, "tie").sortWithinPartitions(*keys, "tie").select("row", "size")
        .mapInArrow(_running_totals, T.StructType([*rows.select("row", "size").schema.fields,
                                                   *T.StructType.fromDDL(_LOCAL).fields])), "shard-order")
    totals = ordered.groupBy("part").agg(F.max("rows_upto").alias("rows"), F.max("bytes_upto").alias("bytes"))
    offsets = prefix_offsets(totals, "part", ["rows", "bytes"])
    whole = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all"))
    # offsets: one row per partition; whole: one row
    placed = (ordered.join(F.broadcast(offsets), "part").join(F.broadcast(whole))
              .withColumn("pos", F.col("rows_before") + F.col("rows_upto") - 1)
              .withColumn("middle", 2 * (F.col("bytes_before") + F.col("bytes_upto")) - F.col("size"))
              .withColumn("shard", F.when(F.col("all") == 0, F.lit(0)).otherwise(
                  F.least(F.lit(shards - 1), F.expr(
                      f"CAST(middle AS DECIMAL(38,0)) * {shards} div (2 * `all`)"))).cast("int")))
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("shard", "slot")],
                    "shard", (F.col("pos") - F.col("first")).alias("slot")))


def op10_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 contiguous shards (by ``doc_id``) of near-equal
    bytes.  A null text has no bytes and the CRC of an empty text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    narrow = docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_contiguous(narrow, ["doc_id"], "size", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# DuckDB has no CRC-32 function: the column is left to the tests, so there is
# no SQL for this query; tests/llm/test_sharding.py holds it to a brute force.
__all__ = ["shard_contiguous", "op10_shards"]
