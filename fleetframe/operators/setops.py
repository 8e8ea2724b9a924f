"""Sort, limit and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.scan import running

# Fixed value: the reference's service start order; stop is its reverse.
START_ORDER = ("scm", "om", "datanode", "recon", "s3gateway", "httpfs")


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """O1 ``head -n``: the first ``n`` rows in ``order`` (a top-k: each task
    keeps its own best ``n``, then one merge of ``n x tasks`` rows)."""
    return df.orderBy(*order).limit(n)


def ordered_plan(placement: DataFrame, keys: Sequence[str], item: str, pos: str,
                 order: Sequence[str] = START_ORDER, chunk_width: int = 1 << 20) -> DataFrame:
    """O2 dependency order per key: rows ranked by the item's place in
    ``order`` then by ``pos``; adds ``seq`` (1-based start order) and
    ``stop_seq`` (its exact reverse).  Items not in ``order`` go last.

    ``seq`` is a row number per key; it runs through the chunked scan
    (chunk = rank band, plus a range of a whole-number ``pos``), so one huge
    key is not numbered in a single task.
    """
    keys = list(keys)
    spark = placement.sparkSession
    dim = F.broadcast(spark.createDataFrame([(str(s), i + 1) for i, s in enumerate(order)],
                                            "_ff_item string, _ff_rank int"))
    r = (placement.join(dim, F.col(item).cast("string") == F.col("_ff_item"), "left")
                  .withColumn("_ff_rank", F.coalesce("_ff_rank", F.lit(len(order) + 1)))
                  .drop("_ff_item"))
    chunk = F.col("_ff_rank").cast("long")
    if dict(r.dtypes)[pos] in ("tinyint", "smallint", "int", "bigint"):
        chunk = chunk * F.lit(1 << 40) + F.floor(F.col(pos) / F.lit(chunk_width))
    s = running(r, keys, ["_ff_rank", pos], chunk, rank="seq", total="_ff_n")
    return (s.withColumn("stop_seq", (F.col("_ff_n") - F.col("seq") + 1).cast("long"))
             .drop("_ff_n", "_ff_rank"))


def uniq(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """O3 ``sort -u``: distinct values (sort at presentation time if needed)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*cols).distinct()


def all_hosts(*frames: DataFrame, col: str = "host") -> DataFrame:
    """U1 union of host lists, distinct."""
    out = None
    for f in frames:
        part = f.select(col)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def unplaced(cluster_hosts: DataFrame, placed: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U2 cluster hosts with no service (``EXCEPT DISTINCT``)."""
    cols = list(cols)
    return cluster_hosts.select(*cols).subtract(placed.select(*cols))


def intersect(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U3 requested ∩ available (distinct)."""
    cols = list(cols)
    return a.select(*cols).intersect(b.select(*cols))


def placement_cube(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """U4 totals over every combination of ``dims`` (``cube``), with a
    ``grouping_id`` column telling which dimensions are rolled up."""
    return df.cube(*dims).agg(*aggs, F.grouping_id(*dims).cast("int").alias("grouping_id"))


__all__ = ["top_n", "ordered_plan", "uniq", "all_hosts", "unplaced", "intersect",
           "placement_cube", "START_ORDER"]
