"""Spreading work that starts from few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster when it has fewer partitions than
    the default parallelism, before CPU-heavy per-row work (tokenising
    whole texts).  A large input already has at least that many splits, so
    on a cluster this is a no-op; it matters for a few big rows in one file.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave as is
        return df
    if current >= target:
        return df
    return df.repartition(target)


__all__ = ["spread"]
