"""Writers (K1–K3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.scan import running
from fleetframe.session import materialize


#: Bytes of a configuration beyond which it is sorted and written by several tasks.
LARGE_BYTES = 64 << 20
#: Bytes of small configurations that are put together for one task.  Well below
#: what a task can write, as several such bins may meet in one.
BIN_BYTES = 16 << 20


def _dealt(df: DataFrame, partition_by: Sequence[str], order: Sequence[str], large_bytes: int) -> DataFrame:
    """Rows dealt out to tasks and sorted by configuration and ``order``.

    Sizes per configuration and their running sum (an ordered scan, so that
    very many configurations are no one task's work) put small configurations
    into bins of about ``BIN_BYTES``, each whole in one of them.  Those of more
    than ``large_bytes`` are cut by ranges of ``order`` and become several
    files, whose names sort as their content does.  Without ``partition_by``
    the whole table is one configuration.
    """
    keys, bin_bytes = list(partition_by), min(BIN_BYTES, large_bytes)
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16)))
    if not keys:
        total = df.agg(size).first()[0] or 0
        if total <= large_bytes:
            return df.repartition(1).sortWithinPartitions(*order)
        return df.repartitionByRange(-(-total // large_bytes), *order).sortWithinPartitions(*order)
    sizes = materialize(df.groupBy(*keys).agg(size.alias("_ff_size")), "writer-sizes")
    small = running(sizes.where(F.col("_ff_size") <= large_bytes), [], keys, F.lit(0), sums={"_ff_upto": F.col("_ff_size")})
    bins = materialize(small.select(*keys, F.floor((F.col("_ff_upto") - F.col("_ff_size") / 2) / bin_bytes).alias("_ff_bin"))
                       .unionByName(sizes.where(F.col("_ff_size") > large_bytes).select(
                           *keys, F.lit(None).cast("long").alias("_ff_bin"))), "writer-bins")
    named = bins.select(*[F.col(k).alias(f"_ff_k{i}") for i, k in enumerate(keys)], "_ff_bin")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_ff_k{i}"))
    rows = df.join(named, same).select(*df.columns, "_ff_bin")
    n, wide = bins.agg(F.max("_ff_bin") + 1, F.count_if(F.col("_ff_bin").isNull())).first()
    out = rows.where(F.col("_ff_bin").isNotNull()).repartition(max(1, n or 0), "_ff_bin").sortWithinPartitions(*keys, *order)
    if wide:
        total = sizes.where(F.col("_ff_size") > large_bytes).agg(F.sum("_ff_size")).first()[0]
        ranges = rows.where(F.col("_ff_bin").isNull()).repartitionByRange(-(-total // large_bytes), *keys, *order)
        out = out.unionByName(ranges.sortWithinPartitions(*keys, *order))
    return out.drop("_ff_bin")


def write_site_xml(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                   mode: str = "overwrite", large_bytes: int = LARGE_BYTES) -> None:
    """K1: ``<configuration><property><name/><value/><description/></property>…``.

    Spark's XML writer with ``rootTag=configuration`` and ``rowTag=property``;
    null descriptions are omitted.  One file per value of ``partition_by``
    (for example ``["source"]``), in a folder named after it; without
    ``partition_by`` the table is one configuration and one file.  Only a
    configuration of more than ``large_bytes`` becomes several files.
    :func:`fleetframe.sources.xml.read_site_xml` returns the partition values.
    """
    cols = [*partition_by, "name", "value", "description"]
    rows = df.select(*[c for c in cols if c in df.columns])
    w = (_dealt(rows, partition_by, ["name"], large_bytes)
           .write.format("xml").option("rootTag", "configuration").option("rowTag", "property")
           .mode(mode))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_properties(df: DataFrame, path: str, key: str = "key", value: str = "value",
                     partition_by: Sequence[str] = (), mode: str = "overwrite",
                     large_bytes: int = LARGE_BYTES) -> None:
    """K2: ``key=value`` lines, one text file per value of ``partition_by``
    (or one file), so that ``${key}`` references stay within their file; more
    only beyond ``large_bytes``."""
    out = df.select(*partition_by, F.concat_ws("=", F.col(key), F.coalesce(F.col(value), F.lit("")))
                    .alias("value"))
    w = _dealt(out, partition_by, ["value"], large_bytes).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet",
                      mode: str = "overwrite", max_records_per_file: int | None = None) -> None:
    """K3: distribute a rendered table by e.g. ``host, role``.

    The ``rebalance`` hint clusters rows by the partition columns so each
    folder gets few files, while AQE still splits a skewed host across tasks
    (a plain ``repartition(host)`` would put a hot host in one task).
    """
    by = list(by)
    w = df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.save(path)


__all__ = ["write_site_xml", "write_properties", "write_partitioned"]
