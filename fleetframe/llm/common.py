"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.session import discard, materialize, scratch_path, scratch_scope


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one driver table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def schema_of(key, *fields: str) -> T.StructType:
    """The field ``key`` (any type) followed by fields given as DDL."""
    rest = T.StructType.fromDDL(", ".join(fields)) if fields else T.StructType()
    return T.StructType([T.StructField("key", key.dataType), *rest.fields])


def numbered(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` and a column that names each of its rows: a struct of the row's
    number in its file and the file.

    A plain read of files already has these; any other frame is written once,
    since a row's name must be the same whenever it is read.
    """
    try:
        if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
            df = materialize(df, "numbered")
        meta = df.metadataColumn("_metadata")
        df.select(meta.getField("row_index"))
    except AnalysisException:  # a source that has no row numbers
        df = materialize(df, "numbered")
        meta = df.metadataColumn("_metadata")
    return df, F.struct(meta.getField("row_index").alias("row_index"), meta.getField("file_path").alias("file_path"))


def prefix_offsets(totals: DataFrame, part: str, amounts: list[str], by: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sums over partition numbers: ``{amount}_before``.

    ``totals`` has one row per partition (and per value of ``by``), so the
    window sees as many rows as there are partitions, never the data.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*(by or [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*(by or []), part, *[
        F.coalesce(F.sum(a).over(w), F.lit(0)).cast("long").alias(f"{a}_before") for a in amounts])


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow carry ``rows`` rows at a time between Spark and Python, unless
    the session names another number: whole texts can be long, and Spark holds
    a batch of every task outside of its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``, without copying: what a task
    makes of a batch of long texts is then handed on piece by piece."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def most_frequent(counts: DataFrame, word: str, n: str, size: int) -> list[str]:
    """The ``size`` words of the largest counts, ties in the words' order.

    The counts' histogram by eighths of a power of two (some 500 rows) gives a
    bound that about ``size`` words reach; only those are sorted and collected.
    ``counts`` should be a written table: it is read twice.
    """
    step = F.floor(F.log2(n) * 8)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        held, least = held + r.k, r.step
        if held >= size:
            break
    if least is None:
        return []
    top = counts.filter(step >= least).orderBy(F.desc(n), word).limit(size)
    return [r[0] for r in top.select(word).collect()]


__all__ = ["table", "schema_of", "numbered", "short_batches", "discard", "scratch_scope", "prefix_offsets", "most_frequent", "slices", "materialize", "scratch_path"]
