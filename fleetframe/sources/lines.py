"""Reading text files as numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.session import materialize


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read small text files as ``(source, line_no, line)`` with 0-based line numbers.

    Each file is one ``wholetext`` record (``text(wholetext=True)``: the
    ``option("wholetext", ...)`` form is overridden by the keyword default),
    split on newlines with its position kept.  Meant for configuration-sized
    files; large logs are read by :func:`read_log_lines`.
    """
    if isinstance(paths, str):
        paths = [paths]
    raw = spark.read.text(list(paths), wholetext=True)
    return split_lines(raw.select(F.col("_metadata.file_path").alias("source"),
                                  F.col("value")), "value")


def read_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read text files of any size as ``(source, line_no, line)``, numbered
    from 0 in each file.

    Spark reads a large file in splits.  Rows of a split come in their order,
    so a line's number is its place in its split plus the lines of the splits
    before it: one row a split, summed up per file.  The lines are written
    once with their split and a running id, since how a file is split may
    differ between two reads.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_ff_at"),
        F.monotonically_increasing_id().alias("_ff_id"), F.col("value").alias("line"))
    raw = materialize(raw, "log-lines")
    splits = raw.groupBy("source", "_ff_at").agg(F.min("_ff_id").alias("_ff_first"), F.count(F.lit(1)).alias("_ff_n"))
    before = Window.partitionBy("source").orderBy("_ff_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(splits.withColumn("_ff_before", F.coalesce(F.sum("_ff_n").over(before), F.lit(0))).drop("_ff_n"),
                         "log-splits")
    number = F.col("_ff_before") + F.col("_ff_id") - F.col("_ff_first")
    return raw.join(splits, ["source", "_ff_at"]).select("source", number.alias("line_no"), "line")


def split_lines(df: DataFrame, text: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Explode a text column into ``(…keep, line_no, line)``; a trailing newline
    does not produce an extra empty line (as ``while read`` would not)."""
    keep = list(keep) if keep is not None else [c for c in df.columns if c != text]
    body = F.regexp_replace(F.col(text), "\n$", "")
    return df.select(*keep, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


__all__ = ["read_lines", "read_log_lines", "split_lines"]
