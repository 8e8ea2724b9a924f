"""Joins (J1–J10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.aggs import hash_bucket, sorted_pieces
from fleetframe.operators.contains import hits


def expand(left: DataFrame, right: DataFrame) -> DataFrame:
    """J1 every left row with every right row (host x directory): the product
    is the result.  Spark broadcasts the right side by its size in bytes."""
    return left.crossJoin(right)


def config_manifest(hosts: DataFrame, roles: DataFrame, files: DataFrame) -> DataFrame:
    """J2 host x role x file targets.  Roles and files, both short lists, are
    crossed first."""
    return hosts.crossJoin(roles.crossJoin(files))


def _keys_of(ref: DataFrame, on: str | Sequence[str]) -> DataFrame:
    # distinct keys (combined map-side): a key repeated a million times in
    # the reference side becomes one row before the join
    cols = [on] if isinstance(on, str) else list(on)
    return ref.select(*cols).distinct()


def semi(df: DataFrame, ref: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """J4 rows of ``df`` with a match in ``ref``."""
    return df.join(_keys_of(ref, on), on, "left_semi")


def anti(df: DataFrame, ref: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """J5 rows of ``df`` with no match in ``ref``."""
    return df.join(_keys_of(ref, on), on, "left_anti")


def lookup_dim(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """J6 inner join to a dimension; unknown keys are dropped.  Spark picks a
    broadcast by the dimension's size in bytes, else a shuffled join."""
    return df.join(dim, on, "inner")


def drift(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """J7 property drift: ``(keys, expected_value, actual_value, state)`` with
    state in match / changed / missing (expected only) / unexpected (actual only).
    Values are compared null-safely.

    Each side is first reduced to one row per key (a key set twice keeps its
    sorted distinct values joined with ``,``), so a repeated key never
    multiplies into all pairs.  The values of a key are gathered per hash
    bucket first, so one key with very many of them is spread until its list
    is put together; the reduction's hash partitioning on the keys is reused
    by the full outer join.
    """
    keys = list(keys)

    def one_per_key(df, name):
        v = F.col(value)
        pieces = df.groupBy(*keys, hash_bucket(v).alias("_ff_b")).agg(F.count(F.lit(1)).alias("_ff_n"),
                                                                       F.collect_set(v).alias("_ff_s"))
        # a single row's value stays as it is, null included
        one = F.get(F.flatten(F.collect_list("_ff_s")), 0)
        return pieces.groupBy(*keys).agg(
            F.when(F.sum("_ff_n") == 1, one).otherwise(sorted_pieces("_ff_s")).alias(name))

    e = one_per_key(expected, "expected_value").withColumn("_ff_e", F.lit(True))
    a = one_per_key(actual, "actual_value").withColumn("_ff_a", F.lit(True))
    j = e.join(a, keys, "full_outer")
    state = (F.when(F.col("_ff_a").isNull(), F.lit("missing"))
              .when(F.col("_ff_e").isNull(), F.lit("unexpected"))
              .when(F.col("expected_value").eqNullSafe(F.col("actual_value")), F.lit("match"))
              .otherwise(F.lit("changed")))
    return j.select(*keys, "expected_value", "actual_value", state.alias("state"))


def pattern_join(df: DataFrame, text: str, df_id: Sequence[str] | str,
                 patterns: DataFrame, pattern: str, pattern_id: Sequence[str] | str,
                 filter_bits: int | None = None) -> DataFrame:
    """J8 theta join: every ``(df_id, pattern_id)`` where ``text`` contains
    ``pattern``, for patterns of any length and number
    (:mod:`fleetframe.operators.contains`).  An empty pattern is in every
    text; null texts and patterns match nothing."""
    df_id = [df_id] if isinstance(df_id, str) else list(df_id)
    pattern_id = [pattern_id] if isinstance(pattern_id, str) else list(pattern_id)
    found = hits(df, df_id, text, patterns, pattern, filter_bits)
    ids = patterns.select(F.col(pattern).cast("string").alias("_ff_pat"), *pattern_id)
    return found.join(ids, "_ff_pat").select("_ff_row.*", *pattern_id)


def contains_join(df: DataFrame, text: str, patterns: DataFrame, pattern: str,
                  filter_bits: int | None = None) -> DataFrame:
    """Rows of ``df`` joined with every row of ``patterns`` whose ``pattern``
    their ``text`` contains (process-to-service matching)."""
    found = hits(df, df.columns, text, patterns, pattern, filter_bits)
    other = patterns.withColumn("_ff_pat", F.col(pattern).cast("string"))
    return found.join(other, "_ff_pat").select("_ff_row.*", *patterns.columns)


def verify_manifest(expected: DataFrame, shipped: DataFrame, file: str, size: str,
                    host: str = "host", targets: DataFrame | None = None) -> DataFrame:
    """J9 shipment check: each shipped ``(host, file, size)`` against the
    source manifest ``(file, size)``; ``ok`` when sizes are equal and > 0.

    With ``targets`` (``host``, ``file``: what should be where, for example
    from :func:`config_manifest`), a file that never arrived has a row too,
    with a null ``actual_size`` and ``ok`` false.  A file missing from the
    manifest is not ok.  A file that the manifest repeats counts once, with
    its largest size.
    """
    e = expected.groupBy(F.col(file)).agg(F.max(size).alias("expected_size"))
    s = shipped.select(F.col(host), F.col(file), F.col(size).alias("actual_size"))
    if targets is not None:
        s = targets.select(host, file).distinct().join(s, [host, file], "full_outer")
    ok = F.coalesce((F.col("actual_size") == F.col("expected_size")) & (F.col("actual_size") > 0),
                    F.lit(False))
    return s.join(e, file, "left").select(host, file, "actual_size", "expected_size", ok.alias("ok"))


def pick_available(available: DataFrame, keys: Sequence[str], item: str, requested: Column,
                   priority: Sequence, out: str = "chosen") -> DataFrame:
    """Per key, the requested item if it is available, else the first
    item of ``priority`` that is.  Keys with neither get no row.

    ``available`` is reduced to distinct ``(key, item)`` pairs (a partial
    aggregate) before the fixed priority table is broadcast against it.
    """
    keys = list(keys)
    spark = available.sparkSession
    prio = F.broadcast(spark.createDataFrame([(str(p), i + 1) for i, p in enumerate(priority)],
                                             "_ff_item string, _ff_rank int"))
    av = available.select(*keys, F.col(item).cast("string").alias("_ff_item"),
                          requested.cast("string").alias("_ff_req")).distinct()
    ranked = av.join(prio, "_ff_item", "left").withColumn(
        "_ff_r", F.when(F.col("_ff_item") == F.col("_ff_req"), F.lit(0)).otherwise(F.col("_ff_rank")))
    return (ranked.where(F.col("_ff_r").isNotNull())
                  .groupBy(*keys).agg(F.min_by("_ff_item", "_ff_r").alias(out)))


__all__ = ["expand", "config_manifest", "semi", "anti", "lookup_dim", "drift",
           "pattern_join", "contains_join", "verify_manifest", "pick_available"]
