"""Aggregations (A1–A9).  All are hash/sort aggregates with map-side partial
aggregation.  List-valued outputs (A2, A8) are by definition as large as
their group; they are sorted per (group, chunk) in parallel and only the
sorted pieces are concatenated per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.scan import VOLUME_COLUMN, by_volume


def last_wins(conf: DataFrame, source: str = "source", key: str = "key",
              value: str = "value", line_no: str = "line_no") -> DataFrame:
    """W6 (shell ``source`` semantics): the value of the last assignment of each key per source.

    An aggregate (``max_by``) rather than a window, so it is combined map-side
    and a source with a third of all lines is not sent to one task whole.
    """
    return (conf.groupBy(source, key)
                .agg(F.max_by(F.col(value), F.col(line_no)).alias(value),
                     F.max(line_no).alias(line_no)))


def ha_flags(placement: DataFrame, keys: Sequence[str], host: str = "host",
             n_out: str = "n_hosts", flag_out: str = "is_ha") -> DataFrame:
    """A1: hosts per service and the HA flag (more than one host)."""
    return (placement.groupBy(*keys)
                     .agg(F.count(host).alias(n_out))
                     .withColumn(flag_out, F.col(n_out) > 1))


LIST_CHUNK = 1 << 16


def _numeric(df: DataFrame, col: str) -> bool:
    t = dict(df.dtypes).get(col, "")
    return t in ("tinyint", "smallint", "int", "bigint") or t.startswith("decimal") or t in ("float", "double")


def ordered_list(df: DataFrame, keys: Sequence[str], pos: str, value: str,
                 out: str = "hosts", sep: str = ",", chunk_width: int | None = LIST_CHUNK,
                 count_out: str | None = None) -> DataFrame:
    """A2: values joined with ``sep`` in ``pos`` order (ties by value);
    ``count_out`` adds the number of non-null values.

    Two levels, so a group with a third of all rows is not sorted in one
    task: each ``(key, chunk of pos)`` is sorted and joined on its own (in
    parallel, after a partial aggregate), then the pieces of a key are
    concatenated in chunk order.  Chunks are ranges of ``chunk_width`` of a
    numeric ``pos``; with ``chunk_width=None``, or for any other type, equal
    numbers of rows (:func:`fleetframe.operators.scan.by_volume`).  The list
    itself is one value, as long as its group.
    """
    keys = list(keys)

    def joined(pairs):
        return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["v"]), sep)

    pair = F.struct(F.col(pos).alias("p"), F.col(value).cast("string").alias("v"))
    if chunk_width and _numeric(df, pos):
        chunk = F.floor(F.col(pos) / F.lit(chunk_width))
    else:
        df = by_volume(df.select(*dict.fromkeys([*keys, pos, value])), keys, [pos])
        chunk = F.col(VOLUME_COLUMN)
    pieces = (df.groupBy(*keys, chunk.alias("_ff_c"))
                .agg(F.count(value).alias("_ff_n"),
                     F.when(F.count(value) > 0, joined(F.collect_list(pair))).alias("_ff_s")))
    aggs = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ff_c", "_ff_s"))),
                                     lambda s: s["_ff_s"]), sep).alias(out)]
    if count_out:
        aggs.append(F.sum("_ff_n").alias(count_out))
    return pieces.groupBy(*keys).agg(*aggs)


SET_BUCKETS = 256


def hash_bucket(value: Column) -> Column:
    """One of ``SET_BUCKETS`` buckets of a value; none for null, so that rows
    without a value still combine before the shuffle."""
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(SET_BUCKETS)))


def sorted_pieces(sets: str | Column, sep: str = ",") -> Column:
    """Aggregate: the disjoint sets of a group's buckets as one sorted list."""
    return F.array_join(F.array_sort(F.flatten(F.collect_list(sets))), sep)


def failed_hosts(steps: DataFrame, run: str, host: str, status: str, ok_value: str = "SUCCESS") -> DataFrame:
    """A3 in long form: every distinct ``(run, host)`` with a failed step."""
    return steps.where(F.col(status) != F.lit(ok_value)).select(run, host).where(F.col(host).isNotNull()).distinct()


def run_summary(steps: DataFrame, run: str, host: str, status: str,
                ok_value: str = "SUCCESS") -> DataFrame:
    """A3: per run ``n_ok``, ``n_total``, sorted distinct ``failed_hosts`` and
    ``overall`` (SUCCESS when all ok, FAILED when none, PARTIAL otherwise).

    Distinct hosts are gathered per (run, hash bucket of the host) in
    parallel; a run's buckets only meet for the list itself.  Its long form is
    :func:`failed_hosts`.
    """
    ok = F.col(status) == F.lit(ok_value)
    failed = F.when(~ok, F.col(host))
    pieces = steps.groupBy(run, hash_bucket(failed).alias("_ff_b")).agg(
        F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n_total"), F.collect_set(failed).alias("_ff_s"))
    agg = pieces.groupBy(run).agg(F.sum("n_ok").alias("n_ok"), F.sum("n_total").alias("n_total"),
                                  sorted_pieces("_ff_s").alias("failed_hosts"))
    return agg.withColumn(
        "overall",
        F.when(F.col("n_ok") == F.col("n_total"), F.lit("SUCCESS"))
         .when(F.col("n_ok") == 0, F.lit("FAILED"))
         .otherwise(F.lit("PARTIAL")))


def any_issue(df: DataFrame, keys: Sequence[str], cond: Column, out: str = "any_issue") -> DataFrame:
    """A4: whether any row of the group meets ``cond``."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(out))


def kind_counts(df: DataFrame, value: str | Column, kind_re: str, group: int = 1,
                kind: str = "kind", distinct_of: str | Column | None = None) -> DataFrame:
    """A5: rows per kind (a regex group of ``value``) and, optionally, the
    number of distinct ``distinct_of`` values per kind."""
    v = F.col(value) if isinstance(value, str) else value
    g = df.select(F.regexp_extract(v, kind_re, group).alias(kind),
                  *( [(F.col(distinct_of) if isinstance(distinct_of, str) else distinct_of)
                      .alias("_ff_d")] if distinct_of is not None else []))
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct_of is not None:
        aggs.append(F.count_distinct("_ff_d").alias("n_distinct"))
    return g.groupBy(kind).agg(*aggs)


def test_rollup(results: DataFrame, suite: str, status: str, pass_value: str = "PASS",
                fail_value: str = "FAIL") -> DataFrame:
    """Run / passed / failed per suite plus an overall row
    (``is_total`` true, suite null)."""
    return (results.rollup(suite)
                   .agg(F.count(F.lit(1)).alias("n_run"),
                        F.count_if(F.col(status) == pass_value).alias("n_passed"),
                        F.count_if(F.col(status) == fail_value).alias("n_failed"),
                        (F.grouping(suite) == 1).alias("is_total")))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             values: Sequence[str], prefix: str = "first_") -> DataFrame:
    """A7 (``head -1``): the values of the first row of each group in ``order``."""
    ostruct = F.struct(*[F.col(c) for c in order])
    vstruct = F.struct(*[F.col(c) for c in values])
    agg = df.groupBy(*keys).agg(F.min_by(vstruct, ostruct).alias("_ff_v"))
    return agg.select(*keys, *[F.col("_ff_v")[c].alias(prefix + c) for c in values])


def collect_sorted(df: DataFrame, keys: Sequence[str], value: str, out: str = "values",
                   sep: str = ",", chunk_width: int | None = LIST_CHUNK) -> DataFrame:
    """Every value of the group, sorted, joined with ``sep``; plus a count
    ``n``.  Values are sorted per (key, range of values) in parallel and the
    sorted pieces concatenated, as in :func:`ordered_list`."""
    return ordered_list(df, keys, value, value, out=out, sep=sep, chunk_width=chunk_width,
                        count_out="n")


def pivot_facts(df: DataFrame, keys: Sequence[str], attr: str, value: str,
                attrs: Sequence[str], pos: str | None = None) -> DataFrame:
    """A9 long-to-wide: one column per listed attribute.  With ``pos`` the
    last occurrence of a repeated attribute wins, otherwise the greatest value.

    The attribute list is explicit, so no extra job discovers the pivot
    values and the output schema is fixed.
    """
    aggs = []
    for a in attrs:
        hit = F.col(attr) == F.lit(a)
        if pos:
            aggs.append(F.max_by(F.when(hit, F.col(value)), F.when(hit, F.col(pos))).alias(a))
        else:
            aggs.append(F.max(F.when(hit, F.col(value))).alias(a))
    return df.groupBy(*keys).agg(*aggs)


__all__ = ["last_wins", "ha_flags", "ordered_list", "hash_bucket", "sorted_pieces", "failed_hosts", "run_summary", "any_issue", "kind_counts",
           "test_rollup", "first_by", "collect_sorted", "pivot_facts"]
