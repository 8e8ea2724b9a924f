"""Sequence operators.

Order-dependent logic runs through :func:`fleetframe.operators.scan.running`
(partitioned by key *and* chunk, so one hot key is spread over many tasks).
Where the semantics allow it an aggregate plus a join replaces the window
(W1, W3, W6): aggregates combine map-side and AQE splits a skewed join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.time import dtype_of, epoch_seconds
from fleetframe.operators.scan import VOLUME_COLUMN, by_volume, number_chunk, running, time_chunk
from fleetframe.session import materialize
from fleetframe.operators.aggs import last_wins  # noqa: F401  (W6 is an aggregate)

# The election commands and the reference's poll limit.
INIT_COMMAND = "--init"
BOOTSTRAP_COMMAND = "--bootstrap"
MAX_POLL_ATTEMPTS = 60
MAX_CONCURRENT = 10


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             chunk: Column | str | None) -> tuple[DataFrame, Column]:
    """``df`` and the chunk column of an ordered scan.

    Without ``chunk``: days for a first order column of time, ranges of
    100,000 for a number, whole keys for other types; the scan itself cuts
    chunks of too many rows.  ``"volume"`` cuts everything by numbers of rows
    beforehand (:func:`by_volume`).
    """
    if isinstance(chunk, Column):
        return df, chunk
    first = order[0]
    dtype = dict(df.select(_col(first).alias("o")).dtypes)["o"]
    if chunk is None and (dtype.startswith("timestamp") or dtype == "date"):
        return df, time_chunk(first, 86400, dtype)
    if chunk is None and (dtype in ("tinyint", "smallint", "int", "bigint", "float", "double")
                          or dtype.startswith("decimal")):
        return df, number_chunk(first, 100_000)
    if chunk is None:
        return df, F.lit(0)
    return by_volume(df, keys, order), F.col(VOLUME_COLUMN)


def _join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; ``other``'s keys are dropped."""
    named = other.select(*[F.col(k).alias(f"_ff_j{i}") for i, k in enumerate(keys)],
                         *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(named[f"_ff_j{i}"])
    return df.join(named, cond, how).drop(*[f"_ff_j{i}" for i in range(len(keys))])


def elect(df: DataFrame, keys: Sequence[str], pos: str, out: str = "command",
          first: str = INIT_COMMAND, other: str = BOOTSTRAP_COMMAND, host: str | None = None) -> DataFrame:
    """W1 first-node election: the lowest ``pos`` of each key gets ``first``,
    every other row ``other`` (a single-member group therefore gets ``first``).

    With ``host`` the election is by name: every row of the host at the lowest
    position gets ``first``, however often it is listed.  Rows with a null key
    are a group of their own.
    """
    keys = list(keys)
    mine = host or pos
    firsts = df.groupBy(*keys).agg(F.min_by(mine, pos).alias("_ff_first"))
    return (_join_keys(df, firsts, keys, "left")
            .withColumn(out, F.when(F.col(mine).eqNullSafe(F.col("_ff_first")), F.lit(first))
                              .otherwise(F.lit(other)))
            .drop("_ff_first"))


def primary(df: DataFrame, keys: Sequence[str], pos: str, value: str,
            out: str = "primary") -> DataFrame:
    """The value at the lowest position of each key (element 0)."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.col(pos)).alias(out))


def carry(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str | Column,
          out: str, chunk: Column | str | None = None) -> DataFrame:
    """W7 header carry-forward: last non-null ``value`` at or before each row."""
    order = [order] if isinstance(order, str) else list(order)
    df, chunk = _chunked(df.withColumn(out, _col(value)), keys, order, chunk)
    return running(df.withColumnRenamed(out, "_ff_v"), keys, order, chunk,
                   carries={out: F.col("_ff_v")}).drop("_ff_v", VOLUME_COLUMN)


def retry_outcome(polls: DataFrame, keys: Sequence[str], order: Sequence[str],
                  exited: Column, max_attempts: int = MAX_POLL_ATTEMPTS) -> DataFrame:
    """W3 bounded retry per key.

    Attempts are numbered from 1 in ``order``; the first attempt where
    ``exited`` holds ends the wait.  If that attempt is within
    ``max_attempts`` the outcome is ``EXITED`` with that attempt number,
    otherwise ``TIMEOUT`` with ``min(polls, max_attempts)`` attempts used.
    ``exit_<order col>`` columns give the exiting poll's order values.

    Two passes and no per-key sort: an aggregate finds each key's number of
    polls and earliest exit, and the polls up to that exit are counted after
    joining it back.  Null keys are a key of their own.
    """
    keys = list(keys)
    p = polls.select(*keys, F.struct(*[F.col(c) for c in order]).alias("_ff_o"), exited.alias("_ff_x"))
    per_key = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ff_total"),
                                   F.min(F.when(F.col("_ff_x"), F.col("_ff_o"))).alias("_ff_exit"))
    upto = (_join_keys(p.select(*keys, "_ff_o"), per_key, keys, "inner")
            .groupBy(*keys).agg(F.count_if(F.col("_ff_o") <= F.col("_ff_exit")).alias("_ff_at"),
                                F.first("_ff_total").alias("_ff_total"), F.first("_ff_exit").alias("_ff_exit")))
    ok = F.col("_ff_exit").isNotNull() & (F.col("_ff_at") <= F.lit(max_attempts))
    return upto.select(
        *keys,
        F.when(ok, F.lit("EXITED")).otherwise(F.lit("TIMEOUT")).alias("outcome"),
        F.when(ok, F.col("_ff_at"))
         .otherwise(F.least(F.col("_ff_total"), F.lit(max_attempts))).cast("long").alias("attempts"),
        F.col("_ff_total").cast("long").alias("polls"),
        *[F.when(ok, F.col("_ff_exit")[c]).alias(f"exit_{c}") for c in order])


def context(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column, n: int,
            out: str = "in_context", chunk: Column | str | None = None) -> DataFrame:
    """W4 ``grep -A n``: a row is in context if it matches or one of the ``n``
    rows before it (same key, in ``order``) matches."""
    df, chunk = _chunked(df, keys, order, chunk)
    s = running(df, keys, order, chunk, rank="_ff_rk", last_rank_where={"_ff_lm": cond})
    return (s.withColumn(out, F.coalesce(F.col("_ff_rk") - F.col("_ff_lm") <= F.lit(n), F.lit(False)))
             .drop("_ff_rk", "_ff_lm", VOLUME_COLUMN))


def drop_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column,
                end: Column, chunk: Column | str | None = None, keep_flag: str | None = None,
                overlap: bool = False) -> DataFrame:
    """W5 ``sed '/start/,/end/d'`` per key.

    A row is inside a range when it matches ``start`` or the last marker
    strictly before it is a start.  The end line is removed with its range;
    an unterminated range runs to the end; repeated starts do not nest; a
    stray end outside a range is kept.  With ``keep_flag`` the rows are kept
    and flagged instead.

    A row that matches both begins a range outside of one and ends the range
    that it is in, as in ``sed``.  That takes a second scan, so it has to be
    asked for with ``overlap``; without it such a row raises an error.
    """
    df, chunk = _chunked(df, keys, order, chunk)
    if overlap:
        both = F.coalesce(start & end, F.lit(False))
        turned = running(df.withColumn("_ff_b", both.cast("long")), keys, order, chunk,
                         sums={"_ff_turns": F.col("_ff_b")})
        marker = F.when(F.col("_ff_b") == 1, None).when(start, F.lit(1)).when(end, F.lit(0))
        # the state before a row: the last plain marker, turned once by each
        # row since that matches both
        s = running(turned.withColumn("_ff_mk", F.when(marker.isNotNull(), F.struct(
            marker.alias("s"), F.col("_ff_turns").alias("n")))), keys, order, chunk,
            carries_before={"_ff_prev": F.col("_ff_mk")})
        since = F.col("_ff_turns") - F.col("_ff_b") - F.coalesce(F.col("_ff_prev.n"), F.lit(0))
        was_in = (F.coalesce(F.col("_ff_prev.s"), F.lit(0)) + since) % 2 == 1
        inside = was_in | F.coalesce(start, F.lit(False))
        s = s.withColumn("_ff_in", inside).drop("_ff_b", "_ff_turns", "_ff_mk", "_ff_prev")
    else:
        marked = df.withColumn("_ff_mk", F.when(start & end, F.raise_error(F.lit(
            "a row matches both markers: pass overlap=True"))).when(start, F.lit("S")).when(end, F.lit("E")))
        s = running(marked, keys, order, chunk, carries_before={"_ff_prev": F.col("_ff_mk")})
        s = s.withColumn("_ff_in", F.coalesce((F.col("_ff_mk") == "S") | (F.col("_ff_prev") == "S"), F.lit(False))
                         ).drop("_ff_mk", "_ff_prev")
    if keep_flag:
        return s.withColumn(keep_flag, ~F.col("_ff_in")).drop("_ff_in", VOLUME_COLUMN)
    return s.where(~F.col("_ff_in")).drop("_ff_in", VOLUME_COLUMN)


def inflight(intervals: DataFrame, keys: Sequence[str], start: str, end: str,
             cap: int = MAX_CONCURRENT, chunk_seconds: int = 86400 * 365) -> DataFrame:
    """W8 concurrency per key over half-open ``[start, end)`` intervals.

    Each interval adds one at ``start`` and takes one at ``end``; the changes
    are summed per key and time before the shuffle, and a running sum over
    these gives the level from each time on.  Returns per key
    ``n_intervals``, ``peak``, ``seconds_above_cap`` - the total time the
    level exceeded ``cap``, summed from its crossings - and ``n_invalid``:
    intervals that end before they start or lack a bound, which count as
    nothing else.  A key with only such intervals has a null ``peak``.
    """
    keys = list(keys)
    valid = F.coalesce(F.col(end) >= F.col(start), F.lit(False))
    edges = F.when(valid, F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("d"), F.lit(1).alias("n"), F.lit(0).alias("x")),
        F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("x"))))
    edges = edges.otherwise(F.array(F.struct(F.lit(None).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("n"),
                                             F.lit(1).alias("x"))))
    net = (intervals.select(*keys, F.explode(edges).alias("_ff_e"))
           .groupBy(*keys, F.col("_ff_e.t").alias("_ff_t"))
           .agg(F.sum("_ff_e.d").alias("_ff_d"), F.sum("_ff_e.n").alias("_ff_n"), F.sum("_ff_e.x").alias("_ff_x")))
    net = materialize(net, "inflight")  # the scan reads it twice, the intervals are often a join
    tdt = dtype_of(net, "_ff_t")
    s = running(net, keys, ["_ff_t"], time_chunk("_ff_t", chunk_seconds, tdt), sums={"_ff_lvl": F.col("_ff_d")})
    secs, before = epoch_seconds("_ff_t", tdt), F.col("_ff_lvl") - F.col("_ff_d")
    crossing = (F.when((before > cap) & (F.col("_ff_lvl") <= cap), secs)
                 .when((before <= cap) & (F.col("_ff_lvl") > cap), -secs))
    return s.groupBy(*keys).agg(
        F.sum("_ff_n").cast("long").alias("n_intervals"),
        F.max(F.when(F.col("_ff_t").isNotNull(), F.col("_ff_lvl"))).cast("long").alias("peak"),
        F.coalesce(F.sum(crossing), F.lit(0)).cast("long").alias("seconds_above_cap"),
        F.sum("_ff_x").cast("long").alias("n_invalid"))


__all__ = ["elect", "primary", "carry", "retry_outcome", "context", "drop_ranges",
           "inflight", "last_wins", "INIT_COMMAND", "BOOTSTRAP_COMMAND"]
