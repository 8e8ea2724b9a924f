"""Session-time-zone independent time helpers.

Fleet logs and the driver tables carry wall-clock ``timestamp_ntz`` values.
Casting those to ``timestamp`` reads them in the session time zone, so the
same job would give different windows (and DST-shifted durations) in
different sessions.  These helpers go through epoch microseconds instead,
treating a wall-clock value as UTC, so results never depend on
``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ntz_epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dtype_of(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]


def epoch_micros(col, dtype: str) -> Column:
    """Microseconds since 1970-01-01 00:00 (UTC for instants, the same wall
    clock for ``timestamp_ntz``)."""
    c = _c(col)
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", _ntz_epoch(), c)
    if dtype == "date":
        return F.timestamp_diff("MICROSECOND", _ntz_epoch(), c.cast("timestamp_ntz"))
    return F.unix_micros(c)


def epoch_seconds(col, dtype: str) -> Column:
    return epoch_micros(col, dtype) / F.lit(1_000_000)


def as_instant(col, dtype: str) -> Column:
    """A ``timestamp`` usable as streaming event time; wall-clock values are
    read as UTC."""
    if dtype == "timestamp":
        return _c(col)
    return F.timestamp_micros(epoch_micros(col, dtype))


def as_wall_clock(col) -> Column:
    """Back from :func:`as_instant`: the UTC wall clock as ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(col)), _ntz_epoch())


__all__ = ["epoch_micros", "epoch_seconds", "as_instant", "as_wall_clock", "dtype_of"]
