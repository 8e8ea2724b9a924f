"""Skew-tolerant ordered scans: row numbers, running sums, carry-forward.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of one key to
one task.  When one host, file or cluster holds a third of all rows that task
holds a third of the data.  :func:`running` is a segmented prefix scan
instead.  It

1. splits every key into *chunks* - a monotone bucket of the ordering value
   (for example ``floor(line_no / 100000)`` or a day) - and counts the rows of
   each; chunks with more than ``most`` rows, and only those, are cut further
   by a range partitioning of their rows (Spark samples the cuts);
2. evaluates the windows inside each piece (bounded size, spread over many
   tasks, one shuffle of the input) and writes the rows once;
3. reads back the last row of each piece, which holds the piece's count, sums
   and carried values all together, and adds these up over the pieces of each
   key (one row a piece).  Only keys of several pieces need this;
4. reads the rows once more and adds what comes before their piece.  Keys of
   one piece have no row in that table, so it is small and Spark broadcasts
   it; the rows are not shuffled again.

Results are exact: a cut never splits rows that compare equal on the order,
because chunks and ranges are functions of the order value.

Each key becomes two plain columns, ``coalesce(key, typed default)`` and
``isnull(key)``: rows whose key is null form a group of their own and survive
the equi-join, while hashing and sorting stay on primitive columns (a
``struct`` key makes both markedly slower).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.functions.time import epoch_micros
from fleetframe.session import materialize

_CHUNK = "_ff_chunk"
_SUB = "_ff_sub"
#: Rows of a chunk beyond which it is cut further.
HOT_ROWS = 1 << 18
_DEFAULTS = {"string": "", "boolean": False}
_LOWEST_CHUNK = -(2 ** 62)


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _key_columns(df: DataFrame, keys: Sequence[str]):
    """Plain, null-safe grouping columns for ``keys``."""
    types = dict(df.dtypes)
    exprs, names = [], []
    for i, k in enumerate(keys):
        t = types[k]
        if t in _DEFAULTS:
            default = F.lit(_DEFAULTS[t])
        elif t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            default = F.lit(0).cast(t)
        elif t in ("date", "timestamp", "timestamp_ntz"):
            default = F.lit(0).cast("timestamp").cast(t)
        else:                                   # nested types: keep the value itself
            exprs.append(F.struct(F.col(k)).alias(f"_ff_k{i}"))
            names.append(f"_ff_k{i}")
            continue
        exprs += [F.coalesce(F.col(k), default).alias(f"_ff_k{i}"), F.col(k).isNull().alias(f"_ff_n{i}")]
        names += [f"_ff_k{i}", f"_ff_n{i}"]
    return exprs, names


def time_chunk(col: str | Column, seconds: int = 86400, dtype: str = "timestamp_ntz") -> Column:
    """Chunk a timestamp / timestamp_ntz / date column into fixed spans
    (independent of the session time zone)."""
    return F.floor(epoch_micros(col, dtype) / F.lit(seconds * 1_000_000))


def number_chunk(col: str | Column, width: int = 100_000) -> Column:
    """Chunk an integral position (line number, sequence id) into ranges."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width))


VOLUME_COLUMN = "_ff_volume"


def by_volume(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
              chunks: int | None = None) -> DataFrame:
    """``df`` with a chunk column (``VOLUME_COLUMN``) that cuts it into
    ``chunks`` pieces of about equal numbers of rows.

    The rows are range-partitioned by key and order, so a key that holds most
    of the rows is cut wherever its rows are dense, whatever the order's type
    or spread, and the numbered pieces are written once: a piece's number
    must not change when a task is run again.  The default is the number of
    shuffle partitions.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[F.col(k) for k in keys], *_cols(order))
    return materialize(cut.withColumn(VOLUME_COLUMN, F.spark_partition_id()), "volume-chunks")


def _cut_hot(d: DataFrame, kcols: list[str], order_cols: list[Column], most: int) -> DataFrame:
    """``d`` with ``_SUB``: 0, or for chunks of more than ``most`` rows the
    number of a range of about as many rows."""
    sizes = d.groupBy(*kcols, _CHUNK).agg(F.count(F.lit(1)).alias("_ff_n")).where(F.col("_ff_n") > most)
    hot = materialize(sizes, "scan-hot")  # at most one row for each `most` rows of input; mostly none
    rows = hot.agg(F.sum("_ff_n")).first()[0]
    if not rows:
        return d.withColumn(_SUB, F.lit(0))
    pieces = [*kcols, _CHUNK]
    ranges = (d.join(hot.select(*pieces), pieces, "left_semi")
              .repartitionByRange(-(-int(rows) * 5 // (most * 4)), *pieces, *order_cols)
              .withColumn(_SUB, F.spark_partition_id() + 1))
    # written, as a range's number must not change when a task is run again
    cut = materialize(ranges.select(*d.columns, _SUB), "scan-cut")
    return d.join(hot.select(*pieces), pieces, "left_anti").select(*d.columns, F.lit(0).alias(_SUB)).unionByName(cut)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            chunk: Column, *,
            rank: str | None = None,
            total: str | None = None,
            sums: Mapping[str, Column] | None = None,
            carries: Mapping[str, Column] | None = None,
            carries_before: Mapping[str, Column] | None = None,
            last_rank_where: Mapping[str, Column] | None = None,
            most: int | None = HOT_ROWS) -> DataFrame:
    """Add ordered-scan columns to ``df``.

    Parameters
    ----------
    keys:   partition columns (the sequence each scan restarts on).
    order:  ascending sort columns; should be a total order within a key.
    chunk:  monotone non-decreasing function of ``order`` used to split keys.
    rank:   name of a 1-based row-number column to add.
    total:  name of a column with the number of rows of the row's key.
    sums:   ``{name: expr}`` running sum of ``expr`` up to and including the row.
    carries: ``{name: expr}`` last non-null ``expr`` up to and including the row.
    carries_before: same, but over rows strictly before the current row.
    last_rank_where: ``{name: cond}`` row number of the last row (up to and
            including the current one) where ``cond`` holds.
    most:   rows of a chunk beyond which it is cut by ranges of the order;
            None trusts the chunks to be even and spares the counting, as do
            those of :func:`by_volume`.

    The input is read by two jobs (one without ``most``) before this returns,
    and written once; the frame returned reads what was written.
    """
    sums = dict(sums or {})
    carries = dict(carries or {})
    carries_before = dict(carries_before or {})
    last_rank_where = dict(last_rank_where or {})
    if not (rank or total or sums or carries or carries_before or last_rank_where):
        return df
    order_cols = _cols(order)
    out_cols = list(df.columns)

    key_exprs, kcols = _key_columns(df, keys)
    d = df.select("*", *key_exprs,
                  F.coalesce(chunk.cast("long"), F.lit(_LOWEST_CHUNK)).alias(_CHUNK))
    d = _cut_hot(d, kcols, order_cols, most) if most and VOLUME_COLUMN not in out_cols else d.withColumn(_SUB, F.lit(0))
    pieces = [*kcols, _CHUNK, _SUB]
    w = Window.partitionBy(*pieces).orderBy(*order_cols)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    # the scan inside each piece; all windows share one sort
    local = {"_ff_lr": F.row_number().over(w).cast("long"), "_ff_last": F.lead(F.lit(1)).over(w).isNull()}
    if total:
        local["_ff_all"] = F.count(F.lit(1)).over(Window.partitionBy(*pieces))
    for n, c in sums.items():
        local[f"_ff_s_{n}"] = F.sum(c).over(upto)
    for n, c in (carries | carries_before).items():
        local[f"_ff_c_{n}"] = F.last(c, ignorenulls=True).over(upto)
    for n, c in carries_before.items():
        local[f"_ff_b_{n}"] = F.last(c, ignorenulls=True).over(before)
    scanned = d.withColumns(local)
    if last_rank_where:
        scanned = scanned.withColumns({f"_ff_w_{n}": F.max(F.when(cond, F.col("_ff_lr"))).over(upto)
                                       for n, cond in last_rank_where.items()})
    scanned = materialize(scanned, "scan")

    # what comes before each piece: the last rows of the pieces before it
    names = [f"_ff_s_{n}" for n in sums], [f"_ff_c_{n}" for n in carries | carries_before], [
        f"_ff_w_{n}" for n in last_rank_where]
    last = scanned.where("_ff_last").select(*pieces, "_ff_lr", *names[0], *names[1], *names[2])
    ws = Window.partitionBy(*kcols).orderBy(_CHUNK, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    ahead = last.select(
        *pieces, *names[2], F.count(F.lit(1)).over(Window.partitionBy(*kcols)).alias("_ff_pieces"),
        F.sum("_ff_lr").over(Window.partitionBy(*kcols)).alias("_ff_total"),
        F.coalesce(F.sum("_ff_lr").over(ws), F.lit(0)).alias("_ff_off"),
        *[F.sum(n).over(ws).alias(f"{n}_p") for n in names[0]],
        *[F.last(n, ignorenulls=True).over(ws).alias(f"{n}_p") for n in names[1]]).where("_ff_pieces > 1")
    if last_rank_where:
        ahead = ahead.select("*", *[F.last(F.col("_ff_off") + F.col(n), ignorenulls=True).over(ws).alias(f"{n}_p")
                                    for n in names[2]])
    ahead = materialize(ahead.drop("_ff_pieces", *names[2]), "scan-ahead")  # its size decides how it is joined

    j = scanned.join(ahead, pieces, "left")
    off, extra = F.coalesce("_ff_off", F.lit(0)), []
    if rank:
        extra.append((off + F.col("_ff_lr")).alias(rank))
    if total:
        extra.append(F.coalesce("_ff_total", "_ff_all").alias(total))
    for n in sums:
        mine, prior = F.col(f"_ff_s_{n}"), F.col(f"_ff_s_{n}_p")
        extra.append(F.when(mine.isNull() | prior.isNull(), F.coalesce(mine, prior)).otherwise(mine + prior).alias(n))
    for n in carries:
        extra.append(F.coalesce(f"_ff_c_{n}", f"_ff_c_{n}_p").alias(n))
    for n in carries_before:
        extra.append(F.coalesce(f"_ff_b_{n}", f"_ff_c_{n}_p").alias(n))
    for n in last_rank_where:
        extra.append(F.coalesce(off + F.col(f"_ff_w_{n}"), F.col(f"_ff_w_{n}_p")).alias(n))
    return j.select(*[F.col(c) for c in out_cols], *extra)


__all__ = ["running", "by_volume", "VOLUME_COLUMN", "HOT_ROWS", "time_chunk", "number_chunk"]
