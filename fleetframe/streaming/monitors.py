"""Structured Streaming monitors.

Library functions take a streaming DataFrame and return a streaming
DataFrame (T6 runs its stream and compares the closed windows).  Event time is
cast to ``timestamp`` because watermarks need it.  Results are written with
``foreachBatch`` to a folder under the session's checkpoint directory, so
nothing is collected through the driver; :func:`run_to_table` reads the
sink back as a batch DataFrame.

The ``st_*`` checks stream the driver's ``events`` file with
``trigger(availableNow=True)`` and are compared with their batch twins in
:data:`STREAM_ORACLE_SQL`.  Windows and sessions are written once the
watermark has passed them; the batch twins leave out those still open.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.functions.time import as_instant, as_wall_clock, dtype_of
from fleetframe.session import scratch_path
from fleetframe.sources.records import parse_run_log
from fleetframe.streaming.sink import Sink

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                 "value double, props string")
TS_FMT = "yyyy-MM-dd HH:mm:ss"
DUCK_TS = "'%Y-%m-%d %H:%M:%S'"
MAX_POLL_ATTEMPTS = 60


# ---------------------------------------------------------------- plumbing

def table_stream(spark: SparkSession, folder: str, name: str, schema: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``<folder>/<name>.parquet`` (new files matching the
    name are picked up as they arrive)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


#: Counters of a query's progress: rows that came behind the watermark, repeats
#: dropped, and keyed rows held as state after the batch.
COUNTERS_SCHEMA = "batch long, counter string, n long"


def _counted(progress) -> list[tuple[int, str, int]]:
    """The counters of one batch's progress: what :meth:`DataFrame.observe`
    was asked for, and what Spark's stateful operators dropped and hold."""
    out = [(progress.batchId, name, int(n or 0)) for row in progress.observedMetrics.values()
           for name, n in row.asDict().items()]
    ops = progress.stateOperators
    if ops:
        out += [(progress.batchId, "rows_late", sum(o.numRowsDroppedByWatermark for o in ops)),
                (progress.batchId, "rows_repeated", sum(int(o.customMetrics.get("numDroppedDuplicateRows", 0)) for o in ops)),
                (progress.batchId, "state_rows", sum(o.numRowsTotal for o in ops))]
    return out


def run_stream(sdf: DataFrame, name: str, mode: str = "append", path: str | None = None,
               batch_fn: Callable[[DataFrame, int], DataFrame] | None = None, schema=None) -> tuple[Sink, Sink]:
    """Run ``sdf`` until the available input is processed; returns the sinks
    of its rows and of its counters (``COUNTERS_SCHEMA``).

    Append output (the mode for windows, sessions and dedup: the watermark
    closes them and frees their state) writes each micro-batch to the sink; a
    batch replayed after a failure (``foreachBatch`` is at-least-once)
    replaces itself.  Complete output (a bounded number of keys, no
    watermark) replaces the sink's content.  Update output holds only the
    changed keys; it is taken from a query whose rows are final
    (``batch_fn`` or timed state), never from a plain aggregate.

    ``path`` names the sink folder; the query's checkpoint and its counters
    are beside it, so a job started again with the same ``path`` goes on where
    it stopped.  Without it all are scratch and go with the application.
    Counters are written when the next batch begins: a driver lost right then
    loses one batch's.
    """
    spark = sdf.sparkSession
    out = path.rstrip("/") if path else scratch_path(spark, name)
    state = out + "_checkpoint" if path else scratch_path(spark, name + "-checkpoint")
    rows = Sink(spark, out)
    counters = Sink(spark, out + "_counters" if path else scratch_path(spark, name + "-counters"))
    schema = schema or sdf.schema
    running: list = []
    noted: set[int] = set()

    def note() -> None:
        """Write the counters of batches that have ended since the last call."""
        found = [p for q in running for p in q.recentProgress if p.batchId not in noted]
        for batch in sorted({p.batchId for p in found}):
            noted.add(batch)
            mine = [x for p in found if p.batchId == batch for x in _counted(p)]
            if mine:
                # an idle trigger reports the batch before it once more
                best = {c: n for _, c, n in mine}
                counters.write(spark.createDataFrame([(batch, c, n) for c, n in best.items()], COUNTERS_SCHEMA).coalesce(1),
                               batch)
                counters.compact(batch, COUNTERS_SCHEMA)

    def each(batch: DataFrame, epoch: int) -> None:
        note()
        if mode == "complete":
            rows.forget(epoch)
        else:
            rows.compact(epoch, schema)
        rows.write(batch_fn(batch, epoch) if batch_fn else batch, epoch)

    q = (sdf.writeStream.outputMode(mode).foreachBatch(each)
             .option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    running.append(q)
    q.awaitTermination()
    note()
    return rows, counters


def run_to_table(sdf: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """:func:`run_stream`, and its rows as a batch DataFrame."""
    if mode not in ("append", "complete"):
        raise ValueError(f"output mode {mode!r} would leave keys out: use append or complete")
    rows, _ = run_stream(sdf, name, mode, path)
    return rows.last(sdf.schema) if mode == "complete" else rows.read(sdf.schema)


def total_of(counters: Sink, counter: str) -> DataFrame:
    """One row ``n``: a counter summed over all batches."""
    return counters.read(COUNTERS_SCHEMA).where(F.col("counter") == counter).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time with a watermark.  Wall-clock (``timestamp_ntz``) stamps
    are read as UTC instants, so windows do not depend on the session zone;
    :func:`wall` turns window bounds back into wall-clock values."""
    return df.withColumn(ts, as_instant(ts, dtype_of(df, ts))).withWatermark(ts, delay)


def wall(col) -> Column:
    """Format an event-time instant (from :func:`with_event_time`) as its
    wall-clock text."""
    return F.date_format(as_wall_clock(col), TS_FMT)


# ---------------------------------------------------------------- monitors

def stream_retry(polls: DataFrame, key: Sequence[str], ts: str, exited: Column,
                 max_attempts: int = MAX_POLL_ATTEMPTS) -> DataFrame:
    """Per key, polls so far, time of the first exit and a timeout flag
    (no exit after ``max_attempts`` polls).  Built-in streaming aggregate."""
    return (polls.groupBy(*key)
                 .agg(F.count(F.lit(1)).alias("polls"),
                      F.min(F.when(exited, F.col(ts))).alias("first_exit"))
                 .withColumn("timed_out", F.col("first_exit").isNull()
                             & (F.col("polls") >= F.lit(max_attempts))))


#: Rows of :func:`stream_poll_outcome` besides the key.
OUTCOME_FIELDS = "started timestamp, outcome string, attempts long, ended timestamp"
_OUTCOME_STATE = "started long, attempts long"


def _wait(max_attempts: int, wait_micros: int, names: list[str]):
    """The state function of :func:`stream_poll_outcome`: one key's polls of a
    batch in their order, after what earlier batches left."""
    import pandas as pd

    def run(key, frames, state):
        started, attempts = state.get if state.exists else (None, 0)
        done = []

        def end(outcome, at):
            nonlocal started, attempts
            done.append((*key, started, outcome, attempts, at))
            started, attempts = None, 0
        if state.hasTimedOut:
            end("TIMEOUT", started + wait_micros)
        polls = [(t, o, x) for f in frames for t, o, x in zip(f["_ff_t"].tolist(), f["_ff_o"].tolist(), f["_ff_x"].tolist())]
        for t, _, exited in sorted(polls, key=lambda p: p[:2]):
            if started is not None and t > started + wait_micros:
                end("TIMEOUT", started + wait_micros)
            started, attempts = t if started is None else started, attempts + 1
            if exited:
                end("EXITED", t)
            elif attempts >= max_attempts:
                end("TIMEOUT", t)
        if started is None:
            if state.exists:
                state.remove()
        else:
            state.update((started, attempts))
            state.setTimeoutTimestamp(max((started + wait_micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if done:
            frame = pd.DataFrame(done, columns=names)
            for c in ("started", "ended"):
                frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="us", utc=True)
            yield frame
    return run


def stream_poll_outcome(polls: DataFrame, key: Sequence[str], ts: str, tiebreak: str, exited: Column,
                        max_attempts: int = MAX_POLL_ATTEMPTS, wait_seconds: int = 600) -> DataFrame:
    """T1 with an end: per key and wait ``(key, started, outcome, attempts,
    ended)``, put out once.

    A wait begins with the key's first poll and ends with the first of: a poll
    that ``exited`` (EXITED), the ``max_attempts``-th poll, or ``wait_seconds``
    after it began (both TIMEOUT).  The last needs no further poll: the
    watermark on ``ts`` passing that moment ends the wait.  Its state is freed
    at the end; the key's next poll begins another wait.

    Polls of a key are put in order within a batch (a batch's polls of one key
    are held by a task: bound a trigger's input); across batches they are
    taken as they come, and those behind the watermark are dropped.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    key = list(key)
    fields = ", ".join([*[f"`{k}` {polls.schema[k].dataType.simpleString()}" for k in key], OUTCOME_FIELDS])
    narrow = polls.select(*key, ts, F.unix_micros(ts).alias("_ff_t"), F.col(tiebreak).alias("_ff_o"),
                          F.coalesce(exited, F.lit(False)).alias("_ff_x"))
    names = [*key, "started", "outcome", "attempts", "ended"]
    return narrow.groupBy(*key).applyInPandasWithState(
        _wait(max_attempts, wait_seconds * 1_000_000, names), fields, _OUTCOME_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_latest_idle(steps: DataFrame, key: Sequence[str], ts: str, tiebreak: str, values: Sequence[str],
                       idle: str) -> DataFrame:
    """T3 with an end: the latest step of each stretch of a key's activity,
    put out when nothing has come for ``idle`` (by the watermark on ``ts``);
    a session's state is freed with it."""
    v = F.struct(*[F.col(c) for c in values])
    return (steps.groupBy(*key, F.session_window(ts, idle).alias("s"))
            .agg(F.max_by(v, F.struct(F.col(ts), F.col(tiebreak))).alias("latest"), F.count(F.lit(1)).alias("n")))


def stream_levels(log: DataFrame, ts: str, level: str, width: str) -> DataFrame:
    """Log lines per level in tumbling windows."""
    return log.groupBy(F.window(ts, width).alias("w"), level).agg(F.count(F.lit(1)).alias("n"))


def stream_latest(steps: DataFrame, key: Sequence[str], ts: str, tiebreak: str,
                  values: Sequence[str]) -> DataFrame:
    """Latest step per key (``max_by`` on ``(ts, tiebreak)``)."""
    v = F.struct(*[F.col(c) for c in values])
    return steps.groupBy(*key).agg(F.max_by(v, F.struct(F.col(ts), F.col(tiebreak))).alias("latest"))


def stream_sessions(log: DataFrame, key: Sequence[str], ts: str, gap: str) -> DataFrame:
    """T4: gap-based sessions per key."""
    return log.groupBy(*key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))


def stream_dedup(df: DataFrame, keys: Sequence[str], event_time: str | None = None) -> DataFrame:
    """T5 duplicate and late rows.

    With ``event_time`` (the watermarked column, made part of the keys):
    exact duplicates of the keys are dropped, rows older than the watermark
    are dropped as late (Spark checks lateness against the watermark of the
    batch before the last), and the state is evicted as the watermark passes.
    Without it: ``dropDuplicatesWithinWatermark`` - a repeat of the keys
    within the watermark delay of its first occurrence is dropped; rows are
    not filtered for lateness in this mode.
    """
    keys = list(keys)
    if event_time:
        return df.dropDuplicates(keys if event_time in keys else [*keys, event_time])
    return df.dropDuplicatesWithinWatermark(keys)


def stream_fail_rate(steps: DataFrame, ts: str, failed: Column, length: str, slide: str) -> DataFrame:
    """Failure rate in sliding windows."""
    return (steps.groupBy(F.window(ts, length, slide).alias("w"))
                 .agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"))
                 .withColumn("fail_rate", F.round(F.col("n_failed") / F.col("n"), 4)))


def down_in_windows(seen: DataFrame, placement: DataFrame, keys: Sequence[str],
                    window_col: str = "window_start", width: str = "1 day") -> DataFrame:
    """T6 over a table: every placed ``keys`` row for every window of the
    calendar from the first to the last window seen, minus the ones seen.

    The calendar holds the windows in which nothing at all was seen, so a
    total outage is reported for every placed row.
    """
    keys = list(keys)
    bounds = seen.agg(F.min(window_col).alias("_a"), F.max(window_col).alias("_z")).filter("_a is not null")
    calendar = bounds.select(F.explode(F.sequence("_a", "_z", F.expr(f"INTERVAL {width}"))).alias(window_col))
    expected = placement.select(*keys).distinct().crossJoin(calendar)
    return expected.join(seen.select(window_col, *keys).distinct(), [window_col, *keys], "left_anti")


def stream_down(procs: DataFrame, placement: DataFrame, keys: Sequence[str], ts: str = "ts",
                width: str = "1 day", path: str | None = None) -> DataFrame:
    """``(window_start, keys)`` of every placed row that a closed window
    has no sighting of.

    ``procs`` is a stream of sightings with a watermark on ``ts``.  Sightings
    are reduced per window and key; a batch holds the windows that the
    watermark has closed since the last one and judges only these: all windows
    from the one after the last judged up to the newest closed, those without
    any sighting included, so a total outage alerts for every placed row.  Of
    earlier batches only that last window is read, from the sink's own rows,
    so a replayed batch judges the same windows again and replaces its alerts.
    Called again with the same ``path`` it reads the new input only.
    """
    keys = list(keys)
    spark = procs.sparkSession
    seen = (procs.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), *keys))
    out = path.rstrip("/") if path else scratch_path(spark, "stream-down")
    judged_schema = "newest long"  # microseconds
    judged = Sink(spark, out + "_judged")
    zero = "TIMESTAMP '1970-01-02 00:00:00'"
    step = spark.sql(f"SELECT unix_micros({zero} + INTERVAL {width}) - unix_micros({zero})").first()[0]
    placed = placement.select(*keys).distinct()

    def judge(batch: DataFrame, epoch: int) -> DataFrame:
        batch = batch.select("window_start", *keys).distinct()
        start = F.unix_micros("window_start")
        first, newest = batch.agg(F.min(start), F.max(start)).first()
        last = judged.read(judged_schema, before=epoch).agg(F.max("newest")).first()[0]
        judged.compact(epoch, judged_schema)
        judged.write(spark.createDataFrame([(last if newest is None else newest,)], judged_schema).coalesce(1), epoch)
        first = first if last is None else last + step
        if newest is None or first > newest:
            return batch.limit(0)
        windows = F.transform(F.sequence(F.lit(first), F.lit(newest), F.lit(step)), F.timestamp_micros)
        expected = placed.select(F.explode(windows).alias("window_start"), *keys)
        return expected.join(batch, ["window_start", *keys], "left_anti")
    rows, _ = run_stream(seen, "stream-down", path=out, batch_fn=judge, schema=seen.schema)
    return rows.read(seen.schema)


# ---------------------------------------------------------------- checks

def _events(spark, sf):
    return with_event_time(table_stream(spark, sf, "events", EVENTS_SCHEMA))


def st_retry(spark, sf):
    r = stream_retry(_events(spark, sf), ["user_id"], "ts", F.col("event_type") == "purchase")
    out = run_to_table(r, "st_retry", mode="complete")
    return out.select("user_id", "polls", wall("first_exit").alias("first_exit"), "timed_out")


def st_tumbling(spark, sf):
    from fleetframe.plans.checks import compose_log_line
    e = table_stream(spark, sf, "events", EVENTS_SCHEMA)
    # a line without a time stamp belongs to no window
    parsed = parse_run_log(e.select(compose_log_line(e).alias("line")))
    counted = parsed.observe("lines", F.count(F.lit(1)).alias("lines"),
                             F.count_if(F.col("ts").isNull()).alias("lines_malformed"))
    log = with_event_time(counted.where(F.col("ts").isNotNull()), "ts")
    levels = stream_levels(log, "ts", "level", "1 hour")
    rows, counters = run_stream(levels, "st_tumbling")
    lost = [total_of(counters, c).select(F.lit(None).cast("string").alias("window_start"), F.lit(c).alias("level"), "n")
            for c in ("lines_malformed", "rows_late")]
    out = rows.read(levels.schema).select(wall("w.start").alias("window_start"), "level", "n")
    return out.unionByName(lost[0]).unionByName(lost[1])


def st_latest(spark, sf):
    r = stream_latest(_events(spark, sf), ["user_id"], "ts", "event_id", ["event_type", "event_id"])
    out = run_to_table(r, "st_latest", mode="complete")
    return out.select("user_id", F.col("latest.event_type").alias("latest_type"),
                      F.col("latest.event_id").alias("latest_event_id"))


def st_session(spark, sf):
    r = stream_sessions(_events(spark, sf), ["user_id"], "ts", "30 minutes")
    out = run_to_table(r, "st_session")
    return out.select("user_id", wall("s.start").alias("session_start"),
                      wall("s.end").alias("session_end"), "n")


def st_dedup(spark, sf):
    e = table_stream(spark, sf, "events", EVENTS_SCHEMA)
    minute = F.timestamp_seconds(F.floor(F.unix_seconds(as_instant("ts", "timestamp_ntz")) / 60) * 60)
    e = e.withColumn("minute", minute).withWatermark("minute", "1 hour")
    r = (stream_dedup(e, ["user_id", "event_type", "minute"], event_time="minute")
         .select("user_id", "event_type", "minute"))
    rows, counters = run_stream(r, "st_dedup")
    out = rows.read(r.schema).select("user_id", "event_type", wall("minute").alias("minute"), F.lit(1).cast("long").alias("n"))
    for c in ("rows_repeated", "rows_late"):
        out = out.unionByName(total_of(counters, c).select(
            F.lit(None).cast("long").alias("user_id"), F.lit(c).alias("event_type"), F.lit(None).cast("string").alias("minute"), "n"))
    return out


def st_down(spark, sf):
    """Types of event that a user has sent on some day, and not on
    another: every user and type, every closed day."""
    placement = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("user_id", "event_type").distinct()
    out = stream_down(_events(spark, sf), placement, ["user_id", "event_type"])
    return out.select(wall("window_start").alias("window_start"), "user_id", "event_type")


def st_poll_outcome(spark, sf):
    """T1 with an end: waits of at most five events or two days for a
    purchase, for every user."""
    r = stream_poll_outcome(_events(spark, sf), ["user_id"], "ts", "event_id", F.col("event_type") == "purchase",
                            max_attempts=5, wait_seconds=2 * 86400)
    out = run_to_table(r, "st_poll_outcome")
    return out.select("user_id", wall("started").alias("started"), "outcome", "attempts", wall("ended").alias("ended"))


def st_latest_idle(spark, sf):
    """T3 with an end: a user's latest event of each stretch without a pause
    of twelve hours."""
    r = stream_latest_idle(_events(spark, sf), ["user_id"], "ts", "event_id", ["event_type", "event_id"], "12 hours")
    out = run_to_table(r, "st_latest_idle")
    return out.select("user_id", wall("s.start").alias("started"), F.col("latest.event_type").alias("latest_type"),
                      F.col("latest.event_id").alias("latest_event_id"), "n")


def st_sliding(spark, sf):
    r = stream_fail_rate(_events(spark, sf), "ts", F.col("event_type") == "error", "1 hour", "30 minutes")
    out = run_to_table(r, "st_sliding")
    return out.select(wall("w.start").alias("window_start"), "n", "n_failed", "fail_rate")


STREAM_CHECKS = {
    "st_retry": st_retry,        # T1
    "st_tumbling": st_tumbling,  # T2
    "st_latest": st_latest,      # T3
    "st_session": st_session,    # T4
    "st_dedup": st_dedup,        # T5
    "st_down": st_down,          # T6
    "st_sliding": st_sliding,    # T7
    "st_poll_outcome": st_poll_outcome,  # T1, timed
    "st_latest_idle": st_latest_idle,    # T3, timed
}

STREAM_ORACLE_SQL = {
    "st_retry": f"""
SELECT user_id, count(*) AS polls,
       strftime(min(ts) FILTER (WHERE event_type = 'purchase'), {DUCK_TS}) AS first_exit,
       (min(ts) FILTER (WHERE event_type = 'purchase') IS NULL AND count(*) >= {MAX_POLL_ATTEMPTS}) AS timed_out
FROM events GROUP BY user_id
""",
    "st_tumbling": f"""
SELECT strftime(date_trunc('hour', ts), {DUCK_TS}) AS window_start,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO'
                       ELSE 'LOG' END AS level, count(*) AS n
FROM events WHERE event_type <> 'signup' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <=
  (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type <> 'signup') GROUP BY ALL
UNION ALL SELECT NULL, 'lines_malformed', count(*) FROM events WHERE event_type = 'signup'
UNION ALL SELECT NULL, 'rows_late', 0
""",
    "st_latest": """
SELECT user_id, event_type AS latest_type, event_id AS latest_event_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""",
    "st_session": f"""
WITH e AS (SELECT user_id, ts, event_id,
                  CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM e)
SELECT user_id, strftime(min(ts), {DUCK_TS}) AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, {DUCK_TS}) AS session_end, count(*) AS n
FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""",
    "st_dedup": f"""
WITH d AS (SELECT DISTINCT user_id, event_type, strftime(date_trunc('minute', ts), {DUCK_TS}) AS minute FROM events)
SELECT user_id, event_type, minute, 1::BIGINT AS n FROM d
UNION ALL SELECT NULL, 'rows_repeated', NULL, (SELECT count(*) FROM events) - (SELECT count(*) FROM d)
UNION ALL SELECT NULL, 'rows_late', NULL, 0
""",
    "st_down": f"""
WITH e AS (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS ws FROM events),
seen AS (SELECT * FROM e WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
w AS (SELECT unnest(generate_series((SELECT min(ws) FROM seen), (SELECT max(ws) FROM seen), INTERVAL 1 DAY)) AS ws)
SELECT strftime(w.ws, {DUCK_TS}) AS window_start, p.user_id, p.event_type
FROM (SELECT DISTINCT user_id, event_type FROM events) p CROSS JOIN w
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.event_type = p.event_type AND s.ws = w.ws)
""",
    "st_poll_outcome": f"""
WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'purchase' AS x,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT a.user_id, a.i, a.ts, min(b.i) FILTER (WHERE b.x AND b.ts <= a.ts + INTERVAL 2 DAY AND b.i < a.i + 5) AS exited,
             min(b.i) FILTER (WHERE b.i = a.i + 4 AND b.ts <= a.ts + INTERVAL 2 DAY) AS full_,
             min(b.i) FILTER (WHERE b.ts > a.ts + INTERVAL 2 DAY) AS late
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.i >= a.i GROUP BY ALL),
w AS (SELECT *, coalesce(coalesce(exited, full_) + 1, late) AS next FROM n WHERE i = 1
      UNION ALL SELECT n.*, coalesce(coalesce(n.exited, n.full_) + 1, n.late)
      FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.next)
SELECT user_id, strftime(ts, {DUCK_TS}) AS started, CASE WHEN exited IS NULL THEN 'TIMEOUT' ELSE 'EXITED' END AS outcome,
       coalesce(exited - i + 1, full_ - i + 1, late - i, (SELECT count(*) FROM e WHERE e.user_id = w.user_id AND e.i >= w.i)) AS attempts,
       strftime(coalesce((SELECT e.ts FROM e WHERE e.user_id = w.user_id AND e.i = coalesce(w.exited, w.full_)),
                         ts + INTERVAL 2 DAY), {DUCK_TS}) AS ended
FROM w WHERE next IS NOT NULL OR ts + INTERVAL 2 DAY < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""",
    "st_latest_idle": f"""
WITH e AS (SELECT user_id, ts, event_id, event_type,
                  CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS nw
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, strftime(min(ts), {DUCK_TS}) AS started, max_by(event_type, struct_pack(ts, event_id)) AS latest_type,
       max_by(event_id, struct_pack(ts, event_id)) AS latest_event_id, count(*) AS n
FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""",
    "st_sliding": f"""
WITH b AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS s0, event_type FROM events),
w AS (SELECT s0 AS ws, event_type FROM b UNION ALL SELECT s0 - INTERVAL 30 MINUTE, event_type FROM b)
SELECT strftime(ws, {DUCK_TS}) AS window_start, count(*) AS n,
       count(*) FILTER (WHERE event_type = 'error') AS n_failed,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS fail_rate
FROM w WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ws
""",
}

__all__ = ["table_stream", "run_stream", "run_to_table", "total_of", "with_event_time", "stream_retry",
           "stream_poll_outcome", "stream_levels", "stream_latest", "stream_latest_idle", "stream_sessions",
           "stream_dedup", "stream_fail_rate", "down_in_windows", "stream_down", "STREAM_CHECKS", "STREAM_ORACLE_SQL"]
