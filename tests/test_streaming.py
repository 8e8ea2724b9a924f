"""Streaming semantics that the batch twins cannot show: rows arriving after
the watermark has passed them are dropped, and a replayed sink is not
duplicated."""

import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from fleetframe.functions.time import as_instant
from fleetframe.streaming.monitors import (run_to_table, stream_dedup, stream_down, stream_levels, stream_retry,
                                           with_event_time)

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, name))


def test_late_rows_are_dropped(spark):
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    t0 = dt.datetime(2024, 1, 2, 12, 0, 0)
    # batch 0: recent rows (the watermark moves to 11:05); batch 1: a repeat
    # of a recent key, dropped as a duplicate; batch 2: a row three hours
    # behind.  Spark filters late rows with the watermark of the batch
    # before the last, so the late row comes two batches after it moved.
    _write(spark, src, "a", [(1, t0, 7, "view"), (2, t0 + dt.timedelta(minutes=5), 8, "click")])
    time.sleep(1.1)
    _write(spark, src, "b", [(3, t0, 7, "view"), (5, t0 + dt.timedelta(minutes=6), 9, "error")])
    time.sleep(1.1)
    _write(spark, src, "c", [(4, t0 - dt.timedelta(hours=3), 9, "error")])
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src))
    minute = F.timestamp_seconds(F.floor(F.unix_seconds(as_instant("ts", "timestamp_ntz")) / 60) * 60)
    ev = stream.withColumn("minute", minute).withWatermark("minute", "1 hour")
    out = run_to_table(stream_dedup(ev, ["user_id", "event_type", "minute"], event_time="minute")
                       .select("event_id", "user_id", "event_type"), "late-dedup", mode="append")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 5]


def test_append_windows_close_with_the_watermark(spark):
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    t0 = dt.datetime(2024, 1, 2, 12, 0, 0)
    _write(spark, src, "a", [(1, t0, 1, "error"), (2, t0 + dt.timedelta(minutes=1), 1, "error")])
    time.sleep(1.1)
    _write(spark, src, "b", [(3, t0 + dt.timedelta(hours=3), 1, "error")])
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src))
    ev = with_event_time(stream, "ts", "10 minutes")
    out = run_to_table(stream_levels(ev, "ts", "event_type", "1 hour"), "late-levels", mode="append")
    rows = {(r["w"]["start"].hour, r["n"]) for r in out.collect()}
    # the 12:00 window closed once the 15:00 row moved the watermark; the
    # 15:00 window is still open, so append mode has not emitted it
    assert rows == {(12, 2)}


def _stream(spark, src):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(src))


def test_restart_goes_on_where_it_stopped_and_outages_alert(spark, tmp_path):
    src, sink = tempfile.mkdtemp(prefix="ff-stream-src-"), str(tmp_path / "down")
    t0 = dt.datetime(2024, 1, 2, 12, 0, 0)
    placement = spark.createDataFrame([("om",), ("scm",)], "event_type string")

    def run():
        out = stream_down(with_event_time(_stream(spark, src), "ts", "10 minutes"), placement, ["event_type"],
                          width="1 hour", path=sink)
        return {(r.window_start.hour, r.event_type) for r in out.collect()}
    _write(spark, src, "a", [(1, t0, 1, "om"), (2, t0 + dt.timedelta(minutes=90), 1, "om")])
    assert run() == {(12, "scm")}          # 13:00 is still open
    time.sleep(1.1)
    _write(spark, src, "b", [(3, t0 + dt.timedelta(hours=3), 1, "scm"), (4, t0 + dt.timedelta(hours=5), 1, "om")])
    # nothing was seen from 14:00 to 15:00
    assert run() == {(12, "scm"), (13, "scm"), (14, "om"), (14, "scm"), (15, "om")}
    before = sorted(p.name for p in (tmp_path / "down").glob("span=*"))
    assert len(before) >= 2
    # a third run judges the new windows only, from 16:00 to the newest that is closed
    time.sleep(1.1)
    _write(spark, src, "c", [(5, t0 + dt.timedelta(hours=9), 1, "om")])
    old = {p: os.path.getmtime(tmp_path / "down" / p / "_SUCCESS") for p in before}
    assert run() == {(12, "scm"), (13, "scm"), (14, "om"), (14, "scm"), (15, "om"), (16, "om"), (16, "scm"), (17, "scm")}
    assert all(os.path.getmtime(tmp_path / "down" / p / "_SUCCESS") == t for p, t in old.items())


def test_replayed_batches_judge_the_same_windows(spark, tmp_path):
    """A crash after the sink was written and before the batch was committed."""
    src, sink = tempfile.mkdtemp(prefix="ff-stream-src-"), tmp_path / "down"
    t0 = dt.datetime(2024, 1, 2, 12, 0, 0)
    placement = spark.createDataFrame([("om",), ("scm",)], "event_type string")

    def run():
        return sorted((r.window_start.hour, r.event_type) for r in stream_down(
            with_event_time(_stream(spark, src), "ts", "10 minutes"), placement, ["event_type"], width="1 hour",
            path=str(sink)).collect())
    for i, name in enumerate("abc"):
        _write(spark, src, name, [(i, t0 + dt.timedelta(hours=2 * i), 1, "om")])
        time.sleep(1.1)
    first = run()
    commits = tmp_path / "down_checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in (commits / str(last), commits / f".{last}.crc"):
        p.unlink()
    assert run() == first and (13, "om") in first and (12, "scm") in first


def test_sink_of_many_batches_has_few_folders(spark, tmp_path):
    from fleetframe.streaming.sink import Sink
    sink, schema = Sink(spark, str(tmp_path / "s")), "n long"
    row = spark.range(1)
    spark.sparkContext.setLogLevel("ERROR")
    for b in range(130):
        sink.compact(b, schema)
        sink.write(row.selectExpr(f"id + {b} AS n").coalesce(1), b)
        if b == 57:  # a merge cut off before its parts were deleted, and one before it was complete
            import shutil
            spans = sink.live()
            shutil.copytree(tmp_path / "s" / "span=0-9", tmp_path / "s" / "span=3-3")
            (tmp_path / "s" / "span=50-59").mkdir()
            assert sink.live() == spans
    assert sorted(r.n for r in sink.read(schema).collect()) == list(range(130))
    assert len(list((tmp_path / "s").glob("span=*"))) <= 24 and (0, 99) in sink.live()
    assert sorted(r.n for r in sink.read(schema, before=100).collect()) == list(range(100))


def _polls(spark, src, name, rows):
    spark.createDataFrame([(i, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=t), k, e) for i, t, k, e in rows],
                          SCHEMA).coalesce(1).write.parquet(os.path.join(src, name))
    time.sleep(1.1)


def test_waits_end_once_and_free_their_state(spark, tmp_path):
    from fleetframe.streaming.monitors import COUNTERS_SCHEMA, run_stream, stream_poll_outcome
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    keys = range(1, 41)
    _polls(spark, src, "a", [(k, k, k, "wait") for k in keys])                       # 40 waits begin
    _polls(spark, src, "b", [(100 + k, 60 + k, k, "exit" if k <= 10 else "wait") for k in keys if k <= 20])
    _polls(spark, src, "c", [(200, 500, 99, "wait")])
    _polls(spark, src, "d", [(300, 2000, 99, "wait"), (301, 2010, 1, "wait"), (302, 2011, 1, "wait")])
    _polls(spark, src, "e", [(400, 2500, 98, "wait")])

    def run():
        r = stream_poll_outcome(with_event_time(_stream(spark, src), "ts", "1 second"), ["user_id"], "ts", "event_id",
                                F.col("event_type") == "exit", max_attempts=3, wait_seconds=600)
        rows, counters = run_stream(r, "waits", path=str(tmp_path / "waits"))
        found = rows.read(r.schema).collect()
        assert len({(x.user_id, x.started) for x in found}) == len(found)  # each wait ends once
        return ([(x.user_id, x.outcome, x.attempts, int((x.ended - x.started).total_seconds())) for x in found],
                {x.batch: x.n for x in counters.read(COUNTERS_SCHEMA).where("counter = 'state_rows'").collect()})
    got, state = run()
    assert sorted(x for x in got if x[0] <= 10) == [(k, "EXITED", 2, 60) for k in range(1, 11)]
    assert sorted(x for x in got if 10 < x[0] <= 40) == [(k, "TIMEOUT", 2 if k <= 20 else 1, 600) for k in range(11, 41)]
    assert [x for x in got if x[0] == 99] == [(99, "TIMEOUT", 1, 600)]
    sizes = [state[b] for b in sorted(state)]
    assert max(sizes) == 40 and sizes[-1] <= 3       # 1, 98 and 99 still wait
    _polls(spark, src, "f", [(500, 2020, 1, "wait"), (501, 9000, 7, "exit")])  # the second is late by then or the third poll
    again, _ = run()
    assert len(again) > len(got) and set(got) <= set(again) and (7, "EXITED", 1, 0) in again


def test_latest_of_a_stretch_closes_when_idle(spark):
    from fleetframe.streaming.monitors import stream_latest_idle
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    _polls(spark, src, "a", [(1, 0, 1, "x"), (2, 100, 1, "y"), (3, 50, 2, "z")])
    _polls(spark, src, "b", [(4, 3000, 1, "w")])
    r = stream_latest_idle(with_event_time(_stream(spark, src), "ts", "1 second"), ["user_id"], "ts", "event_id",
                           ["event_type"], "10 minutes")
    got = {(x.user_id, x.latest.event_type, x.n) for x in run_to_table(r, "idle").collect()}
    assert got == {(1, "y", 2), (2, "z", 1)}


def test_counters_of_malformed_late_and_repeated_rows(spark, tmp_path):
    from fleetframe.streaming.monitors import run_stream, total_of
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    _polls(spark, src, "a", [(1, 7200, 1, "x"), (2, 7200, 1, "x"), (3, 7200, None, "x")])
    _polls(spark, src, "b", [(4, 7201, 1, "y")])
    _polls(spark, src, "c", [(5, 10, 1, "x"), (6, 7202, None, "x")])
    seen = _stream(spark, src).observe("lines", F.count(F.lit(1)).alias("lines"), F.count_if(F.col("user_id").isNull()).alias("bad"))
    ev = with_event_time(seen.where("user_id is not null"), "ts", "1 minute")
    r = stream_dedup(ev, ["user_id", "event_type", "ts"], event_time="ts").select("event_type")
    for _ in range(2):  # the second run has nothing to add
        _, counters = run_stream(r, "count", path=str(tmp_path / "count"))
    got = {c: total_of(counters, c).first().n for c in ("lines", "bad", "rows_late", "rows_repeated")}
    assert got == {"lines": 6, "bad": 2, "rows_late": 1, "rows_repeated": 1}


def test_complete_keeps_all_keys_and_update_is_refused(spark):
    import pytest
    src = tempfile.mkdtemp(prefix="ff-stream-src-")
    t0 = dt.datetime(2024, 1, 2, 12, 0, 0)
    _write(spark, src, "a", [(1, t0, 1, "view"), (2, t0, 2, "view")])
    time.sleep(1.1)
    _write(spark, src, "b", [(3, t0, 1, "view")])
    r = stream_retry(_stream(spark, src), ["user_id"], "ts", F.col("event_type") == "x")
    assert {x.user_id: x.polls for x in run_to_table(r, "retry-all", mode="complete").collect()} == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        run_to_table(r, "retry-all", mode="update")
