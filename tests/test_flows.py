"""Composed flows: install checks and start plan."""

import datetime as dt
import os

from fleetframe.plans.install import compliance, host_eligibility, step_report
from fleetframe.plans.start import endpoints, poll_outcome, start_plan


def test_install_flow(spark):
    facts = spark.createDataFrame([("om1", "om1|10.0.0.1|x86_64|Linux|rocky|9.2"),
                                   ("mac", "mac|10.0.0.2|arm64|Darwin|macos|14")], "host string, raw string")
    got = {r["host"]: r["eligible"] for r in host_eligibility(facts).collect()}
    assert got == {"om1": True, "mac": False}

    settings = spark.createDataFrame([("om1", "selinux", "Enforcing"), ("om1", "swappiness", "1")],
                                     "host string, setting string, raw_value string")
    fs = spark.createDataFrame([("om1", "/data", "ext4", "rw")], "host string, dir string, fs_type string, mount_options string")
    c = {(r["check"], r["setting"]): r["status"] for r in compliance(settings, fs).collect()}
    assert c == {("kernel", "selinux"): "violation", ("kernel", "swappiness"): "ok",
                 ("filesystem:/data", "fs_type"): "ok", ("filesystem:/data", "mount_options"): "violation"}

    lines = spark.createDataFrame([("r1", "SUCCESS:om1"), ("r1", "FAILED:om2:scp"), ("r2", "SUCCESS:om1")],
                                  "run_id string, line string")
    req = spark.createDataFrame([("r1", "om1"), ("r1", "om2"), ("r1", "om3"), ("r2", "om1")],
                                "run_id string, host string")
    summary, failed = step_report(lines, req)
    s = {r["run_id"]: (r["n_ok"], r["n_total"], r["failed_hosts"], r["overall"]) for r in summary.collect()}
    assert s == {"r1": (1, 2, "om2", "PARTIAL"), "r2": (1, 1, "", "SUCCESS")}
    assert {(r["run_id"], r["host"]) for r in failed.collect()} == {("r1", "om2"), ("r1", "om3")}


def test_start_flow(spark):
    placement = spark.createDataFrame([
        ("c", "om", 0, "om1"), ("c", "om", 1, "om2"), ("c", "scm", 0, "scm1"), ("c", "scm", 1, "scm2"),
        ("c", "datanode", 0, "dn1"), ("c", "httpfs", 0, "fs1")], "source string, service string, pos int, host string")
    plan = {r["host"]: (r["seq"], r["stop_seq"], r["command"]) for r in start_plan(placement).collect()}
    assert plan == {"scm1": (1, 6, "--init"), "scm2": (2, 5, "--bootstrap"), "om1": (3, 4, None),
                    "om2": (4, 3, None), "dn1": (5, 2, None), "fs1": (6, 1, None)}

    t0 = dt.datetime(2024, 1, 1)
    polls = spark.createDataFrame(
        [("a", t0 + dt.timedelta(seconds=10 * i), i, "Safe mode is ON") for i in range(5)]
        + [("a", t0 + dt.timedelta(seconds=50), 5, "Safe mode is OFF")]
        + [("b", t0 + dt.timedelta(seconds=10 * i), i, "FAILED") for i in range(70)]
        + [("c", t0, 1, "in safe mode"), ("c", t0, 0, "SCM exited safe mode")],
        "cluster string, ts timestamp, poll_id long, raw string")
    got = {r["cluster"]: (r["outcome"], r["attempts"]) for r in poll_outcome(polls).collect()}
    assert got == {"a": ("EXITED", 6), "b": ("TIMEOUT", 60), "c": ("EXITED", 1)}

    urls = {r["host"]: r["url"] for r in endpoints(placement).collect()}
    assert urls["scm1"] == "http://scm1:9876" and urls["fs1"] == "http://fs1:14000"


def test_scale_conf_and_materialize(spark):
    from fleetframe.session import materialize, scale_conf
    conf = scale_conf(100 * 2 ** 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) > 100_000
    assert int(scale_conf(10 * 2 ** 20, 8)["spark.sql.shuffle.partitions"]) == 16
    df = spark.range(100).withColumnRenamed("id", "x")
    back = materialize(df, "mat-test")
    assert back.count() == 100 and back.columns == ["x"]


def test_down_in_windows_reports_a_total_outage(spark):
    from fleetframe.streaming.monitors import down_in_windows
    ts = lambda h: dt.datetime(2024, 1, 1, h)
    seen = spark.createDataFrame([(ts(1), "om1", "om"), (ts(3), "om1", "om"), (ts(3), "scm1", "scm")],
                                 "window_start timestamp, host string, service string")
    placement = spark.createDataFrame([("om1", "om"), ("scm1", "scm")], "host string, service string")
    down = down_in_windows(seen, placement, ["host", "service"], width="1 hour")
    assert {(r.window_start.hour, r.host) for r in down.collect()} == {(1, "scm1"), (2, "om1"), (2, "scm1")}
    assert down_in_windows(seen.limit(0), placement, ["host", "service"]).count() == 0


def test_scratch_tables_go_when_their_scope_ends(spark):
    from fleetframe.session import discard, materialize, scratch_scope

    def held(path):
        return os.path.exists(path.removeprefix("file:"))
    with scratch_scope() as outer:
        with scratch_scope() as keep:
            a = materialize(spark.range(5), "scope-a")
            b = keep(materialize(a.selectExpr("id * 2 AS id"), "scope-b"))
            paths = a._ff_scratch, b._ff_scratch
        assert not held(paths[0]) and held(paths[1]) and b.count() == 5
        c = outer(materialize(b, "scope-c"))
    assert not held(paths[1]) and sorted(r.id for r in c.collect()) == [0, 2, 4, 6, 8]
    last = c._ff_scratch
    discard(c, c, spark.range(1))
    assert not held(last)
