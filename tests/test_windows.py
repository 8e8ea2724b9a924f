"""Ordered scans and sequence operators (W1–W8) against plain Python models.

Chunk widths are tiny so that every key spans many chunks and the
cross-chunk carry logic is exercised; one key is made hot on purpose.
"""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from fleetframe.operators import windows
from fleetframe.operators.scan import VOLUME_COLUMN, by_volume, number_chunk, running


def _rows(seed=1, n=600, keys=6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, keys)}"
        out.append((k, i, rnd.choice("SEx..") , rnd.choice([None, None, rnd.randint(0, 9)])))
    return out


SCHEMA = "k string, pos long, tok string, v int"


def _by_key(rows):
    g = defaultdict(list)
    for r in rows:
        g[r[0]].append(r)
    for k in g:
        g[k].sort(key=lambda r: r[1])
    return g


def test_running_matches_model(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = running(df, ["k"], ["pos"], number_chunk("pos", 7), rank="rk",
                  sums={"s": F.col("v")}, carries={"c": F.col("v")},
                  carries_before={"cb": F.col("v")},
                  last_rank_where={"lw": F.col("tok") == "S"}).collect()
    got = {(r["k"], r["pos"]): (r["rk"], r["s"], r["c"], r["cb"], r["lw"]) for r in got}
    exp = {}
    for k, seq in _by_key(rows).items():
        s = None
        last = None
        lw = None
        for i, r in enumerate(seq, 1):
            before = last
            if r[3] is not None:
                s = (s or 0) + r[3]
                last = r[3]
            if r[2] == "S":
                lw = i
            exp[(k, r[1])] = (i, s, last, before, lw)
    assert got == exp


def test_running_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("a", 1, 5)], "k string, pos long, v int")
    got = {(r["k"], r["pos"]): r["s"] for r in
           running(df, ["k"], ["pos"], number_chunk("pos", 1), sums={"s": F.col("v")}).collect()}
    assert got == {(None, 1): 1, (None, 2): 3, ("a", 1): 5}


def _sed(seq):
    out, inside = [], False
    for r in seq:
        if not inside:
            if r[2] == "S":
                inside = True
                continue
            out.append(r)
        else:
            if r[2] == "E":
                inside = False
    return out


def test_drop_ranges_matches_sed(spark):
    rnd = random.Random(3)
    rows = []
    for f in range(300):
        for i in range(rnd.randint(0, 15)):
            rows.append((f"f{f}", i, rnd.choice("SEx....."), None))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = windows.drop_ranges(df, ["k"], ["pos"], F.col("tok") == "S", F.col("tok") == "E",
                               chunk=number_chunk("pos", 4))
    got = {(r["k"], r["pos"]) for r in kept.collect()}
    exp = {(r[0], r[1]) for seq in _by_key(rows).values() for r in _sed(seq)}
    assert got == exp


def test_drop_ranges_with_rows_that_match_both(spark):
    import pytest
    rnd = random.Random(4)
    rows = [(f"f{f}", i, rnd.choice("SEBB...."), None) for f in range(200) for i in range(rnd.randint(0, 14))]
    df = spark.createDataFrame(rows, SCHEMA)
    start, end = F.col("tok").isin("S", "B"), F.col("tok").isin("E", "B")
    kept = windows.drop_ranges(df, ["k"], ["pos"], start, end, chunk=number_chunk("pos", 4), overlap=True)
    exp = set()
    for seq in _by_key(rows).values():
        inside = False
        for r in seq:
            if inside:
                inside = r[2] not in "EB"
            elif r[2] in "SB":
                inside = True
            else:
                exp.add((r[0], r[1]))
    assert {(r["k"], r["pos"]) for r in kept.collect()} == exp
    with pytest.raises(Exception, match="overlap=True"):
        windows.drop_ranges(df, ["k"], ["pos"], start, end).collect()


def test_null_keys_and_repeated_hosts(spark):
    polls = spark.createDataFrame([(None, 1, "S"), (None, 2, "."), ("a", 1, ".")], "k string, pos int, tok string")
    got = {r.k: (r.outcome, r.attempts) for r in
           windows.retry_outcome(polls, ["k"], ["pos"], F.col("tok") == "S").collect()}
    assert got == {None: ("EXITED", 1), "a": ("TIMEOUT", 1)}
    hosts = spark.createDataFrame([("c", 0, "a"), ("c", 1, "a"), ("c", 2, "b"), (None, 0, "x")],
                                  "c string, pos int, host string")
    got = sorted((r.pos, r.host, r.command) for r in windows.elect(hosts, ["c"], "pos", host="host").collect())
    assert got == [(0, "a", "--init"), (0, "x", "--init"), (1, "a", "--init"), (2, "b", "--bootstrap")]


def test_inflight_counts_invalid_intervals(spark):
    df = spark.createDataFrame([("a", 5, 3), ("a", None, 3), ("a", 1, 4), ("b", 9, 2)], "k string, s int, e int").select(
        "k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    got = {r.k: (r.n_intervals, r.peak, r.n_invalid) for r in windows.inflight(df, ["k"], "s", "e").collect()}
    assert got == {"a": (1, 1, 2), "b": (0, None, 1)}


def test_context_matches_grep(spark):
    rows = _rows(seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["k"], r["pos"]) for r in
           windows.context(df, ["k"], ["pos"], F.col("tok") == "E", 2, chunk=number_chunk("pos", 5))
           .where("in_context").collect()}
    exp = set()
    for k, seq in _by_key(rows).items():
        for i, r in enumerate(seq):
            if any(x[2] == "E" for x in seq[max(0, i - 2): i + 1]):
                exp.add((k, r[1]))
    assert got == exp


def test_carry(spark):
    rows = [("a", i, "H" if i % 4 == 0 else ".", None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = windows.carry(df, ["k"], "pos", F.when(F.col("tok") == "H", F.col("pos")), "hdr",
                        chunk=number_chunk("pos", 3))
    assert {r["pos"]: r["hdr"] for r in out.collect()} == {i: i - i % 4 for i in range(20)}


def test_retry_outcome_matches_model(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(40):
        n = rnd.randint(0, 12) if k else 200        # key 0 is hot
        for i in range(n):
            rows.append((f"c{k}", i, "S" if rnd.random() < 0.08 else ".", None))
    df = spark.createDataFrame(rows, SCHEMA)
    for max_att in (3, 60):
        got = {r["k"]: (r["outcome"], r["attempts"], r["polls"], r["exit_pos"]) for r in
               windows.retry_outcome(df, ["k"], ["pos"], F.col("tok") == "S", max_att).collect()}
        exp = {}
        for k, seq in _by_key(rows).items():
            at = next((i for i, r in enumerate(seq, 1) if r[2] == "S"), None)
            if at is not None and at <= max_att:
                exp[k] = ("EXITED", at, len(seq), seq[at - 1][1])
            else:
                exp[k] = ("TIMEOUT", min(len(seq), max_att), len(seq), None)
        assert got == exp


def test_inflight_matches_model(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        k = "hot" if i % 3 else f"n{i % 5}"
        s = rnd.randint(0, 50_000)
        rows.append((k, s, s + rnd.randint(0, 20_000)))
    df = (spark.createDataFrame(rows, "k string, s long, e long")
               .select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e")))
    cap = 5
    got = {r["k"]: (r["n_intervals"], r["peak"], r["seconds_above_cap"])
           for r in windows.inflight(df, ["k"], "s", "e", cap=cap, chunk_seconds=3600).collect()}
    exp = {}
    g = defaultdict(list)
    for k, s, e in rows:
        g[k] += [(s, 1), (e, -1)]
    for k, ev in g.items():
        ev.sort(key=lambda x: (x[0], x[1]))
        lvl = peak = 0
        above = 0
        prev_t = None
        for t, d in ev:
            if prev_t is not None and lvl > cap:
                above += t - prev_t
            lvl += d
            peak = max(peak, lvl)
            prev_t = t
        exp[k] = (len(ev) // 2, peak, above)
    assert got == exp


def test_primary(spark):
    df = spark.createDataFrame([("c", 2, "b"), ("c", 0, "a"), ("d", 5, "z")], "c string, pos int, h string")
    assert {r["c"]: r["primary"] for r in windows.primary(df, ["c"], "pos", "h").collect()} == {"c": "a", "d": "z"}


def test_running_spreads_a_hot_key(spark):
    """Two thirds of the rows share one key; the scan must not put them in one task."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.col("id").alias("pos"), F.lit(1).alias("v"))
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running(df, ["k"], ["pos"], number_chunk("pos", 500), sums={"s": F.col("v")}, rank="rk")
        per_task = (out.where(F.col("k") == "hot")
                       .groupBy(F.spark_partition_id().alias("p")).count().collect())
        hot = out.where(F.col("k") == "hot").select("pos", "s", "rk").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    # the hot key is split over several tasks, none holding half of it
    assert len(per_task) >= 4
    assert max(r["count"] for r in per_task) < len(hot) / 2
    # exact: the i-th hot row (1-based) has running sum i
    hot.sort(key=lambda r: r["pos"])
    assert all(r["s"] == i and r["rk"] == i for i, r in enumerate(hot, 1))


def test_dense_hot_key_is_cut_by_volume(spark):
    """One key, one day, 2 M rows: range chunks would be one task."""
    from pyspark.sql import Window
    n = 2_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / n * 3600)
                               .alias("ts"), "id", (F.col("id") % 1000 == 0).alias("hit"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = by_volume(df, ["k"], ["ts", "id"], chunks=16)
        sizes = [r["count"] for r in cut.groupBy(VOLUME_COLUMN).count().collect()]
        assert len(sizes) >= 8 and max(sizes) < n / 6
        got = windows.context(df, ["k"], ["ts", "id"], F.col("hit"), 2, chunk="volume")
        assert got.columns == [*df.columns, "in_context"]
        spread = got.groupBy(F.spark_partition_id()).count().count()
        # 8 shuffle partitions in the tests; chunks are hashed to them
        assert spread >= 4 and got.where("in_context").count() == 3 * (n // 1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_string_order(spark):
    rows = [("a", f"x{i:03}", "H" if i % 5 == 0 else ".") for i in range(60)] + [(None, "y", "H"), ("a", None, ".")]
    df = spark.createDataFrame(rows, "k string, o string, tok string")
    got = {(r.k, r.o): r.h for r in windows.carry(df, ["k"], "o", F.when(F.col("tok") == "H", F.col("o")), "h").collect()}
    assert got == {("a", f"x{i:03}"): f"x{i - i % 5:03}" for i in range(60)} | {(None, "y"): "y", ("a", None): None}


def test_a_hot_day_is_cut_without_being_asked(spark):
    """One key, one day, two million rows: the default spreads them over
    pieces of at most about HOT_ROWS."""
    from fleetframe.operators.scan import _CHUNK, _SUB, HOT_ROWS, _cut_hot, _key_columns, time_chunk
    n = 2_000_000
    second = F.timestamp_add("MILLISECOND", F.col("id") % 50_000_000, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    df = spark.range(n).select(F.lit("h").alias("host"), second.alias("ts"), "id",
                               F.when(F.col("id") % 700_000 == 5, F.col("id")).alias("mark"))
    keys, kcols = _key_columns(df, ["host"])
    d = df.select("*", *keys, time_chunk("ts").alias(_CHUNK))
    sizes = [r.n for r in _cut_hot(d, kcols, [F.col("ts"), F.col("id")], HOT_ROWS).groupBy(_CHUNK, _SUB).agg(
        F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and sum(sizes) == n and max(sizes) < 1.6 * HOT_ROWS
    got = running(df, ["host"], ["ts", "id"], time_chunk("ts"), rank="r", carries={"c": F.col("mark")},
                  sums={"s": F.lit(1)})
    bad = got.where((F.col("r") != F.col("id") + 1) | (F.col("s") != F.col("r")) | ~F.col("c").eqNullSafe(
        F.when(F.col("id") >= 5, F.floor((F.col("id") - 5) / 700_000) * 700_000 + 5)))
    assert got.count() == n and bad.count() == 0


def test_only_crowded_chunks_are_cut(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, i])) for k, m in (("a", 900), ("b", 30), (None, 500), ("c", 1)) for i in range(m)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for width, most in ((10_000, 64), (100, 64), (7, 5), (10_000, None)):
        got = {(r.k, r.i): (r.n, r.t, r.c, r.b, r.s, r.w) for r in running(
            df, ["k"], ["i"], number_chunk("i", width), most=most, rank="n", total="t", carries={"c": F.col("v")},
            carries_before={"b": F.col("v")}, sums={"s": F.col("v")}, last_rank_where={"w": F.col("v") % 3 == 0}).collect()}
        assert len(got) == len(rows)
        for k in ("a", "b", None, "c"):
            mine = [r for r in rows if r[0] == k]
            last = total = at = None
            for j, (_, i, v) in enumerate(mine):
                before, last = last, v if v is not None else last
                total = total if v is None else (total or 0) + v
                at = j + 1 if v is not None and v % 3 == 0 else at
                assert got[k, i] == (j + 1, len(mine), last, before, total, at)


def test_the_scan_reads_what_it_wrote_twice(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(100)], "k string, i long")
    got = running(df, ["k"], ["i"], number_chunk("i", 10), carries={"a": F.when(F.col("i") % 4 == 0, F.col("i")),
                                                                      "b": F.when(F.col("i") % 9 == 0, F.col("i"))})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Exchange hash" not in plan
