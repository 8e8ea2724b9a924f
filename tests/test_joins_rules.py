"""Joins, rules, lookups, aggregates and set operations on inline fixtures."""

import random

import numpy as np

from pyspark.sql import functions as F

from fleetframe.functions import text as T
from fleetframe.operators import aggs, joins, lookup, rules, setops
from fleetframe.plans.status import SERVICE_PATTERNS, service_status


def test_pattern_join_matches_brute_force(spark):
    rnd = random.Random(4)
    words = ["om", "scm", "data", "node", "é", "über", "x1", "proc_om", "the", "a"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", ".", "!"]))
            for i in range(120)]
    pats = []
    for j in range(40):
        d = rnd.choice(docs)[1]
        if d and rnd.random() < 0.7:
            a = rnd.randint(0, len(d) - 1)
            pats.append((j, d[a: a + rnd.randint(1, 25)]))
        else:
            pats.append((j, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))))
    ddf = spark.createDataFrame(docs, "doc_id int, text string")
    pdf = spark.createDataFrame(pats, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in
           joins.pattern_join(ddf, "text", "doc_id", pdf, "text", "item_id").collect()}
    exp = {(d, p) for d, dt in docs for p, pt in pats if pt in dt}
    assert got == exp and exp


def test_drift_states(spark):
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "name string, value string")
    a = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "5")], "name string, value string")
    got = {r["name"]: r["state"] for r in joins.drift(e, a, ["name"], "value").collect()}
    assert got == {"a": "match", "b": "changed", "c": "match", "d": "missing", "e": "unexpected"}


def test_pick_available(spark):
    av = spark.createDataFrame([("h1", "11"), ("h1", "17"), ("h2", "21"), ("h2", "8"), ("h3", "99")],
                               "host string, v string")
    got = {r["host"]: r["chosen"] for r in
           joins.pick_available(av, ["host"], "v", F.lit("17"), [11, 17, 21, 8]).collect()}
    assert got == {"h1": "17", "h2": "21"}


def test_verify_manifest(spark):
    src = spark.createDataFrame([("ozone.tar.gz", 100), ("empty", 0)], "file string, size long")
    dst = spark.createDataFrame([("h1", "ozone.tar.gz", 100), ("h2", "ozone.tar.gz", 90),
                                 ("h3", "empty", 0), ("h4", "other", 5)], "host string, file string, size long")
    got = {r["host"]: r["ok"] for r in joins.verify_manifest(src, dst, "file", "size").collect()}
    assert got == {"h1": True, "h2": False, "h3": False, "h4": False}


def test_service_status(spark):
    hosts = spark.createDataFrame([("om1",), ("scm1",)], "host string")
    svc = spark.createDataFrame(SERVICE_PATTERNS, "service string, pattern string")
    om, scm = "org.apache.hadoop.ozone.om.OzoneManager", "org.apache.hadoop.hdds.scm.server.StorageContainerManager"
    procs = spark.createDataFrame([("om1", 30, f"java -Dproc_om {om}"), ("om1", 20, f"java {om} --x"),
                                   ("scm1", 5, f"java -Xmx1g {scm}")], "host string, pid long, cmd string")
    got = {(r["host"], r["service"]): (r["status"], r["pid"])
           for r in service_status(hosts, svc, procs).collect()}
    assert len(got) == 12
    assert got[("om1", "om")] == ("running", 20)
    assert got[("scm1", "scm")] == ("running", 5)
    assert got[("om1", "datanode")] == ("not running", None)


def test_kernel_fs_dir_rules(spark):
    facts = spark.createDataFrame([
        ("h1", "cpu_governor", "performance"), ("h1", "transparent_hugepage", "always madvise [never]"),
        ("h1", "selinux", "Disabled"), ("h1", "swappiness", "1"),
        ("h2", "cpu_governor", "powersave"), ("h2", "transparent_hugepage", "[always] madvise never"),
        ("h2", "selinux", None), ("h2", "swappiness", "60")], "host string, setting string, raw_value string")
    got = {(r["host"], r["setting"]): r["status"] for r in rules.check_kernel(facts).collect()}
    assert all(v == "ok" for (h, _), v in got.items() if h == "h1")
    assert got[("h2", "selinux")] == "n/a" and got[("h2", "cpu_governor")] == "violation"
    assert got[("h2", "transparent_hugepage")] == "violation"

    fs = spark.createDataFrame([("h1", "/d", "xfs", "rw,noatime"), ("h2", "/d", "btrfs", "rw,relatime")],
                               "host string, dir string, fs_type string, mount_options string")
    got = {(r["host"], r["setting"]): r["status"] for r in rules.check_filesystems(fs).collect()}
    assert got == {("h1", "fs_type"): "ok", ("h1", "mount_options"): "ok",
                   ("h2", "fs_type"): "violation", ("h2", "mount_options"): "violation"}

    dirs = spark.createDataFrame([
        ("h1", "/a", True, "rocky:rocky", "rocky:rocky", "750", True),
        ("h1", "/b", True, "root:root", "rocky:rocky", "700", False),
        ("h1", "/c", False, None, "rocky:rocky", None, None)],
        "host string, dir string, exists boolean, owner string, expected_owner string, perms string, writable boolean")
    got = {(r["dir"], r["setting"]): r["status"] for r in rules.check_dirs(dirs).collect()}
    assert {v for (d, _), v in got.items() if d == "/a"} == {"ok"}
    assert got[("/b", "owner")] == "violation" and got[("/b", "perms")] == "violation"
    assert got[("/b", "writable")] == "violation"
    assert got[("/c", "exists")] == "violation" and got[("/c", "owner")] == "n/a"
    cfg = {(r["dir"], r["setting"]) for r in rules.check_dirs(dirs, config_only=True).collect()}
    assert {s for _, s in cfg} == {"owner"}


def test_eligibility_and_missing(spark):
    h = spark.createDataFrame([("a", "Linux", "x86_64"), ("b", "Linux", "aarch64"), ("c", "Darwin", "arm64"),
                               ("d", "Linux", "ppc64le")], "host string, os_type string, cpu_arch string")
    got = {r["host"]: (r["eligible"], r["reason"]) for r in rules.eligibility(h).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, rules.REASON_OS),
                   "d": (False, rules.REASON_ARCH)}
    conf = spark.createDataFrame([("s1", "CLUSTER_HOSTS", "a,b"), ("s2", "CLUSTER_HOSTS", "")],
                                 "source string, key string, value string")
    srcs = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source string")
    got = {r["source"] for r in rules.missing_keys(conf, srcs, ["CLUSTER_HOSTS"]).collect()}
    assert got == {"s2", "s3"}


def test_lookups(spark):
    df = spark.createDataFrame([("scm",), ("SCM",), ("Scm",), ("DataNode",), ("nope",)], "name string")
    tbl = spark.createDataFrame([("scm", "scm1,scm2"), ("datanode", "dn1")], "service string, hosts string")
    got = {r["name"]: r["hosts"] for r in lookup.lookup(df, "name", tbl, "service", "hosts").collect()}
    assert got == {"scm": "scm1,scm2", "SCM": "scm1,scm2", "Scm": "", "DataNode": "dn1", "nope": ""}
    a = spark.createDataFrame([("x86_64",), ("aarch64",), ("arm64",), ("s390x",)], "arch string")
    got = {r["arch"]: r["code"] for r in lookup.map_code(a, "arch", lookup.ARCH_CODES).collect()}
    assert got == {"x86_64": "amd64", "aarch64": "arm64", "arm64": "arm64", "s390x": None}
    p = spark.createDataFrame([("om", "om1"), ("HttpFS", "fs1"), ("grafana", "g")], "service string, host string")
    got = {r["host"]: r["url"] for r in lookup.service_urls(p).collect()}
    assert got == {"om1": "http://om1:9874", "fs1": "http://fs1:14000"}


def test_scalar_functions(spark):
    df = spark.createDataFrame([('  "om1"   x ', "TRUE", 11, "Safe mode is OFF"),
                                ("'a'", "yes", 9, "FAILED"),
                                ("b\t\nc", None, 21, "in safe mode")], "h string, f string, j int, s string")
    r = df.select(T.norm_host("h").alias("n"), T.flag("f").alias("f"),
                  T.allow_or("j", [8, 11, 17, 21], 8).alias("j"), T.classify_status("s").alias("s"),
                  T.fill_template(F.lit("v${V}-${V}"), {"V": "2.0"}).alias("t")).collect()
    assert [tuple(x) for x in r] == [("om1 x", True, 11, "EXITED", "v2.0-2.0"),
                                     ("a", False, 8, "UNKNOWN", "v2.0-2.0"),
                                     ("b c", False, 21, "WAITING", "v2.0-2.0")]


def test_aggs_and_sets(spark):
    steps = spark.createDataFrame([("r1", "h1", "SUCCESS"), ("r1", "h2", "FAILED"), ("r1", "h0", "FAILED"),
                                   ("r2", "h1", "SUCCESS"), ("r3", "h9", "FAILED")],
                                  "run string, host string, status string")
    got = {r["run"]: (r["n_ok"], r["n_total"], r["failed_hosts"], r["overall"])
           for r in aggs.run_summary(steps, "run", "host", "status").collect()}
    assert got == {"r1": (1, 3, "h0,h2", "PARTIAL"), "r2": (1, 1, "", "SUCCESS"), "r3": (0, 1, "h9", "FAILED")}
    res = spark.createDataFrame([("s1", "PASS"), ("s1", "FAIL"), ("s2", "PASS")], "suite string, status string")
    got = {r["suite"]: (r["n_run"], r["n_passed"], r["n_failed"], r["is_total"])
           for r in aggs.test_rollup(res, "suite", "status").collect()}
    assert got == {"s1": (2, 1, 1, False), "s2": (1, 1, 0, False), None: (3, 2, 1, True)}
    cluster = spark.createDataFrame([(h,) for h in ["om1", "scm1", "prometheus", "grafana", "client"]], "host string")
    placed = spark.createDataFrame([("om1",), ("scm1",)], "host string")
    assert {r["host"] for r in setops.unplaced(cluster, placed, ["host"]).collect()} == {"prometheus", "grafana", "client"}
    pl = spark.createDataFrame([("c", "datanode", 0), ("c", "om", 1), ("c", "scm", 2), ("c", "grafana", 3)],
                               "cluster string, service string, pos int")
    plan = {r["service"]: (r["seq"], r["stop_seq"]) for r in
            setops.ordered_plan(pl, ["cluster"], "service", "pos").collect()}
    assert plan == {"scm": (1, 4), "om": (2, 3), "datanode": (3, 2), "grafana": (4, 1)}


def test_shell_field_helpers(spark):
    df = spark.createDataFrame([("ID=rocky", '"(9.2)"', "v 10 and 20"), ("x", "ab", "none")], "a string, b string, c string")
    r = df.select(T.nth_field("a", "=", 2).alias("f"), T.delete_chars("b", '"()').alias("d"),
                  T.first_number("c").alias("n"), T.default_if_empty(F.lit(""), "dflt").alias("e")).collect()
    assert [tuple(x) for x in r] == [("rocky", "9.2", "10", "dflt"), (None, "ab", None, "dflt")]


def test_ordered_list_chunks_match_model(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "a", "b"]), rnd.randint(0, 60),
             rnd.choice([None, "", "x", "y", "z", "om1"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, pos int, v string")
    got = {r["k"]: (r["hosts"], r["n"]) for r in
           aggs.ordered_list(df, ["k"], "pos", "v", chunk_width=4, count_out="n").collect()}
    exp = {}
    for k in {r[0] for r in rows}:
        mine = sorted(((p, v) for kk, p, v in rows if kk == k),
                      key=lambda t: (t[0], "" if t[1] is None else t[1], t[1] is not None))
        exp[k] = (",".join(v for _, v in mine if v is not None), sum(v is not None for _, _, v in
                                                                      [r for r in rows if r[0] == k]))
    assert got == exp
    nums = spark.createDataFrame([(r[0], r[1]) for r in rows], "k string, v int")
    got = {r["k"]: r["values"] for r in aggs.collect_sorted(nums, ["k"], "v", chunk_width=4).collect()}
    assert got == {k: ",".join(str(v) for v in sorted(v for kk, v, _ in rows if kk == k)) for k in got}


def test_drift_repeated_keys_do_not_multiply(spark):
    e = spark.createDataFrame([("k", "1"), ("k", "2"), ("j", "x")], "name string, value string")
    a = spark.createDataFrame([("k", "2"), ("k", "1"), ("k", "1"), ("j", "y")], "name string, value string")
    got = {r["name"]: (r["expected_value"], r["actual_value"], r["state"])
           for r in joins.drift(e, a, ["name"], "value").collect()}
    assert got == {"k": ("1,2", "1,2", "match"), "j": ("x", "y", "changed")}


def test_contains_join_and_many_short_patterns(spark):
    procs = spark.createDataFrame([("h1", "java -Dproc_om x y"), ("h2", "python tool run now"), ("h3", "x"), ("h4", None)],
                                  "host string, cmd string")
    pats = spark.createDataFrame([("om", "-Dproc_om x"), ("tool", "tool run now"), ("none", "zzz q r"), ("nil", None)],
                                 "service string, pattern string")
    for size in (None, 20, 4):  # a filter of 16 bits knows nearly everything
        got = {(r["host"], r["service"]) for r in
               joins.contains_join(procs, "cmd", pats, "pattern", filter_bits=size).collect()}
        assert got == {("h1", "om"), ("h2", "tool")}
    words = [(i, f"w{i}") for i in range(20_001)]
    docs = [(1, "w1 w20000"), (2, "xw77y"), (3, "none")]
    got = {(r["d"], r["p"]) for r in joins.pattern_join(
        spark.createDataFrame(docs, "d int, t string"), "t", "d",
        spark.createDataFrame(words, "p int, w string"), "w", "p").collect()}
    assert got == {(d, p) for d, t in docs for p, w in words if w in t}
    every = joins.pattern_join(spark.createDataFrame(docs, "d int, t string"), "t", "d",
                               spark.createDataFrame([(0, "")], "p int, w string"), "w", "p")
    assert every.count() == 3


def test_contains_join_random(spark, monkeypatch):
    import random
    from fleetframe.operators import contains
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé \U0001f600x") for _ in range(n))
    docs = [(i, word(rng.randrange(0, 400))) for i in range(60)] + [(60, None), (61, ""), (7, "twice"), (7, "twice")]
    pats = [(i, word(rng.randrange(0, 7))) for i in range(120)]
    for i in range(120, 320):  # pieces of documents, of every length
        t = rng.choice(docs[:60])[1]
        a = rng.randrange(0, len(t) + 1)
        pats.append((i, t[a:a + rng.randrange(1, 90)] + rng.choice(["", "", "q"])))
    pats += [(400 + i, "a shared head of many patterns that goes on and on " + str(i)) for i in range(80)]
    pats += [(500, "twice"), (501, None), (502, ""), (500, "twice")]
    docs.append((62, " ".join(p for _, p in pats[320:400])))
    ddf = spark.createDataFrame(docs, "d int, t string").repartition(3)
    pdf = spark.createDataFrame(pats, "p int, w string").repartition(3)
    want = sorted((d, p) for d, t in docs for p, w in pats if t is not None and w is not None and w in t)
    for bits, part in ((None, 1 << 18), (10, 64), (22, 37)):
        monkeypatch.setattr(contains, "SLICE", part)
        monkeypatch.setattr(contains, "SEGMENT_BITS", 12)
        assert sorted(map(tuple, joins.pattern_join(ddf, "t", "d", pdf, "w", "p", filter_bits=bits).collect())) == want
    for a, b in ((ddf.limit(0), pdf), (ddf, pdf.limit(0))):
        assert joins.pattern_join(a, "t", "d", b, "w", "p").count() == 0


def test_many_patterns_meet_through_a_small_filter(spark):
    """50,000 patterns; only the filter passes the driver, and texts put out
    little more than what they hold."""
    from fleetframe.operators import contains
    pats = spark.range(50_000).select("id", F.concat(F.lit("key-"), F.md5(F.col("id").cast("string"))).alias("w"))
    docs = spark.range(300).select(F.col("id").alias("d"), F.concat_ws(" ", F.lit("some words"), F.concat(
        F.lit("key-"), F.md5((F.col("id") * 7).cast("string"))), F.repeat(F.lit("and more "), 50)).alias("t"))
    got = joins.pattern_join(docs, "t", "d", pats, "w", "id").collect()
    assert sorted(map(tuple, got)) == [(i, 7 * i) for i in range(300)]
    anchors = contains._anchored(pats.select(F.col("w").alias("p")))
    bits, bitmap = contains._filter(anchors, None)
    assert bits <= 21 and bitmap.nbytes == 1 << bits - 3 and (np.unpackbits(bitmap).mean() < 0.2)


def test_verify_manifest_reports_absent_files(spark):
    expected = spark.createDataFrame([("a.xml", 5), ("a.xml", 5), ("b.xml", 7)], "file string, size long")
    shipped = spark.createDataFrame([("h1", "a.xml", 5), ("h1", "c.xml", 1)], "host string, file string, size long")
    targets = joins.config_manifest(spark.createDataFrame([("h1",), ("h2",)], "host string"),
                                    spark.createDataFrame([("om",)], "role string"),
                                    spark.createDataFrame([("a.xml",), ("b.xml",)], "file string"))
    got = {(r.host, r.file): (r.actual_size, r.ok) for r in
           joins.verify_manifest(expected, shipped, "file", "size", targets=targets).collect()}
    assert got == {("h1", "a.xml"): (5, True), ("h1", "b.xml"): (None, False), ("h1", "c.xml"): (1, False),
                   ("h2", "a.xml"): (None, False), ("h2", "b.xml"): (None, False)}


def test_pids_by_service_with_the_real_classes(spark):
    from fleetframe.plans.status import SERVICE_PATTERNS, pids_by_service
    svc = spark.createDataFrame(SERVICE_PATTERNS, "service string, pattern string")
    procs = spark.createDataFrame([(f"h{i % 2}", 100 - i, f"java -Xmx1g {c} start") for i, (_, c) in
                                   enumerate(SERVICE_PATTERNS * 2)], "host string, pid long, cmd string")
    got = {(r.host, r.service): r.pids for r in pids_by_service(procs, svc).collect()}
    assert got[("h0", "scm")] == "94,100" and len(got) == 6


def test_pattern_join_pair_keys_edge_cases(spark):
    docs = [(1, "start über-data, node; the the end"),
            (2, "node the data über"),                  # same words, other order
            (3, "xx über-data, node; the yy"),
            (4, "über data node the")]
    pats = [(10, "t über-data, node; th"),                # partial edge tokens, pair (über,data)/(data,node)
            (11, "the the end"),                          # one interior token: 'the'
            (12, "data, node"),
            (13, "ver-data, node; the the e"),
            (14, "über data node")]                       # one interior token 'data'
    ddf = spark.createDataFrame(docs, "doc_id int, text string")
    pdf = spark.createDataFrame(pats, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in
           joins.pattern_join(ddf, "text", "doc_id", pdf, "text", "item_id").collect()}
    assert got == {(d, p) for d, dt in docs for p, pt in pats if pt in dt}


def test_lists_of_text_positions_are_split_too(spark):
    rows = [("a", f"p{i % 50:03}", f"v{i}") for i in range(400)] + [("b", None, "x"), (None, "p", "y")]
    df = spark.createDataFrame(rows, "k string, pos string, v string").repartition(5)
    want = {"a": ",".join(v for _, _, v in sorted(rows[:400], key=lambda r: (r[1], r[2]))), "b": "x", None: "y"}
    for width in (1 << 16, None):
        got = {r.k: r.hosts for r in aggs.ordered_list(df, ["k"], "pos", "v", chunk_width=width).collect()}
        assert got == want
    got = {r.k: (r["values"], r.n) for r in aggs.collect_sorted(df, ["k"], "v").collect()}
    assert got["a"] == (",".join(sorted(v for _, _, v in rows[:400])), 400)


def test_set_lists_are_gathered_by_buckets(spark):
    """A run with very many failed hosts: no list holds more than its bucket
    until the lists are put together."""
    n = 200_000
    steps = spark.range(n).select(F.when(F.col("id") < n - 10, "hot").otherwise("small").alias("run"),
                                  F.format_string("h%06d", F.col("id")).alias("host"),
                                  F.when(F.col("id") % 2 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    both = steps.unionByName(steps)
    got = {r.run: r for r in aggs.run_summary(both, "run", "host", "status").collect()}
    hosts = got["hot"].failed_hosts.split(",")
    assert hosts == [f"h{i:06}" for i in range(0, n - 10, 2)] and got["hot"].n_total == 2 * (n - 10)
    assert got["small"].failed_hosts.count(",") == 4 and got["small"].overall == "PARTIAL"
    pieces = both.where("status = 'FAILED'").groupBy("run", aggs.hash_bucket(F.col("host"))).agg(
        F.size(F.collect_set("host")).alias("k"))
    assert pieces.agg(F.max("k")).first()[0] < n / 2 / aggs.SET_BUCKETS * 1.5
    assert aggs.failed_hosts(both, "run", "host", "status").count() == n // 2
    e = both.select(F.lit("key").alias("name"), F.col("host").alias("value"))
    d = joins.drift(e, e.limit(1), ["name"], "value").first()
    assert d.expected_value.count(",") == n - 1 and d.state == "changed"


def test_rule_tables_are_broadcast(spark):
    # dealt out by setting, all facts of a setting were one task's
    facts = spark.range(3_000_000).selectExpr("id AS host", "if(id % 2 = 0, 'selinux', 'swappiness') AS setting",
                                         "cast(id % 3 AS string) AS raw_value")
    got = rules.rule_eval(facts, rules.rule_table(spark, rules.KERNEL_RULES))
    assert got.where("status = 'ok'").count() == 500_000 and got.count() == 3_000_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "hashpartitioning" not in plan
