"""Readers and writers (S1–S12, K1–K3) on inline fixtures."""

import os
import random

from pyspark.sql import functions as F

from fleetframe.operators.aggs import kind_counts, pivot_facts
from fleetframe.plans import checks
from fleetframe.sinks import writers
from fleetframe.sinks.writers import write_partitioned, write_properties, write_site_xml
from fleetframe.sources import blocks, conf, properties, records, xml
from fleetframe.sources.lines import read_lines

# Fixture excerpt in the layout of the multi-host configuration (edge cases:
# trailing comment, escaped ${...}, commented-out key, unquoted number).
MULTI_CONF = """# Multi-host configuration
SSH_USER="rocky"
CLUSTER_HOSTS="om1,om2,om3,scm1,scm2,scm3,recon,s3gateway,datanode1,datanode2,datanode3,httpfs,prometheus,grafana,client"
OM_HOSTS="om1,om2,om3"                              # manager hosts
SCM_HOSTS="scm1,scm2,scm3"                         # three of a kind, odd on purpose
DATANODE_HOSTS="datanode1,datanode2,datanode3"     # blocks live here
RECON_HOSTS="recon"
S3GATEWAY_HOSTS="s3gateway"
HTTPFS_HOSTS="httpfs"
OZONE_OM_SERVICE_ID="ozone1"
OZONE_SCM_SERVICE_ID="cluster1"
OZONE_DOWNLOAD_URL="https://archive.apache.org/dist/ozone/\\${OZONE_VERSION}/ozone-\\${OZONE_VERSION}.tar.gz"
# LOCAL_TARBALL_PATH="/path/to/pkg-2.0.0.tar.gz"
MAX_CONCURRENT_TRANSFERS=10
JDK_VERSION='11'
export OZONE_HOME="/opt/ozone"
"""


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_conf_edge_cases(spark, tmp_out):
    p = _write(tmp_out, "multi.conf", MULTI_CONF)
    rows = {r["key"]: r["value"] for r in conf.read_conf(spark, p).collect()}
    assert rows["OM_HOSTS"] == "om1,om2,om3"
    assert rows["MAX_CONCURRENT_TRANSFERS"] == "10"
    assert rows["JDK_VERSION"] == "11"
    assert rows["OZONE_DOWNLOAD_URL"] == \
        "https://archive.apache.org/dist/ozone/${OZONE_VERSION}/ozone-${OZONE_VERSION}.tar.gz"
    assert "LOCAL_TARBALL_PATH" not in rows
    assert "SSH_USER" in rows and rows["SSH_USER"] == "rocky"
    assert rows["OZONE_HOME"] == "/opt/ozone"
    lines = {r["key"]: r["line_no"] for r in conf.read_conf(spark, p).collect()}
    assert lines["SSH_USER"] == 1          # 0-based line numbers


def test_last_assignment_wins(spark):
    df = spark.createDataFrame([("a", 1, "K", "x"), ("a", 5, "K", "y"), ("b", 2, "K", "z")],
                               "source string, line_no int, key string, value string")
    got = {(r["source"], r["value"]) for r in conf.last_wins(df).collect()}
    assert got == {("a", "y"), ("b", "z")}


def test_os_release(spark):
    df = spark.createDataFrame([("h1", 0, 'NAME="Rocky Linux"'), ("h1", 1, 'ID="rocky"'),
                                ("h1", 2, 'VERSION_ID="9.2"'), ("h2", 0, "ID=ubuntu"),
                                ("h2", 1, 'VERSION_ID="22.04"')], "source string, line_no int, line string")
    got = {r["source"]: (r["os_id"], r["os_version"]) for r in conf.parse_os_release(df).collect()}
    assert got == {"h1": ("rocky", "9.2"), "h2": ("ubuntu", "22.04")}


def test_site_xml_round_trip(spark, tmp_out):
    rnd = random.Random(7)
    rows = [(f"src{rnd.randint(0, 3)}", f"k.{i}", f"v{rnd.randint(0, 99)}",
             None if rnd.random() < 0.3 else f"d {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "source string, name string, value string, description string")
    out = os.path.join(tmp_out, "site")
    write_site_xml(df, out, partition_by=["source"])
    back = spark.read.format("xml").option("rowTag", "property").schema(xml.PROPERTY_SCHEMA).load(out) \
        .withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "source=([^/]+)", 1))
    got = sorted(tuple(r) for r in back.select("source", "name", "value", "description").collect())
    assert got == sorted(rows)
    files = [f for _, _, fs in os.walk(out) for f in fs if not f.startswith((".", "_"))]
    text = open(os.path.join(next(d for d, _, fs in os.walk(out) if any(f.startswith("part") for f in fs)),
                             next(f for d, _, fs in os.walk(out) for f in fs if f.startswith("part")))).read()
    assert "<configuration>" in text and "<property>" in text and files


def test_read_site_xml(spark, tmp_out):
    p = _write(tmp_out, "service-site.xml", """<?xml version="1.0"?>
<configuration>
  <!-- comment -->
  <property>
    <name>ozone.om.service.ids</name>
    <value>ozone1</value>
    <description>OM service IDs</description>
  </property>
  <property>
    <name>fs.ofs.impl</name>
    <value>org.apache.hadoop.fs.ozone.OzoneFileSystem</value>
  </property>
</configuration>
""")
    got = {r["name"]: (r["value"], r["description"]) for r in xml.read_site_xml(spark, p).collect()}
    assert got == {"ozone.om.service.ids": ("ozone1", "OM service IDs"),
                   "fs.ofs.impl": ("org.apache.hadoop.fs.ozone.OzoneFileSystem", None)}


def test_properties_round_trip_and_refs(spark, tmp_out):
    kv = spark.createDataFrame([
        ("hadoop.root.logger", "INFO,console"),
        ("log4j.rootLogger", "${hadoop.root.logger}"),
        ("hadoop.log.dir", "/var/log/svc"),
        ("hadoop.log.file", "svc.log"),
        ("log4j.appender.RFA.File", "${hadoop.log.dir}/${hadoop.log.file}"),
        ("log4j.appender.X.File", "${undefined.key}/x"),
        ("chained", "[${log4j.rootLogger}]"),
    ], "key string, value string")
    out = os.path.join(tmp_out, "props")
    write_properties(kv.coalesce(1), out)   # one file = one scope for references
    back = properties.read_properties(spark, out + "/*.txt")
    assert sorted((r["key"], r["value"]) for r in back.collect()) == sorted(tuple(r) for r in kv.collect())
    res = {r["key"]: r["resolved"] for r in properties.resolve_refs(back).collect()}
    assert res["log4j.rootLogger"] == "INFO,console"
    assert res["log4j.appender.RFA.File"] == "/var/log/svc/svc.log"
    assert res["log4j.appender.X.File"] == "${undefined.key}/x"
    assert res["chained"] == "[${hadoop.root.logger}]"      # one level only


COMPOSE = "services:\n" + "".join(
    f"  {svc}:\n    image: rocky9-ssh\n    hostname: {svc}\n    ports:\n"
    f"      - \"{2222 + i}:22\"    # SSH\n"
    + (f"      - \"{web}:{web}\"\n" if web else "")
    + "    networks:\n      - fleet-network\n"
    for i, (svc, web) in enumerate([
        ("om1", 9874), ("om2", 19874), ("om3", 29874), ("scm1", 9876), ("scm2", 19876), ("scm3", 29876),
        ("recon", 9888), ("s3gateway", 9878), ("datanode1", 9882), ("datanode2", 19882),
        ("datanode3", 29882), ("httpfs", 14000), ("prometheus", 9090), ("grafana", 3000),
        ("client", None)])) + "\nnetworks:\n  fleet-network:\n    driver: bridge\n    ports:\n      - \"1:1\"\nvolumes:\n  om1-data:\n"


def test_compose_ports(spark, tmp_out):
    p = _write(tmp_out, "docker-compose.yml", COMPOSE)
    ports = blocks.read_compose_ports(spark, p)
    ssh = ports.where(F.col("container_port") == 22)
    assert ssh.count() == 15
    assert ssh.select("host_port").distinct().count() == 15
    assert {r["host_port"] for r in ssh.collect()} == set(range(2222, 2237))
    kinds = {r["kind"]: r["n"] for r in kind_counts(ssh, "service", r"^(om|scm|datanode)\d+$").collect()}
    assert kinds["om"] == 3 and kinds["scm"] == 3 and kinds["datanode"] == 3
    web = {r["service"]: r["host_port"] for r in ports.where(F.col("container_port") != 22).collect()}
    assert web["om1"] == 9874 and web["httpfs"] == 14000 and web["grafana"] == 3000


def test_dir_report(spark, tmp_out):
    p = _write(tmp_out, "report.txt", """Checking data directories
Directory: /var/lib/hadoop-ozone/om/data
  Owner: rocky:rocky
  Permissions: 750
  ✅ Ownership is correct

Directory: /var/lib/hadoop-ozone/scm/data
  ❌ ERROR: Directory does not exist

Directory: /data/dn
  Mount point: /dev/sdb1
  Filesystem type: btrfs
  Mount options: rw,relatime
  Owner: root:root
  Permissions: 700
""")
    got = {r["dir"]: r for r in blocks.parse_dir_report(read_lines(spark, p)).collect()}
    assert got["/var/lib/hadoop-ozone/om/data"]["owner"] == "rocky:rocky"
    assert got["/var/lib/hadoop-ozone/om/data"]["perms"] == "750"
    assert got["/var/lib/hadoop-ozone/scm/data"]["exists"] is False
    assert got["/data/dn"]["fs_type"] == "btrfs" and got["/data/dn"]["mount_options"] == "rw,relatime"


def test_stanza_blocks(spark, tmp_out):
    p = _write(tmp_out, "ssh_config", """# SSH config
Host om1
    HostName localhost
    Port 2222
    User rocky

Host scm1
    HostName localhost
    Port 2225
    User rocky
    StrictHostKeyChecking no
""")
    long_ = blocks.parse_blocks(read_lines(spark, p))
    wide = {r["block"]: r for r in pivot_facts(long_, ["block"], "attr", "value", ["HostName", "Port", "User"]).collect()}
    assert wide["om1"]["Port"] == "2222" and wide["scm1"]["Port"] == "2225"
    assert long_.count() == 7


def test_records(spark):
    esc = "\u001b"
    logs = spark.createDataFrame([
        (1, f"{esc}[0;32m[2024-05-01 10:00:00] plain message{esc}[0m"),
        (2, f"{esc}[1;33m[2024-05-01 10:00:01] WARNING: careful{esc}[0m"),
        (3, f"{esc}[0;31m[2024-05-01 10:00:02] ERROR: boom: x{esc}[0m"),
        (4, "garbage line"),
    ], "id int, line string")
    got = {r["id"]: (r["level"], r["message"], r["ts"] is not None)
           for r in records.parse_run_log(logs).collect()}
    assert got == {1: ("LOG", "plain message", True), 2: ("WARNING", "careful", True),
                   3: ("ERROR", "boom: x", True), 4: (None, "garbage line", False)}

    steps = spark.createDataFrame([("SUCCESS:om1",), ("FAILED:scm2:selinux",), ("FAILED:dn1:scp",)], "line string")
    assert [(r["status"], r["host"], r["stage"]) for r in records.parse_step(steps).collect()] == [
        ("SUCCESS", "om1", None), ("FAILED", "scm2", "selinux"), ("FAILED", "dn1", "scp")]

    ps = spark.createDataFrame([
        ("rocky     4242  2.0  1.1 3000 200 ?  Sl  10:00  0:05 java -Dproc_om -Xmx1g org.apache.X",),
        ("rocky     4300  0.0  0.0 1000 100 pts/0 S+ 10:01 0:00 grep proc_om",)], "line string")
    rows = records.parse_ps(ps).collect()
    assert len(rows) == 1 and rows[0]["pid"] == 4242 and rows[0]["cmd"].startswith("java -Dproc_om")

    facts = spark.createDataFrame([("om1|10.0.0.1|x86_64|Linux|rocky|9.2",), ("mac|10.0.0.2|arm64|Darwin",)], "raw string")
    r = records.parse_host_facts(facts).collect()
    assert r[0]["os_version"] == "9.2" and r[1]["os_dist"] is None and r[1]["os_type"] == "Darwin"

    tl = spark.createDataFrame([(f"{esc}[0;32m[PASS] conf loads{esc}[0m",), ("[FAIL] xml valid",), ("Tests run: 3",)],
                               "line string")
    assert [(r["status"], r["name"]) for r in records.parse_test_log(tl).collect()] == [
        ("PASS", "conf loads"), ("FAIL", "xml valid")]


def test_write_partitioned(spark, tmp_out):
    df = spark.createDataFrame([(f"h{i % 5}", ["om", "scm"][i % 2], i) for i in range(100)],
                               "host string, role string, v int")
    out = os.path.join(tmp_out, "dist")
    write_partitioned(df, out, ["host", "role"])
    back = spark.read.parquet(out)
    assert back.count() == 100
    assert back.where((F.col("host") == "h1") & (F.col("role") == "scm")).count() == 10


def test_large_logs_are_numbered_over_splits(spark, tmp_out):
    """One file in many splits numbers like ``cat -n``, counting from 0."""
    from fleetframe.operators import windows
    from fleetframe.sources.lines import read_log_lines
    rng = random.Random(3)
    texts = {"a": [f"line {i} " + "x" * rng.randrange(0, 60) + rng.choice(["", "\r", "\u2028y"]) for i in range(20_000)],
             "b": ["only"], "c": ["", "", "z"]}
    for name, lines in texts.items():
        with open(os.path.join(tmp_out, f"{name}.log"), "w", newline="") as f:
            f.write("\n".join(lines) + ("\n" if name != "b" else ""))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_log_lines(spark, [tmp_out])
        got = sorted((r.source.rsplit("/", 1)[1][0], r.line_no, r.line) for r in df.collect())
        assert got == sorted((n, i, x) for n, lines in texts.items() for i, x in enumerate(lines))
        assert spark.read.text(tmp_out, lineSep="\n").rdd.getNumPartitions() > 8
        near = windows.context(df, ["source"], ["line_no"], F.col("line").startswith("line 777 "), 2).where("in_context")
        assert sorted(r.line_no for r in near.collect()) == [777, 778, 779]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_run_log_lines_with_odd_marks(spark):
    rows = ["\u0001x\u0001y", "[2024-01-02 03:04:05] ERROR: a\u0001b", "[nope] z", "[2024-01-02 03:04:05] plain",
            "\u001b[0;31m[2024-01-02 03:04:05] INFO: $1 \\ end\u001b[0m", None]
    got = {r.line: (str(r.ts)[:19] if r.ts else None, r.level, r.message) for r in records.parse_run_log(
        spark.createDataFrame([(x,) for x in rows], "line string")).collect()}
    at = "2024-01-02 03:04:05"
    assert [got[x] for x in rows] == [(None, None, rows[0]), (at, "ERROR", "a\u0001b"), (None, None, "[nope] z"),
                                      (at, "LOG", "plain"), (at, "INFO", "$1 \\ end"), (None, None, None)]


def test_writers_pack_small_and_cut_large_configurations(spark, tmp_out):
    import glob
    rows = [(f"s{i}", f"k{j:04}", "v" * 20) for i in range(60) for j in range(3)] + [
        ("big", f"k{j:05}", "v" * 20) for j in range(8000)] + [(None, "k", "n")]
    df = spark.createDataFrame(rows, "source string, key string, value string").repartition(7)
    write_properties(df, f"{tmp_out}/p", partition_by=["source"], large_bytes=40_000)
    files = {}
    for f in glob.glob(f"{tmp_out}/p/source=*/*.txt"):
        files.setdefault(f.split("source=")[1].split("/")[0], []).append(f)
    assert all(len(files[f"s{i}"]) == 1 for i in range(60)) and len(files["big"]) >= 6 and len(files) == 62
    text = [line for f in sorted(files["big"]) for line in open(f).read().splitlines()]
    assert text == [f"k{j:05}={'v' * 20}" for j in range(8000)]        # in order over its files
    assert max(os.path.getsize(f) for f in files["big"]) < 100_000
    write_site_xml(df.where("source = 'big'").select(F.col("key").alias("name"), "value"), f"{tmp_out}/x", large_bytes=40_000)
    assert len(glob.glob(f"{tmp_out}/x/*.xml")) >= 6 and xml.read_site_xml(spark, f"{tmp_out}/x").count() == 8000
    write_site_xml(df.where("source = 's1'").select(F.col("key").alias("name"), "value"), f"{tmp_out}/y")
    assert len(glob.glob(f"{tmp_out}/y/*.xml")) == 1


def test_small_configurations_go_to_many_tasks(spark):
    # 40 configurations of 1 MB: less than a large one, yet more than one task should write
    df = spark.range(40).selectExpr("cast(id AS string) AS source", "'k' AS name", "repeat('v', 1 << 20) AS value")
    dealt = writers._dealt(df, ["source"], ["name"], writers.LARGE_BYTES)
    assert dealt.count() == 40 and dealt.rdd.getNumPartitions() == 3


def test_references_are_never_broadcast(spark, tmp_out):
    # one small file of many rows: Spark takes its lines for few
    (spark.range(120_000).selectExpr("id AS p_partkey", "'t' AS p_type", "'Brand#1' AS p_brand", "1 AS p_size")
     .coalesce(1).write.parquet(f"{tmp_out}/part.parquet"))
    out = checks.props_resolve(spark, tmp_out)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    # and three tasks compose the lines
    assert plan.count(", 3), REPARTITION_BY_NUM") == 3
    assert out.count() == 360_000
    assert out.where("key = 'part.7.label'").first().resolved == "t/${brand.Brand#1}/size-1"
