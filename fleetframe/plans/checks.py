"""Operator checks over the driver's tables.

Each function takes ``(spark, sf_dir)``, reads whole tables and runs one
library operator (or flow) on them.  Where an operator parses a text format
the check first composes lines in that format from table columns (the SQL
oracle builds the very same lines), so the parser itself is compared.
Composition only renders rows in the schema the operator expects; the
operator gets no hint from how the rows were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.functions.text import (allow_or, classify_status, fill_template, first_number,
                                       flag, norm_host)
from fleetframe.operators import aggs, joins, lookup, rules, setops, windows
from fleetframe.plans.install import (CONFIG_FILES, CONFIG_FOLDERS, compliance, config_targets, jdk_packages,
                                     os_facts, step_report)
from fleetframe.plans.site_config import (core_site_properties, explode_list, fill_placement,
                                          placement_from_conf, service_props, site_properties)
from fleetframe.plans.start import start_plan
from fleetframe.plans.status import SERVICE_PATTERNS, service_status
from fleetframe.plans.status import pids_by_service as status_pids
from fleetframe.session import materialize, scratch_path
from fleetframe.sinks.writers import write_partitioned, write_properties, write_site_xml
from fleetframe.sources.blocks import compose_ports, parse_blocks, parse_dir_report
from fleetframe.sources.lines import read_log_lines
from fleetframe.sources.conf import last_wins, parse_conf, parse_os_release
from fleetframe.sources.properties import parse_properties, read_properties, resolve_refs
from fleetframe.sources.records import (parse_host_facts, parse_ps, parse_run_log,
                                        parse_step, parse_test_log)
from fleetframe.sources.xml import parse_property_xml, read_site_xml

TS_FMT = "yyyy-MM-dd HH:mm:ss"
ESC = "\u001b"
# Fixed value: the archive URL template of the reference configuration.
DOWNLOAD_URL_TEMPLATE = "https://archive.apache.org/dist/ozone/${OZONE_VERSION}/ozone-${OZONE_VERSION}.tar.gz"
EVENT_TYPES = ["signup", "purchase", "error", "view", "click"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a table that one task composes lines from.
SPREAD_ROWS = 50_000


def _spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to one task for every ``SPREAD_ROWS`` rows.  A scan is
    split by the bytes of its files, and a few well compressed ones can hold
    so many rows that the lines composed from them are too many for a task."""
    return df.repartition(max(1, -(-df.count() // SPREAD_ROWS)), *df.columns)


def _fmt(c):
    return F.date_format(c, TS_FMT)


# ---------------------------------------------------------------- sources

def conf_parse(spark, sf):
    """Shell-conf lines (quoted + trailing comment, commented out,
    unquoted, escaped ``\\${X}``, single-quoted) composed from ``customer``."""
    c = t(spark, sf, "customer")
    key = F.concat(F.lit("CUST_"), F.col("c_custkey"))
    seg = F.col("c_mktsegment")
    line = (F.when(seg == "AUTOMOBILE", F.concat(key, F.lit('="'), F.col("c_name"), F.lit('"  # '), seg))
             .when(seg == "BUILDING", F.concat(F.lit("# "), key, F.lit('="'), F.col("c_name"), F.lit('"')))
             .when(seg == "FURNITURE", F.concat(key, F.lit("="), F.col("c_nationkey")))
             .when(seg == "HOUSEHOLD", F.concat(F.lit("  "), key, F.lit('="\\${NATION}/'),
                                                F.col("c_nationkey"), F.lit('"')))
             .otherwise(F.concat(key, F.lit("='"), F.col("c_name"), F.lit(" "), seg, F.lit("'  # quoted"))))
    return parse_conf(c.select("c_custkey", line.alias("line"))).select("c_custkey", "key", "value")


def conf_last_wins(spark, sf):
    """W6 over parsed lines: file = nation, line = customer key, one
    ``SEG_<segment>`` assignment per customer; the last one wins."""
    c = t(spark, sf, "customer")
    lines = c.select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("line_no"),
                     F.concat(F.lit("SEG_"), F.col("c_mktsegment"), F.lit('="'), F.col("c_name"),
                              F.lit('"')).alias("line"))
    return last_wins(parse_conf(lines).select("source", "line_no", "key", "value"))


def xml_props(spark, sf):
    """``<property>`` strings composed from ``nation``, parsed with from_xml."""
    n = t(spark, sf, "nation")
    xml = F.concat(F.lit("<property><name>nation."), F.col("n_nationkey"), F.lit("</name><value>"),
                   F.col("n_name"), F.lit("</value>"),
                   F.when(F.col("n_regionkey") != 0,
                          F.concat(F.lit("<description>region "), F.col("n_regionkey"),
                                   F.lit("</description>"))).otherwise(F.lit("")),
                   F.lit("</property>"))
    p = n.select("n_nationkey", parse_property_xml(xml).alias("p"))
    return p.select("n_nationkey", "p.name", "p.value", "p.description")


def props_resolve(spark, sf):
    """S3: properties lines composed from ``part`` (file = brand) with
    ``${key}`` references: defined, undefined, chained (one level only)."""
    p = _spread(t(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size"))
    k = F.concat(F.lit("part."), F.col("p_partkey"))
    lines = F.array(
        F.concat(k, F.lit(".type = "), F.col("p_type")),
        F.concat(k, F.lit(".label=${"), k, F.lit(".type}/${brand."), F.col("p_brand"),
                 F.lit("}/size-"), F.col("p_size")),
        F.concat(k, F.lit(".full=${"), k, F.lit(".label}@$x")),
        F.concat(F.lit("# part "), F.col("p_partkey")))
    raw = p.select(F.col("p_brand").alias("source"), F.explode(lines).alias("line"))
    kv = parse_properties(raw).select("source", "key", "value")
    return resolve_refs(kv, row_id=("source", "key"), line_no=None).select("source", "key", "resolved")


def pipe_facts(spark, sf):
    """``|``-separated host-fact records composed from ``supplier``
    (negative balance -> the version field is missing)."""
    s = t(spark, sf, "supplier")
    raw = F.concat(
        F.concat_ws("|", F.col("s_name"),
                    F.concat(F.lit("10."), F.col("s_nationkey"), F.lit("."), F.col("s_suppkey")),
                    F.when(F.col("s_acctbal") < 0, F.lit("ppc64le")).otherwise(F.lit("x86_64")),
                    F.lit("Linux"), F.lit("rocky")),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("|9."), F.col("s_nationkey"))).otherwise(F.lit("")))
    return parse_host_facts(s.select("s_suppkey", raw.alias("raw"))).drop("raw")


def compose_log_line(e):
    et = F.col("event_type")
    body = F.concat(F.lit("user "), F.col("user_id"), F.lit(" event "), F.col("event_id"))
    stamp = F.concat(F.lit("["), _fmt(F.col("ts")), F.lit("] "))
    colour = {"error": "0;31", "click": "1;33", "view": "0;34", "purchase": "0;32"}
    level = {"error": "ERROR: ", "click": "WARNING: ", "view": "INFO: ", "purchase": ""}
    out = F.concat(F.lit("no timestamp here: "), body)
    for k in ("error", "click", "view", "purchase"):
        out = F.when(et == k, F.concat(F.lit(f"{ESC}[{colour[k]}m"), stamp, F.lit(level[k]), body,
                                       F.lit(f"{ESC}[0m"))).otherwise(out)
    return out


def log_parse(spark, sf):
    """Coloured run-log lines composed from ``events`` (all levels, a
    plain ``log`` line and a malformed line)."""
    e = t(spark, sf, "events")
    p = parse_run_log(e.select("event_id", compose_log_line(e).alias("line")))
    return p.select("event_id", _fmt(F.col("ts")).alias("ts"), "level", "message")


def test_log_parse(spark, sf):
    """``[PASS]``/``[FAIL]``/``[TEST]`` lines (coloured) from ``events``;
    other lines dropped."""
    e = t(spark, sf, "events")
    et = F.col("event_type")
    line = (F.when(et == "purchase", F.concat(F.lit(f"{ESC}[0;32m[PASS] check "), F.col("event_id"), F.lit(f"{ESC}[0m")))
             .when(et == "error", F.concat(F.lit(f"{ESC}[0;31m[FAIL] check "), F.col("event_id"), F.lit(f"{ESC}[0m")))
             .when(et == "signup", F.concat(F.lit("[TEST] check "), F.col("event_id")))
             .otherwise(F.concat(F.lit("Tests run: "), F.col("event_id"))))
    return parse_test_log(e.select("event_id", line.alias("line"))).select("event_id", "status", "name")


def log_lines(spark, sf):
    """S6 on log files: a day's events as a log file, read back with line
    numbers, and the lines within two of an error line (W4)."""
    e = t(spark, sf, "events")
    day = F.date_format("ts", "yyyyMMdd").alias("day")
    path = scratch_path(spark, "logs")
    logs = e.select("event_id", day, compose_log_line(e).alias("value"))
    logs.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.mode(
        "overwrite").partitionBy("day").text(path)
    lines = parse_run_log(read_log_lines(spark, f"{path}/*/*.txt"))
    found = windows.context(lines, ["source"], ["line_no"], F.col("level") == "ERROR", 2).where("in_context")
    return found.select(F.regexp_extract("source", "day=([0-9]+)", 1).alias("day"), "line_no", "level", "message")


def step_parse(spark, sf):
    """``SUCCESS:host`` / ``FAILED:host:stage`` tokens from ``events``."""
    e = t(spark, sf, "events")
    host = F.concat(F.lit("host"), F.col("user_id"))
    line = F.when(F.col("event_type") == "error",
                  F.concat(F.lit("FAILED:"), host, F.lit(":stage"), first_number(F.col("props"))))\
            .otherwise(F.concat(F.lit("SUCCESS:"), host))
    return parse_step(e.select("event_id", line.alias("line"))).select("event_id", "status", "host", "stage")


def ps_parse(spark, sf):
    """``ps aux`` rows composed from ``supplier``; the grep row
    (negative balance) must be excluded."""
    s = t(spark, sf, "supplier")
    cmd = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("grep -E proc_"), F.col("s_nationkey")))\
           .otherwise(F.concat(F.lit("java -Dproc_"), F.col("s_nationkey"), F.lit(" -cp /opt/x "), F.col("s_name")))
    line = F.concat(F.lit("rocky  "), F.col("s_suppkey"),
                    F.lit("  0.0  1.2 123456 7890 ?  Ssl  10:00   0:01 "), cmd)
    p = parse_ps(s.select("s_suppkey", line.alias("line")))
    return p.select("s_suppkey", "user", "pid", "cmd")


# Fixed frame of every composed compose file: header, and sections that are not services.
COMPOSE_FRAME = [(0, "services:"), (1, "  # nodes"), (10000, "networks:"), (10001, "  fleet-net:"),
                 (10002, "    ports:"), (10003, '      - "1:1"'), (10004, "volumes:"), (10005, "  data:")]


def compose_parse(spark, sf):
    """Compose files (one per region) with one service per nation, its
    SSH and web port lines, plus ``networks:``/``volumes:`` sections whose
    keys and port-like lines must not count as services."""
    n = t(spark, sf, "nation")
    r = t(spark, sf, "region")
    k = F.col("n_nationkey")
    svc = F.regexp_replace(F.lower(F.col("n_name")), " ", "_")
    body = F.array(F.concat(F.lit("  "), svc, F.lit(":")), F.lit("    image: rocky9-ssh"),
                   F.lit("    ports:"),
                   F.concat(F.lit('      - "'), k + 2200, F.lit(':22"    # SSH')),
                   F.concat(F.lit("      - '"), k + 9000, F.lit(":"), k + 9000, F.lit("'")),
                   F.lit("    environment:"), F.lit("      - NODE=1"))
    svc_lines = (n.select(F.col("n_regionkey").alias("source"), k, F.posexplode(body).alias("pos", "line"))
                  .select("source", (F.lit(100) + k * 10 + F.col("pos")).alias("line_no"), "line"))
    frame = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(x).alias("line")) for i, x in COMPOSE_FRAME])
    frame_lines = (r.select(F.col("r_regionkey").alias("source"), F.explode(frame).alias("l"))
                    .select("source", "l.line_no", "l.line"))
    lines = svc_lines.unionByName(frame_lines)
    return compose_ports(lines).select("source", "service", "host_port", "container_port")


def _dir_lines(spark, sf):
    """The two directory reports, composed from ``supplier``: per nation a
    verification run (``v<n>``: data directories, then configuration
    directories, for two hosts one after the other) and an installer run
    (``i<n>``)."""
    s = t(spark, sf, "supplier")
    k, bal, n = F.col("s_suppkey"), F.col("s_acctbal"), F.col("s_nationkey")
    owner = F.when(bal > 3000, F.lit("rocky:rocky")).otherwise(F.lit("root:root"))
    perms = F.when(bal > 5000, F.lit("750")).otherwise(F.lit("700"))
    own = F.concat(F.lit("  Owner: "), owner)
    mode = F.concat(F.lit("  Permissions: "), perms)
    wrote = F.when(bal > 1000, F.lit("  ✅ Write access confirmed")).otherwise(
        F.lit("  ❌ ERROR: No write access to directory"))
    data = F.concat(F.lit("Directory: /data/s"), k)
    block = F.when(bal >= 0, F.array(data, own, mode, F.lit("  ✅ Ownership is correct"), wrote, F.lit(""))).otherwise(
        F.array(data, F.lit("  ❌ ERROR: Directory does not exist"), F.lit("")))
    conf = F.when(bal > 6000, F.array(F.concat(F.lit("Config Directory: /etc/c"), k), F.lit("  Owner: root:root"),
                                      F.lit("  Permissions: 755"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    inst = F.array(F.concat(F.lit("Checking directory: /data/s"), k),
                   F.concat(F.lit("  Mount point: /dev/sd"), k % 3),
                   F.concat(F.lit("  Filesystem type: "), F.when(bal > 2000, F.lit("xfs")).otherwise(F.lit("btrfs"))),
                   F.concat(F.lit("  Mount options: rw"), F.when(bal > 4000, F.lit(",noatime")).otherwise(F.lit(""))),
                   own, mode, F.lit(""))
    host = k % 2

    def rows(prefix, section, body):
        return s.select(F.concat(F.lit(prefix), n).alias("source"),
                        (host * 10**9 + section * 10**8 + k * 10).alias("base"), F.posexplode(body).alias("i", "line")
                        ).select("source", (F.col("base") + F.col("i")).alias("line_no"), "line")

    def heads(prefix, text):
        return s.select(F.concat(F.lit(prefix), n).alias("source"), (host * 10**9 + F.lit(-1)).alias("line_no"),
                        F.concat(F.lit("[2024-01-01 00:00:00] INFO: " + text), F.lit(" h"), host,
                                 F.lit(": /data" if prefix == "i" else "")).alias("line")).distinct()
    parts = [heads("v", "Checking directory permissions on"), rows("v", 0, block), rows("v", 1, conf),
             heads("i", "Validating filesystem for directories on"), rows("i", 0, inst)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def dir_report(spark, sf):
    """Both report layouts, several hosts in each source."""
    return parse_dir_report(_dir_lines(spark, sf))


def dir_rules(spark, sf):
    """P11 on the parsed reports: the data rules on data directories, the
    owner rule on configuration directories."""
    d = parse_dir_report(_dir_lines(spark, sf)).where(F.col("source").startswith("v")).withColumn(
        "expected_owner", F.lit("rocky:rocky"))
    ids = ("source", "host", "kind", "dir")
    return rules.check_dirs(d, ids, config_only=F.col("kind") == "config").select(*ids, "setting", "status")


def fs_rules(spark, sf):
    """P10 on the installer's reports."""
    d = parse_dir_report(_dir_lines(spark, sf)).where(F.col("source").startswith("i"))
    return rules.check_filesystems(d, ("source", "host", "dir")).select("source", "host", "dir", "setting", "raw_value", "status")


def _kernel_settings(spark, sf):
    """A row per customer's host and setting; some facilities are missing."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    raw = F.array(
        F.struct(F.lit("cpu_governor").alias("setting"), F.when(k % 3 == 0, F.lit("performance")).when(
            k % 3 == 1, F.lit("powersave")).alias("raw_value")),
        F.struct(F.lit("transparent_hugepage").alias("setting"), F.when(bal > 5000, F.lit("always madvise [never]")).otherwise(
            F.lit("[always] madvise never")).alias("raw_value")),
        F.struct(F.lit("selinux").alias("setting"), F.when(k % 5 != 0, F.when(bal < 0, F.lit("Enforcing")).otherwise(
            F.lit("Disabled"))).alias("raw_value")),
        F.struct(F.lit("swappiness").alias("setting"), (k % 2).cast("string").alias("raw_value")))
    return t(spark, sf, "customer").select(F.concat(F.lit("h"), k).alias("host"), F.inline(raw))


def kernel_rules(spark, sf):
    """Kernel settings of every host; a missing facility is n/a."""
    return rules.check_kernel(_kernel_settings(spark, sf)).select("host", "setting", "raw_value", "status")


def compliance_flow(spark, sf):
    """P10-P12 as one table of verdicts, counted by check and status."""
    d = parse_dir_report(_dir_lines(spark, sf)).withColumn("host", F.concat_ws("-", "source", "host"))
    d = materialize(d.withColumn("expected_owner", F.lit("rocky:rocky")), "compliance")
    found = compliance(_kernel_settings(spark, sf), d.where(F.col("source").startswith("i")),
                       d.where((F.col("kind") == "data") & F.col("source").startswith("v")))
    return found.groupBy(F.substring_index("check", ":", 1).alias("check"), "setting", "status").agg(
        F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def step_report_flow(spark, sf):
    """S7 -> A3 -> J5: runs are days; requested are all users, reporting are
    those with an event on the day."""
    e = t(spark, sf, "events")
    run, host = F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.concat(F.lit("host"), F.col("user_id"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("FAILED:"), host, F.lit(":copy"))).otherwise(
        F.concat(F.lit("SUCCESS:"), host))
    requested = e.select(run).distinct().crossJoin(e.select(host.alias("host")).distinct())
    summary, failed = step_report(e.select(run, line.alias("line")), requested)
    return summary.join(failed.groupBy("run_id").agg(F.count("*").alias("n_unverified")), "run_id", "left").select(
        "run_id", "n_ok", "n_total", "failed_hosts", "overall", F.coalesce("n_unverified", F.lit(0)).cast("long").alias("n_unverified"))


def start_plan_flow(spark, sf):
    """P2 -> O2 -> W1: the start order of every composed configuration."""
    placed = placement_from_conf(_site_conf(spark, sf))
    return start_plan(placed).select("source", "service", "host", "seq", "stop_seq", "command")


def os_release(spark, sf):
    """An os-release file per supplier; the version is missing for some."""
    s = t(spark, sf, "supplier")
    lines = F.array(F.lit("# os"), F.concat(F.lit('ID="rocky'), F.col("s_nationkey"), F.lit('"')),
                    F.when(F.col("s_acctbal") > 0, F.concat(F.lit("VERSION_ID='9."), F.col("s_nationkey"), F.lit("'")))
                    .otherwise(F.lit("NAME=x")))
    return parse_os_release(s.select(F.col("s_suppkey").cast("string").alias("source"),
                                     F.posexplode(lines).alias("line_no", "line")))


def _site_conf(spark, sf):
    """A configuration per nation: hosts from its suppliers; every third has no
    SCM hosts, every second no SCM service id, every fifth no cluster hosts,
    and only every fourth any common property."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    s = t(spark, sf, "supplier")
    hosts = s.groupBy(F.col("s_nationkey").alias("n")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("s"), k)), ", ").alias("hosts"))
    kv = F.array(
        F.struct(F.lit("CLUSTER_HOSTS").alias("key"), F.when(F.col("n") % 5 == 0, F.lit("")).otherwise(
            F.lit("c1, c2")).alias("value")),
        F.struct(F.lit("SCM_HOSTS").alias("key"), F.when(F.col("n") % 3 == 0, F.lit("")).otherwise(
            F.coalesce("hosts", F.lit(""))).alias("value")),
        F.struct(F.when(F.col("n") % 2 == 1, F.lit("OZONE_SCM_SERVICE_ID")).otherwise(F.lit("X")).alias("key"),
                 F.concat(F.lit("cl"), F.col("n")).alias("value")),
        F.struct(F.when(F.col("n") % 4 == 1, F.lit("OZONE_SCM_DB_DIRS")).otherwise(F.lit("Y")).alias("key"),
                 F.concat(F.lit("/d"), F.col("n")).alias("value")))
    return (n.join(hosts, "n", "left").select(F.concat(F.lit("n"), F.col("n")).alias("source"),
                                              F.posexplode(kv).alias("line_no", "kv"))
             .select("source", "line_no", "kv.key", "kv.value"))


def site_props_full(spark, sf):
    """A10: the site file of every composed configuration, complete."""
    return site_properties(_site_conf(spark, sf)).select("source", "name", "value")


def core_props(spark, sf):
    """A10: the core-site rows of every composed configuration."""
    return core_site_properties(_site_conf(spark, sf)).select("source", "name", "value")


def _proc_lines(spark, sf):
    """``ps aux`` lines composed from ``events``: the event type picks the
    service class, the user the host; some lines are the grep itself."""
    e = t(spark, sf, "events")
    cls = F.element_at(F.array(*[F.lit(c) for _, c in SERVICE_PATTERNS]), (F.col("event_id") % 6 + 1).cast("int"))
    cmd = F.when(F.col("event_type") == "signup", F.concat(F.lit("grep "), cls)).otherwise(
        F.concat(F.lit("java -Xmx1g -cp /opt/x "), cls, F.lit(" --run")))
    line = F.concat(F.lit("rocky "), F.col("event_id"), F.lit(" 0.0 0.1 100 200 ? Sl 10:00 0:01 "), cmd)
    return e.select(F.concat(F.lit("h"), F.col("user_id")).alias("host"), line.alias("line"))


def service_status_real(spark, sf):
    """J3 with the real class names on parsed process lines."""
    procs = parse_ps(_proc_lines(spark, sf))
    hosts = t(spark, sf, "customer").select(F.concat(F.lit("h"), F.col("c_custkey")).alias("host"))
    return service_status(hosts, SERVICE_PATTERNS, procs)


def pids_by_service(spark, sf):
    """S8 -> J8 -> A8: all process ids per host and service."""
    return status_pids(parse_ps(_proc_lines(spark, sf)), SERVICE_PATTERNS).select("host", "service", "pids", "n")


def xml_write(spark, sf):
    """K1 then S2: a site file per block of orders, written from scattered
    rows and read back with its partition value."""
    li = t(spark, sf, "lineitem")
    props = li.select(F.floor(F.col("l_orderkey") / 1000).cast("string").alias("source"),
                        F.concat(F.lit("p."), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("name"),
                        F.concat(F.lit("<&v "), F.col("l_suppkey")).alias("value"), F.lit(None).cast("string").alias("description"))
    path = scratch_path(spark, "site-xml")
    write_site_xml(props.repartition(*props.columns), path, partition_by=["source"])
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    files = back.select(F.regexp_extract("path", "source=([0-9]+)", 1).alias("source")).groupBy("source").agg(
        F.count("*").alias("files"))
    return read_site_xml(spark, path).join(files, "source").select("source", "name", "value", "files")


def props_write(spark, sf):
    """K2 then S3: property files per nation whose references resolve only
    within their file."""
    s = t(spark, sf, "supplier")
    src = F.col("s_nationkey").cast("string").alias("source")
    base = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.lit("base").alias("key"),
                                         F.concat(F.lit("/b"), F.col("n_nationkey")).alias("value"))
    refs = s.select(src, F.concat(F.lit("k"), F.col("s_suppkey")).alias("key"),
                    F.concat(F.lit("${base}/"), F.col("s_suppkey")).alias("value"))
    path = scratch_path(spark, "props")
    write_properties(base.unionByName(refs).repartition(6), path, partition_by=["source"])
    back = read_properties(spark, f"{path}/*/*.txt")
    out = resolve_refs(back)
    return out.select(F.regexp_extract("source", "source=([0-9]+)", 1).alias("source"), "key",
                      F.col("resolved").alias("value"))


def part_write(spark, sf):
    """K3: line items distributed by return flag and status, read back."""
    path = scratch_path(spark, "parts")
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    write_partitioned(li, path, ["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


def uniq_hosts(spark, sf):
    """O3: distinct hosts of the pages' addresses."""
    p = t(spark, sf, "pages")
    return setops.uniq(p.select(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host")), "host")


def primary_host(spark, sf):
    """The first order of every customer by date, then key."""
    o = t(spark, sf, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("pos"), "o_orderkey")
    return windows.primary(o, ["o_custkey"], "pos", "o_orderkey")


def stanza_parse(spark, sf):
    """One stanza file per conversation, a ``Host turn<n>`` block per
    turn with indented attributes, a comment, a blank line, and an indented
    line before the first block (not part of any block)."""
    c = t(spark, sf, "conversations")
    body = F.array(F.concat(F.lit("Host turn"), F.col("turn")),
                   F.concat(F.lit("    Role "), F.col("role")),
                   F.concat(F.lit("    Chars "), F.length("text"), F.lit("  ")),
                   F.lit("    # generated"), F.lit(""))
    rows = (c.select(F.col("conv_id").alias("source"), "turn", F.posexplode(body).alias("pos", "line"))
             .select("source", (F.col("turn") * 10 + F.col("pos")).alias("line_no"), "line"))
    pre = c.where(F.col("turn") == 0).select(F.col("conv_id").alias("source"),
                                             F.lit(-1).cast("long").alias("line_no"),
                                             F.lit("    Preamble outside any block").alias("line"))
    return parse_blocks(rows.unionByName(pre)).select("source", "block", "attr", "value")


# ---------------------------------------------------------------- predicates

def alias_lookup(spark, sf):
    """Service spellings per order priority looked up in a placement
    table built from ``supplier`` (service list per canonical service), one
    row per spelling with the number of orders that use it."""
    o = t(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    name = (F.when(pr == "1-URGENT", F.lit("SCM")).when(pr == "2-HIGH", F.lit("DataNode"))
             .when(pr == "3-MEDIUM", F.lit("datanode")).when(pr == "4-NOT SPECIFIED", F.lit("Datanode"))
             .otherwise(F.lit("om")))
    s = t(spark, sf, "supplier")
    svc = F.element_at(F.array(*[F.lit(x) for x in lookup.SERVICE_ALIASES]),
                       (F.col("s_nationkey") % 6 + 1).cast("int"))
    placement = aggs.ordered_list(s.select(svc.alias("service"), "s_suppkey", "s_name"),
                                  ["service"], "s_suppkey", "s_name", out="hosts")
    req = o.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return lookup.lookup(req, "name", placement, "service", "hosts").select("name", "n", "hosts")


def default_fill(spark, sf):
    """Label values per document; missing quality -> first "cluster
    host" (lang), missing toxic -> all of them (lang,source)."""
    d = t(spark, sf, "documents")
    lb = t(spark, sf, "labels")
    j = d.join(lb, "doc_id", "left")
    cluster = F.concat_ws(",", F.col("lang"), F.col("source"))
    return j.select("doc_id",
                    fill_placement(F.col("quality").cast("string"), cluster, False).alias("quality_hosts"),
                    fill_placement(F.col("toxic").cast("string"), cluster, True).alias("toxic_hosts"))


def list_flatten(spark, sf):
    """Every line of every document with its 0-based position."""
    d = t(spark, sf, "documents")
    e = explode_list(d.select("doc_id", "text"), "text", sep="\n", pos="pos", out="line", normalise=False)
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def norm_text(spark, sf):
    """``xargs``-style normalisation of ``benchmark.text``."""
    b = t(spark, sf, "benchmark")
    return b.select("item_id", norm_host(F.col("text")).alias("norm"))


def flag_parse(spark, sf):
    """P5: boolean strings rendered from order status."""
    o = t(spark, sf, "orders")
    txt = (F.when(F.col("o_orderstatus") == "F", F.lit("True"))
            .when(F.col("o_orderstatus") == "O", F.lit("FALSE")))
    return o.select("o_orderkey", txt.alias("flag_text")).withColumn("flag", flag(F.col("flag_text")))


def allow_list(spark, sf):
    """Part size as a requested JDK; not in {8,11,17,21} -> 8."""
    p = t(spark, sf, "part")
    return p.select("p_partkey", "p_size", allow_or(F.col("p_size"), [8, 11, 17, 21], 8).alias("jdk"))


def eligible_reason(spark, sf):
    """Platform eligibility on host facts rendered from line-item flags."""
    li = t(spark, sf, "lineitem")
    os_type = F.when(F.col("l_returnflag") == "N", F.lit("Darwin")).otherwise(F.lit("Linux"))
    arch = (F.when(F.col("l_linestatus") == "F", F.lit("ppc64le"))
             .when(F.col("l_returnflag") == "R", F.lit("aarch64")).otherwise(F.lit("x86_64")))
    e = rules.eligibility(li.select(os_type.alias("os_type"), arch.alias("cpu_arch")))
    return e.groupBy("os_type", "cpu_arch", "eligible", "reason").agg(F.count(F.lit(1)).alias("n"))


def code_map(spark, sf):
    """Architecture (rendered per nation) -> download code."""
    c = t(spark, sf, "customer")
    n = t(spark, sf, "nation")
    cn = joins.lookup_dim(c.select("c_custkey", "c_nationkey"),
                          n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    arch = F.element_at(F.array(F.lit("x86_64"), F.lit("aarch64"), F.lit("arm64"), F.lit("ppc64le")),
                        (F.col("c_nationkey") % 4 + 1).cast("int"))
    m = lookup.map_code(cn.select("c_custkey", "n_name", arch.alias("arch")), "arch", lookup.ARCH_CODES)
    return m.select("c_custkey", "n_name", "arch", "code")


def jdk_choice(spark, sf):
    """Packages per customer; what is on offer depends on the nation."""
    c = t(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    hosts = c.select(F.concat(F.lit("h"), k).alias("host"),
                     F.element_at(F.array(*[F.lit(x) for x in ("yum", "dnf", "apt-get", "zypper", "brew")]),
                                  (k % 5 + 1).cast("int")).alias("manager"),
                     F.element_at(F.array(F.lit("8"), F.lit("11"), F.lit("17")), (n % 3 + 1).cast("int")).alias("jdk"))
    all_ = ["java-1.8.0-openjdk", "java-1.8.0-openjdk-devel", "java-11-openjdk", "java-11-openjdk-devel",
            "java-17-openjdk", "openjdk-17-jdk", "openjdk-11-jdk", "java-1_8_0-openjdk", "vim"]
    offered = c.select(F.concat(F.lit("h"), k).alias("host"), n.alias("n"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(x).alias("package")) for i, x in enumerate(all_)])).alias("p")).where(
        (F.col("p.i") + F.col("n")) % 4 != 0).select("host", "p.package")
    out = jdk_packages(hosts, offered)
    return out.select("host", "manager", "jdk", F.array_join("packages", " ").alias("packages"))


def os_fallback(spark, sf):
    """Os-release, redhat-release or nothing, per supplier."""
    s = t(spark, sf, "supplier")
    k = F.col("s_suppkey")
    facts = s.select("s_suppkey", F.when(k % 5 == 0, F.lit("Darwin")).otherwise(F.lit("Linux")).alias("os_type"),
                     F.when(k % 4 == 0, F.lit("rocky")).alias("os_id"),
                     F.when(k % 8 == 0, F.lit("9.2")).alias("os_version"),
                     F.when(k % 3 == 0, F.concat(F.lit("Red Hat release "), k, F.lit(".4 (x)"))).alias("redhat_release"))
    return os_facts(facts).select("s_suppkey", "os_dist", "dist_version")


def manifest_targets(spark, sf):
    """J2 -> J9: files that should be on every nation's host, checked against
    what the suppliers' runs shipped; absent ones have a row."""
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("host"))
    path = F.concat_ws("/", "folder", "file").alias("file")
    targets = config_targets(n).select("host", path)
    names = [f"{d}/{f}" for d in CONFIG_FOLDERS for f in CONFIG_FILES]
    named = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))
    # every part is a block of one of the files; sizes come to one of five values
    expected = t(spark, sf, "part").groupBy(named(F.col("p_partkey")).alias("file")).agg(
        (F.sum("p_size") % 5 * 10 + 10).alias("size"))
    shipped = t(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey")).alias("host"), named(F.col("s_suppkey")).alias("file"),
        F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") % 5 * 10 + 10).otherwise(F.lit(0)).alias("size")).distinct()
    return joins.verify_manifest(expected, shipped, "file", "size", targets=targets)


def template_fill(spark, sf):
    """Download URL per part with a version rendered from size and key."""
    p = t(spark, sf, "part")
    ver = F.concat(F.col("p_size"), F.lit(".0."), F.col("p_partkey"))
    return p.select("p_partkey", fill_template(DOWNLOAD_URL_TEMPLATE, {"OZONE_VERSION": ver}).alias("url"))


ORDER_RULES = [
    ("status", "eq", "F"),
    ("priority", "contains", "URGENT"),
    ("price_band", "in", "0,1,2"),
    ("open_flag", "prefix", "O"),
]


def rule_eval(spark, sf):
    """Rule table over unpivoted order facts; ``open_flag`` is
    missing (null) for status P and must give n/a."""
    o = t(spark, sf, "orders")
    wide = o.select("o_orderkey",
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority"),
                    F.floor(F.col("o_totalprice") / 100000).cast("string").alias("price_band"),
                    F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("open_flag"))
    long_ = rules.to_long(wide, ["o_orderkey"], ["status", "priority", "price_band", "open_flag"])
    r = rules.rule_eval(long_, rules.rule_table(spark, ORDER_RULES))
    return r.select("o_orderkey", "setting", "raw_value", "status")


def missing_keys(spark, sf):
    """Every document must have non-empty ``quality`` and ``toxic`` labels."""
    d = t(spark, sf, "documents")
    lb = t(spark, sf, "labels")
    present = rules.to_long(lb, ["doc_id"], ["quality", "toxic"], "key", "value")
    out = rules.missing_keys(present.withColumnRenamed("doc_id", "source"),
                             d.select(F.col("doc_id").alias("source")), ["quality", "toxic"])
    return out.select("source", "key")


def status_class(spark, sf):
    """Safe-mode status texts rendered from event types."""
    e = t(spark, sf, "events")
    et = F.col("event_type")
    raw = (F.when(et == "purchase", F.lit("Safe mode is OFF"))
            .when(et == "error", F.lit("FAILED"))
            .when(et == "signup", F.lit("SCM exited safe mode"))
            .when(et == "click", F.lit("cluster is out of safe mode"))
            .otherwise(F.lit("failed")))
    c = e.select("event_type", classify_status(raw).alias("status"))
    return c.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


def url_build(spark, sf):
    """One service per region (some spellings unknown), host per nation."""
    n = t(spark, sf, "nation")
    r = t(spark, sf, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    rn = F.col("r_name")
    svc = (F.when(rn == "AFRICA", F.lit("om")).when(rn == "AMERICA", F.lit("SCM"))
            .when(rn == "ASIA", F.lit("DataNode")).when(rn == "EUROPE", F.lit("recon"))
            .otherwise(F.lit("Prometheus")))
    p = nr.select("n_nationkey", svc.alias("service"), F.lower(F.col("n_name")).alias("host"))
    return lookup.service_urls(p).select("n_nationkey", "service", "url")


def size_verify(spark, sf):
    """Declared ``n_chars`` against the byte length of the text."""
    d = t(spark, sf, "documents")
    b = F.octet_length(F.col("text")).cast("long")
    return d.select("doc_id", F.col("n_chars"), b.alias("bytes"),
                    rules.verify_size(F.col("n_chars"), b).alias("ok"))


# ---------------------------------------------------------------- joins

def cross_expand(spark, sf):
    """Nation x region."""
    return joins.expand(t(spark, sf, "nation").select("n_nationkey"),
                        t(spark, sf, "region").select("r_regionkey"))


def cross3(spark, sf):
    """Nation x region x distinct return flags (aggregated before crossing)."""
    flags = t(spark, sf, "lineitem").select("l_returnflag").distinct()
    return joins.config_manifest(t(spark, sf, "nation").select("n_nationkey"),
                                 t(spark, sf, "region").select("r_regionkey"), flags)


def presence_matrix(spark, sf):
    """Every customer x every event type, running when the user has an
    event of that type; pid = first event id in (ts, event_id) order."""
    hosts = t(spark, sf, "customer").select(F.col("c_custkey").alias("host"))
    services = [(x, x) for x in EVENT_TYPES]
    procs = t(spark, sf, "events").select(F.col("user_id").alias("host"), F.col("event_type").alias("cmd"),
                                          F.col("event_id").alias("pid"), "ts")
    return service_status(hosts, services, procs, order=("ts", "pid"))


def semi_labels(spark, sf):
    """Documents that have labels."""
    return joins.semi(t(spark, sf, "documents").select("doc_id", "lang"),
                      t(spark, sf, "labels"), "doc_id")


def anti_labels(spark, sf):
    """Documents with no labels."""
    return joins.anti(t(spark, sf, "documents").select("doc_id", "lang"),
                      t(spark, sf, "labels"), "doc_id")


def dim_lookup(spark, sf):
    """Supplier -> nation name."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nk"))
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    return joins.lookup_dim(s, n, "nk").select("s_suppkey", "s_name", "n_name")


def drift(spark, sf):
    """Brands of all parts, expected under the part's key, found under
    another key where the part is large, and with the type for a brand where
    the price is above 950."""
    p = t(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    exp = p.select(F.when(F.col("p_size") <= 40, key).otherwise(F.concat(F.lit("e"), key)).alias("name"),
                   F.col("p_brand").alias("value"))
    act = p.select(F.when(F.col("p_size") >= 10, key).otherwise(F.lit("small")).alias("name"),
                   F.when(F.col("p_retailprice") > 950, F.col("p_type")).otherwise(F.col("p_brand")).alias("value"))
    return joins.drift(exp, act, ["name"], "value")


def contains_join(spark, sf):
    """(document, benchmark item) where the document text contains the
    item text - whole texts, exact."""
    return joins.pattern_join(t(spark, sf, "documents"), "text", "doc_id",
                              t(spark, sf, "benchmark"), "text", "item_id")


def manifest_verify(spark, sf):
    """Shipped sizes (bytes of text, per source host) vs the manifest (n_chars)."""
    d = t(spark, sf, "documents")
    expected = d.select(F.col("doc_id").alias("file"), F.col("n_chars").alias("size"))
    shipped = d.select(F.col("source").alias("host"), F.col("doc_id").alias("file"),
                       F.octet_length("text").cast("long").alias("size"))
    return joins.verify_manifest(expected, shipped, "file", "size")


PICK_PRIORITY = ["2-HIGH", "1-URGENT", "4-NOT SPECIFIED", "5-LOW"]


def pick_alt(spark, sf):
    """Requested priority 3-MEDIUM if the customer has it, else the
    first available of 2-HIGH, 1-URGENT, 4-NOT SPECIFIED, 5-LOW."""
    o = t(spark, sf, "orders")
    return joins.pick_available(o, ["o_custkey"], "o_orderpriority", F.lit("3-MEDIUM"), PICK_PRIORITY)


# ---------------------------------------------------------------- aggregates

def ha_flag(spark, sf):
    """A1: suppliers per order and the HA flag."""
    li = t(spark, sf, "lineitem")
    return aggs.ha_flags(li.select("l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey")


def ordered_list(spark, sf):
    """A2: order keys per customer, comma-joined in key order."""
    o = t(spark, sf, "orders")
    return aggs.ordered_list(o, ["o_custkey"], "o_orderkey", "o_orderkey", out="order_list")


def run_summary(spark, sf):
    """A3: one run per user; error events are failed steps on host
    ``h<first number of props>``."""
    e = t(spark, sf, "events")
    steps = e.select("user_id",
                     F.concat(F.lit("h"), first_number(F.col("props"))).alias("host"),
                     F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS"))
                      .alias("status"))
    return aggs.run_summary(steps, "user_id", "host", "status")


def any_issue(spark, sf):
    """A4: orders with any returned line."""
    li = t(spark, sf, "lineitem")
    return aggs.any_issue(li, ["l_orderkey"], F.col("l_returnflag") == "R")


def kind_counts(spark, sf):
    """A5/O3: pages per top-level domain and distinct hosts per domain."""
    p = t(spark, sf, "pages")
    host = F.regexp_extract(F.col("url"), r"^[a-z]+://([^/:?#]+)", 1)
    return aggs.kind_counts(p.select("url", host.alias("host")), F.col("host"),
                            r"\.([A-Za-z0-9-]+)$", kind="tld", distinct_of="host")


def rollup_flags(spark, sf):
    """Per return flag and overall: lines run / passed (status F) / failed."""
    li = t(spark, sf, "lineitem")
    res = li.select("l_returnflag", F.when(F.col("l_linestatus") == "F", F.lit("PASS"))
                    .otherwise(F.lit("FAIL")).alias("status"))
    return aggs.test_rollup(res, "l_returnflag", "status")


def first_by(spark, sf):
    """Each user's first event in (ts, event_id) order."""
    e = t(spark, sf, "events")
    return aggs.first_by(e, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def collect_sorted(spark, sf):
    """Sorted order keys per customer."""
    o = t(spark, sf, "orders")
    return aggs.collect_sorted(o, ["o_custkey"], "o_orderkey", out="pids")


def pivot_long(spark, sf):
    """Per order, the largest quantity per return flag as columns."""
    li = t(spark, sf, "lineitem")
    return aggs.pivot_facts(li, ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])


def branch_union(spark, sf):
    """A10: SCM-style properties per order (cluster = order, hosts = its
    suppliers by line number): HA branch when more than one line."""
    li = t(spark, sf, "lineitem")
    p = li.select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("pos"),
                  F.concat(F.lit("s"), F.col("l_suppkey")).alias("host"))
    sid = F.concat(F.lit("cluster"), F.col("cluster"))
    return service_props(p, ["cluster"], "ozone.scm", sid, single="scm").select("cluster", "name", "value")


# ---------------------------------------------------------------- windows

def elect_first(spark, sf):
    """Per customer, the lowest order key is ``--init``, others ``--bootstrap``."""
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return windows.elect(o, ["o_custkey"], "o_orderkey")


def retry_outcome(spark, sf):
    """Per user, polls in (ts, event_id) order until a purchase, max 3."""
    e = t(spark, sf, "events")
    r = windows.retry_outcome(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase",
                              max_attempts=3)
    return r.select("user_id", "outcome", "attempts", "polls", "exit_event_id")


def context_after(spark, sf):
    """``grep -A 2 error | grep purchase`` per user."""
    e = t(spark, sf, "events")
    c = windows.context(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)
    return c.where(F.col("in_context") & (F.col("event_type") == "purchase")).select("user_id", "event_id")


def range_drop(spark, sf):
    """``sed '/signup/,/purchase/d'`` per user."""
    e = t(spark, sf, "events")
    kept = windows.drop_ranges(e, ["user_id"], ["ts", "event_id"],
                               F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return kept.select("user_id", "event_id")


def block_carry(spark, sf):
    """The last user turn at or before each turn of a conversation."""
    c = t(spark, sf, "conversations")
    out = windows.carry(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")),
                        "last_user_turn")
    return out.select("conv_id", "turn", "role", "last_user_turn")


def inflight_peak(spark, sf):
    """Open line items (order date .. ship date) per customer nation:
    peak, seconds above 10 and the intervals that end before they start."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    iv = (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(c, o.o_custkey == c.c_custkey)
            .select("c_nationkey", "o_orderdate", "l_shipdate"))
    return windows.inflight(iv, ["c_nationkey"], "o_orderdate", "l_shipdate", cap=10)


# ---------------------------------------------------------------- ordering / sets

def top_n(spark, sf):
    """O1: the ten most expensive orders."""
    o = t(spark, sf, "orders")
    return setops.top_n(o.select("o_orderkey", "o_totalprice"),
                        [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


RANK_ORDER = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH"]


def rank_order(spark, sf):
    """O2: per customer, orders in a dependency order of priorities
    (unlisted last), then key; ``stop_seq`` is the reverse."""
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    r = setops.ordered_plan(o, ["o_custkey"], "o_orderpriority", "o_orderkey", RANK_ORDER)
    return r.select("o_custkey", "o_orderkey", "seq", "stop_seq")


def union_keys(spark, sf):
    """Nations of customers or suppliers."""
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return setops.all_hosts(c, s, col="nationkey")


def except_keys(spark, sf):
    """Document ids with no label (EXCEPT DISTINCT)."""
    return setops.unplaced(t(spark, sf, "documents"), t(spark, sf, "labels"), ["doc_id"])


def intersect_keys(spark, sf):
    """Document ids with a label (INTERSECT DISTINCT)."""
    return setops.intersect(t(spark, sf, "documents"), t(spark, sf, "labels"), ["doc_id"])


def cube_flags(spark, sf):
    """U4: line counts and quantity over the cube of (return flag, line status)."""
    li = t(spark, sf, "lineitem")
    return setops.placement_cube(li, ["l_returnflag", "l_linestatus"],
                                 [F.count(F.lit(1)).alias("n"),
                                  F.round(F.sum("l_quantity"), 2).alias("sum_qty")])


