"""Install-time checks for a fleet.

Host facts -> platform eligibility (S5, P7); kernel, file-system and
directory facts -> rule verdicts (P10–P12); step tokens -> per-run summary
(S7, A3) and the requested hosts with no successful step (J5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.aggs import run_summary
from fleetframe.operators.joins import anti, config_manifest
from fleetframe.operators.rules import check_dirs, check_filesystems, check_kernel, eligibility
from fleetframe.sources.records import parse_host_facts, parse_step

# Package names by manager and JDK, the versions tried in turn
# where the wanted one is not on offer, and where the configuration files go.
RPM_MANAGERS = ("yum", "dnf")
RPM_JDK8 = "java-1.8.0-openjdk"
SUSE_JDK8 = "java-1_8_0-openjdk"
ALTERNATIVES = ("11", "17", "21", "8")
CONFIG_FOLDERS = ("/etc/hadoop", "/opt/ozone/conf/om", "/opt/ozone/conf/scm", "/opt/ozone/conf/datanode",
                  "/opt/ozone/conf/recon", "/opt/ozone/conf/s3g", "/opt/ozone/conf/httpfs", "/opt/ozone/etc/hadoop")
CONFIG_FILES = ("core-site.xml", "ozone-site.xml", "log4j.properties")


def os_facts(df: DataFrame, os_type: str = "os_type", os_id: str = "os_id", os_version: str = "os_version",
             redhat_release: str = "redhat_release") -> DataFrame:
    """S10 fallbacks: add ``os_dist`` and ``dist_version``.

    On Linux the os-release fields, else ``redhat`` and the first number of
    the redhat-release line, else ``unknown``; elsewhere ``non-linux`` and
    ``unknown``.  A field that os-release leaves out is empty.
    """
    has = F.col(os_id).isNotNull() | F.col(os_version).isNotNull()
    red = F.col(redhat_release).isNotNull()
    linux = F.coalesce(F.col(os_type) == "Linux", F.lit(False))
    unknown = F.lit("unknown")
    return (df.withColumn("os_dist", F.when(~linux, F.lit("non-linux")).when(has, F.coalesce(os_id, F.lit("")))
                          .when(red, F.lit("redhat")).otherwise(unknown))
              .withColumn("dist_version", F.when(~linux, unknown).when(has, F.coalesce(os_version, F.lit("")))
                          .when(red, F.regexp_extract(redhat_release, "[0-9]+", 0)).otherwise(unknown)))


def jdk_packages(df: DataFrame, offered: DataFrame, host: str = "host", manager: str = "manager", jdk: str = "jdk",
                 package: str = "package") -> DataFrame:
    """P8 with J10: add ``packages``, what to install on each host, from the
    packages its manager offers (``offered``: host, package); empty where
    nothing fits or the manager is not known.

    yum and dnf: the runtime and development packages; JDK 8 has its own name
    and, where that is not on offer, gives way to 11.  zypper: the same with
    its own name for 8.  apt-get: one package; where it is missing, the first
    other version on offer.  Names that are not offered are left out.
    """
    v, m = F.col(jdk).cast("string"), F.col(manager)
    both = lambda name: F.array(name, F.concat(name, F.lit("-devel")))
    plain = F.concat(F.lit("java-"), v, F.lit("-openjdk"))
    rpm = F.when(v != "8", both(plain)).when(F.array_contains("_ff_have", RPM_JDK8), both(F.lit(RPM_JDK8))).otherwise(
        both(F.lit("java-11-openjdk")))
    suse = F.when(v == "8", both(F.lit(SUSE_JDK8))).otherwise(both(plain))
    apt = F.concat(F.array(F.concat(F.lit("openjdk-"), v, F.lit("-jdk"))),
                   F.array(*[F.lit(f"openjdk-{a}-jdk") for a in ALTERNATIVES]))
    names = F.when(m.isin(*RPM_MANAGERS), rpm).when(m == "zypper", suse).when(m == "apt-get", apt).otherwise(
        F.array().cast("array<string>"))
    # only names that can be asked for are gathered: at most a few a host
    known = offered.where(F.col(package).rlike(r"^(java-[0-9._]+-openjdk(-devel)?|openjdk-[0-9]+-jdk)$"))
    have = known.groupBy(F.col(host).alias("_ff_host")).agg(F.collect_set(package).alias("_ff_have"))
    none = F.array().cast("array<string>")
    joined = df.join(have, F.col(host) == F.col("_ff_host"), "left").withColumn("_ff_have", F.coalesce("_ff_have", none))
    fit = F.filter(names, lambda x: F.array_contains("_ff_have", x))
    return (joined.withColumn("packages", F.coalesce(F.when(m == "apt-get", F.slice(fit, 1, 1)).otherwise(fit), none))
            .drop("_ff_host", "_ff_have"))


def config_targets(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Every file that a distribution run puts on every host: ``(host,
    folder, file)``, eight folders with three files each."""
    spark = hosts.sparkSession
    return config_manifest(hosts.select(host).distinct(),
                           F.broadcast(spark.createDataFrame([(f,) for f in CONFIG_FOLDERS], "folder string")),
                           F.broadcast(spark.createDataFrame([(f,) for f in CONFIG_FILES], "file string")))


def host_eligibility(raw_facts: DataFrame, raw: str = "raw") -> DataFrame:
    """``(host, raw)`` pipe records -> parsed facts with ``eligible``/``reason``."""
    return eligibility(parse_host_facts(raw_facts, raw))


def compliance(settings: DataFrame | None = None, fs_facts: DataFrame | None = None,
               dir_facts: DataFrame | None = None) -> DataFrame:
    """All rule verdicts as one table ``(host, check, setting, raw_value, status)``."""
    parts = []
    if settings is not None:
        parts.append(check_kernel(settings).select(
            "host", F.lit("kernel").alias("check"), "setting", "raw_value", "status"))
    if fs_facts is not None:
        parts.append(check_filesystems(fs_facts).select(
            "host", F.concat(F.lit("filesystem:"), F.col("dir")).alias("check"),
            "setting", "raw_value", "status"))
    if dir_facts is not None:
        parts.append(check_dirs(dir_facts).select(
            "host", F.concat(F.lit("directory:"), F.col("dir")).alias("check"),
            "setting", "raw_value", "status"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def step_report(step_lines: DataFrame, requested: DataFrame, run: str = "run_id",
                line: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(summary, failed)``: per-run counts and failed-host list, and every
    requested ``(run, host)`` without a ``SUCCESS`` token (a host that never
    reported counts as failed, as in the reference's verification pass)."""
    steps = parse_step(step_lines, line)
    summary = run_summary(steps.where(F.col("status").isNotNull()), run, "host", "status")
    ok = steps.where(F.col("status") == "SUCCESS").select(run, "host").distinct()
    failed = anti(requested.select(run, "host"), ok, [run, "host"])
    return summary, failed


__all__ = ["os_facts", "jdk_packages", "config_targets", "host_eligibility", "compliance", "step_report"]
