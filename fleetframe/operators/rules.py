"""Predicates and rule checks.

Rules are rows of a table ``(setting, op, expected)``, so a user adds a
check without code.  Facts are long ``(host, setting, raw_value)`` rows; a
null raw value means the facility is missing on the host and yields
``n/a``, not a violation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values from the reference.
SUPPORTED_OS = "Linux"
SUPPORTED_ARCHS = ("x86_64", "aarch64", "arm64")
REASON_OS = "not Linux"
REASON_ARCH = "unsupported CPU architecture"

KERNEL_RULES = [
    ("cpu_governor", "eq", "performance"),
    ("transparent_hugepage", "contains", "[never]"),
    ("selinux", "eq", "Disabled"),
    ("swappiness", "eq", "1"),
]
FS_RULES = [
    ("fs_type", "in", "ext4,xfs"),
    ("mount_options", "contains", "noatime"),
]
DIR_RULES = [
    ("exists", "eq", "true"),
    ("owner", "eq_expected", None),
    ("perms", "in", "750,755"),
    ("writable", "eq", "true"),
]
# A configuration directory that is absent is skipped, not a violation.
CONFIG_DIR_RULES = [
    ("owner", "eq_expected", None),
]
RULE_SCHEMA = "setting string, op string, expected string"
OPS = ("eq", "ne", "in", "contains", "not_contains", "prefix", "regex", "eq_expected")


def eligibility(df: DataFrame, os_type: str = "os_type", arch: str = "cpu_arch") -> DataFrame:
    """``eligible`` and the first failing ``reason`` (OS checked before arch)."""
    reason = (F.when(F.coalesce(F.col(os_type) != F.lit(SUPPORTED_OS), F.lit(True)), F.lit(REASON_OS))
               .when(~F.coalesce(F.col(arch).isin(*SUPPORTED_ARCHS), F.lit(False)), F.lit(REASON_ARCH)))
    return df.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def rule_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    """A table of rules given as a list.  It is marked for broadcasting: Spark
    does not know the size of such a table and would deal the facts out by
    their settings, which are few, each to one task."""
    return F.broadcast(spark.createDataFrame(list(rules), RULE_SCHEMA))


def _verdict(raw: Column, op: Column, expected: Column) -> Column:
    items = F.split(expected, ",")
    passed = (F.when(op == "eq", raw == expected)
               .when(op == "eq_expected", raw == expected)
               .when(op == "ne", raw != expected)
               .when(op == "in", F.array_contains(items, raw))
               .when(op == "contains", raw.contains(expected))
               .when(op == "not_contains", ~raw.contains(expected))
               .when(op == "prefix", raw.startswith(expected))
               .when(op == "regex", F.regexp_like(raw, expected)))
    return (F.when(raw.isNull(), F.lit("n/a"))
             .when(F.coalesce(passed, F.lit(False)), F.lit("ok"))
             .otherwise(F.lit("violation")))


def rule_eval(facts: DataFrame, rules: DataFrame, setting: str = "setting",
              raw: str = "raw_value", expected_col: str | None = None) -> DataFrame:
    """Join long facts to the rule table on ``setting`` and add
    ``op``, ``expected`` and ``status`` (ok / violation / n/a).

    ``expected_col`` names a per-row expected value (for ``eq_expected``
    rules such as the expected owner of a directory).  Facts with no rule
    are dropped.  A table of :func:`rule_table` is broadcast, another one by
    its size.
    """
    r = rules.select(F.col("setting").alias(setting), "op", F.col("expected").alias("_ff_exp"))
    j = facts.join(r, setting, "inner")
    exp = F.col("_ff_exp")
    if expected_col:
        exp = F.when(F.col("op") == "eq_expected", F.col(expected_col)).otherwise(exp)
    return (j.withColumn("expected", exp)
             .withColumn("status", _verdict(F.col(raw).cast("string"), F.col("op"), F.col("expected")))
             .drop("_ff_exp"))


def to_long(df: DataFrame, ids: Sequence[str], settings: Sequence[str],
            setting: str = "setting", raw: str = "raw_value") -> DataFrame:
    """Unpivot wide facts to ``(ids, setting, raw_value)`` (values as strings)."""
    casted = df.select(*ids, *[F.col(s).cast("string").alias(s) for s in settings])
    return casted.unpivot(list(ids), list(settings), setting, raw)


def check_dirs(dir_facts: DataFrame, ids: Sequence[str] = ("host", "dir"),
               config_only: bool | Column = False, expected_owner: str = "expected_owner") -> DataFrame:
    """Directory checks.  Data directories: exists, owner, mode 750/755,
    writable.  Configuration directories (``config_only``, for all rows or row
    by row): owner only; one that is absent gives n/a.  Checks other than
    ``exists`` are n/a for a missing directory."""
    spark = dir_facts.sparkSession
    rules = rule_table(spark, DIR_RULES)
    config = config_only if isinstance(config_only, Column) else F.lit(config_only)
    present = F.coalesce(F.col("exists"), F.lit(False))
    wide = dir_facts.select(
        *ids, F.col(expected_owner), F.coalesce(config, F.lit(False)).alias("_ff_config"),
        F.lower(F.col("exists").cast("string")).alias("exists"),
        *[F.when(present, F.col(c)).alias(c) for c in ("owner", "perms")],
        F.when(present, F.lower(F.col("writable").cast("string"))).alias("writable"))
    long_ = wide.unpivot([*ids, expected_owner, "_ff_config"], ["exists", "owner", "perms", "writable"],
                         "setting", "raw_value")
    # the rules of configuration directories are some of the others
    long_ = long_.where(~F.col("_ff_config") | F.col("setting").isin([s for s, _, _ in CONFIG_DIR_RULES])).drop("_ff_config")
    return rule_eval(long_, rules, expected_col=expected_owner)


def check_filesystems(fs_facts: DataFrame, ids: Sequence[str] = ("host", "dir")) -> DataFrame:
    """P10: file-system type ext4/xfs and ``noatime`` in the mount options."""
    long_ = to_long(fs_facts, ids, ["fs_type", "mount_options"])
    return rule_eval(long_, rule_table(fs_facts.sparkSession, FS_RULES))


def check_kernel(settings: DataFrame) -> DataFrame:
    """Kernel settings in long form ``(host, setting, raw_value)``."""
    return rule_eval(settings, rule_table(settings.sparkSession, KERNEL_RULES))


def missing_keys(present: DataFrame, sources: DataFrame, required: Sequence[str],
                 source: str = "source", key: str = "key", value: str | None = "value") -> DataFrame:
    """``(source, key)`` for every required key that a source lacks or
    leaves empty.  ``sources`` lists every source to check (a source with
    no lines at all lacks every key)."""
    spark = present.sparkSession
    req = F.broadcast(spark.createDataFrame([(k,) for k in required], f"{key} string"))
    expected = sources.select(source).distinct().crossJoin(req)
    have = present
    if value:
        have = have.where(F.coalesce(F.length(F.col(value)) > 0, F.lit(False)))
    have = have.select(source, key).distinct()
    return expected.join(have, [source, key], "left_anti")


def verify_size(local: Column, remote: Column) -> Column:
    """Remote size equals local size and is positive (null -> false)."""
    return F.coalesce((remote == local) & (remote > 0), F.lit(False))


__all__ = ["eligibility", "rule_table", "rule_eval", "to_long", "check_dirs",
           "check_filesystems", "check_kernel", "missing_keys", "verify_size",
           "KERNEL_RULES", "FS_RULES", "DIR_RULES", "CONFIG_DIR_RULES"]
