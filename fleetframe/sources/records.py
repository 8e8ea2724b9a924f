"""Single-line record parsers: host facts (S5), run logs (S6), step results
(S7), process snapshots (S8) and test output (S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.text import strip_ansi

# Field order of the host-fact record, run-log line layout,
# level words, step tokens and test-result tags.
HOST_FACT_FIELDS = ("hostname", "ip_address", "cpu_arch", "os_type", "os_dist", "os_version")
LOG_RE = r"(?s)^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (?:(WARNING|ERROR|INFO): )?(.*)$"
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
PLAIN_LEVEL = "LOG"
STEP_STATUSES = ("SUCCESS", "FAILED")
TEST_RE = r"(?s)^\[(PASS|FAIL|TEST)\] (.*)$"


def parse_host_facts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``hostname|ip|arch|os_type|os_dist|os_version`` -> six string columns
    (a missing field is null)."""
    parts = F.split(F.col(raw), r"\|", -1)
    return df.select("*", *[F.try_element_at(parts, F.lit(i + 1)).alias(n)
                            for i, n in enumerate(HOST_FACT_FIELDS)])


def parse_run_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Strip ANSI colour codes, then ``[yyyy-MM-dd HH:mm:ss] LEVEL: text``.

    Lines written by the plain ``log`` function carry no level word and get
    ``LOG``.  The stamp has no zone, so ``ts`` is a wall-clock ``timestamp_ntz``.  A line that does not match keeps ``ts``/``level`` null and its
    cleaned text as ``message``.
    """
    # one match a line: its groups behind a mark that no matching line begins
    # with; columns of their own are evaluated once
    mark = "\u0001"
    clean, parts = F.col("_ff_clean"), F.col("_ff_parts")
    ok = clean.startswith("[") & (F.get(parts, 0) == "")
    read = df.withColumn("_ff_clean", strip_ansi(F.col(line))).withColumn("_ff_parts", F.split(F.regexp_replace(
        clean, LOG_RE, f"{mark}$1{mark}$2{mark}$3"), mark, 4))
    return read.select(
        *df.columns,
        F.when(ok, F.try_to_timestamp(F.get(parts, 1), F.lit(LOG_TS_FORMAT)).cast("timestamp_ntz")).alias("ts"),
        F.when(ok, F.coalesce(F.nullif(F.get(parts, 2), F.lit("")), F.lit(PLAIN_LEVEL))).alias("level"),
        F.when(ok, F.get(parts, 3)).otherwise(clean).alias("message"))



def parse_step(df: DataFrame, line: str = "line") -> DataFrame:
    """``SUCCESS:host`` / ``FAILED:host:stage`` -> status, host, stage.
    Unknown status words give null status."""
    parts = F.split(F.col(line), ":", 3)
    status = parts.getItem(0)
    return df.select(
        "*",
        F.when(status.isin(*STEP_STATUSES), status).alias("status"),
        F.try_element_at(parts, F.lit(2)).alias("host"),
        F.try_element_at(parts, F.lit(3)).alias("stage"))


def parse_ps(df: DataFrame, line: str = "line", drop_grep: bool = True) -> DataFrame:
    """A ``ps aux`` row -> user, pid (field 2), cmd (field 11 onward).

    ``drop_grep`` removes the row of the ``grep`` that listed the processes,
    as ``grep -v grep`` does in the reference.
    """
    fields = F.split(F.trim(F.col(line)), r"\s+", 11)
    out = df.select("*",
                    fields.getItem(0).alias("user"),
                    F.try_element_at(fields, F.lit(2)).try_cast("long").alias("pid"),
                    F.try_element_at(fields, F.lit(11)).alias("cmd"))
    if drop_grep:
        out = out.where(~F.col(line).contains("grep"))
    return out


def parse_test_log(df: DataFrame, line: str = "line") -> DataFrame:
    """``[PASS] name`` / ``[FAIL] name`` (colour codes removed) -> status, name;
    other lines are dropped."""
    clean = strip_ansi(F.col(line))
    return (df.where(clean.rlike(TEST_RE))
              .select("*", F.regexp_extract(clean, TEST_RE, 1).alias("status"),
                      F.regexp_extract(clean, TEST_RE, 2).alias("name")))


__all__ = ["parse_host_facts", "parse_run_log", "parse_step", "parse_ps",
           "parse_test_log", "HOST_FACT_FIELDS"]
