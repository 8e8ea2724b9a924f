"""S1 shell-conf reader and S10 os-release reader.

Semantics follow what ``source file.conf`` leaves in the shell:

* whole-line comments and lines that are not ``KEY=...`` (optionally
  ``export KEY=...``) are ignored;
* ``KEY="v"``: the double-quoted text, with ``\\$ \\" \\\\ \\```` unescaped
  (so ``\\${X}`` stays the literal ``${X}``); anything after the closing quote,
  such as a trailing ``# comment``, is dropped;
* ``KEY='v'``: the single-quoted text verbatim;
* ``KEY=v``: up to the first blank, backslash escapes removed;
* a later assignment of the same key wins (see :func:`last_wins`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.operators.aggs import last_wins
from fleetframe.sources.lines import read_lines

# Fixed patterns of the shell assignment grammar handled here.  ``(?s)``: lines
# are already split on newlines, and Java would otherwise stop ``.`` and ``$``
# at U+0085, U+2028 and U+2029 inside a value.
ASSIGN_RE = r"(?s)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
DQ_RE = r'(?s)^"((?:[^"\\]|\\.)*)"'
SQ_RE = r"^'([^']*)'"
BARE_RE = r"^(\S*)"


def parse_conf(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``key`` and ``value`` to every assignment line and drop the rest."""
    c = F.col(line)
    key = F.regexp_extract(c, ASSIGN_RE, 1)
    rest = F.regexp_extract(c, ASSIGN_RE, 2)
    dq = F.regexp_replace(F.regexp_extract(rest, DQ_RE, 1), r'\\([$"\\`])', "$1")
    sq = F.regexp_extract(rest, SQ_RE, 1)
    bare = F.regexp_replace(F.regexp_extract(rest, BARE_RE, 1), r"\\(.)", "$1")
    value = (F.when(rest.startswith('"'), dq)
              .when(rest.startswith("'"), sq)
              .otherwise(bare))
    return (df.where(F.regexp_like(c, F.lit(ASSIGN_RE)))
              .withColumn("key", key)
              .withColumn("value", value))


def read_conf(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Shell-style configuration files -> ``(source, line_no, key, value)``."""
    return parse_conf(read_lines(spark, paths)).select("source", "line_no", "key", "value")


def parse_os_release(lines: DataFrame, source: str = "source", line: str = "line",
                     line_no: str = "line_no") -> DataFrame:
    """``ID=`` and ``VERSION_ID=`` of an os-release file, quotes removed,
    one row per source (later assignments win)."""
    kv = parse_conf(lines, line).where(F.col("key").isin("ID", "VERSION_ID"))
    kv = last_wins(kv, source=source, line_no=line_no)
    return (kv.groupBy(source)
              .agg(F.max(F.when(F.col("key") == "ID", F.col("value"))).alias("os_id"),
                   F.max(F.when(F.col("key") == "VERSION_ID", F.col("value"))).alias("os_version")))


__all__ = ["parse_conf", "read_conf", "last_wins", "parse_os_release", "ASSIGN_RE"]
