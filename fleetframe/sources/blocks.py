"""Readers for block-structured text where a header line scopes the lines
below it: compose ports (S4), directory reports (S9) and stanza files (S11).

All carry the header forward with :func:`fleetframe.operators.windows.carry`,
which is partitioned by (source, chunk of line numbers), so one huge file is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.operators.scan import number_chunk, running
from fleetframe.operators.windows import carry
from fleetframe.sources.lines import read_lines

# Fixed layouts.
COMPOSE_SERVICE_RE = r"(?s)^  ([A-Za-z0-9_.-]+):\s*(#.*)?$"
COMPOSE_TOP_RE = r"^[A-Za-z0-9_.-]+:"
COMPOSE_PORT_RE = r"""^\s*-\s*["']?(\d+):(\d+)["']?"""
# A host line (verification or installer run), then blocks; the host scopes
# the blocks below it.  Only config directories have their own header.
DIR_HOST_RE = r"(?:Checking directory permissions on|Validating filesystem for directories on) ([^\s:]+)"
DIR_HEADER_RE = r"(?s)^(Config Directory|Directory|Checking directory):\s*(.*?)\s*$"
DIR_WRITABLE = (("Write access confirmed", True), ("No write access to directory", False))
DIR_ATTR_RE = r"(?s)^\s+(Owner|Permissions|Mount point|Filesystem type|Mount options):\s*(.*?)\s*$"
DIR_ERROR_MISSING = "Directory does not exist"
STANZA_HEADER_RE = r"^Host\s+(\S+)"
STANZA_ATTR_RE = r"(?s)^\s+(\S+)\s+(.*?)\s*$"


def compose_ports(lines: DataFrame, source: str = "source", line_no: str = "line_no",
                  line: str = "line") -> DataFrame:
    """``(source, service, host_port, container_port)`` from compose lines.

    Inside the top-level ``services:`` section a two-space-indented
    ``name:`` line names the service; ``- "2222:22"`` lines below it are its
    ports.  Both the section and the service are carried forward in one
    ordered scan; keys of other sections (``networks:``, ``volumes:``) are
    not services.
    """
    c = F.col(line)
    top = F.when(c.rlike(COMPOSE_TOP_RE), F.regexp_extract(c, r"^([A-Za-z0-9_.-]+):", 1))
    svc = (F.when(c.rlike(COMPOSE_SERVICE_RE), F.regexp_extract(c, COMPOSE_SERVICE_RE, 1))
            .when(c.rlike(COMPOSE_TOP_RE), F.lit("")))
    scoped = running(lines, [source], [line_no], number_chunk(line_no),
                     carries={"_sec": top, "_svc": svc})
    ports = scoped.where(c.rlike(COMPOSE_PORT_RE) & (F.col("_sec") == "services")
                         & (F.col("_svc") != ""))
    return ports.select(
        source, F.col("_svc").alias("service"),
        F.regexp_extract(c, COMPOSE_PORT_RE, 1).try_cast("int").alias("host_port"),
        F.regexp_extract(c, COMPOSE_PORT_RE, 2).try_cast("int").alias("container_port"))


def read_compose_ports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return compose_ports(read_lines(spark, paths))


def parse_dir_report(lines: DataFrame, source: str = "source", line_no: str = "line_no",
                     line: str = "line") -> DataFrame:
    """Directory reports -> one row per (source, host, kind, dir) with
    owner, permissions, mount point, filesystem type, mount options,
    ``writable`` and ``exists``.

    Reads the verification report (``Directory:`` blocks with write-access
    lines, then ``Config Directory:`` blocks) and the installer's
    (``Checking directory:``), several hosts one after the other.  ``kind`` is
    ``config`` for configuration directories, else ``data``; ``host`` is null
    above the first host line.  A directory listed twice on a host is one row
    in which the last line of each attribute wins.
    """
    c = F.col(line)
    host = F.when(c.rlike(DIR_HOST_RE), F.regexp_extract(c, DIR_HOST_RE, 1))
    kind = F.when(F.regexp_extract(c, DIR_HEADER_RE, 1) == "Config Directory", F.lit("config")).otherwise(F.lit("data"))
    # a host line closes the block above it
    head = (F.when(c.rlike(DIR_HEADER_RE), F.struct(kind.alias("kind"), F.regexp_extract(c, DIR_HEADER_RE, 2).alias("dir")))
             .when(host.isNotNull(), F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("dir"))))
    scoped = running(lines, [source], [line_no], number_chunk(line_no),
                     carries={"host": host, "_block": head}).withColumn("kind", F.col("_block.kind")).withColumn(
                         "dir", F.col("_block.dir"))
    attr = F.when(c.rlike(DIR_ATTR_RE), F.regexp_extract(c, DIR_ATTR_RE, 1))
    val = F.regexp_extract(c, DIR_ATTR_RE, 2)
    named = [("Owner", "owner"), ("Permissions", "perms"), ("Mount point", "mount_point"),
             ("Filesystem type", "fs_type"), ("Mount options", "mount_options")]
    # one aggregate per directory block; a repeated attribute: the last line wins
    aggs = [F.max_by(F.when(attr == a, val), F.when(attr == a, F.col(line_no))).alias(n) for a, n in named]
    wrote = F.lit(None).cast("boolean")
    for said, ok in DIR_WRITABLE:
        wrote = F.when(c.contains(said), F.lit(ok)).otherwise(wrote)
    aggs.append(F.max_by(wrote, F.when(wrote.isNotNull(), F.col(line_no))).alias("writable"))
    aggs.append(F.coalesce(F.bool_or(c.contains(DIR_ERROR_MISSING)), F.lit(False)).alias("_missing"))
    out = scoped.where(F.col("dir").isNotNull()).groupBy(source, "host", "kind", "dir").agg(*aggs)
    return out.withColumn("exists", ~F.col("_missing")).drop("_missing")


def parse_blocks(lines: DataFrame, header_re: str = STANZA_HEADER_RE,
                 attr_re: str = STANZA_ATTR_RE, source: str = "source",
                 line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Stanza files (``Host x`` then indented ``Key value`` lines) ->
    long ``(source, block, attr, value)``; pivot with :func:`pivot_facts`."""
    c = F.col(line)
    hdr = F.when(c.rlike(header_re), F.regexp_extract(c, header_re, 1))
    scoped = carry(lines.withColumn("_h", hdr), [source], line_no, "_h", "block")
    body = scoped.where(F.col("_h").isNull() & F.col("block").isNotNull()
                        & c.rlike(attr_re) & ~F.trim(c).startswith("#"))
    return body.select(source, "block",
                       F.regexp_extract(c, attr_re, 1).alias("attr"),
                       F.regexp_extract(c, attr_re, 2).alias("value"))


__all__ = ["compose_ports", "read_compose_ports", "parse_dir_report", "parse_blocks"]
