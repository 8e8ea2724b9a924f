"""Service status across a fleet (J3 with J8 and A7).

Every host is expected to run every listed service; a service is
``running`` on a host when some process of that host matches the
service's pattern, and its pid is the first matching process in snapshot
order (``head -1``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.aggs import collect_sorted, first_by
from fleetframe.operators.joins import contains_join, expand

# The process class that identifies each service.
SERVICE_PATTERNS = [
    ("scm", "org.apache.hadoop.hdds.scm.server.StorageContainerManager"),
    ("om", "org.apache.hadoop.ozone.om.OzoneManager"),
    ("datanode", "org.apache.hadoop.ozone.HddsDatanodeService"),
    ("recon", "org.apache.hadoop.ozone.recon.ReconServer"),
    ("s3gateway", "org.apache.hadoop.ozone.s3.Gateway"),
    ("httpfs", "org.apache.hadoop.fs.http.server.HttpFSServerWebApp"),
]


def _matched(procs: DataFrame, cmd: str, services: DataFrame | Sequence[tuple[str, str]], service: str,
             pattern: str) -> DataFrame:
    """``procs`` with ``_ff_svc``, a row for each service whose pattern the
    command holds.  A list of services becomes part of the projection; a table
    of any size goes through the contains join."""
    if isinstance(services, DataFrame):
        named = services.select(F.col(service).alias("_ff_svc"), F.col(pattern).alias("_ff_pat_of"))
        return contains_join(procs, cmd, named, "_ff_pat_of").drop("_ff_pat_of")
    found = F.array_compact(F.array(*[F.when(F.col(cmd).contains(p), F.lit(s)) for s, p in services]))
    return procs.select("*", F.explode(found).alias("_ff_svc"))


def pids_by_service(procs: DataFrame, services: DataFrame | Sequence[tuple[str, str]], host: str = "host",
                    service: str = "service", pattern: str = "pattern", cmd: str = "cmd", pid: str = "pid") -> DataFrame:
    """All process ids per host and service, in ascending order, as one
    comma-joined list (what a stop run signals).  Hosts and services without
    a process have no row.  ``services`` is a table with names and patterns,
    or a short list of such pairs."""
    found = _matched(procs.select(host, cmd, pid), cmd, services, service, pattern).select(
        host, F.col("_ff_svc").alias(service), pid).distinct()
    return collect_sorted(found, [host, service], pid, out="pids")


def service_status(hosts: DataFrame, services: DataFrame | Sequence[tuple[str, str]], procs: DataFrame,
                   host: str = "host", service: str = "service", pattern: str = "pattern",
                   cmd: str = "cmd", pid: str = "pid",
                   order: Sequence[str] = ("pid",)) -> DataFrame:
    """``(host, service, status, pid)`` for every host x service; ``services``
    is a table with names and patterns, or a short list of such pairs.

    Processes are matched to the services in one scan, reduced to the first
    match per ``(host, service)`` with a partial aggregate, and only then
    joined to the host x service grid - the grid is never joined to raw
    processes.
    """
    matched = _matched(procs.select(*dict.fromkeys([host, cmd, pid, *order])), cmd, services, service, pattern)
    first = first_by(matched, [host, "_ff_svc"], list(order), [pid], prefix="")
    each = hosts.select(host).distinct()
    if isinstance(services, DataFrame):
        grid = expand(each, services.select(F.col(service).alias("_ff_svc")))
    else:
        grid = each.select(host, F.explode(F.array(*[F.lit(s) for s, _ in services])).alias("_ff_svc"))
    out = grid.join(first, [host, "_ff_svc"], "left")
    return out.select(
        host, F.col("_ff_svc").alias(service),
        F.when(F.col(pid).isNull(), F.lit("not running")).otherwise(F.lit("running")).alias("status"),
        pid)


__all__ = ["service_status", "pids_by_service", "SERVICE_PATTERNS"]
