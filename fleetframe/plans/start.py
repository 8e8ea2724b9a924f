"""Start plan, status poll and endpoints for a fleet.

Placement -> start order with the SCM election (P2 is applied upstream by
``placement_from_conf``; O2 + W1), safe-mode polls -> outcome per cluster
(P14 + W3), placement -> web URLs (P15).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.text import classify_status
from fleetframe.operators.lookup import service_urls
from fleetframe.operators.setops import START_ORDER, ordered_plan
from fleetframe.operators.windows import MAX_POLL_ATTEMPTS, elect, retry_outcome

FORMATTED_SERVICE = "scm"


def start_plan(placement: DataFrame, source: str = "source", service: str = "service",
               pos: str = "pos", host: str = "host", order: Sequence[str] = START_ORDER) -> DataFrame:
    """One row per (source, service, host): ``seq`` (start order: services in
    dependency order, hosts in configured order), ``stop_seq`` (the exact
    reverse) and ``command`` - ``--init`` for the first SCM host,
    ``--bootstrap`` for the other SCM hosts, null for other services."""
    ranked = ordered_plan(placement, [source], service, pos, order)
    scm = elect(placement.where(F.lower(F.col(service)) == FORMATTED_SERVICE), [source], pos, host=host)
    return (ranked.join(scm.select(source, service, pos, "command"), [source, service, pos], "left")
                  .select(source, service, pos, host, "seq", "stop_seq", "command"))


def poll_outcome(polls: DataFrame, cluster: str = "cluster", ts: str = "ts",
                 poll_id: str = "poll_id", raw: str = "raw",
                 max_attempts: int = MAX_POLL_ATTEMPTS) -> DataFrame:
    """Per cluster: EXITED (with the attempt number) or TIMEOUT, from the
    free-text safe-mode status of each poll (ties on ``ts`` broken by id)."""
    return retry_outcome(polls, [cluster], [ts, poll_id],
                         classify_status(F.col(raw)) == "EXITED", max_attempts)


def endpoints(placement: DataFrame, service: str = "service", host: str = "host") -> DataFrame:
    return service_urls(placement, service, host)


__all__ = ["start_plan", "poll_outcome", "endpoints"]
