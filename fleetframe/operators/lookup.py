"""Lookups against small fixed tables (P1, P8, P15) and dimension joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference: accepted spellings per service, the
# architecture-to-download code, and each service's web port.
SERVICE_ALIASES = {
    "scm": ["scm", "SCM"],
    "om": ["om", "OM"],
    "datanode": ["datanode", "DataNode", "DATANODE"],
    "recon": ["recon", "Recon", "RECON"],
    "s3gateway": ["s3gateway", "S3Gateway", "S3GATEWAY"],
    "httpfs": ["httpfs", "HttpFS", "HTTPFS"],
}
ARCH_CODES = {"x86_64": "amd64", "aarch64": "arm64", "arm64": "arm64"}
SERVICE_PORTS = {"om": 9874, "scm": 9876, "datanode": 9882, "recon": 9888,
                 "s3gateway": 9878, "httpfs": 14000}


def alias_table(spark, aliases: Mapping[str, Sequence[str]] = SERVICE_ALIASES) -> DataFrame:
    rows = [(spelling, canon) for canon, spellings in aliases.items() for spelling in spellings]
    return F.broadcast(spark.createDataFrame(rows, "_ff_spelling string, _ff_canon string"))


def canonical(df: DataFrame, name: str, out: str = "canonical",
              aliases: Mapping[str, Sequence[str]] = SERVICE_ALIASES) -> DataFrame:
    """P1 step 1: map an accepted spelling to its canonical name; any other
    spelling gives null (the reference's ``*)`` branch)."""
    t = alias_table(df.sparkSession, aliases)
    return (df.join(t, F.col(name) == F.col("_ff_spelling"), "left")
              .withColumnRenamed("_ff_canon", out).drop("_ff_spelling"))


def lookup(df: DataFrame, name: str, table: DataFrame, table_key: str, table_value: str,
           out: str = "hosts", aliases: Mapping[str, Sequence[str]] = SERVICE_ALIASES,
           default: str = "") -> DataFrame:
    """P1 case-tolerant lookup: spelling -> canonical name -> value from
    ``table``; unknown names (or names with no row) give ``default``."""
    c = canonical(df, name, "_ff_c", aliases)
    t = table.select(F.col(table_key).alias("_ff_c"), F.col(table_value).alias(out))
    return (c.join(t, "_ff_c", "left")
             .withColumn(out, F.coalesce(F.col(out), F.lit(default))).drop("_ff_c"))


def map_code(df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame,
             out: str = "code", default: str | None = None) -> DataFrame:
    """Translate ``col`` through a small code table (a dict becomes a
    broadcast literal table); unmapped values give ``default``."""
    if isinstance(mapping, DataFrame):
        m = mapping.toDF("_ff_k", "_ff_v")
    else:
        m = F.broadcast(df.sparkSession.createDataFrame(
            [(str(k), str(v)) for k, v in mapping.items()], "_ff_k string, _ff_v string"))
    j = df.join(m, F.col(col).cast("string") == F.col("_ff_k"), "left")
    val = F.col("_ff_v") if default is None else F.coalesce(F.col("_ff_v"), F.lit(default))
    return j.withColumn(out, val).drop("_ff_k", "_ff_v")


def service_urls(placement: DataFrame, service: str = "service", host: str = "host",
                 ports: Mapping[str, int] = SERVICE_PORTS, out: str = "url") -> DataFrame:
    """``http://host:port`` for each placed service with a known port
    (service names are canonicalised first; other services are dropped)."""
    p = F.broadcast(placement.sparkSession.createDataFrame(
        [(k, int(v)) for k, v in ports.items()], "_ff_svc string, _ff_port int"))
    c = canonical(placement, service, "_ff_svc")
    j = c.join(p, "_ff_svc", "inner")
    return (j.withColumn(out, F.format_string("http://%s:%d", F.col(host), F.col("_ff_port")))
             .drop("_ff_svc", "_ff_port"))


__all__ = ["lookup", "canonical", "alias_table", "map_code", "service_urls",
           "SERVICE_ALIASES", "ARCH_CODES", "SERVICE_PORTS"]
