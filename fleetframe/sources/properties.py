"""S3 properties reader with one-level ``${key}`` substitution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.sources.lines import read_lines

# Tokens of a value: a ``${name}`` reference, a run without ``$``, or a lone ``$``.
TOKEN_RE = r"(\$\{[^}]*\}|[^$]+|\$)"
REF_RE = r"^\$\{([^}]*)\}$"


def parse_properties(df: DataFrame, line: str = "line") -> DataFrame:
    """Keep ``key=value`` lines (``#``/``!`` comments and blanks dropped); split at
    the first ``=``, both sides trimmed."""
    c = F.col(line)
    body = F.trim(c)
    keep = (body != "") & ~body.startswith("#") & ~body.startswith("!") & body.contains("=")
    parts = F.split(c, "=", 2)
    return (df.where(keep)
              .withColumn("key", F.trim(parts.getItem(0)))
              .withColumn("value", F.trim(parts.getItem(1))))


def read_properties(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``*.properties`` files -> ``(source, line_no, key, value)``."""
    return parse_properties(read_lines(spark, paths)).select("source", "line_no", "key", "value")


def resolve_refs(df: DataFrame, source: str = "source", key: str = "key",
                 value: str = "value", row_id: Sequence[str] = ("source", "line_no"),
                 line_no: str | None = "line_no") -> DataFrame:
    """Substitute ``${name}`` in ``value`` with the value of key ``name`` from the
    same source - one level: substituted text is not scanned again, and a
    reference with no definition stays literal.  Adds ``resolved``.

    Plan: only the reference tokens are exploded (with their token position)
    and equi-joined to the definitions on ``(source, name)`` - a merge join,
    AQE splits a hot name.  Both joins ask for it, since Spark goes by the
    bytes of the files read and would broadcast all definitions of well
    compressed ones.  The hits become one small
    ``position -> text`` map per row, left-joined back by row id, and the
    value is rebuilt token by token with ``transform``.  Rows with no
    resolvable reference keep their value.  Duplicate definitions: the last
    line wins when ``line_no`` is given.
    """
    row_id = list(row_id)
    defs = df.select(F.col(source).alias("_ff_src"), F.col(key).alias("_ff_ref"),
                     F.col(value).alias("_ff_def"),
                     *([F.col(line_no).alias("_ff_ln")] if line_no else []))
    if line_no:
        defs = defs.groupBy("_ff_src", "_ff_ref").agg(F.max_by("_ff_def", "_ff_ln").alias("_ff_def"))
    else:
        defs = defs.groupBy("_ff_src", "_ff_ref").agg(F.max("_ff_def").alias("_ff_def"))

    tokens = F.regexp_extract_all(F.col(value), F.lit(TOKEN_RE), F.lit(1))
    refs = (df.where(F.col(value).contains("${"))
              .select(*row_id, F.col(source).alias("_ff_src"),
                      F.posexplode(tokens).alias("_ff_pos", "_ff_tok"))
              .where(F.col("_ff_tok").rlike(REF_RE))
              .withColumn("_ff_ref", F.regexp_extract("_ff_tok", REF_RE, 1)))
    hits = refs.join(defs.hint("merge"), ["_ff_src", "_ff_ref"], "inner")
    subst = hits.groupBy(*row_id).agg(
        F.map_from_entries(F.collect_list(F.struct("_ff_pos", "_ff_def"))).alias("_ff_map"))
    out = df.join(subst.hint("merge"), row_id, "left")
    rebuilt = F.array_join(F.transform(tokens, lambda t, i: F.coalesce(
        F.try_element_at(F.col("_ff_map"), i), t)), "")
    return (out.withColumn("resolved", F.when(F.col("_ff_map").isNull(), F.col(value)).otherwise(rebuilt))
               .drop("_ff_map"))


__all__ = ["parse_properties", "read_properties", "resolve_refs"]
