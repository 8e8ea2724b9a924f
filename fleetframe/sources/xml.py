"""S2 site-XML reader: one row per ``<property>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("description", T.StringType()),
])


def read_site_xml(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hadoop-style ``*-site.xml`` files -> ``(source, name, value, description)``.

    ``source`` is the file, or for folders written with ``partition_by`` the
    value of a ``source=`` folder; other partition columns are kept.  Uses Spark's XML data source with ``rowTag=property`` and a fixed schema
    (no inference pass); files are split and read in parallel.
    """
    if isinstance(paths, str):
        paths = [paths]
    df = (spark.read.format("xml").option("rowTag", "property")
          .schema(PROPERTY_SCHEMA).load(list(paths)))
    more = [c for c in df.columns if c not in (*PROPERTY_SCHEMA.names, "source")]
    source = F.col("source").cast("string") if "source" in df.columns else F.col("_metadata.file_path")
    return df.select(source.alias("source"), *more, "name", "value", "description")


def parse_property_xml(col: str | Column) -> Column:
    """Parse one ``<property>...</property>`` string into a struct."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_xml(c, PROPERTY_SCHEMA)


__all__ = ["read_site_xml", "parse_property_xml", "PROPERTY_SCHEMA"]
