"""The table behind a streaming query, and the counters beside it.

A sink is a folder in which every micro-batch has a folder of its own,
``span=<n>-<n>``, written with overwrite, so a batch that is replayed after a
failure replaces itself.  Spans are merged as they pile up: once ``FAN``
neighbours of one size exist they are rewritten as one span ten times as long,
and deleted when that is complete.  So a sink of n batches has some
``FAN * log(n)`` folders, a row is rewritten ``log(n)`` times, and a restart
finds either the parts or the whole.  Only batches before the one being
written are merged: they are committed and never replayed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

FAN = 10
_SPAN = re.compile(r"span=(\d+)-(\d+)$")


class Sink:
    """Spans of micro-batches under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(jsc.hadoopConfiguration())

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/span={first}-{last}"

    def _spans(self) -> list[tuple[int, int]]:
        """Complete spans (first, last batch), also those that a longer one
        has replaced."""
        root = self._at(self.path)
        if not self._fs.exists(root):
            return []
        found = [_SPAN.match(f.getPath().getName()) for f in self._fs.listStatus(root)]
        spans = [(int(m[1]), int(m[2])) for m in found if m]
        return [s for s in spans if self._fs.exists(self._at(self._folder(*s) + "/_SUCCESS"))]

    def live(self) -> list[tuple[int, int]]:
        """The spans that make up the table, in order: of spans that overlap
        the longest."""
        out: list[tuple[int, int]] = []
        for first, last in sorted(self._spans(), key=lambda s: (s[0], -s[1])):
            if not out or first > out[-1][1]:
                out.append((first, last))
        return out

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(batch, batch))

    def read(self, schema, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before one."""
        spans = [s for s in self.live() if before is None or s[1] < before]
        if not spans:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(*s) for s in spans])

    def last(self, schema) -> DataFrame:
        """The rows of the last batch (a sink in which each replaces all)."""
        spans = self.live()
        return self.spark.read.schema(schema).parquet(self._folder(*spans[-1])) if spans else \
            self.spark.createDataFrame([], schema)

    def _delete(self, spans: Sequence[tuple[int, int]]) -> None:
        for s in spans:
            self._fs.delete(self._at(self._folder(*s)), True)

    def forget(self, before: int) -> None:
        """Delete the batches before one (which replaces them)."""
        self._delete([s for s in self._spans() if s[1] < before])

    def compact(self, before: int, schema) -> None:
        """Merge what has piled up of the batches before one."""
        live = self.live()
        self._delete([s for s in self._spans() if s not in live])  # left over from a merge that was cut off
        size = 1
        while True:
            same = [s for s in live if s[1] < before and size <= s[1] - s[0] + 1 < size * FAN]
            if len(same) < FAN:
                if not any(s[1] - s[0] + 1 >= size * FAN for s in live):
                    return
                size *= FAN
                continue
            run = same[:FAN]
            whole = (run[0][0], run[-1][1])
            self.spark.read.schema(schema).parquet(*[self._folder(*s) for s in run]).write.mode("overwrite").parquet(
                self._folder(*whole))
            self._delete(run)
            live = sorted([*[s for s in live if s not in run], whole])


__all__ = ["Sink", "FAN"]
