"""Reproduce the hot-key measurement quoted in README/BASELINE.

Enlarges the driver's sf0.1 ``events`` table ``COPIES`` times (ids and times
shifted per copy) with a third of all rows re-keyed to one user, writes it
once to a fresh scratch folder, then times row number + carry-forward with
the chunked scan against a plain ``Window.partitionBy(user)``.

    python -m tests.skew_measure [copies]      # default 100 -> 10 M rows
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetframe.operators.scan import running, time_chunk
from fleetframe.session import build_session

SRC = "/root/testdata/sf0.1/events.parquet"


def main(copies: int = 100) -> None:
    spark = build_session("local[8]", shuffle_partitions=32,
                          extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    out = tempfile.mkdtemp(prefix="run-skew-") + "/events"
    e = spark.read.parquet(SRC)
    n = spark.range(copies).withColumnRenamed("id", "copy")
    (e.crossJoin(n)
      .select((F.col("event_id") + F.col("copy") * 1_000_000).alias("event_id"),
              (F.col("ts") + F.make_dt_interval(F.col("copy") * 31)).alias("ts"),
              F.when(F.col("event_id") % 3 == 0, F.lit(-1))
               .otherwise(F.col("user_id") + F.col("copy") * 100_000).alias("user_id"),
              "event_type")
      .write.parquet(out))
    ev = spark.read.parquet(out)

    def timed(name, df):
        best = min(_run(df) for _ in range(2))
        print(f"{name:32s} {best:7.2f} s", flush=True)

    carry = F.when(F.col("event_type") == "signup", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    timed("plain window rank + carry",
          ev.withColumn("rk", F.row_number().over(w))
            .withColumn("c", F.last(carry, True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    timed("chunked scan rank + carry",
          running(ev, ["user_id"], ["ts", "event_id"], time_chunk("ts", 86400), rank="rk",
                  carries={"c": carry}))
    spark.stop()


def _run(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 100)
