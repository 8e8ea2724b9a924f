"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every fleetframe job expects.  Shuffle partition count and file
# split size are deliberately *not* forced here: on a cluster they are sized
# by the deployment (executor count x cores, and memory per task); AQE then
# coalesces small shuffle partitions and splits skewed ones at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "fleetframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the fleetframe defaults applied.

    ``master`` and ``shuffle_partitions`` are meant for local runs and tests;
    on a cluster leave them unset so the submit-time configuration wins.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: float, total_cores: int,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a run over ``input_bytes`` on ``total_cores`` cores.

    Initial shuffle partitions: enough for ``target_partition_bytes`` per
    partition over the whole input (at least two waves of tasks); AQE then
    coalesces small ones to the same advisory size and splits skewed ones.
    File splits are sized the same way, so a scan task and a reduce task
    handle similar volumes.  For 100 TB on 8,000 cores this gives about
    400,000 shuffle partitions before coalescing.
    """
    parts = max(2 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster this names
    shared storage).  Where it is unset, a local master (tests) gets a fresh
    temporary folder, recorded in the session so later calls agree; any other
    master raises, because executors cannot see the driver's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        pass
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = sc.master if sc is not None else ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver "
                             "and all executors share")
        root = tempfile.mkdtemp(prefix="fleetframe-ck-")
        spark.conf.set("spark.checkpoint.dir", root)
        if sc is not None:
            sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below :func:`checkpoint_root` for one job's output.  The
    driver's JVM deletes it when the application ends."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    except Exception:  # Spark Connect: the folder's owner cleans it
        return path
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(jsc.hadoopConfiguration())
    # deleteOnExit only records paths that exist at the time of the call
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


_scopes = threading.local()


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage and lets an expensive intermediate (a large join) be
    read twice without being recomputed.  Survives executor loss, unlike a
    cache or a local checkpoint.

    The table stays until the application ends, :func:`discard` is called on
    it, or the :func:`scratch_scope` it was written in is left."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ff_scratch = path
    for written in getattr(_scopes, "open", [])[-1:]:
        written.append(out)
    return out


def discard(*tables) -> None:
    """Delete tables of :func:`materialize` that nothing will read again:
    their successors are written."""
    for t in tables:
        path = getattr(t, "_ff_scratch", None)
        if path is None:
            continue
        t._ff_scratch = None
        try:
            jvm, jsc = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc
        except Exception:  # Spark Connect: the folder's owner cleans it
            return
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch_scope():
    """Tables that :func:`materialize` writes inside are deleted on leaving,
    but for those passed to the function that ``with`` gives, which belong to
    the scope around it, if any.  Nothing lazy may lead out that reads the
    others.

    >>> with scratch_scope() as keep:
    ...     result = keep(materialize(many_steps(df), "result"))
    """
    stack = _scopes.open = getattr(_scopes, "open", [])
    written, kept = [], []
    stack.append(written)

    def keep(table):
        kept.append(table)
        return table
    try:
        yield keep
    finally:
        stack.pop()
        discard(*[t for t in written if not any(t is k for k in kept)])
        for outer in stack[-1:]:
            outer += kept


__all__ = ["build_session", "checkpoint_root", "scratch_path", "scale_conf",
           "materialize", "discard", "scratch_scope", "DEFAULT_CONF"]
