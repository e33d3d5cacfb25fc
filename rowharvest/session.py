"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings the plans are written for. Every page-level join is on
#: ``page_id`` plus something finer, so a hash partitioning on ``page_id`` alone
#: must be accepted by those joins: otherwise each of them shuffles again.
#: Rows are small but costly to compute, so small shuffle outputs still go to many cores.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # State with timers and time-to-live; it is kept on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share (``spark.checkpoint.dir``).

    Only a session that runs in one process may do without: it gets a temporary folder. On a cluster every
    executor has its own temporary folder, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rowharvest-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a job read the same expensive intermediate
    (parsed nodes, clusters). The copy is columnar, so each branch reads only its
    columns, and it survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append((df.sparkSession, path))
    df.write.mode("overwrite").parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Collect the garbage of finished plans when the driver's heap has grown to over half of what it may have.

    A step of a long job leaves its plans, and through them broadcast tables and shuffle files, to the driver's collector, which
    would rather grow the heap to its limit; a full collection gives back what it does not need.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        spark._jvm.System.gc()


_open = threading.local()


@contextmanager
def temporary() -> Iterator[None]:
    """Frees the space of all intermediates that are written inside the block, at its end.

    For jobs that write their own result: what is read lazily after the block must not come from them.
    """
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        written, _open.paths = _open.paths, outer
        for spark, path in written:
            spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)
