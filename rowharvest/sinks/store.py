"""Durable record store: data written once, and a log that says which of it counts.

Every append writes one folder of data files (``data/part=...``) and then one small entry of the log (``log/version=...``), which makes it
count: what was not entered is not seen, so a lost job leaves nothing behind that a reader meets. A later entry of
the same batch takes the place of an earlier one; undoing and clearing are entries, too, and touch no data file. One writer at a time: a second
entry of one version is refused.

Sessions can be as many as pages. Rows carry a bucket, a hash of their session, and files are in order of bucket and session, so
reading one session skips the files and row groups of other buckets. The log keeps the number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowharvest.operators.records import last_batches
from rowharvest.operators.skew import same_values

#: Buckets of a store that is begun without a number; a store keeps the number it was begun with.
BUCKETS = 64
#: Appends after which all that counts is written anew as one part.
COMPACT_AFTER = 200

_ENTRY = "op string, part string, session_id string, batch_id string, buckets int"


def data_path(path: str) -> str:
    """Where the data files are; a stream over them sees every append, replaced and undone ones too."""
    return f"{path}/data"


def _bucket(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries of a store: version, op (add, base, drop), part, session_id, batch_id, buckets. None before the first."""
    try:
        return spark.read.schema(f"{_ENTRY}, version bigint").parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _state(spark: SparkSession, path: str, buckets: int | None) -> tuple[DataFrame | None, int, int, int, int]:
    """(log, next version, buckets, version of the last base, parts that count): five numbers reach the driver."""
    log = read_log(spark, path)
    if log is None:
        return None, 0, buckets or BUCKETS, 0, 0
    row = log.agg(F.max("version"), F.max("buckets"), F.coalesce(F.max(F.when(F.col("op") == "base", F.col("version"))), F.lit(0))).first()
    if buckets is not None and buckets != row[1]:
        raise ValueError(f"the store has {row[1]} buckets, not {buckets}")
    parts = log.where((F.col("op") != "drop") & (F.col("version") >= row[2])).agg(F.count_distinct("part")).first()[0]
    return log, row[0] + 1, row[1], row[2], parts


def _enter(entries: DataFrame, path: str, version: int) -> None:
    """One small file, in a folder that must not exist yet."""
    entries.coalesce(1).write.mode("error").parquet(f"{path}/log/version={version}")


def _write_part(records: DataFrame, path: str, op: str, version: int, buckets: int) -> None:
    part = f"w{uuid.uuid4().hex}"
    bucketed = records.withColumn("bucket", _bucket(F.col("session_id"), buckets))
    # The rebalancing gives files of a useful size, and splits a bucket that holds much more than the others.
    bucketed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "session_id", "batch_id").write.parquet(f"{path}/data/part={part}")
    batches = records.sparkSession.read.schema(bucketed.schema).parquet(f"{path}/data/part={part}").select(F.col("batch_id").cast("string")).distinct()
    whole = records.sparkSession.range(1).select(F.lit(None).cast("string").alias("batch_id"))  # an append without rows counts, too
    _enter(whole.unionByName(batches).select(F.lit(op).alias("op"), F.lit(part).alias("part"), F.lit(None).cast("string").alias("session_id"), "batch_id",
                                             F.lit(buckets).alias("buckets")), path, version)


def append_batch(records: DataFrame, path: str, buckets: int | None = None, compact_after: int = COMPACT_AFTER) -> None:
    """Add batches (session_id, batch_id, ...). A session's batch that is written again takes the place of the first, so a
    retried job adds nothing twice."""
    spark = records.sparkSession
    _, version, number, _, parts = _state(spark, path, buckets)
    _write_part(records, path, "add", version, number)
    if parts + 1 >= compact_after:
        compact(spark, path)


def _visible(spark: SparkSession, path: str, buckets: int | None, session_id: str | None) -> DataFrame:
    """The rows that count, with their version and bucket."""
    log, _, number, base, _ = _state(spark, path, buckets)
    if log is None:
        raise ValueError(f"no store at {path}")
    parts = log.where((F.col("op") != "drop") & (F.col("version") >= base))
    data = spark.read.option("basePath", data_path(path)).parquet(data_path(path))
    drops = log.where((F.col("op") == "drop") & (F.col("version") > base)).select("session_id", F.col("batch_id").alias("gone"), F.col("version").alias("since"))
    if session_id is not None:
        data = data.where((F.col("bucket") == _bucket(F.lit(session_id), number)) & (F.col("session_id") == session_id))
        drops = drops.where(F.col("session_id") == session_id)
    rows = data.join(parts.select("part", "version").distinct(), "part").drop("part")
    # Only batches that were written more than once are looked at for the newest writing of each session.
    again = parts.where("batch_id is not null").groupBy("batch_id").agg(F.count_distinct("version").alias("n")).where("n > 1").select("batch_id")
    if not again.isEmpty():
        key = ["session_id", "batch_id"]
        newest = rows.join(again, "batch_id", "left_semi").groupBy(*key).agg(F.max("version").alias("newest"))
        rows = rows.alias("r").join(newest.alias("n"), same_values("r", "n", key), "left").where(
            F.col("n.newest").isNull() | (F.col("r.version") == F.col("n.newest"))).select("r.*")
    if not drops.isEmpty():
        rows = rows.alias("r").join(drops.alias("d"), F.col("r.session_id").eqNullSafe(F.col("d.session_id")) & (F.col("r.version") < F.col("d.since"))
                                    & (F.col("d.gone").isNull() | (F.col("d.gone") == F.col("r.batch_id"))), "left_anti")
    return rows


def read_records(spark: SparkSession, path: str, session_id: str | None = None, buckets: int | None = None) -> DataFrame:
    """Records of the store. For one session only the row groups of its bucket are read; a wrong number of buckets is an error."""
    return _visible(spark, path, buckets, session_id).drop("bucket", "version")


def _drop(spark: SparkSession, path: str, session_id: str, batch_id: str | None, buckets: int | None) -> None:
    _, version, number, _, _ = _state(spark, path, buckets)
    _enter(spark.createDataFrame([("drop", None, session_id, batch_id, number)], _ENTRY), path, version)


def undo_last_batch(spark: SparkSession, path: str, session_id: str, buckets: int | None = None) -> str | None:
    """Drop the newest batch of a session and return its id: one entry of the log."""
    newest = last_batches(read_records(spark, path, session_id, buckets)).first()
    if newest is None:
        return None
    _drop(spark, path, session_id, newest["batch_id"], buckets)
    return newest["batch_id"]


def clear_session(spark: SparkSession, path: str, session_id: str, buckets: int | None = None) -> bool:
    """Drop all records of a session, whatever its batches: one entry of the log. False if it has none."""
    if read_records(spark, path, session_id, buckets).isEmpty():
        return False
    _drop(spark, path, session_id, None, buckets)
    return True


def compact(spark: SparkSession, path: str) -> None:
    """Write all records that count as one part in whole files; readers of the earlier parts are not disturbed, as these stay."""
    _, version, number, _, _ = _state(spark, path, None)
    _write_part(read_records(spark, path), path, "base", version, number)
