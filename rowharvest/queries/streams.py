"""Streaming queries: each processes all available input once and returns the table it wrote."""

from pyspark.sql import functions as F

from rowharvest import schemas
from rowharvest.queries import query, table
from rowharvest.queries.page_tables import ENCODE, HREF, LABEL, LINKS, MENU, MENU_FIELDS, ORIGIN
from rowharvest.session import scratch_path
from rowharvest.sinks import store
from rowharvest.streaming import capture as C


def table_stream(spark, sf_dir, name, schema):
    """A table as a stream, be it one file or a folder of files: streams take a single file by a pattern only."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def event_stream(spark, sf_dir):
    return table_stream(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)


def _written(spark, stream, name, mode="append"):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, "checkpoint")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    C.run_available(writer)
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_keys(spark, sf_dir):
    """Unbounded state: every key is remembered."""
    stream = C.stream_dedup(event_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])
    return _written(spark, stream, "keys")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_keys_bounded(spark, sf_dir):
    """State bounded by event time; the delay here covers the whole table."""
    events = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    stream = C.stream_dedup(events, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    return _written(spark, stream, "keys")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def streamed_totals(spark, sf_dir):
    path = scratch_path(spark, "totals")
    totals = C.stream_stats(event_stream(spark, sf_dir).select("user_id", "value"), ["user_id"], {"value": "value"})
    C.run_available(C.write_changes(totals, path, scratch_path(spark, "checkpoint"), ["user_id"]))
    return C.latest_totals(spark, path, ["user_id"]).select("user_id", "n", F.round("value", 4).alias("value"))


@query("""SELECT event_type AS session_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 900""")
def streamed_cap(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("session_id"), F.col("event_id").alias("seq"), F.lit(False).alias("incomplete"))
    path = scratch_path(spark, "store")
    C.run_available(C.stream_to_store(rows, path, scratch_path(spark, "ledger"), scratch_path(spark, "checkpoint"), max_records=900))
    return store.read_records(spark, path).select("session_id", "seq")


_STREAMED = f"""SELECT DISTINCT page_id, {LABEL} AS label, {ORIGIN} || {ENCODE.format(HREF)} AS target FROM ({LINKS})"""


@query(f"SELECT md5(CAST(page_id AS VARCHAR)) AS page, label, target FROM ({_STREAMED})")
def streamed_records(spark, sf_dir):
    """Page states -> records -> new records -> store."""
    pages = table_stream(spark, sf_dir, "pages", schemas.PAGE)
    states = pages.withColumn("snapshot_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    log = scratch_path(spark, "log")
    C.run_available(C.stream_records(states, [MENU], MENU_FIELDS, log, scratch_path(spark, "checkpoint")))
    written = spark.read.parquet(log)
    fresh = C.stream_dedup(C.read_stream_table(spark, log, written.schema), ["session_id", "fingerprint"])
    path = scratch_path(spark, "store")
    C.run_available(C.stream_to_store(fresh, path, scratch_path(spark, "ledger"), scratch_path(spark, "checkpoint")))
    page = (F.unix_seconds("captured_at") - 1_700_000_000).cast("string")
    v = F.col("values")
    return store.read_records(spark, path).select(F.md5(page).alias("page"), v["label"]["str"].alias("label"), v["target"]["str"].alias("target"))


#: Errors of a user between two other events are one wait: up to three retries, and a completion if another event follows.
_RETRIES = """WITH e AS (SELECT user_id, event_type = 'error' AS bad, count(*) FILTER (WHERE event_type <> 'error') OVER (
  PARTITION BY user_id ORDER BY event_id) AS wait FROM events),
w AS (SELECT user_id, wait, least(count(*), 3) AS n FROM e WHERE bad GROUP BY ALL),
g AS (SELECT user_id, max(wait) AS others FROM e GROUP BY ALL)
SELECT 's' AS session_id, CAST(user_id AS VARCHAR) AS item_key, 'retry' AS status, CAST(a AS INT) AS attempts FROM w, range(1, 4) r(a) WHERE a <= n
UNION ALL SELECT 's', CAST(user_id AS VARCHAR), 'completed', CAST(n AS INT) FROM w JOIN g USING (user_id) WHERE others > wait"""


@query(_RETRIES)
def streamed_retries(spark, sf_dir):
    """Users as items, errors as incomplete readings."""
    rows = event_stream(spark, sf_dir).select(F.lit("s").alias("session_id"), F.col("user_id").cast("string").alias("item_key"),
                                              F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("incomplete"))
    stream = C.incomplete_retry(rows)
    path = scratch_path(spark, "retries")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "checkpoint"))
    # One batch: with timers running a query of this kind always has something left to do.
    writer.trigger(once=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
