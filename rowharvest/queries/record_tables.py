"""Queries over record sets: duplicates, caps, batches, search, profiles, quality."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowharvest import fields
from rowharvest.fields import Field
from rowharvest.operators import profile, records, skew
from rowharvest.operators.extract import from_wide, is_incomplete, kind_of
from rowharvest.queries import query, table
from rowharvest.session import scratch_path
from rowharvest.sinks import export, store
from rowharvest.sources.pages import latest_snapshot, page_sessions, read_snapshots


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""SELECT user_id, event_type, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def first_events(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    return records.dedup_records(df, ["user_id", "event_type"], "event_id")


@query("""SELECT user_id, count(*) AS total, count(DISTINCT event_type) AS kept, count(*) - count(DISTINCT event_type) AS duplicates
  FROM events GROUP BY user_id""")
def repeated_events(spark, sf_dir):
    return records.count_duplicates(events(spark, sf_dir), ["user_id"], ["user_id", "event_type"])


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40")
def capped_sessions(spark, sf_dir):
    return records.cap(events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 40)


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) <= 1500")
def capped_types(spark, sf_dir):
    return records.cap(events(spark, sf_dir).select("event_id", "event_type", "ts"), ["event_type"], "ts", 1500).select(
        "event_id", "event_type")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx FROM events")
def ranked_events(spark, sf_dir):
    """Rank of every event among its type, ranked range by range."""
    df = events(spark, sf_dir).select("event_id", "event_type", "ts")
    return skew.ordered_index(df, ["event_type"], "ts", range_rows=2000).select("event_id", "event_type", "idx")


#: Events with missing types, missing and often repeated order values.
_GAPS = """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_id % 7 <> 0 THEN user_id % 11 END AS place FROM events"""


def events_with_gaps(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
                                        F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 11).alias("place"))


@query(f"""SELECT event_id, kind FROM ({_GAPS}) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY place NULLS LAST, event_id) <= 700""")
def capped_gaps(spark, sf_dir):
    """Ties and missing values under a cap, range by range; a missing key is capped like any other."""
    return records.cap(events_with_gaps(spark, sf_dir), ["kind"], "place", 700, range_rows=1000, ties=["event_id"]).select("event_id", "kind")


@query(f"""SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY place NULLS LAST, event_id) - 1 AS idx FROM ({_GAPS})""")
def ranked_gaps(spark, sf_dir):
    df = events_with_gaps(spark, sf_dir)
    return skew.ordered_index(df, ["kind"], "place", range_rows=1000, ties=["event_id"]).select("event_id", "kind", "idx")


_QUALITY = [Field("text", "Text"), Field("quality", "Quality", "number", required=True)]


@query("""SELECT lang AS session_id, count(DISTINCT text) AS total, count(*) - count(DISTINCT text) AS duplicates,
  count(*) FILTER (WHERE quality IS NULL) AS incomplete, count(DISTINCT source) AS batches, count(DISTINCT text) >= 400 AS near_limit
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def session_stats(spark, sf_dir):
    """Documents as records of one session per language; a label is a required field."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), ["doc_id"], "left")
    maps = from_wide(labelled.withColumn("fingerprint", F.sha2("text", 256)), _QUALITY, ("lang", "source", "fingerprint"))
    rows = maps.select(F.col("lang").alias("session_id"), F.col("source").alias("batch_id"), "fingerprint",
                       is_incomplete(_QUALITY).alias("incomplete"))
    return records.capture_stats(rows, ["session_id"], max_records=500)


@query("""SELECT doc_id, quality IS NULL AS incomplete FROM documents LEFT JOIN labels USING (doc_id)""")
def incomplete_documents(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), ["doc_id"], "left")
    return from_wide(labelled, _QUALITY, ("doc_id",)).select("doc_id", is_incomplete(_QUALITY).alias("incomplete"))


_DAY = "strftime(ts, '%Y-%m-%d')"


@query(f"""SELECT event_id, user_id FROM events e WHERE {_DAY} <> (SELECT max_by({_DAY}, ts) FROM events m WHERE m.user_id = e.user_id)""")
def undone_batches(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return records.undo_last_batch(df, "user_id", "day", "ts").select("event_id", "user_id")


@query("""WITH b AS (SELECT event_type AS session_id, 'week ' || CAST(strftime(ts, '%d') AS INT) // 7 AS batch_id, event_id, ts FROM events)
SELECT session_id, batch_id, count(*) AS n, min(event_id) AS first_id FROM b WHERE session_id <> 'error'
  AND NOT (session_id = 'click' AND batch_id = (SELECT max_by(batch_id, ts) FROM b WHERE session_id = 'click')) GROUP BY ALL""")
def stored_batches(spark, sf_dir):
    """Append all batches, one of them twice, undo the last batch of one session, clear another, read back."""
    path = scratch_path(spark, "store")
    week = F.floor(F.dayofmonth("ts") / 7).cast("string")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("session_id"), F.concat(F.lit("week "), week).alias("batch_id"),
                                        "event_id", F.col("ts").alias("seq"))
    store.append_batch(rows, path)
    store.append_batch(rows.where("batch_id = 'week 1'"), path)
    store.undo_last_batch(spark, path, "click")
    store.clear_session(spark, path, "error")
    return store.read_records(spark, path).groupBy("session_id", "batch_id").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(CAST(p_size AS VARCHAR), 'ring')")
def searched_parts(spark, sf_dir):
    return records.search_records(table(spark, sf_dir, "part"), " RING ", ["p_name", "p_brand", "p_size"]).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_discount > 0.05)")
def selected_parts(spark, sf_dir):
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 AND l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return records.select_records(table(spark, sf_dir, "part").select("p_partkey", "p_name"), chosen, ["p_partkey"])


@query("""SELECT conv_id AS page_id, turn, text AS html FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def newest_states(spark, sf_dir):
    states = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), "turn", F.col("text").alias("html"), F.timestamp_seconds("turn").alias("snapshot_ts"))
    return latest_snapshot(states).select("page_id", "turn", "html")


ORDER_FIELDS = [Field("o_orderpriority", "Priority"), Field("o_totalprice", "Price", "price"), Field("rare", "Rare"),
                Field("secret", "Secret", hidden=True)]
EXPORT_FIELDS = [Field("o_orderpriority", "Priority"), Field("o_totalprice", "Price", "price")]
_NUMBERED = "CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INT)"


def exported_orders(spark, sf_dir):
    order = F.date_diff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long") * 100_000_000 + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(order.alias("seq"), "o_orderkey", "o_orderpriority", "o_totalprice")


def _lines(spark, path, separator):
    """The lines of a file with their numbers."""
    text = spark.read.option("lineSep", separator).text(path).withColumn("at", F.monotonically_increasing_id())
    return text.withColumn("line", F.row_number().over(Window.orderBy("at")))


@query(f"""SELECT {_NUMBERED} AS line, o_orderpriority AS priority, o_totalprice AS price FROM orders""")
def exported_json(spark, sf_dir):
    """One ordered JSON array, written by many tasks, read back line by line."""
    path = scratch_path(spark, "json")
    export.write_json(exported_orders(spark, sf_dir), EXPORT_FIELDS, path, "seq")
    record = F.from_json(F.regexp_replace("value", r"^[\[,]|\]$", ""), "Priority string, Price double")
    return _lines(spark, path, "\n").select("line", record.alias("r")).select("line", F.col("r.Priority").alias("priority"), F.col("r.Price").alias("price"))


@query(f"""SELECT {_NUMBERED} + 1 AS line, '"' || o_orderpriority || '","' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') || '"' AS text FROM orders
  UNION ALL SELECT 1, '"Priority","Price"'""")
def exported_csv(spark, sf_dir):
    """One ordered CSV file with its header; reading it as text drops its byte order mark."""
    path = scratch_path(spark, "csv")
    export.write_csv(exported_orders(spark, sf_dir), EXPORT_FIELDS, path, single_file=True, order="seq")
    return _lines(spark, path, "\r\n").select("line", F.col("value").alias("text"))


_PROFILE = """WITH s AS (SELECT o_orderstatus AS session_id, o_orderkey AS idx, *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS rare FROM orders),
c AS (SELECT session_id, idx, 'o_orderpriority' AS id, o_orderpriority AS v FROM s UNION ALL
      SELECT session_id, idx, 'o_totalprice', regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') FROM s UNION ALL
      SELECT session_id, idx, 'rare', coalesce(rare, '') FROM s),
d AS (SELECT session_id, id, v, min(idx) AS first, row_number() OVER (PARTITION BY session_id, id ORDER BY min(idx), v) AS k
      FROM c WHERE v <> '' GROUP BY session_id, id, v),
f AS (SELECT session_id, id, string_agg(v, '|' ORDER BY k) AS samples FROM d WHERE k <= 3 GROUP BY ALL)
SELECT session_id, id, round(count(*) FILTER (WHERE v <> '') / count(*), 6) AS coverage,
  round(count(DISTINCT v) FILTER (WHERE v <> '') / count(*) FILTER (WHERE v <> ''), 6) AS unique_ratio,
  round(avg(length(v)) FILTER (WHERE v <> ''), 6) AS average_length, any_value(samples) AS samples
FROM c JOIN f USING (session_id, id) GROUP BY session_id, id"""


@query(_PROFILE)
def field_profiles(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("session_id"), "o_orderkey", "o_orderpriority", "o_totalprice",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("rare"), F.lit("x").alias("secret"))
    out = profile.profile_fields(df, ORDER_FIELDS, ["session_id"], "o_orderkey")
    return out.select("session_id", "id", F.round("coverage", 6).alias("coverage"), F.round("unique_ratio", 6).alias("unique_ratio"),
                      F.round("average_length", 6).alias("average_length"), F.array_join("samples", "|").alias("samples"))


DOC_FIELDS = [Field("lang", "Language"), Field("body", "Body"), Field("source", "Source"), Field("origin", "Origin"),
              Field("rare", "Rare"), Field("quality", "Quality", "number"), Field("toxic", "Toxic", "number")]
_COLS = [(i, f.id, f.name) for i, f in enumerate(DOC_FIELDS)]
_ISSUES = f"""WITH w AS (SELECT doc_id, source AS session_id, lang, repeat(text, 2) AS body, source, CASE WHEN doc_id % 40 = 0 THEN 'other' ELSE source END AS origin,
  CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE '' END AS rare, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
c AS ({' UNION ALL '.join(f"SELECT session_id, doc_id, {i} AS i, '{n}' AS name, {c} AS v FROM w" for i, c, n in _COLS)}),
f AS (SELECT session_id, i, 0 AS part, 0 AS j, name || ': fewer than 5% of the records have a value' AS issue FROM c GROUP BY session_id, i, name
      HAVING count(*) FILTER (WHERE v <> '') / count(*) < 0.05
      UNION ALL SELECT session_id, i, 0, 1, name || ': values are so long that they may be whole records' FROM c GROUP BY session_id, i, name
      HAVING avg(length(v)) FILTER (WHERE v <> '') > 1400
      UNION ALL SELECT a.session_id, a.i, 1, b.i, a.name || ' = ' || b.name || ': nearly all values are equal' FROM c a JOIN c b
        ON a.session_id = b.session_id AND a.doc_id = b.doc_id AND a.i < b.i AND a.v <> '' AND b.v <> ''
      GROUP BY a.session_id, a.i, a.name, b.i, b.name HAVING count(*) >= 2 AND count(*) FILTER (WHERE a.v = b.v) / count(*) > 0.9)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY part, i, j) AS INT) AS issue_no, issue FROM f"""


def document_records(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), ["doc_id"], "left")
    return labelled.select(
        "doc_id", F.col("source").alias("session_id"), "lang", F.repeat("text", F.lit(2)).alias("body"), "source",
        F.when(F.col("doc_id") % 40 == 0, "other").otherwise(F.col("source")).alias("origin"),
        F.when(F.col("doc_id") % 97 == 0, "x").alias("rare"), F.col("quality").cast("double"), F.col("toxic").cast("double"))


@query(_ISSUES)
def quality_issues(spark, sf_dir):
    return profile.evaluate_quality(document_records(spark, sf_dir), DOC_FIELDS, ["session_id"])


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR doc_id % 97 = 0")
def filled_documents(spark, sf_dir):
    df = document_records(spark, sf_dir)
    kinds = {f.id: kind_of(f) for f in DOC_FIELDS if f.id in ("rare", "quality")}
    return records.drop_empty_records(df, kinds).select("doc_id")


EDITED = [Field("p_partkey", "Key", "number"), Field("p_name", "Name"), Field("p_brand", "Brand"), Field("p_size", "Size", "number"), Field("p_type", "Type")]


@query("""SELECT p_partkey, '"' || p_brand || '","' || p_partkey || '","' || p_type || '"' AS line, '"Maker","Number","Kind"' AS header FROM part""")
def edited_columns(spark, sf_dir):
    """A column set after edits: renamed, retyped, moved, hidden, deleted and added columns, as they are exported."""
    columns = fields.rename(fields.rename(fields.rename(EDITED, "p_brand", "Maker"), "p_partkey", "Number"), "p_type", "Kind")
    columns = fields.move(fields.move(columns, "p_brand", -1), "p_brand", -1)
    columns = fields.toggle_hidden(fields.delete(fields.retype(columns, "p_partkey", "text"), "p_size"), "p_name")
    columns = fields.toggle_hidden(fields.add_custom(columns, "mine"), "mine")
    df = table(spark, sf_dir, "part").withColumn("p_partkey", F.col("p_partkey").cast("string")).withColumn("mine", F.lit(""))
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), export.csv_line(df, columns).alias("line"), F.lit(export.csv_header(columns)).alias("header"))


_STATES = """SELECT conv_id AS page_id, 'https://e.example.test/' || CASE WHEN turn >= 3 THEN 'late' ELSE 'early' END AS url, turn FROM conversations"""


def page_states(spark, sf_dir):
    """Turns of conversations as states of pages that navigate at their third turn."""
    url = F.concat(F.lit("https://e.example.test/"), F.when(F.col("turn") >= 3, "late").otherwise("early"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("page_id"), url.alias("url"), F.col("text").alias("html"),
                                                       F.timestamp_seconds("turn").alias("snapshot_ts"))


@query(f"""SELECT sha256(page_id || chr(10) || url) AS session_id, count(*) AS states FROM ({_STATES}) GROUP BY 1""")
def navigated_sessions(spark, sf_dir):
    """A new address of a page is a new session."""
    return page_sessions(page_states(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("states"))


@query(f"""SELECT page_id, count(*) AS states, max(turn) AS newest FROM ({_STATES}) GROUP BY page_id""")
def streamed_snapshots(spark, sf_dir):
    """States read as a stream, file by file."""
    path, out = scratch_path(spark, "snapshots"), scratch_path(spark, "snapshot_log")
    page_states(spark, sf_dir).repartition(3).write.parquet(path)
    writer = read_snapshots(spark, path, 1).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("page_id").agg(F.count("*").alias("states"), F.max(F.unix_seconds("snapshot_ts")).alias("newest"))
