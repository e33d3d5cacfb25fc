"""Record sets: duplicates, caps, batches, search, selection, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowharvest.functions import values as V
from rowharvest.operators.skew import RANGE_ROWS, first_rows

NEAR_LIMIT = 0.8


def dedup_records(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first record of every key in capture order.

    An aggregation, not a ranking window: equal records are combined before the shuffle, so
    a fingerprint that holds a third of all rows costs no more than any other.
    """
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in records.columns])


def count_duplicates(records: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Per ``keys``: total rows, kept rows and suppressed repeats of ``identity``."""
    per = records.groupBy(*keys, *[c for c in identity if c not in keys]).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("duplicates"))


def cap(records: DataFrame, keys: list[str], order: str, limit: int, range_rows: int = RANGE_ROWS, ties: list[str] | None = None) -> DataFrame:
    """The first ``limit`` records of every key by the column ``order``; records without an order value come last.

    Exact whatever the sizes: a key's records are counted by ranges of the order, the ranges behind its ``limit``-th record are
    dropped unsorted, and only ranges are ranked. Of records with one order value the first by ``ties`` (by their
    other columns, if not given) are kept. A null key is a key like any other.
    """
    return first_rows(records, keys, order, limit, range_rows, ties)


def last_batches(records: DataFrame, session: str = "session_id", batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """The newest batch of every session."""
    return records.groupBy(session).agg(F.max_by(batch, order).alias(batch))


def undo_last_batch(records: DataFrame, session: str = "session_id", batch: str = "batch_id",
                    order: str = "seq") -> DataFrame:
    """All records but those of each session's newest batch."""
    return records.join(last_batches(records, session, batch, order), [session, batch], "left_anti")


def capture_stats(records: DataFrame, keys: list[str], batch: str = "batch_id", incomplete: str = "incomplete",
                  identity: list[str] | None = None, max_records: int = 50_000) -> DataFrame:
    """Per session: records kept, duplicates, incomplete rows, batches, and whether the limit is near."""
    identity = identity or [*keys, "fingerprint"]
    per = records.groupBy(*keys, *[c for c in identity if c not in keys]).agg(
        F.count("*").alias("n"), F.sum(F.col(incomplete).cast("int")).alias("bad"))
    counts = per.groupBy(*keys).agg(
        F.count("*").alias("total"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("bad").alias("incomplete"))
    batches = records.groupBy(*keys, batch).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("batches"))
    return counts.join(batches, keys).withColumn("near_limit", F.col("total") >= NEAR_LIMIT * max_records)


def search_records(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with a value that contains the query, ignoring case; an empty query keeps all rows.

    Array values are searched as their entries joined by commas.
    """
    query = query.strip().lower()
    if not query:
        return df
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.lower(_search_text(df, name)).contains(query)
    return df.where(hit)


def _search_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("array"):
        text = F.array_join(name, ",")
    elif kind in ("double", "float"):
        text = V.number_text(F.col(name))
    else:
        text = F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def search_values(records: DataFrame, query: str, values: str = "values") -> DataFrame:
    """``search_records`` for records that hold their values in a map."""
    query = query.strip().lower()
    if not query:
        return records
    return records.where(F.exists(F.map_values(values), lambda v: F.lower(F.coalesce(
        v["str"], V.number_text(v["num"]), F.array_join(v["arr"], ","), F.lit(""))).contains(query)))


def select_records(records: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Records whose id is among the chosen ones."""
    return records.join(chosen.select(*on).distinct(), on, "left_semi")


def is_empty(column: str, kind: str) -> Column:
    """Null, '' or an empty array."""
    c = F.col(column)
    if kind == "arr":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "str" else c.isNull()


def drop_empty_records(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with at least one value; ``columns`` maps names to kinds (str, num, arr)."""
    empty = F.lit(True)
    for name, kind in columns.items():
        empty = empty & is_empty(name, kind)
    return df.where(~empty)
