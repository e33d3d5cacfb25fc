"""Ranks that stay balanced when one key, or one order value, holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowharvest.session import materialize

#: Rows one ranking task may sort.
RANGE_ROWS = 2_000_000


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def comparable(df: DataFrame, column: str) -> Column:
    """A column to sort by; maps, which have no order, by their JSON text."""
    return F.to_json(F.struct(column)) if _has_map(df.schema[column].dataType) else F.col(column)


def same_values(left: str, right: str, columns: list[str]) -> Column:
    """Join condition: equal in all columns, nulls equal too."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def ordered_index(df: DataFrame, keys: list[str], order: str, range_rows: int = RANGE_ROWS, ties: list[str] | None = None) -> DataFrame:
    """Adds ``idx``, the zero-based rank of each row within ``keys`` by ``order``, rows without an order value last.

    Rows of one order value are ranked by the columns ``ties`` (by all others, if not given), so only rows that are equal in
    every column may change places. Null keys are a key like any other.

    A plain ranking window would sort all rows of a key in one task. Larger tables are dealt into ranges of the composite
    order (order value, ties, place in the input) first, of about ``range_rows`` each, and written; a value that very many
    rows share, null among them, thus fills several ranges. Each range is ranked by itself and shifted by the rows of its key in the ranges before it.
    """
    return _ranked(df, keys, order, range_rows, ties, None)


def first_rows(df: DataFrame, keys: list[str], order: str, limit: int, range_rows: int = RANGE_ROWS, ties: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows of every key in the order of ``ordered_index``; ranges behind the last one needed are not ranked."""
    return _ranked(df, keys, order, range_rows, ties, limit).where(F.col("idx") < limit).drop("idx")


def _ranked(df: DataFrame, keys: list[str], order: str, range_rows: int, ties: list[str] | None, limit: int | None) -> DataFrame:
    rest = ties if ties is not None else [c for c in df.columns if c not in (*keys, order)]
    by = [F.col(order).asc_nulls_last(), *[comparable(df, c) for c in rest]]
    per_key = [F.col(k) for k in keys] or [F.lit(0)]
    n = df.count()
    if n <= range_rows:
        inside = Window.partitionBy(*per_key).orderBy(*by)
        return df.withColumn("idx", (F.row_number().over(inside) - 1).cast("long"))
    ranges = -(-n // range_rows)
    spread = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, "_row").drop("_row")
    placed = materialize(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))  # a row per key and range
    earlier = Window.partitionBy(*per_key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if limit is not None:
        shifts = shifts.where(F.col("_shift") < limit)
    joined = placed.alias("r").join(shifts.alias("s"), same_values("r", "s", [*keys, "_range"])).select("r.*", "s._shift")
    inside = Window.partitionBy(*per_key, "_range").orderBy(*by)
    return joined.withColumn("idx", (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long")).select(*df.columns, "idx")
