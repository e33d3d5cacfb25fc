"""Column profiles and quality issues of record sets in wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowharvest.fields import Field, visible
from rowharvest.functions import values as V
from rowharvest.operators.extract import kind_of
from rowharvest.session import materialize

# Bounds of profiles and issues.
SAMPLE_LENGTH = 160
SAMPLES = 3
MIN_COVERAGE = 0.05
MAX_MEAN_LENGTH = 1400
EQUAL_SHARE = 0.9


def _text(field: Field) -> Column:
    return V.serialize(F.col(field.id), kind_of(field))


def profile_fields(records: DataFrame, fields: list[Field], keys: list[str], order: str) -> DataFrame:
    """Per key and visible field, over all records: coverage, unique_ratio, average_length and the first samples.

    Values are counted per key, field and value before anything is gathered. The samples are the three values
    that come first by ``order``, each shown up to 160 characters; ranks above three are dropped before the shuffle.
    """
    shown = visible(fields)
    cells = records.select(*keys, F.col(order).alias("_at"), F.inline(F.array(*[F.struct(
        F.lit(i).alias("field_no"), F.lit(f.id).alias("id"), F.lit(f.name[:80]).alias("name"), F.lit(f.type).alias("type"),
        _text(f).alias("value")) for i, f in enumerate(shown, 1)])))
    by_field = [*keys, "field_no", "id", "name", "type"]
    by_value = materialize(cells.groupBy(*by_field, "value").agg(F.count("*").alias("n"), F.min("_at").alias("first")), "values")
    filled = F.col("value") != ""
    count = F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0))
    first = F.row_number().over(Window.partitionBy(*by_field).orderBy("first", "value"))
    samples = by_value.where(filled).withColumn("k", first).where(F.col("k") <= SAMPLES).groupBy(*by_field).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: F.substring(s["value"], 1, SAMPLE_LENGTH)).alias("samples"))
    return by_value.groupBy(*by_field).agg(
        (count / F.sum("n")).alias("coverage"),
        F.when(count > 0, F.count_if(filled) / count).otherwise(F.lit(0.0)).alias("unique_ratio"),
        F.when(count > 0, F.sum(F.when(filled, F.length("value") * F.col("n"))) / count).otherwise(F.lit(0.0))
        .alias("average_length")).join(samples, by_field, "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>")))


def column_patterns(records: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """Rows counted by which columns are filled and which of them hold equal values.

    ``pattern`` has one entry per column: 0 when empty, else the number of the first column
    with the same value. Real data shows few patterns, so the partial aggregation reduces
    the rows before the shuffle, and column pairs are compared on patterns instead of rows.
    """
    texts = F.array(*[_text(f) for f in fields])
    pattern = V.let(texts, lambda a: F.transform(a, lambda v: F.when(v == "", F.lit(0)).otherwise(
        F.array_position(a, v).cast("int"))))
    return records.select(*keys, F.array_join(pattern.cast("array<string>"), ",").alias("pattern"),
                          *[F.length(_text(f)).alias(f"_len{i}") for i, f in enumerate(fields)]).groupBy(
        *keys, "pattern").agg(F.count("*").alias("n"), F.array(*[
            F.sum(f"_len{i}") for i in range(len(fields))]).alias("lengths"))


def evaluate_quality(records: DataFrame, fields: list[Field], keys: list[str] | None = None, *, expected: DataFrame | None = None,
                     most: int | None = None) -> DataFrame:
    """All issues (with ``most``, the first so many) per key, in order: keys, issue_no, issue.

    One pass over the records: empty and verbose columns and equal column pairs all follow
    from the pattern counts. A set without records is itself an issue: the whole set without keys, and
    with keys those of ``expected`` (a table of the keys there were before) that have none left.
    """
    grouped = bool(keys)
    keys = keys or ["_all"]
    df = records if grouped else records.withColumn("_all", F.lit(0))
    names = F.array(*[F.lit(f.name) for f in fields])
    # Written once: three small aggregations read the counts, none reads the records again.
    patterns = materialize(column_patterns(df, fields, keys), "patterns").withColumn(
        "p", F.split("pattern", ",").cast("array<int>"))
    totals = patterns.groupBy(*keys).agg(F.sum("n").alias("rows"))
    per_field = patterns.select(*keys, "n", F.posexplode(F.arrays_zip("p", "lengths")).alias("i", "e")).groupBy(
        *keys, "i").agg(F.sum(F.when(F.col("e.p") > 0, F.col("n")).otherwise(0)).alias("filled"),
                        F.sum("e.lengths").alias("chars")).join(totals, keys)
    name = F.get(names, F.col("i"))
    of_fields = per_field.select(*keys, F.col("i"), F.inline(F.array_compact(F.array(
        F.when(F.col("filled") / F.col("rows") < MIN_COVERAGE, F.struct(
            F.lit(0).alias("j"), F.concat(name, F.lit(": fewer than 5% of the records have a value")).alias("issue"))),
        F.when((F.col("filled") > 0) & (F.col("chars") / F.col("filled") > MAX_MEAN_LENGTH), F.struct(
            F.lit(1).alias("j"),
            F.concat(name, F.lit(": values are so long that they may be whole records")).alias("issue")))))))
    places = F.transform("p", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    filled = F.filter(places, lambda e: e["v"] > 0)
    pairs = patterns.withColumn("f", filled).select(*keys, "n", "f", F.explode("f").alias("a")).select(
        *keys, "n", "a", F.explode(F.filter("f", lambda e: e["i"] > F.col("a.i"))).alias("b"))
    equal = pairs.groupBy(*keys, F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(
        F.sum("n").alias("compared"), F.sum(F.when(F.col("a.v") == F.col("b.v"), F.col("n")).otherwise(0)).alias("same"))
    of_pairs = equal.where((F.col("compared") >= 2) & (F.col("same") / F.col("compared") > EQUAL_SHARE)).select(
        *keys, "i", "j", F.concat(F.get(names, F.col("i")), F.lit(" = "), F.get(names, F.col("j")),
                                  F.lit(": nearly all values are equal")).alias("issue"))
    both = of_fields.withColumn("part", F.lit(0)).unionByName(of_pairs.withColumn("part", F.lit(1)))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "i", "j"))
    issues = both.withColumn("issue_no", number).where(F.lit(True) if most is None else F.col("issue_no") <= most).select(*keys, "issue_no", "issue")
    emptied = [F.lit(1).alias("issue_no"), F.lit("no record is left").alias("issue")]
    if grouped:
        return issues if expected is None else issues.unionByName(
            expected.select(*keys).distinct().join(totals, keys, "left_anti").select(*keys, *emptied))
    nothing = patterns.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("_all"), *emptied)
    return issues.unionByName(nothing).drop("_all")
