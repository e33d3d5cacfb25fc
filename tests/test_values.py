import pytest
from pyspark.sql import functions as F

from rowharvest.functions import values as V


def one(spark, expr, **cols):
    """The expression's value."""
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [
    ("€ 1.234,50", 1234.5), ("1,234.50", 1234.5), ("1,234", 1.234), ("1,234,567", 1.234), ("Rs. 500", 0.5),
    ("12.5.6", 12.5), ("2024-01-03", 2024.0), ("n/a", None), ("", None), ("-7", -7.0), ("12.", 12.0), ("--5", None),
])
def test_parse_number(spark, text, value):
    assert one(spark, V.parse_number(F.col("t")), t=text) == value


def test_parse_number_us_grouping(spark):
    assert one(spark, V.parse_number(F.col("t"), "us"), t="1,234,567") == 1234567.0


@pytest.mark.parametrize("text,value", [
    ("  Café​   Chair ", "Café Chair"), ("a \n b", "a b"), ("ﬁne…", "fine..."),
    ("Café", "Café"), ("　x y﻿ ", "x y"), ("plain", "plain"),
])
def test_normalize_whitespace(spark, text, value):
    assert one(spark, V.normalize_whitespace(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,value", [
    ("2024-01-03", "2024-01-03T00:00:00.000Z"), ("August 20, 2026", "2026-08-20T00:00:00.000Z"),
    ("14 Aug 2023", "2023-08-14T00:00:00.000Z"), ("3 jan 2024", "2024-01-03T00:00:00.000Z"),
    ("8/20/2026", "2026-08-20T00:00:00.000Z"), ("2024-01-03T10:20:30+02:00", "2024-01-03T08:20:30.000Z"),
    ("yesterday", "yesterday"), ("13/45/2026", "13/45/2026"), ("May 2", "May 2"),
])
def test_parse_date(spark, text, value):
    assert one(spark, V.parse_date(F.col("t")), t=text) == value


@pytest.mark.parametrize("ref,base,url", [
    ("item/4", "https://example.test/catalog/", "https://example.test/catalog/item/4"),
    ("/für", "https://example.test/a/b?x=1#f", "https://example.test/f%C3%BCr"),
    ("../c", "https://example.test/a/b/d", "https://example.test/a/c"),
    ("?q=1", "https://example.test/a/b?x=1", "https://example.test/a/b?q=1"),
    ("#top", "https://example.test/a/b?x=1#f", "https://example.test/a/b?x=1#top"),
    ("//Cdn.test/x y", "https://example.test/", "https://cdn.test/x%20y"),
    ("HTTP://Example.TEST:80", "https://e.test/", "http://example.test/"),
    ("mailto:a@b.test", "https://e.test/", "mailto:a@b.test"),
    ("x/../../..", "https://e.test/a/", "https://e.test/"),
    ("page", None, "page"),
])
def test_resolve_url(spark, ref, base, url):
    assert one(spark, V.resolve_url(F.col("r"), F.col("b")), r=ref, b=base) == url


def fnv(text):
    h = 2166136261
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i:i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("text", ["", "abc", "Café", "naïve 😀 text", "x" * 5000])
def test_fnv(spark, text):
    assert one(spark, V.fnv1a32(F.col("t")), t=text) == fnv(text)
    digits = one(spark, V.short_hash(F.col("t")), t=text)
    assert int(digits, 36) == fnv(text) and digits == digits.lower()


@pytest.mark.parametrize("num,text", [(12.0, "12"), (1234.5, "1234.5"), (-0.25, "-0.25"), (12345678.9, "12345678.9"),
                                      (1e10, "10000000000"), (None, "")])
def test_number_text(spark, num, text):
    df = spark.createDataFrame([(num,)], "n double")
    assert df.select(V.serialize(F.col("n"), "num").alias("v")).first()["v"] == text


@pytest.mark.parametrize("text,cell", [('=HYPERLINK("bad")', '"\'=HYPERLINK(""bad"")"'), ("-2+3", '"\'-2+3"'),
                                       ("a, b\nc", '"a, b\nc"')])
def test_csv_safe(spark, text, cell):
    assert one(spark, V.csv_safe(F.col("t")), t=text) == cell


@pytest.mark.parametrize("text,name", [("product-name", "Product Name"), ("someName", "Some Name"),
                                       ("library id", "Library Id"), ("a_b--c", "A B C")])
def test_title_case(spark, text, name):
    assert one(spark, V.title_case(F.col("t")), t=text) == name


def test_patterns(spark):
    text = "Library ID: 771122 mail sales@example.test or ADMIN@example.test"
    assert one(spark, V.pattern_first(F.col("t"), r"library\s+id\s*:\s*(\d+)"), t=text) == "771122"
    assert one(spark, V.pattern_all(F.col("t"), r"([A-Z]+@[A-Z.]+)"), t=text) == ["sales@example.test", "ADMIN@example.test"]
    assert one(spark, V.pattern_first(F.col("t"), r"\d+"), t=text) == "771122"
