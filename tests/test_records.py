import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rowharvest import fields as FL
from rowharvest.fields import Field, Locator
from rowharvest.operators import profile, records, skew
from rowharvest.operators.extract import from_wide, is_incomplete, to_wide
from rowharvest.sinks import export, store
from rowharvest.sources import pages as P


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    # One session holds most of the rows and one fingerprint a third of them.
    data = [("hot" if rnd.random() < 0.7 else f"s{rnd.randrange(5)}", i,
             "f0" if rnd.random() < 0.35 else f"f{rnd.randrange(60)}", f"b{i // 5000}", rnd.random() < 0.1)
            for i in rnd.sample(range(100000), 1500)]
    return spark.createDataFrame(data, "session_id string, seq long, fingerprint string, batch_id string, incomplete boolean")


def brute(rows):
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["seq"])


def test_dedup_first_wins(rows):
    want = {}
    for r in brute(rows):
        want.setdefault((r["session_id"], r["fingerprint"]), r)
    got = records.dedup_records(rows, ["session_id", "fingerprint"], "seq").collect()
    assert {(r.session_id, r.fingerprint): r.asDict() for r in got} == want
    dup = {r.session_id: r for r in records.count_duplicates(rows, ["session_id"], ["session_id", "fingerprint"]).collect()}
    assert sum(r.kept for r in dup.values()) == len(want) and dup["hot"].total == dup["hot"].kept + dup["hot"].duplicates


@pytest.mark.parametrize("limit", [10, 700])
def test_cap(rows, limit):
    want, seen = set(), {}
    for r in brute(rows):
        seen[r["session_id"]] = seen.get(r["session_id"], 0) + 1
        if seen[r["session_id"]] <= limit:
            want.add(r["seq"])
    for range_rows in (10, 10**6):
        assert {r.seq for r in records.cap(rows, ["session_id"], "seq", limit, range_rows).collect()} == want


@pytest.mark.parametrize("limit", [900, 1500])
def test_cap_keeps_exactly_the_limit_among_ties(spark, limit):
    tied = spark.range(3000).select(F.lit("s").alias("session_id"), F.lit(7).alias("seq"), F.format_string("%05d", "id").alias("name"))
    assert sorted(r.name for r in records.cap(tied, ["session_id"], "seq", limit).collect()) == [f"{i:05d}" for i in range(limit)]


def test_ordered_index(rows):
    want, seen = {}, {}
    for r in brute(rows):
        want[r["seq"]] = seen.get(r["session_id"], 0)
        seen[r["session_id"]] = want[r["seq"]] + 1
    for range_rows in (5, 100, 10**6):
        assert {r.seq: r.idx for r in skew.ordered_index(rows, ["session_id"], "seq", range_rows).collect()} == want
    assert [r.idx for r in skew.ordered_index(rows, [], "seq", 5).orderBy("seq").collect()] == list(range(1500))
    timed = rows.withColumn("at", F.timestamp_micros(F.col("seq") * 1000))
    assert {r.seq: r.idx for r in skew.ordered_index(timed, ["session_id"], "at", 100).collect()} == want


def rank_rows(rows):
    """Rows (key, order, name) with their rank, missing order values last."""
    ranks, seen = [], {}
    for key, order, name in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        ranks.append((key, order, name, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    return ranks


@pytest.mark.parametrize("range_rows", [10, 60, 10**6])
def test_ranks_and_caps_with_missing_keys_and_order_values(spark, range_rows):
    rnd = random.Random(range_rows)
    data = [(rnd.choice(("k", "k", "k", "m", None)), rnd.choice((None, 1, 2, 2, 2, 9)), i) for i in range(1000)]
    df = spark.createDataFrame(data, "key string, at long, name long").withColumn("extra", F.create_map(F.lit("a"), "name"))
    want = rank_rows(data)
    got = skew.ordered_index(df, ["key"], "at", range_rows, ties=["name"])
    assert sorted(map(tuple, got.select("key", "at", "name", "idx").collect()), key=repr) == sorted(want, key=repr)
    for limit in (1, 50, 400):
        kept = records.cap(df, ["key"], "at", limit, range_rows, ties=["name"])
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.select("key", "at", "name").collect()), key=repr) == sorted(
            [r[:3] for r in want if r[3] < limit], key=repr)


def test_equal_rows_of_one_key_are_spread_over_ranges(spark):
    df = spark.range(3000).select(F.lit(None).cast("string").alias("key"), F.lit(7).alias("at"))
    assert records.cap(df, ["key"], "at", 1234, range_rows=100).count() == 1234
    assert [r.idx for r in skew.ordered_index(df, ["key"], "at", 100).orderBy("idx").collect()] == list(range(3000))
    assert [r.idx for r in skew.ordered_index(df.drop("key"), [], "at", 100).orderBy("idx").collect()] == list(range(3000))
    assert records.cap(df.limit(0), ["key"], "at", 5, range_rows=100).count() == 0


def test_batches_and_stats(spark, rows, tmp_path):
    stats = {r.session_id: r for r in records.capture_stats(rows, ["session_id"], max_records=50).collect()}
    b = brute(rows)
    assert stats["hot"].batches == len({r["batch_id"] for r in b if r["session_id"] == "hot"})
    assert stats["hot"].incomplete == sum(r["incomplete"] for r in b if r["session_id"] == "hot") and stats["hot"].near_limit
    last = max((r for r in b if r["session_id"] == "hot"), key=lambda r: r["seq"])["batch_id"]
    kept = records.undo_last_batch(rows).where("session_id = 'hot'")
    want = {r["seq"] for r in b if r["session_id"] == "hot" and r["batch_id"] != last}
    assert {r.seq for r in kept.collect()} == want
    path = str(tmp_path / "store")
    one = rows.withColumn("session_id", F.concat(F.lit("a/"), "session_id"))
    store.append_batch(one, path)
    store.append_batch(one, path)
    assert store.read_records(spark, path).count() == 1500
    assert store.undo_last_batch(spark, path, "a/hot") == last
    assert {r.seq for r in store.read_records(spark, path, "a/hot").collect()} == want
    files = lambda: sorted(str(p) for p in (tmp_path / "store" / "data").rglob("*.parquet"))
    written = files()
    assert store.clear_session(spark, path, "a/hot") and not store.clear_session(spark, path, "a/hot")
    assert store.read_records(spark, path, "a/hot").count() == 0 and store.undo_last_batch(spark, path, "a/hot") is None
    assert files() == written  # undoing and clearing touch no data
    rest = 1500 - sum(r["session_id"] == "hot" for r in b)
    assert store.read_records(spark, path).count() == rest
    with pytest.raises(ValueError, match="64 buckets"):
        store.read_records(spark, path, "a/hot", buckets=8)
    again = one.where("session_id = 'a/hot'").limit(3)
    store.append_batch(again, path)  # a cleared session begins anew
    assert store.read_records(spark, path, "a/hot").count() == 3 and store.read_records(spark, path).count() == rest + 3
    store.compact(spark, path)
    assert store.read_records(spark, path).count() == rest + 3 and store.read_records(spark, path).columns == one.columns


def test_a_batch_written_again_replaces_only_its_own_sessions(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *data: spark.createDataFrame(data, "session_id string, batch_id string, seq long")
    store.append_batch(rows(("a", "b1", 1), ("a", "b1", 2), ("b", "b1", 3), (None, "b1", 4)), path, buckets=1)
    store.append_batch(rows(("a", "b1", 5)), path)
    store.append_batch(rows(("c", "b1", 6), ("a", "b2", 7)), path, compact_after=3)
    store.append_batch(rows().limit(0), path)
    got = lambda: sorted(((r.session_id, r.batch_id, r.seq) for r in store.read_records(spark, path).collect()), key=str)
    want = [("a", "b1", 5), ("a", "b2", 7), ("b", "b1", 3), ("c", "b1", 6), (None, "b1", 4)]
    assert got() == want and store.read_log(spark, path).where("op = 'base'").count() > 0
    (tmp_path / "store" / "data" / "part=wlost").mkdir()  # a job that was lost before its entry
    rows(("a", "b9", 9)).withColumn("bucket", F.lit(0)).write.mode("append").parquet(str(tmp_path / "store" / "data" / "part=wlost"))
    assert got() == want
    assert store.undo_last_batch(spark, path, "a") == "b2" and got() == [r for r in want if r[1] != "b2"]
    with pytest.raises(Exception, match="(?i)exists"):
        store._enter(rows().limit(0), path, 0)


def test_an_ordered_file_from_many_parts(spark, tmp_path):
    fields = [Field("name", "Name")]
    for n in (1, 2, 700):
        rows = spark.range(n).repartition(5).select((n - F.col("id")).alias("seq"), F.concat(F.lit("ü\n"), F.col("id").cast("string")).alias("name"))
        for _ in range(2):  # the second one takes the place of the first
            export.write_json(rows, fields, str(tmp_path / f"j{n}"), "seq")
            export.write_csv(rows, fields, f"file:{tmp_path}/c{n}", single_file=True, order="seq")
        (part,) = (tmp_path / f"j{n}").glob("part-*")
        assert [r["Name"] for r in json.loads(part.read_text())] == [f"ü\n{n - 1 - i}" for i in range(n)]
        (part,) = (tmp_path / f"c{n}").glob("part-*")
        assert part.read_bytes().decode("utf-8-sig") == '"Name"\r\n' + "".join(f'"ü\n{n - 1 - i}"\r\n' for i in range(n))


FIELDS = [Field("name", "Name", required=True), Field("note", "Note"), Field("n", "N", "number"),
          Field("tags", "Tags", multiple=True), Field("x", "X", hidden=True)]


@pytest.fixture(scope="module")
def wide(spark):
    data = [(1, '=HYPERLINK("bad")', 'comma, quote " and\nline', 12.0, ["a", "b"], "h"), (2, "Item 2", None, 0.5, [], "h"),
            (3, None, "", None, None, "h")]
    df = spark.createDataFrame(data, "seq long, name string, note string, n double, tags array<string>, x string")
    return df.withColumns({"source_url": F.lit("https://e.test"), "captured_at": F.lit(dt.datetime(2025, 1, 1)),
                           "batch_id": F.lit("b"), "fingerprint": F.concat(F.lit("f"), "seq")})


def test_exports(wide, tmp_path):
    export.write_csv(wide.orderBy("seq"), FIELDS, str(tmp_path / "csv"), metadata=True, single_file=True)
    text = next((tmp_path / "csv").glob("*.txt")).read_bytes().decode()
    assert text.startswith('﻿"Name","Note","N","Tags","Source URL","Captured At","Batch ID","Fingerprint"\r\n')
    assert '"\'=HYPERLINK(""bad"")","comma, quote "" and\nline","12","a | b","https://e.test","2025-01-01T00:00:00.000Z"' in text
    assert text.endswith('"","","","","https://e.test","2025-01-01T00:00:00.000Z","b","f3"\r\n')
    export.write_jsonl(wide, FIELDS, str(tmp_path / "jsonl"))
    lines = [json.loads(x) for p in (tmp_path / "jsonl").glob("*.txt") for x in p.read_text().splitlines()]
    assert len(lines) == 3 and list(lines[0]) == ["Name", "Note", "N", "Tags"]
    assert {"Name": "Item 2", "Note": None, "N": 0.5, "Tags": []} in lines
    export.write_json(wide, FIELDS, str(tmp_path / "json"), "seq", metadata=True)
    whole = json.loads(next((tmp_path / "json").glob("*.txt")).read_text())
    assert [r["_metadata"]["fingerprint"] for r in whole] == ["f1", "f2", "f3"] and whole[0]["N"] == 12
    with pytest.raises(ValueError):
        export.json_object(wide, [Field("name", "Same"), Field("note", "Same")])


def test_search_select_incomplete(wide):
    cols = ["name", "note", "n", "tags"]
    assert [r.seq for r in records.search_records(wide, "  QUOTE ", cols).collect()] == [1]
    assert [r.seq for r in records.search_records(wide, "a,b", cols).collect()] == [1]
    assert records.search_records(wide, " ", cols).count() == 3
    assert [r.seq for r in records.select_records(wide, wide.where("n = 0.5"), ["seq"]).collect()] == [2]
    maps = from_wide(wide, FIELDS, ("seq",))
    assert [r.i for r in maps.select(is_incomplete(FIELDS).alias("i")).collect()] == [False, False, True]
    assert [r.seq for r in records.search_values(maps, "item").collect()] == [2]
    assert to_wide(maps, FIELDS, ("seq",)).collect() == wide.select("seq", *[f.id for f in FIELDS]).collect()
    kinds = {"name": "str", "note": "str", "n": "num", "tags": "arr"}
    assert [r.seq for r in records.drop_empty_records(wide, kinds).orderBy("seq").collect()] == [1, 2]


def test_profiles_of_all_rows(spark):
    n = 4501
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"),
                               F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 7)).alias("a"),
                               F.repeat(F.lit("x"), 500).alias("b"))
    fields = [Field("a", "A"), Field("b", "B"), Field("h", "H", hidden=True)]
    got = {r.id: r for r in profile.profile_fields(df, fields, ["session_id"], "seq").collect()}
    vals = [f"v{i % 7}" for i in range(n) if i % 3]
    assert set(got) == {"a", "b"}
    assert got["a"].coverage == pytest.approx(len(vals) / n) and got["a"].unique_ratio == pytest.approx(7 / len(vals))
    assert got["a"].samples == list(dict.fromkeys(vals))[:3]
    assert [len(s) for s in got["b"].samples] == [160] and got["b"].average_length == 500


def test_quality(spark):
    fields = [Field("a", "A"), Field("b", "B"), Field("c", "C"), Field("d", "D")]
    data = [("s", f"v{i}", f"v{i}" if i else "other", None, "y" * 1500) for i in range(20)] + [("t", "1", "2", "3", "4")]
    df = spark.createDataFrame(data, "k string, a string, b string, c string, d string")
    got = [(r.k, r.issue) for r in profile.evaluate_quality(df, fields, ["k"]).orderBy("k", "issue_no").collect()]
    assert got == [("s", "C: fewer than 5% of the records have a value"),
                   ("s", "D: values are so long that they may be whole records"), ("s", "A = B: nearly all values are equal")]
    none = profile.evaluate_quality(df.where("k = 'zz'"), fields).collect()
    assert [r.issue for r in none] == ["no record is left"]


def test_page_policy(spark):
    urls = ["chrome://settings", "https://chrome.google.com/webstore/detail/x", "https://example.test/products",
            "https://secure.banking.example/x", "ftp://x.test/", "https://a.b.blocked.test/", "https://notblocked.test/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", P.V.host_of(F.col("url")))
    assert [r.page_id for r in P.filter_fetchable(df).orderBy("page_id").collect()] == [2, 3, 5, 6]
    assert [r.page_id for r in df.where(P.is_sensitive_host(F.col("host"))).collect()] == [3]
    assert P.parse_domains(" Blocked.test,\nother.test ,, ") == ["blocked.test", "other.test"]
    blocked = spark.createDataFrame([(d,) for d in P.parse_domains("Blocked.test")], "domain string")
    assert 5 not in {r.page_id for r in P.drop_blocked(df, blocked).collect()}
    assert 6 in {r.page_id for r in P.drop_blocked(df, blocked).collect()}


def test_field_edits():
    f = [Field("a", "A", locators=(Locator.by_class("b", "x"), Locator.item()), pattern="(x)"), Field("b", "B")]
    assert FL.rename(f, "a", "n" * 99)[0].name == "n" * 80
    assert [x.id for x in FL.move(f, "b", -1)] == ["b", "a"] and FL.move(f, "a", -1) == f
    assert FL.toggle_hidden(f, "b")[1].hidden and [x.id for x in FL.delete(f, "a")] == ["b"]
    assert FL.add_custom(f, "c")[2].name == "Field 3" and FL.retype(f, "b", "price")[1].type == "price"
    moved = FL.repoint(f, "a", Locator.by_tag("a"), "url", "href")[0]
    assert moved.pattern is None and len(moved.locators) == 1 and moved.attribute == "href"
    with pytest.raises(ValueError):
        Field("q", "Q", "nonsense")
