import datetime as dt
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rowharvest import schemas
from rowharvest.fields import Field, Locator
from rowharvest.operators.locate import Collection, locate_items, locator_from_css
from rowharvest.queries import QUERIES, load
from rowharvest.sinks.store import data_path, read_records
from rowharvest.sources.nodes import page_nodes
from rowharvest.sources.pages import latest_snapshot, read_snapshots
from rowharvest.streaming import capture as C
from tests.pages import BASE, ID, pages_frame

ROWS = Collection("rows", "#list", ":scope > article.line")
FIELDS = [Field("name", "Name", "text", (Locator.by_class("span", "label"),), required=True)]
T0 = dt.datetime(2025, 1, 1)
load()


def state(names, start):
    return '<section id="list">' + "".join(
        f'<article class="line" data-key="{start + i}"><span class="label">{n}</span></article>'
        for i, n in enumerate(names)) + "</section>"


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    """Recycled rows: three states of one page, an unchanged state, and a navigation."""
    rows = [(1, BASE + "/v", state("ABC", 0), T0), (1, BASE + "/v", state("DEF", 3), T0 + dt.timedelta(seconds=1)),
            (1, BASE + "/v", state("DEF", 3), T0 + dt.timedelta(seconds=2)),
            (1, BASE + "/v", state(["G", "", "F"], 3), T0 + dt.timedelta(seconds=3)),
            (1, BASE + "/v#beta", state("ABC", 0), T0 + dt.timedelta(seconds=4))]
    path = str(tmp_path_factory.mktemp("states"))
    for r in rows:
        spark.createDataFrame([r], schemas.SNAPSHOT).coalesce(1).write.mode("append").parquet(path)
    return path


def names(df):
    return sorted((r.source_url, r["values"]["name"].str or "") for r in df.collect())


def test_capture_end_to_end(spark, states, tmp_path):
    d = {n: str(tmp_path / n) for n in ("log", "ck1", "ck2", "ck3", "store", "ledger", "ck4", "totals")}
    C.run_available(C.stream_records(read_snapshots(spark, states, 1), [ROWS], FIELDS, d["log"], d["ck1"]))
    log = spark.read.parquet(d["log"])
    batch = C.records_of_states(spark.read.parquet(states), [ROWS], FIELDS)
    assert {r.fingerprint for r in log.select("fingerprint").distinct().collect()} == {
        r.fingerprint for r in batch.select("fingerprint").distinct().collect()}
    fresh = C.stream_dedup(C.read_stream_table(spark, d["log"], log.schema), ["session_id", "fingerprint"])
    C.run_available(C.stream_to_store(fresh, d["store"], d["ledger"], d["ck2"], max_records=7))
    stored = read_records(spark, d["store"])
    assert names(stored.where(F.col("source_url").endswith("beta"))) == [(BASE + "/v#beta", n) for n in "ABC"]
    assert stored.groupBy("session_id").count().agg(F.max("count")).first()[0] == 7
    totals = C.stream_stats(C.read_stream_table(spark, data_path(d["store"]), stored.schema), ["session_id"])
    C.run_available(C.write_changes(totals, d["totals"], d["ck4"], ["session_id"]))
    assert sorted(r.n for r in C.latest_totals(spark, d["totals"], ["session_id"]).collect()) == [3, 7]


def test_batch_semantics(spark, states):
    snapshots = spark.read.parquet(states)
    assert {r.url for r in latest_snapshot(snapshots).collect()} == {BASE + "/v#beta"}
    again = C.recapture(snapshots, [ROWS], FIELDS)
    assert names(again) == [(BASE + "/v#beta", n) for n in "ABC"]


def test_cap_across_batches(spark):
    batch = spark.range(100).select(F.when(F.col("id") < 80, "a").otherwise("b").alias("session_id"), F.col("id").alias("seq"))
    ledger = spark.createDataFrame([("a", "b0", 45), ("a", "b1", 99)], "session_id string, batch_id string, accepted long")
    got = C.accept_batch(batch, ledger, "b1", 50, range_rows=7).groupBy("session_id").agg(F.count("*"), F.max("seq")).collect()
    assert {tuple(r) for r in got} == {("a", 5, 4), ("b", 20, 99)}


def test_retry_states(spark, tmp_path):
    rows = [("s", "k1", 1, True), ("s", "k1", 2, False), ("s", "k2", 3, False), *[("s", "k3", 10 + i, True) for i in range(5)]]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "session_id string, item_key string, seq long, incomplete boolean").coalesce(1).write.parquet(src)
    stream = C.incomplete_retry(spark.readStream.schema("session_id string, item_key string, seq long, incomplete boolean").parquet(src))
    q = stream.writeStream.format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "ck")).start()
    end, got = time.time() + 40, []
    while time.time() < end and not any(g[2] == "gave_up" for g in got):  # timers keep such a query busy for ever
        time.sleep(1)
        got = sorted(tuple(r) for r in spark.table("retries").collect())
    q.stop()
    assert ("s", "k3", "gave_up", 3) in got
    assert [g for g in got if g[1] == "k1"] == [("s", "k1", "completed", 1), ("s", "k1", "retry", 1)]
    assert not [g for g in got if g[1] == "k2"]
    assert [g[2:] for g in got if g[1] == "k3" and g[2] == "retry"] == [("retry", 1), ("retry", 2), ("retry", 3)]


class Handle:
    """State of one item and its timers, in memory."""

    def __init__(self, attempts=None):
        self.value, self.timers, self.ttl = attempts, [], None

    def getValueState(self, name, schema, ttl):
        self.ttl = ttl
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_retry_timers():
    state, retries, out = Handle((1, 5)), C.Retries(), []
    retries.init(state)
    waits = []
    while state.exists():
        state.timers.clear()  # the timer that calls is gone
        out += [tuple(r) for r in retries.handleExpiredTimer(("s", "k"), Now(), None)]
        waits += state.timers if state.exists() else []
    assert out == [("s", "k", "gave_up", 3)] and waits == [1900, 2200] and state.ttl == C.RETRY_TTL_MS
    assert list(retries.handleExpiredTimer(("s", "k"), Now(), None)) == []  # forgotten meanwhile
    state = Handle()
    retries.init(state)
    read = lambda *pairs: [r[2:] for r in map(tuple, retries.handleInputRows(("s", "k"), iter(
        [Row(seq=q, incomplete=i) for q, i in pairs]), Now()))]
    assert read((2, False), (1, False)) == [] and state.value is None and state.timers == []
    assert read((9, True), (8, False)) == [("retry", 1)] and state.value == (1, 1600) and state.timers == [1600]
    assert read((11, True), (10, True), (12, True)) == [("retry", 2), ("retry", 3)] and state.timers == [2200]
    assert read((20, False)) == [("completed", 3)] and state.value is None and state.timers == []


def test_locators_and_items(spark):
    for css in ("#a", "div.x.y", 'li[role="listitem"]', ":scope > td:nth-of-type(2)", "main > section[2]".replace("[2]", ":nth-of-type(2)"), ":scope"):
        assert locator_from_css(css).css == css
    for css in ("[[bad", "a b", "a > b.c", ""):
        with pytest.raises(ValueError):
            locator_from_css(css)
    nodes = page_nodes(pages_frame(spark))
    got = locate_items(nodes, [Collection("t", "table.berths", ":scope > tr"), Collection("g", "#grid", ":scope > article.tile.product"),
                               Collection("s", "main > goods-grid >>> section", ":scope > article.tile")])
    counts = {(r.page_id, r.cid): r["count"] for r in got.groupBy("page_id", "cid").count().collect()}
    assert counts[ID["table"], "t"] == 3 and counts[ID["cards"], "g"] == 8 and counts[ID["shadow"], "s"] == 6


def test_frames_and_limitations(spark):
    from rowharvest.sources.frames import frame_links, stitch_frames
    from rowharvest.sources.pages import page_limitations, page_titles

    pages = pages_frame(spark)
    nodes = page_nodes(pages)
    stitched = stitch_frames(nodes, pages)
    inside = stitched.where((F.col("page_id") == ID["frame"]) & (F.col("tree") > 0))
    assert inside.where("tag = 'article'").count() == 3
    rows = stitched.where(F.col("page_id") == ID["frame"]).collect()
    assert len({r.pre for r in rows}) == len(rows) and all(a < r.pre for r in rows for a in r.ancestors)
    host = next(r for r in rows if r.tree > 0 and r.depth == 0).host
    assert next(r for r in rows if r.pre == host).tag == "iframe"
    links = frame_links(nodes, pages)
    got = {r.page_id: r for r in page_limitations(pages, nodes).collect()}
    assert got[ID["frame"]].inaccessible_frames == 1 and got[ID["cards"]].limitations == []
    assert page_limitations(pages, nodes, links).where(F.col("page_id") == ID["frame"]).first().inaccessible_frames == 0
    odd = spark.createDataFrame([(1, BASE, "<canvas></canvas>short"), (2, BASE, "<x-menu></x-menu>"), (3, BASE, "%PDF-1.4 x")],
                                "page_id long, url string, html string")
    notes = {r.page_id: r.limitations for r in page_limitations(odd, page_nodes(odd)).collect()}
    assert ["canvas" in n for n in notes[1]] == [True] and ["closed" in n for n in notes[2]] == [True] and len(notes[3]) == 1
    assert {r.page_id: r.title for r in page_titles(nodes).collect()}[ID["cards"]] == "cards"


def test_thousands_of_collections_are_one_plan(spark):
    from rowharvest.operators.extract import fields_table
    from rowharvest.operators.locate import collections_table

    known = [Collection(f"c{i}", f"section.k{i} > div.list", f":scope > article.item{i}") for i in range(5000)]
    rows = "".join(f"<section class='k{i} x'><div class=list><article class='item{i}'>a{i}</article><article class='item{i} z'>b{i}</article>"
                   f"<article class=other>c</article></div></section>" for i in (7, 4999))
    nodes = page_nodes(spark.createDataFrame([(1, BASE, rows)], "page_id long, url string, html string"))
    start = time.time()
    table = collections_table(spark, known)
    items = locate_items(nodes, table)
    fields = fields_table(spark, [Field("t", "T")], table)
    items._jdf.queryExecution().executedPlan()
    assert time.time() - start < 30
    assert sorted(tuple(r) for r in items.select("cid", "ord").collect()) == [("c4999", 1), ("c4999", 2), ("c7", 1), ("c7", 2)]
    assert fields.count() == 5000 and fields.where("cid = 'c7'").first()["id"] == "t"


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"{BASE}/{i}", f'<nav><ul><li><a href="/a/{i}">Entry {i}</a></li></ul></nav>') for i in range(6)], schemas.PAGE)
    events = spark.createDataFrame([(i, i % 3, "click") for i in range(6)], "event_id long, user_id long, event_type string")
    for folder, files in (("one", 1), ("many", 3)):
        for name, rows in (("pages", pages), ("events", events)):
            rows.repartition(files).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    for name in ("pages", "events"):  # a table that is a single file, beside others
        part = next((tmp_path / "one" / f"{name}.parquet").glob("part-*.parquet"))
        (tmp_path / "file").mkdir(exist_ok=True)
        (tmp_path / "file" / f"{name}.parquet").write_bytes(part.read_bytes())
    for folder in ("file", "one", "many"):
        records, keys = (QUERIES[q](spark, f"{tmp_path}/{folder}") for q in ("streamed_records", "streamed_keys"))
        assert sorted(r["label"] for r in records.collect()) == [f"Entry {i}" for i in range(6)]
        assert sorted(r["user_id"] for r in keys.collect()) == [0, 1, 2]
