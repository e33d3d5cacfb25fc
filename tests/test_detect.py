from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rowharvest.fields import Field, Locator
from rowharvest.operators import detect, extract, infer, structure
from rowharvest.session import materialize, trim_driver
from rowharvest.sources.nodes import page_nodes, text_of
from tests.pages import BASE, ID, pages_frame


@pytest.fixture(scope="module")
def nodes(spark):
    return materialize(page_nodes(pages_frame(spark)), "nodes")


@pytest.fixture(scope="module")
def found(nodes):
    candidates, fields, items = detect.detect_collections(nodes)
    return candidates, materialize(fields, "fields"), materialize(items, "items")


@pytest.fixture(scope="module")
def schema(found):
    """page name -> {candidate item_css: {field name: row}}"""
    out = {}
    names = {v: k for k, v in ID.items()}
    tops = {(r.page_id, r.cid): r for r in found[0].collect()}
    for f in found[1].collect():
        top = tops[f.page_id, f.cid]
        out.setdefault(names[f.page_id], {}).setdefault((top["rank"], top.item_css), {})[f.name] = f
    return out


def top(found, page):
    return found[0].where(F.col("page_id") == ID[page]).orderBy("rank").first()


def test_cards(found, schema):
    best = top(found, "cards")
    assert best.item_count == 8 and best.score > 40 and "items shown" in best.explanation
    assert best.item_css == ":scope > article.tile.product" and best.container_css == "#grid"
    fields = schema["cards"][1, best.item_css]
    assert any(f.type == "price" for f in fields.values())
    assert {"Title", "About", "Price"} <= set(fields)


def test_table_headers(found, schema):
    best = top(found, "table")
    fields = sorted(schema["table"][1, best.item_css].values(), key=lambda f: f.field_no)
    assert [f.name for f in fields] == ["Berth", "Agent Mail", "Agent Line", "Agent Town", "Fee per night"]
    assert [f.type for f in fields] == ["text", "email", "phone", "text", "price"]
    assert best.item_count == 3 and fields[0].required and not fields[1].required


def test_heterogeneous_cards(nodes, found, schema):
    best = next(r for r in found[0].where(F.col("page_id") == ID["ads"]).collect() if r.item_count == 6)
    fields = schema["ads"][best["rank"], best.item_css]
    assert "Library ID" in fields and any(f.type == "image" for f in fields.values())
    assert fields["Link Text"].type == "text" and fields["URL"].type == "url"


def test_union_schema(schema):
    fields = next(iter(schema["market"].values()))
    assert {"Product Name", "Product URL", "Price", "Supplier", "Location", "Minimum Order"} <= set(fields)
    assert fields["Price"].pattern and fields["Product Name"].type == "text"


def test_shadow_and_large(found):
    best = top(found, "shadow")
    assert best.item_count == 6 and best.container_css.startswith("html > body > main > goods-grid >>> ") or ">>>" in best.container_css
    big = top(found, "large")
    assert big.item_count == 2000 and big.container_css == "#ledger"


def test_records_of_detected_collections(nodes, found):
    records = extract.extract_records(nodes, found[2], found[1])
    rows = records.where(F.col("page_id").isin(ID["large"], ID["cards"], ID["table"])).collect()
    assert sum(r.page_id == ID["large"] for r in rows) == 2000
    cards = [r for r in rows if r.page_id == ID["cards"]]
    assert len(cards) == 8 and all(not r.incomplete for r in cards)
    prices = {v.num for r in cards for v in r["values"].values() if v.num is not None}
    assert prices == {i + 10.5 for i in range(8)}
    urls = {v.str for r in cards for v in r["values"].values() if v.str and v.str.startswith(BASE + "/goods/")}
    assert len(urls) == 8


def test_declared_fields(spark, nodes):
    fields = [
        Field("name", "Name", "text", (Locator.by_class("b", "missing"), Locator.by_class("h2", "label")), required=True),
        Field("place", "Place", "text", (Locator.by_class("i", "place"),)),
        Field("digits", "Digits", "text", pattern=r"(\d{3})", multiple=True),
        Field("first", "First", "text", pattern=r"(\d{3,4})"),
    ]
    items = nodes.where((F.col("page_id") == ID["duplicates"]) & (F.col("tag") == "li")).select(
        "page_id", F.lit("c").alias("cid"), F.col("pre").alias("item"), F.col("child_idx").alias("ord"))
    rows = extract.extract_records(nodes, items, extract.fields_table(spark, fields, "c")).orderBy("ord").collect()
    assert [r["values"]["name"].str for r in rows] == ["Kestrel", "Heron", "Kestrel", None]
    assert [r.incomplete for r in rows] == [False, False, False, True]
    assert rows[0].fingerprint == rows[2].fingerprint != rows[1].fingerprint
    assert rows[0]["values"]["digits"].arr == ["204", "204"] and rows[0]["values"]["first"].str == "204"
    assert rows[1]["values"]["digits"].arr == ["310"] and rows[1]["values"]["first"].str == "3101"
    assert rows[3]["values"]["digits"].arr == [] and rows[3]["values"]["first"].str is None
    assert rows[0].source_url == BASE + "/duplicates"


def test_private_values(spark, nodes):
    fields = [
        Field("secret", "Secret", "attribute", (Locator.by_class("input", "secret"),), attribute="value"),
        Field("token", "Token", "attribute", (Locator.by_class("b", "k"),), attribute="data-auth-token"),
        Field("html", "HTML", "html", (Locator.by_class("div", "markup"),)),
    ]
    items = nodes.where((F.col("page_id") == ID["private"]) & (F.col("tag") == "article")).select(
        "page_id", F.lit("c").alias("cid"), F.col("pre").alias("item"), F.lit(1).alias("ord"))
    row = extract.extract_records(nodes, items, extract.fields_table(spark, fields, "c"), with_html=True).first()
    assert row["values"]["secret"].str is None and row["values"]["token"].str is None
    assert row["values"]["html"].str == 'lead <span>Public</span> mid <b class="k">Label &amp; x</b> tail<br>'


def test_point_select(nodes):
    chosen = nodes.where((F.col("page_id") == ID["cards"]) & (F.col("tag") == "span") & (F.col("nth") == 1)).groupBy(
        "page_id").agg(F.min("pre").alias("pre"))
    candidates, fields, items = detect.candidate_from_element(nodes, chosen)
    row = candidates.first()
    assert row.item_count == 8 and row.score >= 60 and row.item_css == ":scope > article.tile.product"
    picked = detect.field_from_node(nodes, items, chosen.withColumn("field_id", F.lit("f"))).first()
    assert picked.type == "price" and picked.css == "span"


def test_signature_ignores_volatile_classes(spark):
    html = ('<div><article class="tile active css-abc123"><i></i></article>'
            '<article class="tile selected css-def456"><i></i></article></div>')
    n = page_nodes(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string"))
    p = structure.structural_profiles(n, n.where("tag = 'article'"))
    assert {r.s for r in p.select(structure.structural_signature().alias("s")).collect()} == {"article||tile|i"}


def test_text_of_nested(spark):
    html = "<div>a<b>b<i>c</i>d</b>e<!-- x --><p>f &amp; g</p>ﬁ</div>"
    n = page_nodes(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string"))
    rows = {r.pre: r for r in text_of(n, n).collect()}
    by_tag = {r.tag: rows[r.pre] for r in n.collect()}
    assert by_tag["div"].text == "abcdef & gfi" and by_tag["div"].raw_text == "abcdef & gﬁ"
    assert by_tag["b"].text == "bcd" and by_tag["p"].text == "f & g"


def nested(depth):
    return "<section>" * depth + "<p class=a>x</p><p>y</p>" + "</section>" * depth


def shape(nodes):
    """Descendants, links and tags below every element, element by element."""
    rows = {r.pre: r for r in nodes.collect()}
    out = {}
    for pre, row in rows.items():
        below = [rows[p] for p in range(pre + 1, row["last"] + 1)]
        tags = {}
        for r in below:
            tags[r.tag] = tags.get(r.tag, 0) + 1
        out[pre] = (len(below), sum(r.tag == "a" and "href" in r.attrs for r in below), tags, any(r.tag == "time" for r in below))
    return out


@pytest.mark.parametrize("html", [nested(30), "<div><a href=x>1<a>2</div><div><div><time>3</time><a href=y><div><a href=z></a></div></a></div><time>4</div><div></div>"])
def test_profiles_equal_counts_element_by_element(spark, html):
    n = materialize(page_nodes(spark.createDataFrame([(1, BASE, html), (2, BASE, "<p>other</p>")], "page_id long, url string, html string")), "n")
    one = n.where("page_id = 1")
    got = {r.pre: (r.element_count, r.links, r.histogram, r.has_cue) for r in structure.structural_profiles(n, one.select("page_id", "pre")).collect()}
    assert got == shape(one)


def test_thousands_of_nested_elements_are_few_rows(spark):
    n = materialize(page_nodes(spark.createDataFrame([(1, BASE, nested(4000))], "page_id long, url string, html string")), "n")
    profiles = structure.structural_profiles(n, n.where("tag = 'section'"))
    assert profiles.where("pre < 10").agg(F.sum("element_count")).first()[0] > 4 * 3900
    assert profiles.count() == 4000


def test_a_container_of_very_many_kinds_elects_in_rounds(spark):
    kinds = [(1, i, 0, i, "li", "", [f"t{i}"], {f"t{i}": 40 + i}, 40 + i, 5, 0, 0, 0, 0) for i in range(60) for _ in range(1)]
    more = [(1, 60 + i, 0, 60 + i, "li", "", ["b"], {"b": 1}, 1, 5 + i % 2, 0, 0, 0, 0) for i in range(5)]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], *r[4:]) for r in kinds + more],
                               "page_id long, pre int, parent int, child_idx int, tag string, role string, direct_tags array<string>, histogram map<string,int>, "
                               "element_count int, text_length int, links int, images int, media int, semantic int")
    whole = {tuple(r) for r in structure.cluster_children(df).collect()}
    assert {tuple(r) for r in structure.cluster_children(df, block=7).collect()} == whole and len({r[2] for r in whole}) >= 1


def passing(rows, css):
    """Elements of one tree that pass a written child chain, step by step."""
    import re

    by = {r.pre: r for r in rows}

    def step_ok(r, step):
        tag, classes, nth = re.fullmatch(r"([a-z]+)((?:\.[\w-]+)*)(?::nth-of-type\((\d+)\))?", step).groups()
        return r.tag == tag and set(classes.split(".")[1:]) <= set(r.classes) and (nth is None or r.nth == int(nth))

    def ok(r):
        for step in reversed(css.split(" > ")):
            if r is None or not step_ok(r, step):
                return False
            r = by.get(r.parent)
        return True

    return [r.pre for r in rows if ok(r)]


def test_written_paths_lead_to_one_element(spark):
    html = ('<main><ul class="menu top"><li class=a>1<li class="a b">2<li class=selected>3</ul><ul class=menu><li class="b a">4<li>5<li><p>6<p class=z>7</ul>'
            '<div><div><div><p>8</p></div></div></div><div><div><div><p>9</p></div></div></div><section id=s><p>10</p></section></main>')
    n = materialize(page_nodes(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")), "n")
    rows = n.collect()
    got = {r.pre: r.css for r in structure.node_paths(n, n.where("depth > 0")).collect()}
    by = {r.pre: r for r in rows}
    for pre, css in got.items():
        if css.startswith("#"):
            assert by[pre].id == css[1:]
        else:
            assert passing(rows, css) == [pre], css
            if " > " in css:  # no shorter tail would do
                assert len(passing(rows, css.split(" > ", 1)[1])) > 1, css
    assert got[next(r.pre for r in rows if r.classes == ["menu", "top"])] == "ul.menu.top"
    assert len(got) == len(rows) - 1


def test_choosing_every_item_of_a_list_is_one_collection(spark):
    html = "<ul>" + "".join(f"<li><b>item {i}</b><i>{'x' * (i % 7)}</i></li>" for i in range(300)) + "</ul><p>alone</p>"
    n = materialize(page_nodes(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")), "n")
    members, _ = detect.nearest_likes(n, n.where("tag in ('b', 'p')").select("page_id", "pre"))
    lists = n.where("tag = 'ul'").first()["pre"]
    got = members.where(F.col("container") == lists)
    assert got.select("pre").distinct().count() == 300 and got.count() <= 300 * got.select("cluster").distinct().count()
    assert got.select("cluster").distinct().count() < 20


def test_markup_leaves_hidden_parts_out_at_any_depth(spark):
    html = ("<div hidden><p>in <b>hidden</b></p><p hidden>twice</p> tail</div><div id=t>a<script>s()</script><p onclick=x title='q\"'>b<i aria-hidden=true>c<u>d</u></i>e"
            "<br>f</p><template>g</template>h<section><div hidden>i<p>j</p></div>k</section></div>")
    n = materialize(page_nodes(spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")), "n")
    got = {r.tag + (r.id or "") + str(r.pre): r.html for r in extract.safe_html(n, n.where("tag in ('div', 'p')").select("page_id", "pre")).join(
        n.select("page_id", "pre", "tag", "id"), ["page_id", "pre"]).collect()}
    whole = next(v for k, v in got.items() if k.startswith("divt"))
    assert whole == 'a<p title="q&quot;">b' + 'e<br>f</p>h<section>k</section>'
    assert sorted(got.values())[0:1] == [" tail"] or "<p>in <b>hidden</b></p> tail" in got.values()
    assert "in <b>hidden</b>" in got.values()  # a chosen element inside a hidden one is read by itself


def test_plans_of_detection_stay_small(spark, monkeypatch):
    sizes, write = [], DataFrameWriter.parquet

    def noted(writer, path, *args, **options):
        sizes.append(writer._df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    card = '<article class="card"><h2 class="label">Item {0}</h2><p>Some words</p><a href="/x/{0}">More {0}</a></article>'
    page = f"<main><section>{''.join(card.format(i) for i in range(6))}</section><table><thead><tr><th>A<th>B</thead><tbody>{'<tr><td>1<td>2' * 4}</table></main>"
    small = materialize(page_nodes(spark.createDataFrame([(1, BASE, page)], "page_id long, url string, html string")), "nodes")
    _, fields, items = detect.detect_collections(small)
    assert materialize(extract.extract_records(small, items, fields), "records").count() == 14  # cards, body rows, and the rows as children of their body
    assert max(sizes) < 200  # 822 nodes in one plan filled the driver's heap with versions of it


def test_the_driver_is_trimmed_when_its_heap_has_grown():
    calls = []

    def driver(total):
        runtime = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 100)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))
        return SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang), System=SimpleNamespace(gc=lambda: calls.append(total))))

    for total in (20, 50, 51, 100):
        trim_driver(driver(total))
    assert calls == [51, 100]
