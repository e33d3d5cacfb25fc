"""Nothing is cut: long lists, late fields, long texts; and values, patterns and locators that must come back as they were."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowharvest.fields import Field, Locator
from rowharvest.functions import values as V
from rowharvest.operators import detect, extract, infer, structure
from rowharvest.operators.locate import Collection, locate_items, locator_from_css
from rowharvest.operators.profile import evaluate_quality, profile_fields
from rowharvest.plans.apply import Plan, PlanField, apply_plan, apply_plans, attach_plans
from rowharvest.plans.validate import validate_plans
from rowharvest.session import materialize, scratch_path
from rowharvest.sinks import export
from rowharvest.sources.frames import stitch_frames
from rowharvest.sources.nodes import UNREAD, page_nodes

URL = "https://shop.example.test/p"


def nodes_of(spark, *htmls):
    rows = [(i, f"{URL}/{i}", h) for i, h in enumerate(htmls, 1)]
    return materialize(page_nodes(spark.createDataFrame(rows, "page_id long, url string, html string")), "nodes")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_late_containers_and_middle_templates(spark):
    filler = "<i></i>" * 30_000
    offers = "".join(f'<div class="offer"><b>Offer {i}</b><a href="/o/{i}">Go</a><p>Price 1{i}</p></div>' for i in range(4))
    lines = "".join(f'<p class="plain">line {i}</p>' for i in range(300))
    nodes = nodes_of(spark, f'<main><div id="far">{filler}</div><section id="list">{lines}{offers}{lines}</section></main>')
    profiles = structure.structural_profiles(nodes, structure.repeating_children(nodes))
    found = structure.cluster_children(profiles).join(nodes.select("page_id", "pre", "classes"), ["page_id", "pre"])
    sizes = {r["c"]: r["n"] for r in found.groupBy(F.get("classes", F.lit(0)).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert sizes["offer"] == 4 and sizes["plain"] == 600


def test_a_field_of_late_items_is_a_field(spark):
    items = "".join(f'<article class="card"><h2 class="label">Thing {i}</h2><p class="about">About thing number {i} at length</p>'
                    + (f'<span class="extra">Extra {i}</span>' if i > 16 else "") + "</article>" for i in range(60))
    nodes = nodes_of(spark, f'<section id="list">{items}</section>')
    members = nodes.where("tag = 'article'").select("page_id", F.lit("c").alias("cid"), "pre")
    fields = {r["name"] for r in infer.infer_schema(members, nodes).collect()}
    assert {"Title", "About", "Extra"} <= fields


def test_a_mark_the_parser_knows_not(spark):
    nodes = nodes_of(spark, "<p>before</p><![foo[x]]><p>after</p>", "<b>fine</b>", "<p>a<![CDATA[x]]>b</p>")
    assert {r["page_id"] for r in nodes.select("page_id").distinct().collect()} == {1, 2, 3}
    assert nodes.where("page_id = 1 and tag = 'p'").count() == 2
    assert nodes.where(F.map_contains_key("attrs", UNREAD)).count() == 0


def test_hidden_parts_stay_hidden_below_transparent_ones(spark):
    nodes = nodes_of(spark, '<div style="display:none"><p style="opacity:0"><b>x</b></p></div><div style="opacity:0"><i>y</i></div>')
    assert {r["tag"]: r["hidden"] for r in nodes.where("tag in ('b', 'i', 'p')").collect()} == {"b": True, "i": False, "p": True}


@pytest.mark.parametrize("value,text", [(0.12345678901234, "0.12345678901234"), (0.12345678901239, "0.12345678901239"), (1 / 3, "0.3333333333333333"),
                                        (1e-13, "0.0000000000001"), (12.0, "12"), (1234.5, "1234.5"), (1e21, "1" + "0" * 21), (-2.5e-7, "-0.00000025"),
                                        (0.0, "0"), (-0.0, "0"), (123456789012345680.0, "123456789012345680"), (1.5e10, "15000000000")])
def test_number_text(spark, value, text):
    assert one(spark, V.number_text(F.lit(value))) == text


def test_patterns_with_and_without_groups(spark):
    first = lambda text, pattern: one(spark, V.pattern_first(F.lit(text), pattern))
    assert first("call (555", r"[(]\d+") == "(555"
    assert first("in 2024 or", r"(?<y>\d{4})") == "2024" and first("in 2024 or", r"in (?<y>\d{4})") == "2024"
    assert first("Size: x", r"Size:(?: (\d))?") == "Size:" and first("Size: 4", r"Size:(?: (\d))?") == "4"
    assert first("a(b)c", r"\((b)\)") == "b" and first("x", "y") == ""
    assert one(spark, V.pattern_all(F.lit("a1 b2"), r"[a-z](\d)")) == ["1", "2"]
    fields = [Field("y", "Y", "text", (Locator.item(),), pattern=r"in (?<year>\d{4})"), Field("p", "P", "text", (Locator.item(),), pattern=r"[(]\d+"),
              Field("bad", "Bad", "text", (Locator.item(),), pattern="(?P<n>x"), Field("all", "All", "text", (Locator.item(),), pattern=r"\d", multiple=True)]
    nodes = nodes_of(spark, "<ul><li>in 2024 (55</li></ul>")
    items = nodes.where("tag = 'li'").select("page_id", F.lit("c").alias("cid"), F.col("pre").alias("item"), F.lit(1).alias("ord"))
    values = extract.extract_records(nodes, items, extract.fields_table(spark, fields, "c")).first()["values"]
    assert values["y"]["str"] == "2024" and values["p"]["str"] == "(55" and values["bad"]["str"] == "in 2024 (55"
    assert values["all"]["arr"] == list("202455")


@pytest.mark.parametrize("text,iso", [("January 5, 2024 10:30", "2024-01-05T10:30"), ("1/5/2024 10:00 AM", "2024-01-05T10:00"),
                                      ("Mon Jan 05 2024 10:00:00 GMT+0000", "2024-01-05T10:00"), ("2024", "2024-01-01T00:00"),
                                      ("Mar 3, 2024, 4:05 PM", "2024-03-03T16:05"), ("2024-02-01 09:15", "2024-02-01T09:15")])
def test_dates_with_times(spark, text, iso):
    assert one(spark, V.parse_date(F.lit(text))).startswith(iso)


def test_plans_read_wide_signs_and_whole_texts(spark):
    long = "x" * 30_000 + " mail me at a@b.example"
    rows = spark.createDataFrame([(1, "１２３", "Ｃａｆé"), (2, "4", long)], "seq long, number string, text string")
    fields = [Field("number", "Number"), Field("text", "Text")]
    plan = Plan((PlanField("N", "number", ("number",)), PlanField("T", "text", ("text",)), PlanField("Both", "text", ("number", "text"), "concat"),
                 PlanField("M", "email", ("text",), "regex", r"([a-z]+@[a-z.]+)"), PlanField("All", "text", ("text",), "regex", r"([Ｃa-z]@)", True)))
    out, made = apply_plan(rows, plan, fields, [], "seq")
    got = {r["seq"]: [r[f.id] for f in made] for r in out.collect()}
    assert got[1][:3] == [123.0, "Café", "123 | Café"] and got[2][1] == long and got[2][3] == "a@b.example" and len(got[2][2]) == len(long) + 4
    maps = extract.from_wide(rows.withColumn("s", F.lit("s")), fields, ("s", "seq"))
    body = plan.to_json()
    checked = validate_plans(spark.createDataFrame([("p", "s", body)], "plan_id string, s string, plan_json string"),
                             spark.createDataFrame([("s", "number"), ("s", "text")], "s string, id string"), ["s"])
    done = {r["seq"]: r["values"] for r in apply_plans(maps, checked, ["s"], "seq").collect()}
    assert done[1]["N"]["num"] == 123.0 and done[1]["T"]["str"] == "Café" and done[2]["M"]["str"] == "a@b.example"


def test_plan_names_are_compared_in_one_form(spark):
    def plan(*names):
        return Plan(tuple(PlanField(n, "text", ("a",)) for n in names)).to_json()

    rows = [("twice", "s", plan("Name", "Ｎame")), ("unsafe", "s", plan("ｃonstructor")), ("fine", "s", plan("Name", "Other")), ("broken", "s", "{")]
    plans = spark.createDataFrame(rows, "plan_id string, s string, plan_json string")
    profiles = spark.createDataFrame([("s", "a")], "s string, id string")
    got = {r["plan_id"]: (r["plan_ok"], r["reasons"]) for r in validate_plans(plans, profiles, ["s"]).collect()}
    assert got["fine"][0] and "duplicate field names" in got["twice"][1] and "unsafe field name" in got["unsafe"][1] and not got["broken"][0]
    now = dt.datetime(2024, 1, 2)
    cache = plans.select(F.col("plan_id").alias("plan_key"), "plan_json", F.lit(dt.datetime(2024, 1, 1)).alias("created_at"))
    keyed = spark.createDataFrame([(n, "s") for n in ("twice", "fine", "none")], "plan_key string, s string")
    hits = {r["plan_key"]: r["cache_hit"] for r in attach_plans(keyed, cache, now, profiles=profiles, on=["s"]).collect()}
    assert hits == {"twice": False, "fine": True, "none": False}


@pytest.mark.parametrize("classes,ident", [("md:flex w-1/2", ""), ("", "a.b"), ("", "9lives"), ("1st", ""), ("plain", "x y>z")])
def test_written_locators_are_read_back(spark, classes, ident):
    # (an id with a space is one id)
    rows = "".join(f'<div class="{classes}" role="x > y"><b>Row {i}</b><i>More of row {i}</i></div>' for i in range(5))
    nodes = nodes_of(spark, f'<main><section id="{ident}">{rows}</section></main>')
    candidates, _, items = detect.detect_collections(nodes)
    best = candidates.where("item_tag = 'div'").first()
    again = locate_items(nodes, [Collection("c", best["container_css"], best["item_css"])])
    assert again.count() == 5 == items.where(F.col("cid") == best["cid"]).count()


def test_selectors_with_signs():
    assert locator_from_css(r":scope > div.md\:flex").classes == ("md:flex",)
    assert locator_from_css(':scope > [role="x > y"]').val == "x > y"
    assert locator_from_css(r"#a\.b").elem_id == "a.b" and locator_from_css(r"#\39 lives").elem_id == "9lives"


def test_frames_in_frames_to_the_end(spark):
    rows = [(i, f"{URL}/{i}", f'<p>level {i}</p><iframe src="{URL}/{i + 1 if i < 6 else 1}"></iframe>') for i in range(1, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = materialize(page_nodes(pages), "nodes")
    stitched = materialize(stitch_frames(nodes, pages), "stitched")
    assert {r["page_id"]: r["n"] for r in stitched.where("tag = 'p'").groupBy("page_id").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(1, 7), 6)
    deep = stitched.where("page_id = 1 and tag = 'p'").orderBy(F.desc("pre")).limit(1)
    assert structure.node_paths(stitched, deep).first()["css"].count(" >>>FRAME>>> ") == 5


def test_profiles_and_issues_cover_everything(spark):
    rows = spark.range(5000).select(F.lit("s").alias("s"), "id", F.when(F.col("id") == 4999, "only").alias("rare"), F.format_string("v%d", F.col("id") % 100).alias("v"))
    got = {r["id"]: r for r in profile_fields(rows, [Field("rare", "Rare"), Field("v", "V")], ["s"], "id").collect()}
    assert got["rare"]["coverage"] == 1 / 5000 and got["rare"]["samples"] == ["only"]
    assert got["v"]["samples"] == ["v0", "v1", "v2"] and got["v"]["unique_ratio"] == 100 / 5000
    emptied = evaluate_quality(rows.where("id < 0"), [Field("v", "V")], ["s"], expected=rows.select("s"))
    assert [(r["s"], r["issue"]) for r in emptied.collect()] == [("s", "no record is left")]


def test_exports_of_any_size_in_order(spark, tmp_path):
    import json

    fields = [Field("name", "Name"), Field("n", "N", "number")]
    rows = spark.range(120_000).select((120_000 - F.col("id")).alias("seq"), F.concat(F.lit("r"), "id").alias("name"), F.col("id").cast("double").alias("n"))
    export.write_json(rows, fields, str(tmp_path / "j"), "seq")
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    got = json.loads(text)
    assert len(got) == 120_000 and got[0]["Name"] == "r119999" and got[-1] == {"Name": "r0", "N": 0}
    export.write_csv(rows, fields, str(tmp_path / "c"), single_file=True, order="seq")
    (part,) = (tmp_path / "c").glob("part-*")
    lines = part.read_bytes().decode("utf-8-sig").split("\r\n")
    assert lines[0] == '"Name","N"' and lines[1] == '"r119999","119999"' and len(lines) == 120_002
    export.write_json(rows.limit(0), fields, str(tmp_path / "e"), "seq")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))) == []
    export.write_csv(rows.limit(0), fields, str(tmp_path / "h"))
    assert "".join(p.read_text() for p in (tmp_path / "h").glob("part-*")).strip() == '"Name","N"'


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
