import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rowharvest.fields import Field
from rowharvest.operators.extract import from_wide
from rowharvest.operators.profile import evaluate_quality, profile_fields
from rowharvest.plans import validate
from rowharvest.plans.apply import Plan, PlanField, apply_plan, apply_plans, attach_plans, choose_plan, plan_keys

FIELDS = [Field("advertiser", "Advertiser Name"), Field("description", "Description 2"), Field("noisy", "Library ID")]
PLAN = Plan((PlanField("Advertiser", "text", ("advertiser",), reason="Entity", confidence=0.98),
             PlanField("Library ID", "text", ("noisy",), "regex", r"Library\s+ID:\s*(\d+)", confidence=0.99),
             PlanField("Ad Text", "text", ("description",), confidence=0.95)),
            ("Library ID",), ("noisy",), "Advertisements", "Removed duplicates.")


@pytest.fixture(scope="module")
def wide(spark):
    data = [("s", i, name, "Become our partner. Call +91 99999 11111",
             f"Active | Library ID: {lib} | Sponsored") for i, (lib, name) in
            enumerate([("100", "Fine Ply"), ("100", "Fine Ply"), ("200", "Other")], 1)]
    return spark.createDataFrame(data, "session_id string, seq long, advertiser string, description string, noisy string")


def test_safe_patterns(spark):
    good = [r"Library\s+ID:\s*(\d+)", r"(\w{2,5})", r"[a-z?*]+([^)]+)", r"\((\d{1,200})\)", r"(a)b+c+", r"(\u20ac)"]
    bad = ["(a+)+$", "(a|aa)+$", "(?:a{1,3})+$", "(a?a?a?a?)", "(a*a*a*)", "(a{0,10})", "", "x" * 161, "abc", "(a)(b)",
           r"(a)\1", "(a.*)", "(a{5,2})", "(a{1,201})", "(a", "a)(b", "(a++)", "(+a)", "([a)", r"(a\q)", "([z-a])",
           "(a+b+c+d+e+f+g+h+i+)", "(a{2", "(a)\\"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string")
    got = {r.p: r.ok for r in df.select("p", validate.safe_pattern(F.col("p")).alias("ok")).collect()}
    assert [p for p in good if not got[p]] == [] and [p for p in bad if got[p]] == []


def test_apply_plan_and_quality(wide):
    cleaned, fields = apply_plan(wide, PLAN, FIELDS, ["session_id"], "seq")
    lib = next(f.id for f in fields if f.name == "Library ID")
    assert [(r.seq, r[lib]) for r in cleaned.orderBy("seq").collect()] == [(1, "100"), (3, "200")]
    twice = Plan((PLAN.fields[0], PlanField("Advertiser Copy", "text", ("advertiser",))))
    copies, copy_fields = apply_plan(wide, twice, FIELDS, ["session_id"], "seq", ["session_id"])
    issues = evaluate_quality(copies, copy_fields, ["session_id"]).collect()
    assert [i.issue for i in issues] == ["Advertiser = Advertiser Copy: nearly all values are equal"]
    one = Plan((PLAN.fields[0],))
    fixed = apply_plan(wide, one, FIELDS, ["session_id"], "seq", ["session_id"])
    assert choose_plan((copies, copy_fields), fixed, ["session_id"]).first()["chosen"] == "corrected"
    assert choose_plan(fixed, (copies, copy_fields), ["session_id"]).first()["chosen"] == "first"


def test_plans_over_records_without_values(spark):
    plan = F.struct(
        F.lit("Parts").alias("recordType"),
        F.array(F.struct(F.lit("Name").alias("name"), F.lit("text").alias("type"), F.array(F.lit("a")).alias("sources"), F.lit("copy").alias("operation"),
                         F.lit("").alias("pattern"), F.lit(False).alias("multiple"), F.lit("").alias("reason"), F.lit(1.0).alias("confidence"))).alias("fields"),
        F.array().cast("array<string>").alias("droppedSources"), F.array().cast("array<string>").alias("deduplicateBy"), F.lit("").alias("summary"))
    plans = spark.range(1).select(F.lit("s").alias("session_id"), plan.alias("plan"))
    rows = from_wide(spark.createDataFrame([("s", 1, "x"), ("s", 2, "x"), ("s", 3, None)], "session_id string, seq long, a string"), [Field("a", "A")],
                     ("session_id", "seq")).withColumn("original_values", F.lit(1)).withColumn("fingerprint", F.lit(""))
    bare = rows.withColumn("values", F.map_filter("values", lambda k, v: F.lit(False))).withColumn("seq", F.col("seq") + 10)
    missing = rows.withColumn("values", F.lit(None).cast(dict(rows.dtypes)["values"])).withColumn("seq", F.col("seq") + 20)
    got = apply_plans(rows.unionByName(bare).unionByName(missing), plans, ["session_id"], "seq").collect()
    assert [(r.seq, r["values"]["Name"]["str"]) for r in got] == [(1, "x")]


def test_operations(spark):
    df = spark.createDataFrame([(1, "", "b ", 3.0, ["x", "y"], "1.234,50", "3 Jan 2024", "a1 B2 a1"), (2, None, "", None, None, "", "", "")],
                               "seq long, a string, b string, n double, t array<string>, p string, d string, r string")
    fields = [Field("a", "A"), Field("b", "B"), Field("n", "N", "number"), Field("t", "T", multiple=True), Field("p", "P"),
              Field("d", "D"), Field("r", "R")]
    plan = Plan((
        PlanField("First", "text", ("a", "b"), "first_nonempty"), PlanField("Join", "text", ("b", "n", "t"), "concat"),
        PlanField("Price", "price", ("p",)), PlanField("Day", "date", ("d",)),
        PlanField("Codes", "text", ("r",), "regex", r"([a-z]\d)", True), PlanField("Code", "text", ("r",), "regex", r"(b\d)"),
        PlanField("None", "text", ("r",), "regex", r"(z\d)")))
    cleaned, out = apply_plan(df, plan, fields, [], "seq")
    rows = cleaned.collect()
    assert len(rows) == 1
    got = {f.name: rows[0][f.id] for f in out}
    assert got == {"First": "b", "Join": "b | 3 | x | y", "Price": 1234.5, "Day": "2024-01-03T00:00:00.000Z",
                   "Codes": ["a1", "B2"], "Code": "B2", "None": None}
    maps = from_wide(df.withColumn("session_id", F.lit("s")), fields, ("session_id", "seq"))
    table = spark.createDataFrame([("s", plan.to_json())], "session_id string, plan_json string")
    parsed = validate.parse_plans(table).select("session_id", "plan")
    row = apply_plans(maps, parsed, ["session_id"], "seq").collect()
    assert len(row) == 1
    values = {k: v.str if v.str is not None else v.num if v.num is not None else v.arr for k, v in row[0]["values"].items()}
    assert values == got


def test_validation(spark):
    base = json.loads(PLAN.to_json())

    def changed(**kw):
        return {**base, **kw}

    def field(**kw):
        return {**base["fields"][0], **kw}

    cases = {
        "good": base, "null": None, "no fields": changed(fields=[]), "not a list": changed(fields="x"),
        "same names": changed(fields=[field(name="Product"), field(name=" product ")], deduplicateBy=[]),
        "html": changed(fields=[field(type="html")], deduplicateBy=[]), "eval": changed(fields=[field(operation="eval")], deduplicateBy=[]),
        "pattern": changed(fields=[field(pattern="unexpected")], deduplicateBy=[]),
        "confidence": changed(fields=[field(confidence=1.5)], deduplicateBy=[]),
        "text confidence": changed(fields=[field(confidence="1")], deduplicateBy=[]),
        "dropped": changed(droppedSources=["not-supplied"]), "dedupe": changed(deduplicateBy=["not-an-output"]),
        "invented": changed(fields=[field(sources=["invented"])], deduplicateBy=[]),
        "constructor": changed(fields=[field(name="constructor")], deduplicateBy=[]),
        "unsafe": changed(fields=[{**base["fields"][1], "pattern": "(a+)+$"}], deduplicateBy=[]),
        "number type": changed(recordType=5), "many": changed(fields=[field(name=f"f{i}") for i in range(31)], deduplicateBy=[]),
        "sources": changed(fields=[field(sources=["noisy"] * 9)], deduplicateBy=[]),
        "good dedupe": changed(deduplicateBy=[" library  id "]), "missing": {k: v for k, v in base.items() if k != "summary"},
        "good long": changed(summary="s " * 400, recordType=" "),
    }
    plans = spark.createDataFrame([(k, "s", json.dumps(v)) for k, v in cases.items()] + [("broken", "s", "{"), ("foreign", "t", json.dumps(base))],
                                  "plan_id string, session_id string, plan_json string")
    profiles = spark.createDataFrame([("s", f.id) for f in FIELDS], "session_id string, id string")
    got = {r.plan_id: r for r in validate.validate_plans(plans, profiles, ["session_id"]).collect()}
    assert {k for k, r in got.items() if r.plan_ok} == {"good", "good dedupe", "good long"}
    assert len(got["good long"].plan.summary) == 500 and got["good long"].plan.recordType == "records"
    assert got["invented"].reasons == ["unknown source"] and got["same names"].reasons == ["duplicate field names"]


def test_leaks_keys_and_reuse(spark, wide):
    profiles = profile_fields(wide, FIELDS, ["session_id"], "seq")
    leak = json.loads(PLAN.to_json())
    leak["fields"][1]["pattern"] = r"call \+91 (99999) sponsored"
    named = json.loads(PLAN.to_json())
    named["fields"][2]["name"] = "Sponsored text"
    named["deduplicateBy"] = ["sponsored TEXT"]
    plans = spark.createDataFrame([("a", "s", PLAN.to_json()), ("b", "s", json.dumps(leak)), ("c", "s", json.dumps(named))],
                                  "plan_id string, session_id string, plan_json string")
    safe = {r.plan_id: r for r in validate.cache_safe_plans(validate.parse_plans(plans), profiles, ["session_id"]).collect()}
    assert (safe["a"].leaks, safe["b"].leaks) == (False, True) and safe["b"].plan is None
    assert safe["a"].plan.recordType == validate.CACHED_TYPE and {f.reason for f in safe["a"].plan.fields} == {validate.CACHED_REASON}
    assert safe["c"].plan.fields[2].name == "Field 3" and safe["c"].plan.deduplicateBy == ["Field 3"]
    sessions = spark.createDataFrame([("s", "h.test", "m", " keep  it ")], "session_id string, host string, model string, instruction string")
    keys = plan_keys(profiles, sessions, ["session_id"])
    base = keys.first()["plan_key"]

    def key(**kw):
        return plan_keys(profiles, sessions.withColumns({k: F.lit(v) for k, v in kw.items()}), ["session_id"]).first()["plan_key"]

    assert key(instruction="keep it") == base and len({base, key(host="o.test"), key(model="n"), key(instruction="x")}) == 4
    now = dt.datetime(2025, 6, 1)
    cache = spark.createDataFrame([(base, "{}", now - dt.timedelta(days=29)), (base, "{old}", now - dt.timedelta(days=40))],
                                  "plan_key string, plan_json string, created_at timestamp")
    assert attach_plans(keys, cache, now).first()["plan_json"] == "{}"
    assert not attach_plans(keys, cache, now + dt.timedelta(days=2)).first()["cache_hit"]
