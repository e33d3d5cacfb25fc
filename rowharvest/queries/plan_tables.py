"""Queries over cleanup plans: running, checking, reusing and choosing them."""

import datetime as dt

from pyspark.sql import functions as F

from rowharvest.fields import Field
from rowharvest.functions import values as V
from rowharvest.operators.extract import from_wide
from rowharvest.operators.profile import profile_fields
from rowharvest.plans import validate
from rowharvest.plans.apply import Plan, PlanField, apply_plan, apply_plans, attach_plans, choose_plan, plan_keys
from rowharvest.queries import heavy_table, query, table
from rowharvest.queries.value_tables import COLLAPSED

CUSTOMER = [Field("c_name", "Name"), Field("c_mktsegment", "Segment"), Field("c_acctbal", "Balance", "number"),
            Field("c_custkey", "Key", "number")]
_BAL = r"regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', '')"


@query(f"""SELECT c_custkey AS id, c_name AS "Customer", c_acctbal AS "Balance", c_mktsegment || ' | ' || c_name || ' | ' || {_BAL} AS "All",
  CAST(regexp_extract(c_name, '#(\\d+)', 1) AS DOUBLE) AS "Number", c_mktsegment AS "First",
  array_to_string(list_distinct(regexp_extract_all(c_name || ' \n ' || c_mktsegment, '([a-f0])', 1, 'i')), '') AS "Letters" FROM customer""".replace(
    "list_distinct(regexp_extract_all(c_name || ' \n ' || c_mktsegment, '([a-f0])', 1, 'i'))",
    "[x FOR x, i IN regexp_extract_all(c_name || c_mktsegment, '([a-f0])', 1, 'i') IF list_position(regexp_extract_all(c_name || c_mktsegment, '([a-f0])', 1, 'i'), x) = i]"))
def planned_customers(spark, sf_dir):
    """All four operations: copy, first non-empty, concatenation, patterns with one and many results."""
    plan = Plan((
        PlanField("Customer", "text", ("c_name",)), PlanField("Balance", "price", ("c_acctbal",)),
        PlanField("All", "text", ("c_mktsegment", "c_name", "c_acctbal"), "concat"),
        PlanField("Number", "number", ("c_name",), "regex", r"#(\d+)"),
        PlanField("First", "text", ("missing", "c_mktsegment", "c_name"), "first_nonempty"),
        PlanField("Letters", "text", ("c_name", "c_mktsegment"), "regex", r"([a-f0])", True)))
    df = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")).withColumn("c_custkey", F.col("c_custkey").cast("double"))
    out, fields = apply_plan(df, plan, CUSTOMER, ["id"], "id")
    return out.select("id", *[(F.array_join(F.col(f.id), "") if f.name == "Letters" else F.col(f.id)).alias(f.name) for f in fields])


_WHOLE = "(text || ' \n ' || source)"


@query(f"""SELECT doc_id, {COLLAPSED.format("(text || ' | ' || source || ' | ' || lang)")} AS joined,
  nullif(regexp_extract({_WHOLE}, '([A-Z0-9._%+-]+@[A-Z0-9.-]+)', 1, 'i'), '') AS mail,
  {COLLAPSED.format("text")} AS whole FROM documents
  QUALIFY row_number() OVER (PARTITION BY {COLLAPSED.format("text")} ORDER BY doc_id) = 1""")
def planned_documents(spark, sf_dir):
    fields = [Field("text", "Text"), Field("source", "Source"), Field("lang", "Language")]
    plan = Plan((PlanField("joined", "text", ("text", "source", "lang"), "concat"),
                 PlanField("mail", "email", ("text", "source"), "regex", r"([A-Z0-9._%+-]+@[A-Z0-9.-]+)"),
                 PlanField("whole", "text", ("text",))), ("Whole",))
    out, made = apply_plan(heavy_table(spark, sf_dir, "documents"), plan, fields, ["doc_id"], "doc_id")
    return out.select("doc_id", *[F.col(f.id).alias(f.name) for f in made])


@query("""SELECT o_orderkey, o_custkey AS customer, o_orderpriority AS priority FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def planned_orders(spark, sf_dir):
    fields = [Field("o_custkey", "Customer", "number"), Field("o_orderpriority", "Priority")]
    plan = Plan((PlanField("customer", "number", ("o_custkey",)), PlanField("priority", "text", ("o_orderpriority",))), ("customer",))
    df = table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    out, made = apply_plan(df, plan, fields, ["o_orderkey"], "o_orderkey")
    return out.select("o_orderkey", F.col(made[0].id).cast("long").alias("customer"), F.col(made[1].id).alias("priority"))


@query("""SELECT c_nationkey AS session_id, min(c_custkey) AS seq, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' | ' || c_nationkey END AS kind
  FROM customer GROUP BY c_nationkey, c_mktsegment""")
def planned_sessions(spark, sf_dir):
    """One plan per nation, built from the nations themselves; all sessions are cleaned in one job."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    even = F.col("n_nationkey") % 2 == 0
    body = F.concat(
        F.lit('{"recordType":'), V.json_text(F.col("n_name")), F.lit(',"summary":"","droppedSources":[],"deduplicateBy":["Kind"],"fields":['
              '{"name":"Kind","type":"text","pattern":"","multiple":false,"reason":"","confidence":1,"operation":'),
        F.when(even, F.lit('"copy","sources":["segment"]')).otherwise(F.lit('"concat","sources":["segment","nation"]')),
        F.lit('},{"name":"Digits","type":"number","pattern":"#(\\\\d+)","multiple":false,"reason":"","confidence":1,'
              '"operation":"regex","sources":["name"]}]}'))
    plans = nations.select(F.col("n_nationkey").cast("long").alias("session_id"), F.concat(F.lit("p"), "n_nationkey").alias("plan_id"),
                           body.alias("plan_json"))
    fields = [Field("segment", "Segment"), Field("nation", "Nation"), Field("name", "Name")]
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("session_id"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"), F.col("c_name").alias("name"))
    profiles = plans.select("session_id", F.explode(F.array(*[F.lit(f.id) for f in fields])).alias("id"))
    checked = validate.validate_plans(plans, profiles, ["session_id"])
    cleaned = apply_plans(from_wide(rows, fields, ("session_id", "seq")), checked, ["session_id"], "seq")
    return cleaned.select("session_id", "seq", F.col("values")["Kind"]["str"].alias("kind"))


_REASONS = """CASE WHEN p_size % 11 = 0 THEN 'duplicate field names|' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'unknown source|' ELSE '' END
  || CASE WHEN p_size % 5 = 0 THEN 'unsupported operation|' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'unsafe pattern|' ELSE '' END
  || CASE WHEN p_size > 40 THEN 'invalid confidence|' ELSE '' END"""


def part_plans(spark, sf_dir):
    """One plan per part, broken in ways that follow from the part's size."""
    size = F.col("p_size")

    def member(name, text):
        return F.concat(F.lit(f'"{name}":'), text if not isinstance(text, str) else F.lit(text))

    def odd(divisor, yes, no):
        return F.when(size % divisor == 0, F.lit(yes)).otherwise(F.lit(no))

    first = F.concat_ws(",", member("name", '"Name"'), member("type", odd(5, '"html"', '"text"')), member("operation", '"copy"'),
                        member("sources", odd(7, '["p_name","other"]', '["p_name"]')), member("pattern", '""'),
                        member("multiple", "false"), member("reason", V.json_text(F.col("p_type"))),
                        member("confidence", (size / 40).cast("string")))
    second = F.concat_ws(",", member("name", odd(11, '" name "', '"Brand"')), member("type", '"text"'), member("operation", '"regex"'),
                         member("sources", '["p_brand"]'), member("pattern", odd(3, '"(a+)+"', '"(\\\\d+)"')), member("multiple", "false"),
                         member("reason", '""'), member("confidence", "0.5"))
    body = F.concat(F.lit('{"recordType":"Parts","summary":"","droppedSources":["p_type"],"deduplicateBy":["NAME"],"fields":[{'), first,
                    F.lit("},{"), second, F.lit("}]}"))
    plans = heavy_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan_id"), F.col("p_brand").alias("session_id"), body.alias("plan_json"))
    profiles = plans.select("session_id").distinct().select("session_id", F.explode(F.array(
        *[F.lit(c) for c in ("p_name", "p_brand", "p_type")])).alias("id"))
    return plans, profiles


@query(f"SELECT p_partkey AS plan_id, ({_REASONS}) = '' AS plan_ok, {_REASONS} AS reasons FROM part")
def checked_plans(spark, sf_dir):
    plans, profiles = part_plans(spark, sf_dir)
    out = validate.validate_plans(plans, profiles, ["session_id"])
    return out.select("plan_id", "plan_ok", F.concat(F.array_join("reasons", "|"), F.when(F.size("reasons") > 0, "|").otherwise("")).alias("reasons"))


@query(f"SELECT p_partkey, ({_REASONS}) = '' AS cache_hit FROM part")
def revalidated_plans(spark, sf_dir):
    """Stored plans are checked against what their session has now; a plan that fails is no hit."""
    plans, profiles = part_plans(spark, sf_dir)
    cache = plans.select(F.col("plan_id").cast("string").alias("plan_key"), "plan_json", F.lit(NOW).cast("timestamp").alias("created_at"))
    keyed = plans.select(F.col("plan_id").alias("p_partkey"), F.col("plan_id").cast("string").alias("plan_key"), "session_id")
    return attach_plans(keyed, cache, NOW, profiles=profiles, on=["session_id"]).select("p_partkey", "cache_hit")


_SHAPES = ("({}+)", "({}+)+", "{}", "({}{{2,9}})", "({}{{0,9}})", "(?:{})", "({})|x", "({}.*)", "([{}]+)\\s*", "({}")


@query(f"""SELECT p_partkey, p_partkey % 10 IN (0, 3, 8) AND p_size % 2 = 0 AS safe FROM part""")
def checked_patterns(spark, sf_dir):
    name = F.regexp_extract("p_name", r"(\w+)", 1)
    shapes = F.array(*[F.concat(F.lit(s.split("{}")[0].replace("{{", "{").replace("}}", "}")), name,
                                F.lit(s.split("{}")[1].replace("{{", "{").replace("}}", "}"))) for s in _SHAPES])
    pattern = F.concat(F.get(shapes, F.col("p_partkey") % 10), F.when(F.col("p_size") % 2 == 0, "").otherwise(r"\9"))
    return heavy_table(spark, sf_dir, "part").select("p_partkey", validate.safe_pattern(pattern).alias("safe"))


_SAMPLES = """SELECT c_nationkey, list(regexp_extract(c_name, '\\d+')) AS digits FROM (SELECT * FROM customer
  QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3) GROUP BY 1"""


@query(f"""SELECT c_custkey AS plan_id, list_contains(digits, regexp_extract(c_name, '\\d+')) AS leaks,
  CASE WHEN list_contains(digits, regexp_extract(c_name, '\\d+')) THEN NULL ELSE 'Field 2' END AS renamed
  FROM customer JOIN ({_SAMPLES}) USING (c_nationkey)""")
def leaking_plans(spark, sf_dir):
    """Plans that repeat their customer's number: a leak where that customer is among the samples."""
    customers = table(spark, sf_dir, "customer").withColumn("session_id", F.col("c_nationkey").cast("string"))
    fields = [Field("c_name", "Who"), Field("c_mktsegment", "Segment")]
    profiles = profile_fields(customers, fields, ["session_id"], "c_custkey")
    digits = F.regexp_extract("c_name", r"\d+", 0)

    def plan_field(name, operation, pattern):
        return F.struct(name.alias("name"), F.lit("text").alias("type"), F.array(F.lit("c_name")).alias("sources"),
                        F.lit(operation).alias("operation"), pattern.alias("pattern"), F.lit(False).alias("multiple"),
                        F.lit("why").alias("reason"), F.lit(1.0).alias("confidence"))

    plan = F.struct(
        F.lit("Customers").alias("recordType"),
        F.array(plan_field(F.lit("Number"), "regex", F.concat(F.lit("("), digits, F.lit(")"))),
                plan_field(F.lit("Customer name"), "copy", F.lit(""))).alias("fields"),
        F.array().cast("array<string>").alias("droppedSources"), F.array(F.lit("customer NAME")).alias("deduplicateBy"),
        F.lit("").alias("summary"))
    plans = customers.select(F.col("c_custkey").alias("plan_id"), "session_id", plan.alias("plan"))
    safe = validate.cache_safe_plans(plans, profiles, ["session_id"])
    return safe.select("plan_id", "leaks", F.get("plan.deduplicateBy", F.lit(0)).alias("renamed"))


NOW = dt.datetime(1998, 6, 1)


@query("""WITH c AS (SELECT o_custkey, max(o_orderdate) AS created, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01' GROUP BY 1),
l AS (SELECT * FROM c WHERE created > TIMESTAMP '1998-06-01' - INTERVAL 30 DAY)
SELECT c_custkey, o IS NOT NULL AS cache_hit, 'plan ' || o AS plan_json FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def attached_plans(spark, sf_dir):
    """Stored plans (one per order, keyed by customer) that are fresh enough to be used again."""
    cache = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit(NOW)).groupBy("o_custkey", "o_orderdate").agg(
        F.max("o_orderkey").alias("o")).select(
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("plan_key"), F.concat(F.lit("plan "), "o").alias("plan_json"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    keyed = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("plan_key"))
    return attach_plans(keyed, cache, NOW).select("c_custkey", "cache_hit", "plan_json")


@query("SELECT count(DISTINCT c_nationkey) AS sessions, count(DISTINCT c_nationkey) AS keys, 64 AS key_length FROM customer")
def template_keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("session_id", F.col("c_nationkey").cast("string"))
    profiles = profile_fields(customers, [Field("c_name", "Name"), Field("c_acctbal", "Balance", "number")], ["session_id"], "c_custkey")
    sessions = customers.select("session_id").distinct().select(
        "session_id", F.concat("session_id", F.lit(".example.test")).alias("host"), F.lit("m").alias("model"), F.lit(" keep  all ").alias("instruction"))
    keys = plan_keys(profiles, sessions, ["session_id"])
    return keys.agg(F.count("*").alias("sessions"), F.count_distinct("plan_key").alias("keys"),
                    F.max(F.length("plan_key")).alias("key_length"))


@query("""SELECT c_mktsegment, CAST(1 AS BIGINT) AS first_issues, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END AS BIGINT) AS corrected_issues,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'first' ELSE 'corrected' END AS chosen FROM customer GROUP BY ALL""")
def chosen_plans(spark, sf_dir):
    """First plans repeat a column; the corrected ones are better except for one segment."""
    df = table(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("double")).withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey")).otherwise(F.col("c_acctbal")))
    df = df.withColumn("copy", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey")).otherwise(F.col("c_custkey") * 2 + 0.5))
    fields = [*CUSTOMER, Field("copy", "Copy", "number")]
    name, key = PlanField("Name", "text", ("c_name",)), PlanField("Key", "number", ("c_custkey",))
    first = apply_plan(df, Plan((name, PlanField("Again", "text", ("c_name",)))), fields, [], "c_custkey", ["c_mktsegment"])
    better = apply_plan(df, Plan((name, key, PlanField("Balance", "number", ("c_acctbal",)), PlanField("Copy", "number", ("copy",)))),
                        fields, [], "c_custkey", ["c_mktsegment"])
    return choose_plan(first, better, ["c_mktsegment"])
