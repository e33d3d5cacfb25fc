"""Cleanup plans as data: pattern safety, validity, leaks of sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowharvest import schemas
from rowharvest.functions import values as V

# What a plan may contain.
OUTPUT_TYPES = ("text", "number", "price", "date", "url", "image", "email", "phone")
OPERATIONS = ("copy", "first_nonempty", "concat", "regex")
DANGEROUS_NAME = r"(?i)^(__proto__|prototype|constructor)$"
MAX_PLAN_FIELDS, MAX_SOURCES, MAX_DROPPED, MAX_DEDUPE = 30, 8, 40, 20
MAX_PATTERN, MAX_QUANTIFIERS, MAX_REPEAT = 160, 8, 200
FORBIDDEN = r"\\[1-9]|\(\?|\||\.\*|\.\+|\)[+*{]"
RANGE = r"\{(\d+)(?:,(\d*))?\}"
TOKEN = r"[\p{L}\p{N}@._+-]{8,}"
CACHED_REASON = "a stored plan that was checked before"
CACHED_TYPE = "Records of a stored plan"
CACHED_SUMMARY = "A stored plan of this template, used again."


def safe_pattern(pattern: Column) -> Column:
    """May this regular expression run on data? One group, few quantifiers, no backtracking traps.

    Alternation, lookaround, back-references, ``?``, dot-star and repeated groups are
    refused; repeat counts lie in 1..200; the syntax must be valid.
    """
    def judged(p: Column) -> Column:
        no_escapes = F.regexp_replace(p, r"(?s)\\.", "e")
        plain = F.regexp_replace(no_escapes, r"\[[^\]]*(\]|$)", "c")
        ranges = F.transform(F.regexp_extract_all(p, F.lit(RANGE), F.lit(0)), lambda r: F.struct(
            F.regexp_extract(r, RANGE, 1).try_cast("int").alias("low"),
            F.regexp_extract(r, RANGE, 2).alias("high")))

        def range_ok(r: Column) -> Column:
            high = F.when(r["high"] == "", r["low"]).otherwise(r["high"].try_cast("int"))
            return F.coalesce(r["low"].between(1, MAX_REPEAT) & (high <= MAX_REPEAT) & (high >= r["low"]), F.lit(False))

        counted = F.regexp_replace(plain, RANGE, "*")
        escapes = F.regexp_extract_all(p, F.lit(r"(?s)\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)"), F.lit(1))
        classes = F.regexp_extract_all(no_escapes, F.lit(r"\[([^\]]*)\]"), F.lit(1))
        spans = F.flatten(F.transform(classes, lambda c: F.regexp_extract_all(c, F.lit(r"(?s)(.-.)"), F.lit(0))))
        well_formed = (
            plain.rlike(r"^[^()]*\([^()]*\)[^()]*$") & ~plain.rlike(r"[\[\]]") & ~counted.rlike(r"[{}]")
            & ~counted.rlike(r"(^|[(+*^$])[+*]") & ~no_escapes.rlike(r"\\$")
            & (F.size(F.filter(F.regexp_extract_all(no_escapes, F.lit(r"\[[^\]]*(\]|$)"), F.lit(1)), lambda x: x == "")) == 0)
            & F.forall(escapes, lambda e: e.rlike(r"(?s)^([dDwWsSbBfnrtv0^$\\.*+?()\[\]{}|/-]|u.{4}|x.{2})$"))
            & F.forall(spans, lambda s: F.ascii(F.substring(s, 1, 1)) <= F.ascii(F.substring(s, 3, 1))))
        return (
            (F.length(p) <= MAX_PATTERN) & (p != "") & ~p.rlike(FORBIDDEN)
            & (F.regexp_count(plain, F.lit(r"\(")) == 1) & (F.regexp_count(plain, F.lit(r"[+*{]")) <= MAX_QUANTIFIERS)
            & (F.regexp_count(plain, F.lit(r"\*")) <= 1) & ~plain.contains("?")
            & F.forall(ranges, range_ok) & well_formed)

    return F.coalesce(V.let(pattern, judged), F.lit(False))


#: Member types a plan must have, as ``schema_of_variant`` prints them.
_TYPES = (
    (r"recordType: STRING", "record type"), (r"summary: STRING", "summary"), (r"fields: ARRAY<OBJECT<", "fields"),
    (r"fields: ARRAY<OBJECT<.*\bname: STRING", "field name"), (r"fields: ARRAY<OBJECT<.*\btype: STRING", "field type"),
    (r"\boperation: STRING", "operation"), (r"\bpattern: STRING", "pattern"), (r"\bmultiple: BOOLEAN", "multiple"),
    (r"\breason: STRING", "reason"), (r"\bconfidence: (BIGINT|DECIMAL|DOUBLE|FLOAT)", "confidence"),
    (r"\bsources: ARRAY<STRING>", "sources"), (r"\bdroppedSources: ARRAY<(STRING|VOID)>", "dropped sources"),
    (r"\bdeduplicateBy: ARRAY<(STRING|VOID)>", "deduplication"),
)


def parse_plans(plans: DataFrame, json: str = "plan_json") -> DataFrame:
    """Adds ``plan`` (PLAN struct or null) and ``type_errors`` for a column of plan JSON."""
    kinds = F.schema_of_variant(F.try_parse_json(json))
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(kinds.rlike(p), F.lit(False)), F.lit(f"malformed {n}"))
                                      for p, n in _TYPES]))
    return plans.withColumn("plan", F.from_json(json, schemas.PLAN)).withColumn("type_errors", wrong)


def validate_plans(plans: DataFrame, profiles: DataFrame, on: list[str], json: str = "plan_json") -> DataFrame:
    """All plans checked at once against the profiles of their session.

    ``plans``: plan_id, ``on``, plan JSON; ``profiles``: ``on``, id. Gives plan_id, ``on``,
    plan_ok, reasons and the normalised plan. A plan is judged as a whole: one bad part
    rejects it.
    """
    parsed = parse_plans(plans.select("plan_id", *on, json), json)
    known = profiles.groupBy(*on).agg(F.collect_set("id").alias("known"))  # at most 30 ids per session
    facts = parsed.join(known, on, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    fields = F.col("plan.fields")

    # All names of a plan get their Unicode step together: array functions have none.
    between = "\x1f"

    def spoken(names: Column) -> Column:
        joined = F.array_join(F.transform(names, lambda n: F.replace(n, F.lit(between), F.lit(" "))), between)
        return F.when(F.size(names) > 0, F.transform(F.split(V.nfkc(joined, in_place=True), between), V.collapse_space)).otherwise(names)

    facts = facts.withColumn("spoken", spoken(F.transform(fields, lambda f: F.coalesce(f["name"], F.lit(""))))).withColumn(
        "wanted", F.transform(spoken(F.col("plan.deduplicateBy")), F.lower)).withColumn(
        "plan", F.col("plan").withField("fields", F.zip_with(fields, "spoken", lambda f, n: f.withField("name", n))))

    def name_of(f: Column) -> Column:
        return F.substring(f["name"], 1, 80)

    facts = facts.withColumn("names", F.transform(fields, lambda f: F.lower(name_of(f))))

    def reason(test: Column, text: str) -> Column:
        return F.when(F.coalesce(test, F.lit(True)), F.lit(text))

    def some(test) -> Column:
        return F.exists(fields, lambda f: F.coalesce(test(f), F.lit(True)))

    reasons = F.array_compact(F.array(
        reason(F.col("plan").isNull() | (F.size("type_errors") > 0), "invalid plan"),
        reason(~F.size(fields).between(1, MAX_PLAN_FIELDS), "unsupported number of fields"),
        reason(some(lambda f: (name_of(f) == "") | name_of(f).rlike(DANGEROUS_NAME)), "unsafe field name"),
        reason(F.size(F.array_distinct("names")) != F.size("names"), "duplicate field names"),
        reason(some(lambda f: ~F.size(f["sources"]).between(1, MAX_SOURCES)), "bad number of sources"),
        reason(some(lambda f: F.size(F.array_except(f["sources"], F.col("known"))) > 0), "unknown source"),
        reason(some(lambda f: ~f["type"].isin(*OUTPUT_TYPES) | ~f["operation"].isin(*OPERATIONS)),
               "unsupported operation"),
        reason(some(lambda f: (f["operation"] == "regex") & ~safe_pattern(f["pattern"])), "unsafe pattern"),
        reason(some(lambda f: (f["operation"] != "regex") & (f["pattern"] != "")), "unexpected pattern"),
        reason(some(lambda f: ~f["confidence"].between(0, 1) | F.isnan(f["confidence"])), "invalid confidence"),
        reason(some(lambda f: f["multiple"].isNull() | f["reason"].isNull()), "malformed field"),
        reason((F.size("plan.droppedSources") > MAX_DROPPED)
               | (F.size(F.array_except("plan.droppedSources", "known")) > 0), "invalid dropped sources"),
        reason((F.size("plan.deduplicateBy") > MAX_DEDUPE) | (F.size(F.array_except("wanted", "names")) > 0), "invalid deduplication"),
    ))
    normal = F.struct(
        F.coalesce(V.text_or_null(F.substring(V.collapse_space(F.col("plan.recordType")), 1, 80)), F.lit("records"))
        .alias("recordType"),
        F.transform(fields, lambda f: F.struct(
            name_of(f).alias("name"), f["type"].alias("type"), f["sources"].alias("sources"),
            f["operation"].alias("operation"), f["pattern"].alias("pattern"), f["multiple"].alias("multiple"),
            F.substring(f["reason"], 1, 240).alias("reason"), f["confidence"].alias("confidence"))).alias("fields"),
        F.array_distinct("plan.droppedSources").alias("droppedSources"), F.col("plan.deduplicateBy").alias("deduplicateBy"),
        F.substring(V.collapse_space(F.col("plan.summary")), 1, 500).alias("summary"))
    return facts.withColumn("reasons", reasons).select(
        "plan_id", *on, (F.size("reasons") == 0).alias("plan_ok"), "reasons",
        F.when(F.size("reasons") == 0, normal).alias("plan"))


# -- A5 leaks ---------------------------------------------------------------------------------


def sampled_tokens(profiles: DataFrame, on: list[str]) -> DataFrame:
    """``on``, token: words of eight or more characters that occur in samples but in no field name."""
    def tokens(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    in_samples = profiles.select(*on, F.explode("samples").alias("sample")).select(
        *on, F.explode(tokens(F.col("sample"))).alias("token")).distinct()
    in_names = profiles.select(*on, F.explode(tokens(F.col("name"))).alias("token")).distinct()
    return in_samples.join(in_names, [*on, "token"], "left_anti")


def cache_safe_plans(plans: DataFrame, profiles: DataFrame, on: list[str]) -> DataFrame:
    """Plans that may be stored for reuse: adds ``leaks`` and replaces ``plan`` by its cache form.

    A plan whose patterns repeat a sampled token leaks and gets no cache form. Field names
    with such a token become ``Field n``; free text is replaced.
    """
    # Bounded per session: 30 profiles x 3 samples x 160 characters.
    words = sampled_tokens(profiles, on).groupBy(*on).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    joined = plans.join(words, on, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    patterns = F.array_join(F.transform("plan.fields", lambda f: F.regexp_replace(F.lower(f["pattern"]), r"\\", "")), " ")

    def told(text: Column) -> Column:
        return F.exists("tokens", lambda t: F.contains(text, t))

    renamed = F.transform("plan.fields", lambda f, i: F.struct(
        f["name"].alias("old"), F.when(told(F.lower(f["name"])), F.concat(F.lit("Field "), (i + 1).cast("string")))
        .otherwise(f["name"]).alias("new")))
    safe = joined.withColumn("leaks", told(patterns)).withColumn("renamed", renamed)
    fields = F.transform(F.arrays_zip(F.col("plan.fields").alias("f"), F.col("renamed").alias("r")), lambda z: F.struct(
        z["r"]["new"].alias("name"), *[z["f"][n].alias(n) for n in ("type", "sources", "operation", "pattern", "multiple")],
        F.lit(CACHED_REASON).alias("reason"), z["f"]["confidence"].alias("confidence")))

    def current(name: Column) -> Column:
        hit = F.filter("renamed", lambda r: F.lower(r["old"]) == F.lower(name))
        return F.coalesce(F.get(hit, F.size(hit) - 1)["new"], name)

    form = F.struct(F.lit(CACHED_TYPE).alias("recordType"), fields.alias("fields"),
                    F.col("plan.droppedSources").alias("droppedSources"),
                    F.transform("plan.deduplicateBy", current).alias("deduplicateBy"),
                    F.lit(CACHED_SUMMARY).alias("summary"))
    return safe.withColumn("plan", F.when(~F.col("leaks"), form)).drop("tokens", "renamed")
