"""Records from items: locate, read, clean, type, fingerprint."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowharvest import schemas
from rowharvest.fields import Field
from rowharvest.functions import values as V
from rowharvest.operators.infer import matches_locator, relative_steps
from rowharvest.operators.locate import element_keys, locator_key
from rowharvest.session import materialize
from rowharvest.sources.nodes import VOID, text_of

# What is never read from a page.
PRIVATE_TAGS = ("input", "textarea", "select", "option")
PRIVATE_ATTRIBUTES = r"(?i)^(value|formaction)$"
SECRET_ATTRIBUTES = r"(?i)token|secret|password|auth|cookie|nonce|payment|card"
STABLE_ATTRIBUTES = ("data-id", "data-key", "itemid", "id")
HTML_DROPPED = ("script", "style", "template", "input", "textarea", "select", "option")


def fields_table(spark, fields: list[Field], cid: str | DataFrame) -> DataFrame:
    """A field list as a table, for the items of the collection ``cid`` on any page, or of each collection of a table (``cid`` column)."""
    rows = [{**asdict(f), "field_no": number, "pattern": _usable_pattern(spark, f)} for number, f in enumerate(fields, 1)]
    whole = F.from_json(F.lit(json.dumps(rows)), T.ArrayType(schemas.FIELD))
    if isinstance(cid, DataFrame):
        return cid.select("cid", F.inline(whole)).drop("collection_id")
    # A literal in the plan: no Python data source, and its size is known when joins are planned.
    return spark.sql("SELECT inline(from_json(:rows, :schema))", args={
        "rows": json.dumps(rows), "schema": T.ArrayType(schemas.FIELD).simpleString()}).drop("collection_id").withColumn(
        "cid", F.lit(cid))


def _usable_pattern(spark, field: Field) -> str | None:
    """The pattern if the engine that runs it takes it: any other leaves the raw text."""
    if not field.pattern:
        return None
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": field.pattern}).collect()
    except PySparkException:
        return None
    return field.pattern


# -- P5 locators to elements ----------------------------------------------------------------


def match_locators(nodes: DataFrame, items: DataFrame, fields: DataFrame) -> DataFrame:
    """Elements each field finds in each item: the first locator with a match decides.

    ``items``: page_id, cid, item. ``fields`` belong to a cid, or to a page_id and cid.
    Elements meet the locators in a join on the hash of what a locator tests first (id, attribute, class, or tag and place); only the
    elements it lets through meet the items around them, by their ancestors.
    """
    on = [k for k in ("page_id", "cid") if k in fields.columns]
    near = [k for k in on if k == "page_id"]
    places = nodes.select("page_id", F.col("pre").alias("item"), F.col("path").alias("item_path"))
    wanted = items.select("page_id", "cid", "item").join(places, ["page_id", "item"])
    locators = fields.select(*on, "field_no", F.posexplode("locators").alias("rank", "loc"))
    index = locators.where("not loc.scope").withColumn("key", locator_key(F.col("loc")))
    element = ["tag", "id", "classes", "attrs", "path", "ancestors"]
    met = nodes.where(F.col("depth") > 0).select("page_id", "pre", *element, F.explode(element_keys()).alias("key")).join(index, [*near, "key"])
    inside = met.withColumn("item", F.explode("ancestors")).join(wanted, ["page_id", "cid", "item"])
    below = inside.withColumn("steps", relative_steps()).where(matches_locator(F.col("loc"))).select(
        "page_id", "cid", "item", "field_no", "rank", "pre")
    itself = wanted.join(locators.where("loc.scope").drop("loc"), on).select(
        "page_id", "cid", "item", "field_no", "rank", F.col("item").alias("pre"))
    best = F.min("rank").over(Window.partitionBy("page_id", "cid", "item", "field_no"))
    return below.unionByName(itself).withColumn("best", best).where("rank = best").drop("rank", "best")


# -- P3, P4 reading elements -------------------------------------------------------------------


def is_private() -> Column:
    attrs = F.col("attrs")

    def attr(name):
        return F.coalesce(attrs[name], F.lit(""))

    return (F.col("tag").isin(*PRIVATE_TAGS) | (attr("contenteditable") == "true")
            | F.map_contains_key(attrs, "hidden") | (attr("aria-hidden") == "true"))


def link_target() -> Column:
    """The resolved address of an element for a field of type url or image; null for others."""
    attrs, type_ = F.col("attrs"), F.col("type")
    href = F.when((type_ == "url") & F.col("tag").isin("a", "area", "link"), attrs["href"])
    return V.resolve_url(F.coalesce(href, F.when(type_ == "image", attrs["src"])), F.col("base_url"))


def safe_raw_value(text: str = "raw_text", link: Column | None = None) -> Column:
    """The public value of an element for a field: '' for form controls, hidden elements and secret attributes.

    Reads the columns tag, attrs, type, attribute, html, base_url and the text column; ``link`` may hold the ``link_target``.
    """
    attrs, type_, name = F.col("attrs"), F.col("type"), F.col("attribute")
    link = link_target() if link is None else link

    def attr(column: Column) -> Column:
        return F.coalesce(attrs[column], F.lit(""))

    secret = name.rlike(PRIVATE_ATTRIBUTES) | name.rlike(SECRET_ATTRIBUTES)
    src = attr(F.lit("src"))
    return (
        F.when(is_private(), F.lit(""))
        .when((type_ == "attribute") & F.coalesce(secret, F.lit(False)), F.lit(""))
        .when(type_ == "html", F.coalesce("html", F.lit("")))
        .when(type_ == "url", F.when(F.col("tag").isin("a", "area", "link") & (attr(F.lit("href")) != ""), link)
              .otherwise(attr(F.coalesce(name, F.lit("href")))))
        .when(type_ == "image", F.when(src != "", link).otherwise(attr(F.coalesce(name, F.lit("src")))))
        .when(type_ == "attribute", attr(F.coalesce(name, F.lit(""))))
        .otherwise(F.col(text)))


def safe_html(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Inner HTML of the targets (page_id, pre) without scripts, forms, hidden parts, handlers and secrets.

    Rebuilt from the node table: every element below a target gives its start tag, its texts and its end tag, put
    together in document order. How many dropped elements an element lies in is a running sum over the
    page (one more at each of them, one less behind its last descendant); what has more of them around it than the target is left out.
    """
    wanted = targets.select("page_id", F.col("pre").alias("target")).distinct()
    attrs = F.col("attrs")

    def attr(name):
        return F.coalesce(attrs[name], F.lit(""))

    dropped = (
        F.col("tag").isin(*HTML_DROPPED) | F.map_contains_key(attrs, "hidden") | (attr("aria-hidden") == "true")
        | (attr("contenteditable") == "true"))
    some = nodes.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    closed = some.where(dropped).groupBy("page_id", (F.col("last") + 1).alias("pre")).agg(F.count("*").alias("closed"))
    running = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    levels = some.select("page_id", "pre", "last", F.col("depth").alias("level"), "tag", "attrs", "chunks", "parent", "child_idx", dropped.alias("dropped")).join(
        closed, ["page_id", "pre"], "left").withColumn(
        "around", F.sum(F.col("dropped").cast("int") - F.coalesce("closed", F.lit(0))).over(running)).drop("dropped", "closed")
    asked = wanted.join(levels.select("page_id", F.col("pre").alias("target"), F.col("last").alias("end"), F.col("around").alias("own")), ["page_id", "target"])
    # Only the elements below a target become rows, once for each target they are below.
    places = asked.select("page_id", "target", "own", F.explode(F.sequence("target", "end")).alias("pre"))
    clean = places.join(levels, ["page_id", "pre"]).where(F.col("around") == F.col("own"))

    def escaped(text: Column, quote: bool) -> Column:
        out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                        F.lit(">"), F.lit("&gt;"))
        return F.replace(out, F.lit('"'), F.lit("&quot;")) if quote else out

    shown = F.filter(F.map_entries("attrs"),
                     lambda e: ~e["key"].rlike("(?i)^on") & ~e["key"].rlike(SECRET_ATTRIBUTES))
    opening = F.concat(F.lit("<"), F.col("tag"), F.array_join(F.transform(
        shown, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"'))), ""), F.lit(">"))
    closing = F.when(F.col("tag").isin(*VOID), "").otherwise(F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    # Every piece is sorted by (last element before it, kind, nesting level upwards, text
    # before end tag, text position): start tags come first at their element, then its
    # leading texts, then what follows the ends of finished subtrees, innermost first.
    piece = lambda a, b, c, d, pos, txt: F.struct(a.alias("a"), F.lit(b).alias("b") if isinstance(b, int) else b.alias("b"), c.alias("c"),
                                                  F.lit(d).alias("d"), pos.alias("pos"), txt.alias("txt"))
    zero = F.lit(0)
    tags = F.when(F.col("pre") == F.col("target"), F.array().cast(_PIECES)).otherwise(F.array(
        piece(F.col("pre"), 0, zero, 0, zero, opening), piece(F.col("last"), 2, -F.col("level"), 1, zero, closing)).cast(_PIECES))
    # A text behind the n-th child comes after that child's last descendant.
    before = some.where("depth > 0").groupBy("page_id", F.col("parent").alias("pre")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("child_idx") + 1).alias("after"), F.col("last").alias("end")))).alias("ends"))
    speaking = levels.where(F.size("chunks") > 0).select("page_id", "pre")
    ends = before.join(speaking, ["page_id", "pre"], "left_semi")
    texts = F.transform("chunks", lambda c: piece(
        F.coalesce(F.element_at("ends", c["after"]), F.col("pre")), F.when(c["after"] == 0, 1).otherwise(2), -F.col("level"), 0, c["pos"],
        escaped(F.coalesce(c["raw"], c["txt"]), False))).cast(_PIECES)
    rows = clean.join(ends, ["page_id", "pre"], "left").select("page_id", "target", F.concat(tags, texts).alias("pieces"))
    return rows.groupBy("page_id", "target").agg(F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces")).select(
        "page_id", F.col("target").alias("pre"), F.array_join(F.transform("pieces", lambda p: p["txt"]), "").alias("html"))


_PIECES = "array<struct<a:int,b:int,c:int,d:int,pos:int,txt:string>>"


# -- X2 patterns, X1 records ---------------------------------------------------------------------


def pattern_values(raw: Column) -> Column:
    """Array of the values a field's pattern finds in ``raw``; ``raw`` itself without a pattern."""
    flags = F.regexp_replace(F.coalesce("pattern_flags", F.lit("i")), "[^ims]", "")
    full = F.concat(F.lit("(?"), flags, F.lit("u)"), F.col("pattern"))
    found = V.matches_of(raw, full, V.has_group(F.col("pattern")))
    return (F.when(F.col("pattern").isNull(), F.array(raw)).when(F.col("multiple"), found)
            .otherwise(F.array(F.coalesce(F.get(found, F.lit(0)), F.lit("")))))


def typed_texts(raws: Column) -> Column:
    """Cleaned texts of a field (dates and addresses in one form), null for empty ones. Reads the columns type and base_url."""
    def one(raw: Column) -> Column:
        return V.let(V.collapse_space(raw), lambda text: F.when(text != "", (
            F.when(F.col("type") == "date", V.parse_date(text))
            .when(F.col("type").isin("url", "image"), V.resolve_url(text, F.col("base_url"))).otherwise(text))))

    return F.transform(raws, one)


def field_value(texts: Column) -> Column:
    """The VALUE struct of a field's cleaned texts: all of a many-valued field, which stay texts, else the first, a number for number types."""
    first, numeric = F.get(texts, F.lit(0)), F.col("type").isin("number", "price")
    return F.struct(F.when(~F.col("multiple") & ~numeric, first).alias("str"), F.when(~F.col("multiple") & numeric, V.parse_number(first)).alias("num"),
                    F.when(F.col("multiple"), F.array_compact(texts)).alias("arr"))


def extract_records(nodes: DataFrame, items: DataFrame, fields: DataFrame, with_html: bool = False) -> DataFrame:
    """One record per item: page_id, cid, item, ord, values, original_values, fingerprint, incomplete, source_url.

    ``values`` maps field id to a VALUE struct, ``original_values`` to the texts as read.
    Items are identified by element, every item gives a record, and nothing is capped.
    ``fields`` belong to a collection (``cid``), of one page when they carry ``page_id`` too.
    The fingerprint covers the values and the item's stable attributes, not its place;
    ``content`` is the text it is computed from.
    """
    on = [k for k in ("page_id", "cid") if k in fields.columns]
    specs = fields.select(*on, "field_no", F.col("id").alias("field_id"), "type", "attribute", "pattern",
                          "pattern_flags", "multiple", "required")
    found = materialize(match_locators(nodes, items, fields).join(specs, [*on, "field_no"]), "found")
    textual = found.where(~F.col("type").isin("url", "image", "attribute", "html"))
    texts = text_of(nodes, textual.select("page_id", "pre"))
    whole = found.join(nodes.select("page_id", "pre", "tag", "attrs", "base_url"), ["page_id", "pre"]).join(
        texts, ["page_id", "pre"], "left").withColumns(
        {"text": F.coalesce("text", F.lit("")), "raw_text": F.coalesce("raw_text", F.lit(""))})
    if with_html:
        markup = safe_html(nodes, found.where("type = 'html'").select("page_id", "pre"))
        whole = whole.join(markup, ["page_id", "pre"], "left")
    else:
        whole = whole.withColumn("html", F.lit(None).cast("string"))
    # Element texts come in NFKC form from the node table; only attribute and markup values still need it.
    link = F.col("link")
    read = whole.withColumn("link", link_target()).withColumn("original", safe_raw_value("raw_text", link)).withColumn(
        "public", F.when(F.col("type").isin("attribute", "html"), V.nfkc(F.when(
            F.col("type").isin("attribute", "html"), F.col("original")))).otherwise(safe_raw_value("text", link)))
    read = read.withColumns({"raws": pattern_values(F.col("original")), "parts": pattern_values(F.col("public"))})
    per_field = read.groupBy("page_id", "cid", "item", "field_no").agg(
        F.array_sort(F.collect_list(F.struct("pre", "raws", "parts"))).alias("e")
    ).select("page_id", "cid", "item", "field_no",
             F.flatten(F.transform("e", lambda e: e["raws"])).alias("raws"),
             F.flatten(F.transform("e", lambda e: e["parts"])).alias("parts"))
    columns = ["page_id", "cid", "item", "ord"]
    none = F.array().cast("array<string>")
    document = nodes.where("pre = 0").select("page_id", F.col("page_url").alias("source_url"), "base_url")
    filled = items.select(*columns).join(specs, on).join(
        per_field, ["page_id", "cid", "item", "field_no"], "left").join(document, ["page_id"], "left").withColumns(
        {"raws": F.coalesce("raws", none), "parts": F.coalesce("parts", none)})
    kept = F.when(F.col("multiple"), F.col("parts")).otherwise(F.slice("parts", 1, 1))
    valued = filled.withColumn("typed", typed_texts(kept)).withColumn("value", field_value(F.col("typed")))
    missing = (F.col("required") & F.col("value.arr").isNull() & F.col("value.num").isNull()
               & (F.coalesce("value.str", F.lit("")) == ""))
    original = F.when(F.col("multiple"), F.col("raws")).otherwise(F.slice("raws", 1, 1))
    # The fields of one item, at most some dozens.
    records = valued.groupBy(*columns).agg(
        F.array_sort(F.collect_list(F.struct("field_no", "field_id", "value", original.alias("raws")))).alias("f"),
        F.max(missing).alias("incomplete"), F.first("source_url").alias("source_url"))
    stable = nodes.select("page_id", F.col("pre").alias("item"), F.array_join(
        F.filter(F.array(*[F.col("attrs")[a] for a in STABLE_ATTRIBUTES]), lambda a: a.isNotNull() & (a != "")),
        "|").alias("stable"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("f", lambda e: F.concat(
        V.json_text(e["field_id"]), F.lit(":"), V.json_value(e["value"]))), ","), F.lit("}"), F.col("stable"))
    return records.join(stable, ["page_id", "item"]).select(
        *columns,
        F.map_from_entries(F.transform("f", lambda e: F.struct(e["field_id"], e["value"]))).alias("values"),
        F.map_from_entries(F.transform("f", lambda e: F.struct(e["field_id"], e["raws"]))).alias("original_values"),
        V.fingerprint(body).alias("fingerprint"), body.alias("content"), "incomplete", "source_url")


def is_incomplete(fields: list[Field], values: str = "values") -> Column:
    """A required field is null or empty; an empty array does not count."""
    out = F.lit(False)
    for f in fields:
        if f.required:
            v = F.col(values)[f.id]
            out = out | (v["arr"].isNull() & v["num"].isNull() & (F.coalesce(v["str"], F.lit("")) == ""))
    return out


# -- wide form -------------------------------------------------------------------------------------


def kind_of(field: Field) -> str:
    return "arr" if field.multiple else "num" if field.type in ("number", "price") else "str"


def to_wide(records: DataFrame, fields: list[Field], keep: tuple[str, ...]) -> DataFrame:
    """One typed column per field (named by field id) beside the ``keep`` columns."""
    return records.select(*keep, *[F.col("values")[f.id][kind_of(f)].alias(f.id) for f in fields])


def from_wide(df: DataFrame, fields: list[Field], keep: tuple[str, ...]) -> DataFrame:
    """Inverse of ``to_wide``: the field columns as one ``values`` map."""
    def value(f: Field) -> Column:
        parts = {"str": F.lit(None).cast("string"), "num": F.lit(None).cast("double"),
                 "arr": F.lit(None).cast("array<string>")}
        kind = kind_of(f)
        parts[kind] = F.col(f.id).cast(schemas.VALUE[kind].dataType)
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    entries = [c for f in fields for c in (F.lit(f.id), value(f))]
    return df.select(*keep, F.create_map(*entries).alias("values"))
