"""Queries over scalar values: text, numbers, dates, URLs, hashes, exports."""

import re

from pyspark.sql import functions as F

from rowharvest.fields import Field
from rowharvest.functions import values as V
from rowharvest.operators import infer
from rowharvest.queries import heavy_table, query, table
from rowharvest.sinks import export

SPACES = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
COLLAPSED = (r"trim(regexp_replace(regexp_replace({}, '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '" + SPACES.replace("{", "{{").replace("}", "}}")
             + r"', ' ', 'g'))")
TEXT = COLLAPSED.format("text")


def re2(pattern: str) -> str:
    """A pattern as an SQL literal for the other engine: code points written out."""
    plain = "".join(c if ord(c) < 128 else f"\\u{ord(c):04x}" for c in pattern)
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", plain).replace("'", "''")


@query(f"SELECT doc_id, length({TEXT}) AS n_chars, md5({TEXT}) AS digest FROM documents")
def normalized_text(spark, sf_dir):
    return heavy_table(spark, sf_dir, "documents").select("doc_id", V.normalize_whitespace(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


_EU = "replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.')"


@query(f"""SELECT o_orderkey, '€ ' || {_EU} AS eu_text, o_totalprice AS eu, o_totalprice AS us,
  CAST(regexp_extract(regexp_replace(format('{{:,.0f}}', o_totalprice), ',', '.'), '^\\d+\\.?\\d*') AS DOUBLE) AS grouped,
  CAST(o_orderkey AS DOUBLE) AS ident FROM orders""")
def parsed_numbers(spark, sf_dir):
    us = F.format_number("o_totalprice", 2)
    eu = F.concat(F.lit("€ "), F.translate(us, ",.", ".,"))
    return heavy_table(spark, sf_dir, "orders").select(
        "o_orderkey", eu.alias("eu_text"), V.parse_number(eu).alias("eu"), V.parse_number(F.concat(F.lit("USD"), us)).alias("us"),
        V.parse_number(F.regexp_replace(F.format_number("o_totalprice", 0), "^(\\d+),(\\d+).*$", "$1,$2")).alias("grouped"),
        V.parse_number(F.concat(F.lit("No "), F.col("o_orderkey").cast("string"), F.lit(" of all"))).alias("ident"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 'around ' || strftime(o_orderdate, '%Y')
  ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') END AS iso FROM orders""")
def parsed_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy"))
            .when(k == 2, F.date_format(d, "d MMM yyyy")).when(k == 3, F.date_format(d, "M/d/yyyy"))
            .when(k == 4, F.upper(F.date_format(d, "MMM d yyyy"))).when(k == 5, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .otherwise(F.concat(F.lit("around "), F.date_format(d, "yyyy"))))
    return heavy_table(spark, sf_dir, "orders").select("o_orderkey", V.parse_date(text).alias("iso"))


_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT page_id, {_ORIGIN} || regexp_replace({_PATH}, '[^/]*$', '') || 'x/y?z=1' AS relative,
  {_ORIGIN} || {_PATH} || '?q=a%20b' AS query, regexp_replace(url, '#.*$', '') || '#top' AS fragment,
  regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.test/a.png' AS protocol, {_ORIGIN} || '/up.html' AS dots,
  'mailto:a@example.test' AS mail FROM pages""")
def resolved_urls(spark, sf_dir):
    def to(ref):
        return V.resolve_url(F.lit(ref), F.col("url"))

    return table(spark, sf_dir, "pages").select(
        "page_id", to("x/y?z=1").alias("relative"), to("?q=a b").alias("query"), to("#top").alias("fragment"),
        to("//CDN.example.test/a.png").alias("protocol"), to("./../../../up.html").alias("dots"), to("mailto:a@example.test").alias("mail"))


_FNV = "list_reduce([CAST(2166136261 AS BIGINT)] || [CAST(unicode(c) AS BIGINT) FOR c IN string_split({}, '')], lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"""SELECT c_custkey, h AS hash, ltrim(array_to_string([substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(36 ** i AS BIGINT)) % 36 + 1 AS BIGINT), 1)
  FOR i IN [6, 5, 4, 3, 2, 1, 0]], ''), '0') AS short_id, sha256(c_name || '|' || c_mktsegment) AS long_id
  FROM (SELECT *, {_FNV.format("c_name || '|' || c_mktsegment")} AS h FROM customer)""")
def fingerprints(spark, sf_dir):
    content = F.concat_ws("|", "c_name", "c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", V.fnv1a32(content).alias("hash"), V.short_hash(content).alias("short_id"), V.fingerprint(content).alias("long_id"))


@query("""SELECT p_partkey, array_to_string([upper(substr(w, 1, 1)) || substr(w, 2) FOR w IN string_split(p_name, ' ')], ' ') AS spaced,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' Kind' AS joined FROM part""")
def titled_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", V.title_case(F.translate("p_name", " ", "-")).alias("spaced"),
        V.title_case(F.concat(F.lower("p_type"), F.lit("Kind"))).alias("joined"))


_PATTERNS = {n: p for n, _, p, _, _ in infer.SEMANTIC_FIELDS}


@query(" UNION ALL ".join(
    f"SELECT lang, '{n}' AS name, count(*) AS n_texts, count(*) FILTER (WHERE regexp_matches(text, '{re2(p)}', 'i')) AS matches "
    "FROM documents GROUP BY lang" for n, p in _PATTERNS.items()))
def semantic_matches(spark, sf_dir):
    return infer.semantic_counts(heavy_table(spark, sf_dir, "documents"), ["lang"]).select("lang", "name", "n_texts", "matches")


@query(f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{re2(_PATTERNS["Email"])}', 1, 'i'), '|') AS emails,
  array_to_string(regexp_extract_all(text, '{re2(_PATTERNS["Phone"])}', 1, 'i'), '|') AS phones,
  regexp_extract(text, '([\\w]+)\\s+of', 1, 'i') AS first_of FROM documents""")
def found_contacts(spark, sf_dir):
    text = F.col("text")
    return heavy_table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(V.pattern_all(text, _PATTERNS["Email"], "iu"), "|").alias("emails"),
        F.array_join(V.pattern_all(text, _PATTERNS["Phone"], "iu"), "|").alias("phones"),
        V.pattern_first(text, r"([\w]+)\s+of", "i").alias("first_of"))


_CELLS = """SELECT c_custkey, 'name' AS col, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'balance', '$' || c_acctbal FROM customer
  UNION ALL SELECT c_custkey, 'key', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'long', CAST(c_custkey + 10000000 AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'mail', lower(c_mktsegment) || '@example.test' FROM customer UNION ALL SELECT c_custkey, 'when', 'updated ' || c_mktsegment FROM customer"""


@query(rf"""SELECT col, CASE WHEN regexp_matches(v, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email'
  WHEN regexp_matches(v, '^\+?[\d\s().-]{{7,}}$') AND regexp_matches(v, '\d') THEN 'phone'
  WHEN regexp_matches(lower(v), '{re2(infer.PRICE_HINT)}') THEN 'price' WHEN regexp_matches(lower(v), '{infer.DATE_HINT}') THEN 'date'
  WHEN regexp_matches(v, '^[+-]?[\d,.]+$') THEN 'number' ELSE 'text' END AS type, count(*) AS n FROM ({_CELLS}) GROUP BY ALL""")
def inferred_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    cells = F.array(*[F.struct(F.lit(n).alias("col"), v.alias("v")) for n, v in (
        ("name", F.col("c_name")), ("balance", F.concat(F.lit("$"), F.col("c_acctbal").cast("string"))),
        ("key", key.cast("string")), ("long", (key + 10000000).cast("string")),
        ("mail", F.concat(F.lower("c_mktsegment"), F.lit("@example.test"))),
        ("when", F.concat(F.lit("updated "), F.col("c_mktsegment"))))])
    no_attrs = F.create_map().cast("map<string,string>")
    return c.select(F.inline(cells)).select("col", infer.infer_type(F.lit("span"), F.col("v"), no_attrs).alias("type")).groupBy(
        "col", "type").agg(F.count("*").alias("n"))


_PHRASES = " ".join(f"WHEN regexp_matches(t, '{p[4:]}', 'i') THEN '{n}'" for p, n in infer.PHRASES)


@query(f"""SELECT doc_id, CASE WHEN regexp_extract(t, '{re2(infer.LABELLED)}', 1) <> '' AND length(regexp_extract(t, '{re2(infer.LABELLED)}', 2)) <= 240
  THEN 'label' {_PHRASES} WHEN length(t) >= 90 THEN 'Description' ELSE 'Field ' || (doc_id + 1) END AS name FROM (SELECT doc_id, {TEXT} AS t FROM documents)""")
def inferred_names(spark, sf_dir):
    docs = heavy_table(spark, sf_dir, "documents").select("doc_id", V.collapse_space(F.col("text")).alias("t"))
    none = F.array().cast("array<string>")
    named = infer.infer_name(F.lit("p"), F.col("t"), F.create_map().cast("map<string,string>"), none, F.col("doc_id"))
    return docs.withColumn("n", named).select(
        "doc_id", F.when(F.col("n.confidence") == 0.96, "label").otherwise(F.col("n.name")).alias("name"))


CUSTOMER = [Field("c_name", "Name"), Field("c_acctbal", "=Balance", "number"), Field("c_mktsegment", "Segment"),
            Field("c_custkey", "Key", hidden=True)]
_NUM = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"


@query(f"""SELECT c_custkey, '"' || c_name || '","' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || {_NUM.format('c_acctbal')}
  || '","' || c_mktsegment || '"' AS line FROM customer""")
def csv_lines(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", export.csv_line(df, CUSTOMER).alias("line"))


@query(f"""SELECT c_custkey, '{{"Name":"' || c_name || '","=Balance":' || {_NUM.format('c_acctbal')} || ',"Segment":"' || c_mktsegment
  || '","_metadata":{{"sourceUrl":"https://e.test/' || c_custkey || '","capturedAt":"2025-01-01T00:00:00.000Z","batchId":"b' || c_nationkey
  || '","fingerprint":"' || md5(c_name) || '"}}}}' AS line FROM customer""")
def json_lines(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumns({
        "source_url": F.concat(F.lit("https://e.test/"), F.col("c_custkey").cast("string")),
        "captured_at": F.lit("2025-01-01").cast("timestamp"), "batch_id": F.concat(F.lit("b"), F.col("c_nationkey").cast("string")),
        "fingerprint": F.md5("c_name")})
    return df.select("c_custkey", export.json_object(df, CUSTOMER, metadata=True).alias("line"))


@query("""SELECT c_custkey, c_name, 'https://e.test/' || c_custkey AS "Source URL", '2025-01-01T00:00:00.000Z' AS "Captured At",
  'b' || c_nationkey AS "Batch ID", md5(c_name) AS "Fingerprint" FROM customer""")
def lineage_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.concat(F.lit("https://e.test/"), F.col("c_custkey").cast("string")).alias("source_url"),
        F.lit("2025-01-01").cast("timestamp").alias("captured_at"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("batch_id"),
        F.md5("c_name").alias("fingerprint"))
    return export.metadata_columns(df)
