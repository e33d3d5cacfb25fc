"""Queries over the page table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowharvest.fields import Field, Locator
from rowharvest.operators import detect, structure
from rowharvest.operators.extract import extract_records, fields_table, safe_html
from rowharvest.operators.locate import Collection, locate_items
from rowharvest.queries import query, table
from rowharvest.session import materialize
from rowharvest.sources import pages as P
from rowharvest.sources.frames import stitch_frames
from rowharvest.sources.nodes import page_nodes, text_of

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
UNESCAPE = "replace(replace({}, '&quot;', '\"'), '&amp;', '&')"
ENCODE = ("array_to_string([CASE WHEN c = ' ' THEN '%20' WHEN regexp_matches(c, '[^\\x21-\\x7E]|[\"<>`{{}}]') "
          "THEN url_encode(c) ELSE c END FOR c IN string_split({}, '')], '')")
LINKS = ("SELECT page_id, url, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS li, "
         "unnest(range(1, 1 + len(regexp_extract_all(html, '<li>')))) AS ord FROM pages")
HREF = UNESCAPE.format("regexp_extract(li, 'href=\"([^\"]*)\"', 1)")
LABEL = UNESCAPE.format("regexp_extract(li, '>([^<]*)</a>', 1)")
BLOCKED = ["example.org", "cheap-pills.example.com", "www.thered.example.net"]
MENU = Collection("menu", "nav > ul", ":scope > li")
MENU_FIELDS = [
    Field("label", "Label", "text", (Locator.by_class("span", "label"), Locator.by_tag("a")), required=True),
    Field("target", "Target", "url", (Locator.by_path("a"),), attribute="href"),
    Field("words", "Words", "text", (Locator.item(),), pattern=r"([^\s,.]{2,})", multiple=True),
]


def pages(spark, sf_dir):
    return P.read_pages(spark, f"{sf_dir}/pages.parquet")


def nodes_of(spark, sf_dir):
    return page_nodes(pages(spark, sf_dir))


def written_nodes(spark, sf_dir):
    return materialize(nodes_of(spark, sf_dir), "nodes")


@query(rf"""SELECT page_id, {HOST} AS host,
  regexp_matches(url, '^https?:|^file:') AND NOT regexp_matches(url, '^(chrome|edge|about|devtools|view-source):', 'i') AS fetchable,
  regexp_matches({HOST}, '(^|\.)(bank|banking|paypal|stripe|checkout|wallet|auth|login)\b', 'i') AS sensitive FROM pages""")
def page_policy(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "host", P.is_fetchable(F.col("url")).alias("fetchable"),
                                       P.is_sensitive_host(F.col("host")).alias("sensitive"))


@query(f"""SELECT page_id, {HOST} AS host FROM pages WHERE NOT ({' OR '.join(
    f"{HOST} = '{d}' OR suffix({HOST}, '.{d}')" for d in BLOCKED)})""")
def unblocked_pages(spark, sf_dir):
    blocked = spark.createDataFrame([(d,) for d in BLOCKED], "domain string")
    return P.drop_blocked(P.filter_fetchable(pages(spark, sf_dir)), blocked).select("page_id", "host")


@query("SELECT page_id, trim(regexp_replace(" + UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")
       + r", '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return P.page_titles(nodes_of(spark, sf_dir))


@query(f"SELECT page_id, {LABEL} AS link_text, {ORIGIN} || {ENCODE.format(HREF)} AS url FROM ({LINKS})")
def page_links(spark, sf_dir):
    """Menu links of fetchable pages, resolved: the shortest way from pages to rows."""
    kept = P.filter_fetchable(pages(spark, sf_dir))
    nodes = page_nodes(kept)
    from rowharvest.functions.values import resolve_url
    from rowharvest.sources.nodes import own_text

    links = nodes.where((F.col("tag") == "a") & F.col("path").rlike(r"/nav(\[\d+\])?/ul(\[\d+\])?/li(\[\d+\])?/a(\[\d+\])?$"))
    return links.select("page_id", own_text().alias("link_text"),
                        resolve_url(F.col("attrs")["href"], F.col("base_url")).alias("url"))


@query("SELECT page_id, " + ", ".join(
    f"len(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'g'), '<{t}[ >]')) AS n_{t}"
    for t in ("li", "p", "a", "h1", "article")) + " FROM pages")
def tag_counts(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("page_id").agg(
        *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("li", "p", "a", "h1", "article")])


@query("""SELECT page_id, len(regexp_extract_all(html, '<(?:head|meta|title|style|script)[ >]')) AS hidden,
  len(regexp_extract_all(html, '<(?:li|a|nav|ul|h1)[ >]')) AS shown FROM pages""")
def visible_elements(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    shown = structure.visible_nodes(nodes).where(F.col("tag").isin("li", "a", "nav", "ul", "h1")).groupBy("page_id").agg(
        F.count("*").alias("shown"))
    return nodes.where("hidden").groupBy("page_id").agg(F.count("*").alias("hidden")).join(shown, ["page_id"])


@query("""SELECT page_id, len(regexp_extract_all(html, '<iframe[ >]')) AS inaccessible_frames,
  CAST(regexp_matches(html, '<canvas[ >]') AS INT) AS n_limitations FROM pages""")
def page_limitations(spark, sf_dir):
    p = pages(spark, sf_dir)
    return P.page_limitations(p, page_nodes(p)).select(
        "page_id", "inaccessible_frames", F.size("limitations").alias("n_limitations"))


@query(f"""SELECT page_id, CAST(ord AS INT) AS ord, {LABEL} AS label, {ORIGIN} || {ENCODE.format(HREF)} AS target,
  coalesce(array_to_string(regexp_extract_all({LABEL}, '([^\\s,.]{{2,}})', 1), '|'), '') AS words, url AS source_url,
  {LABEL} = '' AS incomplete FROM ({LINKS})""")
def menu_records(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    records = extract_records(nodes, locate_items(nodes, [MENU]), fields_table(spark, MENU_FIELDS, "menu"))
    v = F.col("values")
    return records.select("page_id", "ord", v["label"]["str"].alias("label"), v["target"]["str"].alias("target"),
                          F.array_join(v["words"]["arr"], "|").alias("words"), "source_url", "incomplete")


@query(f"""SELECT page_id, sum(2) AS element_count, count(*) AS links, 0 AS images, sum(0) AS semantic,
  string_agg('li', ',') AS direct_tags, sum(length({LABEL})) AS text_length FROM ({LINKS}) GROUP BY page_id""")
def list_profiles(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    profiles = structure.structural_profiles(nodes, nodes.where("tag = 'ul'"))
    return profiles.select("page_id", F.col("element_count").cast("long"), F.col("links").cast("long"), "images",
                           F.col("semantic").cast("long"), F.array_join("direct_tags", ",").alias("direct_tags"),
                           F.col("text_length").cast("long"))


#: Two menu entries differ in text length only; everything else of their shape is equal.
_LIKE = "0.89 + 0.1 * least(a, b) / greatest(a, b)"


@query(f"""WITH l AS (SELECT page_id, ord, length({LABEL}) AS n FROM ({LINKS}))
SELECT x.page_id, CAST(x.ord AS INT) AS ord, round({_LIKE.replace('least(a, b)', 'least(x.n, y.n)').replace(
    'greatest(a, b)', 'greatest(x.n, y.n)')}, 6) AS similarity FROM l x JOIN l y ON x.page_id = y.page_id AND y.ord = x.ord + 1""")
def neighbour_similarity(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    items = locate_items(nodes, [MENU])
    profiles = structure.structural_profiles(nodes, items.withColumnRenamed("item", "pre"))
    shaped = items.join(profiles.withColumnRenamed("pre", "item"), ["page_id", "item"]).select(
        "page_id", "ord", structure.profile_struct().alias("p"))
    following = shaped.select("page_id", (F.col("ord") - 1).alias("ord"), F.col("p").alias("q"))
    return shaped.join(following, ["page_id", "ord"]).select(
        "page_id", "ord", F.round(structure.structural_similarity(F.col("p"), F.col("q")), 6).alias("similarity"))


@query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS members, 'li||' || '|a' AS signature FROM ({LINKS}) GROUP BY page_id")
def list_clusters(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    lists = nodes.where("tag = 'ul'").select("page_id", F.col("pre").alias("parent"))
    children = structure.repeating_children(nodes).join(lists, ["page_id", "parent"], "left_semi")
    profiles = materialize(structure.structural_profiles(nodes, children), "profiles")
    signed = profiles.select("page_id", "pre", structure.structural_signature().alias("signature"))
    return structure.cluster_children(profiles).join(signed, ["page_id", "pre"]).groupBy(
        "page_id", "container", "cluster").agg(F.count("*").alias("members"), F.first("signature").alias("signature")).select(
        "page_id", "members", "signature")


@query(f"SELECT page_id, 'li:nth-of-type(' || ord || ')' AS css FROM ({LINKS})")
def element_paths(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    return structure.node_paths(nodes, nodes.where("tag = 'li'")).select("page_id", "css")


_SCORE = f"""WITH l AS (SELECT page_id, ord, {LABEL} AS t, length({LABEL}) AS n FROM ({LINKS})),
f AS (SELECT page_id, n AS first_n FROM l WHERE ord = 1),
s AS (SELECT page_id, avg(0.89 + 0.1 * least(n, first_n) / greatest(n, first_n)) AS consistency
      FROM l JOIN f USING (page_id) WHERE ord >= 2 GROUP BY page_id),
a AS (SELECT page_id, count(*) AS items, avg(n) AS avg_text,
      avg(CASE WHEN regexp_matches(t, 'library\\s+id|price|₹|\\$|rating|email|phone|started\\s+running|minimum\\s+order', 'i')
          THEN 1.0 ELSE 0.0 END) AS cue FROM l GROUP BY page_id)
SELECT page_id, 'ul' AS container_css, ':scope > li' AS item_css, CAST(items AS BIGINT) AS item_count,
  CAST(floor(least(28.0, items * 3.5) + least(17.0, avg_text / 18) + 8 + cue * 13 + consistency * 16 + 14 + 0.5) AS INT) AS score
FROM a JOIN s USING (page_id)"""


@query(_SCORE)
def detected_menus(spark, sf_dir):
    """Detection over whole pages; the menu lists are the part that SQL can recompute."""
    candidates, _, _ = detect.detect_collections(written_nodes(spark, sf_dir))
    return candidates.where("item_tag = 'li'").select("page_id", "container_css", "item_css", "item_count", "score")


@query()
def detected_collections(spark, sf_dir):
    candidates, _, _ = detect.detect_collections(written_nodes(spark, sf_dir))
    return candidates.select("page_id", "rank", "name", "container_css", "item_css", "item_count", "score", "explanation", "n_fields")


@query()
def inferred_fields(spark, sf_dir):
    _, fields, _ = detect.detect_collections(written_nodes(spark, sf_dir))
    return fields.select("page_id", "cid", "field_no", "id", "name", "type", "attribute", "pattern", "multiple", "required",
                         F.round("confidence", 6).alias("confidence"), "explanation",
                         F.array_join(F.transform("locators", lambda x: x["css"]), ", ").alias("locators"))


@query()
def detected_records(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    _, fields, items = detect.detect_collections(nodes)
    records = extract_records(nodes, items, fields)
    return records.select("page_id", "cid", "ord", F.to_json("values").alias("values"), "fingerprint", "incomplete", "source_url")


@query(f"""SELECT page_id, CAST(count(*) AS BIGINT) AS item_count, ':scope > li' AS item_css,
  'chosen element and its likes: ' || count(*) AS explanation FROM ({LINKS}) GROUP BY page_id""")
def point_selection(spark, sf_dir):
    """Somebody clicks the first menu link of every page."""
    nodes = written_nodes(spark, sf_dir)
    chosen = nodes.where("tag = 'a'").groupBy("page_id").agg(F.min("pre").alias("pre"))
    candidates, _, _ = detect.candidate_from_element(nodes, chosen)
    return candidates.select("page_id", "item_count", "item_css", "explanation")


@query("SELECT page_id, 'a' AS css, 'url' AS type, 'href' AS attribute FROM pages WHERE regexp_matches(html, '<li>')")
def field_selection(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    second = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
    chosen = nodes.where("tag = 'a'").withColumn("n", second).where("n = 2").select(
        "page_id", F.lit("f").alias("field_id"), "pre")
    return detect.field_from_node(nodes, locate_items(nodes, [MENU]), chosen).select("page_id", "css", "type", "attribute")


@query(f"SELECT page_id, CAST(ord AS INT) AS ord, li AS html FROM ({LINKS})")
def menu_markup(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    items = locate_items(nodes, [MENU])
    return items.join(safe_html(nodes, items.withColumnRenamed("item", "pre")).withColumnRenamed("pre", "item"),
                      ["page_id", "item"]).select("page_id", "ord", "html")


@query("SELECT page_id, " + UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + " AS heading, length("
       + UNESCAPE.format("string_agg_li") + """) AS menu_chars FROM (SELECT *, array_to_string(
  regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1), '') AS string_agg_li FROM pages)""")
def element_texts(spark, sf_dir):
    nodes = written_nodes(spark, sf_dir)
    targets = nodes.where(F.col("tag").isin("h1", "ul")).select("page_id", "pre", "tag")
    texts = text_of(nodes, targets).join(targets, ["page_id", "pre"])
    return texts.groupBy("page_id").agg(F.max(F.when(F.col("tag") == "h1", F.col("text"))).alias("heading"),
                                        F.max(F.when(F.col("tag") == "ul", F.length("text"))).cast("long").alias("menu_chars"))


@query("""SELECT page_id + 1000000000 AS page_id, len(regexp_extract_all(html, '<li>')) AS n_li,
  len(regexp_extract_all(html, '<article>')) AS n_article, 0 AS inaccessible_frames FROM pages
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY page_id) = 1""")
def framed_pages(spark, sf_dir):
    """Every page framed by another page of its site: the framing page shows the framed elements."""
    inner = pages(spark, sf_dir).select("page_id", "url", "html")
    plain = F.regexp_replace("url", "#.*$", "")
    hosts = inner.groupBy(plain.alias("target")).agg(F.min("page_id").alias("page_id")).select(
        (F.col("page_id") + 1_000_000_000).alias("page_id"),
        F.concat(F.regexp_extract("target", r"^([a-z]+://[^/?#]*)", 1), F.lit("/frame/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit('<h1>Frame</h1><iframe src="'), F.replace("target", F.lit("&"), F.lit("&amp;")), F.lit('"></iframe>')).alias("html"))
    both = inner.unionByName(hosts)
    nodes = materialize(page_nodes(both), "nodes")
    from rowharvest.sources.frames import frame_links

    stitched = stitch_frames(nodes, both).where("page_id >= 1000000000")
    closed = P.page_limitations(hosts, nodes, frame_links(nodes, both)).select("page_id", F.col("inaccessible_frames").cast("int"))
    return stitched.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "li").alias("n_li"), F.count_if(F.col("tag") == "article").alias("n_article")).join(closed, ["page_id"])


@query("""SELECT page_id, 'li||' AS prefix, len(regexp_extract_all(html, '<li>')) AS n_li FROM pages WHERE page_id >= 0""")
def shadow_pages(spark, sf_dir):
    """Menus moved into an open shadow root: seen as a tree of their own, behind their host."""
    menu = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    shadowed = pages(spark, sf_dir).select("page_id", "url", F.concat(
        F.lit("<main><site-menu><template shadowrootmode=open>"), menu, F.lit("</template></site-menu></main>")).alias("html"))
    nodes = page_nodes(shadowed)
    return nodes.where("tree = 1 and tag = 'li'").groupBy("page_id").agg(
        F.lit("li||").alias("prefix"), F.count("*").alias("n_li"))
