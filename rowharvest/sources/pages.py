"""Page tables: reading, URL policy, page facts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowharvest import schemas
from rowharvest.functions import values as V

# URLs that are never read, and hosts that call for care.
RESTRICTED_URL = r"(?i)^(chrome|chrome-extension|edge|about|devtools|view-source):|^https?://chrome\.google\.com/webstore"
FETCHABLE_URL = r"^https?:|^file:"
SENSITIVE_HOST = r"(?i)(^|\.)(bank|banking|paypal|stripe|checkout|wallet|auth|login)\b"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page table (page_id, url, html) with its host."""
    return spark.read.parquet(path).withColumn("host", V.host_of(F.col("url")))


def is_restricted_url(url: Column) -> Column:
    return url.rlike(RESTRICTED_URL)


def is_fetchable(url: Column) -> Column:
    return url.rlike(FETCHABLE_URL) & ~is_restricted_url(url)


def is_sensitive_host(host: Column) -> Column:
    return host.rlike(SENSITIVE_HOST)


def filter_fetchable(pages: DataFrame) -> DataFrame:
    return pages.where(is_fetchable(F.col("url")))


def parse_domains(text: str) -> list[str]:
    """A typed block list: split at newlines and commas, trimmed, lower case."""
    return sorted({p.strip().lower() for p in text.replace("\n", ",").split(",") if p.strip()})


def domain_suffixes(host: Column) -> Column:
    """``a.b.c`` as [``a.b.c``, ``b.c``, ``c``]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def blocked_hosts(pages: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hosts of ``pages`` that equal a blocked domain or lie below one.

    Works on the distinct hosts, so the suffix explosion never touches page rows.
    """
    hosts = pages.select("host").distinct()
    suffixes = hosts.select("host", F.explode(domain_suffixes(F.col("host"))).alias("domain"))
    return suffixes.join(blocked.select(F.lower(F.trim("domain")).alias("domain")).distinct(), ["domain"],
                       "left_semi").select("host").distinct()


def drop_blocked(pages: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pages whose host is not on the block list (``domain`` column)."""
    return pages.join(blocked_hosts(pages, blocked), ["host"], "left_anti")


def page_titles(nodes: DataFrame) -> DataFrame:
    """page_id, title: text of the first ``title`` in the head."""
    titles = nodes.where((F.col("tag") == "title") & (F.col("tree") == 0))
    text = F.array_join(F.transform("chunks", lambda c: F.coalesce(c["raw"], c["txt"])), "")
    return titles.groupBy("page_id").agg(F.min_by(V.collapse_space(text), "pre").alias("title"))


PDF_NOTE = "a PDF file: it has no elements"
CANVAS_NOTE = "drawn on a canvas: hardly any text in elements"
CLOSED_NOTE = "custom elements without content: closed shadow roots cannot be read"


def page_limitations(pages: DataFrame, nodes: DataFrame, stitched: DataFrame | None = None) -> DataFrame:
    """page_id, inaccessible_frames, limitations: what cannot be read on a page.

    Frames count as inaccessible unless they carry their own document or are listed in
    ``stitched`` (page_id, iframe). One aggregation over the nodes of each page.
    """
    hosts = nodes.where("depth = 0 and host >= 0").groupBy("page_id", F.col("host").alias("pre")).agg(
        F.lit(True).alias("opened"))
    if stitched is not None:
        hosts = hosts.unionByName(stitched.select("page_id", F.col("iframe").alias("pre")).distinct().withColumn(
            "opened", F.lit(True)))
    marked = nodes.where(F.col("tag").isin("canvas", "iframe", "body", "embed", "object") | F.col("tag").contains("-"))
    facts = marked.join(hosts, ["page_id", "pre"], "left").groupBy("page_id").agg(
        F.max(F.col("tag") == "canvas").alias("canvas"),
        F.max(F.when((F.col("tag") == "body") & (F.col("tree") == 0), F.col("text_len"))).alias("body_text"),
        F.count_if((F.col("tag") == "iframe") & F.col("opened").isNull()).alias("closed_frames"),
        F.max(F.col("tag").contains("-") & (F.col("n_children") == 0) & F.col("opened").isNull()).alias("closed_parts"),
        F.max(F.col("tag").isin("embed", "object") & (F.coalesce(F.col("attrs")["type"], F.lit("")) == "application/pdf"))
        .alias("embedded_pdf"))
    pdf = F.col("html").startswith("%PDF-") | F.coalesce("embedded_pdf", F.lit(False))
    notes = F.array_compact(F.array(
        F.when(pdf, PDF_NOTE),
        F.when(F.coalesce("canvas", F.lit(False)) & (F.coalesce("body_text", F.lit(0)) < 50), CANVAS_NOTE),
        F.when(F.coalesce("closed_parts", F.lit(False)), CLOSED_NOTE)))
    return pages.select("page_id", F.substring("html", 1, 5).alias("html")).join(facts, ["page_id"], "left").select(
        "page_id", F.coalesce("closed_frames", F.lit(0)).cast("long").alias("inaccessible_frames"),
        notes.alias("limitations"))


# -- S10, C7 snapshots ----------------------------------------------------------------------


def read_snapshots(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of page states: page_id, url, html, snapshot_ts."""
    reader = spark.readStream.schema(schemas.SNAPSHOT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def snapshot_key(snapshots: DataFrame) -> DataFrame:
    """Pages whose ``page_id`` names one state of one URL of a page.

    Several states of a page can then be parsed side by side, and a new URL is a new page.
    """
    stamp = F.unix_micros("snapshot_ts").cast("string")
    return snapshots.withColumn("page_id", F.concat_ws("@", F.col("page_id").cast("string"), stamp))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest state of every page.

    The newest moment is found on the narrow columns; the map-side maximum keeps a page
    that holds most of the rows from loading one task, and html is read for winners only.
    """
    newest = snapshots.groupBy("page_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    kept = snapshots.join(newest, ["page_id", "snapshot_ts"], "left_semi")
    return kept.dropDuplicates(["page_id", "snapshot_ts"])


def page_sessions(snapshots: DataFrame) -> DataFrame:
    """Adds session_id: one per page and URL, so navigation starts a new session."""
    return snapshots.withColumn("session_id", F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), "url"), 256))


