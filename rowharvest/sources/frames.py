"""Same-origin frames: the framed page's elements as part of the page around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowharvest.functions import values as V
from rowharvest.session import materialize


def _origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def _no_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def frame_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, iframe, child_id: frames whose source is a page of the table with the same origin.

    Where several pages share a URL the lowest page_id is meant.
    """
    sources = nodes.where((F.col("tag") == "iframe") & F.col("attrs")["src"].isNotNull()
                          & ~F.map_contains_key("attrs", "srcdoc")).select(
        "page_id", F.col("pre").alias("iframe"), "page_url",
        V.resolve_url(F.col("attrs")["src"], F.col("base_url")).alias("target"))
    same = sources.where(_origin(F.col("target")) == _origin(F.col("page_url"))).select(
        "page_id", "iframe", _no_fragment(F.col("target")).alias("target"))
    targets = pages.groupBy(_no_fragment(F.col("url")).alias("target")).agg(F.min("page_id").alias("child_id"))
    return same.join(targets, ["target"]).select("page_id", "iframe", "child_id")


def stitch_frames(nodes: DataFrame, pages: DataFrame, depth: int | None = None) -> DataFrame:
    """The node table with the trees of same-origin frames added to the framing pages.

    A framed page's elements are renumbered behind the elements of the page around it and
    keep their own tree number; its root's ``host`` is the frame element. Frames in frames are followed
    to the end (to ``depth`` levels, if given); a page inside itself is not shown again.
    """
    links = frame_links(nodes, pages)
    out, level, done = nodes, nodes, 0
    while depth is None or done < depth:
        done += 1
        frames = level.where(F.col("tag") == "iframe").select(
            F.col("page_id").alias("outer_id"), F.col("pre").alias("outer_iframe"), *(
                [F.col("origin_id").alias("page_id"), F.col("origin_pre").alias("iframe"), "trail"] if "origin_id" in level.columns
                else ["page_id", F.col("pre").alias("iframe"), F.array("page_id").alias("trail")]))
        placed = frames.join(links, ["page_id", "iframe"]).where(~F.array_contains("trail", F.col("child_id"))).select(
            F.col("outer_id"), F.col("outer_iframe"), "child_id", F.array_append("trail", F.col("child_id")).alias("trail"))
        sizes = nodes.groupBy("page_id").agg((F.max("pre") + 1).alias("n"), (F.max("tree") + 1).alias("n_trees"))
        sized = placed.join(sizes.withColumnRenamed("page_id", "child_id"), ["child_id"])
        used = out.groupBy(F.col("page_id").alias("outer_id")).agg(
            (F.max("pre") + 1).alias("start"), (F.max("tree") + 1).alias("tree_start"))
        before = Window.partitionBy("outer_id").orderBy("outer_iframe").rowsBetween(Window.unboundedPreceding, -1)
        slots = sized.join(used, ["outer_id"]).select(
            "outer_id", "outer_iframe", "child_id", "trail",
            (F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))).cast("int").alias("shift"),
            (F.col("tree_start") + F.coalesce(F.sum("n_trees").over(before), F.lit(0))).cast("int").alias("tree_shift"))
        child = nodes.withColumnRenamed("page_id", "child_id")
        moved = slots.join(child, ["child_id"])

        def shifted(name: str) -> Column:
            return F.when(F.col(name) >= 0, F.col(name) + F.col("shift")).otherwise(F.lit(-1)).alias(name)

        level = moved.select(
            F.col("outer_id").alias("page_id"), (F.col("tree") + F.col("tree_shift")).alias("tree"),
            F.when((F.col("depth") == 0) & (F.col("host") < 0), F.col("outer_iframe")).otherwise(
                F.when(F.col("host") >= 0, F.col("host") + F.col("shift")).otherwise(F.lit(-1))).alias("host"),
            (F.col("pre") + F.col("shift")).alias("pre"), (F.col("last") + F.col("shift")).alias("last"),
            shifted("parent"), "depth", "child_idx", "n_children", "nth", "tag", "id", "classes", "attrs", "chunks",
            "text_len", F.transform("ancestors", lambda a: a + F.col("shift")).alias("ancestors"), "path", "hidden",
            "page_url", "base_url", F.col("child_id").alias("origin_id"), F.col("pre").alias("origin_pre"), "trail")
        level = materialize(level, "frames")
        out = out.unionByName(level.drop("origin_id", "origin_pre", "trail"))
        if level.where(F.col("tag") == "iframe").isEmpty():
            break
    return out
