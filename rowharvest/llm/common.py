"""What several operators share: written intermediates, files, Arrow helpers, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowharvest.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back: a cut in the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path))


def mapped(path: str) -> pa.Buffer:
    """A file's bytes: mapped where the file system is mounted, else read."""
    system, path = located(path)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return file.read_buffer()
    with system.open_input_file(path) as file:
        return file.read_buffer()


def remainder(id_column: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id is the text ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column, F.lit("")).cast("binary")) % divisor


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task's arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that links reach.

    Alternating star contraction on the edge table: every round moves each node's neighbours to its least
    neighbour, first the larger ones, then the smaller ones. Rounds grow with the logarithm of the longest
    path. Both steps are a partial aggregation and a join, so a node with very many links is no group in one
    task (a skewed join is split). Each round is written to the shared folder; only two numbers reach the driver.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links, before = stored(links, "links"), None
    while True:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u > v").unionAll(
            least.select("u", F.col("m").alias("v"))).distinct()
        links = stored(small, "links")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of links that already connect all that the links (a, b) connect: at most one per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def table_reader(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
