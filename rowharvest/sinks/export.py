"""CSV, JSON and JSON Lines exports of record sets in wide form."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowharvest.fields import Field, unique_names, visible
from rowharvest.functions import values as V
from rowharvest.operators.extract import kind_of
from rowharvest.session import materialize, scratch_path

# Metadata headings (CSV) and keys (JSON) by record column.
METADATA = (("Source URL", "sourceUrl", "source_url"), ("Captured At", "capturedAt", "captured_at"),
            ("Batch ID", "batchId", "batch_id"), ("Fingerprint", "fingerprint", "fingerprint"))
BOM = "\ufeff"
CRLF = "\r\n"


def metadata_text(df: DataFrame, column: str) -> Column:
    is_time = df.schema[column].dataType.typeName().startswith("timestamp")
    return F.coalesce(V.iso_utc(F.col(column)) if is_time else F.col(column).cast("string"), F.lit(""))


def metadata_columns(df: DataFrame) -> DataFrame:
    """The lineage columns under their export headings, after all other columns."""
    names = [c for _, _, c in METADATA]
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *[metadata_text(df, c).alias(heading) for heading, _, c in METADATA])


def csv_header(fields: list[Field], metadata: bool = False) -> str:
    cells = [f.name for f in visible(fields)] + ([h for h, _, _ in METADATA] if metadata else [])
    inert = [f"'{c}" if c[:1] in ("=", "+", "-", "@") else c for c in cells]
    return ",".join('"' + c.replace('"', '""') + '"' for c in inert)


def csv_line(df: DataFrame, fields: list[Field], metadata: bool = False) -> Column:
    """One CSV row: every cell quoted, formulas neutralised, hidden fields left out."""
    cells = [V.serialize(F.col(f.id), kind_of(f)) for f in visible(fields)]
    cells += [metadata_text(df, c) for _, _, c in METADATA] if metadata else []
    return F.concat_ws(",", *[V.csv_safe(c) for c in cells])


# One ordered file, written by many tasks ------------------------------------------------------------------------

#: Bytes copied at once.
COPY_BYTES = 8 << 20


def _located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_ordered_file(lines: DataFrame, path: str, name: str, head: str, between: str, tail: str, empty: str) -> None:
    """The rows of ``lines`` (a column ``value``, in order) as the one file ``path/name``: head, rows with ``between`` them, tail.

    Every partition of the ordered rows is written by its task as a part. Where each part belongs is a prefix sum over the table of
    parts (a row each); with it the parts are copied to their places in the file side by side. A file system without writing at
    an offset gets them one after the other, from one task that neither sorts nor holds them. Without rows the file is ``empty``.
    """
    spark = lines.sparkSession
    folder = scratch_path(spark, "export")
    system, local = _located(folder)
    system.create_dir(local, recursive=True)
    gap = between.encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, size, rows = TaskContext.get(), None, 0, 0
        part = f"{folder}/{at.partitionId():08d}-{at.taskAttemptId()}"  # of this attempt alone
        for batch in batches:
            for text in batch.column("value").to_pylist():
                if out is None:
                    where, place = _located(part)
                    out = where.open_output_stream(place, buffer_size=1 << 20)
                data = gap + text.encode() if rows else text.encode()
                out.write(data)
                size, rows = size + len(data), rows + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [at.partitionId()], "name": [part], "n_bytes": [size]})

    parts = materialize(lines.select("value").mapInArrow(write, "part long, name string, n_bytes long"), "export_parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    placed = parts.select("part", "name", "n_bytes", (F.lit(len(head.encode())) + F.coalesce(F.sum("n_bytes").over(before), F.lit(0))
                                                      + (F.row_number().over(Window.orderBy("part")) - 1) * len(gap)).alias("place"))
    placed = materialize(placed, "export_places")
    n, behind = placed.agg(F.count("*"), F.max(F.col("place") + F.col("n_bytes"))).first()
    target, place = _located(path)
    target.create_dir(place, recursive=True)
    for old in target.get_file_info(pyarrow.fs.FileSelector(place)):  # an earlier export
        if old.is_file and old.base_name.startswith(("part-", ".part-", "_SUCCESS")):
            target.delete_file(old.path)
    if not n:
        with target.open_output_stream(f"{place}/{name}") as out:
            out.write(empty.encode())
    elif isinstance(target, pyarrow.fs.LocalFileSystem):
        with open(f"{place}/.{name}", "wb") as out:
            out.truncate(behind + len(tail.encode()))
            out.write(head.encode())
            out.seek(behind)
            out.write(tail.encode())
        copied = placed.repartition(n, "part").mapInArrow(_copier(f"{place}/.{name}", len(head.encode()), gap), placed.schema)
        copied.agg(F.count("*")).collect()
        os.replace(f"{place}/.{name}", f"{place}/{name}")
    else:
        whole = placed.coalesce(1).sortWithinPartitions("part").mapInArrow(_joiner(path, name, head, gap, tail), placed.schema)
        whole.agg(F.count("*")).collect()


def _pieces(name: str) -> Iterator[bytes]:
    system, place = _located(name)
    with system.open_input_stream(place) as part:
        while data := part.read(COPY_BYTES):
            yield data


def _copier(target: str, head: int, gap: bytes):
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = os.open(target, os.O_WRONLY)
                try:
                    at = row["place"]
                    if at > head:  # all but the first part come behind a gap
                        os.pwrite(out, gap, at - len(gap))
                    for data in _pieces(row["name"]):
                        os.pwrite(out, data, at)
                        at += len(data)
                finally:
                    os.close(out)
            yield batch

    return copy


def _joiner(path: str, name: str, head: str, gap: bytes, tail: str):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _located(path)
        with system.open_output_stream(f"{place}/{name}") as out:
            out.write(head.encode())
            first = True
            for batch in batches:
                for row in batch.to_pylist():
                    if not first:
                        out.write(gap)
                    first = False
                    for data in _pieces(row["name"]):
                        out.write(data)
                yield batch
            out.write(tail.encode())

    return join


def write_csv(df: DataFrame, fields: list[Field], path: str, metadata: bool = False, single_file: bool = False,
              order: str | None = None) -> None:
    """CSV with CRLF row ends, in ``order`` if given; line breaks inside cells stay as they are.

    Every part file starts with the header, so each can be opened by itself; a result without
    rows is one file with the header. A single file also gets a byte order mark; it is sorted and written by many tasks.
    """
    header = csv_header(fields, metadata)
    ordered = df.orderBy(order) if order else df
    lines = ordered.select(csv_line(df, fields, metadata).alias("value"))
    if single_file:
        opening = BOM + header + CRLF
        write_ordered_file(lines, path, "part-00000.txt", opening, CRLF, CRLF, opening)
        return
    if df.isEmpty():
        lines = df.sparkSession.range(1).coalesce(1).select(F.lit(header).alias("value"))
    else:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(header), F.lit(CRLF), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", CRLF).text(path)


def json_object(df: DataFrame, fields: list[Field], metadata: bool = False) -> Column:
    """One JSON object per row, keyed by field name in field order, nulls included."""
    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value)

    def value(f: Field) -> Column:
        kind, column = kind_of(f), F.col(f.id)
        if kind == "str":
            return V.json_text(column)
        return F.coalesce(V.number_text(column) if kind == "num" else F.to_json(column), F.lit("null"))

    parts = [member(f.name, value(f)) for f in visible(unique_names(fields))]
    if metadata:
        inner = F.concat_ws(",", *[member(key, V.json_text(metadata_text(df, c))) for _, key, c in METADATA])
        parts.append(F.concat(F.lit('"_metadata":{'), inner, F.lit("}")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def write_jsonl(df: DataFrame, fields: list[Field], path: str, metadata: bool = False, order: str | None = None) -> None:
    ordered = df.orderBy(order) if order else df
    ordered.select(json_object(df, fields, metadata).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, fields: list[Field], path: str, order: str, metadata: bool = False) -> None:
    """One JSON array in ``order``, a line for each record, in one file that many tasks write."""
    rows = df.orderBy(order).select(json_object(df, fields, metadata).alias("value"))
    write_ordered_file(rows, path, "part-00000.txt", "[", "\n,", "]\n", "[]\n")
