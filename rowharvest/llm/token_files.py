"""Operator 11, token-ID output: flat unsigned integer files with 64-bit document offsets, written and read in parallel."""

from __future__ import annotations

import json
import math
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import located, mapped, stored

#: Ids of one file, in bytes.
FILE_BYTES = 64 << 20
#: Documents that one reading task maps.
READ_DOCUMENTS = 1 << 14
#: Text that is encoded at once.
TEXT_BYTES = 4 << 20
#: Words kept with their ids by one worker process.
HELD_WORDS = 400_000

#: Kinds of bytes: white space, letters, digits, other ASCII, and what is not decided by one byte.
BLANK, LETTER, DIGIT, OTHER, OPEN = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[128:] = OPEN
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER


# Encoding ----------------------------------------------------------------------------------------------------------------------

def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(parts of the texts that are encoded alike wherever they stand, row of each), in order.

    Parts are cut at ASCII white space, which gives no token, and between two ASCII characters of different kind
    (letters, digits, others), where the pre-tokenizer always cuts; digits stand alone. An apostrophe stays with
    the letters behind it, and nothing is cut beside other characters, which may combine, except Latin-1 letters. A word
    that holds "<|" may hold a special token: it stays whole, and A-Z in it are not lower-cased, as all others are.
    """
    if not len(data):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # all of these two-byte characters but two are letters
    kind[lead] = kind[lead + 1] = LETTER
    a, b = kind[:-1], kind[1:]
    cut = np.ones(len(data), bool)
    cut[1:] = ((a != b) & (a != OPEN) & (b != OPEN) & ~((data[:-1] == 39) & (b == LETTER))) | (a == BLANK) | (b == BLANK) | ((a == DIGIT) & (b == DIGIT))
    folded = K.LOWER[data]
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(marks):
        blank = np.flatnonzero(kind == BLANK)
        around = np.searchsorted(blank, marks)
        first = np.where(around > 0, blank[np.maximum(around - 1, 0)] + 1, 0) if len(blank) else np.zeros(len(marks), np.int64)
        last = np.append(blank, len(data))[around]
        for low, high in set(zip(first.tolist(), last.tolist())):
            cut[low + 1:high] = False
            folded[low:high] = data[low:high]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    solid = kind != BLANK
    starts = np.flatnonzero(cut & solid)
    rows = np.searchsorted(offsets, starts, "right") - 1
    place = np.cumsum(solid, dtype=np.int32) - 1
    text = folded[solid]
    bounds = np.append(place[starts], len(text)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(text)]), rows


def _form(tokenizer) -> dict:
    """What a tokenizer does to a text before its model."""
    spec = json.loads(tokenizer.to_str())
    return {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "special": {t["content"] for t in spec["added_tokens"]}}


#: The steps before the model under which ``units`` holds; under others texts are encoded whole.
UNIT_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "special": {"<|startoftext|>", "<|endoftext|>"},
}


class Words:
    """Ids of parts of texts under one tokenizer, as the library gives them; a bounded number is kept."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = _form(self.tokenizer) != UNIT_FORM
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.kind = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.held: dict[str, bytes] = {}

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, how many of each)."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [x for x in names if x not in self.held]
        if len(self.held) + len(fresh) > HELD_WORDS:
            self.held, fresh = {}, names
        if not self.whole:  # plain lower-case words pass the steps before the model unchanged
            tokenize, pack = self.tokenizer.model.tokenize, struct.Struct
            plain = [x for x in fresh if x.isascii() and x.isalpha() and x.islower()]
            for word in plain:
                found = [token.id for token in tokenize(word)]
                self.held[word] = pack(f"<{len(found)}{self.kind.char}").pack(*found)
            fresh = [x for x in fresh if x not in self.held]
        for at in range(0, len(fresh), 10_000):
            some = fresh[at:at + 10_000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.held[word] = np.array(found.ids, self.kind).tobytes()
        ids = [self.held[x] for x in names]
        sizes = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        flat, begin = np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return flat[np.repeat(begin[codes], counts) + inner], counts


@lru_cache(maxsize=2)
def words_at(path: str, end_id: int) -> Words:
    """Loaded once per worker process, which encodes in one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path, end_id)


def blank_bounds(data: np.ndarray, limit: int) -> list[int]:
    """Bounds of parts of about ``limit`` bytes that end behind ASCII white space; a longer run without any stays whole."""
    bounds, at = [0], limit
    while at < len(data):
        while at < len(data):  # search on in steps of the limit
            found = np.flatnonzero(~K.TOKEN[data[at:at + limit]])
            if len(found):
                bounds.append(at + int(found[0]) + 1)
                break
            at += limit
        else:
            break
        at = bounds[-1] + limit
    if bounds[-1] < len(data):
        bounds.append(len(data))
    return bounds


def encode_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids, then ``end_id``, as little-endian unsigned integers of the vocabulary's width."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_at(tokenizer_path, end_id)
        end = np.array([end_id], words.kind)
        for batch in batches:
            for first, stop, data, offsets in K.slices(batch.column("text"), TEXT_BYTES):
                out, n = [], stop - first
                if words.whole:
                    out = [words.encode(pa.array([text or ""]))[0].tobytes() + end.tobytes() for text in batch.column("text").slice(first, n).to_pylist()]
                elif n == 1:  # perhaps a very long text
                    bounds = blank_bounds(data, TEXT_BYTES)
                    out = [words.encode(units(data[a:b], np.array([0, b - a]))[0])[0] for a, b in zip(bounds, bounds[1:])]
                    out = [np.concatenate([*out, end]).tobytes()]
                else:
                    parts, rows = units(data, offsets)
                    ids, counts = words.encode(parts)
                    ends = np.cumsum(np.bincount(rows, weights=counts, minlength=n).astype(np.int64))
                    out = [x.tobytes() + end.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array([len(x) // words.kind.itemsize for x in out], pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_tokens long, ids binary")


# Files -------------------------------------------------------------------------------------------------------------------------

def _numbers(path: str, kind: str) -> np.ndarray:
    return np.frombuffer(mapped(path), kind)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1, file_bytes: int = FILE_BYTES,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the id column, below ``path``.

    ``path`` is a folder (or its URI) that the driver and all executors share. Every file of ids is a flat sequence of little-endian unsigned
    integers (16 bits where the vocabulary allows, else 32) and has two companions: ``.offsets``, unsigned 64-bit
    places of its documents in the whole corpus (one more than documents), and ``.keys``, an Arrow file with their ids
    and lengths. ``path/files`` is a Parquet table with a row per file in corpus order; the same rows are returned.

    Texts are encoded once and written; rows are dealt by ranges of (id, hash of the ids), so one id of very many rows is
    many files, and each range is sorted and written by its task. How many ids lie before a file is a
    prefix sum over the table of files, a row each; with it a second pass writes the offsets. A task that runs
    again writes files of its own name: only those of the finished attempt are in the table.

    A null text is empty: its end only. Rows that repeat an id are documents of their own, ordered by a hash; null ids come first;
    other columns are ignored; an empty table gives an empty table of files. A very long text is encoded in parts.
    """
    spark = docs.sparkSession
    encoded = stored(encode_ids(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), "token-ids")
    kind = dict(encoded.dtypes)["doc_id"]
    width = words_at(tokenizer_path, end_id).kind.itemsize
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    system, local = located(path)
    system.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, keys, sizes = TaskContext.get(), [], []
        name = f"{path}/{context.partitionId():08d}-{context.taskAttemptId()}"
        at, out = None, None
        for batch in batches:
            if out is None:
                at, local = located(name)
                out = at.open_output_stream(f"{local}.ids")
            column = batch.column("ids")
            _, bounds, data = column.buffers()
            bounds = np.frombuffer(bounds, np.int32, len(column) + 1, column.offset * 4)
            out.write(data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])))
            keys.append(batch.column("doc_id"))
            sizes.append(batch.column("n_tokens"))
        if out is not None:
            out.close()
            table = pa.table({"doc_id": pa.chunked_array(keys), "n_tokens": pa.chunked_array(sizes)})
            with at.open_output_stream(f"{local}.keys") as stream, pa.ipc.new_file(stream, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name.rsplit("/", 1)[-1]], "n_documents": [len(table)],
                                              "n_ids": [pa.compute.sum(table.column("n_tokens")).as_py()]})

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, local = located(f"{path}/{row['name']}")
                sizes = pa.ipc.open_file(mapped(f"{path}/{row['name']}.keys")).read_all().column("n_tokens").to_numpy()
                with at.open_output_stream(f"{local}.offsets") as stream:
                    stream.write(np.concatenate(([row["base"]], row["base"] + np.cumsum(sizes))).astype("<u8").tobytes())
            yield batch

    files = max(1, math.ceil(total * width / file_bytes))
    ordered = encoded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie")
    listed = stored(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(write, "part long, name string, n_documents long, n_ids long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = listed.select("part", "name", "n_documents", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
                          F.lit(width).alias("width"), F.lit(kind).alias("key_type"))
    spread = min(files, 4 * spark.sparkContext.defaultParallelism)
    based.repartition(spread).mapInArrow(offsets, based.schema).write.parquet(f"{path}/files")
    return spark.read.schema(based.schema).parquet(f"{path}/files")


def map_documents(spark: SparkSession, path: str, function: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that ``function`` gives for consecutive documents of the files: it gets their ids, their offsets in the corpus (one
    more) and a mapped array of all their token ids."""
    files = spark.read.parquet(f"{path}/files")
    ranges = files.select("name", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_documents") - 1, F.lit(READ_DOCUMENTS).cast("long"))).alias("low"))
    ranges = ranges.repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/{row['name']}"
                keys = pa.ipc.open_file(mapped(f"{name}.keys")).read_all().column("doc_id").combine_chunks()
                places, ids = _numbers(f"{name}.offsets", "<u8").astype(np.int64), _numbers(f"{name}.ids", f"<u{row['width']}")
                at, stop = row["low"], min(len(keys), row["low"] + READ_DOCUMENTS)
                while at < stop:
                    to = min(stop, max(at + 1, int(np.searchsorted(places, places[at] + K.SLICE_BYTES, "right")) - 1))
                    yield function(keys.slice(at, to - at), places[at:to + 1], ids[places[at] - places[0]:places[to] - places[0]])
                    at = to

    return ranges.mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files below ``path``; ids as written, start counts all ids before."""
    first = spark.read.parquet(f"{path}/files").select("key_type").first()

    def rows(keys: pa.Array, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        at = (places - places[0]) * ids.itemsize
        column = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])
        return pa.RecordBatch.from_arrays([keys, pa.array(places[:-1]), pa.array(np.diff(places)), column.cast(pa.binary())],
                                          names=["doc_id", "start", "n_tokens", "ids"])

    return map_documents(spark, path, rows, f"doc_id {first['key_type'] if first else 'long'}, start long, n_tokens long, ids binary")


class TokenFiles:
    """Reads any stretch of the corpus from mapped files, as a training job does: positions run over all files."""

    def __init__(self, path: str):
        import pyarrow.parquet

        system, local = located(path)
        rows = sorted(pyarrow.parquet.read_table(f"{local}/files", filesystem=system).to_pylist(), key=lambda r: r["part"])
        self.path, self.files, self.bases = path, rows, [r["base"] for r in rows]
        self.n_ids = rows[-1]["base"] + rows[-1]["n_ids"] if rows else 0
        self.first = np.concatenate(([0], np.cumsum([r["n_documents"] for r in rows]))).astype(np.int64)  # documents before each file

    def _ids(self, file: int) -> np.ndarray:
        return _numbers(f"{self.path}/{self.files[file]['name']}.ids", f"<u{self.files[file]['width']}")

    def window(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from position ``start`` on, fewer at the end of the corpus."""
        parts, stop = [np.empty(0, np.uint32)], min(start + length, self.n_ids)
        while start < stop:
            file = bisect_right(self.bases, start) - 1
            part = self._ids(file)[start - self.bases[file]:stop - self.bases[file]]
            parts.append(part.astype(np.uint32))
            start += len(part)
        return np.concatenate(parts)

    def document(self, number: int) -> np.ndarray:
        """The ids of the document with this number in file order, its end included."""
        file = int(np.searchsorted(self.first, number, "right")) - 1
        places = _numbers(f"{self.path}/{self.files[file]['name']}.offsets", "<u8").astype(np.int64)
        at = number - int(self.first[file])
        return self.window(int(places[at]), int(places[at + 1] - places[at]))
