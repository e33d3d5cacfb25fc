"""Operator 13, source divergence audit: run-length coded term columns of the sources of each language, compared pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import stored

#: Scale of a term's share.
ONE = 1_000_000_000
#: Text whose terms are counted at once, terms of a block of columns, sources of a tile, and columns the vocabulary is ordered by.
TEXT_BYTES, BLOCK_TERMS, TILE, LEADING = 4 << 20, 1 << 16, 64, 6

_TERM = np.full(256, 32, np.uint8)  # letters, A-Z lower-cased, and all beyond ASCII; any other byte is a space
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms, row of each): runs of letters and characters beyond ASCII, A-Z lower-cased."""
    text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_TERM[data])])
    lists = pc.ascii_split_whitespace(text)
    found, rows = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(found, "")
    return found.filter(solid).dictionary_encode(), rows.filter(solid).to_numpy()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, documents) of slices of the texts."""

    def rows_of(groups: pa.Table, group: np.ndarray, term: pa.Array, n: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([groups.column("lang").combine_chunks().take(pa.array(group)), groups.column("source").combine_chunks().take(pa.array(group)),
                                           term, pa.array(n), pa.array(documents)], names=["lang", "source", "term", "n", "documents"])

    for batch in batches:
        for first, stop, data, offsets in K.slices(batch.column("text"), TEXT_BYTES):
            labels = pa.table({c: batch.column(c).slice(first, stop - first) for c in ("lang", "source")})
            if stop - first == 1:  # perhaps a very long text: in parts, each term's document counted once
                counts: dict[str, int] = {}
                step = _parts(data, TEXT_BYTES)
                for a, b in zip(step, step[1:]):
                    coded, _ = terms_of(data[a:b], np.array([0, b - a]))
                    for term, n in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()):
                        counts[term] = counts.get(term, 0) + n
                names = pa.array(list(counts), pa.string())
                yield rows_of(labels, np.zeros(len(names), np.int64), names, np.array(list(counts.values()), np.int64), np.ones(len(names), np.int64))
                continue
            coded, rows = terms_of(data, offsets)
            code = coded.indices.to_numpy().astype(np.int64)
            width = max(1, len(coded.dictionary))
            seen, times = np.unique(rows * width + code, return_counts=True)  # documents x terms
            groups = labels.group_by(["lang", "source"], use_threads=False).aggregate([])
            number = {(g["lang"], g["source"]): i for i, g in enumerate(groups.to_pylist())}
            group = np.array([number[x["lang"], x["source"]] for x in labels.to_pylist()], np.int64)
            both, inverse = np.unique(group[seen // width] * width + seen % width, return_inverse=True)
            yield rows_of(groups, both // width, coded.dictionary.cast(pa.string()).take(pa.array(both % width)),
                          np.bincount(inverse, weights=times, minlength=len(both)).astype(np.int64), np.bincount(inverse, minlength=len(both)).astype(np.int64))


def _parts(data: np.ndarray, limit: int) -> list[int]:
    """Bounds of parts of about ``limit`` bytes that do not cut a term; a longer term stays whole."""
    bounds, at = [0], limit
    while at < len(data):
        found = np.flatnonzero(_TERM[data[at:at + limit]] == 32)
        if len(found):
            bounds.append(at + int(found[0]) + 1)
            at = bounds[-1]
        at += limit
    return bounds + [len(data)] if bounds[-1] < len(data) else bounds


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact at any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(ONE).cast("decimal(10,0)"), wide(F.greatest(total + 2 * terms, F.lit(1))))


def gap(p, q):
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits a long."""
    return (p - q) * (p - q) // (p + q)


def runs_of(places: np.ndarray, values: np.ndarray, size: int, absent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, value) of each run of equal values in a column of ``size`` places, ``absent`` where none is given; places ascend."""
    if not len(places):
        return np.zeros(min(size, 1), np.int64), np.full(min(size, 1), absent, np.int64)
    behind = places + 1
    free = np.flatnonzero(behind < np.append(places[1:], size))  # a place without a value follows
    starts, kept = np.concatenate([places, behind[free]]), np.concatenate([values, np.full(len(free), absent, np.int64)])
    if places[0] > 0:
        starts, kept = np.append(starts, 0), np.append(kept, absent)
    order = np.argsort(starts, kind="stable")
    starts, kept = starts[order], kept[order]
    new = np.append(True, kept[1:] != kept[:-1])
    return starts[new], kept[new]


def compared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of ``gap`` over all places of two run-length columns: run bounds are intersected, each stretch counts by its length."""
    bounds = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], bounds, "right") - 1], b[1][np.searchsorted(b[0], bounds, "right") - 1]
    return int((gap(p, q) * np.diff(np.append(bounds, size))).sum())


def source_divergence(docs: DataFrame, *, min_documents: int = 10, top_terms: int = 10, block_terms: int = BLOCK_TERMS, tile: int = TILE,
                      text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps the V terms of
    ``min_documents`` of its documents or more. A (lang, source) group, and a language, gives a kept term the share
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms. Two shares differ by floor((p - q)^2 / (p + q)).
    Part 'pair': for every other source of the language (item), the sum over the kept terms (0 without any), all ranks. Part 'term': the
    kept terms a group has with a share above its language's, by that difference, up to rank ``top_terms``. Ties go to the lesser item.

    Terms are counted in one pass over the texts and pre-aggregated. The vocabulary of a language is ordered by the counts in its
    ``LEADING`` largest groups, then by total and a signature of all counts, so that equal counts stand together, and
    dealt by ranges into blocks of about ``block_terms``. In each block a group's shares are a run-length column (absent terms are
    long runs). Columns of ``tile`` sources at a time meet those of another tile, block by block: bounds of the
    runs are intersected and each difference is multiplied by the length. A task holds two tiles of one block, whatever the number of
    terms or sources. The term part needs single terms and is a row-wise top list, limited before its shuffle.

    A null text, language or source counts as ''. Every row is a document: repeated rows count each; other columns, the id among them, are
    ignored; an empty table gives an empty result. A very long text is counted in parts.
    """
    labelled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    pairs = labelled.select("lang", "source").distinct()
    counts = labelled.mapInArrow(_counts, "lang string, source string, term string, n long, documents long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "term-counts")
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).where(
        F.col("documents") >= min_documents).select("lang", "term", "total"), "kept-terms")
    kept = stored(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept-counts")
    languages = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = pairs.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["size", "terms", "lang_total"])
    by_size = Window.partitionBy("lang").orderBy(F.desc("size"), "source")  # a row per source
    groups = stored(groups.withColumn("number", F.row_number().over(by_size) - 1), "source-groups")

    # the vocabulary in blocks
    leading = kept.join(groups.select("lang", "source", "number"), ["lang", "source"])
    keys = [F.coalesce(F.max(F.when(F.col("number") == i, F.col("n"))), F.lit(0)).alias(f"lead{i}") for i in range(LEADING)]
    keys.append(F.max("total").alias("total"))
    keys.append(F.sum(F.xxhash64("number", "n").cast("decimal(38,0)")).alias("signature"))
    vocabulary = leading.groupBy("lang", "term").agg(*keys)
    order = ["lang", *[f"lead{i}" for i in range(LEADING)], "total", "signature", "term"]
    blocks = max(1, -(-terms.count() // block_terms))
    placed = stored(vocabulary.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("lang", "term").mapInArrow(
        _numbered, "lang string, term string, block long, place long"), "vocabulary")
    lengths = placed.groupBy("lang", "block").agg(F.count("*").alias("length"))

    # columns, a row per language, block and source; block -1 is a column of no place, which every group has
    column = groups.select("lang", "source", "number", share(F.lit(0).cast("long"), F.col("size"), F.col("terms")).alias("absent"), "size", "terms")
    shares = kept.join(column, ["lang", "source"]).join(placed, ["lang", "term"]).select(
        "lang", "block", "number", "place", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"))
    entries = shares.groupBy("lang", "block", "number").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("entries"))  # of one block: bounded
    everywhere = lengths.unionAll(groups.select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("length")).distinct())
    wide = column.select("lang", "source", "number", "absent").join(everywhere, "lang").join(entries, ["lang", "block", "number"], "left")
    coded = stored(wide.select("lang", "block", "source", "number", "length", "absent", "entries").mapInArrow(
        _run_length, "lang string, block long, source string, number int, length long, starts binary, shares binary"), "run-columns")

    # tiles against tiles
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / tile)).cast("int").alias("last"))
    mine = F.floor(F.col("number") / tile).cast("int")
    dealt = coded.withColumn("tile", mine).join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", "length", "starts", "shares")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_tile_pairs, "lang string, source string, item string, value long").groupBy(
        "lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionAll(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    # single terms
    found = kept.join(groups.select("lang", "source", "size", "terms", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q")).where("p > q")
    found = found.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(sums, "pair").unionAll(ranked(found, "term").where(F.col("rank") <= top_terms))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition with its number and their place among those of their language."""
    from pyspark import TaskContext

    block, place, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        new = np.flatnonzero(np.append([lang[0] != last], lang[1:] != lang[:-1])) if len(lang) else np.empty(0, np.int64)
        at = np.arange(len(lang)) + place
        for i in new.tolist():
            at[i:] -= at[i]
        if len(lang):
            place, last = int(at[-1]) + 1, lang[-1]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(np.full(len(lang), block, np.int64)), pa.array(at)],
                                         names=["lang", "term", "block", "place"])


def _run_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, shares = [], []
        for i in range(batch.num_rows):
            entries = batch.column("entries")[i].values
            place, p = (entries.field(c).to_numpy() for c in ("place", "p")) if entries is not None else (np.empty(0, np.int64),) * 2
            runs = runs_of(place, p, batch.column("length")[i].as_py(), batch.column("absent")[i].as_py())
            starts.append(runs[0].astype(np.int64).tobytes())
            shares.append(runs[1].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lang", "block", "source", "number", "length")], pa.array(starts, pa.binary()), pa.array(shares, pa.binary())],
                                         names=["lang", "block", "source", "number", "length", "starts", "shares"])


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Every pair of columns of a block between two tiles, or inside one, once."""
    rows = table.select(["tile", "source", "length", "starts", "shares"]).sort_by("source").to_pylist()
    columns = [(r["tile"], r["source"], (np.frombuffer(r["starts"], np.int64), np.frombuffer(r["shares"], np.int64))) for r in rows]
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    size, out = rows[0]["length"], []
    for i, (tile, source, runs) in enumerate(columns):
        if tile == low:
            for j, (other, item, theirs) in enumerate(columns):
                if other == high and (low != high or i < j):
                    out.append((source, item, compared(runs, theirs, size) if size else 0))
    source, item, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(out), pa.string()), "source": pa.array(source, pa.string()),
                     "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})
