"""Operator 9, benchmark decontamination: SimHash of item-sized windows, found by Hamming blocks, verified exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import stored

SHINGLE = 5
BITS = 256
#: The index proposes every item whose fingerprint is within this distance. With equal weights, texts of similarity 0.8
#: differ in 39 bits on average (deviation 5.7); unequal weights can put them further apart, which the audit makes up for.
RADIUS = 47
#: 16 blocks of 16 bits: of fingerprints that differ in at most RADIUS bits, some block differs in at most NEAR bits.
BLOCKS, BLOCK_BITS = 16, 16
NEAR = RADIUS // BLOCKS
_PARTS = K.mix(np.arange(101, 105, dtype=np.uint64))
#: All ways to change up to NEAR bits of a block: 137 of 65,536.
_FLIPS = np.array([sum(1 << bit for bit in bits) for n in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), n)])


def text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of rows, word hashes, row of each word) by slices of the column."""
    for first, stop, data, offsets in K.slices(column):
        starts, ends, rows = K.words(data, offsets)
        yield stop - first, K.run_hashes(data, starts, ends, lower=True), rows


def window_shingles(hashes: np.ndarray) -> np.ndarray:
    """Shingles of one run of words: five words, or all of them if they are fewer."""
    return K.shingles(hashes, np.zeros(len(hashes), np.int64), 1, SHINGLE)[0]


def fingerprint(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """256-bit SimHash as 32 bytes: each bit is the sign of the weights' sum."""
    wide = K.mix(shingles[:, None] ^ _PARTS).view(np.uint8).reshape(len(shingles), BITS // 8)
    bits = np.unpackbits(wide, axis=1).astype(np.float32) * 2 - 1
    return np.packbits((bits * weights[:, None]).sum(axis=0) > 0)


class HammingIndex:
    """Fingerprints by the value of each of their blocks: finds all within RADIUS by looking up the values near a block's own.

    Two unlike fingerprints have a block in common that is so near with a chance of 16 * 137 / 65,536: 3 %.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view(np.uint16).astype(np.int64)
        self.order = np.argsort(blocks, axis=0, kind="stable").T.astype(np.int32)  # fingerprints by block value, block after block
        self.bounds = np.stack([np.searchsorted(np.sort(blocks[:, b]), np.arange((1 << BLOCK_BITS) + 1)) for b in range(BLOCKS)]).astype(np.int32)

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """Distinct fingerprints of which a block is at most NEAR bits away: all within RADIUS are among them."""
        values = print_.view(np.uint16).astype(np.int64)[:, None] ^ _FLIPS
        own = np.arange(BLOCKS)[:, None]
        first, last = self.bounds[own, values], self.bounds[own, values + 1]
        block, flip = np.nonzero(last > first)
        found = [self.order[b, i:j] for b, i, j in zip(block.tolist(), first[block, flip].tolist(), last[block, flip].tolist())]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)

    def within(self, print_: np.ndarray) -> np.ndarray:
        """Every fingerprint within RADIUS of this one."""
        found = self.candidates(print_)
        return found[np.unpackbits(self.prints[found] ^ print_, axis=1).sum(axis=1) <= RADIUS]


class Items:
    """Benchmark items of one bounded slice: seeds and indexed fingerprints, with the shingle weights of the whole benchmark.

    ``whole`` has the number of items with words, the ascending shingles that two items or more have, and in how many
    items each is; without it, the items here are the whole benchmark.
    """

    def __init__(self, item_ids: list, texts: list[str | None], threshold: float, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.threshold = threshold
        column = pa.array(texts, pa.large_string())
        runs: list[np.ndarray] = []
        for n, hashes, rows in text_words(column):
            runs += np.split(hashes, np.cumsum(np.bincount(rows, minlength=n))[:-1])
        kept = [i for i, run in enumerate(runs) if len(run)]  # an item without a word matches nothing
        self.ids, runs = [item_ids[i] for i in kept], [runs[i] for i in kept]
        self.words = np.array([len(run) for run in runs], dtype=np.int64)
        sets = [window_shingles(run) for run in runs]
        if whole is None:
            value, n = np.unique(np.concatenate([np.unique(x) for x in sets]) if sets else np.empty(0, np.uint64), return_counts=True)
            whole = len(sets), value[n > 1], n[n > 1]
        total, self.common, seen = whole
        #: A shingle of many items says less; one of a single item weighs as one that no item has: most.
        self.other = 1 + math.log1p(total)
        self.common_weights = 1 + np.log((1 + total) / seen)
        self.counts = [Counter(x.tolist()) for x in sets]
        weights = [self.weigh(c) for c in self.counts]
        #: The items' shingles, one item after the other, with times and weights.
        self.bounds = np.concatenate(([0], np.cumsum([len(c) for c in self.counts]))).astype(np.int64)
        self.flat = np.array([s for c in self.counts for s in c], np.uint64)
        self.flat_times = np.array([n for c in self.counts for n in c.values()], np.float64)
        self.flat_weights = np.concatenate([*weights, np.empty(0)])
        self.totals = np.array([w @ list(c.values()) for c, w in zip(self.counts, weights)])
        self.weights = [dict(zip(c, w.tolist())) for c, w in zip(self.counts, weights)]
        prints = [fingerprint(np.array(list(c), np.uint64), (w * list(c.values())).astype(np.float32)) for c, w in zip(self.counts, weights)]
        self.prints = np.array(prints, np.uint8).reshape(-1, BITS // 8)
        self.index = HammingIndex(self.prints)
        #: (sorted shingles, item of each, offset of each) by shingle length: items under five words have one of their own length
        self.seeds = {}
        for size in sorted({min(SHINGLE, int(n)) for n in self.words}):
            mine = [i for i, n in enumerate(self.words) if min(SHINGLE, int(n)) == size]
            value = np.concatenate([sets[i] for i in mine])
            order = np.argsort(value, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.seeds[size] = (bitmap, value[order], np.concatenate([np.full(len(sets[i]), i) for i in mine])[order],
                                np.concatenate([np.arange(len(sets[i])) for i in mine])[order])

    def weigh(self, shingles: Counter) -> np.ndarray:
        """Weight of one occurrence of each shingle, in the counter's order."""
        weights, asked = np.full(len(shingles), self.other), np.array(list(shingles), np.uint64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, asked), len(self.common) - 1)
            hit = self.common[at] == asked
            weights[hit] = self.common_weights[at[hit]]
        return weights

    def starts(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (row, item, first word) of the windows to look at.

        A window as similar as asked shares a shingle with its item, and the best one starts between the
        least and the greatest start that a shared shingle points to; starts between close ones are filled in.
        """
        found = []
        for size, (bitmap, value, item, offset) in self.seeds.items():
            own, row, place = K.shingles(hashes, rows, n_rows, size)
            short = counts[row] < size  # stands for a whole shorter text: never equal to an item's shingle of this length
            hit = np.flatnonzero(bitmap[(own & np.uint64(0xFFFFF)).astype(np.int64)] & ~short)
            left, right = np.searchsorted(value, own[hit], "left"), np.searchsorted(value, own[hit], "right")
            times = right - left
            if not times.sum():
                continue
            hit = np.repeat(hit, times)
            at = np.repeat(left - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            begin = place[hit] - first[row[hit]] - offset[at]
            begin = np.clip(begin, 0, np.maximum(counts[row[hit]] - self.words[item[at]], 0))
            found.append(np.unique(np.stack([row[hit], item[at], begin], axis=1), axis=0))
        if not found:
            return np.empty((0, 3), np.int64)
        windows = np.concatenate(found)
        same = np.flatnonzero((windows[1:, 0] == windows[:-1, 0]) & (windows[1:, 1] == windows[:-1, 1]))
        gap = windows[same + 1, 2] - windows[same, 2]
        near = (gap > 1) & (gap <= self.words[windows[same, 1]] // 4)
        same, gap = same[near], gap[near] - 1
        if len(same):
            between = np.repeat(windows[same], gap, axis=0)
            between[:, 2] += 1 + np.arange(gap.sum()) - np.repeat(np.concatenate(([0], np.cumsum(gap)[:-1])), gap)
            windows = np.concatenate([windows, between])
        return windows

    def similarity(self, item: int, window: Counter, weights: dict[int, float]) -> float:
        """Weighted Jaccard similarity of the shingle multisets; ``weights`` are of the window's shingles."""
        own, shared, total = self.counts[item], 0.0, 0.0
        for s, n in window.items():
            weight, m = weights[s], own.get(s, 0)
            shared += weight * min(n, m)
            total += weight * max(n, m)
        total += sum(self.weights[item][s] * n for s, n in own.items() if s not in window)
        return shared / total if total else 0.0

    def similar(self, tried: np.ndarray, window: Counter, weights: np.ndarray) -> np.ndarray:
        """The items among those tried that may reach the threshold: all at once, with room for rounding."""
        shingles, times = np.array(list(window), np.uint64), np.array(list(window.values()), np.float64)
        order = np.argsort(shingles)
        sizes = self.bounds[tried + 1] - self.bounds[tried]
        start = np.cumsum(sizes) - sizes
        at = np.repeat(self.bounds[tried] - start, sizes) + np.arange(sizes.sum())
        place = order[np.minimum(np.searchsorted(shingles, self.flat[at], sorter=order), len(order) - 1)]
        both = np.where(shingles[place] == self.flat[at], np.minimum(times[place], self.flat_times[at]), 0) * self.flat_weights[at]
        shared = np.add.reduceat(both, start)
        return tried[shared >= (self.threshold - 1e-6) * (weights @ times + self.totals[tried] - shared)]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, distance, similarity): the best window of each row and item that reaches the threshold."""
        done = 0
        for n, hashes, rows in text_words(column):
            counts = np.bincount(rows, minlength=n)
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            windows: dict[tuple[int, int, int], set[int]] = {}
            for row, item, begin in self.starts(hashes, rows, n, first, counts).tolist():
                windows.setdefault((row, begin, min(int(self.words[item]), int(counts[row]))), set()).add(item)
            for (row, begin, length), proposed in windows.items():
                at = first[row] + begin
                window = Counter(window_shingles(hashes[at:at + length]).tolist())
                weights = self.weigh(window)
                print_ = fingerprint(np.array(list(window), np.uint64), (weights * list(window.values())).astype(np.float32))
                sizes = {int(self.words[item]) for item in proposed}
                # What the index proposes, and as an audit the items that share a shingle with the window, at any distance.
                tried = {item for item in self.index.within(print_).tolist() if int(self.words[item]) in sizes} | proposed
                by_shingle = dict(zip(window, weights.tolist()))
                for item in self.similar(np.array(sorted(tried)), window, weights).tolist():
                    value = self.similarity(item, window, by_shingle)
                    if value >= self.threshold and (value, -begin) > best.get((row, item), (0.0, 0, 0))[:2]:
                        best[row, item] = value, -begin, int(np.unpackbits(self.prints[item] ^ print_).sum())
            for (row, item), (value, begin, distance) in sorted(best.items()):
                yield done + row, item, -begin, distance, value
            done += n


def item_counts(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(items with words, ascending shingles that two or more of them have, in how many each is), of the whole benchmark.

    A shingle of one item needs no entry: it weighs as one that no item has.
    """

    def shingles(batches):
        for batch in batches:
            for n, hashes, rows in text_words(batch.column("text")):
                value, row, _ = K.shingles(hashes, rows, n, SHINGLE)
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                new = np.ones(len(value), bool)
                new[1:] = (np.diff(value) != 0) | (np.diff(row) != 0)
                first = np.diff(row, prepend=-1) != 0  # a row with words has a shingle; these count the rows
                yield pa.RecordBatch.from_pydict({"h": K.signed(value[new]), "first": first[new].astype(np.int64)})

    counts = stored(items.select("text").mapInArrow(shingles, "h long, first long").groupBy("h").agg(
        F.count("*").alias("n"), F.sum("first").alias("first")), "benchmark-shingles")
    total = counts.agg(F.sum("first")).first()[0] or 0
    common = counts.where("n > 1").select("h", "n").toArrow()
    value, n = common.column("h").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(value)
    return total, value[order], n[order]


def item_slices(benchmark: DataFrame, threshold: float, slice_bytes: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in slices of about ``slice_bytes`` of text, each with the shingle weights of the whole."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    whole = item_counts(items)
    n = max(1, math.ceil(total / slice_bytes))
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).orderBy("item_id", "text").toArrow()
        made = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), threshold, whole)
        if made.ids:
            yield made


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, slice_bytes: int = 16 << 20, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): items that a document holds, in any window.

    A window has as many words as the item (the whole text, if that is shorter). Words are runs of letters,
    digits and non-ASCII bytes, A-Z lower-cased; shingles are five words (items of fewer words: all of them).
    Windows are taken wherever a text shares a shingle with an item, over whole texts: elsewhere the similarity is 0. The index
    proposes for each window all items whose fingerprints are within RADIUS of its own; the items that share a shingle with it are
    verified, too, so that an item beyond the radius is not lost. ``distance`` says which rows the index found. Similarity is the
    weighted Jaccard similarity of shingle multisets; a shingle's weight falls with the number of items that have it.
    One row per document row and item, for the best window (the first, if equal). Null or word-free texts and
    items match nothing; repeated rows are each answered; two equal items are both named; other columns are ignored.
    No shuffle of texts: the benchmark goes to the tasks in slices of bounded size, one pass over the texts for each slice. With each
    slice go the counts of all shingles that two or more items have (16 bytes each), so the slices do not change the weights.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"doc_id": dict(narrow.dtypes)["doc_id"], "item_id": dict(benchmark.dtypes)[item_id_col]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, first_word long, n_words long, distance long, similarity double"
    found = None
    for items in item_slices(benchmark, threshold, slice_bytes, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                hits = list(own.matches(batch.column("text")))
                rows, which, begin, distance, value = zip(*hits) if hits else ([], [], [], [], [])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": [own.ids[i] for i in which],
                    "first_word": list(begin), "n_words": [int(own.words[i]) for i in which], "distance": list(distance),
                    "similarity": list(value)}, schema=pa.schema([
                        ("doc_id", batch.schema.field("doc_id").type), ("item_id", arrow_id), ("first_word", pa.int64()),
                        ("n_words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())]))

        arrow_id = pa.int64() if kinds["item_id"] == "bigint" else pa.array(items.ids).type
        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, slice_bytes: int = 16 << 20,
                      text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay. See ``contaminated``."""
    for items in item_slices(benchmark, threshold, slice_bytes, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in shared.value.matches(batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
