"""Operator 12, periodic run detection: maximal repetitions of words, found on a harmonic grid with common extensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K

#: A difference cover: every number below PERIOD is a difference of two members, modulo PERIOD.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Text whose documents share one structure, and pairs of the grid looked at together.
TEXT_BYTES, PAIRS = 1 << 20, 1 << 19
#: Places of a block of the minimum structure.
BLOCK = 16


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[a, b]: the least step that brings places congruent to a and b both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    places = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    for step in range(PERIOD - 1, -1, -1):
        both = inside[(places + step) % PERIOD]
        out[np.ix_(both, both)] = step
    return out


class RangeMinimum:
    """Minimum of any stretch of an array: a sparse table over blocks, and least values up to and from each place in its block."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        wide = np.full(-(-max(n, 1) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        wide[:n] = values
        rows = wide.reshape(-1, BLOCK)
        self.values, self.upto = wide, np.minimum.accumulate(rows, axis=1).reshape(-1)
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [rows.min(axis=1)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value from each first to each last place, both included."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.since[first], self.upto[last])
        same = np.flatnonzero(a == b)
        if len(same):
            at, stop = first[same], last[same]
            low = self.values[at]
            for step in range(1, BLOCK):
                low = np.minimum(low, self.values[np.minimum(at + step, stop)])
            out[same] = low
        between = b - a - 1
        for level, row in enumerate(self.table):
            here = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(here):
                low, high = a[here] + 1, b[here] - (1 << level)
                out[here] = np.minimum(out[here], np.minimum(row[low], row[high]))
        return out


class Extensions:
    """How many equal signs follow from two places of a text, in constant time after sorting only the suffixes at cover places.

    Signs are small numbers; the text must end documents with signs of their own. The blocks of PERIOD signs at cover places are
    sorted; suffixes that begin with equal blocks are told apart by doubling over the sequence of blocks, which gives the common prefix
    of neighbours on the way (a minimum over the former round). Any two places reach the cover after the same
    few steps: those signs are compared, then the common prefix of two sorted suffixes is a range minimum.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        ends = int(text.max(initial=0)) + 1 + np.arange(PERIOD + 1)
        self.text = np.concatenate([text, ends]).astype(np.int64)
        self.made = None
        self.n = n

    def _sort(self) -> None:
        n, text = self.n, self.text
        chains = [np.arange(c, n, PERIOD) for c in COVER]
        place = np.concatenate(chains)  # cover places, those a period apart side by side
        m = len(place)
        number = np.full(n + PERIOD + 1, -1, np.int64)
        number[place] = np.arange(m)
        order, common = _sorted_blocks(text, place)
        rank = np.empty(m, np.int64)

        def group() -> None:
            rank[order] = np.maximum.accumulate(np.where(common >= 0, np.arange(m), 0))

        group()
        width = 1
        while (common < 0).any():
            ahead = lambda x: np.where(x + width < m, rank[np.minimum(x + width, m - 1)], -1)
            tied = common < 0
            shared = np.flatnonzero(tied | np.append(tied[1:], False))
            mine = order[shared]
            by = np.lexsort((ahead(mine), rank[mine]))
            mine = mine[by]
            order[shared] = mine
            key, old = ahead(mine), rank[mine]
            parted = np.flatnonzero((old[1:] == old[:-1]) & (key[1:] != key[:-1])) + 1
            known = np.where(common < 0, np.iinfo(np.int64).max, common)
            low, high = key[parted - 1], key[parted]
            common[shared[parted]] = width * PERIOD + RangeMinimum(known).least(low + 1, high)
            group()
            width *= 2
        self.made = (number, rank, RangeMinimum(common))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal signs from places a and b on (a != b)."""
        text, out = self.text, np.zeros(len(a), np.int64)
        steps = _shifts()[a % PERIOD, b % PERIOD]
        live = np.arange(len(a))
        for step in range(PERIOD):
            live = live[(step < steps[live])]
            if not len(live):
                break
            equal = text[a[live] + step] == text[b[live] + step]
            out[live[equal]] += 1
            live = live[equal]
        rest = np.flatnonzero(out == steps)
        if len(rest):
            if self.made is None:
                self._sort()
            number, rank, least = self.made
            x, y = a[rest] + steps[rest], b[rest] + steps[rest]
            inside = (x < self.n) & (y < self.n)
            rest, x, y = rest[inside], rank[number[x[inside]]], rank[number[y[inside]]]
            out[rest] += least.least(np.minimum(x, y) + 1, np.maximum(x, y))
        return out


def _sorted_blocks(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cover places' numbers by their blocks, equal signs of each with the one before; -1 where the blocks are equal)."""
    m = len(place)
    common = np.zeros(m, np.int64)
    if not m:
        return np.empty(0, np.int64), common
    order, group = np.arange(m), np.zeros(m, np.int64)
    common[:] = -1
    common[0] = 0
    for step in range(PERIOD):  # one sign more where groups are still shared
        tied = common < 0
        shared = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(shared):
            break
        mine, sign = order[shared], text[place[order[shared]] + step]
        by = np.lexsort((sign, group[shared]))
        mine, sign, of = mine[by], sign[by], group[shared]
        order[shared] = mine
        new = np.flatnonzero((of[1:] == of[:-1]) & (sign[1:] != sign[:-1])) + 1
        common[shared[new]] = step
        group = np.maximum.accumulate(np.where(common >= 0, np.arange(m), 0))
    return order, common


def maximal_runs(text: np.ndarray, bounds: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run of at least ``shortest`` signs and two periods in the documents text[bounds[i]:bounds[i + 1]].

    A run of period p holds two neighbouring multiples of p (counted from its document's begin), so pairs of
    them, of all p up to half the document, are extended to both sides: n (1 + 1/2 + 1/3 + ...) pairs. Runs of a period and of its
    multiples are the same stretch: the smallest period is kept. By start, then period.
    """
    sizes = np.diff(bounds)
    docs = len(sizes)
    # documents one after the other, each ended by a sign of its own
    at = bounds[:-1] - bounds[0] + np.arange(docs)
    top = int(text.max(initial=0)) + 1
    joined = np.empty(int(sizes.sum()) + docs, np.int64)
    ends = at + sizes
    joined[ends] = top + np.arange(docs)
    solid = np.ones(len(joined), bool)
    solid[ends] = False
    joined[solid] = text[bounds[0]:bounds[-1]]
    ahead, back = Extensions(joined), Extensions(joined[::-1])
    n = len(joined)
    found = []
    for i, j, p in grid(at, sizes, shortest):
        first = i > 0
        hit = (joined[i] == joined[j]) | (first & (joined[i - 1] == joined[j - 1]))
        i, j, p = i[hit], j[hit], p[hit]
        right = ahead.common(i, j)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.common(n - i[inner], n - j[inner])
        hit = (left + right >= p) & (left + right + p >= shortest)
        found.append(np.stack([i[hit] - left[hit], j[hit] + right[hit], p[hit]]))
    start, end, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    document = np.searchsorted(at, start, "right") - 1
    return start - document + bounds[0], end - document + bounds[0], period


def grid(at: np.ndarray, sizes: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, i + p, p) for all neighbouring multiples of all periods of all documents, PAIRS at a time."""
    document = np.flatnonzero(sizes >= max(2, shortest))
    halves = sizes[document] // 2
    owner = np.repeat(document, halves)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (sizes[owner] - 1) // period
    total = np.cumsum(counts)
    last = int(total[-1]) if len(total) else 0
    for low in range(0, last, PAIRS):
        high = min(last, low + PAIRS)
        a, b = int(np.searchsorted(total, low, "right")), int(np.searchsorted(total, high, "left")) + 1
        before = total[a:b] - counts[a:b]
        times = np.minimum(total[a:b], high) - np.maximum(before, low)
        p = np.repeat(period[a:b], times)
        k = np.arange(low, high) - np.repeat(before, times)
        i = np.repeat(at[owner[a:b]], times) + k * p
        yield i, i + p, p


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of every word, bounds of the rows' words, the distinct words) of a text column: runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    found, rows = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(found, "")
    coded = found.filter(solid).dictionary_encode()
    counts = np.bincount(rows.filter(solid).to_numpy(), minlength=len(column))
    return coded.indices.to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(counts))), coded.dictionary


def repeated_tail(words: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The words of documents, of which those whose seed ends in 0 repeat from some word on: word i >= a is word a + (i - a) % p,
    where a = g % n, p = 1 + (n - a) // (3 + g % 8), g = seed // 10."""
    out = words.copy()
    for d in np.flatnonzero((seeds % 10 == 0) & (np.diff(bounds) > 0)).tolist():
        first, n, g = int(bounds[d]), int(bounds[d + 1] - bounds[d]), int(seeds[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[first + a:first + n] = words[first + a + np.arange(n - a) % p]
    return out


def find_runs(docs: DataFrame, *, seed: Column | None = None, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): the maximal runs of repeated words of each text, and the text without the repetitions.

    Words are runs without ASCII white space. runs is an array of (start, period, length), numbered from 0, by start, then period: every
    stretch of at least ``shortest`` words and of two of its smallest period that no neighbouring word extends.
    collapsed joins by one space the words that no run holds behind its first period. ``seed`` (a long column) makes the texts of
    seeds that end in 0 repeat themselves first, see ``repeated_tail``, for trials with known runs.

    Texts are independent: one pass without a shuffle. The documents of about a MB of text share one structure
    for common extensions, built from the suffixes at a difference cover only; a longer text is one by itself.

    A null text has no word; repeated rows are each answered; other columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(1).cast("long") if seed is None else seed).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, _, _ in K.slices(batch.column("text"), TEXT_BYTES):
                part = batch.slice(first, stop - first)
                words, bounds, names = split_words(part.column("text"))
                words = repeated_tail(words, bounds, part.column("seed").to_numpy())
                start, end, period = maximal_runs(words, bounds, shortest)
                row = np.searchsorted(bounds, start, "right") - 1
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, start + period, 1)
                np.add.at(marks, end, -1)
                keep = np.cumsum(marks)[:-1] == 0
                kept = names.cast(pa.string()).take(pa.array(words[keep]))
                left = np.concatenate(([0], np.cumsum(keep)))[bounds]
                runs = pa.StructArray.from_arrays([pa.array(start - bounds[row]), pa.array(period), pa.array(end - start)], names=["start", "period", "length"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), runs),
                     pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")],
                    names=["doc_id", "runs", "collapsed"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, runs array<struct<start: long, period: long, length: long>>, collapsed string")
