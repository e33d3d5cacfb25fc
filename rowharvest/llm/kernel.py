"""Vectorised helpers on the UTF-8 bytes of an Arrow text column.

The tasks of several operators need hashes of words, word shingles and byte runs. All of
them work on the column's own buffer: no Python object is made per word. Memory is bounded
by slices of a few MB (and by the longest single word or run), not by the batch.

Hashes are polynomial over random byte values, modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Text of one slice, in bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21

WORD = np.zeros(256, dtype=bool)  # letters, digits and everything beyond ASCII
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    WORD[_first:_last + 1] = True
TOKEN = np.ones(256, dtype=bool)  # all but ASCII white space
TOKEN[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (in place where possible)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=8)
def byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(seed))
    return values[LOWER] if lower else values


_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n; kept for the usual slice, made anew for longer runs."""
    if _held and len(_held[0]) > n:
        return _held[0], _held[1]
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 20) + 1, base, dtype=U64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= SLICE_BYTES:
        _held[:] = made
    return made[0], made[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, seed: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each run data[start:end]; starts and ends ascend, runs do not overlap."""
    out = np.empty(len(starts), dtype=U64)
    table, at = byte_values(seed, lower), 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        chunk = data[base:int(ends[stop - 1])]
        up, down = _powers(len(chunk))
        prefix = np.empty(len(chunk) + 1, dtype=U64)
        prefix[0] = 0
        np.cumsum(table[chunk] * up[:len(chunk)], out=prefix[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (prefix[e] - prefix[s]) * down[s] + (e - s).astype(U64)
        at = stop
    return mix(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a text column; nulls count as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets from 0) of consecutive rows of up to ``limit`` bytes."""
    data, offsets = text_buffer(column)
    at, n = 0, len(column)
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, stop, data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes that ``table`` marks; none crosses a row."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


PLACES = mix(np.arange(11, 75, dtype=U64)) | U64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of every run of ``size`` words, in order.

    A row of fewer words has one shingle, made of all of them; a row without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n = max(0, len(hashes) - size + 1)
    at = np.flatnonzero(rows[:n] == rows[size - 1:]) if n else np.empty(0, np.int64)
    total = np.full(len(at), size, dtype=U64)
    for j in range(size):
        total += hashes[at + j] * PLACES[j]
    parts, places = [total], [at]
    for short in range(1, size):
        at = first[counts == short]
        if len(at):
            total = np.full(len(at), short, dtype=U64)
            for j in range(short):
                total += hashes[at + j] * PLACES[j]
            parts.append(total)
            places.append(at)
    values, places = mix(np.concatenate(parts)), np.concatenate(places)
    if len(parts) > 1:
        order = np.argsort(places, kind="stable")
        values, places = values[order], places[order]
    return values, rows[places], places


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
