"""Operator 2, suffix-array dedup: passages that recur byte for byte, found with induced sorting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import stored

U64 = np.uint64
#: Length of the byte runs whose hashes route windows to shards.
GRAM = 32
#: UTF-8 has no such byte: it ends every piece of a shard's text.
BETWEEN = 255
#: Text of one suffix array.
SHARD_BYTES = 4 << 20


# Induced sorting ---------------------------------------------------------------------------------------------------------------

def _rising(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S-type); the last one is not: behind it stands the least sign."""
    step = np.sign(np.diff(s.astype(np.int64)))
    n = len(s)
    at = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the text changes
    out = np.zeros(n, bool)
    changes = ahead < n
    out[:-1][changes] = step[ahead[changes]] > 0
    return out


def _same_before(s: np.ndarray) -> np.ndarray:
    """How many equal characters stand directly before each place."""
    n = len(s)
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _chains(entries: np.ndarray, times: np.ndarray) -> np.ndarray:
    """entries, then each entry's predecessor for those with times >= 1, then the next for times >= 2, and so on."""
    if not len(entries) or not times.any():
        return entries
    source = np.repeat(np.arange(len(entries)), times + 1)
    back = np.arange(len(source)) - np.repeat(np.concatenate(([0], np.cumsum(times + 1)[:-1])), times + 1)
    order = np.lexsort((source, back))
    return entries[source[order]] - back[order]


class _Buckets:
    """Lists of suffixes by first character, filled at one end."""

    def __init__(self, s: np.ndarray, letters: int):
        self.s, self.parts = s, [[] for _ in range(letters)]

    def push(self, places: np.ndarray) -> None:
        if len(places):
            letters = self.s[places]
            order = np.argsort(letters, kind="stable")
            places, letters = places[order], letters[order]
            for part in np.split(places, np.flatnonzero(letters[1:] != letters[:-1]) + 1):
                self.parts[self.s[part[0]]].append(part)

    def take(self, letter: int) -> np.ndarray:
        return np.concatenate(self.parts[letter]) if self.parts[letter] else np.empty(0, np.int64)


def _induce(s: np.ndarray, letters: int, rising: np.ndarray, before: np.ndarray, least: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones ``least`` in (some) order.

    One pass over the letters upwards puts the falling suffixes, one downwards the rising ones. All suffixes
    of a letter are handled at once; those that a letter induces in itself form runs of that letter.
    """
    n = len(s)
    # Up: every suffix met in order puts its predecessor, if that is falling, at the end of its letter's list.
    chosen = _Buckets(s, letters)
    chosen.push(least)
    falling = _Buckets(s, letters)
    falling.push(np.array([n - 1]))
    lower: list[np.ndarray] = []
    for letter in range(letters):
        own = falling.take(letter)
        own = _chains(own, np.where(own > 0, before[own], 0))  # predecessors equal to a falling character are falling
        lower.append(own)
        met = np.concatenate([own, chosen.take(letter)])
        left = met[met > 0] - 1
        left = left[~rising[left] & (s[left] != letter)]
        falling.push(left)
    # Down: every suffix met from the end puts its predecessor, if that is rising, at the front of its letter's list.
    upper = _Buckets(s, letters)
    result: list[np.ndarray] = []
    for letter in range(letters - 1, -1, -1):
        own = upper.take(letter)  # from the largest to the smallest
        own = _chains(own, np.where(own > 0, before[own], 0))
        met = np.concatenate([own, lower[letter][::-1]])
        left = met[met > 0] - 1
        left = left[rising[left] & (s[left] != letter)]
        upper.push(left)
        result.append(met)
    return np.concatenate(result)[::-1]


def _doubled(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text over many letters, in order up to ``depth`` letters: ranks of twice as many letters each round,
    only where ranks are still shared."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = s[order][1:] != s[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while width < depth:
        alone = new & np.append(new[1:], True)
        shared = np.flatnonzero(~alone)
        if not len(shared):
            break
        places = order[shared]
        ahead = np.where(places + width < n, rank[np.minimum(places + width, n - 1)] + 1, 0)
        by = np.lexsort((ahead, rank[places]))
        places, ahead, old = places[by], ahead[by], rank[places[by]]
        order[shared] = places
        fresh = np.ones(len(shared), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])
        new[shared] = fresh
        rank[places] = np.maximum.accumulate(np.where(fresh, shared, 0))
        width *= 2
    return order


def suffix_array(s: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """The suffixes of ``s`` in order, as far as their first ``depth`` characters decide it.

    Induced sorting: leftmost-smaller (LMS) suffixes stand where a falling stretch turns into a rising one. Their substrings,
    up to the next such place, are sorted by inducing from them in text order, and named; the text of names is sorted
    recursively and gives the order of the LMS suffixes, from which all others are induced. Each name stands for two
    characters or more, so half the depth is enough below. A text with more letters than buckets can
    serve (a text of names, as a rule) is sorted by doubling instead, which needs no buckets.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    if letters > 4096:
        return _doubled(s, depth)
    rising, before = _rising(s), _same_before(s)
    least = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if not len(least):
        return _induce(s, letters, rising, before, least)
    order = _induce(s, letters, rising, before, least)
    is_least = np.zeros(n, bool)
    is_least[least] = True
    order = order[is_least[order]]
    name_of = np.zeros(n, np.int64)
    name_of[order] = _names(s, rising, least, order)
    names = name_of[least]
    below = int(names.max()) + 1
    if below == len(least):
        least = order
    else:
        least = least[suffix_array(names, below, depth // 2 + 1)]
    return _induce(s, letters, rising, before, least)


def _names(s: np.ndarray, rising: np.ndarray, least: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in their order: equal substrings (characters and types) get equal numbers."""
    n = len(s)
    end = np.append(least[1:], n - 1)  # a substring reaches to the next LMS place, or to the end of the text
    length = np.zeros(n, np.int64)
    length[least] = end - least + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    last = least[-1]
    same &= (a != last) & (b != last)  # the last one also holds the sign behind the text: equal to no other
    sign = s.astype(np.int64) * 2 + rising
    open_ = np.flatnonzero(same)
    offset = 0
    while len(open_):
        open_ = open_[offset < length[a[open_]]]
        differ = sign[a[open_] + offset] != sign[b[open_] + offset]
        same[open_[differ]] = False
        open_ = open_[~differ]
        offset += 1
    return np.concatenate(([0], np.cumsum(~same)))


def recurring(data: np.ndarray, order: np.ndarray, length: int, block: int = 64) -> np.ndarray:
    """Which places of ``data`` begin a run of ``length`` bytes that also begins elsewhere; no run holds BETWEEN.

    Permuted common prefixes: the common prefix of a suffix with its predecessor in order is at least that of the
    suffix one place before, less one. Places are taken in blocks, all blocks in step, so each keeps what it knows.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < length + 1:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([data, np.full(length + block + 16, BETWEEN, np.uint8)])
    stop = np.flatnonzero(wide == BETWEEN)
    room = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)  # bytes up to the end of the piece
    starts = np.arange(0, n, block)
    known = np.zeros(len(starts), np.int64)
    most = length + block
    for step in range(block):
        place = starts + step
        live = place < n
        known = np.maximum(known - 1, 0)
        where = np.where(live, place, 0)
        other = before[where]
        most_here = np.where(live & (other >= 0), np.minimum(most, np.minimum(room[where], room[np.maximum(other, 0)])), 0)
        known = np.minimum(known, most_here)
        open_ = np.flatnonzero(known < most_here)
        while len(open_):  # eight bytes at a time
            a, b = where[open_] + known[open_], other[open_] + known[open_]
            differ = np.zeros(len(open_), np.int64)
            equal = np.ones(len(open_), bool)
            for j in range(8):
                equal &= wide[a + j] == wide[b + j]
                differ += equal
            known[open_] = np.minimum(known[open_] + differ, most_here[open_])
            open_ = open_[(differ == 8) & (known[open_] < most_here[open_])]
        hit = known >= length
        out[where[hit]] = True
        out[other[hit]] = True
    return out


# Windows and their routing -------------------------------------------------------------------------------------------------------

PLACE_BITS = 21


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, bytes of the row before them): rows in slices; a long row in pieces that share no window."""
    size = 1 << PLACE_BITS - 1
    for first, _, data, offsets in K.slices(column, size):
        if len(data) <= size:
            yield first, data, offsets, 0
        else:
            for at in range(0, len(data) - length + 1, size):
                part = data[at:at + size + length - 1]
                yield first, part, np.array([0, len(part)]), at


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, content hash, row, start in the row, bytes, least grams) of the segments of all rows.

    The key of a window of ``length`` bytes is the hash of its least gram (the first, if equal): equal windows have
    equal keys. A segment is a maximal run of windows with one key, with all their bytes. Two windows of a segment can
    be equal only if they have different least grams, which are counted.
    """
    width, n = length - GRAM + 1, len(data) - GRAM + 1
    if n < width:
        return tuple(np.empty(0, t) for t in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    up, down = K._powers(len(data))
    prefix = np.empty(len(data) + 1, U64)
    prefix[0] = 0
    np.cumsum(K.byte_values(0, False)[data] * up[:len(data)], out=prefix[1:])
    grams = K.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:n])
    mask = U64((1 << PLACE_BITS) - 1)
    placed = np.concatenate([grams & ~mask | np.arange(n, dtype=U64), np.full(-n % width, ~U64(0))]).reshape(-1, width)
    forward = np.minimum.accumulate(placed, axis=1).reshape(-1)[:n]
    backward = np.minimum.accumulate(placed[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    least = (np.minimum(backward[:n - width + 1], forward[width - 1:]) & mask).astype(np.int64)  # of the window at each place
    first, last = offsets[:-1], offsets[1:] - length  # windows of a row begin from first to last
    has = last >= first
    inside = np.zeros(len(least) + 1, np.int64)
    inside[first[has]] += 1
    np.add.at(inside, last[has] + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    moved = np.flatnonzero(np.diff(least, prepend=-1))  # windows whose least gram is another than that of the window before
    key = np.repeat(grams[least[moved]], np.diff(np.append(moved, len(least))))
    edge = np.ones(len(key), bool)
    edge[1:] = (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])
    edge[first[has]] = True
    begin = np.flatnonzero(edge)
    finish = np.append(begin[1:], len(key))
    keep = inside[begin]
    begin, finish = begin[keep], finish[keep]
    end = finish - 1 + length
    content = K.mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U64) * U64(K.BASE))
    grams_in = 1 + np.searchsorted(moved, finish, "left") - np.searchsorted(moved, begin, "right")
    row = np.searchsorted(offsets, begin, "right") - 1
    return key[begin], content, row, begin - offsets[row], end - begin, grams_in


def window_hashes(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Two independent hashes of the ``length`` bytes from each place of ``data`` that has so many."""
    up, down = K._powers(len(data))
    out = []
    for seed in (1, 2):
        prefix = np.empty(len(data) + 1, U64)
        prefix[0] = 0
        np.cumsum(K.byte_values(seed, False)[data] * up[:len(data)], out=prefix[1:])
        out.append(K.mix((prefix[length:] - prefix[:-length]) * down[:len(data) - length + 1]))
    return out


def recurring_spans(parts: list[bytes], owners: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(owner, start, end) of the bytes of each part that are in a run of ``length`` bytes found at another place, too."""
    sizes = np.array([len(x) for x in parts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    hits = np.flatnonzero(recurring(data, suffix_array(data, 256, length), length))
    part = np.searchsorted(begin, hits, "right") - 1
    for rows in np.split(np.arange(len(hits)), np.flatnonzero((np.diff(part) != 0) | (np.diff(hits) > length)) + 1):
        if len(rows):
            which = part[rows[0]]
            yield int(owners[which]), int(hits[rows[0]] - begin[which]), int(hits[rows[-1]] - begin[which] + length)


def remove_recurring(docs: DataFrame, *, length: int = 400, passage: int | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those covered by a string of ``length``
    bytes that also starts anywhere else, in the same or another row. kept is binary: a cut may split a character.
    With ``passage`` also repeats: the text holds a string of ``passage`` bytes that starts anywhere else. It removes nothing.

    (1) Every text is cut into segments of windows that share the hash of their least gram; equal windows are in segments
    of equal key. Segments with a key found once are done. (2) Of the others, contents found several times recur as a whole.
    (3) One copy of each distinct content, where a key has several, goes to the key's shard, which builds its suffix array
    and finds what recurs. A key whose contents exceed ``shard_bytes`` is no group: a row for each window of its distinct
    contents, known by two more 64-bit hashes, is dealt by those, and windows of two places recur. (4) Spans go back to the texts by segment. Rows are hashes and places up to step 3; copies,
    however many, are one content. The exact check is the arrays' own, on bytes; hashes route. Both lengths go side by side; for
    ``passage`` only keys that hold a content of a text without a recurring whole content are searched: the others are known.

    A null text is empty; rows that repeat an id and a text are texts of their own, whose passages recur; null ids are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    kind = dict(base.dtypes)["doc_id"]
    lengths = [length] if passage in (None, length) else [length, passage]
    narrow = base.where(F.octet_length("text") >= min(lengths))

    def places(batches):
        for batch in batches:
            for width in lengths:
                for first, data, offsets, before in pieces(batch.column("text"), width):
                    key, content, row, start, size, grams = segments(data, offsets, width)
                    row = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(row), batch.column("tag").take(row), pa.array(K.signed(key ^ U64(width))), pa.array(K.signed(content)),
                         pa.array(start + before), pa.array(size.astype(np.int32)), pa.array(grams.astype(np.int32)), pa.array(np.full(len(key), width, np.int32))],
                        names=["doc_id", "tag", "key", "content", "start", "size", "grams", "length"])

    every = stored(narrow.select("doc_id", "tag", "text").mapInArrow(
        places, f"doc_id {kind}, tag long, key long, content long, start long, size int, grams int, length int"), "segments")
    several = stored(every.groupBy("key").agg(F.sum("grams").alias("n")).where("n > 1").select("key"), "shared-keys")
    found = stored(every.join(several, "key", "left_semi"), "shared-segments")
    contents = stored(found.groupBy("key", "content").agg(
        F.count("*").alias("copies"), F.max("grams").alias("grams"), F.max("length").alias("length"),
        F.min(F.struct("doc_id", "tag", "start", "size")).alias("one")), "segment-contents")
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.tag") == F.col(f"{y}.tag"))
    mixed = contents.groupBy("key").agg(F.count("*").alias("n"), F.max("grams").alias("grams"), F.max("length").alias("length"),
                                        F.sum("one.size").alias("bytes")).where("n > 1 or grams > 1")
    if len(lengths) > 1:
        short = F.col("length") == passage
        known = found.where(short).join(contents.where(short & (F.col("copies") > 1)), ["key", "content"], "left_semi").select("doc_id", "tag").distinct()
        alone = contents.where(short & (F.col("copies") == 1)).select("key", "one.doc_id", "one.tag")
        asked = alone.alias("a").join(known.alias("k"), same("a", "k"), "left_anti").select("key").distinct()
        mixed = mixed.where(~short).unionAll(mixed.where(short).join(asked, "key", "left_semi"))
    mixed = stored(mixed.withColumn("large", F.col("bytes") > shard_bytes), "mixed-keys")
    total, large = mixed.agg(F.sum(F.when(~F.col("large"), F.col("bytes"))), F.max("large")).first()
    shards = max(1, math.ceil((total or 0) / shard_bytes))
    wanted = contents.join(mixed.select("key", "large"), "key").select(
        F.col("one.doc_id").alias("doc_id"), F.col("one.tag").alias("tag"), F.struct("one.start", "one.size", "key", "content", "length", "large").alias("part"))
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list("part").alias("parts"))  # no more than a text's own segments
    holders = base.alias("d").join(wanted.alias("w"), same("d", "w")).select("d.text", "w.parts")

    def fetch(batches):
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text"), batch.column("parts")):
                raw = memoryview(text.as_buffer())
                out += [(p["key"], p["content"], p["length"], bytes(raw[p["start"]:p["start"] + p["size"]])) for p in parts.as_py() if not p["large"]]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["key", "content", "length", "bytes"])

    def hashed(batches):
        """Two hashes of each window of the contents of large keys."""
        for batch in batches:
            for text, parts in zip(batch.column("text"), batch.column("parts")):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for p in parts.as_py():
                    if p["large"]:
                        one, two = window_hashes(raw[p["start"]:p["start"] + p["size"]], p["length"])
                        yield pa.RecordBatch.from_pydict({"key": np.full(len(one), p["key"]), "content": np.full(len(one), p["content"]),
                                                          "length": np.full(len(one), p["length"], np.int32), "low": np.arange(len(one)), "h1": K.signed(one), "h2": K.signed(two)})

    def merged(batches):
        for batch in batches:
            out = []
            for key, content, width, lows in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "length", "lows"))):
                lows = np.array(lows, np.int64)
                for run in np.split(lows, np.flatnonzero(np.diff(lows) > width) + 1):
                    out.append((key, content, int(run[0]), int(run[-1]) + width))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["key", "content", "low", "high"])

    def search(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("content").to_numpy(), table.column("key").to_numpy()))
        key, content = table.column("key").to_numpy()[order], table.column("content").to_numpy()[order]
        first = np.ones(len(order), bool)  # repeated rows sent the same content twice
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        order = order[first]
        parts = table.column("bytes").take(pa.array(order)).to_pylist()
        spans = list(recurring_spans(parts, np.arange(len(parts)), table.column("length")[0].as_py()))
        which = np.array([x[0] for x in spans], np.int64)
        return pa.table({"key": key[first][which], "content": content[first][which], "low": np.array([x[1] for x in spans], np.int64),
                         "high": np.array([x[2] for x in spans], np.int64)})

    sent = holders.mapInArrow(fetch, "key long, content long, length int, bytes binary").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    marked = sent.groupBy("length", "shard").applyInArrow(search, "key long, content long, low long, high long")
    if large:
        windows = stored(holders.where(F.exists("parts", lambda p: p["large"])).mapInArrow(hashed, "key long, content long, length int, low long, h1 long, h2 long"), "key-windows")
        place = F.struct("content", "low")  # repeated rows sent the same place twice
        again = windows.groupBy("key", "h1", "h2").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("key", "h1", "h2")
        lows = windows.join(again, ["key", "h1", "h2"], "left_semi").groupBy("key", "content", "length").agg(F.sort_array(F.collect_set("low")).alias("lows"))
        marked = marked.unionAll(lows.mapInArrow(merged, "key long, content long, low long, high long"))
    whole = contents.where("copies > 1").select("key", "content", F.lit(0).cast("long").alias("low"), F.col("one.size").cast("long").alias("high"))
    marks = stored(whole.unionAll(marked), "segment-spans")
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    spans = found.select("doc_id", "tag", "key", "content", "start", "length").join(marks, ["key", "content"]).groupBy("doc_id", "tag").agg(
        F.collect_set(F.when(F.col("length") == length, span)).alias("spans"), F.max(F.col("length") == lengths[-1]).alias("repeats"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw, removed, runs, at, kept = memoryview(text.as_buffer()), 0, 0, 0, []
                for low, high in sorted((x["low"], x["high"]) for x in spans.as_py() or ()):
                    if low > at or not runs:
                        kept.append(raw[at:low])
                        runs, removed, at = runs + 1, removed + high - low, high
                    elif high > at:
                        removed, at = removed + high - at, high
                kept.append(raw[at:])
                out.append((len(raw), removed, runs, b"".join(kept)))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              batch.column("repeats")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "repeats"])

    joined = base.alias("d").join(spans.alias("s"), same("d", "s"), "left").select("d.doc_id", "d.text", "s.spans", F.coalesce("s.repeats", F.lit(False)).alias("repeats"))
    out = joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, repeats boolean")
    return out.drop("repeats") if passage is None else out
