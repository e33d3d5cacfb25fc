"""Operator 6, MinHash near-dedup: consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import connected_components, stored
from rowharvest.llm.trie_lm import _borders, _pack, _pack_sorted, _unpack, _unpack_sorted, blocks_of

SHINGLE = 5
#: Documents of similarity 0.8 meet in a band with probability 0.991, of 0.85 with 0.999, of 0.9 with 0.99998.
BANDS, ROWS = 12, 5


def doc_shingles(column: pa.Array, slice_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows, shingles, times, row): the distinct shingles of each row, by slices of the column."""
    for first, stop, data, offsets in K.slices(column, slice_bytes):
        starts, ends, rows = K.words(data, offsets)
        values, rows, _ = K.shingles(K.run_hashes(data, starts, ends, lower=True), rows, stop - first, SHINGLE)
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        yield first, stop - first, values[at], np.diff(np.append(at, len(values))), rows[at]


def block_texts(row: dict) -> pa.Array:
    """The texts of one row of ``blocks_of``."""
    sizes, size = _unpack(row["sizes"], np.int64), int.from_bytes(row["text"][:8], "little")
    data = pa.decompress(row["text"][8:], decompressed_size=size, codec="zstd") if size else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).tobytes()), data)


def row_numbers(block: int, places: np.ndarray) -> np.ndarray:
    """A number of their own for rows of a block of ``blocks_of``: 23 bits of partition, 20 of block, 20 of place."""
    partition, nth = block >> 32, block & 0xFFFFFFFF
    if partition >> 23 or nth >> 20 or (len(places) and int(places[-1]) >> 20):
        raise ValueError("more than 2**23 partitions, 2**20 blocks of a partition or 2**20 rows of a block")
    return places.astype(np.int64) | nth << 20 | partition << 40


def document_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, counts): in how many rows of all blocks each distinct shingle of a block is, in ascending order.

    A block sends each of its distinct shingles once, sorted and packed, to the shard of its hash range, so a shingle
    of very many documents is no more entries in a shard than there are blocks. Nothing is broadcast.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [values for _, _, values, _, _ in doc_shingles(block_texts(row))]
                values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
                bounds = np.searchsorted(values, _borders(shards))
                yield pa.RecordBatch.from_pydict({
                    "block": [row["block"]] * shards, "shard": np.arange(shards), "shingles": [_pack_sorted(x) for x in np.split(values, bounds)],
                    "counts": [_pack(x) for x in np.split(n.astype(np.uint32), bounds)]})

    def count(table: pa.Table) -> pa.Table:
        lists = [_unpack_sorted(x) for x in table.column("shingles").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()]), minlength=len(distinct))
        answers = np.split(sums[inverse].astype(np.int64), np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "counts": pa.array([_pack(x) for x in answers], pa.binary())})

    return blocks.select("block", "sizes", "text").mapInArrow(send, "block long, shard long, shingles binary, counts binary").groupBy("shard").applyInArrow(
        count, "block long, shard long, counts binary")


def idf(total: int, seen: np.ndarray) -> np.ndarray:
    """Weight of one occurrence of a shingle: 1 + ln(documents / documents that have it)."""
    return 1 + np.log(total / seen)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1), and their logarithms."""
    want = (np.arange(65536) + 0.5) / 65536
    x = np.linspace(0, 40, 2_000_001)
    values = np.interp(want, 1 - (1 + x) * np.exp(-x), x)
    return values.astype(np.float32), np.log(values).astype(np.float32)


_SEEDS = K.mix(np.arange(501, 501 + BANDS * ROWS, dtype=np.uint64))


def signatures(values: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, band keys of each): improved consistent weighted sampling.

    Every sample draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the hash of (shingle, sample number), puts
    t = floor(ln(w) / r + b) and takes the shingle that minimises ln(c) - r (t - b + 1); the sample is
    (shingle, t). Two documents agree in a sample with the probability of their weighted Jaccard similarity.
    """
    gamma, log_gamma = _draws()
    counts = np.bincount(rows, minlength=n_rows)
    have = np.flatnonzero(counts)
    samples = np.empty((len(have), BANDS * ROWS), np.uint64)
    bounds = np.concatenate(([0], np.cumsum(counts[have])))
    logs = np.log(weights).astype(np.float32)
    at = 0
    while at < len(have):  # blocks that stay in the processor's cache
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16_384, "right")) - 1)
        a, b = bounds[at], bounds[stop]
        own, log_w, first = values[a:b], logs[a:b], bounds[at:stop] - a
        for k, seed in enumerate(_SEEDS):
            x = own ^ seed
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            draw = x.view(np.uint16).reshape(-1, 4)
            r = gamma[draw[:, 3]]
            shift = draw[:, 2] * np.float32(1 / 65536)
            t = np.floor(log_w / r + shift)
            cost = log_gamma[draw[:, 1]] - r * (t - shift + np.float32(1))
            bits = cost.view(np.int32)
            ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
            tie = (x ^ (t.astype(np.int64).view(np.uint64) * np.uint64(K.BASE))) >> np.uint64(32)
            samples[at:stop, k] = np.minimum.reduceat(ordered.view(np.uint64) << np.uint64(32) | tie, first) & np.uint64(0xFFFFFFFF)
        at = stop
    keys = np.empty((len(have), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(have), band + 1, np.uint64)
        for row in range(ROWS):
            key = K.mix(key * np.uint64(K.BASE) + samples[:, band * ROWS + row])
        keys[:, band] = key
    return have, keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two ascending shingle lists with weights."""
    (x, u), (y, v) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    shared = np.minimum(u[hit], v[at[hit]]).sum()
    total = u.sum() + v.sum() - shared
    return float(shared / total) if total else 0.0


def common_weight(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Mean weight of the common shingles of two texts: (shingles, times, weights) and (shingles, times)."""
    (x, n, w), (y, m) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    return float(np.average(w[hit], weights=np.minimum(n[hit], m[at[hit]])))


def text_order(text: str, values: np.ndarray) -> np.ndarray:
    """Where each shingle of a text, in its order there, is in the ascending list of its distinct ones."""
    data, offsets = K.text_buffer(pa.array([text], pa.large_string()))
    starts, ends, rows = K.words(data, offsets)
    return np.searchsorted(values, K.shingles(K.run_hashes(data, starts, ends, lower=True), rows, 1, SHINGLE)[0])


def word_weights(hits: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``hits`` (which shingles of a text, in its order, another text has): weight of the words that lie in
    such a shingle, each by the lightest of these, and of the other words, each by the heaviest shingle around it."""
    n = hits.shape[1]
    light, heavy = np.full((len(hits), n + SHINGLE - 1), np.inf), np.zeros(n + SHINGLE - 1)
    kept = np.where(hits, weights, np.inf)
    for j in range(SHINGLE):
        np.minimum(light[:, j:j + n], kept, out=light[:, j:j + n])
        np.maximum(heavy[j:j + n], weights, out=heavy[j:j + n])
    covered = np.isfinite(light)
    return np.where(covered, light, 0).sum(1), np.where(covered, 0, heavy).sum(1)


def word_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted share of the words of two texts (shingles in the order of the text, with weights) that lie in common shingles."""
    (shared, own), (others, rest) = ([x[0] for x in word_weights(np.isin(u[0], v[0])[None, :], u[1])] for u, v in ((a, b), (b, a)))
    low = min(shared, others)
    total = shared + own + others + rest - low
    return float(low / total) if total else 0.0


def elements(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A multiset of shingles as a set: the n-th occurrence of a shingle is an element of its own."""
    if (times == 1).all():
        return values
    each = np.repeat(values, times)
    nth = np.arange(len(each)) - np.repeat(np.concatenate(([0], np.cumsum(times)[:-1])), times)
    return np.where(nth > 0, K.mix(each ^ (nth.astype(np.uint64) * np.uint64(K.BASE))), each)


class Block:
    """Some texts of one band: ids, components, band keys, and their shingles with weights, one after the other; in what
    order they are in each text."""

    def __init__(self, texts: list[dict]):
        joined = lambda name, kind: np.frombuffer(b"".join(t[name] for t in texts), kind)
        self.ids, self.components = (np.array([t[c] for t in texts], np.int64) for c in ("node", "component"))
        self.keys = np.array([t["bands"] for t in texts], np.int64).view(np.uint64)
        self.values, self.weights = joined("elements", np.uint64), joined("weights", np.float64)
        self.owner = np.repeat(np.arange(len(texts)), [len(t["elements"]) // 8 for t in texts])
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.totals = np.bincount(self.owner, weights=self.weights, minlength=len(texts))
        self.order = [np.frombuffer(t["spelled"], np.int32) + start for t, start in zip(texts, np.cumsum(self.sizes) - self.sizes)]

    def shared_weight(self, other: Block, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Weight, and number, of the shingles that each text here and each text there have in common: products of indicator
        matrices, by columns of the elements that both blocks have."""
        common = np.intersect1d(self.values, other.values)
        out, number = np.zeros((len(self.ids), len(other.ids))), np.zeros((len(self.ids), len(other.ids)), np.float32)
        for at in range(0, len(common), step):
            part = common[at:at + step]
            sides = []
            for block in (self, other):
                place = np.minimum(np.searchsorted(part, block.values), len(part) - 1)
                hit = part[place] == block.values
                matrix = np.zeros((len(block.ids), len(part)))
                matrix[block.owner[hit], place[hit]] = block.weights[hit] if block is self else 1.0
                sides.append(matrix)
            mine = sides[0] > 0
            if self is other:
                sides[1] = mine.astype(float)
            out += sides[0] @ sides[1].T
            number += mine.astype(np.float32) @ sides[1].astype(np.float32).T
        return out, number

    def words_shared(self, other: Block, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``word_weights`` of each text here against each text there, for the pairs asked for."""
        common = np.intersect1d(self.values, other.values)
        held = np.zeros((len(other.ids), len(common) + 1), bool)
        place = np.minimum(np.searchsorted(common, other.values), len(common) - 1)
        hit = common[place] == other.values
        held[other.owner[hit], place[hit]] = True
        shared, own = np.zeros(asked.shape), np.zeros(asked.shape)
        for i in np.flatnonzero(asked.any(axis=1)):
            values, these = self.values[self.order[i]], np.flatnonzero(asked[i])
            place = np.minimum(np.searchsorted(common, values), len(common) - 1)
            place = np.where(common[place] == values, place, len(common))
            shared[i, these], own[i, these] = word_weights(held[np.ix_(these, place)], self.weights[self.order[i]])
        return shared, own


#: Common shingles of so many documents, in the geometric mean, are those of a large group of copies.
GROUP = 10


def compare(x: Block, y: Block, band: int, threshold: float, light: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of different components, each pair in the first band that its texts share. ``light`` is the
    mean weight up to which common shingles are those of a large group."""
    wanted = x.components[:, None] != y.components[None, :]
    if x is y:
        wanted &= np.arange(len(x.ids))[:, None] < np.arange(len(y.ids))[None, :]
    for k in range(int(np.flatnonzero(x.keys[0] == np.uint64(band))[0])):
        wanted &= x.keys[:, k][:, None] != y.keys[:, k][None, :]
    if not wanted.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared, number = x.shared_weight(y)
    linked = wanted & (shared >= threshold * (x.totals[:, None] + y.totals[None, :] - shared))
    asked = wanted & ~linked & (shared <= light * number) & (number >= threshold * (x.sizes[:, None] + y.sizes[None, :] - number))
    if asked.any():
        (here, own), (there, rest) = x.words_shared(y, asked), (m.T for m in y.words_shared(x, asked.T))
        low = np.minimum(here, there)
        linked |= asked & (low >= threshold * (here + own + there + rest - low))
    return np.nonzero(linked)


#: Shingles of one block of a band.
BLOCK_SHINGLES = 16_384
#: Text of one block of documents, and compressed text whose shingles are counted in one shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 3 << 20


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, class_id, text_id): near-duplicate classes of the documents, one row per row of ``docs``.

    Documents with the same multiset of shingles are one text; text_id is its least doc_id. Two texts are
    linked if the weighted Jaccard similarity of their TF-IDF shingles is ``threshold`` or more. Where ``GROUP`` documents or more
    have the common shingles, they are also linked if the Jaccard similarity of the plain shingles and the weighted share of the
    words that lie in common shingles both are: a changed word spoils five shingles, and in a large group of copies
    these, which are rare, weigh a multiple of those that all have. class_id is
    the least doc_id that links reach. Shingles are five words (the whole text, if it has fewer), words
    runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Every shingle weighs by the number of documents that
    have it, however few or many: each block of texts asks the shards of ``document_counts`` for its own.

    Candidates are texts that agree in a band of samples. They are verified in two steps: every text against
    the least text of each of its bands; then, with the components of those links known, the pairs of a band
    whose texts are in different components, so no link between components is lost. The second step deals each such
    band into blocks of bounded size and compares block with block as matrices: no pair is a row, only links are.

    Texts without a word (null, empty) are each in a class of their own. Ids are whole numbers. Rows that repeat an id are
    answered by the least class of their texts; rows with a null id are left out.
    Other columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    blocks = blocks_of(narrow, F.lit(False), "doc_id", "text", block_bytes)
    total, size = blocks.agg(F.sum(F.size("doc_ids")), F.sum(F.length("text"))).first()
    shards, light = max(1, math.ceil((size or 0) / shard_bytes)), idf(total or 1, GROUP)
    answers = document_counts(blocks, shards).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("answers"))
    def sign(batches):
        for batch in batches:
            for block in batch.to_pylist():
                answered = np.concatenate([_unpack(x["counts"], np.int64) for x in block["answers"]])
                found = list(doc_shingles(block_texts(block)))
                distinct = np.unique(np.concatenate([values for _, _, values, _, _ in found])) if found else np.empty(0, np.uint64)
                for first, n, values, times, rows in found:
                    seen = answered[np.searchsorted(distinct, values)]
                    have, keys = signatures(values, idf(total, seen) * times, rows, n)
                    tags, bounds = [], np.searchsorted(rows, have)
                    for salt in (3, 5):  # the multiset as a sum of mixed hashes
                        marks = K.mix(values ^ np.uint64(salt * K.BASE % 2**64)) * (2 * times - 1).astype(np.uint64)
                        tags.append(np.add.reduceat(marks, bounds) if len(have) else np.empty(0, np.uint64))
                    ids, held = block["doc_ids"], have + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in held], pa.int64()), pa.array(row_numbers(block["block"], held)), pa.array(K.signed(tags[0])), pa.array(K.signed(tags[1])),
                         pa.array(np.bincount(rows, minlength=n)[have]),
                         pa.FixedSizeListArray.from_arrays(pa.array(K.signed(keys.reshape(-1))), BANDS).cast(pa.list_(pa.int64())),
                         pa.array([_pack(x) for x in np.split(seen, bounds[1:])] if len(have) else [], pa.binary())],
                        names=["doc_id", "row", "t1", "t2", "size", "bands", "seen"])

    signed = stored(blocks.select("block", "doc_ids", "sizes", "text").join(answers, "block").mapInArrow(
        sign, "doc_id long, row long, t1 long, t2 long, size long, bands array<long>, seen binary"), "signatures")
    texts = stored(signed.groupBy("t1", "t2").agg(F.min("row").alias("node"), F.min("doc_id").alias("text_id"), F.min("bands").alias("bands"),
                                                  F.min("size").alias("size")), "texts")
    members = texts.select("node", "size", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    bands = stored(members.join(leaders, "band").select("band", "leader", "node", "size"), "bands")
    first = bands.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    # Texts are joined by sorting at every size: their bytes, not the ids they are chosen by, are what moves.
    chosen = signed.select("row", "seen").join(bands.select("node").distinct(), F.col("row") == F.col("node"), "left_semi")

    def unpack(batches):
        for batch in batches:
            for block in batch.to_pylist():
                column = block_texts(block)
                for at in range(0, len(column), 2_000):
                    part = column.slice(at, 2_000)
                    yield pa.RecordBatch.from_arrays([pa.array(row_numbers(block["block"], np.arange(at, at + len(part)))), part.cast(pa.string())], names=["row", "text"])

    numbered = blocks.select("block", "sizes", "text").mapInArrow(unpack, "row long, text string")
    involved = stored(numbered.join(chosen.hint("merge"), "row"), "candidate-texts")

    def verify(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def parsed(row, text, seen):
            if row not in held:
                if len(held) > 200:
                    held.clear()
                values, times = [x for _, _, *x, _ in doc_shingles(pa.array([text], pa.large_string()))][0]
                held[row] = values, times, idf(total, _unpack(seen, np.int64))
            return held[row]

        def near(x, y):
            (u, n, v), (s, m, w) = parsed(*x), parsed(*y)
            if similarity((u, v * n), (s, w * m)) >= threshold:
                return True
            if similarity((u, n), (s, m)) < threshold or common_weight((u, n, v), (s, m)) > light:
                return False
            at, to = text_order(x[1], u), text_order(y[1], s)
            return word_similarity((u[at], v[at]), (s[to], w[to])) >= threshold

        for batch in batches:
            left, right = ([batch.column(c).to_pylist() for c in names] for names in (("a", "left_text", "left_seen"), ("b", "right_text", "right_seen")))
            keep = pa.array(np.array([near(x, y) for x, y in zip(zip(*left), zip(*right))], bool))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    left = involved.select(F.col("row").alias("a"), F.col("text").alias("left_text"), F.col("seen").alias("left_seen"))
    right = involved.select(F.col("row").alias("b"), F.col("text").alias("right_text"), F.col("seen").alias("right_seen"))
    links = stored(first.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(
        "a", "b", "left_text", "left_seen", "right_text", "right_seen").mapInArrow(verify, "a long, b long"), "links-to-leaders")

    known = connected_components(links).withColumnRenamed("node", "known")
    placed = stored(bands.join(known, bands.node == known.known, "left").select(
        "band", "node", "size", F.coalesce("component", "node").alias("component")), "placed-bands")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("size").alias("total")).where(
        "low < high").select("band", F.ceil(F.col("total") / BLOCK_SHINGLES).alias("blocks"))
    open_ = placed.join(mixed, "band").select("band", "node", "component", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    asked = open_.select("node").distinct()

    def parse(batches):
        for batch in batches:
            done, counts, spelled = [], batch.column("seen").to_pylist(), batch.column("text")
            for at, n, values, times, rows in doc_shingles(spelled):
                bounds = np.searchsorted(rows, np.arange(n + 1))
                for k in range(n):
                    own, many = values[bounds[k]:bounds[k + 1]], times[bounds[k]:bounds[k + 1]]
                    order = (np.cumsum(many) - many)[text_order(spelled[at + k].as_py(), own)].astype(np.int32)
                    done.append((elements(own, many).tobytes(), np.repeat(idf(total, _unpack(counts[at + k], np.int64)), many).tobytes(), order.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array([d[k] for d in done], pa.binary()) for k in (0, 1, 2)]], names=["row", "elements", "weights", "spelled"])

    parsed = stored(involved.join(asked.hint("merge"), involved.row == asked.node, "left_semi").mapInArrow(
        parse, "row long, elements binary, weights binary, spelled binary").join(texts.select(F.col("node").alias("row"), "bands").hint("merge"), "row"), "parsed-texts")
    packed = stored(open_.join(parsed.hint("merge"), open_.node == parsed.row).groupBy("band", "block").agg(
        F.collect_list(F.struct("node", "component", "bands", "elements", "weights", "spelled")).alias("texts")), "packed-bands")  # of bounded size
    blocks = packed.select("band", "block")
    tasks = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band").where("x <= y")
    side = lambda name, at: packed.select("band", F.col("block").alias(at), F.col("texts").alias(name))
    tasks = tasks.join(side("left", "x").hint("merge"), ["band", "x"]).join(side("right", "y").hint("merge"), ["band", "y"])

    def link_blocks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = Block(row["left"])
                y = x if row["x"] == row["y"] else Block(row["right"])
                a, b = compare(x, y, row["band"] % 2**64, threshold, light)
                yield pa.RecordBatch.from_pydict({"a": x.ids[a], "b": y.ids[b]})

    links = stored(links.unionAll(tasks.mapInArrow(link_blocks, "a long, b long")), "links")
    classes = connected_components(links).withColumnRenamed("node", "linked")
    by_text = stored(texts.join(classes, texts.node == classes.linked, "left").select("t1", "t2", "text_id", F.coalesce("component", "node").alias("component")), "text-classes")
    by_text = by_text.join(by_text.groupBy("component").agg(F.min("text_id").alias("class_id")), "component")
    answered = signed.select("doc_id", "t1", "t2").join(by_text, ["t1", "t2"]).groupBy("doc_id").agg(F.min(F.struct("class_id", "text_id")).alias("x"))
    return narrow.select("doc_id").join(answered, "doc_id", "left").select(
        "doc_id", F.coalesce("x.class_id", "doc_id").alias("class_id"), F.coalesce("x.text_id", "doc_id").alias("text_id"))


def keep_first_of_class(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their class's least id; rows with a null id stay. All columns stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
