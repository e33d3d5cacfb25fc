"""Operator 4, LM scoring: bigram tries in Elias-Fano levels with quantised smoothed probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import located, mapped, stored
from rowharvest.session import scratch_path

U64 = np.uint64
#: Text of one block, and text whose n-grams make one shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 12 << 20
#: Hashes that stand for the end of a text (a token) and for its begin (a context only).
END, BEGIN = U64(0xE2D00000000000E5), U64(0xB5610000000000B1)
#: log10 gains are kept in 16 bits: 0 to 20 in steps of 0.0003.
STEPS, MOST = 65535, 20.0


class EliasFano:
    """A monotone sequence of 64-bit numbers: low bits packed side by side, high parts in unary.

    ``next_at`` finds successors on the packed form. The ones of the unary part are counted when it is opened.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.packed = n, width, low, high
        self.high = np.flatnonzero(np.unpackbits(high)) - np.arange(n)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, min(63, (max(1, universe) // max(1, n)).bit_length() - 1))
        low = np.zeros((n * width + 63) // 64 + 1, U64)
        if n and width:
            at = np.arange(n, dtype=np.int64) * width
            bits = values & U64((1 << width) - 1)
            word, shift = at >> 6, (at & 63).astype(U64)
            first = np.flatnonzero(np.diff(word, prepend=-1))  # numbers of one word are neighbours: or them group-wise
            low[word[first]] = np.bitwise_or.reduceat(bits << shift, first)
            over = (at & 63) + width > 64
            low[word[over] + 1] |= bits[over] >> (U64(64) - shift[over])
        high = (values >> U64(width)).astype(np.int64)
        marks = np.zeros(int(high[-1]) + n + 1 if n else 0, bool)
        marks[high + np.arange(n)] = True
        return cls(n, width, low, np.packbits(marks))

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        value = self.low[word] >> shift
        over = (bit & 63) + self.width > 64
        value[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return value & U64((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.high[at].astype(U64) << U64(self.width) | self.lows(at)

    def next_at(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number that is not less than each value, between places first and last if given."""
        high = (values >> U64(self.width)).astype(np.int64)
        low = values & U64((1 << self.width) - 1)
        left, right = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        if first is not None:
            left, right = np.clip(left, first, last), np.clip(right, first, last)
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            less = self.lows(middle) < low[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]
            open_ = open_[left[open_] < right[open_]]
        return left


class Trie:
    """Bigrams by predicted word, then by the word before it.

    Level one holds the predicted words (a monotone sequence), pointers the begin of each one's contexts (monotone),
    level two the contexts, made monotone by their node's number, and with each the quantised gain of
    its smoothed probability over the backoff. Levels are files that are mapped, not read.
    """

    def __init__(self, low_bits: int, words: EliasFano, pointers: EliasFano, contexts: EliasFano, gains: np.ndarray):
        self.low_bits, self.words, self.pointers, self.contexts, self.gains = low_bits, words, pointers, contexts, gains

    @classmethod
    def build(cls, keys: np.ndarray, gains: np.ndarray, key_bits: int) -> Trie:
        """From ascending distinct keys (word part above, context part below) and their log10 gains."""
        low_bits = key_bits // 2
        word = keys >> U64(low_bits)
        first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
        node = np.repeat(np.arange(len(first), dtype=U64), np.diff(np.append(first, len(keys))))
        return cls(low_bits, EliasFano.build(word[first], 1 << (key_bits - low_bits)), EliasFano.build(np.append(first, len(keys)).astype(U64), len(keys) + 1),
                   EliasFano.build(node << U64(low_bits) | keys & U64((1 << low_bits) - 1), max(1, len(first)) << low_bits),
                   np.minimum(np.round(gains / MOST * STEPS), STEPS).astype(np.uint16))

    def write(self, folder: str) -> None:
        """Each level as files of plain little-endian numbers, with their shapes beside them."""
        system, local = located(folder)
        system.create_dir(local, recursive=True)
        files = {"gains": self.gains}
        for name in ("words", "pointers", "contexts"):
            level = getattr(self, name)
            files |= {f"{name}-shape": np.array([level.n, level.width, self.low_bits]), f"{name}-low": level.low, f"{name}-high": level.packed}
        for name, numbers in files.items():
            with system.open_output_stream(f"{local}/{name}") as out:
                out.write(pa.py_buffer(np.ascontiguousarray(numbers)))

    @classmethod
    def open(cls, folder: str) -> Trie:
        """The levels, mapped where the file system is mounted."""
        def numbers(name, kind):
            return np.frombuffer(mapped(f"{folder}/{name}"), kind)

        levels, low_bits = [], 0
        for name in ("words", "pointers", "contexts"):
            n, width, low_bits = numbers(f"{name}-shape", np.int64).tolist()
            levels.append(EliasFano(n, width, numbers(f"{name}-low", U64), numbers(f"{name}-high", np.uint8)))
        return cls(low_bits, *levels, numbers("gains", np.uint16))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """log10 gain of each key, 0 if the bigram was never seen: word, then context among that word's own."""
        out = np.zeros(len(keys))
        if not self.words.n:
            return out
        word = keys >> U64(self.low_bits)
        node = self.words.next_at(word)
        node = np.minimum(node, self.words.n - 1)
        hit = np.flatnonzero(self.words.get(node) == word)
        node = node[hit]
        first, last = self.pointers.get(node).astype(np.int64), self.pointers.get(node + 1).astype(np.int64)
        value = node.astype(U64) << U64(self.low_bits) | keys[hit] & U64((1 << self.low_bits) - 1)
        at = self.contexts.next_at(value, first, last)
        seen = at < last
        seen[seen] = self.contexts.get(at[seen]) == value[seen]
        out[hit[seen]] = self.gains[at[seen]] * (MOST / STEPS)
        return out


# Packed arrays: what goes between tasks ------------------------------------------------------------------------------------------

def _pack(array: np.ndarray) -> bytes:
    """Bytes of one significance side by side, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=U64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, U64), dtype=U64)


def blocks_of(docs: DataFrame, held: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, doc_ids, held, offsets, text): documents in compressed blocks of bounded size, written once."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held"))
    kind = dict(narrow.dtypes)["doc_id"]

    def pack(batches):
        n = 0
        for batch in batches:
            for first, stop, data, offsets in K.slices(batch.column("text"), block_bytes):
                ids = batch.column("doc_id").slice(first, stop - first)
                flags = batch.column("held").slice(first, stop - first).fill_null(False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), flags), pa.array([_pack(np.diff(offsets))], pa.binary()),
                     pa.array([_compressed(data)], pa.binary())], names=["block", "doc_ids", "held", "sizes", "text"])
                n += 1

    return stored(narrow.mapInArrow(pack, f"block long, doc_ids array<{kind}>, held array<boolean>, sizes binary, text binary"), "text-blocks")


def _compressed(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def block_tokens(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash of each token, document of each token, number of documents) of a block: each document's words, then END."""
    sizes = _unpack(row["sizes"], np.int64)
    n, size = len(sizes), int.from_bytes(row["text"][:8], "little")
    data = np.frombuffer(pa.decompress(row["text"][8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    starts, ends, docs = K.words(data, np.concatenate(([0], np.cumsum(sizes))), K.TOKEN)
    hashes = K.run_hashes(data, starts, ends, lower=True)
    counts = np.bincount(docs, minlength=n)
    place = np.arange(len(docs)) + docs  # one END behind each earlier document
    tokens, owner = np.full(len(docs) + n, END, U64), np.repeat(np.arange(n), counts + 1)
    tokens[place] = hashes
    return tokens, owner, n


def score_texts(docs: DataFrame, *, held: Column, prior: float = 4.0, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model learns from the rows where ``held`` is not true. Tokens are words (runs without ASCII white space,
    A-Z lower-cased) and one end per text. base_score sums log10 (c + 1) / (N + V + 1); score sums log10 of
    p(w | v) = (c(v w) + prior q(w)) / (c(v) + prior), q(w) = (c(w) + 1) / (N + V + 1), with the begin of the text
    as the first context. That is backoff prior q(w) / (c(v) + prior) by a gain 1 + c(v w) / (prior q(w)), which the
    trie keeps for the bigrams seen.

    Work goes in four steps over compressed blocks of texts: (1) each block's distinct words to word shards, which
    answer with corpus counts; (2) with those, a block knows base scores and backoffs, and sends each of its distinct
    bigrams once, with its training count, sorted and packed, to bigram shards; (3) a shard sums the counts, builds its
    trie in files in the shared folder and answers every block's bigrams with gains; (4) the block adds them up for its documents. Shards are by
    predicted word, those of very frequent words also by context; a bigram, however frequent, is no more entries in
    its shard than there are blocks. Words are known by 64-bit hashes, bigrams by a hash whose length grows with the corpus.

    A null text is empty (one token, the end); repeated rows count and are answered each; other columns are ignored;
    an empty table gives an empty result.
    """
    blocks = blocks_of(docs, held, id_col, text_col, block_bytes)
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    total = blocks.agg(F.sum(F.aggregate(F.array("text"), F.lit(0).cast("long"), lambda a, t: a + F.length(t)))).first()[0] or 0
    shards = max(1, math.ceil(3 * total / shard_bytes))  # text compresses about threefold
    key_bits = min(62, max(40, 2 * math.ceil(math.log2(total + 2)) - 4)) // 2 * 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, owner, _ = block_tokens(row)
                learn = ~np.array([bool(h) for h in row["held"]], bool)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                counts = np.bincount(inverse[learn[owner]], minlength=len(distinct)).astype(np.uint32)
                bounds = np.searchsorted(distinct, _borders(shards))
                yield pa.RecordBatch.from_pydict({
                    "block": [row["block"]] * shards, "shard": np.arange(shards), "words": [_pack_sorted(x) for x in np.split(distinct, bounds)],
                    "counts": [_pack(x) for x in np.split(counts, bounds)]})

    def count(table: pa.Table) -> pa.Table:
        lists = [_unpack_sorted(x) for x in table.column("words").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()]),
                           minlength=len(distinct)).astype(np.int64)
        answers = np.split(sums[inverse], np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"block": table.column("block").to_pylist() + [-1], "shard": [table.column("shard")[0].as_py()] * (len(lists) + 1),
                         "counts": [_pack(x) for x in answers] + [b""], "n": [0] * len(lists) + [int(sums.sum())],
                         "v": [0] * len(lists) + [int((sums > 0).sum())]},
                        schema=pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]))

    answers = stored(blocks.mapInArrow(words, "block long, shard long, words binary, counts binary").groupBy("shard").applyInArrow(
        count, "block long, shard long, counts binary, n long, v long"), "word-counts")
    n_all, v_all = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    starts = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0  # training texts: how often BEGIN is a context
    spread = n_all / (4 * shards)
    informed = blocks.join(answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("answers")), "block")

    def paired(row: dict) -> tuple[np.ndarray, ...]:
        """(owner, corpus count and context's count of each token, place of its bigram, bigrams' shards, keys and word counts): a block's distinct
        bigrams by shard and key, the same whenever they are asked for."""
        tokens, owner, _ = block_tokens(row)
        c = np.concatenate([_unpack(a["counts"], np.int64) for a in row["answers"]])[np.unique(tokens, return_inverse=True)[1]]
        before, c_before = np.empty_like(tokens), np.empty_like(c)
        before[1:], c_before[1:] = tokens[:-1], c[:-1]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        before[first], c_before[first] = BEGIN, starts
        half = U64(64 - key_bits // 2)
        key = tokens >> half << U64(key_bits // 2) | K.mix(before) >> half
        route = np.where(c > spread, K.mix(tokens ^ K.mix(before)), K.mix(tokens))
        del tokens, before  # a block is some million tokens, so arrays go as soon as they can
        route %= U64(shards)
        order = np.lexsort((key, route))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(route[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        at = order[new]
        return owner, c, c_before, place, route[at], key[at], c[at]

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owner, _, _, place, route, key, c = paired(row)
                learn = ~np.array([bool(h) for h in row["held"]], bool)
                times = np.bincount(place[learn[owner]], minlength=len(key)).astype(np.uint32)
                parts, out = np.searchsorted(route, np.arange(1, shards, dtype=U64)), []
                for s, (k, t, m) in enumerate(zip(np.split(key, parts), np.split(times, parts), np.split(c, parts))):
                    if len(k):
                        new = np.flatnonzero(np.diff(k >> U64(key_bits // 2), prepend=~(k[:1] >> U64(key_bits // 2))))
                        out.append((s, _pack_sorted(k), _pack(t), _pack(m[new])))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_pydict({"block": [row["block"]] * len(out), "shard": columns[0], "keys": columns[1], "times": columns[2],
                                                  "counts": columns[3]})

    tries = scratch_path(docs.sparkSession, "tries")

    def look_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists, rare = [], []
        for r in rows:
            keys = _unpack_sorted(r["keys"])
            part = keys >> U64(key_bits // 2)
            which = np.cumsum(np.diff(part, prepend=~part[:1]) != 0) - 1
            lists.append(keys)
            rare.append((prior * (_unpack(r["counts"], np.int64)[which] + 1) / (n_all + v_all + 1)).astype(np.float32))
        keys, rare, times = np.concatenate(lists), np.concatenate(rare), np.concatenate([_unpack(r["times"], np.uint32) for r in rows]).astype(np.int64)
        learnt = np.flatnonzero(times)
        order = learnt[np.argsort(keys[learnt], kind="stable")]
        own, own_rare = keys[order], rare[order]
        first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        sums = np.add.reduceat(times[order], first) if len(first) else np.empty(0, np.int64)
        trie = Trie.build(own[first], np.log10(1 + sums / own_rare[first].astype(float)), key_bits)
        folder = f"{tries}/{rows[0]['shard']}-{TaskContext.get().taskAttemptId()}"  # of this attempt alone, gone with it
        trie.write(folder)
        trie = Trie.open(folder)
        gains = [np.concatenate([trie.lookup(k[i:i + 500_000]) for i in range(0, len(k), 500_000)]) for k in lists]
        del trie
        system, local = located(folder)
        system.delete_dir(local)
        return pa.table({"block": [r["block"] for r in rows], "shard": [r["shard"] for r in rows],
                         "gains": pa.array([_pack(np.rint(g * (STEPS / MOST)).astype(np.uint16)) for g in gains], pa.binary())})

    sent = informed.mapInArrow(bigrams, "block long, shard long, keys binary, times binary, counts binary")
    found = sent.groupBy("shard").applyInArrow(look_up, "block long, shard long, gains binary")
    found = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "gains"))).alias("found"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, ids, held_out = batch.slice(i, 1).to_pylist()[0], batch.column("doc_ids")[i].values, batch.column("held")[i].values
                owner, c, c_before, place, *_ = paired(row)
                gains = np.concatenate([_unpack(x["gains"], np.uint16) for x in row["found"]])[place] * (MOST / STEPS)
                q = (c + 1) / (n_all + v_all + 1)
                sums = lambda x: np.bincount(owner, weights=x, minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [ids, held_out, pa.array(sums(None).astype(np.int64)), pa.array(sums(c > 0).astype(np.int64)), pa.array(np.full(len(ids), n_all, np.int64)),
                     pa.array(sums(np.log10(q))), pa.array(sums(np.log10(prior * q / (c_before + prior)) + gains))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return informed.join(found, "block").mapInArrow(
        add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _borders(shards: int) -> np.ndarray:
    """Equal cuts of the 64-bit hash range."""
    return np.array([(1 << 64) * s // shards for s in range(1, shards)], dtype=U64)
