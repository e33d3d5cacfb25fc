"""Operator 5, BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K

#: Pre-tokenisation of byte-level vocabularies that use the pattern of their library (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
MASK_BITS = 10
SHORTEST, LONGEST = 128, 8192
_GEAR = (K.byte_values(7, False) >> np.uint64(32)).astype(np.uint32)


class Encoder:
    """A byte-level BPE vocabulary file, read for a fast encoder that gives the same ids.

    Special tokens in a text are found first, as the file's own library does; each part between
    them is encoded by itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = {ord(c): i for i, c in _byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        if order != sorted(order):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        ranks = {bytes(letter[ord(c)] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._inner = tiktoken.Encoding("chunked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.decode_bytes = self._inner.decode_bytes

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit integers."""
        return np.array(self._inner.encode_ordinary(text), dtype="<u4").tobytes()

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at special tokens: (text, None) and (special, id) in order."""
        while True:
            hits = [(at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0]
            if not hits:
                yield text, None
                return
            at, _, s = min(hits)
            yield text[:at], None
            yield s, self.special[s]
            text = text[at + len(s):]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabulary files: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder_at(path: str) -> Encoder:
    return Encoder(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a rolling hash of the last 16 bytes has its low bits zero."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    h, width = _GEAR[data], 1
    while width < WINDOW:  # h covers width bytes: double it
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, width * 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_bounds(places: np.ndarray, start: int, end: int) -> list[int]:
    """Bounds of the chunks of data[start:end]: at rolling-hash places, SHORTEST to LONGEST bytes apart (the last may be shorter)."""
    bounds, at = [start], start
    mine = places[np.searchsorted(places, start + SHORTEST):np.searchsorted(places, end)].tolist()
    for place in mine:
        while place - at > LONGEST:
            at += LONGEST
            bounds.append(at)
        if place - at >= SHORTEST:
            at = place
            bounds.append(at)
    while end - at > LONGEST:
        at += LONGEST
        bounds.append(at)
    if at < end:
        bounds.append(end)
    return bounds


def firm_bounds(data: np.ndarray) -> np.ndarray:
    """Places between a printable ASCII character and a following space or line feed.

    No alternative of the pattern spans such a place and none looks back, so token lists on its two
    sides are independent: a part between two of them has the same ids in every text.
    """
    if len(data) < 2:
        return np.empty(0, np.int64)
    blank = (data[1:] == 32) | (data[1:] == 10)
    return np.flatnonzero((data[:-1] > 32) & (data[:-1] < 127) & blank) + 1


class Reuse:
    """Encodes texts by chunks. A chunk's inner part, from its first to its last firm bound, is encoded once and
    kept; what lies between two inner parts (the join) is encoded again, up to the firm bounds on both sides, where
    it must agree with them."""

    def __init__(self, encoder: Encoder, shared: dict[bytes, tuple[bytes, bytes]], limit: int):
        self.encoder, self.shared, self.limit = encoder, shared, limit
        self.held: dict[bytes, tuple[bytes, bytes]] = {}
        self.size = 0

    def encode(self, part: bytes) -> tuple[bytes, bytes]:
        """(ids, the bytes they decode to) of a part between firm bounds."""
        if (known := self.shared.get(part) or self.held.get(part)) is not None:
            return known
        ids = self.encoder.plain(part.decode("utf-8", "replace"))
        known = ids, self.encoder.decode_bytes(np.frombuffer(ids, "<u4").tolist())
        if self.size > self.limit:  # start again: results do not depend on what is kept
            self.held.clear()
            self.size = 0
        self.held[part] = known
        self.size += 200 + 2 * len(part) + len(ids)
        return known

    def text(self, data: np.ndarray, places: np.ndarray, firm: np.ndarray, start: int, end: int) -> tuple[bytes, bytes]:
        raw, done, parts = data, start, []
        bounds = chunk_bounds(places, start, end)
        inner = np.searchsorted(firm, bounds)
        for k in range(len(bounds) - 1):
            left, right = inner[k], inner[k + 1] - 1
            while left <= right and firm[left] <= max(bounds[k], done):  # a firm bound at the very edge belongs to the join
                left += 1
            if left < right:
                parts += [(done, int(firm[left])), (int(firm[left]), int(firm[right]))]
                done = int(firm[right])
        parts.append((done, end))
        ids, out = zip(*[self.encode(raw[a:b].tobytes()) for a, b in parts if b > a]) if end > start else ((), ())
        return b"".join(ids), b"".join(out)


def inner_parts(data: np.ndarray, places: np.ndarray, firm: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The chunks' inner parts, as ``Reuse.text`` takes them."""
    bounds = chunk_bounds(places, start, end)
    inner = np.searchsorted(firm, bounds)
    for k in range(len(bounds) - 1):
        left, right = inner[k], inner[k + 1] - 1
        while left <= right and firm[left] <= bounds[k]:
            left += 1
        if left < right:
            yield int(firm[left]), int(firm[right])


def shared_chunks(docs: DataFrame, *, reuse_bytes: int, text_col: str = "text") -> DataFrame:
    """(part): the inner parts that save most when they are encoded once, up to ``reuse_bytes`` in all.

    All chunks of all texts are counted by hash; chunks found once are no use. What is beyond the bound is
    encoded in the tasks that meet it, with the same ids.
    """
    def count(batches):
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text")):
                places, firm = cuts(data), firm_bounds(data)
                spans = [s for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for s in inner_parts(data, places, firm, a, b)]
                if spans:
                    starts, ends = np.array(spans).T
                    hashes, one, n = np.unique(K.run_hashes(data, starts, ends), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"h": K.signed(hashes), "n": n, "size": (ends - starts)[one]})

    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(count, "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n > 1")
    slots = max(1, reuse_bytes // 2048)
    wanted = counts.orderBy(F.desc(F.expr("(n - 1) * size")), "h").limit(slots).select("h").toArrow().column("h").to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(wanted))

    def fetch(batches):
        mine = wanted.value
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text")):
                places, firm = cuts(data), firm_bounds(data)
                spans = [s for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for s in inner_parts(data, places, firm, a, b)]
                if spans and len(mine):
                    starts, ends = np.array(spans).T
                    hashes, one = np.unique(K.signed(K.run_hashes(data, starts, ends)), return_index=True)
                    one = one[np.isin(hashes, mine)]
                    yield pa.RecordBatch.from_pydict({"part": [data[starts[i]:ends[i]].tobytes() for i in one]}, schema=pa.schema([("part", pa.binary())]))

    return texts.mapInArrow(fetch, "part binary").groupBy("part").agg(F.count("*").alias("n")).select("part")


def encode(docs: DataFrame, tokenizer_path: str, *, reuse_bytes: int = 32 << 20, held_bytes: int = 64 << 20, id_col: str = "doc_id",
           text_col: str = "text", with_output: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text under a byte-level BPE vocabulary file.

    Ids are exactly those of the file's own library without added special tokens; decoding keeps special tokens.
    Texts are cut into content-defined chunks. Chunks that recur are encoded once, in a job of their own, and
    given to all tasks up to ``reuse_bytes``; a task keeps the other parts it has met up to ``held_bytes``.
    Neither bound changes a result. ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    A null text is empty; repeated rows are each answered; other columns are ignored. No text is shuffled.
    """
    spark = docs.sparkSession
    parts = shared_chunks(docs, reuse_bytes=reuse_bytes, text_col=text_col)

    def once(batches):
        encoder = encoder_at(tokenizer_path)
        for batch in batches:
            texts = batch.column("part").to_pylist()
            ids = [encoder.plain(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_pydict({"part": texts, "ids": ids}, schema=pa.schema([("part", pa.binary()), ("ids", pa.binary())]))

    rows = parts.mapInArrow(once, "part binary, ids binary").toArrow()
    shared = spark.sparkContext.broadcast(list(zip(rows.column("part").to_pylist(), rows.column("ids").to_pylist())))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    fields += [("ids", pa.list_(pa.int64()), "array<long>"), ("decoded", pa.string(), "string")] if with_output else []

    def run(batches):
        encoder = encoder_at(tokenizer_path)
        known = {part: (ids, encoder.decode_bytes(np.frombuffer(ids, "<u4").tolist())) for part, ids in shared.value}
        reuse = Reuse(encoder, known, held_bytes)
        special = [s.encode() for s in encoder.special]
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, offsets in K.slices(batch.column("text")):
                places, firm = cuts(data), firm_bounds(data)
                whole = data.tobytes()
                rare = any(s in whole for s in special)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if rare and any(s in whole[a:b] for s in special):
                        pairs = []
                        for part, token in encoder.parts(whole[a:b].decode("utf-8", "replace")):
                            if token is not None:
                                pairs.append((np.array([token], "<u4").tobytes(), part.encode()))
                            elif part:
                                own = np.frombuffer(part.encode(), np.uint8)
                                pairs.append(reuse.text(own, cuts(own), firm_bounds(own), 0, len(own)))
                        ids, text = b"".join(p[0] for p in pairs), b"".join(p[1] for p in pairs)
                    else:
                        ids, text = reuse.text(data, places, firm, a, b)
                    text = text.decode("utf-8", "replace")
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
                                *((np.frombuffer(ids, "<u4").astype(np.int64), text) if with_output else ())))
            columns = list(zip(*out)) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f[1]) for c, f in zip(columns, fields)]],
                                             names=["doc_id", *[f[0] for f in fields]])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, " + ", ".join(f"{n} {kind}" for n, _, kind in fields))
