"""Operator 7, language ID: unigram pieces per language, summed over all segmentations of each word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import remainder, stored

#: Words up to so many bytes are summed many at once; their probabilities are normal numbers. Longer ones go place by place, in logarithms.
SHORT_WORD = 32
#: Places of a long word whose pieces are looked up at once.
PLACES = 4096
#: Text that is scored at once.
SCORE_BYTES = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Vocabulary:
    """A fixed public vocabulary as byte strings, found by the hash of a byte run.

    The vocabulary's word mark is written as a space before the word; its byte pieces are single
    bytes, so every word has at least one segmentation.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, int] = {bytes([i]): i for i in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces.setdefault(model.id_to_piece(i).replace("▁", " ").encode(), len(pieces))
        self.size = len(pieces)
        #: Bytes of the longest piece that a word can hold: a word has a space in front only.
        self.longest = max(len(text) for text in pieces if b" " not in text[1:])
        hashes = np.zeros(self.size, np.uint64)
        for text, i in pieces.items():
            h = 0
            for byte in text:
                h = (h * K.BASE + byte + 1) % 2**64
            hashes[i] = h
        self.hashes = np.append(hashes, np.uint64(0))  # the last one is no piece
        slots = self._slot(hashes)
        self.first = np.full(1 << 20, self.size, np.int32)
        self.first[slots] = np.arange(self.size)
        left = np.flatnonzero(self.first[slots] != np.arange(self.size))  # share a slot with another piece
        self.rest = np.sort(hashes[left])
        self.rest_ids = left[np.argsort(hashes[left])]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or ``size``."""
        ids = self.first[self._slot(h)]
        ids = np.where(self.hashes[ids] == h, ids, self.size)
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            ids = np.where(self.rest[at] == h, self.rest_ids[at], ids)
        return ids


@lru_cache(maxsize=2)
def vocabulary_at(path: str) -> Vocabulary:
    """Loaded once per worker process."""
    return Vocabulary(path)


def word_matrix(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """One row per word: a space, then its bytes."""
    rows = np.full((len(starts), length + 1), 32, np.uint8)
    rows[:, 1:] = data[starts[:, None] + np.arange(length)]
    return rows


def steps(vocabulary: Vocabulary, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece of each word there) for all byte runs that are a piece in some word, by start."""
    length = rows.shape[1]
    for i in range(length):
        h = np.zeros(len(rows), np.uint64)
        for j in range(i, min(length, i + vocabulary.longest)):
            h = h * K.U64(K.BASE) + rows[:, j] + K.U64(1)
            ids = vocabulary.find(h)
            if (ids != vocabulary.size).any():
                yield i, j + 1, ids


def forward(vocabulary: Vocabulary, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of each word under each column of ``p`` (pieces + 1 row of zeros x languages)."""
    alpha = np.zeros((rows.shape[1] + 1, len(rows), p.shape[1]))
    alpha[0] = 1
    for i, j, ids in steps(vocabulary, rows):
        alpha[j] += alpha[i] * p[ids]
    return alpha[-1]


def expected(vocabulary: Vocabulary, rows: np.ndarray, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of every piece over all segmentations of the words (one language)."""
    found = list(steps(vocabulary, rows))
    n = rows.shape[1]
    alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
    alpha[0] = beta[n] = 1
    for i, j, ids in found:
        alpha[j] += alpha[i] * p[ids]
    for i, j, ids in reversed(found):
        beta[i] += beta[j] * p[ids]
    share = weights / alpha[n]
    total = np.zeros(vocabulary.size + 1)
    for i, j, ids in found:
        total += np.bincount(ids, weights=alpha[i] * p[ids] * beta[j] * share, minlength=len(total))
    return total[:-1]


def pieces_ending(vocabulary: Vocabulary, word: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The piece of l + 1 bytes whose last byte is at each place from ``first`` to ``stop`` (excluded), or no piece: places x lengths."""
    places = np.arange(first, stop)
    h, power = np.zeros(len(places), np.uint64), 1
    ids = np.full((len(places), vocabulary.longest), vocabulary.size, np.int32)
    for back in range(vocabulary.longest):
        begin = places - back
        h += (word[np.maximum(begin, 0)].astype(np.uint64) + K.U64(1)) * K.U64(power)
        power = power * K.BASE % 2**64
        inside = begin >= 0
        ids[inside, back] = vocabulary.find(h[inside])
    return ids


def pieces_beginning(vocabulary: Vocabulary, word: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The same by the places of their first bytes."""
    behind = min(len(word), stop + vocabulary.longest)
    ending = np.full((behind - first + vocabulary.longest, vocabulary.longest), vocabulary.size, np.int32)
    ending[:behind - first] = pieces_ending(vocabulary, word, first, behind)
    lengths = np.arange(vocabulary.longest)
    return ending[np.arange(stop - first)[:, None] + lengths, lengths]


def chain(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Logarithms of a[1], a[2], ... in parts, where a[0] = 1 and a[j + 1] = sum over l of weights[j, l] a[j - l] (places x lengths x languages).

    The last values are scaled every few places, so that no word is too long for them.
    """
    recent = scale = None
    for weights in parts:
        n, longest, languages = weights.shape
        if recent is None:
            recent, scale = np.zeros((longest, languages)), np.zeros(languages)
            recent[0] = 1
        values, scales = np.empty((n, languages)), np.empty((n, languages))
        held = np.empty((n + longest, languages))  # backwards: what came last is first
        held[n:] = recent
        for j in range(n):
            at = n - 1 - j
            values[j] = held[at] = (weights[j] * held[at + 1:at + 1 + longest]).sum(axis=0)
            scales[j] = scale
            if j % 4 == 3 or j == n - 1:
                most = held[at:at + longest].max(axis=0)
                held[at:at + longest] /= most
                scale = scale + np.log(most)
        recent = held[:longest].copy()
        yield np.log(values) + scales


def long_word(vocabulary: Vocabulary, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of one word of any length (with its space) under each column of ``p``."""
    last = None
    for last in chain(p[pieces_ending(vocabulary, word, at, min(len(word), at + PLACES))] for at in range(0, len(word), PLACES)):
        pass
    return last[-1]


def expected_of_long(vocabulary: Vocabulary, word: np.ndarray, weight: float, p: np.ndarray) -> np.ndarray:
    """``expected`` for one word of any length."""
    n, column = len(word), p[:, None]
    bounds = [(at, min(n, at + PLACES)) for at in range(0, n, PLACES)]
    alpha = np.concatenate([[0.0], *(x[:, 0] for x in chain(column[pieces_ending(vocabulary, word, a, b)] for a, b in bounds))])
    beta = np.concatenate([[0.0], *(x[:, 0] for x in chain(column[pieces_beginning(vocabulary, word, a, b)[::-1]] for a, b in reversed(bounds)))])[::-1]
    total = np.zeros(vocabulary.size + 1)
    for a, b in bounds:
        ids = pieces_ending(vocabulary, word, a, b)
        place, length = np.nonzero(ids != vocabulary.size)
        own, end = ids[place, length], place + a + 1
        share = np.exp(alpha[end - length - 1] + np.log(p[own]) + beta[end] - alpha[n])
        total += np.bincount(own, weights=share * weight, minlength=len(total))
    return total[:-1]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, distinct word of each occurrence)."""
    _, first, inverse = np.unique(K.run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return first, inverse


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, word matrix) of words of one length, at most ``limit`` at once."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, bounds):
        for at in range(0, len(same), limit):
            part = same[at:at + limit]
            yield part, word_matrix(data, starts[part], int(lengths[part[0]]))


@dataclass
class Model:
    """Languages in ascending order and, for each, the probability of every piece (last row: no piece)."""

    vocabulary_path: str
    languages: list[str]
    p: np.ndarray

    def score(self, vocabulary: Vocabulary, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, probability of it) for every text."""
        predicted, sure = [], []
        at_once = max(500, 40_000 // len(self.languages))  # words: their tables are words x languages x places
        for first, stop, data, offsets in K.slices(column, SCORE_BYTES):
            starts, ends, rows = K.words(data, offsets, K.TOKEN)
            totals = np.zeros((stop - first, len(self.languages)))
            if len(starts):
                one, inverse = distinct_words(data, starts, ends)
                logs = np.empty((len(one), len(self.languages)))
                long = ends[one] - starts[one] > SHORT_WORD
                short = np.flatnonzero(~long)
                for part, matrix in by_length(data, starts[one[short]], ends[one[short]], at_once):
                    logs[short[part]] = np.log(forward(vocabulary, matrix, self.p))
                for w in np.flatnonzero(long).tolist():
                    logs[w] = long_word(vocabulary, word_matrix(data, starts[one[w:w + 1]], int(ends[one[w]] - starts[one[w]]))[0], self.p)
                for g in range(len(self.languages)):
                    totals[:, g] = np.bincount(rows, weights=logs[inverse, g], minlength=stop - first)
            best = totals.argmax(axis=1)
            chance = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            letters, some = np.zeros(stop - first, bool), np.flatnonzero(np.diff(offsets))
            if len(some):
                letters[some] = np.logical_or.reduceat((K.LOWER[data] >= 97) & (K.LOWER[data] <= 122), offsets[some])
            for i in np.flatnonzero(~letters).tolist():
                letters[i] = bool(LETTER.search(bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace")))
            del starts, ends, rows
            predicted += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            sure.append(np.where(letters, chance, 0.0))
        return predicted, np.concatenate(sure) if sure else np.empty(0)


def train(docs: DataFrame, vocabulary_path: str, *, sample_per_language: int = 2_000, rounds: int = 3, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Piece probabilities per language by expectation-maximisation over all segmentations.

    The classifier is fitted on a bounded sample: about ``sample_per_language`` documents of each language
    (all, if there are fewer), chosen by a hash of id and text. Languages are all non-null values of ``lang``.
    The driver gets the piece table only: vocabulary x languages numbers.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    vocabulary = vocabulary_at(vocabulary_path)
    p = np.zeros((vocabulary.size + 1, max(1, len(languages))))
    p[:-1] = 1 / vocabulary.size
    if not languages:
        return Model(vocabulary_path, [UNKNOWN], p)
    share = F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(min(1.0, sample_per_language / sizes[g])))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches):
        for batch in batches:
            for g in set(batch.column("lang").to_pylist()):
                column = batch.filter(pa.compute.equal(batch.column("lang"), g)).column("text")
                for _, _, data, offsets in K.slices(column):
                    starts, ends, _ = K.words(data, offsets, K.TOKEN)
                    if len(starts):
                        one, inverse = distinct_words(data, starts, ends)
                        yield pa.RecordBatch.from_pydict({
                            "lang": [g] * len(one), "word": [data[s:e].tobytes() for s, e in zip(starts[one], ends[one])],
                            "n": np.bincount(inverse).astype(np.int64)})

    words = stored(chosen.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "language-words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches):
            words_of = vocabulary_at(vocabulary_path)
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                names = np.array(batch.column("lang").to_pylist(), dtype=object)
                data, offsets = K.text_buffer(batch.column("word").cast(pa.large_binary()).view(pa.large_string()))
                weights = batch.column("n").to_numpy().astype(float)
                for g in sorted(set(names.tolist())):
                    mine = np.flatnonzero(names == g)
                    total = totals.setdefault(g, np.zeros(words_of.size))
                    own = shared.value[:, languages.index(g)]
                    long = np.diff(offsets)[mine] > SHORT_WORD
                    short = mine[~long]
                    for part, matrix in by_length(data, offsets[:-1][short], offsets[1:][short], 4_000):
                        total += expected(words_of, matrix, weights[short][part], own)
                    for w in mine[long].tolist():
                        total += expected_of_long(words_of, word_matrix(data, offsets[w:w + 1], int(offsets[w + 1] - offsets[w]))[0], weights[w], own)
            for g, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [g] * len(at), "piece": at.astype(np.int64), "n": total[at]})

        rows = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(p)
        at = [languages.index(g) for g in rows.column("lang").to_pylist()]
        counts[rows.column("piece").to_numpy(), at] = rows.column("n").to_numpy()
        counts[:-1] += 0.1  # every piece stays possible
        p = counts / counts.sum(axis=0)
        p[-1] = 0
    return Model(vocabulary_path, languages, p)


def _predictor(docs: DataFrame, model: Model):
    """A function of a text column -> (languages, scores), for use inside tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(vocabulary: Vocabulary, column: pa.Array):
        return shared.value.score(vocabulary, column)

    return predict


def predict_language(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the text alone.

    score is the probability of the language among the learned ones, all equally likely beforehand.
    Words count whole, whatever their length, with every piece of the vocabulary.
    A text that is null or without a letter gets 'und' and 0; ties go to the first name. Repeated rows
    are each answered, other columns are ignored, an empty table gives an empty result. No shuffle.
    """
    predict, path = _predictor(docs, model), model.vocabulary_path

    def run(batches):
        vocabulary = vocabulary_at(path)
        for batch in batches:
            names, scores = predict(vocabulary, batch.column("text"))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, model: Model, *, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language: not 'und', and at least ``min_score`` sure. All columns stay."""
    predict, path = _predictor(docs, model), model.vocabulary_path

    def run(batches):
        vocabulary = vocabulary_at(path)
        for batch in batches:
            names, scores = predict(vocabulary, batch.column(text_col))
            pa.default_memory_pool().release_unused()
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_part(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return docs.where(remainder(id_col, 4) != 2)
