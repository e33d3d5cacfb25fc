"""Operators 11 (token files), 12 (periodic runs) and 13 (source divergence)."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowharvest.llm import divergence, kernel, runs, token_files
from rowharvest.llm.queries import tokenizer
from tests.llm.helpers import frame, prose
from tests.llm.test_text_operators import AWKWARD

WORDS = "word_bpe_49k.json"
SIGNS = "aBé'’ .,-1́×÷É ß中😀\n\t<|\x1c\x0b\x85ſKİı>s<"


# 11: token files -------------------------------------------------------------------------------------------------------------------

def library_ids(texts, path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return [made.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def encode_locally(texts, words):
    parts, rows = token_files.units(*kernel.text_buffer(pa.array(texts)))
    ids, counts = words.encode(parts)
    ends = np.cumsum(np.bincount(rows, weights=counts, minlength=len(texts)).astype(int))
    return [x.tolist() + [1] for x in np.split(ids, ends[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=40) | st.text(max_size=20) | st.just("<|endoftext|>A"), min_size=1, max_size=5))
def test_parts_encode_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode_locally(texts, token_files.words_at(tokenizer(WORDS), 1)) == library_ids(texts, tokenizer(WORDS))


def test_every_ascii_character_and_forgotten_words():
    words = token_files.Words(tokenizer(WORDS), 1)
    texts = ["".join(map(chr, range(1, 128))), " ".join(f"x{chr(c)}y {chr(c)}s" for c in range(1, 128)), "it's 'S don''t rock'n'roll 5's x' <|ENDOFTEXT|>b"]
    token_files.HELD_WORDS, limit = 3, token_files.HELD_WORDS
    try:
        assert encode_locally(texts, words) == library_ids(texts, tokenizer(WORDS))
    finally:
        token_files.HELD_WORDS = limit


def test_long_texts_are_cut_at_blanks_only():
    data = np.frombuffer(b"ab cd" * 10 + b"x" * 40 + b" y", np.uint8)
    bounds = token_files.blank_bounds(data, 7)
    assert bounds[0] == 0 and bounds[-1] == len(data) and all(data[b - 1] == 32 for b in bounds[1:-1]) and len(bounds) > 4


@pytest.mark.parametrize("file_bytes", [300, 64 << 20])
def test_token_files_are_the_corpus_in_order(spark, tmp_path, monkeypatch, file_bytes):
    rng = random.Random(file_bytes)
    monkeypatch.setattr(token_files, "TEXT_BYTES", 200)
    texts = AWKWARD + [prose(rng, rng.randrange(40)) for _ in range(60)] + ["same"] * 40
    ids = [rng.randrange(1000) for _ in range(len(texts) - 40)] + [7] * 40  # one id of many rows
    ids[5] = None
    docs = frame(spark, texts, ids=ids).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash")).withColumn("tie", F.lit(1))
    path = f"file:{tmp_path}/out"
    files = token_files.write_token_files(docs, path, tokenizer(WORDS), file_bytes=file_bytes)
    want = sorted(zip([-1 if i is None else i for i in ids], library_ids(texts, tokenizer(WORDS))))
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    assert (files.count() > 4) == (file_bytes == 300)
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 2
        at += r["n_tokens"]
    whole = [x for r in got for x in np.frombuffer(r["ids"], "<u2").tolist()]
    reader = token_files.TokenFiles(path)
    assert reader.n_ids == len(whole)
    for start in (0, 1, 150, len(whole) - 5):
        assert reader.window(start, 300).tolist() == whole[start:start + 300]
    assert [reader.document(i).tolist() for i in range(len(got))] == [np.frombuffer(r["ids"], "<u2").tolist() for r in got]


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert token_files.write_token_files(frame(spark, []), path, tokenizer(WORDS)).count() == 0
    assert token_files.read_documents(spark, path).count() == 0 and token_files.TokenFiles(path).window(0, 9).tolist() == []


def test_other_tokenizers_are_called_with_whole_texts(spark, tmp_path):
    texts = AWKWARD[:11] + [" a  b's\n"]
    path = f"{tmp_path}/out"
    token_files.write_token_files(frame(spark, texts), path, tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_files.read_documents(spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == library_ids(texts, tokenizer("byte_bpe_50k.json"))


# 12: runs --------------------------------------------------------------------------------------------------------------------------

def plain_runs(words, shortest=12):
    """Every stretch that no neighbour extends, under its smallest period: all periods, word by word."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, 2 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, p, e - s) for (s, e), p in best.items())


def collapse(words, found):
    gone = {i for s, p, length in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeat_tail(words, h):
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


@pytest.mark.parametrize("case", range(60))
def test_maximal_runs_equal_brute_force(case):
    rng = random.Random(case)
    docs = []
    for _ in range(rng.randrange(1, 8)):
        words = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.choice((0, 1, 11, 12, 13, 60, 250)))]
        docs.append(repeat_tail(words, 10 * rng.randrange(10_000)) if rng.random() < 0.6 else words)
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    shortest = rng.choice((2, 5, 12))
    start, end, period = runs.maximal_runs(np.array([w for d in docs for w in d], np.int64), bounds, shortest)
    row = np.searchsorted(bounds, start, "right") - 1
    for i, words in enumerate(docs):
        mine = row == i
        assert list(zip((start[mine] - bounds[i]).tolist(), period[mine].tolist(), (end - start)[mine].tolist())) == plain_runs(words, shortest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=120), st.integers(1, 6))
def test_common_extensions_of_all_pairs(signs, times):
    text = np.array(signs * times, np.int64)
    n = len(text)
    a, b = np.meshgrid(np.arange(n), np.arange(n))
    a, b = a[a != b], b[a != b]
    got = runs.Extensions(text).common(a, b)
    for x, y, g in list(zip(a.tolist(), b.tolist(), got.tolist()))[::max(1, len(a) // 2000)]:
        k = 0
        while max(x, y) + k < n and text[x + k] == text[y + k]:
            k += 1
        assert g == k


def test_cover_reaches_every_difference():
    assert {(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD)) and runs._shifts().max() < runs.PERIOD


def test_range_minimum():
    values = np.random.default_rng(1).integers(0, 1000, 700)
    low, high = np.triu_indices(700)
    assert (runs.RangeMinimum(values).least(low[::7], high[::7]) == [values[a:b + 1].min() for a, b in zip(low[::7], high[::7])]).all()


def test_find_runs_and_its_query_columns(spark, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 1 << 10)
    rng = random.Random(2)
    texts = AWKWARD + ["\u0085a b  " * 20, "a b " * 9 + "c " + "a b c " * 7, "x y\tx\ny " * 40] + [prose(rng, rng.randrange(300)) for _ in range(80)]
    ids = list(range(len(texts) - 1)) + [None]
    docs = frame(spark, texts, ids=ids).withColumn("runs", F.lit("clash")).withColumn("seed", F.lit("clash")).withColumn("collapsed", F.lit(1))
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    got = {r["doc_id"]: r for r in runs.find_runs(docs, seed=seed).collect()}
    for i, text in zip(ids, texts):
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
        words = repeat_tail(words, zlib.crc32(("" if i is None else str(i)).encode()))
        want = plain_runs(words) if len(words) < 2000 else [tuple(x) for x in got[i]["runs"]]
        assert [tuple(x) for x in got[i]["runs"]] == want and got[i]["collapsed"] == collapse(words, want)
    assert [tuple(x) for x in got[AWKWARD.index("word " * 3000)]["runs"]] == [(0, 1, 3000)]
    assert runs.find_runs(docs.limit(0)).count() == 0 and runs.find_runs(frame(spark, ["a"] * 3, ids=[1, 1, 1])).count() == 3


# 13: source divergence -------------------------------------------------------------------------------------------------------------

def audit(rows, least=10, top=10):
    import re

    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(whole)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block_terms, tile, text_bytes", [(1 << 16, 64, 4 << 20), (7, 2, 150)])
def test_divergence_equals_brute_force(spark, monkeypatch, block_terms, tile, text_bytes):
    monkeypatch.setattr(divergence, "TEXT_BYTES", text_bytes)
    rng = random.Random(tile)
    pool = [f"{a}{b}" for a in "abcdé" for b in ("xx", "Yy", "中", "ß", "q")]
    rows = [(t, rng.choice(("l1", None)), f"s{rng.randrange(3)}") for t in AWKWARD]
    rows += [(" ".join(rng.choice(pool[:rng.randrange(2, 25)]) for _ in range(rng.randrange(1, 60))), rng.choice(("l1", "l2")), rng.choice(("a", "b", "c", "É", None)))
             for _ in range(150)]
    rows += [("lonely words", "l3", "a"), ("other words", "l3", "b"), (None, "l4", "only"), ("again again", "l2", "hot")] + [("again again", "l2", "hot")] * 30
    docs = spark.createDataFrame([(1, *r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, number int")
    got = divergence.source_divergence(docs, block_terms=block_terms, tile=tile)
    assert sorted(map(tuple, got.collect())) == audit(rows)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_run_columns_meet_as_dense_ones_do():
    rng = np.random.default_rng(0)
    for size in (1, 2, 9, 60):
        dense, coded = [], []
        for _ in range(2):
            places = np.flatnonzero(rng.random(size) < 0.5)
            values = rng.integers(1, 4, len(places))
            full = np.full(size, 2)
            full[places] = values
            dense.append(full)
            coded.append(divergence.runs_of(places, values, size, 2))
            assert (np.diff(coded[-1][1]) != 0).all()
        assert divergence.compared(*coded, size) == int(divergence.gap(*dense).sum())


def test_shares_are_exact_beyond_a_long(spark):
    n = 9 * 10**17
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(n), F.lit(3)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (n + 6)
