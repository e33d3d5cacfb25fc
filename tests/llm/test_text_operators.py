import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowharvest.llm import chunked_bpe, decontaminate, kernel, language, lines, personal_data, queries, suffixes, trie_lm, weighted_minhash
from rowharvest.llm.queries import tokenizer
from tests.llm.helpers import components, frame, prose, shingle_counts, weighted_jaccard, word_list

AWKWARD = [None, "", " \n\t", "x", "É É é\nß", "a\r\nb\n", "tie", "tie", "word " * 3000, "y" * 20_000, "<|endoftext|> and <|endoftext|>\n\n  x ",
           "emoji 😀 text nbsp　wide"]


def rows(df, *key):
    return sorted(map(tuple, df.select(*key).collect()), key=repr)


# kernel ------------------------------------------------------------------------------------------------------------------------------

def test_run_hashes_depend_on_the_bytes_only():
    column = pa.array(["ab cd ab", None, "", "cd", "CD éé"])
    seen = {}
    for first, stop, data, offsets in kernel.slices(column, 4):
        starts, ends, row = kernel.words(data, offsets)
        for s, e, h in zip(starts, ends, kernel.run_hashes(data, starts, ends, lower=True)):
            assert seen.setdefault(bytes(data[s:e]).lower(), h) == h
    assert sorted(seen) == sorted([b"ab", b"cd", "éé".encode()]) and len(set(seen.values())) == 3


# 8: lines ------------------------------------------------------------------------------------------------------------------------------

def cut_lines(texts, least):
    strip = " \t\n\x0b\x0c\r"
    fold = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(strip))
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in split for k in {fold(x) for x in ls} if k)
    gone = {k for k, n in seen.items() if n >= least}
    return [(len(ls), sum(fold(x) in gone for x in ls), "\n".join(x for x in ls if fold(x) not in gone)) for ls in split]


@pytest.mark.parametrize("least", [1, 2, 3, 10])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    pool = ["Shared line", " shared LINE\t", "ÉTÉ", "été", "Été", "", "  ", "a|b", "ßa", "日本", "ÃA", "ãa"] + [f"line {i}" for i in range(30)]
    texts = AWKWARD + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = lines.line_dedup(frame(spark, texts), min_documents=least).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == cut_lines(texts, least)


def test_line_dedup_keeps_repeated_rows_null_ids_and_other_columns(spark):
    texts = ["same\nown 1", "same\nown 1", "same\nown 2", None]
    docs = frame(spark, texts, ids=[1, 1, None, None]).withColumn("kept", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    assert rows(lines.line_dedup(docs, min_documents=3), "doc_id", "kept") == rows(
        spark.createDataFrame([(1, "own 1"), (1, "own 1"), (None, "own 2"), (None, "")], "doc_id long, kept string"), "doc_id", "kept")
    whole = lines.drop_common_lines(docs, min_documents=3)
    assert whole.columns == docs.columns and {r["kept"] for r in whole.collect()} == {"clash"}
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_min_chars_counts_code_points(spark):
    got = lines.line_dedup(frame(spark, ["éé\nabc", "éé\nabc"]), min_documents=2, min_chars=3).collect()
    assert {r["kept"] for r in got} == {"éé"}


# 7: language ------------------------------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    vocabulary = language.vocabulary_at(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = np.append(rng.random(vocabulary.size), 0)[:, None] / 1000
    word = b" nation"
    data = np.frombuffer(word[1:], np.uint8)
    matrix = language.word_matrix(data, np.array([0]), len(data))

    def piece(part):
        h = 0
        for byte in part:
            h = (h * kernel.BASE + byte + 1) % 2**64
        return int(vocabulary.find(np.array([h], np.uint64))[0])

    def total(at):
        return 1.0 if at == len(word) else sum(p[piece(word[at:end]), 0] * total(end) for end in range(at + 1, len(word) + 1))

    assert language.forward(vocabulary, matrix, p)[0, 0] == pytest.approx(total(0), rel=1e-9)
    counts = language.expected(vocabulary, matrix, np.array([2.0]), p[:, 0])
    lengths = np.zeros(vocabulary.size)
    for part in {word[a:b] for a in range(len(word)) for b in range(a + 1, len(word) + 1)}:
        if piece(part) < vocabulary.size:
            lengths[piece(part)] = len(part)
    assert counts @ lengths == pytest.approx(2 * len(word))  # every segmentation covers the word


def test_long_words_sum_like_short_ones(monkeypatch):
    vocabulary = language.vocabulary_at(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random((vocabulary.size, 2)), np.zeros((1, 2))]) / vocabulary.size
    text = b"internationalization_of_responsibilities" + bytes(rng.integers(97, 110, 60).tolist()) + "日本語".encode()
    data = np.frombuffer(text, np.uint8)
    assert vocabulary.longest > 16
    for places in (7, 4096):
        monkeypatch.setattr(language, "PLACES", places)
        for n in (1, 6, 7, 20, 45):
            matrix = language.word_matrix(data, np.array([0]), n)
            assert language.long_word(vocabulary, matrix[0], p) == pytest.approx(np.log(language.forward(vocabulary, matrix, p)[0]), rel=1e-9)
            want = language.expected(vocabulary, matrix, np.array([3.0]), p[:, 0])
            assert language.expected_of_long(vocabulary, matrix[0], 3.0, p[:, 0]) == pytest.approx(want, rel=1e-9, abs=1e-12)
    # Far below the least normal number: exact rational sums over all segmentations.
    word, exact = language.word_matrix(np.tile(data, 3), np.array([0]), 3 * len(data))[0], [Fraction(1)]
    ids = language.pieces_ending(vocabulary, word, 0, len(word))
    for j in range(len(word)):
        exact.append(sum(Fraction(float(p[ids[j, l], 0])) * exact[j - l] for l in range(min(j + 1, vocabulary.longest)) if ids[j, l] < vocabulary.size))
    want = (math.log(exact[-1].numerator >> (exact[-1].numerator.bit_length() - 60)) + (exact[-1].numerator.bit_length() - 60) * math.log(2)
            - math.log(exact[-1].denominator >> (exact[-1].denominator.bit_length() - 60)) - (exact[-1].denominator.bit_length() - 60) * math.log(2))
    assert want < -750 and language.long_word(vocabulary, word, p)[0] == pytest.approx(want, rel=1e-9)
    lengths = np.array([0] * vocabulary.size)
    places, ends = np.nonzero(ids != vocabulary.size)
    lengths[ids[places, ends]] = ends + 1
    assert language.expected_of_long(vocabulary, word, 1.0, p[:, 0]) @ lengths == pytest.approx(len(word))


def test_language_learns_from_words_longer_than_any_table(spark):
    made = [(g, "".join(random.Random(i).choices(letters, k=300))) for i in range(40) for g, letters in (("xx", "abcab"), ("yy", "abccc"))]
    docs = frame(spark, [t for _, t in made], langs=[g for g, _ in made])
    model = language.train(docs.where("doc_id % 4 < 2"), tokenizer("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, model).collect()}
    assert all(got[i] == g for i, (g, _) in enumerate(made) if i % 4 > 1)


def test_language_held_out_accuracy_and_awkward_texts(spark):
    words = {"xx": "la le du de une".split(), "yy": "the of and with a".split()}
    rng = random.Random(1)
    made = [(g, " ".join(rng.choice(words[g]) + rng.choice(("", "s", "ing" if g == "yy" else "eaux")) for _ in range(20))) for g in ("xx", "yy") for _ in range(60)]
    docs = frame(spark, [t for _, t in made], langs=[g for g, _ in made])
    model = language.train(docs.where("doc_id % 3 > 0"), tokenizer("piece_bpe_32k.model"), sample_per_language=30)
    got = {r["doc_id"]: r for r in language.predict_language(docs, model).collect()}
    assert all(got[i]["lang_pred"] == g for i, (g, _) in enumerate(made) if i % 3 == 0)
    odd = language.predict_language(frame(spark, AWKWARD + ["1234 -- 99", "日本語"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [not any(c.isalpha() for c in t or "") for t in AWKWARD + ["1234 -- 99", "日本語"]]
    assert all(0 <= r["score"] <= 1 for r in odd)
    kept = language.keep_known_languages(frame(spark, AWKWARD), model, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 3
    nothing = language.train(docs.limit(0), tokenizer("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in language.predict_language(docs, nothing).collect()} == {"und"}


# 5: BPE ------------------------------------------------------------------------------------------------------------------------------

def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(5)
    signs = ["a", "B", "é", " ", "  ", "\n", "\r\n", "\t", "'s", "9", "…", "😀", " ", "　", "<|endoftext|>", ".", "word", " the"]
    shared = prose(rng, 1500)
    texts = AWKWARD + ["".join(rng.choice(signs) for _ in range(rng.randrange(400))) for _ in range(150)] + [
        prose(rng, 30) + shared + prose(rng, 30) for _ in range(5)]
    got = chunked_bpe.encode(frame(spark, texts), tokenizer("byte_bpe_50k.json"), reuse_bytes=1 << 16, held_bytes=1 << 14, with_output=True)
    for r in got.collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text == (texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chunks_are_the_same_wherever_a_passage_stands():
    rng = random.Random(3)
    passage = prose(rng, 4000).encode()
    found = []
    for before in (b"", prose(rng, 100).encode()):
        data = np.frombuffer(before + passage, np.uint8)
        parts = chunked_bpe.inner_parts(data, chunked_bpe.cuts(data), chunked_bpe.firm_bounds(data), 0, len(data))
        found.append({data[a:b].tobytes() for a, b in parts})
    assert len(found[0] & found[1]) > 0.8 * len(found[0])


# 6: MinHash --------------------------------------------------------------------------------------------------------------------------

def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    weights = rng.random(400) * 3 + 0.2
    a, b = values[:320], values[60:]
    true = weighted_minhash.similarity((a, weights[:320]), (b, weights[60:] * 1.2))
    joined, w = np.concatenate([a, b]), np.concatenate([weights[:320], weights[60:] * 1.2])
    rows_ = np.repeat([0, 1], [len(a), len(b)])
    agree = []
    for salt in range(40):
        _, keys = weighted_minhash.signatures(kernel.mix(joined + np.uint64(salt)), w, rows_, 2)
        agree.append((keys[0] == keys[1]).mean())
    assert np.mean(agree) == pytest.approx(true ** weighted_minhash.ROWS, abs=0.06)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts, base = list(AWKWARD), [prose(rng, 80, 5000) for _ in range(12)]
    for i, text in enumerate(base):
        words = text.split()
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(copy).upper() if k == 1 else ", ".join(copy))
    texts += ["alpha beta", "Alpha, BETA", "alpha gamma"]
    counts = [shingle_counts(word_list(t)) for t in texts]
    seen = Counter(s for c in counts for s in c)
    weight = lambda s: 1 + math.log(len(texts) / seen[s]) if seen[s] >= 0.02 * len(texts) else 1 + math.log(50)
    sims = {(a, b): weighted_jaccard(counts[a], counts[b], weight) for a in range(len(texts)) for b in range(a) if counts[a] and counts[b]}
    want = components(range(len(texts)), [k for k, v in sims.items() if v >= 0.8])
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(frame(spark, texts)).collect()}
    unsure = {x for k, v in sims.items() if 0.8 <= v < 0.86 for x in k}  # banding may miss one in a hundred here
    assert {k: v for k, v in got.items() if k not in unsure} == {k: v for k, v in want.items() if k not in unsure}
    kept = weighted_minhash.keep_first_of_class(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if k == v} and kept.columns == frame(spark, texts).columns


def test_near_duplicates_link_through_a_third_text(spark):
    words = [f"t{i}" for i in range(120)]
    first, second, third = list(words), list(words), list(words)
    second[10:12] = ["p", "q"]
    third[10:12], third[100:102] = ["p", "q"], ["r", "s"]
    docs = frame(spark, [" ".join(x) for x in (third, first, second)], ids=[5, 9, 2])
    assert {r["class_id"] for r in weighted_minhash.near_duplicates(docs).collect()} == {2}
    assert weighted_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_rare_shingles_weigh_by_their_own_document_counts(spark):
    rng = random.Random(12)
    boilerplate = prose(rng, 134, 10**6)  # in 6 of 400 documents: 1.5 %
    texts = [f"{boilerplate} {prose(rng, 15, 10**6)}" for _ in range(6)] + [prose(rng, 30, 10**6) for _ in range(384)]
    for _ in range(5):  # real copies
        words = prose(rng, 120, 10**6).split()
        texts += [" ".join(words), " ".join([*words[:-2], "other", "end"])]
    counts = [shingle_counts(word_list(t)) for t in texts]
    seen = Counter(s for c in counts for s in c)
    weight = lambda s: 1 + math.log(len(texts) / seen[s])
    assert weighted_jaccard(counts[0], counts[1], weight) < 0.78 < 0.81 < weighted_jaccard(counts[0], counts[1], lambda s: 1 + math.log(50))
    want = components(range(400), [(a, b) for a in range(400) for b in range(a) if counts[a].keys() & counts[b].keys()
                                   and weighted_jaccard(counts[a], counts[b], weight) >= 0.8])
    for sizes in ({}, {"block_bytes": 5_000, "shard_bytes": 2_000}):
        got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(frame(spark, texts), **sizes).collect()}
        assert got == want and len(set(got.values())) == 395


def test_near_copies_are_found_within_large_groups_of_copies(spark):
    rng = random.Random(14)
    base, texts = prose(rng, 300, 10**6).split(), []
    for i in range(150):  # copies of one text, five words changed in most of them
        copy = list(base)
        for k in range(5 * (i % 3 > 0)):
            copy[rng.randrange(60 * k, 60 * k + 50)] = f"new{i}x{k}"
        texts.append(" ".join(copy))
    footer = prose(rng, 134, 10**6)  # in 40 documents that are no copies
    texts += [f"{footer} {prose(rng, 15, 10**6)}" for _ in range(40)] + [prose(rng, 30, 10**6) for _ in range(2810)]
    counts = [shingle_counts(word_list(t)) for t in texts]
    seen = Counter(s for c in counts for s in c)
    weight = lambda s: 1 + math.log(len(texts) / seen[s])
    assert weighted_jaccard(counts[0], counts[1], weight) < 0.8 < 0.83 < weighted_jaccard(counts[0], counts[1], lambda s: 1)
    assert weighted_jaccard(counts[150], counts[151], weight) < 0.75 < 0.81 < weighted_jaccard(counts[150], counts[151], lambda s: 1)
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(frame(spark, texts)).collect()}
    assert sum(got[i] == 0 for i in range(150)) >= 147  # banding may miss one in fifty here
    assert all(got[i] == i for i in range(150, len(texts)))


def test_blocks_link_as_pairs_do():
    rng = random.Random(15)
    base = prose(rng, 90, 30).split()  # shingles that come again
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(3, 88, 4)] + [" ".join(base), " ".join(base[:70] + ["own"] * 20)]
    parts = [p for _, _, *p, _ in (next(weighted_minhash.doc_shingles(pa.array([t], pa.large_string()))) for t in texts)]
    weights = [np.where(np.isin(values, parts[-2][0]), 1.0, 2.3) for values, _ in parts]
    rows_ = [{"node": i, "component": i, "bands": [7] * 12, "elements": weighted_minhash.elements(v, n).tobytes(), "weights": np.repeat(w, n).tobytes(),
              "spelled": (np.cumsum(n) - n)[weighted_minhash.text_order(t, v)].astype(np.int32).tobytes()} for i, (t, (v, n), w) in enumerate(zip(texts, parts, weights))]
    want = set()
    for a, b in ((a, b) for b in range(len(texts)) for a in range(b)):
        (v, n), (s, m), at, to = parts[a], parts[b], weighted_minhash.text_order(texts[a], parts[a][0]), weighted_minhash.text_order(texts[b], parts[b][0])
        heavy = weighted_minhash.similarity((v, weights[a] * n), (s, weights[b] * m))
        words_ = weighted_minhash.word_similarity((v[at], weights[a][at]), (s[to], weights[b][to]))
        plain = weighted_minhash.similarity((v, n), (s, m))
        if heavy >= 0.8 or plain >= 0.8 and words_ >= 0.8 and weighted_minhash.common_weight((v, n, weights[a]), (s, m)) <= 1.5:
            want.add((a, b))
    whole, left, right = (weighted_minhash.Block(x) for x in (rows_, rows_[:10], rows_[10:]))
    pairs = lambda x, y: {tuple(sorted(p)) for p in zip(*(b.ids[i].tolist() for b, i in zip((x, y), weighted_minhash.compare(x, y, 7, 0.8, 1.5))))}
    assert pairs(whole, whole) == want and pairs(left, left) | pairs(left, right) | pairs(right, right) == want and 20 < len(want) < 276


def test_row_numbers_differ_in_late_partitions():
    made = [weighted_minhash.row_numbers(p << 32 | n, np.arange(3)) for p in (0, 1, 127, 128, 300_000) for n in (0, 1, 70_000)]
    assert len(np.unique(np.concatenate(made))) == 45 and min(x.min() for x in made) >= 0


# 9: decontamination ------------------------------------------------------------------------------------------------------------------

def brute_contaminated(texts, items):
    sets = [shingle_counts(word_list(t)) for t in items]
    seen = Counter(s for c in sets for s in c)
    n = sum(bool(c) for c in sets)
    weight = lambda s: 1 + math.log((1 + n) / seen[s]) if s in seen else 1 + math.log1p(n)
    found = set()
    for d, text in enumerate(texts):
        words = word_list(text)
        for i, own in enumerate(sets):
            length = len(word_list(items[i]))
            for start in range(max(1, len(words) - length + 1)):
                if own and words and weighted_jaccard(shingle_counts(words[start:start + length]), own, weight) >= 0.8:
                    found.add((d, i))
    return found


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng, n, 60) for n in (3, 4, 5, 12, 30, 45, 45)] + ["", None, "w1 w2 w3"]
    items.append(items[4])  # equal to another one
    texts = list(AWKWARD)
    for item in items[:7]:
        for edits in (0, 1, 2, 3):
            words = item.split()
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at:at + rng.randrange(2)] = ["zz"] * rng.randrange(2)
            texts.append(prose(rng, rng.randrange(30), 60) + " - " + ",".join(words).upper() + " " + prose(rng, rng.randrange(30), 60))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, texts), benchmark)
    want = brute_contaminated(texts, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10
    sliced = decontaminate.contaminated(frame(spark, texts), benchmark, slice_bytes=10_000)
    assert {(r["doc_id"], r["item_id"]) for r in sliced.collect()} == want
    kept = decontaminate.drop_contaminated(frame(spark, texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(frame(spark, texts), benchmark.limit(0)).count() == 0


def test_slices_do_not_change_the_weights(spark):
    rng = random.Random(19)
    template = prose(rng, 24, 10**6)
    items = [f"{template} {prose(rng, 12, 10**6)}" for _ in range(30)] + ["", None, "one two"]
    texts = [f"{prose(rng, 8, 10**6)} {' '.join(item.split()[:36 - k] + ['zz'] * k)} {prose(rng, 8, 10**6)}" for item in items[:20] for k in (0, 2, 3, 4)]
    texts += [f"{template} {prose(rng, 12, 10**6)}" for _ in range(10)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = [rows(decontaminate.contaminated(frame(spark, texts), benchmark, slice_bytes=size), "doc_id", "item_id", "first_word", "n_words", "distance", "similarity")
             for size in (1 << 20, 1_500)]
    assert found[0] == found[1] and {r[:2] for r in found[0]} == brute_contaminated(texts, items)
    assert 20 <= len(found[0]) < len(texts)


def test_matches_far_apart_in_bits_are_found(spark):
    rng = random.Random(23)
    template = prose(rng, 64, 10**6)  # 60 shingles of weight 1, two own ones of weight 7
    items = [f"{template} {prose(rng, 2, 10**6)}" for _ in range(400)]
    texts = [" ".join(["zz", *item.split()[:-1], "other"]) for item in items[:25]]
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_contaminated(texts, items) >= {(i, i) for i in range(25)}
    assert any(r["distance"] > decontaminate.RADIUS for r in got)


@pytest.mark.parametrize("away", [0, 16, 32, decontaminate.RADIUS])
def test_index_finds_every_fingerprint_within_the_radius(away):
    rng = np.random.default_rng(away)
    prints = rng.integers(0, 256, (300, 32), np.uint8)
    prints[7] = prints[3]
    index = decontaminate.HammingIndex(prints)
    for i in range(300):
        bits = np.unpackbits(prints[i])
        bits[rng.choice(256, away, replace=False)] ^= 1
        asked = np.packbits(bits)
        assert index.within(asked).tolist() == [j for j in range(300) if np.unpackbits(prints[j] ^ asked).sum() <= decontaminate.RADIUS]
    assert not len(decontaminate.HammingIndex(np.empty((0, 32), np.uint8)).within(prints[0]))


def test_index_passes_few_and_finds_most():
    """Of unlike fingerprints under 5 % are compared; of windows that reach 0.8 at least nine in ten are proposed by the index."""
    rng = np.random.default_rng(2)
    index = decontaminate.HammingIndex(rng.integers(0, 256, (4_000, 32), np.uint8))
    assert np.mean([len(index.candidates(x)) for x in rng.integers(0, 256, (200, 32), np.uint8)]) < 0.05 * 4_000

    words = random.Random(31)
    texts = [prose(words, words.randrange(20, 60), 10**6) for _ in range(300)]
    items = decontaminate.Items(list(range(len(texts))), texts, 0.8)
    edited = []
    for text in texts:
        for _ in range(3):
            parts = text.split()
            for _ in range(words.randrange(1, 3)):
                parts[words.choice((words.randrange(2), -1 - words.randrange(2), words.randrange(len(parts))))] = "other"
            edited.append(" ".join(parts))
    found = [(item, distance) for _, item, _, distance, _ in items.matches(pa.array(edited))]
    assert len(found) > 300
    assert np.mean([distance <= decontaminate.RADIUS for _, distance in found]) >= 0.9


# 10: personal data ------------------------------------------------------------------------------------------------------------------

def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "b-c", " ", "-", "1", "25", "255", "256", "+", "(", ")", "4111111111111111", "é", "_", "\n", "1.2.3.4", "x@y.z", "0" * 9]), max_size=40))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert sorted(personal_data.base_spans(text)) == brute_spans(text)


def test_base_spans_are_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        personal_data.base_spans(text)


def test_personal_data_adds_spans_and_keeps_base(spark):
    plain = [f"mail to ann{i}@site{i}.example.com or call phone +1 (555) 010-{1000 + i} from host 10.0.0.{i} card 4111111111111111 ok" for i in range(30)]
    more = [f"contact e-mail bob{i} (at) host.example (dot) com and phone (555) 123-{1000 + i}." for i in range(10)] + ["4111111111111111 5500000000000004"]
    texts = AWKWARD + plain + more
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = [tuple(s) for s in got[i]["base"]]
        assert sorted(base) == brute_spans(text or "") and set(base) <= {tuple(s) for s in got[i]["spans"]}
    assert [s["kind"] for s in got[len(texts) - 1]["spans"]] == ["card", "card"]
    assert personal_data.find_personal_data(frame(spark, [])).count() == 0


def test_reliabilities_find_the_poor_labeler():
    rng = random.Random(0)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.5
        marks = "".join(("1" if true else "0") if rng.random() < good else ("0" if true else "1") for good in (0.95, 0.9, 0.9, 0.85, 0.5))
        counts["email", "base", marks] += 1
    believed = personal_data.reliabilities(counts)
    assert believed["email", "base", "11110"] > 0.95 and believed["email", "base", "00001"] < 0.05
    assert abs(believed["email", "base", "11001"] - believed["email", "base", "11000"]) < 0.1  # the last labeler tells nothing


# 4: LM --------------------------------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=200), st.integers(0, 2**50))
def test_elias_fano_finds_successors(values, extra):
    values = np.array(sorted(values), np.uint64)
    packed = trie_lm.EliasFano.build(values, 2**50 + 1)
    assert packed.get(np.arange(len(values))).tolist() == values.tolist()
    asked = np.array([extra, 0, 2**50, *values.tolist()], np.uint64)
    assert packed.next_at(asked).tolist() == np.searchsorted(values, asked).tolist()


def brute_scores(texts, held, prior):
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    split = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + [None] for t in texts]
    train = [ws for ws, h in zip(split, held) if not h]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["<begin>", *ws], ws))
    before = lambda v: len(train) if v == "<begin>" else c[v]
    n, v = sum(c.values()), len(c)
    q = lambda w: (c[w] + 1) / (n + v + 1)
    out = []
    for ws in split:
        full = sum(math.log10((pairs[x, w] + prior * q(w)) / (before(x) + prior)) for x, w in zip(["<begin>", *ws], ws))
        out.append((len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(q(w)) for w in ws), full))
    return out


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (3_000, 2_000)])
def test_scores_equal_brute_force(spark, block, shard):
    from rowharvest.llm.common import remainder

    rng = random.Random(8)
    texts = AWKWARD + [prose(rng, rng.randrange(60), 30) + " The END" for _ in range(60)]
    docs = frame(spark, texts)
    got = trie_lm.score_texts(docs, held=remainder("doc_id", 7) == 2, block_bytes=block, shard_bytes=shard).orderBy("doc_id").collect()
    want = brute_scores(texts, [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))], 4.0)
    for r, w in zip(got, want, strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], abs=3e-4 * r["n_tokens"])
    assert trie_lm.score_texts(docs.limit(0), held=remainder("doc_id", 7) == 2).count() == 0


def test_a_frequent_bigram_is_one_entry_of_a_block(spark, monkeypatch):
    from rowharvest.llm.common import remainder

    sent, pack = spark.sparkContext.accumulator(0), trie_lm._pack_sorted  # entries of the lists of words and bigrams, by the tasks

    def counted(values):
        sent.add(len(values))
        return pack(values)

    rng = random.Random(4)
    texts = ["hot pair " * 2000 + prose(rng, 5, 9) for _ in range(30)]
    monkeypatch.setattr(trie_lm, "_pack_sorted", counted)
    docs = frame(spark, texts)
    got = trie_lm.score_texts(docs, held=remainder("doc_id", 7) == 2, block_bytes=200_000, shard_bytes=20_000).orderBy("doc_id").collect()
    assert 0 < sent.value < 5_000  # the texts have 120,180 tokens
    want = brute_scores(texts, [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))], 4.0)
    for r, w in zip(got, want, strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["score"] == pytest.approx(w[4], abs=3e-4 * r["n_tokens"])


def test_bigram_probabilities_sum_to_one():
    c, n, v, prior = {"a": 6, "b": 3, "end": 3}, 12, 3, 4.0
    q = {w: (k + 1) / (n + v + 1) for w, k in c.items()} | {"unknown": 1 / (n + v + 1)}
    pairs = {"a": 4, "b": 1, "end": 1}
    assert sum((pairs.get(w, 0) + prior * q[w]) / (6 + prior) for w in q) == pytest.approx(1)


# 2: suffixes --------------------------------------------------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.booleans())
def test_suffix_array_is_in_order(letters, doubled):
    s = np.array(letters, np.uint8)
    got = suffixes._doubled(s, 1000) if doubled and len(s) > 1 else suffixes.suffix_array(s, 256, 1000)
    assert got.tolist() == sorted(range(len(s)), key=lambda i: letters[i:])


def test_suffix_array_of_prose_and_runs():
    rng = random.Random(6)
    for text in (prose(rng, 3000, 50).encode(), b"ab" * 3000, b"a" * 3000, (prose(rng, 200).encode() + b"\xff") * 5):
        data = np.frombuffer(text, np.uint8)
        assert suffixes.suffix_array(data, 256, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(x), int(gone.sum()), runs, bytes(b for b, g in zip(x, gone) if not g)))
    return out


@pytest.mark.parametrize("length,shard", [(40, 1 << 20), (40, 3_000), (100, 1 << 20)])
def test_removed_passages_equal_brute_force(spark, length, shard):
    rng = random.Random(length)
    passages = [prose(rng, n, 900) + "é" for n in (9, 12, 20, 60)]
    texts = AWKWARD[:9] + ["z" * 500, "abc" * 100, "y" * 130]
    for _ in range(50):
        texts.append(" ".join(rng.choice([prose(rng, 10, 900), *passages]) for _ in range(rng.randrange(1, 5))))
    texts += texts[-3:]
    got = suffixes.remove_recurring(frame(spark, texts), length=length, shard_bytes=shard).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_removed(texts, length)


def test_a_line_in_all_texts_is_not_one_group(spark, monkeypatch):
    rng = random.Random(21)
    line = prose(rng, 14, 10**5)  # shorter than the windows, in every text, with other text around it
    texts = [f"{prose(rng, 12, 10**5)} {line} {prose(rng, 12, 10**5)}" for _ in range(60)]
    texts += [f"{prose(rng, 4, 10**5)} {texts[k][20:150]} {prose(rng, 4, 10**5)}" for k in range(10)] + texts[:3] + [line * 5]
    sizes, spans = spark.sparkContext.accumulator(0), suffixes.recurring_spans

    def bounded(parts, owners, length):
        sizes.add(max(0, sum(map(len, parts)) - 6_000))
        return spans(parts, owners, length)

    monkeypatch.setattr(suffixes, "recurring_spans", bounded)
    got = suffixes.remove_recurring(frame(spark, texts), length=120, shard_bytes=1_000).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_removed(texts, 120)
    assert sum(r["n_removed"] > 0 for r in got) >= 20 and sizes.value == 0


@pytest.mark.parametrize("length,passage,shard", [(120, 60, 1 << 20), (120, 60, 1_000), (60, 120, 1 << 20), (80, 80, 1 << 20)])
def test_texts_that_share_a_shorter_passage_are_told(spark, length, passage, shard):
    rng = random.Random(passage)
    line = prose(rng, 7, 10**5)[:40]
    texts = [f"{prose(rng, rng.randrange(5, 40), 10**5)} {line} {prose(rng, 10, 10**5)}" for _ in range(60)]
    texts += [f"{prose(rng, 4, 10**5)} {texts[k][5:5 + n]} {prose(rng, 4, 10**5)}" for k, n in enumerate((55, 59, 60, 61, 75, 80, 100, 119, 120, 150))]
    texts += texts[20:22] + [line, line * 4, "z" * 65, "z" * 130, None, ""]
    got = suffixes.remove_recurring(frame(spark, texts), length=length, passage=passage, shard_bytes=shard).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_removed(texts, length)
    assert [r["repeats"] for r in got] == [n > 0 for _, n, _, _ in brute_removed(texts, passage)]


def test_op2_tells_a_passage_of_over_fifty_words_and_removes_only_400_bytes(spark, tmp_path):
    rng = random.Random(54)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared = words(54)
    texts = [f"{words(60)} {shared} {words(2)}", f"{words(90)} {shared} {words(97)}", words(200), words(54)]
    assert 250 < len(shared) < 400
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_suffixes(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["repeats"]) for r in got] == [(0, True), (0, True), (0, False), (0, False)]


def test_repeated_rows_recur_and_null_ids_stay(spark):
    text = prose(random.Random(1), 300)
    docs = frame(spark, [text, text, "short", None], ids=[None, None, 3, 4])
    got = suffixes.remove_recurring(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == sorted([(len(text), len(text))] * 2 + [(5, 0), (0, 0)])
    assert suffixes.remove_recurring(docs.limit(0)).count() == 0


def test_addresses_with_very_long_groups_are_none(spark):
    texts = ["0" * 5000 + ".1.1.1 and 10.0.0.1", "9" * 5000 + ".1.1.1", "1." * 3000, "000000000255.0.0.1"]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in personal_data.find_personal_data(frame(spark, texts)).collect()}
    assert ("ip", 0, 5006) in got[0] and ("ip", 5011, 5019) in got[0] and not [x for x in got[1] if x[0] == "ip"]
    assert len([x for x in got[2] if x[0] == "ip"]) == 750 and got[3] == [("ip", 0, 18)]
