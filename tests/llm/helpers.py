"""Small fixtures and brute-force versions for the operator tests."""

import random
import re
from collections import Counter

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, texts, ids=None, langs=None):
    rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def word_list(text):
    """Words as the shingle operators see them."""
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
            for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7F])+", text or "")]


def shingle_counts(words, size=5):
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def weighted_jaccard(a, b, weight):
    total = sum(weight(s) * max(a[s], b[s]) for s in set(a) | set(b))
    return sum(weight(s) * min(a[s], b[s]) for s in set(a) & set(b)) / total if total else 0.0


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
