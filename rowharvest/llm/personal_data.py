"""Operator 10, personal data: labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Forms beyond the base patterns.
HIDDEN_AT = re.compile(r" ?(?:\((?:at|AT)\)|\[(?:at|AT)\]) ?")
HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]) ?)[A-Za-z0-9-]+)+")
LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-]|[ ][0-9])")

# Gazetteers (fixed values).
TOP_DOMAINS = set("com org net edu gov io info biz de fr es it uk us eu ch at nl be pl se no fi dk pt ru cn jp in br au ca mx".split())
CARD_STARTS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54",
                 "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
CUES = {"email": re.compile(r"\b(?:e-?mail|mail|contact|write to|kontakt|correo|courriel)\b", re.I),
        "ip": re.compile(r"\b(?:ip|host|server|address|adresse|dirección|login|client)\b", re.I),
        "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|pay)\b", re.I),
        "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", re.I)}
OTHER_CUE = re.compile(r"\b(?:version|release|order|invoice|isbn|issn|part|serial|model|chapter|section|token|hash|sha|id)\W*$", re.I)

LABELERS = ("pattern", "shape", "gazetteer", "context", "check")
YES, NO, ABSTAIN = "1", "0", "-"
#: An added span needs this probability, and two labelers for it.
SURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind and start: leftmost matches that do not overlap; those that fail their test are dropped.

    All scans are linear in the text, also over very long runs of digits or letters.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    for run in DOTTED.finditer(text):
        groups = run.group().split(".")
        place = run.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i:i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(g) <= 3 and int(g or 0) <= 255 for g in (x.lstrip("0") for x in four)):
                found.append(("ip", place, end))
            place = end + 1
    for run in DIGITS.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", run.start(), run.end()))
    for run in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in run.group()) <= 15:
            found.append(("phone", run.start(), run.end()))
    return found


def other_spans(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, form, start, end) of candidates that the base patterns do not have."""
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        for mark in HIDDEN_AT.finditer(text):
            start = mark.start()
            while start > 0 and text[start - 1] in LOCAL_PART:
                start -= 1
            domain = HIDDEN_DOMAIN.match(text, mark.end())
            if domain and start < mark.start():
                yield "email", "hidden", start, domain.end()
    if text.count(":") >= 7:
        for run in LONG_IP.finditer(text):
            yield "ip", "long", run.start(), run.end()
    for run in DIGITS.finditer(text):  # several numbers beside each other that the base pattern reads as one
        if " " in run.group() and sum(c.isdigit() for c in run.group()) > 19:
            place = run.start()
            for group in run.group().split(" "):
                digits = group.replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield "card", "beside", place, place + len(group)
                place += len(group) + 1
    for run in LOCAL_PHONE.finditer(text):
        yield "phone", "local", run.start(), run.end()


def votes(text: str, kind: str, form: str, start: int, end: int) -> str:
    """One mark of each labeler: yes, no or abstain."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    pattern = YES if form == "base" else ABSTAIN
    edge = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower()
        shape = YES if span[0].isalnum() and ".." not in span else NO
        gazetteer, check = YES if last in TOP_DOMAINS else ABSTAIN, YES if 2 <= len(last) <= 24 and last.isalpha() else NO
    elif kind == "ip":
        parts = span.split(":" if form == "long" else ".")
        shape = NO if edge else YES
        gazetteer = NO if form != "long" and parts[0] in ("0", "255") else ABSTAIN
        check = YES if form == "long" or all(p == (p.lstrip("0") or "0") for p in parts) else NO
    elif kind == "card":
        shape = NO if edge else YES
        gazetteer, check = YES if digits.startswith(CARD_STARTS) else ABSTAIN, YES if luhn(digits) else NO
    else:
        shape = YES if re.search(r"[ ().-]", span) and not edge else ABSTAIN
        gazetteer = (YES if digits.startswith(CALLING_CODES) else NO) if form == "base" else ABSTAIN
        check = YES if 10 <= len(digits) <= 13 and len(set(digits)) > 2 else NO
    before = text[max(0, start - 40):start]
    context = NO if OTHER_CUE.search(before) else YES if CUES[kind].search(before) else ABSTAIN
    return pattern + shape + gazetteer + context + check


def candidates(text: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, form, start, end, votes) of all candidate spans: base ones first."""
    for kind, start, end in base_spans(text):
        yield kind, "base", start, end, votes(text, kind, "base", start, end)
    for kind, form, start, end in other_spans(text):
        yield kind, form, start, end, votes(text, kind, form, start, end)


def reliabilities(patterns: dict[tuple[str, str, str], int], rounds: int = 100) -> dict[tuple[str, str, str], float]:
    """Probability that a span is personal, for each (kind, form, votes), by expectation-maximisation.

    Every kind has a share of personal spans, every labeler of a kind a probability of each mark for
    personal and for other spans; the first guess is the majority of the votes.
    """
    out = {}
    for kind in KINDS:
        own = [(k, n) for k, n in sorted(patterns.items()) if k[0] == kind]
        if not own:
            continue
        marks = np.array([["10-".index(c) for c in k[2]] for k, _ in own])
        n = np.array([n for _, n in own], float)
        believed = (1 + (marks == 0).sum(axis=1)) / (2 + (marks != 2).sum(axis=1))
        for _ in range(rounds):
            share = (n @ believed + 1) / (n.sum() + 2)
            logs = np.stack([np.full(len(own), np.log(share)), np.full(len(own), np.log(1 - share))], axis=1)
            for j in range(len(LABELERS)):
                for side, weight in enumerate((n * believed, n * (1 - believed))):
                    seen = np.bincount(marks[:, j], weights=weight, minlength=3)
                    prior = np.array([2.0, 1.0, 1.0]) if side == 0 else np.array([1.0, 2.0, 1.0])  # labelers are better than chance
                    logs[:, side] += np.log((seen + prior) / (seen + prior).sum())[marks[:, j]]
            believed = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))
        out |= {k: float(b) for (k, _), b in zip(own, believed)}
    return out


@dataclass
class SpanClassifier:
    """Logistic regression on kind, form and votes."""

    places: dict[str, int]
    weights: np.ndarray

    @staticmethod
    def features(kind: str, form: str, marks: str) -> list[str]:
        return [kind, f"{kind}/{form}", *[f"{kind}/{name}={mark}" for name, mark in zip(LABELERS, marks)]]

    @classmethod
    def fit(cls, believed: dict[tuple[str, str, str], float], counts: dict[tuple[str, str, str], int], steps: int = 300) -> SpanClassifier:
        keys = sorted(believed)
        places = {f: i for i, f in enumerate(sorted({f for k in keys for f in cls.features(*k)}))}
        x = np.zeros((len(keys), len(places)))
        for i, k in enumerate(keys):
            x[i, [places[f] for f in cls.features(*k)]] = 1
        y, n = np.array([believed[k] for k in keys]), np.sqrt(np.array([counts[k] for k in keys], float))
        weights = np.zeros(len(places))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ weights))
            weights -= (x.T @ (n * (p - y)) + 0.01 * weights) / max(1.0, n.sum()) * 4
        return cls(places, weights)

    def __call__(self, kind: str, form: str, marks: str) -> float:
        total = sum(self.weights[self.places[f]] for f in self.features(kind, form, marks) if f in self.places)
        return float(1 / (1 + np.exp(-total)))


def learn(docs: DataFrame, *, text_col: str = "text") -> SpanClassifier:
    """Votes of all candidate spans of all documents, counted by pattern; the driver gets the counts of at most
    kinds x forms x 3**labelers patterns."""
    def count(batches):
        for batch in batches:
            seen = Counter("|".join((kind, form, marks)) for text in batch.column("text").to_pylist() if text
                           for kind, form, _, _, marks in candidates(text))
            yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())},
                                             schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(
        F.sum("n").alias("n")).collect()
    counts = {tuple(r["pattern"].split("|")): r["n"] for r in rows}
    return SpanClassifier.fit(reliabilities(counts), counts)


def personal_spans(text: str, classifier: SpanClassifier) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and kind. Added spans overlap nothing that is there already."""
    order = lambda s: (s[1], KINDS.index(s[0]))
    base, taken = [], []
    for kind, form, start, end, marks in candidates(text):
        if form == "base":
            base.append((kind, start, end))
        elif (marks.count(YES) >= 2 and classifier(kind, form, marks) >= SURE
              and not any(a < end and start < b for _, a, b in base) and not any(a < end and start < b for _, a, b in taken)):
            taken.append((kind, start, end))
    return sorted(base, key=order), sorted(base + taken, key=order)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): personal data in each text, as lists of (kind, start, end) in code points, end exclusive.

    base has the spans of the fixed patterns; spans also those of further forms (written-out addresses, long IP
    addresses, card numbers beside others, phone numbers without a country code) that the classifier accepts.
    A null text is empty; repeated rows are each answered; other columns are ignored; an empty table gives
    an empty result. Two passes over the texts, no shuffle of texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col=text_col))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [personal_spans(t or "", shared.value) for t in batch.column("text").to_pylist()]
            lists = [[[{"kind": k, "start": a, "end": b} for k, a, b in f[side]] for f in found] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists[0], span), pa.array(lists[1], span)],
                                             names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, base {kind}, spans {kind}")
