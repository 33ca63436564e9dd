"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(severity > k) = sigmoid(w.x - b_k) with one weight vector for all ordered thresholds b_0 < b_1 < ...; the expected
severity is the sum of these over k. x says which words of the vocabulary a text has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .textcore import pieces

_WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 600_000
GRADES = 3  # severities 0 (none) to 3


def features(word: str) -> list[str]:
    """A word and its stems, so that inflected forms share weights."""
    return [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Severity:
    weights: dict[str, float]
    thresholds: list[float]
    cut: float  # the score w.x from which a text is toxic
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def found(self, text: str) -> tuple[set[str], set[str]]:
        """The text's features that have a weight, and its words that have such a feature."""
        get, had, words = self.memory.get, set(), set()
        if len(self.memory) > WORDS_KEPT:
            self.memory.clear()
        for w in set(_WORD.findall(text.lower())):
            fs = get(w)
            if fs is None:
                fs = self.memory[w] = tuple(f for f in features(w) if f in self.weights)
            if fs:
                had.update(fs)
                words.add(w)
        return had, words

    def score(self, had: set[str]) -> float:
        return sum(self.weights[f] for f in sorted(had))

    def above(self, had: set[str]) -> np.ndarray:
        """P(severity > k) for each threshold k."""
        return 1 / (1 + np.exp(-(self.score(had) - np.array(self.thresholds))))

    def grade(self, had: set[str]) -> int:
        """The expected severity rounded; 1 at least for a toxic text, and 0 for others."""
        return max(1, int(self.above(had).sum() + 0.5)) if self.score(had) >= self.cut else 0


def _apart(texts: list[list[str]]) -> list[int]:
    """One row of each group of near copies: two of four smallest hashes of word triples in common with an earlier row make a copy."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, ws in enumerate(texts):
        grams = [crc32(" ".join(ws[i : i + 3]).encode()) for i in range(max(1, len(ws) - 2))]
        keys = [(n, min((g * m) % 4294967291 for g in grams)) for n, m in enumerate((1, 2654435761, 40503, 2246822519))]
        if sum(x in seen for x in keys) < 2:
            out.append(k)
        seen.update(keys)
    return out


def _vocabulary(sets: list[set[str]], toxic: np.ndarray, least: float) -> list[str]:
    """Features far more frequent in toxic texts than in others, by a likelihood ratio that no chance word reaches."""
    n1 = int(toxic.sum())
    n0 = len(sets) - n1
    count: dict[str, list[int]] = {}
    for s, t in zip(sets, toxic.tolist(), strict=True):
        for f in {f for w in s for f in features(w)}:
            count.setdefault(f, [0, 0])[int(t)] += 1
    q, out = n1 / (n0 + n1), []
    for f, (c0, c1) in count.items():
        p = c1 / (c0 + c1)
        if p > q and (c1 + 0.5) * n0 > 20 * (c0 + 0.5) * n1:
            ratio = 2 * (c1 * np.log(p / q) + (c0 * np.log((1 - p) / (1 - q)) if c0 else 0.0))
            if ratio > least:
                out.append(f)
    return sorted(out)


def _endings(words: list[str]) -> set[str]:
    return {w[-4:] for w in words}


def grades(lists: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """Severity grades from labels that only say toxic or not: 0 for clean texts, 1 to 3 for toxic ones.

    A toxic text's grade is the third that it falls into by how much its words' endings speak for toxicity in all,
    judged by a naive Bayes model of the endings in the other half of the texts. So the grades come from features that
    the regression does not use, and no text has a say in its own.
    """
    score, half = np.zeros(len(lists)), np.arange(len(lists)) % 2
    found = [_endings(ws) for ws in lists]
    for fold in (0, 1):
        count: dict[str, list[int]] = {}
        for k in np.flatnonzero(half != fold).tolist():
            for e in found[k]:
                count.setdefault(e, [0, 0])[int(toxic[k])] += 1
        n1 = max(int(toxic[half != fold].sum()), 1)
        n0 = max(int((~toxic[half != fold]).sum()), 1)
        odds = {e: float(np.log((c1 + 1) / (n1 + 2) * (n0 + 2) / (c0 + 1))) for e, (c0, c1) in count.items() if c0 + c1 > 1}
        for k in np.flatnonzero(half == fold).tolist():
            score[k] = sum(x for e in found[k] if (x := odds.get(e, 0.0)) > 1)
    cuts = np.quantile(score[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (score > cuts[0]) + (score > cuts[1]), 0)


def cut_of(scores: np.ndarray, toxic: np.ndarray, cost: float = 5.0) -> float:
    """The score from which texts count as toxic: above 0, and such that the share of toxic texts found, less `cost` times that of clean ones, is largest."""
    levels = np.unique(scores[scores > 0])
    if not len(levels):
        return float("inf")
    gain = [(scores[toxic] >= c).mean() - cost * (scores[~toxic] >= c).mean() for c in levels]
    best = int(np.argmax(gain))
    return float(levels[best] + (levels[best - 1] if best else 0.0)) / 2


def fit(rows: list[tuple[str, int]], least: float = 30.0, rounds: int = 400, rate: float = 0.3, decay: float = 2e-4) -> Severity | None:
    """From (text, toxic 0/1) rows; None if they are not of both kinds.

    Labels say toxic or not; grades() makes grades of them. Of near copies one counts. Thresholds stay in order because
    each is the one before plus a positive step.
    """
    toxic = np.array([int(t) for _, t in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    lists = [_WORD.findall((t or "").lower()) for t, _ in rows]
    apart = _apart(lists)
    sets, toxic = [set(lists[k]) for k in apart], toxic[apart]
    vocabulary = _vocabulary(sets, toxic, least)
    number = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(sets), len(vocabulary)))
    for r, s in enumerate(sets):
        for f in {f for w in s for f in features(w)} & number.keys():
            x[r, number[f]] = 1
    grade = grades([lists[k] for k in apart], toxic)
    w, first, steps = np.zeros(len(vocabulary)), 0.0, np.zeros(GRADES - 1)
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean())[:, None] / len(sets)
    memory = [np.full(len(vocabulary), 1e-8), 1e-8, np.full(GRADES - 1, 1e-8)]
    for _ in range(rounds):
        b = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - b)))
        # Log likelihood of cumulative links: log(P(>k-1) - P(>k)) for the grade k.
        left = np.concatenate((np.ones((len(p), 1)), p), axis=1)
        right = np.concatenate((p, np.zeros((len(p), 1))), axis=1)
        share = np.maximum((left - right)[np.arange(len(p)), grade], 1e-12)[:, None]
        slope = p * (1 - p)
        d_left = np.where(np.arange(GRADES) == grade[:, None] - 1, slope / share, 0)
        d_right = np.where(np.arange(GRADES) == grade[:, None], slope / share, 0)
        d = (d_left - d_right) * balance  # by w.x - b_k
        gw = x.T @ d.sum(axis=1) - decay * w
        gb = -d.sum(axis=0)
        gsteps = np.array([gb[k + 1 :].sum() for k in range(GRADES - 1)]) * np.exp(steps)
        for k, g in enumerate((gw, gb.sum(), gsteps)):
            memory[k] = memory[k] + g * g
        w = np.maximum(w + rate * gw / np.sqrt(memory[0]), 0)
        first += rate * gb.sum() / np.sqrt(memory[1])
        steps = np.clip(steps + rate * gsteps / np.sqrt(memory[2]), -5, 5)
    b = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
    return Severity(dict(zip(vocabulary, w.tolist(), strict=True)), b.tolist(), cut_of(x @ w, toxic))


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: int = 4000, longest: int = 50_000) -> list[tuple[str, int]]:
    """About per_class labelled texts of each class at most, by a hash of doc_id, and of a text its first `longest` characters: documented bounds on what is learned from."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    cut = F.lit(False)
    for t, c in n.items():
        cut = cut | ((F.col("toxic") == t) & (share < int(min(1.0, per_class / c) * (1 << 30))))
    some = [(r[0], r[1]) for r in known.where(cut).collect()]
    if not some:
        return []
    wanted = docs.sparkSession.createDataFrame(some, "doc_id long, toxic int")
    rows = docs.where("text is not null").join(F.broadcast(wanted), "doc_id").select("doc_id", F.substring("text", 1, longest).alias("text"), "toxic")  # wanted is bounded by per_class
    return [(r[1], r[2]) for r in sorted(rows.collect())]


def severity(docs: DataFrame, model: Severity | None) -> DataFrame:
    """(doc_id, text) -> doc_id, severity (0 to 3), expected_severity, toxic, and toxic_words found.

    severity is the expected one rounded, from 1 on for toxic texts and 0 for others; texts without a toxic word are not toxic. Null and empty texts have no words; without a model all is 0. Whole texts are
    read. Other columns are dropped; rows may repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def grade(batches):
        m = shared.value
        none = m.above(set()) if m else np.zeros(GRADES)
        for b in pieces(batches, "text"):
            out = [[], [], [], []]
            for t in b["text"].to_pylist():
                had, words = m.found(t) if t and m else (set(), set())
                p = m.above(had) if had else none
                grade_ = m.grade(had) if had else 0
                for o, v in zip(out, (grade_, float(p.sum()), grade_ > 0, sorted(words)), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.list_(pa.string()))], ["doc_id", "severity", "expected_severity", "toxic", "toxic_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(grade, "doc_id long, severity int, expected_severity double, toxic boolean, toxic_words array<string>")
