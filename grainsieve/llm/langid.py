"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters; longer runs are cut into consecutive words of 40 letters. A word's features are its affixes, its letter n-grams and, if it is in the learned lexicon, the word itself; the
transitions between labels are learned from sequences that switch between languages. Forward-backward gives each word
a distribution over languages; a text's language is the one with the largest mean share, and that share its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .bpe import runs
from .textcore import fields_of, held, map_batches, pieces, quoted

WORDS_KEPT = 300_000
CHUNK = 64
_WORD = re.compile(r"[^\W\d_]{1,40}")  # of a script without spaces, a whole clause is one run: its pieces are the words


def features(word: str) -> list[str]:
    w = f"^{word}$"
    out = [f"<{w[:k]}" for k in (2, 3, 4)] + [f">{w[-k:]}" for k in (2, 3, 4, 5)]
    out += [w[k : k + 3] for k in range(len(w) - 2)] + [w[k : k + 1] for k in range(1, len(w) - 1)]
    out.append(f"={word}")
    return out


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]  # feature -> row of weights
    weights: np.ndarray
    transitions: np.ndarray  # log scale, from row to column
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words on their own, one row each."""
        get = self.index.get
        rows = [[i for f in features(w) if (i := get(f)) is not None] for w in words]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
        out = np.zeros((len(words), len(self.langs)))
        full = size > 0
        if full.any():
            out[full] = np.add.reduceat(self.weights[flat], (np.cumsum(size) - size)[full])
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position's distribution over labels, for sequences laid end to end, and how often each move between labels is expected.

    Sequences are cut into chunks that go side by side; each chunk's transfer matrix carries the state from one chunk
    to the next, so long sequences take no longer than short ones, and the result is that of the plain recursion.
    """
    k, total = scores.shape[1], len(scores)
    if not total:
        return np.zeros((0, k)), np.zeros((k, k))
    pieces = -(-lengths // CHUNK)
    first = np.cumsum(pieces) - pieces  # each sequence's first chunk
    n = int(pieces.sum())
    seq = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(n) - first[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + nth * CHUNK
    size = np.minimum(CHUNK, lengths[seq] - nth * CHUNK)
    at = np.minimum(begin[:, None] + np.arange(CHUNK), total - 1)
    live = np.arange(CHUNK) < size[:, None]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))[at]
    a = np.exp(transitions - transitions.max())
    opening = np.exp(starts - starts.max())

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)

    # Transfer matrices; a chunk that begins a sequence begins with the start scores instead of a transition.
    transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(CHUNK):
        on = live[:, t]
        if not on.any():
            break
        step = transfer[on] @ a * e[on, t][:, None, :]
        transfer[on] = scaled(step, (1, 2))
    begins = np.zeros((n, k))  # forward state before a chunk's first transition
    ends = np.ones((n, k))  # backward state after a chunk's last symbol
    head = nth == 0
    alpha = np.ones((n, CHUNK, k))
    # Chunks of a rank are worked on together, sequence by sequence in step.
    by_rank = [np.flatnonzero(nth == r) for r in range(int(pieces.max()))] if n < 4096 else np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    for r, c in enumerate(by_rank):
        if r:
            before = begins[c - 1]
            begins[c] = scaled(np.einsum("nk,nkj->nj", before, transfer[c - 1]) if r > 1 else _head_state(c - 1, e, live, opening, a, size, k), 1)
    for r in range(len(by_rank) - 1, 0, -1):
        c = by_rank[r]
        ends[c - 1] = scaled(np.einsum("nkj,nj->nk", transfer[c], ends[c]), 1)
    state = np.where(head[:, None], opening, begins @ a)
    for t in range(CHUNK):
        state = scaled(state * e[:, t], 1)
        alpha[:, t] = state
        state = state @ a
    out, moves = np.empty((total, k)), np.zeros((k, k))
    state = ends.copy()
    for t in range(CHUNK - 1, -1, -1):
        on = live[:, t]
        here = alpha[on, t] * state[on]
        out[begin[on] + t] = here / np.maximum(here.sum(axis=1, keepdims=True), 1e-300)
        onward = e[on, t] * state[on]
        came = alpha[on, t - 1] if t else begins[on] * ~head[on, None]
        # P(label before, label here) is forward score x move x emission x backward score, over their sum.
        total_ = np.einsum("ni,ij,nj->n", came, a, onward)
        moves += a * np.einsum("ni,nj->ij", came / np.maximum(total_, 1e-300)[:, None], onward)
        state[on] = scaled(onward @ a.T, 1)
    return out, moves


def _head_state(c: np.ndarray, e: np.ndarray, live: np.ndarray, opening: np.ndarray, a: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Forward states at the ends of chunks that begin sequences; only full chunks have a successor."""
    state = np.broadcast_to(opening, (len(c), k)) * e[c, 0]
    for t in range(1, CHUNK):
        state = state @ a * e[c, t]
        state = state / np.maximum(state.max(axis=1, keepdims=True), 1e-300)
    return state


def fit(rows: list[tuple[str, str]], words_per_lang: int = 30_000, rounds: int = 25, rate: float = 0.5, decay: float = 1e-6) -> Model | None:
    """Maximum likelihood by Adagrad, on (language, text) rows; None without rows.

    Texts are cut into segments of 8 to 40 words, and sequences are made of segments of one or of several languages,
    so that switching is learned as well as staying.
    """
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    rng = np.random.default_rng(7)
    segments: dict[str, list[list[str]]] = {lang: [] for lang in langs}
    for lang in langs:
        left = words_per_lang
        for text in (t for x, t in rows if x == lang):
            words = _WORD.findall(text.lower())
            at = 0
            while at < len(words) and left > 0:
                size = int(rng.integers(8, 41))
                segments[lang].append(words[at : at + size])
                left -= size
                at += size
    pool = [(k, s) for k, lang in enumerate(langs) for s in segments[lang]]
    if not pool:
        return None
    order = rng.permutation(len(pool))
    sequences, at = [], 0
    while at < len(order):  # every second sequence stays in one language
        n = int(rng.integers(2, 5))
        sequences.append([pool[i] for i in order[at : at + n]])
        at += n
    pure = sorted(pool, key=lambda x: x[0])
    sequences += [[x] for x in pure]
    words = [w for seq in sequences for _, s in seq for w in s]
    labels = np.array([k for seq in sequences for k, s in seq for _ in s])
    lengths = np.array([sum(len(s) for _, s in seq) for seq in sequences])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([vocabulary[w] for w in words])
    seen: dict[str, int] = {}
    for w in vocabulary:
        for f in features(w):
            seen[f] = seen.get(f, 0) + 1
    common = np.bincount(ids)
    index: dict[str, int] = {}
    for f, n in seen.items():  # a feature of one word says no more than the word; words enter the lexicon from three uses on
        if n > 1 if f[0] != "=" else common[vocabulary[f[1:]]] > 2:
            index[f] = len(index)
    k = len(langs)
    model = Model(langs, index, np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k))
    per_word = [[index[f] for f in features(w) if f in index] for w in vocabulary]
    size = np.array([len(x) for x in per_word])
    flat = np.array([i for x in per_word for i in x], np.int64)
    owner = np.repeat(np.arange(len(vocabulary)), size)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(words), bool)
    inside[first] = False
    onward = np.flatnonzero(inside)
    true_moves = np.bincount(labels[onward - 1] * k + labels[onward], minlength=k * k).reshape(k, k)
    gw, gt, gs = (np.full_like(x, 1e-8) for x in (model.weights, model.transitions, model.starts))
    gold = np.zeros((len(vocabulary), k))
    np.add.at(gold, (ids, labels), 1.0)
    for _ in range(rounds):
        e = np.zeros((len(vocabulary), k))
        for c in range(k):
            e[:, c] = np.bincount(owner, model.weights[flat, c], len(vocabulary))
        p, expected_moves = forward_backward(e[ids], lengths, model.starts, model.transitions)
        expected = np.stack([np.bincount(ids, p[:, c], len(vocabulary)) for c in range(k)], 1)
        diff = (gold - expected) / len(words)
        dw = np.stack([np.bincount(flat, diff[owner, c], len(index)) for c in range(k)], 1) - decay * model.weights
        dt = (true_moves - expected_moves) / len(words)
        ds = (np.bincount(labels[first], minlength=k) - p[first].sum(axis=0)) / len(words)
        for x, g, d in ((model.weights, gw, dw), (model.transitions, gt, dt), (model.starts, gs, ds)):
            g += d * d
            x += rate * d / np.sqrt(g)
    return model


def sample_rows(docs: DataFrame, per_lang: int = 150, longest: int = 20_000) -> list[tuple[str, str]]:
    """At most per_lang labelled texts of each language, of at most `longest` characters: a documented bound on what is learned from.

    A language that only has longer texts is learned from their first `longest` characters. Every language counts, over all rows; rows are taken by a hash of doc_id that has nothing to do with the language.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").withColumn("fits", F.length("text") <= longest)
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    counted = {(r[0], r[1]): r[2] for r in rows.groupBy("lang", "fits").count().collect()}
    counts = {lang: (fits, n) for (lang, fits), n in counted.items() if fits or (lang, True) not in counted}
    if not counts:
        return []
    wanted = [(lang, fits, int(min(1.0, 1.1 * per_lang / n) * (1 << 30))) for lang, (fits, n) in counts.items()]
    cuts = docs.sparkSession.createDataFrame(wanted, "lang string, fits boolean, below long")
    taken = rows.join(F.broadcast(cuts), ["lang", "fits"]).where(share < F.col("below")).select("lang", F.substring("text", 1, longest).alias("text"), share.alias("h")).collect()
    out, had = [], dict.fromkeys(counts, 0)
    for r in sorted(taken, key=lambda r: (r["lang"], r["h"])):
        if had[r["lang"]] < per_lang:
            had[r["lang"]] += 1
            out.append((r["lang"], r["text"]))
    return out


class Labeller:
    """A model with a memory of words."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))
        self.letters = np.zeros(0, bool)

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, list[str]]]:
        """For each text, its words' distributions, and the words; words without a letter are left out."""
        found = [_WORD.findall(t.lower()) for t in texts]
        new = list({w for ws in found for w in ws}.difference(self.number))
        if len(self.number) + len(new) > WORDS_KEPT:
            self.number.clear()
            new = list({w for ws in found for w in ws})
            self.scores, self.letters = self.scores[:0], self.letters[:0]
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.emissions(new)))
            self.letters = np.concatenate((self.letters, np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))))
        get = self.number.__getitem__
        ids = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in found]
        keep = [self.letters[i] for i in ids]
        ids = [i if k.all() else i[k] for i, k in zip(ids, keep, strict=True)]
        lengths = np.array([len(i) for i in ids])
        full = lengths > 0
        p, _ = forward_backward(self.scores[np.concatenate(ids)] if full.any() else np.zeros((0, len(self.model.langs))), lengths[full], self.model.starts, self.model.transitions)
        end = np.cumsum(lengths)
        return [(p[z - n : z], ws if k.all() else [w for w, ok in zip(ws, k.tolist(), strict=True) if ok]) for z, n, ws, k in zip(end.tolist(), lengths.tolist(), found, keep, strict=True)]


UNKNOWN = "und"


def identify(docs: DataFrame, model: Model | None, spans: bool = False, called: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """docs with lang_pred, score and, with spans, lang_spans: runs of words of one language as (lang, first, last), last exclusive. `called` gives other names for these.

    Null texts and texts without a letter are `und` with score 0, and so is everything without a model. Only the text
    is looked at. Columns named as the new ones are replaced; rows may repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that it was learned from
    new = list(called[: 3 if spans else 2])
    own = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in new}]
    kind = "array<struct<lang:string,first:int,last:int>>"
    fields = [*fields_of(own), *zip(new, ("string", "double", kind), strict=False)]
    names = [f.name for f in own]

    def label(batches):
        m = shared.value
        labeller = _labeller(m) if m else None
        for b in pieces(batches, "text"):
            pred, score, runs_ = [], [], []
            for run in runs(b["text"].to_pylist()):
                for p, _ in labeller.texts(run) if m else ((np.zeros((0, 0)), []) for _ in run):
                    if not len(p):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        runs_.append([])
                        continue
                    mean = p.mean(axis=0)
                    best = int(mean.argmax())
                    pred.append(m.langs[best])
                    score.append(float(min(1.0, mean[best])))
                    if spans:
                        lab = p.argmax(axis=1)
                        edge = np.flatnonzero(np.diff(lab, prepend=-1))
                        runs_.append([{"lang": m.langs[lab[x]], "first": int(x), "last": int(y)} for x, y in zip(edge, np.append(edge[1:], len(lab)), strict=True)])
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                made.append(pa.array(runs_, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *made], [*names, *new])

    return map_batches(docs.select(*map(quoted, names)), label, fields)


def _labeller(model: Model) -> Labeller:
    return held(("labeller", crc32(model.weights.tobytes())), lambda: Labeller(model))


def held_out(doc_id):
    """The documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, per_lang: int = 150) -> Model | None:
    """A model from the labelled texts of docs."""
    return fit(sample_rows(docs, per_lang))
