"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are numbered and fed into one automaton. Training texts stream through it; after each word the
automaton holds the length of the longest run of item words that ends there. Words that cannot belong to a window of
an item are passed over first (numpy): all pairs of neighbours in a window are pairs of neighbours in an item.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from . import textcore as tc
from .textcore import fields_of, map_batches, quoted, unused

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

#: Most words of items in one automaton; more items go into further ones, one pass over the texts for each.
AUTOMATON_WORDS = 200_000


class SuffixAutomaton:
    """Of several sequences: a state for each set of runs that end at the same places."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for p's longest run with c after it."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def matches(self, sequence: list[int]):
        """After each symbol, how many of the last ones are a run of some sequence."""
        state = n = 0
        nexts, link, length = self.next, self.link, self.length
        for c in sequence:
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            if (to := nexts[state].get(c)) is not None:
                state, n = to, n + 1
            else:
                n = 0
            yield n


class Index:
    """Items as an automaton, with what tells which item a window is of."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        buf, off = tc.column_bytes(pa.array([t for _, t in items], pa.string()))
        buf = tc.LOWER[buf]
        starts, ends, at = tc.words(buf, off, WORD)
        h = tc.word_hashes(buf, starts, ends)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 1
        self.automaton, self.of = SuffixAutomaton(), {}
        self.names = [i for i, _ in items]
        near: list[np.ndarray] = []
        self.shorter: set[int] = set()
        for k in range(len(items)):
            seq = ids[at[k] : at[k + 1]]
            if not len(seq):
                continue
            s = seq.tolist()
            self.automaton.add(s)
            n = min(window, len(s))
            if n < window:
                self.shorter.add(n)
            for x in range(len(s) - n + 1):
                self.of.setdefault(tuple(s[x : x + n]), set()).add(k)
            near.append((seq[:-1] << 32) | seq[1:])
        self.near = np.unique(np.concatenate([np.zeros(0, np.int64), *near]))
        self.lengths = sorted({n for n in map(len, self.of)}, reverse=True)

    def runs(self, ids: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that may hold a window: known words, each neighbouring pair known, and none over the end of a text."""
        least = self.lengths[-1] if self.lengths else 0
        if not least:
            return []
        known = ids > 0
        if least == 1:
            joined = np.zeros(max(len(ids) - 1, 0), bool)
        key = (ids[:-1] << 32) | ids[1:]
        at = np.searchsorted(self.near, key)
        joined = known[:-1] & known[1:] & (self.near[np.minimum(at, len(self.near) - 1)] == key) if len(self.near) else np.zeros(max(len(ids) - 1, 0), bool)
        inner = cut[(cut > 0) & (cut < len(ids))]
        joined[inner - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        out = [(int(a), int(z) + 1) for a, z in zip(edge[::2], edge[1::2], strict=True) if z + 1 - a >= least]
        if least == 1:  # lone words too
            lone = known.copy()
            lone[:-1] &= ~joined
            lone[1:] &= ~joined
            out += [(int(a), int(a) + 1) for a in np.flatnonzero(lone)]
        return out


def _find(index: Index, texts: pa.Array):
    """For each text: word count, hit words (from, to, first byte, last byte) as merged runs, and the items found."""
    buf, off = tc.column_bytes(texts)
    for i, j in tc.slices(off):
        b, o = tc.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, at = tc.words(b, o, WORD)
        h = tc.word_hashes(b, starts, ends)
        pos = np.searchsorted(index.vocabulary, h)
        ids = np.where(index.vocabulary[np.minimum(pos, len(index.vocabulary) - 1)] == h, pos + 1, 0) if len(index.vocabulary) else np.zeros(len(h), np.int64)
        found: dict[int, tuple[np.ndarray, set[int]]] = {}
        for a, z in index.runs(ids, at):
            seq = ids[a:z].tolist()
            for t, n in enumerate(index.automaton.matches(seq)):
                for w in index.lengths:
                    if w <= n and (items := index.of.get(tuple(seq[t - w + 1 : t + 1]))):
                        doc = int(np.searchsorted(at, a, "right")) - 1
                        if doc not in found:
                            found[doc] = (np.zeros(at[doc + 1] - at[doc], bool), set())
                        found[doc][0][a + t - w + 1 - at[doc] : a + t + 1 - at[doc]] = True
                        found[doc][1].update(items)
        for doc in range(j - i):
            hit, items = found.get(doc, (None, set()))
            spans = []
            if hit is not None:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                first, base = at[doc], o[doc]
                spans = [(int(x), int(y), int(starts[first + x] - base), int(ends[first + y - 1] - base)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            yield int(at[doc + 1] - at[doc]), spans, items


SPANS = "array<struct<first:long,last:long,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")]))


def _merged(spans: list[dict]) -> list[dict]:
    """Runs of hit words from several automata as one list."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], "stop": s["stop"]}
        else:
            out.append(dict(s))
    return out


def _marked(batches, index, rest: list[str], called: tuple[str, str, str]):
    """The batches with what one automaton finds added to n_words, spans and items."""
    tc.forget()  # texts and hits need the room of what the worker keeps for another operator
    known = pickle.loads(index.value)
    for b in tc.pieces(batches, "text"):
        n, spans, names = [], b[called[1]].to_pylist(), b[called[2]].to_pylist()
        for r, (size, hit, got) in enumerate(_find(known, b["text"])):
            n.append(size)
            spans[r] = _merged([*spans[r], *({"first": f, "last": t, "start": s, "stop": e} for f, t, s, e in hit)])
            names[r] = sorted({*names[r], *(known.names[i] for i in got)})
        yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], [*rest, *called])


def _looked_up(docs: DataFrame, items: DataFrame, window: int, automaton_words: int, called: tuple[str, str, str], last: Callable | None = None, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with n_words, spans and items; or what `last`, with columns of its own, makes of such batches in the tasks of the last pass."""
    spark = docs.sparkSession
    ship(spark)
    own = [f for f in docs.schema.fields if f.name.lower() not in {c.lower() for c in called}]
    rest = [f.name for f in own]
    marked = [*fields_of(own), *zip(called, ("long", SPANS, "array<string>"), strict=True)]
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = size // (2 * automaton_words) + 1  # a word and its separator are two characters at least
    empty = (F.lit(0).cast("long"), F.expr(f"cast(array() as {SPANS})"), F.expr("cast(array() as array<string>)"))
    df = docs.select(*map(quoted, rest), *(e.alias(c) for e, c in zip(empty, called, strict=True)))
    for k in range(passes):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        index = spark.sparkContext.broadcast(pickle.dumps(Index(sorted((r[0], r[1]) for r in part.collect()), window)))
        ends = last is not None and k + 1 == passes

        def find(batches, index=index, ends=ends):
            found = _marked(batches, index, rest, called)
            return last(found) if ends else found

        df = map_batches(df, find, fields if ends else marked)
        if k + 1 < passes:
            df = materialize(df, "hits")
    return df


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, automaton_words: int = AUTOMATON_WORDS, called: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """docs with n_words, spans (hit words first..last, exclusive, and their bytes start..stop) and items found.

    A-Z count as a-z; words are runs of ASCII letters and digits and of all other characters beyond ASCII. A window is
    that many consecutive words of an item, or a whole item that is shorter. A word inside any occurrence of a window
    is hit. Null and empty texts have no words; items without words, with null ids or null texts match nothing. Items
    of the same id count as one in `items`, which holds ids as strings, sorted. Columns named as the new ones, for
    which `called` gives other names, are replaced; all other columns stay, whatever their names, and rows may repeat. Empty tables work on either side. The items of an automaton are bounded
    by automaton_words; larger benchmarks take one pass over the texts for each part.
    """
    return _looked_up(docs, items, window, automaton_words, called)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without the words of test items: hit spans are cut out; a text of which more than most_coverage is hit goes.

    The columns are those of docs, whatever their names, n_chars brought up to date if there is one. Texts without a
    hit stay as they are, null and empty ones too. Texts are cut in the Python task that has found their hits, so no second worker holds them.
    """
    own = docs.columns
    n_words, spans_, _ = called = tuple(unused(x, own) for x in ("n_words", "spans", "items"))

    def cut(found):
        for b in found:
            spans = b[spans_].to_pylist()
            kept = [n == 0 or sum(s["last"] - s["first"] for s in x) <= most_coverage * n for n, x in zip(b[n_words].to_pylist(), spans, strict=True)]
            texts, at = b["text"].filter(pa.array(kept, pa.bool_())), [x for x, k in zip(spans, kept, strict=True) if k]
            if any(at):
                whole = texts.to_pylist()
                for r, x in enumerate(at):
                    if x:
                        raw, edges = whole[r].encode(), [0, *(e for s in x for e in (s["start"], s["stop"])), None]
                        whole[r] = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)).decode()
                texts = pa.array(whole, texts.type)
            b = b.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([texts if c == "text" else b[c] for c in own], own)

    out = _looked_up(docs, items, window, automaton_words, called, cut, fields_of(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out


def report(found: DataFrame) -> DataFrame:
    """The digest of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
