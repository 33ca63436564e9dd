"""Byte-level BPE encoding and decoding: speculate and verify.

For a batch's new words, greedy longest match proposes tokens. A proposal is the BPE encoding exactly if each adjacent
pair of its tokens is compatible, that is, if the two tokens' joined bytes encode to these two again. All pairs of all
proposals are looked up together in a table of known pairs (numpy); words with a pair that fails, and only they, go
through exact merging.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .textcore import fields_of, held, map_batches, pieces

WORDS_KEPT = 400_000  # words whose encoding a worker remembers; beyond it starts anew

# Letters first: no other alternative can begin with one. Right for the characters below; see _plain.
_SPLIT = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Fixed ranges in which Python's classes agree with the tokenizer library's; texts with other characters are split by the library.
_PLAIN = "\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u0391-\\u03a1\\u03b1-\\u03c9\\u0400-\\u045f\\u05d0-\\u05ea\\u0621-\\u063a\\u2010-\\u2027\\u20ac\\u3001-\\u3003\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3\\uff01-\\uff5e"
_ODD = re.compile(f"[^{_PLAIN}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairCoder:
    """A byte-level BPE vocabulary file of the tokenizers library, with its own encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        self.path = path
        self.token: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        plain = set(spec["model"]["vocab"].values())
        self.id = {b: i for i, b in self.token.items() if i in plain}
        self.reach: dict[bytes, int] = {}
        for t in self.id:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.letter = letter
        vocab = spec["model"]["vocab"]
        self.byte = [self.id[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[(vocab[a] << 20) | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.none = len(self.merged)
        self.digits = {i: str(i) for i in self.token}
        self.pairs = np.zeros(0, np.int64)  # known pairs, sorted, and which of them are compatible
        self.fits = np.zeros(0, bool)
        self.words: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None
        self.merged_words = 0
        self.seen_words = 0

    def merge_exactly(self, word: bytes) -> tuple[int, ...]:
        """The lowest-ranked pair is merged, leftmost first, until there is none."""
        if len(word) > 256:
            return self._merge_long(word)
        ids, get, none = [self.byte[x] for x in word], self.rank.get, self.none
        ranks = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            k = ranks.index(r)
            ids[k] = new = self.merged[r]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((new << 20) | ids[k + 1], none)
            if k:
                ranks[k - 1] = get((ids[k - 1] << 20) | new, none)
        return tuple(ids)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for words of any length."""
        ids: list[int | None] = [self.byte[x] for x in word]
        n, get = len(ids), self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k] << 20) | ids[k + 1])) is not None]
        heapify(heap)
        while heap:
            r, k, a, b = heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j], after[k] = self.merged[r], None, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := get((ids[x] << 20) | ids[y])) is not None:
                    heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i in ids if i is not None)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; a token's first three bytes tell how long it can be."""
        out, at, n, get, reach = [], 0, len(word), self.id.get, self.reach.get
        while at < n:
            end = min(n, at + reach(word[at : at + 3], 2))
            while (found := get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """Which pairs (a << 32 | b) are compatible; b is one more than the id, and 0 asks for a alone. Unknown ones are worked out once."""
        ask = np.unique(keys)
        at = np.searchsorted(self.pairs, ask)
        new = ask[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != ask)] if len(self.pairs) else ask
        if len(new):
            a, b = new >> 32, (new & 0xFFFFFFFF) - 1
            fits = [self.merge_exactly(self.token[x] + (self.token[y] if y >= 0 else b"")) == ((x, y) if y >= 0 else (x,)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            both = np.concatenate((self.pairs, new))
            order = np.argsort(both, kind="stable")
            self.pairs, self.fits = both[order], np.concatenate((self.fits, np.array(fits, bool)))[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not yet known."""
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        if len(self.pairs) > 8 * WORDS_KEPT:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        todo = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in todo]
        proposals = [self.propose(w) for w in raw]
        size = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        # Each token with its right neighbour in the word; 0 where there is none, so that single tokens are verified too.
        right = np.zeros(len(flat), np.int64)
        right[:-1] = flat[1:] + 1
        right[first + size - 1] = 0
        lone = size == 1
        need = right > 0
        need[first[lone]] = True
        ok = np.ones(len(flat), bool)
        ok[need] = self._compatible((flat[need] << 32) | right[need])
        good = np.logical_and.reduceat(ok, first) if len(flat) else np.zeros(0, bool)
        self.seen_words += len(todo)
        self.merged_words += int((~good).sum())
        for k, w in enumerate(todo):
            self.words[w] = tuple(proposals[k]) if good[k] else self.merge_exactly(raw[k])

    def split(self, text: str) -> list[str]:
        """The words of a text: its special tokens, and what the byte-level pattern finds between them."""
        if self.cut and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        letter = self.letter
        return [bytes(letter[c] for c in w).decode("utf-8") for w, _ in self._library.pre_tokenize_str(text)]

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """Each text's words, all of them known afterwards."""
        out = [self.split(t) for t in texts]
        new = set(chain.from_iterable(out)).difference(self.words)
        if new:
            size = len(self.words)
            self.learn(new - self.special.keys())
            if len(self.words) < size + len(new):  # the memory began anew
                self.learn(set(chain.from_iterable(out)).difference(self.words, self.special))
            for s, i in self.special.items():
                self.words[s] = (i,)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(map(self.words.__getitem__, w))) for w in self.split_all(texts)]

    def decode(self, ids: list[int]) -> str:
        """As the library: bytes of all tokens in a row, what is not UTF-8 replaced; unknown ids are skipped."""
        return b"".join([t for i in ids if (t := self.token.get(i)) is not None]).decode("utf-8", "replace")


def coder(path: str) -> BytePairCoder:
    return held(path, lambda: BytePairCoder(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def runs(texts: list[str | None], most: int = 1 << 20):
    """Texts in runs of so many characters; null: empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _with(df: DataFrame, column: str, out: str, kind: str, make) -> DataFrame:
    """df with a column computed from another, batch by batch; a column of that name is replaced."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != out]
    fields = fields_of(f for f in df.schema.fields if f.name != out)
    arrow = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}[kind]

    def work(batches):
        for b in pieces(batches, column):
            made = pa.array(make(b[column].to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), made], [*rest, out])

    return map_batches(df, work, [*fields, (out, kind)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with out: the token ids of each whole text, without added tokens.

    Null and empty texts have no ids (an empty array). A special token's string in a text is that token. Other columns
    stay; one named as out is replaced. Rows keep their number and may repeat; an empty table gives an empty one.
    """
    path = path or default_path()
    return _with(df, text, out, "array<int>", lambda col: [np.array(ids, np.int32) for run in runs(col) for ids in coder(path).encode_all(run)])


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """df with out: the text of each array of ids, special tokens kept. Null and empty arrays give an empty text; unknown ids nothing."""
    path = path or default_path()
    return _with(df, ids, out, "string", lambda col: [coder(path).decode(x or []) for x in col])


def count(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with out: the number of ids that encode() gives."""
    path = path or default_path()

    def lengths(col):
        c = coder(path)
        return [sum(map(len, map(c.words.__getitem__, w))) for run in runs(col) for w in c.split_all(run)]

    return _with(df, text, out, "long", lengths)


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256 and decoded_sha256: encode(), then decode() of these ids, in one pass.

    Null texts count as empty. Other columns are dropped; rows keep their number and may repeat.
    """
    path = path or default_path()
    ship(df.sparkSession)

    def work(batches):
        c = coder(path)
        for b in pieces(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for run in runs(b["text"].to_pylist()):
                for w in c.split_all(run):
                    ids = list(chain.from_iterable(map(c.words.__getitem__, w)))
                    n.append(len(ids))
                    ids_sha.append(sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
