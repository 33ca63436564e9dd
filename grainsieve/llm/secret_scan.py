"""Secret scans by a linear-chain conditional random field over tokens, beside exact patterns.

Tokens are runs of anything but white space, tagged begin, inside or outside of a secret from their shape, the words
and kinds of the neighbouring tokens and features of the file, and decoded by Viterbi. The patterns' spans are always kept; the
field adds spans of its own.

Most tokens are plain words: nothing in their shape is odd (_ODD), they hold no keyword and are not among the AFTER
tokens behind a keyword or an opener. The field holds them outside by a constraint, in learning and in decoding, so the
chain falls apart at them: decoding the stretches of other tokens between them gives what decoding the whole text would.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .langid import forward_backward
from .textcore import fields_of, map_batches, pieces, quoted

# Fixed patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_OPENER = re.compile(r"pass(?:word|wd|phrase|code|key)|pwd|secret|token|api_?key|bearer|credential|\bkey\b", re.ASCII | re.IGNORECASE)
# Signs of codes, capitals within a word, long runs of letters, symbols between letters.
_ODD = re.compile(r"[0-9=_+/@:]|[A-Z]{8}|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z.-]{20}|[^\W\d_][#$%^&*!~?|\\][^\W\d_]", re.ASCII)
_ENTERS = re.compile(f"{_ODD.pattern}|(?i:{_OPENER.pattern})", re.ASCII)
AFTER = 4  # tokens behind a keyword or an opener that enter the chain whatever their shape
_SPACE, _TOKEN = re.compile(r"\s"), re.compile(r"\S+")
KINDS = ("assign", "access", "hex", "crf")
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in code points."""
    out = []
    if (":" in text or "=" in text) and _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def plain(token: str) -> bool:
    return not _ODD.search(token)


def opens(token: str) -> bool:
    return token.rstrip("\"'")[-1:] in (":", "=")


def kind_of(token: str) -> str:
    """What a token is to its neighbours."""
    if plain(token):
        return "keyword" if _OPENER.search(token) else "word"
    if opens(token):
        return "opens"
    if _OPENER.search(token):
        return "assigns"
    return "number" if not any(c.isalpha() for c in token) else "odd"


def word_of(token: str | None) -> str:
    """What a neighbour says: its letters in lower case, if they are words and no code."""
    if token is None:
        return "-"
    kind = kind_of(token)
    return "".join(filter(str.isalpha, token.lower()))[:20] if kind in ("word", "keyword", "opens") else f"<{kind}>"


def shape(token: str) -> list[str]:
    """Features of a token's own form."""
    core = token.strip("\"'.,;:!?()[]{}<>")
    n = len(core)
    digits, uppers = sum(c.isdigit() for c in core), sum(c.isupper() for c in core)
    letters = sum(c.isalpha() for c in core)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    count: dict[str, int] = {}
    for c in core:
        count[c] = count.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in count.values()) if n else 0.0
    cases = sum(a.isupper() != b.isupper() for a, b in zip(core[1:], core[2:], strict=False) if a.isalpha() and b.isalpha())
    out = [f"len{min(n // 4, 12)}", f"cases{min(cases, 6)}", f"turns{min(turns, 8)}", f"entropy{round(entropy * 2)}", f"kind_{kind_of(token)}"]
    out.append("mixed" if digits and letters else "digits" if digits else "letters")
    if letters and uppers == letters:
        out.append("upper")
    if digits and letters and n >= 16:
        out.append("long_mixed")
    if re.fullmatch(r"[0-9a-f]+", core) and letters:
        out.append("hex")
    for c in "=:_+/@.-":
        if c in core:
            out.append(f"has{c}")
    out.append("start" + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", core[:4]))))
    return out


def file_features(text: str, n_odd: int) -> list[str]:
    return [f"size{min(len(text).bit_length(), 18)}", f"odd{min(int(100 * n_odd / max(len(text), 1)), 4)}"]


def chain_tokens(text: str) -> list[tuple[int, int]]:
    """Where the tokens are that enter the chain: odd ones, keywords, and those soon after a keyword or an opener."""
    out, end = [], 0
    for m in _ENTERS.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, at)
        end = stop.start() if stop else len(text)
        out.append((start, end))
    behind = []
    for start, end in out:
        token = text[start:end]
        if opens(token) or _OPENER.search(token):
            for _ in range(AFTER):
                m = _TOKEN.search(text, end)
                if not m:
                    break
                end = m.end()
                behind.append(m.span())
    return sorted({*out, *behind}) if behind else out


def before(text: str, at: int) -> str | None:
    """The token that ends before a place."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at] or None


def after(text: str, at: int) -> str | None:
    m = _TOKEN.search(text, at)
    return m[0] if m else None


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """The chain's tokens, those with nothing but white space between them together."""
    out: list[list[tuple[int, int]]] = []
    for s, e in chain_tokens(text):
        if out and text[out[-1][-1][1] : s].isspace():
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
    return out


def chain_features(text: str, stretch: list[tuple[int, int]], file: list[str]) -> list[list[str]]:
    """The features of each token of a stretch."""
    tokens = [text[s:e] for s, e in stretch]
    left, right = before(text, stretch[0][0]), after(text, stretch[-1][1])
    kinds = [kind_of(left) if left else "none", *map(kind_of, tokens), kind_of(right) if right else "none"]
    words = [word_of(left), *map(word_of, tokens), word_of(right)]
    return [["bias", *shape(t), f"after_{kinds[k]}", f"before_{kinds[k + 2]}", f"left={words[k]}", f"right={words[k + 2]}", *file] for k, t in enumerate(tokens)]


@dataclass
class Field:
    weights: dict[str, tuple[float, float, float]]
    moves: np.ndarray  # transition scores, from row to column

    def scores(self, names: list[str]) -> list[float]:
        found = [w for f in names if (w := self.weights.get(f)) is not None]
        return [sum(w[y] for w in found) for y in range(3)]

    def viterbi(self, e: list[list[float]], opened: bool, closed: bool) -> list[int]:
        """The best labels of a stretch; opened and closed: whether a plain token, outside, stands before and after it."""
        moves = self.moves
        score = [e[0][y] + (moves[O, y] if opened else 0.0) for y in range(3)]
        back = []
        for t in range(1, len(e)):
            came = [max(range(3), key=lambda x: score[x] + moves[x, y]) for y in range(3)]
            score = [score[came[y]] + moves[came[y], y] + e[t][y] for y in range(3)]
            back.append(came)
        best = max(range(3), key=lambda y: score[y] + (moves[y, O] if closed else 0.0))
        out = [best]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def tag(self, text: str) -> list[tuple[int, int]]:
        """Secrets as (start, end) in code points; an inside tag without a begin begins one."""
        found = stretches(text)
        file = file_features(text, sum(map(len, found)))
        out = []
        for s in found:
            labels = self.viterbi([self.scores(f) for f in chain_features(text, s, file)], bool(text[: s[0][0]].strip()), bool(text[s[-1][1] :].strip()))
            begin = None
            for k, y in enumerate([*labels, O]):
                if y != I and begin is not None:
                    out.append((s[begin][0], s[k - 1][1]))
                    begin = None
                if y == B or y == I and begin is None:
                    begin = k
        return out


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: How a secret may be written so that no pattern finds it: alphabets, lengths, and what stands before and after.
_ALPHABETS = ("0123456789ABCDEF", _LETTERS, _LETTERS + "-_", _LETTERS + "+/", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LENGTHS = (20, 32, 16, 40, 12, 24, 10)
_AROUND = (("", ""), ("Bearer ", ""), ('"', '"'), ("pwd = ", ""), ("login with ", ""), ("pass: ", ""), ("(", ")"), ("key => ", ""), ("'", "',"), ("id: ", ""), ("pat_", ""))
DISGUISES = 12  # of each match
RARE = 5  # neighbours' words seen less often in learning have no weight
WORDS = 0.3  # the pace at which those words learn, of the other features' pace: shapes hold where no word is known


def _disguised(text: str, span: tuple[int, int, int], nth: int) -> tuple[str, int, int] | None:
    """The text around a pattern's match with another secret in its place that no pattern finds, and where that is; None if one does."""
    start, _, end = span
    left, right = text[max(0, start - 200) : start], text[end : end + 200]
    digest = blake2b(f"{nth} {text[start:end]}".encode(), digest_size=64).digest()
    letters, size, (lead, cut) = _ALPHABETS[nth % len(_ALPHABETS)], _LENGTHS[nth % len(_LENGTHS)], _AROUND[nth % len(_AROUND)]
    text = left + lead + "".join(letters[x % len(letters)] for x in digest[:size]) + cut + right
    at = len(left) + len(lead)
    return None if any(a < at + size and at < z for a, _, z in base_spans(text)) else (text, at, at + size)


#: Odd tokens that are no secrets, with words of the text around (w, v; u capitalised, W in capitals) and numbers of one, two and four digits (k, d, n).
_ORDINARY = (
    "{u}{v}", "{u}{v}{n}", "{w}{k}{u}", "https://{w}.org/{v}/{w}-{n}?q={v}", "20{d}-{d}-{d}T{d}:{d}:{d}Z", "ISBN-978-{k}-{d}-{n}-{k}", "v{k}.{d}.{k}-{w}{k}", "{W}-{d}", "C:\\{u}\\{v}{d}.txt",
    "{w}.{v}{d}@{w}.com", "/{w}/{v}_{n}.html", "{d}:{d}:{d}", "{W}{n}", "+{d}-{n}-{n}", "{W}_{V}", "{u}-{v}-{w}",
)


def _undisguised(text: str, span: tuple[int, int, int], nth: int) -> str | None:
    """The text around a pattern's match with an ordinary token in its place."""
    start, _, end = span
    left, right = text[max(0, start - 200) : start], text[end : end + 200]
    words = re.findall(r"[a-z]{3,12}", (left + right).lower()) or ["word"]
    x = blake2b(f"- {nth} {text[start:end]}".encode(), digest_size=16).digest()
    w, v = words[x[0] % len(words)], words[x[1] % len(words)]
    out = re.sub("{(.)}", lambda m: {"w": w, "v": v, "u": w.title(), "W": w.upper(), "V": v.upper(), "k": str(x[2 + m.start() % 8] % 10), "d": f"{x[2 + m.start() % 8] % 60:02}", "n": f"{x[2 + m.start() % 8] * 37 % 9000 + 1000}"}[m[1]], _ORDINARY[nth % len(_ORDINARY)])
    return left + out + right


def _chains(text: str, spans: list[tuple[int, int]], most: int) -> list[tuple[list[list[str]], list[int], int]]:
    """A text's stretches as features and labels, with the places outside that they lie between; the last is the number of tokens."""
    found = stretches(text)
    file = file_features(text, sum(map(len, found)))
    out = []
    for s in found:
        if most <= 0:
            break
        labels = []
        for a, z in s:
            over = [x for x in spans if x[0] < z and a < x[1]]
            labels.append(O if not over else B if min(x[0] for x in over) >= a else I)
        out.append(([["plain"], *chain_features(text, s, file), ["plain"]], [O, *labels, O], len(s)))
        most -= len(s)
    return out


def gradients(e: np.ndarray, length: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slope of the log likelihood of the labels `gold`, by the scores e of chains laid end to end and by the moves."""
    p, expected = forward_backward(e, length, np.zeros(3), moves)
    onward = np.ones(len(gold), bool)
    onward[np.cumsum(length) - length] = False
    at = np.flatnonzero(onward)
    return np.eye(3)[gold] - p, np.bincount(gold[at - 1] * 3 + gold[at], minlength=9).reshape(3, 3) - expected


def fit(texts: list[str], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4, most: int = 40_000) -> Field:
    """Maximum likelihood by Adagrad on up to `most` tokens of the texts, and as many of disguised ones.

    The labels are the patterns' spans. From these alone the field could only learn to repeat the patterns, so in each
    match's place other secrets are shown as well that no pattern finds: of other alphabets and lengths, without a
    keyword or behind other words, quoted otherwise (_disguised); and so are addresses, dates, names and the like,
    which are no secrets (_undisguised). So the field learns what the patterns miss.
    """
    chains: list[tuple[list[list[str]], list[int], int]] = []
    left, more, nth = most, most, 0
    for text in texts:
        spans = base_spans(text)
        own = _chains(text, [(a, z) for a, _, z in spans], left)
        chains += own
        left -= sum(n for *_, n in own)
        for span in spans:
            for _ in range(DISGUISES):
                nth += 1
                if more > 0 and (seen := _disguised(text, span, nth)):
                    part, a, z = seen
                    new = _chains(part, [*((x, y) for x, _, y in base_spans(part)), (a, z)], more)
                    chains += new
                    more -= sum(n for *_, n in new)
                    part = _undisguised(text, span, nth)
                    new = _chains(part, [(x, y) for x, _, y in base_spans(part)], more)
                    chains += new
                    more -= sum(n for *_, n in new)
    times = Counter(f for chain, *_ in chains for fs in chain for f in fs)
    index = {f: k for k, f in enumerate(f for f, n in times.items() if n >= RARE or "=" not in f[:6])}
    chains = [([[f for f in fs if f in index] for fs in chain], ys, n) for chain, ys, n in chains]
    w, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    if not chains:
        return Field({"bias": (1.0, 0.0, 0.0)}, moves)
    length = np.array([len(y) for _, y, _ in chains])
    size = np.array([len(fs) for chain, *_ in chains for fs in chain])
    flat = np.array([index[f] for chain, *_ in chains for fs in chain for f in fs])
    owner = np.repeat(np.arange(len(size)), size)
    gold = np.array([y for _, ys, _ in chains for y in ys])
    outside = np.array([fs == ["plain"] for chain, *_ in chains for fs in chain])
    gw, gm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    pace = np.array([rate * (WORDS if f.startswith(("left=", "right=")) else 1.0) for f in index])[:, None]
    for _ in range(rounds):
        e = np.stack([np.bincount(owner, w[flat, y], len(size)) for y in range(3)], 1)
        e[outside] = (0.0, -60.0, -60.0)  # the constraint
        diff, dm = gradients(e, length, moves, gold)
        diff[outside] = 0.0
        dw = np.stack([np.bincount(flat, diff[owner, y] / len(chains), len(index)) for y in range(3)], 1) - decay * w
        dm = dm / len(chains) - decay * moves
        gw += dw * dw
        gm += dm * dm
        w += pace * dw / np.sqrt(gw)
        moves += rate * dm / np.sqrt(gm)
    return Field({f: tuple(w[i].tolist()) for f, i in index.items()}, moves)


_BASES = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}")


def sample_texts(docs: DataFrame, per_kind: int = 800, longest: int = 20_000) -> list[str]:
    """About per_kind texts with a pattern's match, and as many without, by a hash of doc_id: a documented bound on what is learned from.

    Of a text over `longest` characters so many are taken, from around its first match or else from its beginning.
    """
    hit = F.col("text").rlike(_BASES[0]) | F.col("text").rlike(_BASES[1]) | F.col("text").rlike(_BASES[2])
    rows = docs.where("text is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).alias("h"))
    n = {r[0]: r[1] for r in rows.groupBy(hit.alias("hit")).count().collect()}
    cut = F.lit(False)
    for k, c in n.items():  # the number first: it is cheaper than the patterns
        cut = cut | ((F.col("h") < int(min(1.0, per_kind / c) * (1 << 30))) & (hit == F.lit(k)))
    at = F.least(*(F.nullif(F.regexp_instr("text", F.lit(b)), F.lit(0)) for b in _BASES))  # of those patterns that match at all
    begin = F.when(F.length("text") <= longest, 1).otherwise(F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - longest // 2))
    return [r[1] for r in sorted(rows.where(cut).select("h", F.substring("text", begin, F.lit(longest)).alias("text")).collect())]


def find(text: str, model: Field | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets: the patterns' and the field's, which may overlap."""
    return sorted(base_spans(text) + ([(a, 3, z) for a, z in model.tag(text)] if model else []))


SPANS = "array<struct<kind:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, model: Field | None) -> DataFrame:
    """docs with secrets: spans of each whole text by start and kind, in code points, stop exclusive.

    Null and empty texts have none. Without a model only the patterns count. A column named secrets is replaced; all
    others stay, whatever their names; rows may repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that it was learned from
    own = [f for f in docs.schema.fields if f.name.lower() != "secrets"]
    names = [f.name for f in own]

    def work(batches):
        m = shared.value
        for b in pieces(batches, "text"):
            found = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in find(t, m)] if t else [] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(found, _SPANS)], [*names, "secrets"])

    return map_batches(docs.select(*map(quoted, names)), work, [*fields_of(own), ("secrets", SPANS)])


def masked(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    """The text with the characters under (start, kind, end) spans, which may overlap, replaced by one `by` for each run."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Field | None, by: str = "<SECRET>") -> DataFrame:
    """docs with each secret's characters replaced by `by`; overlapping spans are one.

    The columns are those of docs, whatever their names, n_chars brought up to date if there is one. Null and empty
    texts stay; rows may repeat; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def work(batches):
        m = shared.value
        for b in pieces(batches, "text"):
            texts = [masked(t, find(t, m), by) if t else t for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else b[c] for c in names], names)

    out = map_batches(docs, work, fields_of(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def report(found: DataFrame) -> DataFrame:
    """The digest of scan()."""
    def n(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), n("crf"))
