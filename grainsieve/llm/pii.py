"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The network is trained in numpy from labelled spans: the patterns' own in a bounded sample of texts, and others written into
these texts in forms that no pattern finds (fields apart, other separators, words for signs), beside dates, versions,
prices and the like, which are no personal data.

Whole texts are cut into overlapping windows, whatever stands in them; each is decoded to the probabilities of its tags
by forward-backward, those of a character are averaged over its windows, weighted by how far from a window's border it
is, and a Viterbi pass over what may be inside settles the spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .secret_scan import masked
from .textcore import fields_of, map_batches, pieces, quoted

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ZONE = re.compile(r"[0-9][0-9\x20.-]*")  # all that an address of the net or a card number is made of


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in code points; the time is in proportion to the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, 0, done))
        at = text.find("@", done)
    for zone in _ZONE.finditer(text):
        a, z = zone.span()
        if z - a >= 7:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, a, z) if all(map(_small, m[0].split(".")))]
        if z - a >= 12:
            out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text, a, z) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m[0])) <= 15:
            out.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


# ---- the network

WINDOW = 64  # characters of one that is learned from
BLOCK = 32
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_SIGNS = "".join(map(chr, range(33, 127)))
_CODES = {c: k for k, c in enumerate(dict.fromkeys("\0 \n" + re.sub("[A-Z1-9]", "", _SIGNS) + "é"))}  # padding, blank, other space, signs, letters, digits as 0; the last: other letters
ALPHABET = len(_CODES) + 1  # and what is none of these


def code(c: str) -> int:
    if c.isdigit():
        return _CODES["0"]
    if (k := _CODES.get(c.lower() if c.isascii() else "")) is not None:
        return k
    return _CODES["é"] if c.isalpha() else _CODES["\n"] if c.isspace() else len(_CODES)


_ASCII = np.array([code(chr(k)) if k else len(_CODES) for k in range(128)], np.uint8)
_PLANE = np.zeros(0x110000, np.uint8)  # of all code points; 0: not asked for yet
_PLANE[:128] = _ASCII


def codes(text: str) -> np.ndarray:
    if text.isascii():
        return _ASCII[np.frombuffer(text.encode(), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _PLANE[points]
    if not out.all():
        new = np.unique(points[out == 0])
        _PLANE[new] = [code(chr(c)) for c in new.tolist()]
        out = _PLANE[points]
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: an inside only its own begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for y in range(2, TAGS, 2):
        ok[:, y] = False
        ok[[y - 1, y], y] = True
    return ok


ALLOWED = allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _run(x: np.ndarray, wh: np.ndarray, keep: bool):
    """Hidden states of an LSTM over x (time, rows, 4 gates) and, for training, what its slope needs."""
    steps, rows, h4 = x.shape
    n = h4 // 4
    h, c = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
    out, kept = np.empty((steps, rows, n), x.dtype), []
    for t in range(steps):
        z = x[t] + h @ wh
        s, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        before = c
        c = s[:, n : 2 * n] * c + s[:, :n] * g
        top = np.tanh(c)
        if keep:
            kept.append((s, g, before, top, h))
        h = s[:, 2 * n :] * top
        out[t] = h
    return out, kept


#: In float32 a number's bits, read as an integer, are 2**23 times its binary logarithm and 127, but for a bend between powers of two.
_BIT, _ONE, _FARTHEST = 1 << 23, 127 << 23, 120


def _squash(z: np.ndarray, bits: np.ndarray, other: np.ndarray) -> None:
    """The sigmoid of x in place of z: of float32, z is 127 - x / (2 ln 2) in units of a bit, else -x.

    With e = exp(-x / 2) it is (1 / e) / (e + 1 / e). In float32 both powers are read off their bits, and as their bends are opposite,
    it is within 0.0026 of the true value everywhere.
    """
    if z.dtype == np.float32:
        np.copyto(bits, z, casting="unsafe")
        np.subtract(2 * _ONE, bits, out=other)
        up, down = bits.view(np.float32), other.view(np.float32)
        up += down
        np.divide(down, up, out=z)
    else:
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)


def _emitted(cols: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """(time, tags, rows): emissions of characters (time, rows), as emissions() has them, but less those of the first tag, outside.

    Both directions run side by side, gates as whole blocks. Cells and states are held as halves, as tanh(x) is 2 * (sigmoid(2 * x) - 1 / 2), and one product with the last states gives the next gates and the last emissions.
    """
    n, kind, (steps, rows), tags = len(w["hf"]), w["out"].dtype, cols.shape, w["out"].shape[1]
    over = w["out"][:, 1:] - w["out"][:, :1]
    quick = kind == np.float32
    unit, zero = (-_BIT / (2 * np.log(2)), _ONE) if quick else (-1.0, 0)
    scale = np.full(4 * n, unit)
    scale[3 * n :] *= 2
    low, high = _ONE - _FARTHEST * _BIT, _ONE + _FARTHEST * _BIT
    far = deep = False
    tables, products = [], []
    for d, out in (("f", over[:n]), ("b", over[n:])):
        most = np.abs(w[f"x{d}"] * scale).max(0) + np.abs(w[f"h{d}"] * scale).sum(0)
        far |= quick and bool(most.max() > _FARTHEST * _BIT)
        tables.append((w[f"x{d}"] * scale + zero).astype(kind))
        products.append(np.ascontiguousarray(2 * np.concatenate([w[f"h{d}"] * scale, out], 1).T.astype(kind)))
    e = np.empty((steps, tags, rows), kind)
    e[:] = (w["bias"] - w["bias"][0])[:, None]
    h, c, top = (np.zeros((n, 2, rows), kind) for _ in range(3))
    x, z, made = np.empty((rows, 4 * n), kind), np.empty((4 * n, 2, rows), kind), np.empty((4 * n + tags - 1, 2, rows), kind)
    bits, other = np.empty(z.shape, np.int32), np.empty(z.shape, np.int32)
    i, f, o, g = (z[k * n : (k + 1) * n] for k in range(4))
    with np.errstate(over="ignore"):
        for t in range(steps + 1):
            for d in (0, 1):
                if t:
                    np.matmul(products[d], h[:, d], made[:, d])
                    e[steps - t if d else t - 1, 1:] += made[4 * n :, d]
                if t < steps:
                    np.take(tables[d], cols[steps - 1 - t if d else t], 0, x, "clip")
                    np.copyto(z[:, d], x.T)
            if t == steps:
                break
            if t:
                z += made[: 4 * n]
            if far:
                np.clip(z, low, high, z)
            _squash(z, bits, other)
            g -= 0.5
            g *= i
            c *= f
            c += g
            if quick and t % 32 == 31:  # a cell's half gains half at most in a step
                deep = bool(np.abs(c).max() > 20)
            np.multiply(c, 4 * unit, top)
            if quick:
                top += zero
                if deep:
                    np.clip(top, low, high, top)
            _squash(top, bits[:n], other[:n])
            top -= 0.5
            np.multiply(o, top, h)
    return e


def _back(dout: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """The slopes by x and by wh."""
    steps, rows, n = dout.shape
    dx, dwh = np.empty((steps, rows, 4 * n), dout.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((rows, n), dout.dtype), np.zeros((rows, n), dout.dtype)
    for t in range(steps - 1, -1, -1):
        s, g, before, top, h = kept[t]
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        d = dout[t] + dh
        dc = d * o * (1 - top * top) + dc
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * top * o * (1 - o), dc * i * (1 - g * g)], 1)
        dx[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def marginals(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of emissions (time, rows, tags): each tag's probability, the expected number of moves, and each row's log total."""
    m = np.where(ALLOWED, np.exp(moves), 0.0)
    top = e.max(2, keepdims=True)
    p = np.exp(e - top).astype(np.float64)
    steps = len(e)
    a, scale, b = np.empty_like(p), np.empty(p.shape[:2]), np.empty_like(p)
    for t in range(steps):
        a[t] = p[t] if not t else (a[t - 1] @ m) * p[t]
        scale[t] = a[t].sum(1)
        a[t] /= scale[t][:, None]
    b[-1] = 1.0
    expected = np.zeros_like(m)
    for t in range(steps - 2, -1, -1):
        onward = p[t + 1] * b[t + 1] / scale[t + 1][:, None]
        expected += a[t].T @ onward
        b[t] = onward @ m.T
    return a * b, expected * m, np.log(scale).sum(0) + top[:, :, 0].sum(0)


@dataclass
class Network:
    """Input tables (a row for each character and direction), recurrent weights, output layer and moves."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator, kind=np.float32) -> Network:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (ALPHABET, 4 * hidden)).astype(kind)
            w[f"x{d}"][:, hidden : 2 * hidden] += 1.0
            w[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(kind)
        w["out"] = rng.normal(0, 0.1, (2 * hidden, TAGS)).astype(kind)
        w["bias"] = np.zeros(TAGS, kind)
        w["moves"] = np.zeros((TAGS, TAGS), kind)
        return cls(w)

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Of windows (rows, time): emissions (time, rows, tags) and, for training, what their slopes need."""
        w, t = self.weights, ids.T
        hf, kf = _run(w["xf"][t], w["hf"], keep)
        hb, kb = _run(w["xb"][t[::-1]], w["hb"], keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ w["out"] + w["bias"], (h, kf, kb)

    def slopes(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of labelled windows, and its slope by every weight."""
        w, rows = self.weights, len(ids)
        e, (h, kf, kb) = self.emissions(ids, keep=True)
        p, expected, total = marginals(e, w["moves"])
        y = gold.T
        onehot = np.eye(TAGS)[y]
        seen = np.zeros_like(expected)
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1.0)
        score = (e * onehot).sum() + (w["moves"] * seen).sum()
        de = ((p - onehot) / rows).astype(e.dtype)
        out = {"moves": np.where(ALLOWED, (expected - seen) / rows, 0.0).astype(e.dtype), "bias": de.sum((0, 1)), "out": np.tensordot(h, de, ((0, 1), (0, 1)))}
        dh = de @ w["out"].T
        n = dh.shape[2] // 2
        chars = np.eye(ALPHABET, dtype=e.dtype)[ids.T].reshape(-1, ALPHABET)
        dx, out["hf"] = _back(dh[:, :, :n], w["hf"], kf)
        out["xf"] = chars.T @ dx.reshape(-1, 4 * n)
        dx, out["hb"] = _back(dh[::-1, :, n:], w["hb"], kb)
        out["xb"] = chars.T @ dx[::-1].reshape(-1, 4 * n)
        return float((total.sum() - score) / rows), out

    def tags(self, ids: np.ndarray) -> np.ndarray:
        """(rows, time, tags): the probabilities of windows' tags, as marginals() of emissions() has them, without what learning needs."""
        w, cols = self.weights, ids.T.astype(np.intp)
        (steps, rows), kind = cols.shape, w["out"].dtype
        p = _emitted(cols, w)
        np.clip(p, -25, 25, p)  # beyond it all is certain, and no path's weight gets too small for a float
        np.exp(p, p)
        m = np.where(ALLOWED, np.exp(w["moves"]), 0).astype(kind)
        moves = np.stack([m.T, m])  # onward and back, both at once
        both, now = np.ones((steps, 2, TAGS, rows), kind), np.empty((2, TAGS, rows), kind)
        for t in range(steps):
            if t:
                np.matmul(moves, now, out=both[t])
            np.multiply(both[t, 0], p[t], out=now[0])
            np.multiply(both[t, 1], p[steps - 1 - t], out=now[1])
            now *= np.reciprocal(np.add.reduce(now, 1))[:, None]
        p *= both[:, 0]
        p *= both[::-1, 1]
        p /= np.add.reduce(p, 1)[:, None]
        return np.ascontiguousarray(p.transpose(2, 0, 1))


# ---- learning

#: Forms that no pattern finds: {u} a user, {h} a host, {t} a top domain, {n} up to 255, {x4} so many hexadecimal digits, 0 a digit. Cards' digits pass Luhn.
FORMS = {
    "email": ("{u} at {h} dot {t}", "{u}(at){h}.{t}", "{u} [at] {h} [dot] {t}", "{u} @ {h}.{t}", "{u}(at){h}(dot){t}", "{u} AT {h} DOT {t}", "{u}[at]{h}.{t}", "{u} @{h}.{t}"),
    "ip": ("{x4}:{x3}::{x2}:{x4}", "{x4}::{x4}:{x4}:{x4}:{x4}", "{x4}:{x4}:{x4}:{x4}:{x4}:{x4}:{x4}:{x4}", "{n}[.]{n}[.]{n}[.]{n}", "{n} . {n} . {n} . {n}", "{n}(.){n}(.){n}(.){n}"),
    "card": ("0000.0000.0000.0000", "0000/0000/0000/0000", "0000 - 0000 - 0000 - 0000", "0000_0000_0000_0000", "0000.000000.00000", "0000/000000/00000"),
    "phone": ("(000) 000-0000", "000-000-0000", "0049 00 0000000", "000.000.0000", "0000/0000000", "+00/000/000000", "(0000) 000000", "000 000 0000"),
}
#: What is no personal data, though it has digits or signs.
ORDINARY = (
    "2000-00-00", "00.00.2000", "00:00:00", "v0.00.0", "0.0.00", "$0,000.00", "00,000", "00.0%", "000-0-00-000000-0", "0:0", "00000", "page 00", "2000-2000", "@{u}", "{u}@{h}", "00 km", "#{x6}", "{x32}",
    "{u}00", "0st {u}", "{h}.{t}/00", "0 000 000", "(0) (00)", "00/00/2000", "00x00", "no. 00-0000", "{u} at {h}", "dot {h}", "at 00 {h}", "00000000", "0.", "00.0.",
)
_TOPS = ("com", "org", "net", "de", "io", "co.uk", "edu", "fr")


def written(form: str, kind: str | None, words: list[str], rng: random.Random) -> str:
    """A form filled in."""
    pick = lambda: rng.choice(words)
    if kind == "card":
        d = [rng.randrange(10) for _ in range(form.count("0"))]
        d[-1] = next(x for x in range(10) if luhn("".join(map(str, [*d[:-1], x]))))
        it = iter(d)
        return re.sub("0", lambda _: str(next(it)), form)

    def fill(m: re.Match) -> str:
        c = m[1] or "0"
        if c == "u":
            return pick() + rng.choice(("", ".", "_", "-")) + rng.choice((pick(), str(rng.randrange(100)))) if kind else pick()
        if c == "h":
            return pick() + rng.choice(("", str(rng.randrange(20)), "-" + pick()))
        if c[0] == "x":
            return "".join(rng.choice("0123456789abcdef") for _ in range(int(c[1:])))
        return rng.choice(_TOPS) if c == "t" else str(rng.randrange(256 if c == "n" else 10))

    return re.sub(r"\{(u|h|t|n|x\d+)\}|0", fill, form)


def examples(texts: list[str], most: int, rng: random.Random, forms: dict[str, tuple[str, ...]] = FORMS) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: about half with personal data written in, a quarter with something ordinary, the others as they stand, most of them around a pattern's span."""
    spans = [base_spans(t) for t in texts]
    own = [(k, s) for k, found in enumerate(spans) for s in found]
    words = list(dict.fromkeys(w.lower() for t in texts[:500] for w in re.findall(r"[A-Za-z]{3,10}", t[:500])))[:3000] or ["name", "mail", "host"]
    ids, tags = np.zeros((most, WINDOW), np.uint8), np.zeros((most, WINDOW), np.uint8)
    for row in range(most):
        dice, added = rng.random(), None
        if dice < 0.15 and own:
            k, (start, _, end) = rng.choice(own)
            text = texts[k]
        else:
            text = rng.choice(texts) if texts else ""
            start = end = rng.randrange(len(text) + 1)
            if dice < 0.93:
                while start < len(text) and not text[start].isspace():
                    start += 1
                kind = rng.choice(KINDS) if dice < 0.68 else None
                item = written(rng.choice(forms[kind] if kind else ORDINARY), kind, words, rng)
                lead = " " + rng.choice(("", "", "", "(", '"', rng.choice(words) + ": "))
                text = text[max(0, start - WINDOW) : start] + lead + item + rng.choice((" ", ". ", ", ", ") ", "\n")) + text[start : start + WINDOW]
                start = min(start, WINDOW) + len(lead)
                end = start + len(item)
                added = (start, KINDS.index(kind), end) if kind else None
        left = max(0, start - rng.randrange(max(WINDOW - (end - start), 0) + 12))
        near = text[max(0, left - WINDOW) : left + 2 * WINDOW]
        shift = max(0, left - WINDOW)
        part = text[left : left + WINDOW]
        ids[row, : len(part)] = codes(part)
        marks = [(a + shift, k, z + shift) for a, k, z in base_spans(near)]
        for a, k, z in [*marks, *([added] if added else [])]:
            a, z = a - left, z - left
            if a < WINDOW and z > 0:
                tags[row, max(a, 0) : min(z, WINDOW)] = 2 + 2 * k
                if a >= 0:
                    tags[row, a] = 1 + 2 * k
    return ids, tags


def fit(texts: list[str], most: int = 8000, rounds: int = 9, hidden: int = 20, batch: int = 160, rate: float = 0.03, seed: int = 0, forms: dict[str, tuple[str, ...]] = FORMS) -> Network:
    """Learn from `most` windows that are cut out of the texts or written into them, by Adam."""
    rng = np.random.default_rng(seed)
    ids, tags = examples(texts, most, random.Random(seed), forms)
    net = Network.new(hidden, rng)
    w = net.weights
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, rounds * (most // batch)
    for _ in range(rounds):
        order = rng.permutation(most)
        for k in range(0, most - batch + 1, batch):
            at = order[k : k + batch]
            _, g = net.slopes(ids[at], tags[at])
            size = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
            step += 1
            now = rate * (1 - 0.9 * step / max(steps, 1))
            for n, x in g.items():
                x = x * min(1.0, 5.0 / max(size, 1e-9))
                first[n] += 0.1 * (x - first[n])
                second[n] += 0.001 * (x * x - second[n])
                w[n] -= now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return net


def sample_texts(docs: DataFrame, most: int = 4000, longest: int = 1000) -> list[str]:
    """About `most` texts by a hash of doc_id and text, of each `longest` characters from around its first digit or at sign, or else its beginning: the bound on what is learned from."""
    n = docs.count()
    h = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 100), F.lit(13)), F.lit(1 << 30))
    rows = docs.where("text is not null").select(h.alias("h"), "text").where(F.col("h") < int(min(1.0, most / max(n, 1)) * (1 << 30)))
    begin = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - longest // 2)
    return [r[1] for r in sorted(rows.select("h", F.substring("text", begin, F.lit(longest)).alias("text")).collect())]


# ---- decoding

SPAN = 8  # blocks of a window that is decoded; the last is the next window's first
_RISE = (np.arange(BLOCK, dtype=np.float32)[:, None] + 1.0) / (BLOCK + 1)


def reconciled(parts: list[np.ndarray], net: Network, at_once: int = 752) -> list[np.ndarray]:
    """The tags' probabilities of whole texts of codes, from windows that overlap by a block; no position is left out. In an overlap the further one is from a window's border, the more it counts."""
    step = SPAN - 1
    n_windows = [max(-(-(len(p) - BLOCK) // (step * BLOCK)), 1) for p in parts]
    first = np.concatenate(([0], np.cumsum([n * step + 1 for n in n_windows]))).astype(np.int64)
    flat = np.zeros((int(first[-1]), BLOCK), np.uint8)
    line = flat.reshape(-1)
    for p, at in zip(parts, first.tolist(), strict=False):
        line[at * BLOCK : at * BLOCK + len(p)] = p
    where = np.concatenate([np.zeros(0, np.int64), *(at + np.arange(n) * step for at, n in zip(first.tolist(), n_windows, strict=False))])
    total = np.zeros((len(flat), BLOCK, TAGS), np.float32)
    begins, ends = np.isin(where, first), np.isin(where + SPAN, first)  # a text's first and last window count whole at its borders
    for b in range(0, len(where), at_once):
        some = where[b : b + at_once]
        p = net.tags(flat[some[:, None] + np.arange(SPAN)].reshape(len(some), -1)).reshape(len(some), SPAN, BLOCK, TAGS)
        p[:, 0] *= np.where(begins[b : b + at_once, None, None], np.float32(1), _RISE)
        p[:, -1] *= np.where(ends[b : b + at_once, None, None], np.float32(1), _RISE[::-1])
        total[some[:, None] + np.arange(1, SPAN - 1)] = p[:, 1:-1]
        total[some] += p[:, 0]
        total[some + step] += p[:, -1]
    whole = total.reshape(-1, TAGS)
    return [whole[at * BLOCK : at * BLOCK + len(p)] for p, at in zip(parts, first.tolist(), strict=False)]


def stretches(p: np.ndarray) -> list[tuple[int, int]]:
    """Where spans of the best path may lie, by the tags' probabilities of a whole text: exact, no span lies elsewhere.

    A span's last characters could be outside instead, so from each of its places on to its end the best tags must gain
    over outside. The greatest such gain from a place on bounds what any span can gain.
    """
    if not len(p):
        return []
    if p[:, 0].min() > 0.51:  # outside is likelier everywhere
        return []
    gain = np.log(p[:, 1:].max(1).astype(np.float64) + 1e-12) - np.log(p[:, 0].astype(np.float64) + 1e-12)
    if gain.max() < 0:
        return []
    sums = np.cumsum(gain[::-1])
    least = np.minimum.accumulate(np.concatenate(([0.0], sums[:-1])))
    may = ((sums - least) >= -1e-6)[::-1]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], may.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def paths(probabilities: list[np.ndarray]) -> list[np.ndarray]:
    """The best allowed tags of each stretch, all stretches of about a length at once."""
    bad = np.where(ALLOWED, 0.0, -1e9)
    order = sorted(range(len(probabilities)), key=lambda k: len(probabilities[k]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
    b = 0
    while b < len(order):
        rows = [order[b]]
        while b + len(rows) < len(order) and len(rows) < 2048 and len(probabilities[order[b + len(rows)]]) <= 1.3 * len(probabilities[rows[0]]) + 16:
            rows.append(order[b + len(rows)])
        b += len(rows)
        steps = len(probabilities[rows[-1]])
        e = np.full((steps, len(rows), TAGS), -1e9)
        e[:, :, 0] = 0.0  # outside, behind a stretch's end
        for i, k in enumerate(rows):
            e[: len(probabilities[k]), i] = np.log(probabilities[k] + 1e-12)
        score = e[0] + np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0.0, -1e9)
        came = np.zeros((steps, len(rows), TAGS), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + bad
            came[t] = all_.argmax(1)
            score = np.take_along_axis(all_, came[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        best = np.zeros((steps, len(rows)), np.int64)
        best[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            best[t - 1] = came[t][np.arange(len(rows)), best[t]]
        for i, k in enumerate(rows):
            out[k] = best[: len(probabilities[k]), i]
    return out


_V6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def plausible(kind: int, s: str) -> bool:
    """What a span of the network has to be like."""
    d = _digits(s)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", s, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", s, re.IGNORECASE)) and sum(c.isalpha() for c in s) >= 5
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return bool(_V6.fullmatch(s)) and len(s) >= 6 or len(parts) == 4 and all(map(_small, parts)) and not any(c.isalpha() for c in s)
    if any(c.isalpha() for c in s):
        return False
    return 12 <= len(d) <= 19 and luhn(d) if kind == 2 else 7 <= len(d) <= 15


SURE = 0.8  # the least mean probability of a span


def found(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the personal data in each text; kinds of the network's own spans come after the patterns'.

    A span of the network that lies within one of a pattern's is the pattern's; others may overlap.
    """
    out = [base_spans(t) for t in texts]
    if net is None:
        return out
    whole = reconciled([codes(t) for t in texts], net)
    where = [(k, a, z) for k, p in enumerate(whole) for a, z in stretches(p)]
    probabilities = [whole[k][a:z] for k, a, z in where]
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, a, _), tags, p in zip(where, paths(probabilities), probabilities, strict=True):
        begins = np.flatnonzero(tags % 2 == 1)
        for s in begins.tolist():
            y, e = int(tags[s]), s + 1
            while e < len(tags) and tags[e] == y + 1:
                e += 1
            start, end = a + s, a + e
            while end > start and not (texts[k][end - 1].isalnum() or texts[k][end - 1] in ")]"):
                end -= 1
            kind = (y - 1) // 2
            if float(1 - p[s:e, 0].mean()) >= SURE and plausible(kind, texts[k][start:end]) and not any(b <= start and end <= z for b, _, z in out[k]):
                more[k].append((start, len(KINDS) + kind, end))
    return [sorted(o + m) if m else o for o, m in zip(out, more, strict=True)]


NAMES = (*KINDS, *(f"lstm_{k}" for k in KINDS))
SPANS = "array<struct<kind:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _mapped(docs: DataFrame, net: Network | None, names: list[str], made: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # some ten thousand weights

    def work(batches):
        model = shared.value
        for b in pieces(batches, "text"):
            texts = [t or "" for t in b["text"].to_pylist()]
            yield made(b, texts, found(texts, model))

    return map_batches(docs.select(*map(quoted, names)), work, fields)


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with personal: spans of each whole text by start and kind, in code points, stop exclusive.

    Null and empty texts have none. Without a network only the patterns count. A column named personal is replaced; all
    others stay, whatever their names; rows may repeat; an empty table gives an empty one.
    """
    own = [f for f in docs.schema.fields if f.name.lower() != "personal"]
    names = [f.name for f in own]

    def made(b, _, spans):
        found_ = [[{"kind": NAMES[k], "start": s, "stop": e} for s, k, e in x] for x in spans]
        return pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(found_, _SPANS)], [*names, "personal"])

    return _mapped(docs, net, names, made, [*fields_of(own), ("personal", SPANS)])


def mask(docs: DataFrame, net: Network | None, by: str = "<PERSONAL>") -> DataFrame:
    """docs with the characters of personal data replaced by `by`; overlapping spans are one.

    The columns are those of docs, whatever their names, n_chars brought up to date if there is one. Null texts stay null;
    rows may repeat; an empty table gives an empty one.
    """
    names = docs.columns

    def made(b, texts, spans):
        kept = [None if x is None else masked(t, s, by) for x, t, s in zip(b["text"].is_valid().to_pylist(), texts, spans, strict=True)]
        kept = [t if v else None for t, v in zip(kept, b["text"].is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kept, b.schema.field("text").type) if c == "text" else b[c] for c in names], names)

    out = _mapped(docs, net, names, made, fields_of(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def report(scanned: DataFrame) -> DataFrame:
    """The digest of scan()."""
    def n(kind: str):
        return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("personal", lambda s: s["kind"].isin(*KINDS))
    more = F.size(F.filter("personal", lambda s: ~s["kind"].isin(*KINDS))).cast("long").alias("n_lstm")
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), *map(n, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("personal")).alias("spans"), more)
