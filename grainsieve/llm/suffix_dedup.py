"""Exact removal of repeated byte strings by a collection's Burrows-Wheeler transform, built column by column.

A start p is repeated if the `length` bytes at p also start earlier. Every such string has one anchor: the smallest
of its 24-byte hashes, leftmost first. Consecutive starts with one anchor form a run, and the bytes under a run are a
passage; equal strings lie in passages of the same anchor at the same distance from it. So:

1. anchors: each text's anchors are dealt by hash, and those that occur once are dropped for good;
2. passages: the passages of the others are gathered by anchor, equal ones merged with their first occurrence;
3. the passages that share an anchor without being equal are a collection of strings. Its transform is built from the
   right, one symbol of each string a round: the round's new suffixes are merged into the transform and the
   common-prefix table, which are read and rewritten front to back. Suffixes with a common prefix of `length` bytes
   or more are neighbours there, and their first occurrence is the one to keep;
4. what is not a first occurrence is cut from the texts.

Step 3's sequential files are the shuffle blocks of a deal of anchors and the arrays of the deal itself, which hold a
bounded number of passages, so they need no folder of a machine. An anchor that many passages share is split by the
bytes around it: its run is cut into chunks of CHUNK starts, keyed by the bytes that all windows of a chunk have in
common.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship, shuffle_partitions
from . import textcore as tc

_U = np.uint64
GRAM, CHUNK = 24, 8
HOT = 512  # occurrences (a text block's equal passages count once) from which an anchor's passages are split
COLLECTION = 1500  # passages in one transform, if their anchors allow
BLOCK = 3 << 20  # bytes of text that are handled together
NEVER = np.iinfo(np.int64).max


def collection_bwt(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a collection (0: a string's beginning; others are bytes, numbered in order) and the common prefixes of neighbouring suffixes, at most cap."""
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.zeros(256, bool)
    used[flat] = True
    kind = np.uint8 if used.sum() < 256 else np.uint16  # symbols are numbered from 1 in the order of their bytes
    flat = np.cumsum(used).astype(kind)[flat]
    end = np.cumsum(size)

    def symbol(i: np.ndarray, n: int) -> np.ndarray:
        """What stands before the suffix of n symbols; 0 before a whole string."""
        at = end[i] - n - 1
        return np.where(size[i] > n, flat[np.maximum(at, 0)], 0).astype(np.uint16)

    shared = np.uint8 if cap < 256 else np.uint16 if cap < 65536 else np.uint32  # what holds a common prefix
    every = np.arange(m)
    bwt, lcp = symbol(every, 0), np.zeros(m, shared)
    open_ = every  # strings with symbols left, in the order of their longest suffix so far
    at = every.copy()  # and where that stands
    n = 0
    while len(open_ := open_[(left := size[open_] > n)]):
        at, n = at[left], n + 1
        # Where each new suffix goes: after the m empty ones, in the order of symbol, then of the suffix without it.
        order = np.argsort(bwt, kind="stable")
        order = order[np.searchsorted(bwt[order], 1) :] if len(order) else order
        who = np.full(len(bwt), -1, np.int32)
        who[at] = open_
        owner = who[order]
        new = np.flatnonzero(owner >= 0)
        old = owner < 0
        grown, common = np.empty(m + len(order), kind), np.zeros(m + len(order), shared)
        grown[:m], common[:m] = bwt[:m], lcp[:m]
        grown[m:][old], common[m:][old] = bwt[m:], lcp[m:]
        grown[m:][new] = symbol(owner[new].astype(np.int64), n)
        # Common prefixes change only at new suffixes and right after them.
        spot = np.unique(np.concatenate((new, new + 1)))
        spot = spot[(spot > 0) & (spot < len(order))]
        low, high = order[spot - 1], order[spot]
        same = bwt[low] == bwt[high]
        value = np.zeros(len(spot), shared)
        if same.any():
            bounds = np.empty(2 * int(same.sum()), np.int64)
            bounds[0::2], bounds[1::2] = low[same] + 1, high[same] + 1
            ahead = np.append(lcp, shared(np.iinfo(shared).max))
            value[same] = np.minimum(np.minimum.reduceat(ahead, bounds)[0::2].astype(np.int64) + 1, cap)
        common[m + spot] = value
        if len(order):
            common[m] = 0
        bwt, lcp, open_, at = grown, common, owner[new].astype(np.int64), m + new
    return bwt, lcp


def classes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of at least `length` bytes: its string, its start in it, and a number that equal first `length` bytes share."""
    bwt, lcp = collection_bwt(strings, length)
    m, size = len(strings), np.array([len(s) for s in strings], np.int64)
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(bwt), np.int64)
    place[order] = np.arange(len(bwt)) - np.count_nonzero(bwt == 0) + m
    group = np.cumsum(lcp < length)
    who, at, out = np.arange(m), np.arange(m), []
    for n in range(int(size.max(initial=0)) + 1):
        if n:
            more = size[who] >= n
            who, at = who[more], place[at[more]]
        if n >= length:
            out.append((who, size[who] - n, group[at]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts (offsets off): runs of starts with one anchor, as first start, number, anchor's hash and anchor's place."""
    n, width = len(buf), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(_U), none
    up, down = tc._powers(n + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(tc.BYTE_HASH[buf] * up[:n])))
    h = tc.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    key = _sliding_min((h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U), width)
    anchor = (key & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(n + 1, np.int8)
    long_ = np.diff(off) >= length
    np.add.at(change, off[:-1][long_], 1)
    np.add.at(change, (off[1:] - length + 1)[long_], -1)
    valid = np.cumsum(change[: len(anchor)], dtype=np.int8) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[off[:-1][long_]] = True
    start = np.flatnonzero(first)
    place = np.cumsum(valid) - 1  # number of a valid start among all
    count = np.diff(np.append(place[start], int(valid.sum())))
    return start, count, h[anchor[start]], anchor[start]


def _blobs(key: np.ndarray, deals: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by deal, and (deal, from, to) in it."""
    to = ((key >> _U(20)) % _U(deals)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    held, first = np.unique(to[order], return_index=True)
    cut = np.append(first, len(to))
    return order, [(int(d), int(a), int(z)) for d, a, z in zip(held, cut, cut[1:], strict=False)]


def _chunks(buf: np.ndarray, start: int, count: int, gram: int, anchor: int, length: int):
    """A run in chunks by the distance to its anchor, each with a key made of what all windows of a whole chunk have in common."""
    at = start
    while at < start + count:
        chunk, inner = divmod(anchor - at, CHUNK)
        more = min(start + count - at, inner + 1)
        low = anchor - chunk * CHUNK
        core = buf[low : low - CHUNK + 1 + length].tobytes()
        yield at, more, int.from_bytes(blake2b(core, digest_size=8, key=gram.to_bytes(8, "little")).digest(), "little")
        at += more


class Passages:
    """The passages of a block of texts whose anchors occur more than once; equal ones are one, led by its first occurrence."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, ids: np.ndarray, anchors: np.ndarray, hot: np.ndarray, length: int):
        """anchors: sorted hashes that count; hot: for each, whether its runs are split."""
        found = [[], [], []]
        for i, j in tc.slices(off):
            part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            start, count, gram, place = runs(part, o, length)
            at = np.searchsorted(anchors, gram)
            known = (anchors[np.minimum(at, len(anchors) - 1)] == gram) if len(anchors) else np.zeros(len(gram), bool)
            split = known.copy()
            split[known] = hot[at[known]]
            whole = known & ~split
            more = [x for p, n, g, a in zip(start[split].tolist(), count[split].tolist(), gram[split].tolist(), place[split].tolist(), strict=True) for x in _chunks(part, p, n, g, a, length)]
            found[0].append(np.concatenate((start[whole], np.array([x[0] for x in more], np.int64))) + off[i])
            found[1].append(np.concatenate((count[whole], np.array([x[1] for x in more], np.int64))))
            found[2].append(np.concatenate((gram[whole], np.array([x[2] for x in more], _U))))
        self.start, self.count, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        doc = np.searchsorted(off, self.start, "right") - 1
        own, at = ids[doc], self.start - off[doc]
        number: dict[tuple[int, bytes], int] = {}
        raw, over = buf.tobytes(), length - 1
        self.which = np.fromiter((number.setdefault((k, raw[x : x + n + over]), len(number)) for k, x, n in zip(key.tolist(), self.start.tolist(), self.count.tolist(), strict=True)), np.int64, len(self.start))
        self.bytes = [b for _, b in number]
        order = np.lexsort((at, own, self.which))
        lead = order[np.unique(self.which[order], return_index=True)[1]] if len(order) else order
        self.key, self.doc_id, self.at = key[lead], own[lead], at[lead]
        #: Whether a run stands where its passage's first occurrence stands; rows that repeat a doc_id and a text tie.
        self.leads = (own == self.doc_id[self.which]) & (at == self.at[self.which]) if len(order) else np.zeros(0, bool)


def _resolve(parts: list[dict], length: int) -> list[np.ndarray]:
    """For each part (a block's passages of one deal): for all their starts in a row, whether the first occurrence there is not the very first."""
    key = np.concatenate([p["key"] for p in parts])
    own, at = np.concatenate([p["doc_id"] for p in parts]), np.concatenate([p["at"] for p in parts])
    strings = [b for p in parts for b in p["bytes"]]
    number: dict[tuple[int, bytes], int] = {}
    which = np.fromiter((number.setdefault(x, len(number)) for x in zip(key.tolist(), strings, strict=True)), np.int64, len(strings))
    distinct = [b for _, b in number]
    keys = np.array([k for k, _ in number], _U)
    order = np.lexsort((at, own, which))
    lead = order[np.unique(which[order], return_index=True)[1]]
    starts = np.array([len(b) - length + 1 for b in distinct], np.int64)
    base = np.cumsum(starts) - starts
    # The first occurrence at each start of each distinct passage: its own, unless others of its anchor have the string earlier.
    first_id = np.repeat(own[lead], starts)
    first_at = np.repeat(at[lead], starts) + np.arange(int(starts.sum())) - np.repeat(base, starts)
    _, inverse, size = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[inverse] > 1)
    several = several[np.argsort(inverse[several], kind="stable")]
    ends = np.flatnonzero(np.diff(inverse[several], append=-1)) + 1  # where an anchor's passages end
    at_ = 0
    while at_ < len(several):
        to = ends[min(np.searchsorted(ends, at_ + COLLECTION), len(ends) - 1)]
        some, at_ = several[at_:to], to
        who, offset, group = classes([distinct[i] for i in some.tolist()], length)
        spot = base[some[who]] + offset
        order = np.lexsort((first_at[spot], first_id[spot], group))
        spot, group = spot[order], group[order]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        best = np.repeat(spot[head], np.diff(np.append(head, len(spot))))
        first_id[spot], first_at[spot] = first_id[best], first_at[best]
    out, done = [], 0
    for p in parts:
        mine = which[done : done + len(p["key"])]
        n = starts[mine]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        spot = np.repeat(base[mine], n) + inner
        out.append((first_id[spot] != np.repeat(p["doc_id"], n)) | (first_at[spot] != np.repeat(p["at"], n) + inner))
        done += len(p["key"])
    return out


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [{"start": int(a), "stop": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _rows(ids: list[int | None], buf: np.ndarray, off: np.ndarray, covered: np.ndarray | None, keep: bool) -> list[dict]:
    out = []
    for k, i in enumerate(ids):
        part, hit = buf[off[k] : off[k + 1]], None if covered is None else covered[off[k] : off[k + 1]]
        spans = [] if hit is None else _spans(hit)
        kept = (part[~hit] if spans else part).tobytes()
        out.append({"doc_id": i, "n_bytes": len(part), "spans": spans, "kept_sha256": sha256(kept).hexdigest(), "kept": kept if keep else None})
    return out


def repeated_spans(docs: DataFrame, length: int = 100, keep: bool = False, hot_from: int = HOT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, spans of repeated bytes, kept_sha256 and, with keep, the kept bytes; one row per input row.

    A byte is repeated if a string of `length` bytes (at least 48) covers it that also starts earlier: in a text of smaller doc_id, or
    earlier in the same text. Strings are judged on the input. Null texts count as empty. Rows of null doc_id come
    after all others; rows that share a doc_id are one place, so equal rows are not repeats of one another. Other
    columns are dropped. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = int(size // BLOCK + 1)
    deals = int(max(parts, size // (32 << 20) + 1))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # By text as well, so that neither rows of null doc_id nor many texts of one doc_id are a block of their own.
    text = text.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(blocks)).cast("long"))

    def anchors(batches):
        for b in batches:
            buf, off = tc.column_bytes(b["text"])
            block = b["block"].to_numpy(zero_copy_only=False)
            gram, passage, of = [], [], []
            for i, j in tc.slices(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                start, count, h, _ = runs(part, o, length)
                up, down = tc._powers(len(part) + 1)
                total = np.concatenate((np.zeros(1, _U), np.cumsum(tc.BYTE_HASH[part] * up[: len(part)])))
                passage.append(tc.mix((total[start + count + length - 1] - total[start]) * down[start] + count.astype(_U)))
                gram.append(h)
                of.append(block[i + np.searchsorted(o, start, "right") - 1])
            if not gram or not sum(map(len, gram)):
                continue
            gram, passage, of = np.concatenate(gram), np.concatenate(passage), np.concatenate(of)
            order = np.lexsort((passage, of, gram))
            gram, passage, of = gram[order], passage[order], of[order]
            head = np.ones(len(gram), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
            other = head.copy()
            other[1:] |= passage[1:] != passage[:-1]
            spot = np.flatnonzero(head)
            n = np.minimum(np.add.reduceat(other.astype(np.int64), spot), 254)
            twice = np.diff(np.append(spot, len(gram))) > 1
            n = np.where(twice & (n == 1), 255, n)  # 255: one passage, but more than once
            gram, of = gram[spot], of[spot]
            order, cut = _blobs(gram, deals)
            gram, of, n = gram[order], of[order].astype(np.int32), n[order].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in cut], pa.int64()), *(pa.array([x[a:z].tobytes() for _, a, z in cut], pa.binary()) for x in (gram, of, n))], ["deal", "gram", "of", "n"])

    def repeats(t: pa.Table) -> pa.Table:
        gram, of, n = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("gram", _U), ("of", np.int32), ("n", np.uint8)))
        order = np.argsort(gram, kind="stable")
        gram, of, n = gram[order], of[order], n[order].astype(np.int64)
        spot = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        each = np.diff(np.append(spot, len(gram)))
        total = np.add.reduceat(np.where(n == 255, 1, n), spot)
        keep_ = (each > 1) | (total > 1) | (np.maximum.reduceat(n, spot) == 255)
        hot = np.repeat(total >= hot_from, each)
        mask = np.repeat(keep_, each)
        gram, of, hot = gram[mask], of[mask], hot[mask]
        order = np.argsort(of, kind="stable")
        gram, of, hot = gram[order], of[order], hot[order]
        spot = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        cut = list(zip(spot.tolist(), np.append(spot[1:], len(of)).tolist(), strict=True))
        return pa.table({"block": pa.array(of[spot].astype(np.int64)), "kind": pa.array(["anchor"] * len(cut), pa.string()), "a": pa.array([gram[a:z].tobytes() for a, z in cut], pa.binary()), "b": pa.array([hot[a:z].tobytes() for a, z in cut], pa.binary()), "c": pa.array([None] * len(cut), pa.binary())})

    answers = text.mapInArrow(anchors, "deal long, gram binary, of binary, n binary").groupBy("deal").applyInArrow(repeats, "block long, kind string, a binary, b binary, c binary")
    answers = materialize(answers, "anchors")

    def passages(left: pa.Table, right: pa.Table) -> tuple[list[int | None], np.ndarray, np.ndarray, Passages]:
        """A block's texts in a fixed order, so that its passages have the same numbers whenever they are worked out."""
        gram = np.frombuffer(b"".join(right["a"].to_pylist()), _U)
        hot = np.frombuffer(b"".join(right["b"].to_pylist()), bool)
        order = np.argsort(gram, kind="stable")
        gram, hot = gram[order], hot[order]
        one = np.ones(len(gram), bool)
        one[1:] = gram[1:] != gram[:-1]  # several batches may have told of it
        ids = left["doc_id"].to_pylist()
        texts = left["text"].to_pylist()
        rows = sorted(zip([NEVER if i is None else i for i in ids], texts, strict=True))
        buf, off = tc.column_bytes(pa.array([t for _, t in rows], pa.string()))
        keys = np.array([i for i, _ in rows], np.int64)
        return [None if i == NEVER else i for i in keys.tolist()], buf, off, Passages(buf, off, keys, gram[one], hot[one], length)

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's distinct passages, dealt out by anchor."""
        out = {c: [] for c in ("block", "deal", "a", "b", "c", "d")}
        if left.num_rows and right.num_rows:
            p = passages(left, right)[3]
            pack = zstandard.ZstdCompressor(1)
            order, cut = _blobs(p.key, deals)
            for d, x, z in cut:
                mine = order[x:z]
                text_ = [p.bytes[i] for i in mine.tolist()]
                row = (left["block"][0].as_py(), d, pack.compress(b"".join(text_)), np.array([len(t) for t in text_], np.int32).tobytes(), np.stack([p.key[mine].view(np.int64), p.doc_id[mine], p.at[mine]]).tobytes(), mine.astype(np.int32).tobytes())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in {"block", "deal"} else pa.binary()) for k, v in out.items()})

    def resolve(t: pa.Table) -> pa.Table:
        parts_, unpack = [], zstandard.ZstdDecompressor()
        for a, b, c in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True):
            n, a = np.frombuffer(b, np.int32).astype(np.int64), unpack.decompress(a)
            end = np.cumsum(n)
            key, own, at = np.frombuffer(c, np.int64).reshape(3, -1)
            parts_.append({"bytes": [a[x:z] for x, z in zip((end - n).tolist(), end.tolist(), strict=True)], "key": key.view(_U), "doc_id": own, "at": at, "n": n - length + 1})
        masks = _resolve(parts_, length)
        return pa.table({"block": t["block"], "kind": pa.array(["mask"] * len(parts_), pa.string()), "a": t["d"], "b": pa.array([p["n"].astype(np.int32).tobytes() for p in parts_], pa.binary()), "c": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], _RESULT)
        kind = right["kind"]
        ids, buf, off, p = passages(left, right.filter(pc.equal(kind, "anchor")))
        told_ = right.filter(pc.equal(kind, "mask"))
        mask_of: dict[int, np.ndarray] = {}
        for w, n, m in zip(told_["a"].to_pylist(), told_["b"].to_pylist(), told_["c"].to_pylist(), strict=True):
            w, n = np.frombuffer(w, np.int32), np.frombuffer(n, np.int32).astype(np.int64)
            bits = np.unpackbits(np.frombuffer(m, np.uint8), count=int(n.sum())).view(bool)
            for i, x in zip(w.tolist(), np.split(bits, np.cumsum(n)[:-1]), strict=True):
                mask_of[i] = x
        repeated = np.zeros(len(buf) + length + 1, bool)
        for x, n, w, leads in zip(p.start.tolist(), p.count.tolist(), p.which.tolist(), p.leads.tolist(), strict=True):
            repeated[x : x + n] = mask_of[w] if leads else True
        depth = np.zeros(len(repeated) + 1, np.int32)
        at = np.flatnonzero(repeated)
        depth[at] += 1
        depth[at + length] -= 1
        return pa.Table.from_pylist(_rows(ids, buf, off, np.cumsum(depth)[: len(buf)] > 0, keep), _RESULT)

    # The texts are dealt into blocks once; both uses below read the same exchange.
    blocks_ = text.groupBy("block")
    dealt = blocks_.cogroup(answers.groupBy("block")).applyInArrow(gather, "block long, deal long, a binary, b binary, c binary, d binary")
    told = dealt.groupBy("deal").applyInArrow(resolve, "block long, kind string, a binary, b binary, c binary")
    return text.groupBy("block").cogroup(answers.union(told).groupBy("block")).applyInArrow(cut, RESULT)


def report(found: DataFrame) -> DataFrame:
    """The digest of repeated_spans()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
