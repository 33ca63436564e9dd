"""N-gram Jaccard self-join of documents by parity sketches.

A document's set is its distinct word shingles. In a band of set sizes, the shingle universe is dealt into blocks by
hash, and each shingle flips one of 64 bits of its block: a block's parity bits are a small sketch, and a shingle in
which two sets differ changes one block. A linked pair differs in at most D shingles, so of m blocks at least m - D are
alike (pigeonhole). If each set puts its m blocks into one order that all sets share, and a pair has m - D blocks in
common, then the pair also has T in common among the first D + T of each. These are the join keys. The order puts
blocks of many bits first: blocks without a bit or with one, which unlike sets have in common too, come last and are
mostly left out. A set is keyed in its own band of sizes and, as the smaller one, in the next.

Where few sets share a key, they are taken as pairs, and pairs that meet less than T times go: most sets that meet by
chance meet once. Where many do, they are a group, whose sets are compared by larger sketches, whose Hamming distance
is a lower bound of the sets' difference. What is left of both is verified on the sets themselves. Equal sets are
merged before anything is paired. Links are only looked for between sets that other links do not already join, so a
group of n near copies costs about n verifications, while no two sets that are linked can end in different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from hashlib import blake2b
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, ship, shuffle_partitions
from . import textcore as tc
from .components import connected_components, join_sized

_U = np.uint64
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False

TILE = 1000  # sets that are compared with one another at once
PAIRS = 4  # pairs that a tile gives out for two components in the first round; later rounds allow more, until none is left out
DEAL = 12 << 20  # bytes of keys in one deal
SMALL = 16  # sets that share a key and are taken as pairs; more are a group
MATCHES, FROM = 4, 32  # T of bands from that size on; below, it is 1
HOT = 32  # sets of one batch that share a key: they go as a list of their own, and only their first meets other batches
LIST = 4096  # ids in one row of a group
FAN = 64  # sets that are first compared with the same one of their group
PAIRS_AT_ONCE = 20_000


class Bands:
    """Size bands for one threshold: a set links only to sets of its own or a neighbouring band."""

    def __init__(self, threshold: Fraction, biggest: int = 1 << 40):
        self.t = threshold
        self.low = [1]
        while self.low[-1] <= biggest:
            self.low.append(max(self.low[-1] + 1, ceil(self.low[-1] / threshold**2)))

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def differs(self, total: int) -> int:
        """Most shingles in which a linked pair can differ, whose sizes add up to total."""
        return floor(total * (1 - self.t) / (1 + self.t))

    def blocks(self, band: int) -> int:
        """A quarter more blocks than the keys of the largest set, and some for small sets, so that weak blocks need not be keys."""
        most = self.differs(2 * (self.low[band + 1] - 1))
        return most + most // 4 + 8

    def matches(self, band: int) -> int:
        """T: in how many keys of a band two linked sets meet at least."""
        return MATCHES if self.low[band] >= FROM else 1

    def of(self, n: int) -> Iterator[tuple[int, int]]:
        """The bands in which a set of n shingles is keyed, and its number of keys there; none where only equal sets can link."""
        b = self.band(n)
        for band in (b, b + 1):
            largest = min(self.low[band + 1] - 1, floor(n / self.t))
            if largest >= self.low[band] and (d := self.differs(n + largest)):
                yield band, d + self.matches(band)


@cache
def bands(num: int, den: int) -> Bands:
    return Bands(Fraction(num, den))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    buf, off = tc.column_bytes(texts)
    for i, j in tc.slices(off):
        b, o = tc.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, at = tc.words(b, o, WORD)
        h = tc.word_hashes(b, starts, ends)
        grams = h[: len(h) - words + 1] if len(h) >= words else h[:0]
        for k in range(1, words):
            grams = tc.pair(grams, h[k : k + len(grams)])
        for r in range(j - i):
            x, y = at[r], at[r + 1]
            if y - x >= words:
                s = np.sort(grams[x : y - words + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif y > x:
                one = h[x : x + 1]
                for k in range(x + 1, y):
                    one = tc.pair(one, h[k : k + 1])
                yield tc.mix(one + _U(y - x))
            else:
                yield h[:0]


def signatures(s: np.ndarray, bs: Bands) -> np.ndarray:
    """The join keys of a set of shingle hashes. The second lowest bit is set in bands where one match makes a candidate, the lowest is free."""
    out = [np.zeros(0, _U)]
    for band, wanted in bs.of(len(s)):
        m = bs.blocks(band)
        block = ((s >> _U(32)) * _U(m)) >> _U(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        held, parity = block[first], np.bitwise_xor.reduceat(_U(1) << (s[order] & _U(63)), first)
        if len(held) < wanted:  # blocks without a shingle count as well
            bare = np.setdiff1d(np.arange(m, dtype=_U), held)
            held, parity = np.concatenate((held, bare)), np.concatenate((parity, np.zeros(len(bare), _U)))
        key = (tc.pair(held + _U(band << 40), parity) & ~_U(3)) | _U(2 * (bs.matches(band) == 1))
        if len(key) > wanted:
            key = key[np.lexsort((key, -np.bitwise_count(parity).astype(np.int8)))[:wanted]]
        out.append(key)
    return np.concatenate(out)


def _linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return t.denominator * both >= t.numerator * (len(a) + len(b) - both)


def _key(s: np.ndarray) -> bytes:
    """A set's name: 128 bits."""
    return blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """The 64 bits by which candidates are told apart; sets that share them are compared one by one."""
    return int.from_bytes(key[:8], "little", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """A parity bit or two for each member; two sets' sketches, folded to one size, differ in no more bits than the sets differ in members."""
    bits = 1 << min(max(int(len(s) - 1).bit_length(), 7), 16)
    out = np.zeros(bits >> 6, _U)
    at = s & _U(bits - 1)
    np.bitwise_xor.at(out, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, in fewer words."""
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _pairs(tile: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile (rows are sorted by it), of different sides if any row has one; about PAIRS_AT_ONCE at a time."""
    cut = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
    left, right, n = [], [], 0
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        two = bool((side[a:z] >= 0).any())
        for k in range(a, z - 1):
            other = np.arange(k + 1, z)
            if two:
                other = other[side[k + 1 : z] != side[k]]
            left.append(np.full(len(other), k))
            right.append(other)
            n += len(other)
            if n > PAIRS_AT_ONCE:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _near(tile: np.ndarray, group: np.ndarray, ids: np.ndarray, comp: np.ndarray, sketches: list[bytes], size: np.ndarray, side: np.ndarray, bs: Bands, most: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Pairs of different components within a tile that sizes and sketches do not rule out, and the groups of which pairs were left out: those both of whose components already had `most`."""
    order = np.lexsort((group, tile))
    tile, group, ids, comp, size, side = (x[order] for x in (tile, group, ids, comp, size, side))
    tile = np.cumsum(np.concatenate(([0], (tile[1:] != tile[:-1]) | (group[1:] != group[:-1]))))
    words = np.array([len(sketches[i]) // 8 for i in order.tolist()])
    folded = {w: np.zeros((len(words), w), _U) for w in np.unique(words).tolist()}
    for n in folded:
        rows = np.flatnonzero(words == n)
        mine = np.frombuffer(b"".join(sketches[i] for i in order[rows].tolist()), _U).reshape(-1, n)
        for w in folded:
            if w <= n:
                folded[w][rows] = _fold(mine, w)
    num, den = bs.t.numerator, bs.t.denominator
    found: dict[tuple[int, int], None] = {}
    taken: dict[int, int] = {}
    over: set[int] = set()
    for x, y in _pairs(tile, side):
        ok = (comp[x] != comp[y]) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        limit = (size[x] + size[y]) * (den - num) // (den + num)
        least = np.minimum(words[x], words[y])
        near = np.zeros(len(x), bool)
        for w in np.unique(least).tolist():
            at = np.flatnonzero(least == w)
            p, q = folded[w][x[at]], folded[w][y[at]]
            near[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= limit[at]
        x, y = x[near], y[near]
        a, b = np.minimum(ids[x], ids[y]).tolist(), np.maximum(ids[x], ids[y]).tolist()
        for p, c, d, g in zip(zip(a, b, strict=True), comp[x].tolist(), comp[y].tolist(), group[x].tolist(), strict=True):
            if p not in found:
                if taken.get(c, 0) < most or taken.get(d, 0) < most:
                    found[p] = None
                    taken[c], taken[d] = taken.get(c, 0) + 1, taken.get(d, 0) + 1
                else:
                    over.add(g)
    return list(found), over


def jaccard_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id) with one row per input row.

    Words are runs of anything but ASCII white space, A-Z taken as a-z; a text of fewer words than a shingle is one
    shingle. Two documents link when their sets' Jaccard similarity is at least num/den, exactly. component_id is the
    smallest doc_id reachable by links, the document's own included.

    Null and empty texts and texts of white space have an empty set and link with nothing. Repeated rows and equal
    texts share one set. Rows of null doc_id keep a null component unless a link gives them one, and links may run
    through them. A text of any length is one row's work. Other columns are ignored, whatever their names. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    num, den = threshold
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark)
    try:
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, num, den, parts, scratch)
    finally:
        scratch.close("each", "component")


def _components(doc: DataFrame, words: int, num: int, den: int, parts: int, scratch: Scratch) -> DataFrame:
    def names(batches):
        tc.forget()
        for b in batches:
            n, keys = [], []
            for s in shingle_sets(b["text"], words):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "key"])

    each = scratch.write(doc.mapInArrow(names, "doc_id long, n_shingles long, key binary"), "each")

    def distinct(batches):
        tc.forget()
        seen: set[bytes] = set()  # 16 bytes for each text of a partition
        for b in batches:
            rows = {c: [] for c in ("id", "key", "size", "sketch", "row")}
            for r, s in enumerate(shingle_sets(b["text"], words)):
                if len(s) and (key := _key(s)) not in seen:
                    seen.add(key)
                    for c, x in zip(rows, (_short(key), key, len(s), sketch(s).tobytes(), r), strict=True):
                        rows[c].append(x)
            text = b["text"].take(pa.array(rows.pop("row"), pa.int64()))
            kinds = {"id": pa.int64(), "key": pa.binary(), "size": pa.int64(), "sketch": pa.binary()}
            yield pa.RecordBatch.from_arrays([*(pa.array(v, kinds[c]) for c, v in rows.items()), text], [*rows, "text"])

    # Each distinct set once, with a text that has it, in buckets: all later joins find it there without a shuffle.
    dealt = doc.where("text is not null").mapInArrow(distinct, "id long, key binary, size long, sketch binary, text string").repartition(parts, "id")
    once = dealt.groupBy("id", "key").agg(*(F.first(c).alias(c) for c in ("size", "sketch", "text")))
    sets = scratch.write_buckets(once, "sets", "id", parts)

    n_keys = (sets.agg(F.sum("size")).first()[0] or 0) * 3 * (den - num) // (den + num)
    deals = int(max(parts, n_keys * 12 // DEAL + 1))
    keyed = sets.select("id", "text").mapInArrow(_keys(words, num, den, deals), "deal long, lists boolean, sig binary, ids binary")
    met = scratch.write(keyed.groupBy("deal").applyInArrow(_meet(deals), "g long, ids binary, share long, pairs binary, n binary"), "met")
    groups = met.where("ids is not null").select("g", "ids")
    counted = met.where("pairs is not null").select("share", "pairs", "n").groupBy("share").applyInArrow(_counted, "a long, b long, n long")
    pairs = scratch.write(counted, "pairs")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs (a, b) of ids: whether the sets are linked, and their keys."""
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("text").alias("ta")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("text").alias("tb")), "b")
        return scratch.write(both.mapInArrow(_verify(words, num, den), "a long, b long, ka binary, kb binary, ok boolean"), name)

    # Nodes of the graph of links are sets, named by their smallest doc_id (null: last) and then their key: a component's least node has its id.
    owner = each.where("key is not null").groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("d")).select("key", F.struct("d", "key").alias("node"))

    def grown(comp: DataFrame | None, tried: DataFrame, k: int) -> DataFrame:
        """The components (id, component) that new links give, on top of those so far."""
        ends = tried.where("ok").select("ka", "kb")
        named = ends.join(owner.select(F.col("key").alias("ka"), F.col("node").alias("a")), "ka").join(owner.select(F.col("key").alias("kb"), F.col("node").alias("b")), "kb").select("a", "b")
        out = connected_components(named if comp is None else named.union(comp.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        return scratch.write(out.select("id", "component", F.col("id.key").alias("key")), f"components{k}")

    # First each set with the one set that it shares most keys with, of those before it in a tree of its groups: no set is asked for by more than FAN others of a group.
    stars = groups.mapInArrow(_stars, "a long, b long, n long").union(pairs).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    tried = verified(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")), "tried0")
    comp = grown(None, tried, 0)

    # Then the pairs across components.
    def apart(found: DataFrame) -> DataFrame:
        node = sets.select("id", "key", "size", "sketch").join(comp.select("key", F.col("component.key").alias("c")), "key", "left").withColumn("c", F.coalesce("c", "key"))
        of = lambda x: node.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("c", "size", "sketch")))
        both = found.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
        return both.select("a", "b", "sizea", "sizeb", "sketcha", "sketchb").mapInArrow(_let_through(num, den), "a long, b long")

    more = verified(apart(pairs.select("a", "b")).distinct(), "more")
    tried = tried.union(more)
    if more.where("ok").head(1):
        comp = grown(comp, more, 1)
        scratch.drop("components0")
    else:
        scratch.paths["components1"] = scratch.paths.pop("components0")
    scratch.drop("pairs")

    # And pairs across components in groups whose sets are still in several, in tiles of bounded size. While components
    # join, a few pairs are enough for two of them; groups of which pairs were left out come up again, with more pairs allowed.
    most, k, left = PAIRS, 2, None
    while True:
        node = sets.select("id", "key").join(comp.select("key", F.col("component.key").alias("c")), "key", "left").select("id", F.coalesce("c", "key").alias("c"))
        again = groups if left is None else groups.join(left, "g", "left_semi")  # whole lists: a row for up to LIST members
        labelled = again.mapInArrow(_members, "g long, id long").join(node, "id")
        labelled = scratch.write(labelled, f"labelled{k}")
        tiled = scratch.write(_tiles(labelled), f"tiled{k}")
        scratch.drop(f"labelled{k}", f"near{k - 1}")
        deals = int(max(parts, tiled.count() * 200 // DEAL + 1))
        drawn = tiled.join(sets.select("id", "size", "sketch"), "id").groupBy(F.pmod("tile", F.lit(deals)))
        near = scratch.write(drawn.applyInArrow(_bridge(num, den, most), "a long, b long, g long").distinct(), f"near{k}")
        scratch.drop(f"tiled{k}")
        new = verified(near.where("a is not null").select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), f"tried{k}")
        tried = tried.union(new)
        if new.where("ok").head(1):
            comp = grown(comp, new, k)
            scratch.drop(f"components{k - 1}")
        else:
            scratch.paths[f"components{k}"] = scratch.paths.pop(f"components{k - 1}")
        left = near.where("a is null").select("g")
        if not left.head(1):
            break
        most, k = most * 16, k + 1
    # Sets without a link to another one are components of their own; their documents, if several, are one component as well.
    linked = comp.select("key", F.col("component.d").alias("c"))
    of_set = scratch.write(owner.join(linked, "key", "left").select("key", F.coalesce("c", "node.d").alias("d")), "component")
    found = each.join(of_set, "key", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("d") < (1 << 63) - 1, F.col("d")).otherwise(F.col("doc_id")).alias("component_id"))


def _keys(words: int, num: int, den: int, deals: int):
    """Keys with the sets' ids, dealt out: 4 bytes of the key and 8 of the id each; sets of a batch that share a key and are many as lists."""

    def work(batches):
        for b in batches:
            ids = b["id"].to_numpy(zero_copy_only=False)
            made = [signatures(s, bands(num, den)) for s in shingle_sets(b["text"], words)]
            size = np.array([len(x) for x in made], np.int64)
            if not size.sum():
                continue
            sig, own = np.concatenate(made), np.repeat(ids, size)
            del made
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            deal, short = (sig >> _U(33)) % _U(deals), sig.astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            many = np.diff(np.append(first, len(sig)))
            rows = []
            for at, n in zip(first[many >= HOT].tolist(), many[many >= HOT].tolist(), strict=True):
                g = tc.pair(deal[at : at + 1], short[at : at + 1].astype(_U))
                for x in range(0, n, LIST):
                    rows.append((int(own[at + x] % deals), True, g.tobytes(), own[at + x : at + min(n, x + LIST)].tobytes()))
            kept = np.ones(len(sig), bool)
            kept[np.repeat(many >= HOT, many)] = False
            kept[first] = True
            short[first[many >= HOT]] |= np.uint32(1)  # the first of a list of its own
            deal, short, own = deal[kept].astype(np.int64), short[kept], own[kept]
            order = np.argsort(deal, kind="stable")
            held, first = np.unique(deal[order], return_index=True)
            short, own, cut = short[order], own[order], np.append(first, len(order)).tolist()
            rows += [(d, False, short[a:z].tobytes(), own[a:z].tobytes()) for d, a, z in zip(held.tolist(), cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["deal", "lists", "sig", "ids"])

    return work


def _meet(deals: int):
    """Of a deal: ids that share a key, as pairs dealt out anew if they are few, and else as lists; lists of one group have its number g in common."""

    def work(t: pa.Table) -> pa.Table:
        tc.forget()  # also what the deal before has needed
        flat, sig, own = t["lists"].to_pylist(), t["sig"].to_pylist(), t["ids"].to_pylist()
        g = [int.from_bytes(s, "little", signed=True) for many, s in zip(flat, sig, strict=True) if many]
        ids = [x for many, x in zip(flat, own, strict=True) if many]
        short = np.frombuffer(b"".join(s for many, s in zip(flat, sig, strict=True) if not many), np.uint32)
        own = np.frombuffer(b"".join(x for many, x in zip(flat, own, strict=True) if not many), np.int64)
        order = np.lexsort((own, short & ~np.uint32(1)))
        short, own = short[order], own[order]
        led, key = short & np.uint32(1), short & ~np.uint32(1)
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        led, key, own = led[keep], key[keep], own[keep]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        leads = np.maximum.reduceat(led, first) > 0 if len(key) else np.zeros(0, bool)
        several = (size > 1) & ((size > SMALL) | leads)
        deal = np.full(1, t["deal"][0].as_py(), _U)
        for at, n in zip(first[several].tolist(), size[several].tolist(), strict=True):
            name = int(tc.pair(deal, key[at : at + 1].astype(_U)).view(np.int64)[0])
            for x in range(at, at + n, LIST):
                g.append(name)
                ids.append(own[x : min(at + n, x + LIST)].tobytes())
        a, b, once = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for n in range(2, SMALL + 1):
            some = first[(size == n) & ~leads]
            for x in range(n - 1):
                for y in range(x + 1, n):
                    a.append(own[some + x])
                    b.append(own[some + y])
                    once.append((key[some] & np.uint32(2)) > 0)
        a, b, once = map(np.concatenate, (a, b, once))
        order = np.lexsort((b, a))
        a, b, weight = a[order], b[order], np.where(once[order], MATCHES, 1)
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        a, b, n = a[first], b[first], np.minimum(np.add.reduceat(weight, first), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
        share = tc.mix(a.view(_U)) % _U(deals)
        order = np.argsort(share, kind="stable")
        held, first = np.unique(share[order], return_index=True)
        cut = np.append(first, len(order)).tolist()
        pieces = [order[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        no, more = [None] * len(pieces), [None] * len(g)
        return pa.table({
            "g": pa.array(g + no, pa.int64()), "ids": pa.array(ids + no, pa.binary()), "share": pa.array(more + held.astype(np.int64).tolist(), pa.int64()),
            "pairs": pa.array(more + [np.stack((a[p], b[p])).tobytes() for p in pieces], pa.binary()), "n": pa.array(more + [n[p].tobytes() for p in pieces], pa.binary()),
        })

    return work


def _counted(t: pa.Table) -> pa.Table:
    """Pairs that meet in keys enough: MATCHES times, or once in a band where that is enough, as such a match counts as so many."""
    blobs = [np.frombuffer(x, np.int64).reshape(2, -1) for x in t["pairs"].to_pylist()]
    a, b = (np.concatenate([x[k] for x in blobs]) for k in (0, 1))
    n = np.frombuffer(b"".join(t["n"].to_pylist()), np.uint8).astype(np.int64)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    n = np.add.reduceat(n, first)
    enough = n >= MATCHES
    return pa.table({"a": a[first][enough], "b": b[first][enough], "n": n[enough]})


def _let_through(num: int, den: int):
    """Pairs that neither sizes nor sketches rule out."""

    def work(batches):
        for b in batches:
            x, y = b["sizea"].to_numpy(zero_copy_only=False), b["sizeb"].to_numpy(zero_copy_only=False)
            ok = den * np.minimum(x, y) >= num * np.maximum(x, y)
            limit = (x + y) * (den - num) // (den + num)
            for k, (p, q) in enumerate(zip(b["sketcha"].to_pylist(), b["sketchb"].to_pylist(), strict=True)):
                if ok[k]:
                    p, q = np.frombuffer(p, _U)[None], np.frombuffer(q, _U)[None]
                    size = min(p.shape[1], q.shape[1])
                    ok[k] = np.bitwise_count(_fold(p, size) ^ _fold(q, size)).sum(dtype=np.int64) <= limit[k]
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], ["a", "b"])

    return work


def _stars(batches):
    """Each list as a tree: every id but the first with one before it, which FAN ids share."""
    for b in batches:
        a, z = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for blob in b["ids"].to_pylist():
            x = np.frombuffer(blob, np.int64)
            a.append(x[np.arange(len(x) - 1) // FAN])
            z.append(x[1:])
        pairs, n = np.unique(np.stack((np.concatenate(a), np.concatenate(z)), 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def _members(batches):
    for b in batches:
        blobs = b["ids"].to_pylist()
        size = np.array([len(x) // 8 for x in blobs], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["g"].to_numpy(zero_copy_only=False), size)), pa.array(np.frombuffer(b"".join(blobs), np.int64))], ["g", "id"])


def _tiles(labelled: DataFrame) -> DataFrame:
    """Members (g, id, c) of groups that hold several components, dealt into tiles that cover all pairs across components.

    The sets of a group's largest component need not be compared with one another: they are dealt into tiles with the
    group's other sets, which are also dealt into tiles among themselves. So a large group that lacks a few sets makes
    about as many rows as it has sets.
    """
    of_comp = labelled.groupBy("g", "c").agg(F.count("*").alias("n"))
    of_group = of_comp.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("big"), F.max_by("c", F.struct("n", "c")).alias("main")).where("n > big")
    cut = of_group.select("g", "n", "main", F.ceil(F.col("big") / TILE).cast("int").alias("p"), F.ceil((F.col("n") - F.col("big")) / TILE).cast("int").alias("q"), (F.col("n") <= TILE).alias("small"))
    in_ = join_sized(labelled, cut, "g", labelled.count()).withColumn("mine", F.col("c") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("mine"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    across = lambda p, q: F.struct(F.xxhash64("g", F.lit(1), p, q).alias("tile"), F.col("mine").cast("int").alias("side"))
    among = lambda j: F.struct(F.xxhash64("g", F.lit(2), F.least("own", j), F.greatest("own", j)).alias("tile"), F.when(F.col("own") == j, F.lit(-1)).otherwise(F.col("own") + 2).alias("side"))
    other = F.concat(F.transform(upto(F.col("p")), lambda i: across(i, F.col("own"))), F.transform(upto(F.col("q")), among))
    spots = F.when(F.col("small"), F.array(F.struct(F.xxhash64("g").alias("tile"), F.lit(-1).alias("side")))).when(F.col("mine"), F.transform(upto(F.col("q")), lambda j: across(F.col("own"), j))).otherwise(other)
    return in_.select("g", "id", "c", F.explode(spots).alias("at")).select("g", "id", "c", "at.tile", "at.side")


def _bridge(num: int, den: int, most: int):
    def near(t: pa.Table) -> pa.Table:
        comp: dict[bytes, int] = {}
        c = np.array([comp.setdefault(x, len(comp)) for x in t["c"].to_pylist()])
        found, over = _near(*(t[x].to_numpy() for x in ("tile", "g", "id")), c, t["sketch"].to_pylist(), *(t[x].to_numpy() for x in ("size", "side")), bands(num, den), most)
        none = [None] * len(over)
        return pa.table({"a": pa.array([a for a, _ in found] + none, pa.int64()), "b": pa.array([b for _, b in found] + none, pa.int64()), "g": pa.array([None] * len(found) + sorted(over), pa.int64())})

    return near


def _verify(words: int, num: int, den: int):
    def work(batches):
        t = bands(num, den).t
        for b in batches:
            left = shingle_sets(b["ta"], words)
            right = shingle_sets(b["tb"], words)
            ok = [_linked(x, y, t) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], b["ka"], b["kb"], pa.array(ok, pa.bool_())], ["a", "b", "ka", "kb", "ok"])

    return work
