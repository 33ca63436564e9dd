"""Hard negatives, source divergence and personal data against brute force, on odd rows, ties, long texts and hot groups."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainsieve.llm import divergence, hard_negatives, pii

# ---- hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by scoring every pair."""
    own = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(Counter(len(v) for *_, v in own).items(), key=lambda x: (x[1], x[0]))[0]
    own = [x for x in own if len(x[2]) == dims]
    out = []
    for i, l, v in {(i, l, tuple(v)) for i, l, v in own if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in own if j != i)
        for s, j in [(-s, j) for s, j, m in scored if m == l][:positives]:
            near = [(-t, k) for t, k, m in scored if m != l and 50 * s <= -100 * t <= 95 * s][:negatives]
            out += [(i, j, r + 1, k, s, t) for r, (t, k) in enumerate(near)]
    return sorted(out)


def mined(df, **more):
    got = hard_negatives.mine(hard_negatives.prepared(df), F.col("vec_id") % 5 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


VECTORS = "vec_id long, label int, embedding array<float>, score string, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(11)
    v = lambda n=6: [rng.choice((0.25, -0.5, 0.125, round(rng.uniform(-1, 1) * 4096) / 4096)) for _ in range(n)]
    same = v()
    rows = [(k, rng.randrange(3), v()) for k in range(60)] + [(100 + k, k % 2, same) for k in range(40)]  # many ties
    rows += [(5, 1, rows[5][2]), (7, rows[7][1], rows[7][2]), (-3, 0, same), (-5, 1, v()), (200, 1, [0.0] * 6)]
    return rows + [(None, 1, v()), (300, None, v()), (305, 1, None), (310, 1, []), (315, 1, v(5)), (320, 1, [1.0, None, *[0.0] * 4]), (325, 1, [math.nan, *[0.0] * 5]), (330, 1, [math.inf, *[0.0] * 5])]


def test_hard_negatives_equal_brute_force(spark, odd_vectors, monkeypatch):
    want = plain_negatives(odd_vectors, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert mined(vectors(spark, odd_vectors)) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 600)  # many blocks of anchors
    assert mined(vectors(spark, odd_vectors)) == want


def test_hard_negatives_of_nothing(spark, odd_vectors):
    df = vectors(spark, odd_vectors)
    assert mined(df.where("vec_id is not null and vec_id is null")) == []
    assert mined(df.where("vec_id % 5 <> 0")) == []  # no anchor
    assert mined(df.where("label = 1")) == []  # no other label
    assert mined(df.where("size(embedding) = 0")) == []
    with pytest.raises(ValueError, match="smaller scale"):
        mined(spark.createDataFrame([(5, 1, [1e30, 1.0]), (6, 1, [-1e30, 1.0])], "vec_id long, label int, embedding array<double>"))


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(1)
    for scale in (3, 100, 5000, 1 << 28):
        v = rng.integers(-scale, scale, (500, 16))
        c = hard_negatives.Cells.of(v.min(0), v.max(0))
        table, slack = c.table(v[3])
        low, score = hard_negatives.least_scores(table, c.approximate(v)), v @ v[3]
        assert (low <= score).all() and (score <= low + slack).all()
        assert scale > 100 or (low == score).all()  # a cell for every value


# ---- source divergence


def plain_audit(rows, least=3, most=200):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, *_ in rows]
    in_docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, l, s), ws in zip(rows, words, strict=True):
        groups[l].add(s)
        in_docs[l].update(set(ws))
        n[l, s].update(ws)
    out = []
    for l, sources in groups.items():
        kept = [w for w, k in in_docs[l].items() if k >= least]
        total = {s: sum(n[l, s][w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (n[l, s][w] + 1) // (total[s] + len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(n[l, s][w] for s in sources) + 1) // (sum(total.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s, w], p[o, w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s, w], q[w]), w.encode()) for w in kept if n[l, s][w] and p[s, w] > q[w])[:most]
            out += [(l, s, part, i.decode(), -v, r + 1) for part, xs in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(xs)]
    return sorted(out)


TEXTS = "text string, lang string, source string, term string, n int, `a.b` int"


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(12)
    words = ["Tee", "tee", "WASSER", "äpfel", "Äpfel", "日本", "x", "É", *(f"w{chr(97 + k)}" for k in range(26))]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(("", ".", "1", "-")) for _ in range(n))
    rows = [(prose(rng.randrange(40)), rng.choice(("en", "de")), rng.choice(("a", "b", "ü", "c.d"))) for _ in range(90)]
    rows += [(None, "en", "none"), ("", "en", "empty"), ("123 !", "xx", "a"), ("one two", "xx", "b"), (None, None, None), ("tee tee", None, "a"), ("tee", "", None), ("Tee", "", "z"), *[("same text", "en", "a")] * 5]
    return rows + [(prose(30_000), "de", "long")]


def audited(spark, rows, **more):
    got = divergence.audit(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TEXTS).repartition(4), **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_audit_equals_brute_force(spark, odd_texts, monkeypatch):
    assert audited(spark, odd_texts) == plain_audit(odd_texts)
    assert audited(spark, odd_texts, most=3, least=1) == plain_audit(odd_texts, least=1, most=3)
    monkeypatch.setattr(divergence, "BROADCAST", 0)  # salted keys instead
    monkeypatch.setattr(divergence, "HELD", 3)  # counts passed on many times
    monkeypatch.setattr(divergence, "PIECE", 200)
    assert audited(spark, odd_texts) == plain_audit(odd_texts)
    assert audited(spark, []) == []


def test_shares_are_exact_beyond_longs(spark):
    for n, total in ((0, 1), (8_999_999_999, 9_000_000_007), (9_000_000_000, 9_000_000_007), (5 * 10**17, 6 * 10**17 + 1)):
        assert spark.range(1).select(F.expr(divergence.share(f"{n}L", f"{total}L"))).first()[0] == 1 + 10**9 * (n + 1) // total


# ---- personal data

_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def plain_personal(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(_PLAIN.values()) for m in re.finditer(pattern, text) if good(m[0]))


def test_patterns_equal_the_plain_ones():
    rng = random.Random(13)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+49 30 123456", "+1 (234) 555-0199", "+", "-", " ", "é", "0", "17", "x_y%", "..", "007.08.9.10", "\n", "(", "@d-e.f", "12345678901234567890"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_personal(text), text
    for text in ("1" * 300_000, "a" * 300_000, "+1" + " " * 300_000, "1." * 150_000, "a." * 100_000 + "@"):
        pii.base_spans(text)  # in proportion to the text, or this would not end


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(0)
    net = pii.Network.new(4, rng, np.float64)
    ids = rng.integers(0, pii.ALPHABET, (3, 7)).astype(np.uint8)
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [5, 6, 6, 0, 7, 8, 0], [2, 2, 0, 0, 1, 1, 2]], np.uint8)
    _, slopes = net.slopes(ids, tags)
    for name, w in net.weights.items():
        for k in rng.choice(w.size, 12):
            at = np.unravel_index(k, w.shape)
            if name != "moves" or pii.ALLOWED[at]:
                old = w[at]
                w[at] = old + 1e-5
                up = net.slopes(ids, tags)[0]
                w[at] = old - 1e-5
                down = net.slopes(ids, tags)[0]
                w[at] = old
                assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-6, (name, at)


def test_marginals_and_paths_equal_enumeration():
    rng = np.random.default_rng(2)
    e, moves = rng.normal(size=(3, 1, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    total, want = 0.0, np.zeros((3, pii.TAGS))
    for y in np.ndindex(*[pii.TAGS] * 3):
        if pii.ALLOWED[y[0], y[1]] and pii.ALLOWED[y[1], y[2]]:
            x = math.exp(sum(e[t, 0, y[t]] for t in range(3)) + moves[y[0], y[1]] + moves[y[1], y[2]])
            total += x
            for t in range(3):
                want[t, y[t]] += x
    p, _, z = pii.marginals(e, moves)
    assert np.allclose(p[:, 0], want / total) and math.isclose(z[0], math.log(total))
    probabilities = [rng.dirichlet(np.ones(pii.TAGS), n) for n in (1, 3, 4, 3)]
    for p, got in zip(probabilities, pii.paths(probabilities), strict=True):
        ok = [y for y in np.ndindex(*[pii.TAGS] * len(p)) if (y[0] % 2 or not y[0]) and all(pii.ALLOWED[a, b] for a, b in zip(y, y[1:], strict=False))]
        assert tuple(got) == max(ok, key=lambda y: sum(math.log(p[t, y[t]]) for t in range(len(p))))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    rng = random.Random(14)
    return pii.fit([prose(rng, 60) + rng.choice((" jo.doe7@mail.org ", " 10.20.30.40 ", " +49 30 1234567 ", " 4111 1111 1111 1111 ", " ")) + prose(rng, 60) for _ in range(400)])


def recall(network, forms, n=40):
    rng = random.Random(15)
    words, hits = prose(rng, 200).split(), []
    for kind, fs in forms.items():
        for f in fs:
            for _ in range(n):
                item = pii.written(f, kind, words, rng)
                text = f"{prose(rng, 12)} {item} {prose(rng, 12)}"
                at = text.index(item)
                hits.append(any(k >= 4 and a < at + len(item) and at < z for a, k, z in pii.found([text], network)[0]))
    return sum(hits) / len(hits)


def test_the_network_finds_what_patterns_miss(network):
    """Forms that it has learned, and whole forms that it has never seen; ordinary numbers stay."""
    assert recall(network, pii.FORMS) > 0.85
    unseen = {"email": ("{u} (at) {h} (dot) {t}", "{u}@{h}(dot){t}"), "ip": ("{x4}:{x4}::{x4}", "{n} .{n} .{n} .{n}"), "card": ("0000 / 0000 / 0000 / 0000", "000000.000000.0000"), "phone": ("000/000/0000", "(000)000.0000", "00 00 00 00 00", "+00 (0) 00/000000")}
    assert recall(network, unseen) > 0.5
    rng = random.Random(16)
    texts = [f"{prose(rng, 10)} {pii.written(f, None, ['kite', 'tree'], rng)} {prose(rng, 10)}" for f in pii.ORDINARY for _ in range(10)]
    assert sum(any(k >= 4 for _, k, _ in x) for x in pii.found(texts, network)) < 0.04 * len(texts)


def test_windows_are_reconciled(network):
    """A text's spans do not change with what stands far before them or with what is looked at together with it, and long stretches are settled whole."""
    rng = random.Random(17)
    part = f"{prose(rng, 10)} write to anna (at) kite-house.org please {prose(rng, 10)}"
    alone = [(a, k, z) for a, k, z in pii.found([part], network)[0] if k >= 4]
    assert alone
    lead = prose(rng, 300) + " "
    both = pii.found([prose(rng, 20) + " 12 ", lead + part, part], network)
    assert [(a - len(lead), k, z - len(lead)) for a, k, z in both[1] if k >= 4] == alone == [x for x in both[2] if x[1] >= 4]
    digits = " ".join(str(rng.randrange(10**4)) for _ in range(20_000))
    spans = pii.found([digits], network)[0]
    assert all(0 <= a < z <= len(digits) for a, _, z in spans)


def test_scan_and_mask_of_odd_rows(spark, network):
    rows = [(1, "mail jo@ex.org now", "x"), (1, "mail jo@ex.org now", "x"), (2, None, "x"), (3, "", "x"), (None, "+49 30 1234567, ü 10.0.0.1", "x"), (4, prose(random.Random(1), 200_000) + " jo@ex.org", "y"), (5, "12", None)]
    docs = spark.createDataFrame([(i, t, len(t or ""), s, 1) for i, t, s in rows], "doc_id long, text string, n_chars long, personal string, `a.b` int").repartition(2)
    got = pii.report(pii.scan(docs, None)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans if len(r.spans) < 60 else "") for r in got)[:3] == [(0, 0, 1, 0, 1, "phone:0:14,ip:18:26"), (1, 1, 0, 0, 0, "email:5:14"), (1, 1, 0, 0, 0, "email:5:14")]
    assert Counter(r.doc_id for r in got) == {None: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    hidden = pii.mask(docs, None)
    assert hidden.columns == docs.columns
    texts = {(r.doc_id, r.n_chars): r.text for r in hidden.collect()}
    assert texts[1, 19] == "mail <PERSONAL> now" and (2, None) in texts and texts[3, 0] == "" and [t for (i, _), t in texts.items() if i == 4][0].endswith(" <PERSONAL>")
    assert not any("jo@ex.org" in (r.text or "") for r in pii.mask(docs, network).collect())
    assert pii.scan(docs.where("doc_id > 99"), network).count() == 0
    assert pii.sample_texts(docs.where("doc_id > 99")) == []


# ---- repeated passages longer than a byte counts


def test_repeated_strings_of_three_hundred_bytes(spark):
    from grainsieve.llm import suffix_dedup

    rng = random.Random(18)
    shared = [prose(rng, 120), prose(rng, 70)]
    rows = [(1, prose(rng, 30) + shared[0]), (2, shared[0] + prose(rng, 30) + shared[1]), (3, shared[1] + " x " + shared[0][:299]), (4, shared[0][:300])]
    got = {r.doc_id: r for r in suffix_dedup.report(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), length=300)).collect()}
    seen: set[bytes] = set()
    for doc, text in rows:
        b, gone = text.encode(), set()
        for k in range(len(b) - 299):
            if b[k : k + 300] in seen:
                gone.update(range(k, k + 300))
            seen.add(b[k : k + 300])
        assert got[doc].n_removed == len(gone), doc
    assert got[2].n_removed > 300 and got[4].n_removed == 300


def test_the_sample_of_a_long_text_is_around_its_first_match(spark):
    from grainsieve.llm import secret_scan

    long_ = "a " * 30_000 + "f" * 30 + " b" * 30_000 + " password=abcdef99 " + "c " * 10_000
    sample = secret_scan.sample_texts(spark.createDataFrame([(1, long_), (2, "d " * 40_000)], "doc_id long, text string"), longest=2000)
    assert sorted(("f" * 30 in t, "password" in t, len(t)) for t in sample) == [(False, False, 2000), (True, False, 2000)]


def test_network_reads_every_position():
    """Texts without a digit or sign too: each place of each text is decoded, in one window or two."""
    class Everywhere:
        def __init__(self):
            self.seen = np.zeros(len(pii._CODES) + 1, np.int64)

        def tags(self, ids):
            np.add.at(self.seen, ids.ravel(), 1)
            p = np.full((*ids.shape, pii.TAGS), 1e-6, np.float32)
            letter = pii.code("q")
            p[:, :, 0] = ids != letter
            p[:, 1:, 2] = (ids[:, 1:] == letter) & (ids[:, :-1] == letter)
            p[:, :, 1] = (ids == letter) & (p[:, :, 2] < 0.5)
            return p / p.sum(2, keepdims=True)

    net = Everywhere()
    for n in (1, 31, 32, 33, 255, 256, 257, 1000):
        parts = [np.full(n, pii.code("a"), np.uint8), np.full(n // 2 + 1, pii.code("b"), np.uint8)]
        net.seen[:] = 0
        got = pii.reconciled(parts, net)
        assert [len(p) for p in got] == [n, n // 2 + 1] and all(np.allclose(p.sum(1), 1, atol=1e-5) for p in got)
        assert net.seen[pii.code("a")] >= n and net.seen[pii.code("b")] >= n // 2 + 1


def test_address_far_from_digits_is_looked_at(monkeypatch):
    monkeypatch.setattr(pii, "plausible", lambda kind, s: True)

    class Letters:
        def tags(self, ids):
            p = np.full((*ids.shape, pii.TAGS), 1e-6, np.float32)
            hit = ids == pii.code("q")
            before = np.concatenate((np.zeros((len(ids), 1), bool), hit[:, :-1]), 1)
            p[:, :, 0], p[:, :, 1], p[:, :, 2] = ~hit, hit & ~before, hit & before
            return (p + 1e-6) / (p + 1e-6).sum(2, keepdims=True)

    for lead in (0, 40, 700):
        text = "word " * lead + "qqqq" + " word" * lead
        assert pii.found([text], Letters())[0] == [(5 * lead, 4, 5 * lead + 4)]


def test_stretches_lose_no_span():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40, 300):
        for sharp in (0.05, 0.3, 1.0):
            p = rng.dirichlet(np.ones(pii.TAGS) * sharp + np.eye(pii.TAGS)[0] * 3 * sharp, n).astype(np.float32)
            want, got = pii.paths([p])[0], np.zeros(n, np.int64)
            cut = pii.stretches(p)
            for (a, z), tags in zip(cut, pii.paths([p[a:z] for a, z in cut]), strict=True):
                got[a:z] = tags
            assert got.tolist() == want.tolist()


def test_quick_decoding_equals_the_slow_one():
    rng = np.random.default_rng(9)
    net = pii.Network.new(5, rng, np.float64)
    ids = rng.integers(0, pii.ALPHABET, (7, 50)).astype(np.uint8)
    want = pii.marginals(net.emissions(ids)[0], net.weights["moves"])[0].transpose(1, 0, 2)
    assert np.allclose(net.tags(ids), want, atol=1e-9)


def test_sigmoid_is_read_off_bits():
    x = np.linspace(-160, 160, 400_001)
    z = (pii._ONE - x * pii._BIT / (2 * np.log(2))).astype(np.float32)
    pii._squash(z, np.empty(z.shape, np.int32), np.empty(z.shape, np.int32))
    assert np.abs(z - 1 / (1 + np.exp(-x))).max() < 0.0026


@pytest.mark.parametrize("times", [1, 40, 4000])
def test_quick_decoding_in_single_precision(times):
    """The quick sigmoid changes probabilities by little, and weights so large that its bits or an exponential would run over still give probabilities."""
    rng = np.random.default_rng(10)
    net = pii.Network.new(20, rng)
    for name, w in net.weights.items():
        if name != "moves":
            w *= times
    ids = rng.integers(0, pii.ALPHABET, (60, 256)).astype(np.uint8)
    got = net.tags(ids)
    assert np.isfinite(got).all() and np.allclose(got.sum(2), 1, atol=1e-4)
    if times == 1:
        slow = pii.Network({k: w.astype(np.float64) for k, w in net.weights.items()})
        want = pii.marginals(slow.emissions(ids)[0], slow.weights["moves"])[0].transpose(1, 0, 2)
        assert np.abs(got - want).max() < 0.01


def test_codes_of_all_letters():
    text = "".join(map(chr, [*range(0, 0xD800, 7), *range(0x10000, 0x110000, 997), 0xE9, 0x660, 0x2003]))
    assert pii.codes(text).tolist() == [pii.code(c) if c != "\0" else len(pii._CODES) for c in text]
