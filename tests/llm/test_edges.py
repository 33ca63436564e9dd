"""Odd inputs for all training-data operators and pipeline stages, the fields' gradients, and secrets that no pattern finds."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from grainsieve.llm import bpe, decontaminate, jaccard_join, langid, secret_scan, sharding, spotsigs, suffix_dedup, token_counts, toxicity

#: Columns named as what operators add, and one with a dot.
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, secrets int, spans string, items int, n_words int, score string, lang_pred int, `a.b` int, Spans2 int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", 2, 3, "own", 4, 5, 6) for i, t, lang in rows], CLASHES)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "ü", "\x00", *(prose(rng, 60) for _ in range(8)), *(prose(rng, 60, "äöüßklmnop") for _ in range(8))]
    rows = [(k, t, "en" if k % 2 else "de") for k, t in enumerate(texts)]
    rows += [(7, texts[7], "en"), (7, texts[7], None), (None, texts[8], None), (None, None, None), (-(9 * 10**18), texts[9], "en"), (9 * 10**18, texts[10] + " tail", "de"), (3, "another of the id", "en")]
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("1", prose(random.Random(77), 60)), (None, "x"), ("2", None), ("3", "")], "item_id string, text string")


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, odd, items, tmp_path, name):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = STAGES[name](spark, odd, str(tmp_path))
    if name != "bpe_encoding":
        assert got.columns == odd.columns
        rows = got.collect()
        want = {"language_id": odd.count() - 5, "ngram_jaccard_join": len(rows)}.get(name, odd.count())  # null, empty, white, control, and null again
        assert len(rows) == want and len(rows) > 10
        assert {(r["score"], r["a.b"], r["secrets"], r["spans"]) for r in rows} == {("own", 5, 1, "x")}
    else:
        assert got.count() == odd.count()
    none = STAGES[name](spark, odd.where("doc_id is null and doc_id is not null"), str(tmp_path))
    assert none.count() == 0 and none.columns == got.columns


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    base = prose(rng, 80)
    rows = [(5, base, "en"), (3, base, "en"), (3, base, "en"), (None, base, "en"), (9, base + " x", "en"), (11, prose(rng, 80), "en"), (12, None, "en"), (12, "", "en")]
    got = corpus_pipeline.keep_one_of_each_group(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(3, base), (3, base), (0, base), (11, rows[5][1]), (12, ""), (12, "")])


def test_operators_on_odd_rows(spark, odd, items):
    n = odd.count()
    assert bpe.round_trip(odd).count() == n
    assert secret_scan.report(secret_scan.scan(odd, None)).count() == n
    assert jaccard_join.jaccard_components(odd).count() == n
    assert token_counts.length_histogram(odd).agg({"n_docs": "sum"}).first()[0] == n
    assert langid.identify(odd, langid.learned(odd)).count() == n
    found = decontaminate.contamination(odd, items)
    assert found.count() == n and dict(found.dtypes)["n_words"] == "bigint"
    assert suffix_dedup.report(suffix_dedup.repeated_spans(odd)).count() == n
    assert sharding.sharded(odd, 3).count() == n
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.severity(odd, toxicity.fit(toxicity.sample_rows(odd, labels))).count() == n


def test_fingerprints_of_ids_far_apart(spark, odd):
    """Ids at both ends of the longs, crowded ones and null ones: each row's next is that of the plain order."""
    rng = random.Random(3)
    own = [(i, prose(rng, 12)) for i in [-(2**63), 2**63 - 1, *range(1000), *(10**15 + 7 * k for k in range(300))]] + [(None, prose(rng, 5)) for _ in range(900)]
    got = spotsigs.fingerprints(spark.createDataFrame(own, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(own) and spotsigs.fingerprints(odd).count() == odd.count()
    texts = dict(x for x in own if x[0] is not None)
    ids = sorted(texts)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, nxt in zip(ids, ids[1:], strict=False):
        half = len(texts[i]) // 2
        assert by[i].edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - half] + texts[nxt][:half]).encode()).hexdigest()
    assert sum(r.doc_id is None for r in got) == 900


def test_very_long_text(spark):
    """A text of five million characters beside short ones goes through each operator whole."""
    rng = random.Random(4)
    line = prose(rng, 2000)
    long_ = (line + " ") * (5_000_000 // len(line)) + "password=abcdef99 end"
    rows = [(1, long_), (2, long_ + " more"), (3, line), (4, prose(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, 3, (90, 100)).collect()}
    assert [got[k].component_id for k in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert {r.doc_id: r.n_assign for r in secret_scan.report(secret_scan.scan(docs, None)).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    cut = {r.doc_id: r for r in suffix_dedup.report(suffix_dedup.repeated_spans(docs)).collect()}
    assert cut[1].n_removed > 4_900_000 and cut[3].n_removed == len(line) and cut[4].n_removed == 0
    n = {r.doc_id: r.n_chars for r in spotsigs.fingerprints(docs).collect()}
    assert n[1] == len(long_)
    model = langid.fit([("en", line), ("de", prose(rng, 500, "äöüßklmnop"))])
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"en"}
    hits = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame([("q", " ".join(line.split()[:12]))], "item_id string, text string")).collect()}
    assert len(hits[1].spans) > 300 and hits[4].items == []
    sizes = {r.doc_id: r.size for r in sharding.sharded(docs, 2).collect()}
    assert sizes[1] == len(long_) + 1
    assert {r.doc_id: r.n_tokens > 1_000_000 for r in bpe.round_trip(docs).collect()} == {1: True, 2: True, 3: False, 4: False}


def likelihood(e, gold, starts, moves):
    """Log probability of one labelled sequence, by the plain recursion."""
    score, total = starts[gold[0]] + e[0, gold[0]], starts + e[0]
    for t in range(1, len(gold)):
        score += moves[gold[t - 1], gold[t]] + e[t, gold[t]]
        total = np.logaddexp.reduce(total[:, None] + moves, axis=0) + e[t]
    return score - np.logaddexp.reduce(total)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 3, 2, 150, 64, 65])
    e, moves = rng.normal(size=(int(lengths.sum()), 3)), rng.normal(size=(3, 3))
    gold = rng.integers(0, 3, len(e))
    cut = np.cumsum(lengths)[:-1]

    def whole(e, moves):
        return sum(likelihood(x, g, np.zeros(3), moves) for x, g in zip(np.split(e, cut), np.split(gold, cut), strict=True))

    de, dm = secret_scan.gradients(e, lengths, moves, gold)
    for x, d, of in [(moves, dm, lambda y: whole(e, y)), (e, de, lambda y: whole(y, moves))]:
        for at in [(0, 0), (1, 2), (2, 1), (2, 2)]:
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            assert abs((of(up) - of(down)) / 2e-5 - d[at]) < 1e-5


def test_secrets_beyond_the_patterns():
    """Learned from labels that are hexadecimal tokens behind a keyword only, the field finds kinds that no pattern does, and leaves ordinary odd tokens alone."""
    rng = random.Random(6)
    any_ = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(of) for _ in range(n))
    texts = [prose(rng, 20) + f' token = "{any_(40, "0123456789abcdef")}" ' + prose(rng, 20) for _ in range(60)] + [prose(rng, 30) + f" {rng.randint(1, 31)}.12.2024 a{k}@mail.org " + prose(rng, 10) for k in range(60)]
    model = secret_scan.fit(texts)
    kinds = {"bearer": lambda: f"Bearer {any_(26)}", "capitals": lambda: any_(32, "0123456789ABCDEF"), "access": lambda: "ASIA" + any_(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "prefix": lambda: "zk_" + any_(36), "quoted": lambda: f'"{any_(20)}"', "pwd": lambda: f"pwd => {any_(12)}"}
    right = wrong = asked = 0
    for k in range(300):
        made = list(kinds.values())[k % len(kinds)]()
        text = f"{prose(rng, 15)} {made} {prose(rng, 15)}"
        value = re.split(r"\s", made)[-1].strip('"')
        at = text.index(value)
        assert not secret_scan.base_spans(text)
        found = [x for x in secret_scan.find(text, model) if x[1] == 3]
        hit = [x for x in found if x[0] < at + len(value) and at < x[2]]
        asked, right, wrong = asked + 1, right + bool(hit), wrong + len(found) - len(hit)
    ordinary = ["https://site.org/page/item-1234?q=abc", "2024-11-28T10:22:33Z", "ISBN-978-3-16-148410-0", "v2.13.4-beta1", "+49-170-1234567", "COVID-19", "UTF-8", "192.168.100.200", "name.other92@mail.org", "C:\\Users\\file01.txt"]
    for k in range(300):
        wrong += bool(model.tag(f"{prose(rng, 15)} {ordinary[k % len(ordinary)]} {prose(rng, 15)}"))
    assert right / asked > 0.9 and right / (right + wrong) > 0.9, (right, asked, wrong)


def test_secrets_of_forms_never_learned():
    """Alphabets, prefixes, lengths, surroundings and ordinary tokens that learning never makes; README states the figures."""
    rng = random.Random(11)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_ = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = [prose(rng, 20) + f' token = "{any_(40, "0123456789abcdef")}" ' + prose(rng, 20) for _ in range(60)] + [prose(rng, 30) + f" {rng.randint(1, 31)}.12.2024 a{k}@mail.org " + prose(rng, 10) for k in range(60)]
    model = secret_scan.fit(texts)
    kinds = {
        "base32": lambda: f"seed {any_(26, low + '234567')}", "dashed": lambda: f"licence {'-'.join(any_(5, up + digits) for _ in range(5))}", "dotted": lambda: f"jwt {any_(18, low + up + digits)}.{any_(45, low + up + digits)}.{any_(28, low + up + digits)}",
        "forge": lambda: f"forge ghp_{any_(36, low + up + digits)}", "live": lambda: f"charge sk-live-{any_(28, low + digits)}", "signs": lambda: f"login {any_(5, low)}#{any_(4, up)}!{any_(5, digits + low)}", "angled": lambda: f"set <{any_(18, low + up + digits)}>", "padded": lambda: f"salt {any_(42, low + up + digits)}==",
    }
    found, added = dict.fromkeys(kinds, 0), 0
    for k in range(400):
        name = list(kinds)[k % len(kinds)]
        lead, made = kinds[name]().split(" ")
        text = f"{prose(rng, 15)} {lead} {made} {prose(rng, 15)}"
        assert not secret_scan.base_spans(text)
        at = text.index(made)
        found[name] += any(a < at + len(made) and at < z for a, z in model.tag(text))
    ordinary = ["SKU-48213-B", "1,234.56", "2001:db8:85a3::8a2e", "Q3/2021", "user_name42", "mailto:anna@mail.org", "#1f77b4", "3.14159265", "km/h", "12:30-14:45", "A4/B5", "x86_64", "foo(bar=1)", "IBM-360/91", "h2o+co2", "12.5%"]
    for k in range(400):
        added += bool(model.tag(f"{prose(rng, 15)} {ordinary[k % len(ordinary)]} {prose(rng, 15)}"))
    right = sum(found.values())
    assert right / 400 > 0.6 and right / (right + added) > 0.8, (found, added)
