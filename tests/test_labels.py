"""The label engine against its golden samples, stated edge cases and plain-Python restatements."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from grainsieve.functions import scalars as S
from grainsieve.functions import sql as E
from grainsieve.operators import allergens, layout, lookups, normalize, parse
from grainsieve.plans.verify import parsed, verify
from grainsieve.sources import labels, recognizer
from grainsieve.sources.kb import knowledge_base

KB = knowledge_base()


def column(spark, expression, **values):
    kinds = {str: "string", float: "double", int: "int"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return E.select(df, expression.alias("x")).first()[0]


@pytest.fixture(scope="module")
def golden(spark):
    return {r.label_id: r for r in verify(labels.samples(spark)).collect()}


def test_golden_verdicts(golden):
    assert {k: [v.label for v in r.claim_verdicts] for k, r in golden.items()} == {"s1": ["不一致"], "s2": ["不一致"], "s3": ["不一致"], "s4": ["一致"]}
    assert {k: [v.label for v in r.baseline_verdicts] for k, r in golden.items()} == {"s1": ["一致"], "s2": ["一致"], "s3": ["无法判定"], "s4": ["一致"]}


def test_golden_risk_and_confidence(golden):
    assert [(golden[k].risk.level, golden[k].risk.score) for k in ("s1", "s2", "s3", "s4")] == [("低", 0.0), ("低", 0.0), ("低", 0.3), ("低", 0.0)]
    assert [(f.nutrient, f.level, f.contribution) for f in golden["s1"].risk.factors] == [("钠", "低", 0.357), ("糖", "低", 0.357), ("脂肪", "低", 0.286)]
    assert [(f.nutrient, f.level, f.contribution) for f in golden["s3"].risk.factors] == [("糖", "中", 0.5), ("钠", "低", 0.5)]
    assert {r.confidence for r in golden.values()} == {0.75}


def test_golden_populations(golden):
    got = {k: [(p.level, p.score) for p in r.population_results] for k, r in golden.items()}
    assert got["s1"] == [("低", 0), ("高", 0), ("低", 0), ("中", 0), ("低", 0), ("低", 0), ("高", 0)]
    assert got["s2"] == [("低", 0), ("低", 0), ("低", 0), ("中", 0), ("低", 0), ("低", 0), ("低", 0)]
    assert got["s3"] == [("低", 0.3), ("高", 0.6), ("低", 0.3), ("中", 0.3), ("中", 0.6), ("中", 0.3), ("高", 0.6)]
    assert got["s4"] == [("低", 0), ("低", 0), ("低", 0), ("中", 0), ("中", 0), ("低", 0), ("低", 0)]
    assert [a.raw for a in golden["s3"].additives] == ["柠檬酸", "山梨酸钾", "食用香精"]
    assert not golden["s1"].allergen_alerts


def test_knowledge_base_is_consistent():
    assert KB.issues() == []
    assert (len(KB.additive_function), len(KB.claims), len(KB.match_words), len(KB.allergen_aliases()), len(KB.clauses)) == (119, 19, 95, 197, 14)


@pytest.mark.parametrize(("text", "want"), [
    ("糖 0g", ("糖", 0.0, "g", "100g")), ("维生素B1 0.5mg", ("维生素B1", 0.5, "mg", "100g")), ("纳 20mg", None), ("能量 180kJ/100mL", ("能量", 180.0, "kJ", "100mL")), ("碳水化合物 100g", None), ("", None),
])
def test_nutrition_segment(spark, text, want):
    got = column(spark, parse.nutrition_segment(E.col("t"), KB), t=text)
    assert (got and tuple(got)[:4]) == want


@pytest.mark.parametrize(("text", "want"), [
    ("风味发酵乳（水、脱脂乳粉、白砂糖）", [("风味发酵乳", 0), ("水", 1), ("脱脂乳粉", 1), ("白砂糖", 1)]), ("单，双甘油脂肪酸酯", [("单，双甘油脂肪酸酯", 0)]), ("食品添加剂（柠檬酸）", [("柠檬酸", 1)]), ("配料：水、、 白砂糖。", [("水", 0), ("白砂糖", 0)]), ("", []), ("水）、盐", [("水", 0), ("盐", 0)]),
])
def test_split_ingredients(spark, text, want):
    assert [tuple(x) for x in column(spark, parse.split_ingredients(E.col("t")), t=text)] == want


@pytest.mark.parametrize(("text", "want"), [("无添加剂", ["CLAIM_NO_ADDITIVE"]), ("0添加香精", ["CLAIM_NATURAL"]), ("无蔗糖添加", ["CLAIM_NO_SUGAR"]), ("口感好", []), ("0脂肪 0蔗糖 零脂肪", ["CLAIM_ZERO_FAT", "CLAIM_ZERO_SUCROSE"])])
def test_claims(spark, text, want):
    assert [c.pattern_id for c in column(spark, parse.claim_matches(E.col("t"), KB), t=text)] == want


def test_scalars(spark):
    assert column(spark, S.rounded(E.col("v"), 2), v=1.005) == 1.0
    assert column(spark, S.rounded(E.col("v"), 0), v=-2.5) == -2.0
    assert column(spark, S.number(E.col("t")), t="12abc") == 12.0
    assert column(spark, S.number(E.col("t")), t="x") is None
    assert column(spark, S.number_text(E.col("v")), v=5.0) == "5"
    assert column(spark, S.trim(E.col("t")), t="　a b ") == "a b"
    assert column(spark, S.region_basis(E.col("t")), t="每 1L") == "1000mL"
    assert column(spark, S.ean13(E.col("t")), t="6901234567892").valid
    assert column(spark, S.ean13(E.col("t")), t="6901234567893").expected == 2
    assert column(spark, S.convert(E.col("v"), E.lit("kcal"), E.lit("kJ")), v=1.0) == 4.184
    assert column(spark, S.convert(E.col("v"), E.lit("kcal"), E.lit("g")), v=1.0) is None


def alerts(spark, *names):
    rows = [(n, None) for n in names]
    df = spark.createDataFrame([(rows,)], "i array<struct<raw:string,standard:string>>")
    return {a.code: [(m.alias, m.level) for m in a.matched] for a in E.select(df, allergens.detect(E.col("i"), KB).alias("a")).first().a}


def test_allergen_guards(spark):
    assert alerts(spark, "蛋白质", "乳化剂", "副干酪乳杆菌") == {}
    assert list(alerts(spark, "鱿鱼")) == ["MOLLUSC"]
    assert list(alerts(spark, "田螺肉")) == ["MOLLUSC"]
    assert list(alerts(spark, "大豆蛋白粉")) == ["SOY"]
    assert alerts(spark, "花生油") == {"PEANUT": [("花生油", "exact")]}


def test_terms(spark):
    ask = ["副干酪乳杆菌", "龙舌兰糖浆", "复配酸度调节剂", "着色剂", "发酵副干酪饮料剂", "食用白砂糖", "单双甘油脂肪酸脂"]
    df = spark.createDataFrame([([(t, 0) for t in ask],)], "p array<struct<raw:string,level:int>>")
    got = {i.raw: (i.standard, i.confidence) for i in normalize.with_ingredients(df, "p", "i", KB).first().i}
    assert got["副干酪乳杆菌"] == ("副干酪乳杆菌", 1.0)
    assert got["龙舌兰糖浆"] == (None, 0.0)
    assert got["复配酸度调节剂"] == ("酸度调节剂", 0.85)
    assert got["着色剂"] == ("着色剂", 0.9)
    assert got["食用白砂糖"] == ("白砂糖", 0.87)
    assert got["单双甘油脂肪酸脂"] == ("单双甘油脂肪酸酯", 0.875)


def test_fuzzy_against_all_words():
    for word in KB.vocabulary[::9]:
        term = word + "某"
        want = max(((SequenceMatcher(None, term, w, autojunk=False).ratio(), -k) for k, w in enumerate(KB.vocabulary) if len(w) > 1 and abs(len(w) - len(term)) <= 2), default=(0, 0))
        got = normalize.fuzzy_match(term, KB.vocabulary)
        assert (got and (got[0], got[1])) == ((KB.vocabulary[-want[1]], want[0]) if want[0] >= 0.86 and len(term) > 2 else None)


def test_confidence_and_rejection(spark):
    rows = [("a", None, "糖 1g", "0蔗糖", None, None), ("b", "水、花生", "糖 1g", "低糖", ["x", "y", "z"], None), ("c", "水", "糖 1g", "低糖", ["x", "y", "z"], True), ("d", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "label_id string, ingredients_text string, nutrition_text string, claims_text string, uncertain array<string>, human_verified boolean")
    got = {r.label_id: r for r in verify(df).collect()}
    assert got["a"].conf_struct == 0.3 and got["a"].rejected
    assert got["b"].conf_ocr == 0.57 and got["b"].rejected and got["b"].claim_verdicts is None
    assert [a.code for a in got["b"].allergen_alerts] == ["PEANUT"]  # alerts come whatever the gate says
    assert {a.certainty for a in got["b"].allergen_alerts} == {"可能含有"}
    assert got["c"].conf_ocr == 0.9 and [v.label for v in got["c"].claim_verdicts] == ["一致"]
    assert got["d"].rejected and got["d"].missing_fields == ["配料表", "营养成分表", "宣称语"]


def test_unknown_ingredient_never_agrees(spark):
    df = spark.createDataFrame([("a", "水、柠檬酸、食用盐、大豆油、龙舌兰糖浆", "糖 0g", "无糖")], "label_id string, ingredients_text string, nutrition_text string, claims_text string")
    assert [v.label for v in verify(df).first().claim_verdicts] == ["无法判定"]


def test_empty_table(spark):
    assert verify(spark.createDataFrame([], "label_id string, other int")).count() == 0


def test_layout(spark):
    rows = [("测试饮料", 0), ("营养成分表 每100mL", 40), ("能量", 80), ("180kJ 2%", 120), ("糖 9g", 160), ("0蔗糖", 200), ("配料：水、白砂糖", 240), ("、柠檬酸", 280), ("保质期 12个月", 320)]
    boxes = [(t, 0.9, 0.0, 50.0, float(y), y + 20.0, y + 10.0, 20.0) for t, y in rows]
    df = spark.createDataFrame([("i", boxes), ("none", [])], f"image_id string, boxes array<{layout.BOX}>")
    got = {r.label_id: r for r in layout.label_sources(df, "boxes", KB).collect()}
    assert got["i"].product_name == "测试饮料" and got["i"].claims_text == "0蔗糖" and got["i"].basis == "100mL"
    assert [(n.name, n.value, n.basis) for n in got["i"].nutrition] == [("能量", "180", "100mL"), ("糖", "9", "100mL")]
    assert got["i"].ingredients_text.startswith("水、白砂糖")
    assert got["none"].confidence is None and got["none"].ingredients_text is None


def test_stream_equals_batch(spark, tmp_path):
    from grainsieve.plans.verify import conform
    from grainsieve.streaming.jobs import label_stream, verify_stream

    conform(labels.samples(spark)).write.parquet(str(tmp_path / "in"))
    q = verify_stream(label_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("reports").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted((r.label_id, r.claim_verdicts[0].label) for r in verify(labels.samples(spark)).collect())
    assert sorted((r.label_id, r.claim_verdicts[0].label) for r in spark.table("reports").collect()) == want


def test_recogniser_errors_stay_errors(spark):
    with pytest.raises(recognizer.RecognizerMissing):
        recognizer.recognizer()


def test_lookups(spark):
    rows = spark.createDataFrame([(1, k, k) for k in range(30)], "u int, at int, id int")
    assert lookups.newest(rows, "u", "at", "id").count() == 20
    assert lookups.latest_requests(rows, "u", "id").first().at == 29
    assert parsed(labels.samples(spark)).where(F.size("claims") == 1).count() == 4


def test_forms(spark):
    from grainsieve.operators import forms

    p = forms.profiles(spark.createDataFrame([(1, [" milk", "EGG", ""], "x", "花生、 芝麻")], "user_id int, allergens array<string>, population string, avoid string")).first()
    assert (p.allergens, p.population, p.avoid) == (["MILK", "EGG"], "成人", ["花生", "芝麻"])
    rows = spark.createDataFrame([("a", 1, "糖", "1"), ("a", 2, "", "1"), ("a", 3, "钠", "x"), ("b", 1, "糖", "2")], "k string, place int, name string, value string")
    assert [tuple(r) for r in forms.checked_rows(rows, "k").collect()] == [("a", 2, "missing_name")]


def test_product_records_keep_their_failures(spark):
    from grainsieve.sources.records import product_records

    got = product_records(spark, "http://127.0.0.1:9/{code}", ["1", "2"], 1).collect()
    assert {(r.code, r.state) for r in got} == {("1", "network"), ("2", "network")}
