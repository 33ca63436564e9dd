"""Queries over the label engine, on labels made from the driver's tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plain
from .functions import scalars as S
from .functions import sql as E
from .operators import allergens, layout, lookups, normalize, parse
from .plans import rows as R
from .plans.verify import parsed, verified, verify
from .runtime import ship, spread, table
from .sources.kb import dimensions, knowledge_base
from .sources.labels import BASES, CLAIMS, VOCAB, synthetic

KB = knowledge_base()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query and its SQL, which may be made only when it is asked for."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- what the oracles share


def q(x) -> str:
    """A value as DuckDB SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return repr(x)
    if isinstance(x, list | tuple):
        return "([" + ", ".join(map(q, x)) + "]::VARCHAR[])"
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") t({names}))"


PARTS = {"风味发酵乳（水、脱脂乳粉、白砂糖）": [("风味发酵乳", 0), ("水", 1), ("脱脂乳粉", 1), ("白砂糖", 1)]}
_ING = [(v, j, raw, level, *(plain.normalize(raw)[k] for k in ("standard", "groups", "is_additive", "function", "confidence"))) for v in VOCAB for j, (raw, level) in enumerate(PARTS.get(v, [(v, 0)]))]
_PATTERN = {w: p for w, p in KB.match_words}


def _claim_of(text: str) -> str | None:
    best = next((w for w, _ in KB.match_words if w in text), None)
    return _PATTERN.get(best)


_CONDITIONS = [
    (c["id"], k, x["kind"], x["type"], x.get("nutrient"), t.get("solid"), t.get("liquid"), t.get("unit"), x.get("groups") or [], [x["function"]] if x.get("function") else x.get("functions"), x.get("value"), x.get("weight") or "strong")
    for c in KB.claims for k, x in enumerate(c["conditions"]) for t in [KB.thresholds["claims"].get(x.get("threshold"), {})]
]

LABELS = f"""
WITH lab AS (SELECT p_partkey AS k, 'L' || p_partkey AS label_id, {q(BASES)}[(p_partkey % 4 + 1)::INT] AS basis, {q(CLAIMS)}[(p_partkey % {len(CLAIMS)} + 1)::INT] AS claim, (50 + p_partkey % 50) / 100.0::DOUBLE AS conf FROM part),
vocab AS {values(_ING, "term, j, raw, level, standard, groups, is_additive, func, confidence")},
picked AS (SELECT k, label_id, i, {q(VOCAB)}[((k * 7 + i * 13) % {len(VOCAB)} + 1)::INT] AS term FROM lab, (SELECT unnest(range(9)) AS i) WHERE i <= 3 + k % 6),
ing AS (SELECT label_id, k, row_number() OVER (PARTITION BY label_id ORDER BY i, j) - 1 AS pos, raw, level, standard, groups, is_additive, func, confidence FROM picked JOIN vocab USING (term)),
nut AS (SELECT label_id, k, basis, u.name, u.value, u.unit, CASE basis WHEN '100mL' THEN 'liquid' WHEN '份' THEN NULL ELSE 'solid' END AS kind, CASE basis WHEN '30g' THEN 30.0 ELSE 100.0 END AS amount
  FROM (SELECT *, unnest([{{'name': '糖', 'value': (k * 37 % 300) / 10.0::DOUBLE, 'unit': 'g'}}, {{'name': '钠', 'value': (k * 53 % 900)::DOUBLE, 'unit': 'mg'}}, {{'name': '脂肪', 'value': (k * 17 % 250) / 10.0::DOUBLE, 'unit': 'g'}}, {{'name': '钙', 'value': (k * 29 % 400)::DOUBLE, 'unit': 'mg'}}, {{'name': '蛋白质', 'value': (k * 11 % 200) / 10.0::DOUBLE, 'unit': 'g'}}]) AS u FROM lab)),
sums AS (SELECT label_id, count(*) AS n_ing, count(*) FILTER (standard IS NULL) AS n_unknown, count(*) FILTER (is_additive) AS n_additive, count(*) FILTER (level = 0) AS n_top, count(*) FILTER (is_additive AND func IS NULL) AS n_odd, floor(avg(confidence) * 10000 + 0.5) / 10000 AS conf_normalize FROM ing GROUP BY label_id),
conf AS (SELECT label_id, conf AS conf_ocr, 1.0::DOUBLE AS conf_struct, conf_normalize, least(conf, 1.0, conf_normalize) AS confidence FROM lab JOIN sums USING (label_id)),
cond AS {values(_CONDITIONS, "pattern_id, ord, kind, type, nutrient, solid, liquid, unit, groups, functions, value, weight")},
lab2 AS (SELECT lab.*, p.pattern_id FROM lab JOIN {values([(c, _claim_of(c)) for c in CLAIMS], "claim, pattern_id")} p USING (claim)),
"""
_FOUND = """
hits AS (SELECT l.label_id, c.pattern_id, c.ord, count(i.label_id) AS n FROM lab2 l JOIN cond c USING (pattern_id) LEFT JOIN ing i ON i.label_id = l.label_id AND (
    (c.type LIKE 'ingredient_%sent' AND list_has_any(i.groups, c.groups)) OR (c.type = 'additive_absent' AND i.is_additive AND (c.functions IS NULL OR list_contains(c.functions, i.func) OR (list_contains(c.functions, '防腐剂') AND len(c.functions) = 1 AND list_contains(KEEPS, i.standard))))) GROUP BY ALL),
status AS (SELECT l.label_id, c.pattern_id, c.ord, c.kind, c.type, c.weight, CASE
    WHEN c.type LIKE 'nutrition%' THEN CASE WHEN n.name IS NULL OR n.kind IS NULL THEN 'missing' ELSE CASE WHEN (c.type = 'nutrition_max' AND n.value * 100.0 / n.amount <= CASE n.kind WHEN 'liquid' THEN c.liquid ELSE c.solid END) OR (c.type = 'nutrition_min' AND n.value * 100.0 / n.amount >= CASE n.kind WHEN 'liquid' THEN c.liquid ELSE c.solid END) THEN 'satisfied' ELSE 'violated' END END
    WHEN c.type = 'ingredient_absent' THEN CASE WHEN h.n > 0 THEN 'violated' WHEN s.n_unknown > 0 THEN 'missing' ELSE 'satisfied' END
    WHEN c.type = 'ingredient_present' THEN CASE WHEN h.n > 0 THEN 'satisfied' WHEN s.n_unknown > 0 THEN 'missing' ELSE 'violated' END
    WHEN c.type = 'additive_absent' THEN CASE WHEN h.n > 0 THEN 'violated' WHEN s.n_unknown + s.n_odd > 0 THEN 'missing' ELSE 'satisfied' END
    WHEN c.type = 'additive_count_max' THEN CASE WHEN s.n_additive <= c.value THEN 'satisfied' ELSE 'violated' END
    ELSE CASE WHEN s.n_top <= c.value THEN 'satisfied' ELSE 'violated' END END AS status
  FROM lab2 l JOIN cond c USING (pattern_id) JOIN hits h ON h.label_id = l.label_id AND h.ord = c.ord JOIN sums s ON s.label_id = l.label_id LEFT JOIN nut n ON n.label_id = l.label_id AND n.name = c.nutrient)
""".replace("KEEPS", q(KB.preservatives))
_VERDICT = """,
verdict AS (SELECT l.label_id, l.claim, l.pattern_id, CASE WHEN count(status) FILTER (status = 'violated' AND NOT weak) > 0 THEN '不一致' WHEN count(status) FILTER (status = 'missing' AND NOT weak) > 0 THEN '无法判定'
    WHEN count(status) FILTER (status = 'violated') > 0 THEN '存在争议' WHEN count(status) = 0 OR count(status) FILTER (status = 'missing') > 0 THEN '无法判定' ELSE '一致' END AS label
  FROM lab2 l LEFT JOIN (SELECT *, kind = 'semantic' AND weight = 'weak' AS weak FROM status) s USING (label_id) JOIN conf c ON c.label_id = l.label_id WHERE c.confidence >= 0.6 GROUP BY ALL),
baseline AS (SELECT l.label_id, CASE WHEN count(status) FILTER (status = 'violated') > 0 THEN '不一致' WHEN count(status) = 0 OR count(status) FILTER (status = 'missing') > 0 THEN '无法判定' ELSE '一致' END AS label
  FROM lab2 l LEFT JOIN (SELECT * FROM status WHERE type LIKE 'nutrition%') s USING (label_id) JOIN conf c ON c.label_id = l.label_id WHERE c.confidence >= 0.6 GROUP BY l.label_id),
"""
_RISK = """
fac AS (SELECT n.label_id, r.*, n.value * 100.0 / n.amount AS v, CASE WHEN n.value * 100.0 / n.amount >= r.high THEN 2 WHEN n.value * 100.0 / n.amount >= r.medium THEN 1 ELSE 0 END AS lv FROM nut n JOIN RISKS r ON r.nutrient = n.name WHERE n.kind IS NOT NULL),
risk AS (SELECT label_id, sum(CASE lv WHEN 2 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.0 END * weight ORDER BY ord) / sum(weight ORDER BY ord) AS s FROM fac GROUP BY label_id),
scored AS (SELECT c.label_id, CASE WHEN s IS NULL THEN '未知' WHEN s >= 0.75 THEN '高' WHEN s >= 0.45 THEN '中' ELSE '低' END AS level, coalesce(floor(s * 1000 + 0.5) / 1000, 0.0) AS score FROM conf c LEFT JOIN risk USING (label_id) WHERE confidence >= 0.6)
""".replace("RISKS", values([(n, r["unit"], float(r["medium"]), float(r["high"]), float(r["weight"]), i) for i, (n, r) in enumerate(KB.thresholds["risk"].items())], "nutrient, unit, medium, high, weight, ord"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return synthetic(spark, sf_dir)


_plans: dict[tuple[str, str], DataFrame] = {}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports: a plan, analysed once for a session and a folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _plans:
        _plans.clear()
        _plans[key] = verify(labels(spark, sf_dir))
    return _plans[key]


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.col("rejected"))


# ---- parsing and normalising


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, pos::INT AS pos, raw, level::INT AS level FROM ing")
def parse_ingredients_leveled(spark, sf_dir):
    parts = E.with_columns(labels(spark, sf_dir), {"parts": parse.split_ingredients(E.col("ingredients_text"))})
    return R.exploded(parts, "parts", "label_id", called="p", place="pos").select("label_id", "pos", "p.raw", "p.level")


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, pos::INT AS pos, raw, standard, is_additive, func AS function, confidence::DOUBLE AS confidence, len(groups)::INT AS n_groups FROM ing")
def normalize_ingredients(spark, sf_dir):
    p = R.exploded(parsed(labels(spark, sf_dir)), "ingredients", "label_id", called="i")
    return p.select("label_id", F.col("i.position").alias("pos"), "i.raw", "i.standard", "i.is_additive", "i.function", "i.confidence", F.size("i.groups").alias("n_groups"))


_TERMS = [f + v for f in ("", "优质", "食品添加剂", "特浓") for v in ("白糖", "浓缩柠檬汁", "山梨酸钾", "复配增稠剂", "着色剂", "干酪", "发酵副干酪乳杆菌饮", "某物")]


@query(f"SELECT p_partkey AS id, x.* FROM part JOIN {values([(i, t, *(plain.normalize(t)[k] for k in ('standard', 'confidence', 'is_additive'))) for i, t in enumerate(_TERMS)], 'ord, term, standard, confidence, is_additive')} x ON p_partkey % {len(_TERMS)} = x.ord".replace("x.*", "x.term, x.standard, x.confidence::DOUBLE AS confidence, x.is_additive"))
def normalize_terms(spark, sf_dir):
    ship(spark)
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*map(F.lit, _TERMS)), (F.col("p_partkey") % len(_TERMS)).cast("int")).alias("term"))
    rows = normalize.with_ingredients(terms.withColumn("parts", F.array(F.struct(F.col("term").alias("raw"), F.lit(0).alias("level")))), "parts", "ing", KB)
    return rows.select("id", "term", F.col("ing")[0]["standard"].alias("standard"), F.col("ing")[0]["confidence"].alias("confidence"), F.col("ing")[0]["is_additive"].alias("is_additive"))


@query()
def normalize_fuzzy(spark, sf_dir):
    """Terms with one letter changed; no plain SQL has the likeness measure, a test compares it with the standard library's."""
    ship(spark)
    words = [w for w in KB.vocabulary if len(w) > 4]
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*(F.lit(w[:-1] + "某") for w in words)), (F.col("p_partkey") % len(words)).cast("int")).alias("term"))
    return terms.withColumn("m", normalize.fuzzy(KB)(F.array("term"))[0]).select("id", "term", F.col("m.standard").alias("standard"), F.col("m.confidence").alias("confidence"))


_SEGMENTS = [("能量 180kJ/100mL", "能量", 180.0, "kJ", "100mL"), ("维生素B1 0.5mg", "维生素B1", 0.5, "mg", "100g"), ("糖 0g", "糖", 0.0, "g", "100g"), ("钠：20毫克", "钠", 20.0, "mg", "100g"), ("纳 20mg", None, None, None, None), ("脂肪 3.5g/30g", "脂肪", 3.5, "g", "30g"), ("碳水化合物 100g", None, None, None, None), ("每份 蛋白质 5g", "蛋白质", 5.0, "g", "份"), ("热量 90千卡", "能量", 90.0, "kcal", "100g")]


@query(f"SELECT p_partkey AS id, x.segment, x.name, x.value::DOUBLE AS value, x.unit, x.basis FROM part JOIN {values([(i, *s) for i, s in enumerate(_SEGMENTS)], 'ord, segment, name, value, unit, basis')} x ON p_partkey % {len(_SEGMENTS)} = x.ord")
def parse_nutrition_segment(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*(F.lit(s[0]) for s in _SEGMENTS)), (F.col("p_partkey") % len(_SEGMENTS)).cast("int")).alias("segment"))
    return E.with_columns(rows, {"r": parse.nutrition_segment(E.col("segment"), KB)}).select("id", "segment", "r.name", "r.value", "r.unit", "r.basis")


_BASES = [("每100g", "solid", 100.0), ("100mL", "liquid", 100.0), ("30 克", "solid", 30.0), ("L", "liquid", 100.0), ("份", None, 100.0), ("每 250毫升", "liquid", 250.0), ("0g", "solid", 100.0)]


@query(f"SELECT p_partkey AS id, x.basis, x.kind, x.amount::DOUBLE AS amount FROM part JOIN {values([(i, *b) for i, b in enumerate(_BASES)], 'ord, basis, kind, amount')} x ON p_partkey % {len(_BASES)} = x.ord")
def parse_basis(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*(F.lit(b[0]) for b in _BASES)), (F.col("p_partkey") % len(_BASES)).cast("int")).alias("basis"))
    return E.select(rows, "id", "basis", S.basis_kind(E.col("basis")).alias("kind"), S.basis_amount(E.col("basis")).alias("amount"))


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, ['g','mg','μg','kg','kJ','kcal'][(l_orderkey % 6 + 1)::INT] AS a, ['mg','g','kJ'][(l_linenumber % 3 + 1)::INT] AS b FROM lineitem),
m AS {values([*((k, 'm', v) for k, v in S.MASS.items()), *((k, 'e', v) for k, v in S.ENERGY.items())], 'unit, kind, f')}
SELECT l_orderkey, l_linenumber, a AS from_unit, b AS to_unit, CASE WHEN lower(a) = lower(b) THEN v ELSE v * x.f::DOUBLE / y.f::DOUBLE END AS converted FROM u JOIN m x ON x.unit = lower(a) LEFT JOIN m y ON y.unit = lower(b) AND y.kind = x.kind""")
def unit_convert(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(k, n, F.col("l_quantity").alias("v"), F.get(F.array(*map(F.lit, ["g", "mg", "μg", "kg", "kJ", "kcal"])), (k % 6).cast("int")).alias("from_unit"), F.get(F.array(*map(F.lit, ["mg", "g", "kJ"])), (n % 3).cast("int")).alias("to_unit"))
    return E.select(rows, "l_orderkey", "l_linenumber", "from_unit", "to_unit", S.convert(E.col("v"), E.col("from_unit"), E.col("to_unit")).alias("converted"))


_W = KB.match_words


@query(f"""WITH w AS {values([(i, w, p) for i, (w, p) in enumerate(_W)], 'ord, word, pattern_id')},
t AS (SELECT p_partkey AS id, '超' || a.word || ' ' || b.word || '!' AS text, a.word AS wa, a.pattern_id AS pa, b.word AS wb, b.pattern_id AS pb FROM part JOIN w a ON p_partkey % {len(_W)} = a.ord JOIN w b ON (p_partkey * 7) % {len(_W)} = b.ord)
SELECT id, text, wa AS raw, pa AS pattern_id, 1 AS start FROM t UNION ALL SELECT id, text, wb, pb, (2 + length(wa))::INT FROM t WHERE pa <> pb""")
def claim_match_longest(spark, sf_dir):
    words = F.array(*(F.lit(w) for w, _ in _W))
    k = F.col("p_partkey")
    texts = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("超"), F.get(words, (k % len(_W)).cast("int")), F.lit(" "), F.get(words, (k * 7 % len(_W)).cast("int")), F.lit("!")).alias("text"))
    return E.with_columns(texts, {"m": parse.claim_matches(E.col("text"), KB)}).transform(lambda df: R.exploded(df, "m", "id", "text")).select("id", "text", "x.raw", "x.pattern_id", "x.start")


# ---- conditions and verdicts


@query(LABELS + _FOUND + " SELECT status.label_id, pattern_id, ord::INT AS ord, type, status FROM status JOIN conf USING (label_id) WHERE confidence >= 0.6")
def constraint_status(spark, sf_dir):
    return R.hit_rows(reports(spark, sf_dir)).select("label_id", "pattern_id", "ord", F.col("constraint_type").alias("type"), "status")


def _constraint(kind: str):
    @query(LABELS + _FOUND + f" SELECT status.label_id, pattern_id, status FROM status JOIN conf USING (label_id) WHERE confidence >= 0.6 AND type = '{kind}'")
    def f(spark, sf_dir):
        return constraint_status(spark, sf_dir).where(F.col("type") == kind).select("label_id", "pattern_id", "status")

    QUERIES[f"constraint_{kind}"], ORACLE_SQL[f"constraint_{kind}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _kind in ("nutrition_max", "nutrition_min", "ingredient_absent", "ingredient_present", "additive_absent", "additive_count_max", "ingredient_count_max"):
    _constraint(_kind)


@query(LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + " SELECT * FROM verdict")
def verdict_lattice(spark, sf_dir):
    claim = F.get(F.array(*map(F.lit, CLAIMS)), (F.substring("label_id", 2, 20).cast("long") % len(CLAIMS)).cast("int"))
    return R.verdict_rows(reports(spark, sf_dir)).select("label_id", claim.alias("claim"), "pattern_id", "label")


@query(LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + " SELECT * FROM baseline")
def baseline_verdict(spark, sf_dir):
    return R.baseline_rows(reports(spark, sf_dir)).select("label_id", "label")


@query(LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + " SELECT v.label_id, (v.label = '不一致')::INT AS inconsistent, (b.label = '不一致')::INT AS by_baseline, (v.label = '不一致')::INT - (b.label = '不一致')::INT AS extra FROM verdict v JOIN baseline b USING (label_id)")
def crosscheck_gain(spark, sf_dir):
    return live(reports(spark, sf_dir)).select("label_id", F.col("meta.inconsistent").alias("inconsistent"), F.col("meta.inconsistent_by_baseline").alias("by_baseline"), F.col("meta.extra_found_by_crosscheck").alias("extra"))


# ---- risk, populations, confidence


@query(LABELS + _RISK + " SELECT * FROM scored")
def risk_weighted(spark, sf_dir):
    return live(reports(spark, sf_dir)).select("label_id", "risk.level", "risk.score")


@query(LABELS + _RISK + " SELECT f.label_id, f.nutrient, floor(v * 1000 + 0.5) / 1000 AS value, ['低','中','高'][lv + 1] AS level, floor(weight::DOUBLE / sum(weight::DOUBLE) OVER (PARTITION BY f.label_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 1000 + 0.5) / 1000 AS contribution FROM fac f JOIN conf USING (label_id) WHERE confidence >= 0.6")
def risk_factors(spark, sf_dir):
    return R.factor_rows(reports(spark, sf_dir)).select("label_id", "nutrient", "value", "level", "contribution")


_POP_RULES = [(p, k, r["type"], r.get("groups") or [], r.get("functions"), r.get("nutrient"), r.get("value"), {"低": 0, "中": 1, "高": 2}[r["level"]]) for p, c in KB.populations.items() for k, r in enumerate(c["rules"])]
_POP_FOCUS = [(p, n) for p, c in KB.populations.items() for n, w in c["weights"].items() if w > 1.5]


@query(LABELS + _RISK + f""", pops AS {values([(p, i) for i, p in enumerate(KB.populations)], 'population, pord')},
rule AS {values(_POP_RULES, 'population, ord, type, groups, functions, nutrient, value, lv')}, focus AS {values(_POP_FOCUS, 'population, nutrient')},
fired AS (SELECT s.label_id, r.population, max(r.lv) AS lv FROM scored s JOIN rule r ON
   (r.type = 'nutrition_min_warn' AND EXISTS (SELECT 1 FROM nut n WHERE n.label_id = s.label_id AND n.name = r.nutrient AND n.kind IS NOT NULL AND n.value * 100.0 / n.amount >= r.value))
   OR (r.type = 'ingredient_group_warn' AND EXISTS (SELECT 1 FROM ing i WHERE i.label_id = s.label_id AND list_has_any(i.groups, r.groups)))
   OR (r.type = 'additive_warn' AND EXISTS (SELECT 1 FROM ing i WHERE i.label_id = s.label_id AND i.is_additive AND (r.functions IS NULL OR list_contains(r.functions, i.func)))) GROUP BY ALL),
top AS (SELECT f.label_id, c.population, max(CASE f.lv WHEN 2 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.0 END) AS t FROM fac f JOIN focus c USING (nutrient) GROUP BY ALL),
one AS (SELECT s.label_id, p.population, s.level AS base, CASE WHEN t > s.score THEN t::DOUBLE ELSE s.score END AS score, t, coalesce(f.lv, 0) AS rl FROM scored s CROSS JOIN pops p LEFT JOIN top USING (label_id, population) LEFT JOIN fired f USING (label_id, population))
SELECT label_id, population, CASE WHEN base = '未知' THEN CASE WHEN rl > 0 THEN ['低','中','高'][rl + 1] ELSE '未知' END ELSE ['低','中','高'][greatest(rl, CASE WHEN t IS NULL THEN CASE base WHEN '高' THEN 2 WHEN '中' THEN 1 ELSE 0 END ELSE CASE WHEN score >= 0.75 THEN 2 WHEN score >= 0.45 THEN 1 ELSE 0 END END) + 1] END AS level, score FROM one""")
def population_final(spark, sf_dir):
    return R.population_rows(reports(spark, sf_dir)).select("label_id", "population", "level", "score")


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, conf_ocr, conf_struct, conf_normalize, confidence FROM conf")
def confidence_min(spark, sf_dir):
    return reports(spark, sf_dir).select("label_id", "conf_ocr", "conf_struct", "conf_normalize", "confidence")


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, confidence < 0.6 AS rejected, confidence < 0.6 AS has_reason, confidence >= 0.6 AS has_verdicts FROM conf")
def reject_gate(spark, sf_dir):
    return reports(spark, sf_dir).select("label_id", "rejected", F.col("reject_reason").isNotNull().alias("has_reason"), F.col("claim_verdicts").isNotNull().alias("has_verdicts"))


# ---- allergens

_GUARDS = [(c, a, i, KB.allergens["ambiguous"].get(a, []) + (KB.allergens["single_char"].get(a, []) if len(a) == 1 else [])) for c, a, i in KB.allergen_aliases()]
_ALLERGEN = LABELS + f"""
al AS {values(_GUARDS, 'code, alias, aord, blocked')},
names AS (SELECT label_id, raw AS ingredient, standard AS name, 0 AS nord FROM ing WHERE standard IS NOT NULL UNION SELECT label_id, raw, raw, 1 FROM ing),
matched AS (SELECT label_id, ingredient, code, alias, aord, nord, CASE WHEN name = alias THEN 'exact' ELSE 'contains' END AS level FROM names JOIN al ON contains(name, alias) WHERE name = alias OR (len(list_filter(blocked, lambda b: contains(name, b))) = 0
  AND NOT (length(alias) = 1 AND strpos(name, alias) > 1 AND strpos(name, alias) < length(name) AND length(name) > 3) AND NOT (length(alias) = 2 AND length(name) - 2 >= 4))),
per_alias AS (SELECT label_id, ingredient, code, alias, aord, arg_min(level, nord) AS level FROM matched GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY label_id, code, ingredient ORDER BY level DESC, length(alias) DESC, aord) AS r FROM per_alias)
"""


@query(_ALLERGEN + " SELECT label_id, code, ingredient, alias, level, '可能含有' AS certainty FROM best WHERE r = 1")
def allergen_detect(spark, sf_dir):
    a = parsed(labels(spark, sf_dir))
    a = E.with_columns(a, {"alerts": allergens.detect(E.col("ingredients"), KB)})
    a = R.exploded(a, "alerts", "label_id", called="a").select("label_id", "a.code", "a.matched", "a.certainty")
    return R.exploded(a, "matched", "label_id", "code", "certainty", called="m").select("label_id", "code", "m.ingredient", "m.alias", "m.level", "certainty")


@query(_ALLERGEN + " SELECT label_id, code, count(*) AS n_ingredients FROM best WHERE r = 1 AND code IN ('MILK', 'EGG', 'PEANUT') GROUP BY ALL")
def allergen_profile_filter(spark, sf_dir):
    a = parsed(labels(spark, sf_dir))
    a = E.with_columns(a, {"alerts": allergens.for_profile(allergens.detect(E.col("ingredients"), KB), E.expr("array('milk', ' Egg ', 'PEANUT')"))})
    return R.exploded(a, "alerts", "label_id", called="a").select("label_id", "a.code", F.size("a.matched").cast("long").alias("n_ingredients"))


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, w.word, arg_min(raw, pos) AS ingredient FROM ing JOIN (SELECT unnest(['糖', '油', '花生']) AS word) w ON contains(raw, w.word) GROUP BY ALL")
def avoid_words(spark, sf_dir):
    a = E.with_columns(parsed(labels(spark, sf_dir)), {"m": allergens.avoid_matches(E.col("ingredients"), E.expr("array('糖', '油', '花生')"))})
    return R.exploded(a, "m", "label_id").select("label_id", "x.word", "x.ingredient")


# ---- summaries and searches


@query(LABELS + _FOUND + _VERDICT + _RISK + """ SELECT count(*) AS total, count(*) AS ok, 0::BIGINT AS failed, count(*) FILTER (v.label = '不一致') AS inconsistent, count(*) FILTER (s.level = '高') AS high_risk, count(*) FILTER (c.confidence < 0.75) AS low_confidence,
 floor(count(*) FILTER (v.label = '不一致') * 100 / count(*) + 0.5)::BIGINT AS inconsistent_pct FROM conf c LEFT JOIN verdict v USING (label_id) LEFT JOIN scored s USING (label_id)""")
def batch_summary(spark, sf_dir):
    return lookups.batch_summary(reports(spark, sf_dir).withColumn("ok", F.lit(True)))


@query(LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + " SELECT c.label_id, coalesce(v.label, '无法判定') AS verdict, coalesce((v.label = '不一致')::INT, 0) AS violated FROM conf c LEFT JOIN verdict v USING (label_id)")
def history_summary(spark, sf_dir):
    return lookups.history_rows(reports(spark, sf_dir)).select("label_id", "verdict", "violated")


@query("SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20")
def history_top20(spark, sf_dir):
    return lookups.newest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_request(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return lookups.latest_requests(events, "user_id", "event_id").select("user_id", "event_type", "value")


@query("""WITH c AS (SELECT p_partkey AS id, (690 + p_partkey % 20)::VARCHAR || lpad(p_partkey::VARCHAR, 9, '0') AS body, p_partkey % 10 AS last FROM part), s AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: substr(body, i, 1)::INT * CASE i % 2 WHEN 0 THEN 3 ELSE 1 END)) AS t FROM c)
SELECT id, body || last AS code, ((10 - t % 10) % 10 = last) AS valid, ((10 - t % 10) % 10)::INT AS expected, CASE WHEN substr(body, 1, 3) BETWEEN '690' AND '699' THEN '中国大陆（690~699）' ELSE '其他/未指定' END AS region FROM s""")
def ean13_check(spark, sf_dir):
    k = F.col("p_partkey")
    codes = table(spark, sf_dir, "part").select(k.alias("id"), F.concat((690 + k % 20).cast("string"), F.lpad(k.cast("string"), 9, "0"), (k % 10).cast("string")).alias("code"))
    return E.with_columns(codes, {"e": S.ean13(E.col("code"))}).select("id", "code", "e.valid", "e.expected", "e.region")


@query("""SELECT id, u.name, floor(u.value * 1000 + 0.5) / 1000 AS value, u.unit, '100g' AS basis FROM (SELECT p_partkey AS id, unnest([{'name': '能量', 'value': p_retailprice, 'unit': 'kJ'}, {'name': '糖', 'value': p_size / 3.0::DOUBLE, 'unit': 'g'}, {'name': '钠', 'value': CASE WHEN p_size % 2 = 0 THEN p_size / 7.0::DOUBLE END, 'unit': 'g'}]) AS u FROM part) WHERE u.value IS NOT NULL""")
def record_unpivot(spark, sf_dir):
    size = F.col("p_size")
    n = F.create_map(F.lit("energy-kj_100g"), F.col("p_retailprice"), F.lit("sugars_100g"), (size / F.lit(3.0)).cast("double"), F.lit("sodium_100g"), F.when(size % 2 == 0, (size / F.lit(7.0)).cast("double")))
    return lookups.record_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n.alias("n")), "id", "n")


@query("SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'p_name' END, CASE WHEN p_partkey % 5 = 0 THEN 'p_size' END], lambda x: x IS NOT NULL) AS changed FROM part".replace("list_filter", "array_to_string(list_filter").replace(") AS changed", "), ',') AS changed"))
def field_diff(spark, sf_dir):
    k = F.col("id")
    before = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")
    after = before.select("id", F.when(k % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), "p_brand", F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return lookups.field_diff(before, after, "id").select("id", F.array_join("changed", ",").alias("changed"))


# ---- layout

_ROWS = [("测试", "饮料"), ("配料：", "水、白砂糖、柠檬酸"), ("营养成分表", "每100mL"), ("能量", "180kJ"), ("糖 9g", "钠 12mg"), ("0蔗糖", "新口感")]


def _images(spark, sf_dir) -> DataFrame:
    """For each part six lines of text, cut into two boxes each, with uneven heights of the boxes' places."""
    k = E.col("p_partkey")
    boxes = []
    for r, pair in enumerate(_ROWS):
        for side, text in enumerate(pair):
            y = E.lit(float(40 * r)) + ((k * (r + 3) + side * 5) % 7).cast("double")
            boxes.append(layout.box(E.lit(100.0 * side), y, E.lit(100.0 * side + 90), y + 20.0, E.lit(text), E.lit(0.9 if side else 0.8)))
    order = boxes[::2] + boxes[1::2]
    return E.select(spread(table(spark, sf_dir, "part").select("p_partkey")), k.cast("string").alias("image_id"), E.array(*order).alias("boxes"))


@query(f"""SELECT p_partkey::VARCHAR AS image_id, r.i::INT AS line, r.text, floor(0.85 * 10000 + 0.5) / 10000 AS confidence FROM part, {values([(i, ' '.join(t)) for i, t in enumerate(_ROWS)], 'i, text')} r""")
def layout_lines(spark, sf_dir):
    x = E.with_columns(_images(spark, sf_dir), {"l": layout.lines(E.col("boxes"))}).transform(lambda df: R.exploded(df, "l", "image_id", called="l", place="line"))
    return x.select("image_id", "line", "l.text", (F.floor(F.col("l.confidence") * 10000 + 0.5) / 10000).alias("confidence"))


@query("""SELECT p_partkey::VARCHAR AS image_id, 1 AS n_ingredient, 3 AS n_nutrition, 1 AS n_claim, 1 AS n_header, '100mL' AS region_basis, 0 AS n_warnings FROM part""")
def layout_regions(spark, sf_dir):
    x = E.with_columns(_images(spark, sf_dir), {"l": layout.lines(E.col("boxes"))})
    x = layout.with_regions(x, "l", KB)
    return x.select("image_id", *(F.size(f"{c}_lines").alias(f"n_{c}") for c in ("ingredient", "nutrition", "claim", "header")), "region_basis", F.size("warnings").alias("n_warnings"))


@query()
def layout_to_report(spark, sf_dir):
    """From boxes to verdicts: composed of parts that have oracles of their own."""
    ship(spark)
    r = verify(layout.label_sources(_images(spark, sf_dir), "boxes", KB))
    return r.select("label_id", "confidence", "rejected", F.size("ingredients").alias("n_ingredients"), F.size("nutrition").alias("n_nutrition"), F.to_json("claim_verdicts").alias("verdicts"))


@query()
def full_report(spark, sf_dir):
    """Whole reports as JSON."""
    r = reports(spark, sf_dir)
    return r.select("label_id", "confidence", "rejected", F.to_json(F.struct(*[c for c in r.columns if c != "label_id"])).alias("report"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = verified(parsed(labels(spark, sf_dir)))
    return r.select("label_id", "confidence", "rejected", F.col("risk.level").alias("risk"), F.transform("claim_verdicts", lambda v: v["label"]).alias("verdicts"), F.transform("allergen_alerts", lambda a: a["code"]).alias("allergens"))
