"""What a reader of a report sees: details, evidence, notes, reasons, orders and refusals, each said again in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plain
from .operators import lookups
from .plans import rows as R
from .plans.verify import verify
from .queries import _ALLERGEN, _FOUND, _POP_RULES, _RISK, _VERDICT, KB, LABELS, labels, q, query, reports, values
from .sources.labels import CLAIMS

_NUMBER = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"
_CLAIMS = plain.document("claims")["claims"]
_SHOWN = f"({_NUMBER.format('n.value')}) || n.unit || '/' || n.basis"
_WITH_FUNCTION = "raw || CASE WHEN func IS NULL THEN '' ELSE '（' || func || '）' END"
_MEMBER = "((c.type LIKE 'ingredient_%sent' AND list_has_any(i.groups, c.groups)) OR (c.type = 'additive_absent' AND i.is_additive AND (c.functions IS NULL OR list_contains(c.functions, i.func) OR (list_contains(c.functions, '防腐剂') AND len(c.functions) = 1 AND list_contains(" + q(KB.preservatives) + ", i.standard)))) OR (c.type = 'additive_count_max' AND i.is_additive) OR (c.type = 'ingredient_count_max' AND i.level = 0))"

_DETAILS = f""",
found AS (SELECT l.label_id, c.ord, list(i.raw ORDER BY i.pos) AS raws, string_agg({_WITH_FUNCTION}, '、' ORDER BY i.pos) AS told, list('配料表：' || i.raw ORDER BY i.pos) AS proof FROM lab2 l JOIN cond c USING (pattern_id) JOIN ing i ON i.label_id = l.label_id AND {_MEMBER} GROUP BY ALL),
odd AS (SELECT label_id, coalesce(list(raw ORDER BY pos) FILTER (standard IS NULL), []) AS unknown, coalesce(list(raw ORDER BY pos) FILTER (is_additive AND func IS NULL), []) AS loose FROM ing GROUP BY label_id),
said AS (SELECT s.*, f.raws, f.told, f.proof, c.nutrient, n.name IS NULL AS absent, {_SHOWN} AS shown, n.basis, n.kind AS per, c.type = 'nutrition_max' AS most, c.unit, CASE WHEN n.kind = 'liquid' THEN c.liquid ELSE c.solid END::DOUBLE AS bound, c.value, o.unknown, o.loose
  FROM status s JOIN cond c ON c.pattern_id = s.pattern_id AND c.ord = s.ord LEFT JOIN found f ON f.label_id = s.label_id AND f.ord = s.ord JOIN odd o ON o.label_id = s.label_id LEFT JOIN nut n ON n.label_id = s.label_id AND n.name = c.nutrient),
ruled AS (SELECT *, '限量 ' || nutrient || CASE WHEN most THEN ' ≤ ' ELSE ' ≥ ' END || ({_NUMBER.format('bound')}) || unit || CASE WHEN per = 'liquid' THEN '/100mL' ELSE '/100g' END AS rule FROM said),
detail AS (SELECT label_id, pattern_id, ord, kind, type, status, weight, CASE
    WHEN type LIKE 'nutrition%' THEN CASE WHEN absent THEN '营养表里没有' || nutrient || '这一项' WHEN per IS NULL THEN '限量按每 100 计，不能与每「' || basis || '」相比' WHEN status = 'satisfied' THEN rule ELSE nutrient || '标为 ' || shown || '，' || CASE WHEN most THEN '高于' ELSE '低于' END || '限量（' || rule || '）' END
    WHEN type LIKE 'ingredient_%sent' THEN CASE WHEN raws IS NOT NULL THEN '配料里有：' || array_to_string(raws, '、') WHEN status = 'missing' THEN '有不认识的配料，所以不能断定：' || array_to_string(unknown[1:5], '、') WHEN type = 'ingredient_present' THEN '配料里没有找到' END
    WHEN type = 'additive_absent' THEN CASE WHEN raws IS NOT NULL THEN '添加剂有：' || told WHEN status = 'missing' THEN '有的配料或添加剂归不了类，所以不能断定：' || array_to_string((unknown || loose)[1:5], '、') END
    ELSE '共 ' || coalesce(len(raws), 0) || CASE type WHEN 'additive_count_max' THEN '种食品添加剂' ELSE '项配料' END || '，最多可有 ' || value::INT || CASE WHEN status = 'violated' THEN '：' || array_to_string(raws[1:8], '、') || CASE WHEN len(raws) > 8 THEN ' 等' ELSE '' END ELSE '' END END AS detail,
  CASE WHEN type LIKE 'nutrition%' THEN CASE WHEN status = 'violated' THEN '营养表：' || nutrient || ' ' || shown ELSE '' END WHEN type LIKE '%count_max' AND status <> 'violated' THEN '' ELSE coalesce(array_to_string(proof, '|'), '') END AS evidence FROM ruled)"""
_SEEN = LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + _DETAILS


@query(_SEEN + " SELECT d.label_id, pattern_id, ord::INT AS ord, detail, evidence FROM detail d JOIN conf USING (label_id) WHERE confidence >= 0.6")
def condition_details(spark, sf_dir):
    return R.hit_rows(reports(spark, sf_dir)).select("label_id", "pattern_id", "ord", "detail", F.array_join("evidence", "|").alias("evidence"))


@query(_SEEN + ", bad AS (SELECT d.label_id, string_agg(detail, '；' ORDER BY ord) AS issues FROM detail d JOIN verdict v USING (label_id, pattern_id) WHERE v.label = '不一致' AND status = 'violated' AND detail IS NOT NULL GROUP BY d.label_id) SELECT c.label_id, coalesce(issues, '') AS issues FROM conf c LEFT JOIN bad USING (label_id)")
def main_issues(spark, sf_dir):
    return reports(spark, sf_dir).select("label_id", F.coalesce(F.array_join(lookups.main_issues(F.col("claim_verdicts")), "；"), F.lit("")).alias("issues"))


def _described(x: dict) -> str:
    what = x.get("nutrient") or "、".join(x.get("groups") or x.get("functions") or [x.get("function") or ""])
    return {"nutrition_max": f"{what}不超过限量", "nutrition_min": f"{what}达到限量", "ingredient_absent": f"配料里没有 {what}", "ingredient_present": f"配料里有 {what}", "additive_absent": f"没有{what}添加剂"}.get(x["type"], f"数目不超过 {x.get('value')}")


_DESC = values([(c["id"], k, _described(x)) for c in _CLAIMS for k, x in enumerate(c["conditions"])], "pattern_id, ord, about")
_ADVICE = values([(c["id"], k, a["type"], a.get("nutrient"), a.get("groups") or [], a.get("functions")) for c in _CLAIMS for k, a in enumerate(c["advisories"])], "pattern_id, place, type, nutrient, groups, functions")
_MODES = values([(c["id"], bool(c["regulated"]), any(x["kind"] == "semantic" for x in c["conditions"]), bool(c["conditions"]) and all(x["kind"] == "semantic" for x in c["conditions"])) for c in _CLAIMS], "pattern_id, regulated, semantic, only_semantic")


@query(_SEEN + f""", about AS {_DESC}, mode AS {_MODES}, advice AS {_ADVICE},
hit AS (SELECT label_id, pattern_id, ord, status, kind = 'semantic' AND weight = 'weak' AND status = 'violated' AS weak, coalesce(detail, about) AS told FROM detail JOIN about USING (pattern_id, ord)),
h AS (SELECT label_id, pattern_id, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (weak) AS n_weak, string_agg(told, '；' ORDER BY ord) FILTER (status = 'missing') AS missing, string_agg(told, '；' ORDER BY ord) FILTER (weak) AS weak FROM hit GROUP BY ALL),
adv AS (SELECT l.label_id, a.place, CASE a.type WHEN 'ingredient_present' THEN '另外请看配料：' || string_agg(raw, '、' ORDER BY pos) ELSE '另外请看添加剂：' || string_agg({_WITH_FUNCTION}, '、' ORDER BY pos) END AS t
  FROM lab2 l JOIN advice a USING (pattern_id) JOIN ing i ON i.label_id = l.label_id AND ((a.type = 'ingredient_present' AND list_has_any(i.groups, a.groups)) OR (a.type = 'additive_warn' AND i.is_additive AND list_contains(a.functions, i.func))) GROUP BY l.label_id, a.place, a.type
  UNION ALL SELECT l.label_id, a.place, '另外请看' || a.nutrient || '：' || {_SHOWN} FROM lab2 l JOIN advice a USING (pattern_id) JOIN nut n ON n.label_id = l.label_id AND n.name = a.nutrient AND a.type = 'nutrition_present'),
also AS (SELECT label_id, string_agg(t, chr(10) ORDER BY place) AS also FROM adv GROUP BY label_id)
SELECT v.label_id, v.pattern_id, CASE WHEN m.pattern_id IS NULL THEN 'fallback' WHEN only_semantic THEN 'semantic' ELSE 'rule' END AS source, CASE WHEN m.pattern_id IS NULL THEN '没有规则认得这一说法，因此不下结论。' ELSE nullif(concat_ws(chr(10), CASE WHEN NOT regulated THEN '这一说法没有法定的定义，以下按一般理解核对。' END,
  CASE WHEN h.label_id IS NULL THEN '这一说法没有可以计量的条件，只列出相关事实。' WHEN semantic AND v.label = '一致' THEN '这里的「一致」只是说标签上没有找到反例。' WHEN n_missing > 0 AND v.label <> '不一致' AND n_weak = 0 THEN '有的条件查不到依据：' || missing WHEN n_weak > 0 THEN '有次要条件不合：' || weak END, also), '') END AS note
FROM verdict v LEFT JOIN mode m USING (pattern_id) LEFT JOIN h ON h.label_id = v.label_id LEFT JOIN also ON also.label_id = v.label_id""")
def verdict_notes(spark, sf_dir):
    return R.verdict_rows(reports(spark, sf_dir)).select("label_id", "pattern_id", "source", "note")


@query(LABELS + _RISK + """, placed AS (SELECT f.label_id, f.nutrient, lv, ord, floor(weight::DOUBLE / sum(weight::DOUBLE) OVER (PARTITION BY f.label_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 1000 + 0.5) / 1000 AS contribution FROM fac f JOIN conf USING (label_id) WHERE confidence >= 0.6)
SELECT label_id, (row_number() OVER (PARTITION BY label_id ORDER BY lv DESC, contribution DESC, ord) - 1)::INT AS place, nutrient FROM placed""")
def risk_factors_in_order(spark, sf_dir):
    return R.factor_rows(reports(spark, sf_dir)).select("label_id", "place", "nutrient")


@query(_ALLERGEN + " SELECT label_id, code, (row_number() OVER (PARTITION BY label_id, code ORDER BY level DESC, ingredient) - 1)::INT AS place, ingredient FROM best WHERE r = 1")
def allergen_matches_in_order(spark, sf_dir):
    alerts = R.alert_rows(reports(spark, sf_dir)).select("label_id", "code", "matched")
    return R.exploded(alerts, "matched", "label_id", "code", called="m", place="place").select("label_id", "code", "place", "m.ingredient")


_REASONS = values([(p, k, t, g, f, n, v, lv, n or (g[0] if g else plain.document("populations")["populations"][p]["rules"][k]["id"]), plain.document("populations")["populations"][p]["rules"][k].get("unit")) for p, k, t, g, f, n, v, lv in _POP_RULES], "population, ord, type, groups, functions, nutrient, value, lv, concern, unit")
_PER = "floor(n.value * 100.0 / n.amount * 100 + 0.5) / 100"


@query(LABELS + _RISK + f""", rule AS {_REASONS},
fired AS (SELECT s.label_id, r.population, r.ord, r.lv, r.concern, '每 100 含' || r.nutrient || ' ' || ({_NUMBER.format(f'({_PER})')}) || r.unit || '，到了提示线' AS reason FROM scored s JOIN rule r ON r.type = 'nutrition_min_warn' JOIN nut n ON n.label_id = s.label_id AND n.name = r.nutrient AND n.kind IS NOT NULL AND n.value * 100.0 / n.amount >= r.value
  UNION ALL SELECT s.label_id, r.population, r.ord, r.lv, r.concern, CASE r.type WHEN 'ingredient_group_warn' THEN '宜留意配料：' || string_agg(raw, '、' ORDER BY pos) ELSE '宜留意添加剂：' || string_agg({_WITH_FUNCTION}, '、' ORDER BY pos) END
  FROM scored s JOIN rule r ON r.type <> 'nutrition_min_warn' JOIN ing i ON i.label_id = s.label_id AND ((r.type = 'ingredient_group_warn' AND list_has_any(i.groups, r.groups)) OR (r.type = 'additive_warn' AND i.is_additive AND (r.functions IS NULL OR list_contains(r.functions, i.func)))) GROUP BY s.label_id, r.population, r.ord, r.lv, r.concern, r.type),
one AS (SELECT *, row_number() OVER (PARTITION BY label_id, population, concern ORDER BY lv DESC, ord) AS k, min(ord) OVER (PARTITION BY label_id, population, concern) AS first FROM fired),
told AS (SELECT label_id, population, string_agg(reason, '；' ORDER BY lv DESC, first) AS reasons FROM one WHERE k = 1 GROUP BY ALL)
SELECT s.label_id, p.population, coalesce(reasons, '') AS reasons FROM scored s CROSS JOIN {values([(p,) for p in KB.populations], 'population')} p LEFT JOIN told t ON t.label_id = s.label_id AND t.population = p.population""")
def population_reasons(spark, sf_dir):
    return R.population_rows(reports(spark, sf_dir)).select("label_id", "population", F.array_join("reasons", "；").alias("reasons"))


def _texts(spark, sf_dir):
    """The labels as texts: the nutrition table and the claims in one text each, some empty, with doubts and checks by hand."""
    k = F.col("key")
    ten = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    claim = F.get(F.array(*map(F.lit, CLAIMS)), (k % len(CLAIMS)).cast("int"))
    text = F.concat(F.lit("营养成分表：糖 "), ten(k * 37 % 300), F.lit("g，钠："), (k * 53 % 900).cast("string"), F.lit("毫克；脂肪 "), ten(k * 17 % 250), F.lit("g/100g"))
    return labels(spark, sf_dir).select(
        "label_id", F.when(k % 9 > 0, F.col("ingredients_text")).alias("ingredients_text"), F.when(k % 6 > 0, text).otherwise("").alias("nutrition_text"), F.when(k % 8 > 0, F.concat(F.lit(" "), claim, F.lit("，,、"))).alias("claims_text"),
        F.col("confidence"), F.slice(F.array(F.lit("配料"), F.lit(" "), F.lit("糖 "), F.lit("钠"), F.lit("脂肪")), F.lit(1), (k % 6).cast("int")).alias("uncertain"), (k % 7 == 0).alias("human_verified"),
    )


@query(LABELS.rstrip().rstrip(",") + """, t AS (SELECT k, label_id, conf AS given, list_filter(['配料', '', '糖', '钠', '脂肪'][1:(k % 6)::INT], lambda x: x <> '') AS doubts, k % 7 = 0 AS by_hand, k % 9 = 0 AS no_i, k % 6 = 0 AS no_n, k % 8 = 0 AS no_c FROM lab),
u AS (SELECT *, greatest(floor(least(1.0, greatest(0.0, CASE WHEN by_hand THEN greatest(given * (1.0::DOUBLE - least(len(doubts), 3) * 0.08::DOUBLE), 0.9) ELSE given * (1.0::DOUBLE - least(len(doubts), 3) * 0.08::DOUBLE) END)) * 10000 + 0.5) / 10000, 0) AS conf_ocr, least(CASE WHEN no_i THEN 0.3 ELSE 1.0 END, CASE WHEN no_n THEN 0.75 ELSE 1.0 END)::DOUBLE AS conf_struct, CASE WHEN no_i THEN 1.0 ELSE conf_normalize END::DOUBLE AS normal FROM t JOIN sums USING (label_id)),
c AS (SELECT *, floor(least(conf_ocr, conf_struct, normal) * 10000 + 0.5) / 10000 AS confidence, list_filter([CASE WHEN no_i THEN '配料表' END, CASE WHEN no_n THEN '营养成分表' END, CASE WHEN no_c THEN '宣称语' END], lambda x: x IS NOT NULL) AS missing FROM u),
w AS (SELECT *, list_filter([CASE WHEN len(missing) > 0 THEN '标签上没有读到：' || array_to_string(missing, '、') END, CASE WHEN normal < 0.8 AND NOT no_i THEN '认不出的配料较多' END, CASE WHEN conf_ocr < 0.8 THEN '文字识别不太可靠' END], lambda x: x IS NOT NULL) AS why FROM c)
SELECT label_id, conf_ocr::DOUBLE AS conf_ocr, conf_struct, normal AS conf_normalize, confidence, confidence < 0.6 AS rejected, CASE WHEN confidence < 0.6 THEN CASE WHEN len(why) > 0 THEN array_to_string(why, '；') ELSE '可用的信息太少' END || '。请补上文字，或换一张更清楚的图片再试。' END AS reject_reason,
 CASE WHEN by_hand THEN '' ELSE array_to_string(doubts, ',') END AS uncertain, array_to_string(missing, ',') AS missing_fields, CASE WHEN no_n THEN 0 ELSE 3 END::INT AS n_nutrition, CASE WHEN no_c THEN 0 ELSE 1 END::INT AS n_claims FROM w""")
def text_labels_verified(spark, sf_dir):
    """Labels given as texts from end to end: what is missing, doubts, checks by hand, confidences, and why a label is refused."""
    r = verify(_texts(spark, sf_dir))
    return r.select("label_id", "conf_ocr", "conf_struct", "conf_normalize", "confidence", "rejected", "reject_reason", F.array_join("uncertain", ",").alias("uncertain"), F.array_join("missing_fields", ",").alias("missing_fields"), F.size("nutrition").alias("n_nutrition"), F.size("claims").alias("n_claims"))
