"""Queries over recognised boxes, whole nutrition texts, profiles and the history, with DuckDB SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import sql as E
from .operators import history, lookups, parse, recognition
from .plans import rows as R
from .queries import _FOUND, _VERDICT, KB, LABELS, q, query, reports, values
from .runtime import spread, table
from .sources import categories

def _k():
    return F.col("p_partkey")


def _pick(items: list[str]):
    """One of several texts for each part."""
    return F.get(F.array(*map(F.lit, items)), (_k() % len(items)).cast("int"))


def _own_parts(spark, sf_dir):
    """The columns that are used, over all cores: a part file of millions of rows is one task's scan."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


def _parts(spark, sf_dir, *columns):
    return _own_parts(spark, sf_dir).where(_k().isNotNull()).select(_k().alias("id"), *columns)


def _of_pick(rows: list[tuple], names: str, n: int) -> str:
    return f"part JOIN {values(rows, names)} x ON p_partkey % {n} = x.ord"


_TEXTS = {  # a whole table's text, and its rows as they are read
    "营养成分表：每100mL 能量 180kJ，糖 9g；钠 12mg": [("能量", 180.0, "kJ", "100mL"), ("糖", 9.0, "g", "100mL"), ("钠", 12.0, "mg", "100mL")],
    "蛋白质 3.2g/30g、脂肪 0g": [("蛋白质", 3.2, "g", "30g"), ("脂肪", 0.0, "g", "100g")],
    "无": [],
}


@query(f"SELECT p_partkey AS id, x.pos::INT AS pos, x.name, x.value::DOUBLE AS value, x.unit, x.basis FROM {_of_pick([(i, p, *r) for i, rows in enumerate(_TEXTS.values()) for p, r in enumerate(rows)], 'ord, pos, name, value, unit, basis', len(_TEXTS))}")
def nutrition_whole_text(spark, sf_dir):
    rows = E.with_columns(_parts(spark, sf_dir, _pick(list(_TEXTS)).alias("t")), {"r": parse.nutrition_text(E.col("t"), KB)})
    return R.exploded(rows, "r", "id", called="r", place="pos").select("id", "pos", "r.name", "r.value", "r.unit", "r.basis")


@query(LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + " SELECT v.label_id, 0 AS place, v.claim, v.label, b.label AS baseline FROM verdict v JOIN baseline b USING (label_id)")
def verdicts_side_by_side(spark, sf_dir):
    both = R.exploded(reports(spark, sf_dir), history.side_by_side(F.col("claim_verdicts"), F.col("baseline_verdicts")), "label_id", called="v")
    return both.select("label_id", "v.place", "v.claim", "v.label", "v.baseline")


_CODES = [("GLUTEN", "含麸质的谷物", "麸质"), ("FISH", "鱼类及其制品", "鱼类"), ("NEW", None, "NEW"), ("MILK", "乳及其制品", "乳制品"), ("EGG", "及其制品蛋", "及其制品蛋")]


@query(f"SELECT p_partkey AS id, x.code, x.short FROM {_of_pick([(i, c, s) for i, (c, _, s) in enumerate(_CODES)], 'ord, code, short', len(_CODES))}")
def allergen_short_names(spark, sf_dir):
    rows = _parts(spark, sf_dir, _pick([c for c, *_ in _CODES]).alias("code"), F.get(F.array(*(F.lit(n) for _, n, _ in _CODES)), (_k() % len(_CODES)).cast("int")).alias("name"))
    return rows.select("id", "code", categories.short_name(F.col("code"), F.col("name")).alias("short"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'batch' WHEN 2 THEN 'barcode' ELSE 'image' END AS source FROM part")
def history_sources(spark, sf_dir):
    return _parts(spark, sf_dir, history.source_of(_pick(["/a/manual.html", "/batch.html?x=1", "/barcode", "/", ""])).alias("source"))


_X = "SELECT p_partkey AS id, p_name AS t, (p_partkey + p_size) % 9 AS s, (p_size % 40)::DOUBLE AS a, (p_partkey % 31)::DOUBLE AS b, (p_partkey % 101)::DOUBLE / 4 AS c, (p_size + p_partkey % 7)::DOUBLE AS d FROM part"


@query(f"""WITH x AS ({_X}), r AS (SELECT *, CASE s WHEN 0 THEN [least(a, c, 9), least(b, d), greatest(a, c, 9), greatest(b, d)] WHEN 1 THEN [least(a, c), least(b, d), greatest(a, c), greatest(b, d)] WHEN 2 THEN [least(a, c), least(b, d), greatest(a, c), greatest(b, d)]
  WHEN 3 THEN [least(a, c), least(b, d), greatest(a, c), greatest(b, d)] WHEN 4 THEN [a, b, a + c, b + d] WHEN 5 THEN [a, b, c, b] WHEN 6 THEN [0, b, 0, d] WHEN 7 THEN [a, b, a, b + d] ELSE [0, 0, 0, 0] END AS e FROM x)
SELECT id, CASE WHEN s = 8 THEN '' ELSE t END AS text, CASE WHEN s IN (0, 2, 7) THEN c / 100 ELSE 0.0 END::DOUBLE AS confidence, e[1]::DOUBLE AS x_min, e[2]::DOUBLE AS y_min, e[3]::DOUBLE AS x_max, e[4]::DOUBLE AS y_max,
 CASE WHEN s = 3 THEN d ELSE (e[2] + e[4]) / 2 END::DOUBLE AS y_center, CASE WHEN s IN (4, 7) THEN d ELSE abs(e[4] - e[2]) END::DOUBLE AS height FROM r""")
def box_shapes(spark, sf_dir):
    """Boxes of nine shapes, their numbers as numbers and as texts, made from the table's columns; the last is no JSON."""
    size = F.col("p_size")
    a, b, c, d = (size % 40).cast("double"), (_k() % 31).cast("double"), (_k() % 101).cast("double") / 4, (size + _k() % 7).cast("double")
    t = F.to_json(F.struct(F.col("p_name").alias("text")))
    inner = F.substring(t, F.lit(2), F.length(t) - 2)  # "text":"..."
    said = F.concat(F.lit('"confidence":"'), (c / 100).cast("string"), F.lit('"'))
    shapes = [
        '{"box":[[@a,@b],["@c",@b],[@c,"@d"],[9,null],"odd"],@t,"score":@k}', '{"points":[{"x":@a,"y":"@b"},{"x":@c,"y":@d}],@t}', '{"box":null,"bbox":{"topLeft":{"x":@a,"y":@b},"bottomRight":{"x":@c,"y":@d}},@t,@s}',
        '{"points":{"topLeft":{"x":@a,"y":@b},"bottomLeft":{"x":"@c","y":@d}},@t,"yCenter":@d}', '{"left":@a,"top":@b,"width":@c,"h":@d,@t}', '{"x_min":"x","xMin":@a,"xMax":"@c","y_min":@b,@t}',
        '{"yMin":@b,"bottom":@d,"text":null,"txt":@v}', '{"box":[],"left":"@a","y_min":"","top":@b,"height":@d,@t,"score":null,"confidence":@k}', '{"text":@v',
    ]
    parts = {"a": a.cast("string"), "b": b.cast("string"), "c": c.cast("string"), "d": d.cast("string"), "k": (c / 100).cast("string"), "t": inner, "s": said, "v": F.substring(inner, F.lit(8), F.length(inner))}

    def filled(shape: str):
        return F.concat(*(parts[x] if n % 2 else F.lit(x) for n, x in enumerate(re.split("@([abcdktsv])", shape))))

    n = (_k() + size) % len(shapes)
    j = F.coalesce(*(F.when(n == i, filled(x)) for i, x in enumerate(shapes)))
    rows = _own_parts(spark, sf_dir).select(_k().alias("id"), recognition.box_of_json(j).alias("b"))
    return rows.select("id", "b.text", "b.confidence", "b.x_min", "b.y_min", "b.x_max", "b.y_max", "b.y_center", "b.height")


@query("""SELECT id, string_agg(line || ':' || x, ' ' ORDER BY line, x) AS boxes FROM (SELECT p_partkey AS id, unnest([{'line': 0, 'x': p_partkey % 50}, {'line': 0, 'x': 60 + p_partkey % 7}, {'line': 0, 'x': 90}, {'line': 1, 'x': 5}, {'line': 1, 'x': 10 + p_partkey % 80}]) AS b FROM part), LATERAL (SELECT b.line AS line, b.x AS x) GROUP BY id""")
def boxes_in_reading_order(spark, sf_dir):
    def box(line: int, x, jitter):
        return F.struct(F.lit(line).alias("line"), x.cast("double").alias("x"), (F.lit(40.0 * line) + (jitter % 9).cast("double")).alias("y"))

    boxes = F.array(box(0, F.lit(90), _k()), box(1, 10 + _k() % 80, _k() * 5), box(0, _k() % 50, _k() * 3), box(1, F.lit(5), _k() * 7), box(0, 60 + _k() % 7, _k() * 2))
    rows = _parts(spark, sf_dir, recognition.reading_order(boxes).alias("b"))
    return rows.select("id", F.array_join(F.transform("b", lambda b: F.concat(b["line"].cast("string"), F.lit(":"), b["x"].cast("int").cast("string"))), " ").alias("boxes"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE WHEN l_quantity < 5 THEN '' ELSE l_returnflag || l_linenumber END AS text, (l_linenumber * 37 + l_orderkey * 11) % 100 / 100.0::DOUBLE AS confidence FROM lineitem)
SELECT id, count(*) AS n_lines, count(*) FILTER (text <> '' AND confidence >= 0.5)::INT AS n_kept, coalesce(string_agg(text, chr(10) ORDER BY place, text) FILTER (text <> '' AND confidence >= 0.5), '') AS full_text,
 floor(list_reduce(list(confidence ORDER BY place, text) FILTER (text <> '' AND confidence >= 0.5), lambda a, b: a + b) / count(*) FILTER (text <> '' AND confidence >= 0.5) * 1e4 + 0.5) / 1e4 AS confidence, count(*) FILTER (text <> '' AND confidence >= 0.5) = 0 AS failed FROM l GROUP BY id""")
def recognised_lines_kept(spark, sf_dir):
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("place"), F.when(F.col("l_quantity") < 5, "").otherwise(F.concat("l_returnflag", n.cast("string"))).alias("text"), ((n * 37 + F.col("l_orderkey") * 11) % 100 / F.lit(100.0)).alias("confidence"))
    return recognition.kept_lines(lines, "id").select("id", "n_lines", "n_kept", "full_text", "confidence", F.col("problem").isNotNull().alias("failed"))


_CHARS = ["", "甲", "乙", "丙", " "]


@query(f"""WITH s AS (SELECT p_partkey AS id, t, [0, 1, 2, 3, 4, 5][((p_partkey // (t + 1) + t * p_partkey) % 5 + 1)::INT] AS k, (p_partkey * (t + 3) % 40 + 60) / 100.0::DOUBLE AS p FROM part, range(7) r(t)),
d AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY id ORDER BY t) AS before FROM s)
SELECT id, coalesce(string_agg({q(_CHARS)}[k + 1], '' ORDER BY t) FILTER (k <> 0 AND k <> before), '') AS text, floor(coalesce(list_reduce(list(p ORDER BY t) FILTER (k <> 0 AND k <> before), lambda a, b: a + b) / count(*) FILTER (k <> 0 AND k <> before), 0.0) * 1e4 + 0.5) / 1e4 AS confidence FROM d GROUP BY id""")
def ctc_decode(spark, sf_dir):
    def step(t: int):
        k = ((F.floor(_k() / (t + 1)) + t * _k()) % 5).cast("int")
        p = (_k() * (t + 3) % 40 + 60) / F.lit(100.0)
        return F.array(*(F.when(k == c, p).otherwise(F.lit(0.01 * c)) for c in range(len(_CHARS))))

    rows = _parts(spark, sf_dir, recognition.ctc_text(F.array(*(step(t) for t in range(7))), F.array(*map(F.lit, _CHARS))).alias("r"))
    return rows.select("id", "r.text", recognition.rounded(F.col("r.confidence"), 4).alias("confidence"))


@query("""WITH i AS (SELECT p_partkey AS id, (p_partkey * 37 % 4000 + 1)::DOUBLE AS w, (p_partkey * 101 % 3000 + 1)::DOUBLE AS h FROM part), r AS (SELECT *, CASE WHEN least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) ELSE 1.0::DOUBLE END AS ratio FROM i),
s AS (SELECT *, greatest(floor(w * ratio / 32 + 0.5) * 32, 32) AS dw, greatest(floor(h * ratio / 32 + 0.5) * 32, 32) AS dh FROM r), t AS (SELECT *, sqrt(8388608.0::DOUBLE / (dw * dh)) AS shrink FROM s)
SELECT id, CASE WHEN dw * dh > 8388608 THEN greatest(floor(dw * shrink / 32) * 32, 32) ELSE dw END::INT AS det_width, CASE WHEN dw * dh > 8388608 THEN greatest(floor(dh * shrink / 32) * 32, 32) ELSE dh END::INT AS det_height,
 greatest(least(least(greatest(floor(48 * w / h), 320), 2048), ceil(48 * w / h)), 1)::INT AS rec_width, least(greatest(floor(48 * w / h), 320), 2048)::INT AS rec_padded FROM t""")
def model_input_sizes(spark, sf_dir):
    rows = _parts(spark, sf_dir, (_k() * 37 % 4000 + 1).cast("double").alias("w"), (_k() * 101 % 3000 + 1).cast("double").alias("h"))
    rows = rows.select("id", recognition.detection_size(F.col("w"), F.col("h")).alias("d"), recognition.line_size(F.col("w"), F.col("h")).alias("l"))
    return rows.select("id", F.col("d.width").alias("det_width"), F.col("d.height").alias("det_height"), F.col("l.width").alias("rec_width"), F.col("l.padded").alias("rec_padded"))


_CORNERS = 7


@query(f"""WITH p AS (SELECT p_partkey AS id, i, ((p_partkey * (i * 7 + 3) + p_size * i) % 29)::DOUBLE AS x, CASE WHEN p_partkey % 10 = 0 THEN 2 * ((p_partkey * (i * 7 + 3) + p_size * i) % 29) WHEN p_partkey % 7 = 0 AND i > 2 THEN 4 ELSE (p_partkey * (i * 11 + 5) + p_size * (i + 1)) % 23 END::DOUBLE AS y FROM part, range({_CORNERS}) r(i)),
d AS (SELECT DISTINCT id, x, y FROM p), e AS (SELECT a.id, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS n FROM d a JOIN d b ON a.id = b.id AND (a.x, a.y) <> (b.x, b.y)),
m AS (SELECT e.id, px, py, qx, qy, min((qx - px) * (y - py) - (qy - py) * (x - px)) AS left_of, max((qx - px) * (y - py) - (qy - py) * (x - px)) AS right_of, min((x - px) * (qx - px) + (y - py) * (qy - py)) AS first, max((x - px) * (qx - px) + (y - py) * (qy - py)) AS last, min((x - px) * (qx - px) + (y - py) * (qy - py)) FILTER ((qx - px) * (y - py) = (qy - py) * (x - px)) AS first_on, max((x - px) * (qx - px) + (y - py) * (qy - py)) FILTER ((qx - px) * (y - py) = (qy - py) * (x - px)) AS last_on, max(n) AS n FROM e JOIN d USING (id) GROUP BY ALL),
h AS (SELECT * FROM m WHERE left_of >= 0 AND right_of > 0 AND first_on >= 0 AND last_on <= n * n + 1e-9),
poly AS (SELECT id, sum(px * qy - qx * py) / 2 AS area, string_agg(px::INT || ',' || py::INT, ' ' ORDER BY px, py) AS hull, count(*)::INT AS n_corners, floor(min((last - first) / n * (right_of / n)) * 1000 + 0.5) / 1000 AS rectangle, floor(sum(n) * 1000 + 0.5) / 1000 AS perimeter FROM h GROUP BY id)
SELECT id, hull, n_corners, floor(area * 1000 + 0.5) / 1000 AS area, perimeter, rectangle, coalesce((SELECT count(*) FROM h WHERE h.id = i.id AND (qx - px) * (9.589 - py) - (qy - py) * (11.317 - px) > 0) = n_corners, false) AS inside FROM (SELECT DISTINCT id FROM d) i LEFT JOIN poly USING (id)""")
def polygon_measures(spark, sf_dir):
    """Hulls of seven points of each part, some repeated, on a line or inside; their area, way around, smallest rectangle, and whether a point is inside."""
    size = F.col("p_size")

    def corner(i: int):
        x = (_k() * (i * 7 + 3) + size * i) % 29
        y = F.when(_k() % 10 == 0, 2 * x)
        if i > 2:
            y = y.when(_k() % 7 == 0, F.lit(4))
        return F.struct(x.cast("double").alias("x"), y.otherwise((_k() * (i * 11 + 5) + size * (i + 1)) % 23).cast("double").alias("y"))

    rows = _parts(spark, sf_dir, F.array(*map(corner, range(_CORNERS))).alias("p")).transform(lambda d: R.settled(d, "id", recognition.convex_hull(F.col("p")).alias("h")))
    h = F.col("h")
    told = F.array_join(F.transform(F.array_sort(h), lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), " ")
    return rows.select(
        "id", told.alias("hull"), F.when(h.isNotNull(), F.size(h)).alias("n_corners"), recognition.rounded(recognition.polygon_area(h), 3).alias("area"), recognition.rounded(recognition.polygon_perimeter(h), 3).alias("perimeter"),
        recognition.rounded(recognition.smallest_rectangle(h)["area"], 3).alias("rectangle"), F.coalesce(recognition.in_polygon(F.lit(11.317), F.lit(9.589), h), F.lit(False)).alias("inside"),
    )


_OWN = [(c, x["name"], KB.allergens["clause_map"].get(x["standard"], x["standard"])) for c, x in KB.allergens["categories"].items()]
_DOCUMENTS = [
    ('{"categories": [{"code": "A", "name": "甲", "standard": "GB 7718"}, {"name": "no code"}, {"code": "B", "clause": "条"}]}', [("A", "甲", "GB 7718"), ("B", "B", "条")]),
    ('{"categories": {"C": {"standard": "GB 7718"}, "D": {"name": "丁", "standard": "X"}}, "clause_map": {"X": "X 附录"}}', [("C", "C", "GB 7718-2011 附录 C"), ("D", "丁", "X 附录")]),
    ('{"categories": []}', _OWN),
    ("not JSON", _OWN),
]


@query(f"SELECT p_partkey AS id, x.pos::INT AS pos, x.code, x.name, x.clause FROM {_of_pick([(i, p, *r) for i, (_, rows) in enumerate(_DOCUMENTS) for p, r in enumerate(rows)], 'ord, pos, code, name, clause', len(_DOCUMENTS))}")
def allergen_category_sources(spark, sf_dir):
    rows = categories.with_categories(_parts(spark, sf_dir, _pick([d for d, _ in _DOCUMENTS]).alias("t")), "t")
    return R.exploded(rows, "categories", "id", called="c", place="pos").select("id", "pos", "c.code", "c.name", "c.clause")


_ALIAS = {"糖类": "糖", "糖份": "糖", "钠盐": "钠"}


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 END::DOUBLE AS sugar FROM part")
def nutrition_by_alias(spark, sf_dir):
    row = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    kinds = F.array(F.array(row("糖份", 9.0), row("糖", 1.0)), F.array(row("糖份", 8.0), row("糖类", 2.0)), F.array(row("钠", 5.0), row("糖份", 3.0)), F.array(row("钠", 5.0)))
    return _parts(spark, sf_dir, lookups.nutrition_value(F.get(kinds, (_k() % 4).cast("int")), "糖", _ALIAS)["value"].alias("sugar"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c' ELSE '' END AS verdicts, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS n FROM part")
def tolerant_history(spark, sf_dir):
    rows = _parts(spark, sf_dir, history.tolerant_rows(_pick(['[{"verdict": "a"}, {"verdict": "b", "other": 1}]', '[{"verdict": "c"}]', '{"verdict": "d"}', "[{broken", ""]), "verdict:string").alias("r"))
    return rows.select("id", F.array_join(F.transform("r", lambda r: r["verdict"]), ",").alias("verdicts"), F.size("r").alias("n"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '糖' WHEN 1 THEN '白糖' END AS raw, CASE p_partkey % 3 WHEN 1 THEN '白砂糖' END AS standard, CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 0 END::INT AS n_words FROM part")
def ingredient_and_word_shapes(spark, sf_dir):
    given = F.get(F.array(F.lit("糖"), F.lit('{"raw": "白糖", "standard": "白砂糖"}'), F.lit("{}")), (_k() % 3).cast("int"))
    words = F.get(F.array(F.lit('{"蛋": ["蛋白质", 5], "豆": null}'), F.lit("{broken"), F.lit(None).cast("string")), (_k() % 3).cast("int"))
    rows = _parts(spark, sf_dir, recognition.ingredient_of(given).alias("i"), recognition.word_map(words).alias("w"))
    return rows.select("id", "i.raw", "i.standard", F.coalesce(F.size(F.try_element_at("w", F.lit("蛋"))), F.lit(0)).alias("n_words"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(range(least(p_partkey % 9 + 1, 6)), lambda i: 'x' || i), '、') AS shown FROM part")
def alert_ingredients_shown(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(0).cast("long"), 2 * (_k() % 9 + 1) - 1), lambda i: F.struct(F.concat(F.lit("x"), F.floor(i / 2).cast("string")).alias("ingredient")))
    return _parts(spark, sf_dir, history.shown_ingredients(names).alias("shown"))
