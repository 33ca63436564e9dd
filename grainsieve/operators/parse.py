"""Label texts into ingredients with levels, nutrition rows and claims: expressions within a row, so nothing is shuffled."""

from __future__ import annotations

import json
import re

from ..functions import sql as F
from ..functions.sql import Column

from ..functions import scalars as S
from ..sources.kb import KnowledgeBase

# Fixed patterns and words.
ANCHOR = r"^\s*(配料表|配料|原料|成分)\s*[:：]?"
NUTRITION_ANCHOR = r"^\s*(营养成分表|营养成分|营养标签)\s*[:：]?"
NOT_INGREDIENT = (
    "配料表|成分表|食品添加剂|添加剂|服务热线|客服|热线|电话|地址|委托|生产单位|生产商|生产许可|工厂代码|有限公司|公司|"
    "添加量|净含量|营养成分|营养素参考|执行标准|产品标准|标准号|许可证|保质期|贮存|储存|请置于|不宜|请勿|无需|开袋即食|开启后|漏气|"
    r"活菌数|活菌|CFU|杀菌|灭菌|辐照|www\.|http|\.com|@|NRV|Ingredient|Allergen"
)
SEPARATORS = r"[、,，;；\n|]+"
UNIT = r"(?i)^(μg|ug|µg|mg|g|kj|kcal|千焦|千卡|毫克|微克|克)"
UNITS = {"mg": "mg", "毫克": "mg", "g": "g", "克": "g", "kj": "kJ", "千焦": "kJ", "kcal": "kcal", "千卡": "kcal", "μg": "μg", "µg": "μg", "ug": "μg", "微克": "μg"}
BASIS_100 = r"(?i)每?\s*100\s*(?:mL|毫升|g|克)"
BASIS_MARKED = r"(?i)(?:每|/)\s*\d+\s*(?:mL|毫升|g|克)"

PART = "struct<raw:string,level:int>"
ITEM = "struct<name:string,value:double,unit:string,basis:string,nrv:double>"
CLAIM = "struct<raw:string,pattern_id:string,start:int,stop:int>"


def is_non_ingredient(part: Column) -> Column:
    latin = F.regexp_count(part, F.lit("[A-Za-z]"))
    return part.rlike(NOT_INGREDIENT) | part.rlike(r"^[\dA-Za-z%．.]+$") | ((latin >= 4) & (latin / F.greatest(F.length(part), F.lit(1)) > 0.5))


def split_ingredients(text: Column) -> Column:
    """array<struct<raw, level>>: parts between separators, level by bracket depth; 单 and a following 双… are one name.

    The text is cut into separators' gaps and brackets first, so the fold runs over parts and not over characters.
    """
    head = F.regexp_replace(S.trim(F.coalesce(text, F.lit(""))), ANCHOR, "")
    tokens = F.regexp_extract_all(head, F.lit(r"[（(［\[）)］\]]|[^、,，;；\n|（(［\[）)］\]]+"), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        depth, parts = state["depth"], state["parts"]
        part = S.strip(S.trim(token), " .。:：")
        opens, closes = token.isin("（", "(", "［", "["), token.isin("）", ")", "］", "]")
        last = F.get(parts, F.size(parts) - 1)
        joins = (F.size(parts) > 0) & (last["raw"] == "单") & part.startswith("双")
        joined = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.struct(F.concat(F.lit("单，"), part).alias("raw"), last["level"].alias("level"))))
        added = F.concat(parts, F.array(F.struct(part.alias("raw"), depth.alias("level"))))
        skip = opens | closes | (part == "") | is_non_ingredient(part)
        return F.struct(
            F.when(opens, depth + 1).when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth).alias("depth"),
            F.when(skip, parts).when(joins, joined).otherwise(added).cast(f"array<{PART}>").alias("parts"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().cast(f"array<{PART}>").alias("parts"))
    return F.aggregate(tokens, start, step, lambda s: s["parts"])


def _unit(text: Column) -> Column:
    """A unit's name at a text's beginning, or null."""
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in UNITS.items()) + ")")
    return F.try_element_at(table, F.lower(F.regexp_extract(text, UNIT, 1)))


def nutrient_name(name: Column, kb: KnowledgeBase) -> Column:
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in kb.nutrients.items()) + ")")
    return S.let(S.trim(F.coalesce(name, F.lit(""))), lambda key: F.coalesce(F.try_element_at(table, key), key))


def segment_basis(segment: Column) -> tuple[Column, Column]:
    """(what is left, basis) of a nutrition segment: the last mark of 100, else the last marked amount, else a serving, else 100g."""
    def mark(pattern: str) -> Column:
        last = F.try_element_at(F.regexp_extract_all(segment, F.lit(pattern), F.lit(0)), F.lit(-1))
        return F.regexp_replace(F.replace(F.replace(last, F.lit(" "), F.lit("")), F.lit("每"), F.lit("")), "^/", "")

    has_100 = segment.rlike(BASIS_100)
    has_mark = segment.rlike(BASIS_MARKED)
    serving = segment.contains("份")
    left = F.when(has_100, F.regexp_replace(segment, BASIS_100, " ")).when(has_mark, F.regexp_replace(segment, BASIS_MARKED, " ")).when(serving, F.replace(F.replace(segment, F.lit("每份"), F.lit(" ")), F.lit("份"), F.lit(" "))).otherwise(segment)
    basis = F.when(has_100, mark(BASIS_100)).when(has_mark, mark(BASIS_MARKED)).when(serving, F.lit("份")).otherwise(F.lit("100g"))
    return left, basis


def nutrition_segment(segment: Column, kb: KnowledgeBase) -> Column:
    """One `name number unit` text as a nutrition row, or null. A known name goes first, as it may hold a digit."""
    names = "^(" + "|".join(map(re.escape, kb.nutrient_names)) + ")"

    def cut(text: Column) -> Column:
        left, basis = segment_basis(text)
        return F.struct(text.alias("text"), left.alias("left"), basis.alias("basis"), F.regexp_extract(left, names, 1).alias("known"))

    def read(x: Column) -> Column:
        source = F.substring(x["left"], F.length(x["known"]) + 1, F.lit(1 << 30))
        found = F.struct(source.alias("source"), F.regexp_extract(source, r"(\d+(?:\.\d+)?)", 1).alias("digits"), F.regexp_extract(source, r"^(\D*)\d", 1).alias("front"))
        return S.let(found, lambda y: F.struct(x["text"].alias("text"), x["basis"].alias("basis"), x["known"].alias("known"), y["digits"].alias("digits"), S.trim(F.regexp_replace(S.strip(S.trim(y["front"]), " :：-—/"), r"(每|含量)\s*$", "")).alias("guess"), F.regexp_replace(F.substring(y["source"], F.length(y["front"]) + F.length(y["digits"]) + 1, F.lit(1 << 30)), "^[" + re.escape(S.SPACES) + "]+", "").alias("rest")))

    def judge(x: Column) -> Column:
        name = F.when(x["known"] != "", x["known"]).otherwise(x["guess"])
        y = F.struct(x.alias("x"), nutrient_name(name, kb).alias("name"), _unit(x["rest"]).alias("unit"))
        return S.let(y, lambda z: F.when(
            (z["x"]["text"] != "") & (z["x"]["digits"] != "") & ~((z["x"]["known"] == "") & ((z["x"]["guess"] == "") | ((F.length(z["x"]["guess"]) < 2) & (z["name"] == z["x"]["guess"])))) & ~(z["unit"].isNull() & z["x"]["rest"].rlike("^[A-Za-z]")),
            F.struct(z["name"].alias("name"), F.when(z["x"]["digits"] != "", z["x"]["digits"].cast("double")).alias("value"), F.coalesce(z["unit"], F.lit("g")).alias("unit"), z["x"]["basis"].alias("basis"), F.lit(None).cast("double").alias("nrv")),
        ))

    return S.let(S.let(S.let(S.trim(F.coalesce(segment, F.lit(""))), cut), read), judge)


def nutrition_text(text: Column, kb: KnowledgeBase) -> Column:
    """A whole table's text as nutrition rows; a basis marked for the table holds where a row has none of its own."""
    def whole(head: Column) -> Column:
        rows = F.filter(F.transform(F.split(head, SEPARATORS), lambda s: nutrition_segment(s, kb)), lambda r: r.isNotNull())
        return S.let(S.region_basis(head), lambda region: F.transform(rows, lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value"), r["unit"].alias("unit"), F.when(r["basis"] == "100g", F.coalesce(region, r["basis"])).otherwise(r["basis"]).alias("basis"), r["nrv"].alias("nrv"))))

    return S.let(F.regexp_replace(S.trim(F.coalesce(text, F.lit(""))), NUTRITION_ANCHOR, ""), whole)


def nutrition_items(items: Column, region: Column, kb: KnowledgeBase) -> Column:
    """Given rows of texts as nutrition rows; those without a number, a name or a known unit go."""
    def one(x: Column) -> Column:
        unit = S.trim(F.coalesce(x["unit"], F.lit("")))
        basis = F.when(F.coalesce(x["basis"], F.lit("")) != "", S.trim(x["basis"])).otherwise(F.coalesce(region, F.lit("100g")))
        name = S.trim(F.coalesce(x["name"], F.lit("")))
        good = S.number(x["value"]).isNotNull() & (name != "") & ~(_unit(unit).isNull() & unit.rlike("^[A-Za-zμ]"))
        row = F.struct(nutrient_name(name, kb).alias("name"), S.number(x["value"]).alias("value"), F.coalesce(_unit(unit), F.lit("g")).alias("unit"), basis.alias("basis"), S.number(x["nrv"]).alias("nrv"))
        return F.when(good, row)

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<struct<name:string,value:string,unit:string,basis:string,nrv:string>>")), one), lambda r: r.isNotNull())


def claim_matches(text: Column, kb: KnowledgeBase) -> Column:
    """array of claims in a text: longest words first take their places, none may overlap, one for each pattern (the leftmost)."""
    schema = "array<struct<word:string,id:string>>"
    words = F.from_json(F.lit(json.dumps([{"word": w, "id": p} for w, p in kb.match_words], ensure_ascii=False)), schema)
    present = F.filter(words, lambda w: text.contains(w["word"]))

    def places(w: Column) -> Column:
        n = F.length(w["word"])
        last = F.length(text) - n
        return F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, n) == w["word"])

    def take(found: Column, w: Column) -> Column:
        n = F.length(w["word"])

        def at(got: Column, i: Column) -> Column:
            new = F.struct(w["word"].alias("raw"), w["id"].alias("pattern_id"), i.alias("start"), (i + n).alias("stop"))
            clash = F.exists(got, lambda g: (i < g["stop"]) & (g["start"] < i + n))
            return F.when(clash, got).otherwise(F.concat(got, F.array(new))).cast(f"array<{CLAIM}>")

        return F.aggregate(places(w), found, at)

    found = F.aggregate(present, F.array().cast(f"array<{CLAIM}>"), take)
    return S.let(F.array_sort(found, lambda a, b: a["start"] - b["start"]), lambda ordered: F.filter(ordered, lambda c, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda d: d["pattern_id"] == c["pattern_id"])))


def claims(texts: Column, kb: KnowledgeBase) -> Column:
    """Claims of several texts; a text without a match stays, with a null pattern."""
    whole = F.filter(F.transform(texts, S.trim), lambda t: t.isNotNull() & (t != ""))
    lone = lambda t: F.array(F.struct(t.alias("raw"), F.lit(None).cast("string").alias("pattern_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop")))
    return F.flatten(F.transform(F.transform(whole, lambda t: F.struct(t.alias("t"), claim_matches(t, kb).alias("m"))), lambda x: F.when(F.size(x["m"]) > 0, x["m"]).otherwise(lone(x["t"]))))
