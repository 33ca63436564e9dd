"""Scalar functions as Column expressions, with the number and white-space rules of the label format."""

from __future__ import annotations

from . import sql as F
from .sql import Column

SPACES = "\t\n\x0b\x0c\r                  　﻿"

# Unit factors.
MASS = {"g": 1.0, "gram": 1.0, "克": 1.0, "mg": 0.001, "毫克": 0.001, "ug": 0.000001, "μg": 0.000001, "微克": 0.000001, "kg": 1000.0, "千克": 1000.0}
ENERGY = {"kj": 1.0, "千焦": 1.0, "kcal": 4.184, "大卡": 4.184, "千卡": 4.184, "cal": 0.004184, "卡": 0.004184}
LEVELS = {"低": 0, "中": 1, "高": 2, "未知": -1}


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def literal_map(values: dict) -> Column:
    return F.expr("map(" + ", ".join(F.lit(x).text for kv in values.items() for x in kv) + ")")


def trim(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def clean_term(text: Column) -> Column:
    t = F.translate(trim(F.coalesce(text, F.lit(""))), "　\t\n ", "")
    return strip(t, "、,，;；.。")


def rounded(value: Column, digits: int) -> Column:
    """Half goes up, on the binary product."""
    f = float(10**digits)
    return F.floor(value * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def number(text: Column) -> Column:
    """The number that a text begins with, or null."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def number_text(value: Column) -> Column:
    """A number as text: whole ones without a point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))


def unit_key(unit: Column) -> Column:
    return F.replace(F.lower(trim(F.coalesce(unit, F.lit("")))), F.lit(" "), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(values: dict[str, float]) -> Column:
    return literal_map(values)


def convert(value: Column, from_: Column, to: Column) -> Column:
    """By mass, else by energy; null where units do not match."""
    def by(x: Column, factors: dict[str, float]) -> Column:
        return x["v"] * F.try_element_at(_table(factors), x["a"]) / F.try_element_at(_table(factors), x["b"])

    asked = F.struct(value.alias("v"), unit_key(from_).alias("a"), unit_key(to).alias("b"))
    return let(asked, lambda x: F.when(x["a"] == x["b"], x["v"]).otherwise(F.coalesce(by(x, MASS), by(x, ENERGY))))


def basis_kind(basis: Column) -> Column:
    b = F.lower(trim(F.coalesce(basis, F.lit(""))))
    return F.when(b.contains("ml") | b.contains("毫升") | (b == "l"), F.lit("liquid")).when(b.contains("g") | b.contains("克"), F.lit("solid"))


def basis_amount(basis: Column) -> Column:
    n = F.regexp_extract(trim(F.coalesce(basis, F.lit(""))), r"(\d+(?:\.\d+)?)", 1)
    v = F.when(n != "", n.cast("double"))
    return F.when(v > 0, v).otherwise(F.lit(100.0))


def region_basis(text: Column) -> Column:
    """A whole table's basis from `每 N unit`, or null."""
    n = F.regexp_extract(text, r"(?i)每\s*(\d+)\s*(mL|毫升|g|克|L|升)", 1)
    u = F.lower(F.regexp_extract(text, r"(?i)每\s*(\d+)\s*(mL|毫升|g|克|L|升)", 2))
    value = n.try_cast("long")
    return F.when(n != "", F.when(u.isin("l", "升"), F.concat((value * 1000).cast("string"), F.lit("mL"))).when(u.isin("ml", "毫升"), F.concat(value.cast("string"), F.lit("mL"))).otherwise(F.concat(value.cast("string"), F.lit("g"))))


def with_basis(items: Column) -> Column:
    """Nutrition rows with their basis' kind and amount."""
    return F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["unit"].alias("unit"), x["basis"].alias("basis"), basis_kind(x["basis"]).alias("kind"), basis_amount(x["basis"]).alias("amount")))


def per_100(item: Column, to: Column) -> Column:
    """A row's value in another unit for each 100 of its basis, or null; the row comes from with_basis()."""
    return let(item, lambda x: F.when(x["kind"].isNotNull(), F.when(to == x["unit"], x["value"]).otherwise(convert(x["value"], x["unit"], to)) * F.lit(100.0) / x["amount"]))


def level_order(level: Column) -> Column:
    return F.when(level == "低", 0).when(level == "中", 1).when(level == "高", 2).otherwise(F.lit(-1))


def max_level(a: Column, b: Column) -> Column:
    best = F.greatest(F.lit(0), level_order(a), level_order(b))
    return F.when(best == 2, F.lit("高")).when(best == 1, F.lit("中")).otherwise(F.lit("低"))


def band(value: Column, medium: Column, high: Column) -> Column:
    return F.when(value >= high, F.lit("高")).when(value >= medium, F.lit("中")).otherwise(F.lit("低"))


def ean13(code: Column) -> Column:
    """struct(digits, valid, expected, region) of a bar code; the expected check digit is null unless there are 13 digits."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    total = sum((F.substring(digits, k + 1, 1).try_cast("int") * (3 if k % 2 else 1) for k in range(12)), F.lit(0))
    expected = F.when(F.length(digits) == 13, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)))
    head = F.substring(digits, 1, 3)
    # Prefix bands.
    region = F.when(head.between("690", "699"), F.lit("中国大陆（690~699）")).when(head.between("450", "459") | head.between("490", "499"), F.lit("日本（450~459 / 490~499）")).when(head.between("000", "019"), F.lit("美国/加拿大（000~019）")).when(head.between("300", "379"), F.lit("法国等（300~379）")).otherwise(F.lit("其他/未指定"))
    return F.struct(digits.alias("digits"), F.coalesce(expected == F.substring(digits, 13, 1).try_cast("int"), F.lit(False)).alias("valid"), expected.cast("int").alias("expected"), region.alias("region"))


def relative_time(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 60000)
    return F.when(minutes < 1, F.lit("刚刚")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟前"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" 小时前"))).otherwise(F.concat(F.month(at).cast("string"), F.lit("-"), F.dayofmonth(at).cast("string")))


def percent(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with {name} filled in; null values leave the name as it is."""
    for k, v in values.items():
        template = F.when(v.isNull(), template).otherwise(F.replace(template, F.lit("{" + k + "}"), v))
    return template
