"""User profiles and review forms: normalised profiles, checked rows, and where a field's value comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POPULATIONS = ("成人", "糖尿病", "高血压", "肾病", "儿童", "孕妇", "痛风")  # fixed values
SEPARATORS = r"[、,，;；\s]+"


def profiles(rows: DataFrame) -> DataFrame:
    """(user_id, allergens, population, avoid) with codes in capitals, a known population and the words to avoid as an array."""
    codes = F.array_distinct(F.filter(F.transform(F.coalesce("allergens", F.array()), lambda c: F.upper(F.btrim(c))), lambda c: c != ""))
    words = F.array_distinct(F.filter(F.split(F.coalesce("avoid", F.lit("")), SEPARATORS), lambda w: w != ""))
    return rows.select("user_id", codes.alias("allergens"), F.when(F.col("population").isin(*POPULATIONS), F.col("population")).otherwise(F.lit(POPULATIONS[0])).alias("population"), words.alias("avoid"))


def row_problem(name: Column, value: Column) -> Column:
    """What is wrong with a form's nutrition row: missing_name, missing_value, not_a_number, or null."""
    return F.when(F.btrim(F.coalesce(name, F.lit(""))) == "", "missing_name").when(F.btrim(F.coalesce(value, F.lit(""))) == "", "missing_value").when(F.btrim(value).try_cast("double").isNull(), "not_a_number")


def checked_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, name, value) -> for each key its first problem and that row's place; keys without a problem do not appear."""
    bad = rows.withColumn("problem", row_problem(F.col("name"), F.col("value"))).where(F.col("problem").isNotNull())
    return bad.groupBy(key).agg(F.min(F.struct("place", "problem")).alias("x")).select(key, "x.place", "x.problem")


def origin(edited: Column, recognised: Column) -> Column:
    """Where a field's value comes from: edited, recognised or missing."""
    return F.when(F.coalesce(edited, F.lit(False)), "edited").when(recognised.isNotNull(), "recognised").otherwise("missing")
