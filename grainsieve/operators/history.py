"""The history of checks: a bounded store that reads broken entries as none, where a check came from, and its side-by-side verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookups import HISTORY, newest


def tolerant_rows(text: Column, schema: str) -> Column:
    """A JSON array of rows as array<struct>; null, broken text and anything but an array are an empty one."""
    parsed = F.from_json(text, f"array<struct<{schema}>>")
    return F.coalesce(F.when(F.btrim(text).startswith("["), F.filter(parsed, lambda r: r.isNotNull())), F.array().cast(f"array<struct<{schema}>>"))


def record(rows: DataFrame, folder: str) -> None:
    """Append a batch of history rows; nothing that is there is rewritten."""
    rows.write.mode("append").parquet(folder)


def recent(spark: SparkSession, folder: str, key: str, at: str, tie: str, most: int = HISTORY) -> DataFrame:
    """Each key's newest rows of the store, newest first by `place`."""
    return newest(spark.read.parquet(folder), key, at, tie, most)


def source_of(path: Column) -> Column:
    """How a check was entered, told by the path of its page."""
    found = F.lit("image")
    for word, source in reversed((("manual", "text"), ("batch", "batch"), ("barcode", "barcode"))):
        found = F.when(path.contains(word), source).otherwise(found)
    return found


def side_by_side(verdicts: Column, baseline: Column) -> Column:
    """Verdicts and baseline verdicts by their place: array<struct<place, claim, label, baseline>>; a missing partner is null."""
    return F.transform(verdicts, lambda v, i: F.struct(i.alias("place"), v["claim"].alias("claim"), v["label"].alias("label"), F.get(baseline, i)["label"].alias("baseline")))


def shown_ingredients(matched: Column, most: int = 6) -> Column:
    """The distinct ingredient names of an alert, the first `most` of them, as one text."""
    names = F.array_distinct(F.filter(F.transform(matched, lambda m: m["ingredient"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.array_join(F.slice(names, 1, most), "、")
