"""Reports as rows: one for each verdict, condition, risk factor, population or alert.

An inner explode lets Spark infer a filter on the array's size, and it pushes that filter below every projection of the
plan, writing out the rule engine a second time in it. An outer explode infers none; the rows that it makes for null and
empty arrays are dropped by a test on what it generated, which cannot be pushed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, what: str | Column, *keep: str | Column, called: str = "x", place: str | None = None) -> DataFrame:
    """(keep, place, called): the members of an array, which are not null, with their place from 0 if that is named. Null and empty arrays have no row."""
    made = F.posexplode_outer(what).alias(place or "_place", called)
    rows = df.select(*keep, made).where(F.col(called).isNotNull())
    return rows if place else rows.drop("_place")


def settled(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A projection that later ones are not merged with: lambdas that use a column of it several times have it worked out once a row."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def verdict_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, claim, pattern_id, label, note, source, clauses, hits) of each claim; rejected labels have none."""
    return exploded(reports, "claim_verdicts", "label_id", place="place").select("label_id", "place", *(f"x.{c}" for c in ("claim", "pattern_id", "label", "note", "source", "clauses", "hits")))


def hit_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, pattern_id, ord, constraint_type, desc, status, detail, evidence, clause, severity) of each condition of each claim."""
    verdicts = exploded(reports, "claim_verdicts", "label_id", called="v", place="place").select("label_id", "place", F.col("v.pattern_id").alias("pattern_id"), F.col("v.hits").alias("hits"))
    return exploded(verdicts, "hits", "label_id", "place", "pattern_id", place="ord").select("label_id", "place", "pattern_id", "ord", "x.*")


def baseline_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, claim, pattern_id, label, hits) by the nutrition table alone; rejected labels have none."""
    return exploded(reports, "baseline_verdicts", "label_id", place="place").select("label_id", "place", *(f"x.{c}" for c in ("claim", "pattern_id", "label", "hits")))


def factor_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, nutrient, value, unit, level, contribution), most serious first."""
    return exploded(reports, F.col("risk.factors"), "label_id", place="place").select("label_id", "place", "x.*")


def population_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, population, level, score, reasons)."""
    return exploded(reports, "population_results", "label_id", place="place").select("label_id", "place", "x.*")


def alert_rows(reports: DataFrame) -> DataFrame:
    """(label_id, place, code, name, standard, clause, note, matched, certainty); rejected labels have alerts too."""
    return exploded(reports, "allergen_alerts", "label_id", place="place").select("label_id", "place", "x.*")
