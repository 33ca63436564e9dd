"""Searches over the knowledge base, batch and history summaries, record unpivoting and field differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 20
RECORD_KEYS = {  # fixed values: keys of a product record, their names and units
    "energy-kj_100g": ("能量", "kJ"), "proteins_100g": ("蛋白质", "g"), "fat_100g": ("脂肪", "g"), "saturated-fat_100g": ("饱和脂肪", "g"), "carbohydrates_100g": ("碳水化合物", "g"),
    "sugars_100g": ("糖", "g"), "fiber_100g": ("膳食纤维", "g"), "sodium_100g": ("钠", "g"), "calcium_100g": ("钙", "g"),
}


def clause_search(keywords: DataFrame, clauses: DataFrame) -> DataFrame:
    """(keyword, id, standard) of the clauses that hold each distinct keyword in any field. The clauses are a document's few rows, which every keyword is tried against."""
    held = F.concat_ws("", "id", "standard", "section", "summary", "usage")
    return keywords.select("keyword").distinct().join(F.broadcast(clauses.withColumn("_held", held)), F.expr("contains(_held, keyword)")).select("keyword", "id", "standard")


def clauses_by_standard(cited: DataFrame, clauses: DataFrame) -> DataFrame:
    """cited (id, key) -> (place, standard, n_clauses, n_keys, ids): the clauses cited by their standards, which come in order."""
    both = cited.join(F.broadcast(clauses.select("id", "standard")), "id")
    out = both.groupBy("standard").agg(F.count_distinct("id").alias("n_clauses"), F.count_distinct("key").alias("n_keys"), F.sort_array(F.collect_set("id")).alias("ids"))
    return out.select(F.row_number().over(Window.orderBy("standard")).alias("place"), "standard", "n_clauses", "n_keys", "ids")  # as few rows as there are standards


def clause_summaries(cited: DataFrame, clauses: DataFrame) -> DataFrame:
    """cited (id, ...) with summary: `standard section　summary` of the clause, or the id where no clause has it."""
    told = clauses.select("id", F.concat(F.btrim(F.concat_ws(" ", "standard", "section")), F.lit("　"), "summary").alias("summary"))
    return cited.join(F.broadcast(told), "id", "left").withColumn("summary", F.coalesce("summary", "id"))


def additive_search(asked: DataFrame, additives: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (keyword, function) -> (keyword, function, name): additives whose name or an alias holds the keyword, of the function if one is given."""
    own = asked.select("keyword", "function").distinct()
    named = own.join(F.broadcast(aliases), F.expr("contains(alias, keyword)")).select("keyword", "function", "name").distinct()
    return named.join(F.broadcast(additives.select("name", F.col("function").alias("of"))), "name").where("function IS NULL OR function = of").select("keyword", "function", "name", "of")


def additives_by_function(found: DataFrame, functions: DataFrame) -> DataFrame:
    """found (name, function) -> (ord, function, n_additives): how many different additives of each function there are, in the functions' order; functions without one are left out."""
    counts = found.groupBy("function").agg(F.count_distinct("name").alias("n_additives"))
    return counts.join(F.broadcast(functions), "function").select("ord", "function", "n_additives")


def alias_lookup(keywords: DataFrame, aliases: DataFrame, standards: DataFrame, groups: DataFrame, most: int = 60) -> DataFrame:
    """(keyword, place, alias, standard, group_names): for each distinct keyword the aliases whose text or standard name holds it, the first `most` as a listing shows them, with the names of the standard's groups."""
    met = keywords.select("keyword").distinct().join(F.broadcast(aliases), F.expr("contains(alias, keyword) OR contains(standard, keyword)"))
    hit = met.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy("ord"))).where(F.col("place") <= most)
    of = standards.select("standard", F.explode("groups").alias("code")).join(groups, "code", "left").groupBy("standard").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("name", "code"))), "、").alias("group_names"))
    return hit.join(F.broadcast(of), "standard", "left").select("keyword", "place", "alias", "standard", F.coalesce("group_names", F.lit("")).alias("group_names"))


def inconsistencies(aliases: DataFrame, standards: DataFrame, allergen_aliases: DataFrame) -> DataFrame:
    """(problem, what): aliases (alias, standard) whose standard name is unknown, and allergen aliases (code, alias) of more than one category."""
    dangling = aliases.join(standards.select("standard").distinct(), "standard", "left_anti").select(F.lit("dangling_alias").alias("problem"), F.col("standard").alias("what")).distinct()
    shared = allergen_aliases.groupBy("alias").agg(F.count_distinct("code").alias("n")).where("n > 1").select(F.lit("alias_of_two_allergens").alias("problem"), F.col("alias").alias("what"))
    return dangling.unionByName(shared)


def summary_flags(results: DataFrame, *kept: str) -> DataFrame:
    """(ok, report columns) -> the columns kept, ok, and for each row whether it counts as inconsistent, of high risk, of low confidence."""
    worst = F.exists("claim_verdicts", lambda v: v["label"] == "不一致")
    bad = F.coalesce(F.col("ok") & worst, F.lit(False))
    return results.select(*kept, "ok", bad.alias("inconsistent"), (F.col("ok") & (F.col("risk.level") == "高")).alias("high_risk"), (F.col("ok") & (F.col("confidence") < 0.75)).alias("low_confidence"))


def summary_counts(flags: DataFrame) -> DataFrame:
    """One row over the flags: totals, and the share of inconsistent labels among those that worked."""
    out = flags.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"),
        *(F.count_if(c).alias(c) for c in ("inconsistent", "high_risk", "low_confidence")),
    )
    return out.withColumn("inconsistent_pct", F.when(F.col("ok") > 0, F.floor(F.col("inconsistent") * 100 / F.col("ok") + 0.5)).otherwise(F.lit(0)).cast("long"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over (ok, report columns): totals, and the share of inconsistent labels among those that worked."""
    return summary_counts(summary_flags(results))


def worst_verdict(rejected, verdicts):
    """A report's one-word outcome."""
    has = lambda label: F.exists(verdicts, lambda v: v["label"] == label)
    return F.when(rejected, "无法判定").when(has("不一致"), "不一致").when(has("无法判定"), "无法判定").when(has("存在争议"), "存在争议").otherwise("一致")


def main_issues(verdicts):
    """Details of what was violated under inconsistent verdicts."""
    bad = F.filter(verdicts, lambda v: v["label"] == "不一致")
    return F.flatten(F.transform(bad, lambda v: F.transform(F.filter(v["hits"], lambda h: h["status"] == "violated"), lambda h: h["detail"])))


def history_rows(reports: DataFrame) -> DataFrame:
    """What the history keeps of a report; its population is the first one, whatever was chosen."""
    return reports.select(
        "label_id", F.col("product_name").alias("product"), worst_verdict(F.col("rejected"), F.col("claim_verdicts")).alias("verdict"), F.coalesce(F.size("claim_verdicts"), F.lit(0)).alias("claims"),
        F.coalesce(F.size(F.filter("claim_verdicts", lambda v: v["label"] == "不一致")), F.lit(0)).alias("violated"),
        F.get("population_results", F.lit(0))["population"].alias("population"), F.transform("allergen_alerts", lambda a: a["code"]).alias("allergens"), F.col("risk.level").alias("risk"),
    )


def newest(rows: DataFrame, key: str, at: str, tie: str, most: int = HISTORY) -> DataFrame:
    """Each key's newest rows: the bounded history ring as a table."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def latest_requests(rows: DataFrame, key: str, request: str) -> DataFrame:
    """Only each key's last request counts; results of older ones are dropped."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), request).alias("x")).select(key, "x.*")


def record_rows(records: DataFrame, key: str, nutriments: str) -> DataFrame:
    """A product record's map of numbers as nutrition rows: (key, name, value rounded to 3, unit, basis)."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.try_element_at(F.col(nutriments), F.lit(k)).alias("value"), F.lit(u).alias("unit")) for k, (n, u) in RECORD_KEYS.items()))
    flat = records.select(key, F.explode(rows).alias("r")).where("r.value is not null")
    return flat.select(key, "r.name", (F.floor(F.col("r.value") * 1000 + 0.5) / 1000).alias("value"), "r.unit", F.lit("100g").alias("basis"))


def record_state(status, body):
    """The four outcomes of asking a product database: ok, not_found, server_error, network."""
    return F.when(status.isNull(), "network").when(status >= 500, "server_error").when((status == 404) | body.isNull(), "not_found").otherwise("ok")


def field_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, names of changed fields), for keys of both sides."""
    fields = [c for c in before.columns if c != key and c in after.columns]
    both = before.alias("b").join(after.alias("a"), key)
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in fields)))
    return both.select(key, changed.alias("changed"))


def nutrition_value(rows, nutrient: str, aliases: dict[str, str]):
    """The first row of a nutrient's name, or else of the first alias that stands for it; null if there is none. For rows that this package did not parse: its own parser puts standard names."""
    named = lambda name: F.get(F.filter(rows, lambda r: r["name"] == name), F.lit(0))
    return F.coalesce(*(named(n) for n in [nutrient, *(a for a, s in aliases.items() if s == nutrient)]))


def document_counts(dims: dict[str, DataFrame], used: DataFrame) -> DataFrame:
    """(kind, n, n_used): how many additives, aliases, standard names and allergen aliases a knowledge base has, and how many of them are among the distinct names of used (name)."""
    columns = {"additive": "name", "alias": "alias", "standard": "standard", "allergen_alias": "alias"}
    every = reduce(DataFrame.unionByName, (dims[k].select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in columns.items()))
    seen = used.select("name").distinct().withColumn("seen", F.lit(1))
    return F.broadcast(every).join(seen, "name", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("seen").alias("n_used"))
