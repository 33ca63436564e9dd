"""Weighted nutrition risk, and what it means for each population."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import sql as F
from ..functions.sql import Column

from ..functions import scalars as S
from ..sources.kb import KnowledgeBase
from . import rules

FOCUS = 1.5  # a population's weight has to be above this to make a nutrient its focus
FACTOR = "struct<nutrient:string,value:double,unit:string,level:string,contribution:double>"


def level_of_score(score: Column, kb: KnowledgeBase) -> Column:
    return F.when(score >= float(kb.thresholds["score_high"]), F.lit("高")).when(score >= float(kb.thresholds["score_medium"]), F.lit("中")).otherwise(F.lit("低"))


def level_score(level: Column, kb: KnowledgeBase) -> Column:
    return F.element_at(S.literal_map({k: float(v) for k, v in kb.thresholds["scores"].items()}), level)


def factors(kb: KnowledgeBase) -> Column:
    """array of struct(ord, nutrient, value, unit, level, weight, score) of the risk nutrients that the label has, on rules.with_evidence()."""
    def one(k: int, nutrient: str, cfg: dict) -> Column:
        def row(value: Column) -> Column:
            level = S.band(value, F.lit(float(cfg["medium"])), F.lit(float(cfg["high"])))
            return F.when(value.isNotNull(), F.struct(F.lit(k).alias("ord"), F.lit(nutrient).alias("nutrient"), S.rounded(value, 3).alias("value"), F.lit(cfg["unit"]).alias("unit"), level.alias("level"), F.lit(float(cfg["weight"])).alias("weight"), level_score(level, kb).alias("score")))

        return S.let(S.per_100(F.col(f"_i_{nutrient}"), F.lit(cfg["unit"])), row)

    return F.array_compact(F.array(*(one(k, n, cfg) for k, (n, cfg) in enumerate(kb.thresholds["risk"].items()))))


def risk(found: Column, kb: KnowledgeBase) -> Column:
    """struct(level, score, raw, factors); factors by level, then contribution, then in their own order."""
    none = F.struct(F.lit("未知").alias("level"), F.lit(0.0).alias("score"), F.array().cast(f"array<{FACTOR}>").alias("factors"))

    def weighed(t: Column) -> Column:
        rows = F.transform(found, lambda f: F.struct((-S.level_order(f["level"])).alias("a"), (-S.rounded(f["weight"] / t["w"], 3)).alias("b"), f["ord"].alias("c"), f.alias("f")))
        listed = F.transform(F.array_sort(rows), lambda r: F.struct(r["f"]["nutrient"].alias("nutrient"), r["f"]["value"].alias("value"), r["f"]["unit"].alias("unit"), r["f"]["level"].alias("level"), (-r["b"]).alias("contribution")))
        return S.let(t["s"] / t["w"], lambda raw: F.struct(level_of_score(raw, kb).alias("level"), S.rounded(raw, 3).alias("score"), listed.alias("factors")))

    sums = F.aggregate(found, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda a, f: F.struct((a["w"] + f["weight"]).alias("w"), (a["s"] + f["score"] * f["weight"]).alias("s")))
    return F.when(F.size(found) == 0, none).otherwise(S.let(sums, weighed))


def with_populations(df: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """df with population_results, array<struct<population, level, score, reasons>> in the populations' order, from _factors and risk."""
    cfgs = list(kb.populations.items())
    none = F.array().cast("array<struct<ord:int,concern:string,level:string,reason:string>>")
    df = F.with_columns(df, {f"_p{k}": F.array_compact(F.array(*(_rule(j, r) for j, r in enumerate(cfg["rules"])))) if cfg["rules"] else none for k, (_, cfg) in enumerate(cfgs)})
    df = F.with_columns(df, {f"_q{k}": _population(name, cfg, F.col("_factors"), F.col("risk"), F.col(f"_p{k}"), kb) for k, (name, cfg) in enumerate(cfgs)})
    df = F.with_columns(df, {"population_results": F.array(*(F.col(f"_q{k}") for k in range(len(cfgs))))})
    return df.drop(*(f"_{x}{k}" for x in "pq" for k in range(len(cfgs))))


def _population(name: str, cfg: dict, found: Column, base: Column, all_hits: Column, kb: KnowledgeBase) -> Column:
    focus = [n for n, w in cfg["weights"].items() if w > FOCUS]
    top = F.array_max(F.transform(F.filter(found, lambda f: f["nutrient"].isin(focus)), lambda f: f["score"])) if focus else F.lit(None).cast("double")
    score = F.when(top > base["score"], S.rounded(top, 3)).otherwise(base["score"])
    level = F.when(top.isNotNull(), level_of_score(F.greatest(base["score"], top), kb)).otherwise(base["level"])
    def merged(hits: Column) -> Column:
        rule_level = F.aggregate(hits, F.lit("低"), lambda a, h: S.max_level(a, h["level"]))
        # For each concern its highest level, the first of equals, where the concern first came up.
        best = F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o["concern"] == h["concern"]) & ((S.level_order(o["level"]) > S.level_order(h["level"])) | ((o["level"] == h["level"]) & (o["ord"] < h["ord"])))))
        ordered = F.array_sort(F.transform(best, lambda h: F.struct((-S.level_order(h["level"])).alias("a"), F.array_min(F.transform(F.filter(hits, lambda o: o["concern"] == h["concern"]), lambda o: o["ord"])).alias("b"), h["reason"].alias("reason"))))
        return F.struct(rule_level.alias("level"), F.transform(ordered, lambda x: x["reason"]).alias("reasons"))

    def told(m: Column) -> Column:
        final = F.when(base["level"] == "未知", F.when(m["level"] != "低", m["level"]).otherwise(F.lit("未知"))).otherwise(S.max_level(level, m["level"]))
        return F.struct(F.lit(name).alias("population"), final.alias("level"), score.alias("score"), m["reasons"].alias("reasons"))

    return S.let(S.let(all_hits, merged), told)


def _rule(k: int, r: dict) -> Column:
    """A rule's hit, or null."""
    concern = r.get("nutrient") or (r["groups"][0] if r.get("groups") else r["id"])

    def hit(when: Column, reason: Column) -> Column:
        return F.when(when, F.struct(F.lit(k).alias("ord"), F.lit(concern).alias("concern"), F.lit(r["level"]).alias("level"), reason.alias("reason")))

    if r["type"] == "ingredient_group_warn":
        x = F.col(rules.group_column(r["groups"]))
        return hit(F.size(x) > 0, F.concat(F.lit("宜留意配料："), rules.names(x)))
    if r["type"] == "nutrition_min_warn":
        value = S.per_100(F.col(f"_i_{r['nutrient']}"), F.lit(r["unit"]))
        return S.let(value, lambda v: hit(F.coalesce(v >= float(r["value"]), F.lit(False)), F.concat(F.lit(f"每 100 含{r['nutrient']} "), S.number_text(S.rounded(v, 2)), F.lit(f"{r['unit']}，到了提示线"))))
    x = F.col(rules.additive_column(r.get("functions")))
    return hit(F.size(x) > 0, F.concat(F.lit("宜留意添加剂："), rules.with_function(x)))
