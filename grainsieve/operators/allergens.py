"""Allergen alerts: aliases contained in ingredient names, with guards against chance containment."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions import sql as F
from ..functions.sql import Column

from ..functions import scalars as S
from ..sources.kb import WORDING, KnowledgeBase

ALIAS = "code:string,alias:string,place:int,blocked:array<string>,ord:int"
GAP, INNER = 4, 3  # defaults: a two-character alias in a name that much longer, and the longest name with an inner one-character alias


def aliases(kb: KnowledgeBase) -> Column:
    place = {c: i for i, c in enumerate(kb.allergens["categories"])}
    rows = [{"code": c, "alias": a, "place": place[c], "blocked": kb.allergens["ambiguous"].get(a, []) + (kb.allergens["single_char"].get(a, []) if len(a) == 1 else []), "ord": i} for c, a, i in kb.allergen_aliases()]
    if not rows:
        raise ValueError("no allergen data: silence would be taken for safety")
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{ALIAS}>>")


def match(name: Column, a: Column, gap: int = GAP, inner: int = INNER) -> Column:
    """`exact`, `contains` or null for a name and an alias row."""
    n, m, at = F.length(name), F.length(a["alias"]), F.instr(name, a["alias"]) - 1
    blocked = F.exists(a["blocked"], lambda w: name.contains(w))
    inside = (at > 0) & (at < n - 1) & (n > inner)
    chance = F.when(m == 1, inside).when(m == 2, n - m >= gap).otherwise(F.lit(False))
    return F.when(name == a["alias"], F.lit("exact")).when((at >= 0) & ~blocked & ~chance, F.lit("contains"))



def detect(ingredients: Column, kb: KnowledgeBase, gap: int = GAP, inner: int = INNER) -> Column:
    """Alerts of all categories in their order, whatever a user's profile says.

    Both an ingredient's standard name and its raw name are looked at. Of several aliases of a category in an
    ingredient the exact one counts, then the longest, then the first.
    """
    table = aliases(kb)

    def hits(i: Column) -> Column:
        shown = F.coalesce(i["raw"], i["standard"])
        named = F.array_distinct(F.filter(F.array(i["standard"], i["raw"]), lambda x: F.coalesce(x, F.lit("")) != ""))

        def of_names(names: Column) -> Column:
            def one(a: Column) -> Column:
                level = F.get(F.filter(F.transform(names, lambda n: match(n, a, gap, inner)), lambda x: x.isNotNull()), F.lit(0))
                return S.let(level, lambda level: row(a, level))

            possible = F.filter(table, lambda a: F.exists(names, lambda n: n.contains(a["alias"])))
            return F.filter(F.transform(possible, one), lambda h: h["level"].isNotNull())

        def row(a: Column, level: Column) -> Column:
            return F.struct(a["code"].alias("code"), a["place"].alias("place"), shown.alias("ingredient"), F.when(level == "exact", F.lit(0)).when(level == "contains", F.lit(1)).alias("rank"), (-F.length(a["alias"])).alias("shorter"), a["ord"].alias("ord"), a["alias"].alias("alias"), level.alias("level"))

        return S.let(named, of_names)

    def best(found: Column) -> Column:
        before = lambda o, h: F.struct(*(o[c].alias(c) for c in ("rank", "shorter", "ord"))) < F.struct(*(h[c].alias(c) for c in ("rank", "shorter", "ord")))
        return F.array_distinct(F.filter(found, lambda h: ~F.exists(found, lambda o: (o["code"] == h["code"]) & (o["ingredient"] == h["ingredient"]) & before(o, h))))

    notes = {c: x["note"] or "" for c, x in kb.allergens["categories"].items()}
    meta = {c: {"name": x["name"], "standard": x["standard"], "clause": kb.allergens["clause_map"].get(x["standard"], x["standard"]), "note": notes[c] or None} for c, x in kb.allergens["categories"].items()}
    info = F.from_json(F.lit(json.dumps(meta, ensure_ascii=False)), "map<string,struct<name:string,standard:string,clause:string,note:string>>")
    codes = F.array(*map(F.lit, kb.allergens["categories"]))

    def alert(rows: Column):
        def one(code: Column) -> Column:
            mine = F.array_sort(F.transform(F.filter(rows, lambda h: h["code"] == code), lambda h: F.struct(h["rank"].alias("r"), h["ingredient"].alias("ingredient"), h["alias"].alias("alias"), h["level"].alias("level"))))
            return S.let(F.try_element_at(info, code), lambda x: F.struct(code.alias("code"), x["name"].alias("name"), x["standard"].alias("standard"), x["clause"].alias("clause"), x["note"].alias("note"), F.transform(mine, lambda h: F.struct(h["ingredient"].alias("ingredient"), h["alias"].alias("alias"), h["level"].alias("level"))).alias("matched"), F.lit(WORDING).alias("certainty")))

        return one

    return S.let(S.let(F.flatten(F.transform(ingredients, hits)), best), lambda rows: F.filter(F.transform(codes, alert(rows)), lambda a: F.size(a["matched"]) > 0))


def for_profile(alerts: Column, codes: Column) -> Column:
    """Alerts of a user's own categories, in any case of letters; none for an empty profile."""
    upper = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.upper(F.btrim(c)))
    return F.filter(alerts, lambda a: F.array_contains(upper, F.upper(a["code"])))


def not_found(alerts: Column, codes: Column) -> Column:
    """The profile's categories without an alert."""
    return F.array_except(F.transform(codes, lambda c: F.upper(F.btrim(c))), F.transform(alerts, lambda a: a["code"]))


def alert_state(alerts: Column, codes: Column) -> Column:
    mine = for_profile(alerts, codes)
    return F.when(F.size(F.coalesce(codes, F.array().cast("array<string>"))) == 0, F.lit("none")).when(F.size(mine) > 0, F.lit("hit")).otherwise(F.lit("not_found"))


def avoid_matches(ingredients: Column, words: Column) -> Column:
    """For each word to avoid that an ingredient contains: the word and the first such ingredient."""
    raws = F.transform(ingredients, lambda i: i["raw"])
    found = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.get(F.filter(raws, lambda r: r.contains(w)), F.lit(0)).alias("ingredient")))
    return F.filter(found, lambda x: x["ingredient"].isNotNull() & (x["word"] != ""))


def categories(kb: KnowledgeBase, spark) -> DataFrame:
    from ..sources.kb import dimensions

    return dimensions(spark, kb)["allergen"]
