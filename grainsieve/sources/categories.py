"""Allergen categories from JSON text of two shapes, with the package's own where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kb import KnowledgeBase, knowledge_base

# Short names of categories.
SHORT = {"GLUTEN": "麸质", "CRUSTACEAN": "甲壳类", "MOLLUSC": "软体动物", "MILK": "乳制品"}
ENDING = "及其制品"
CATEGORY = "array<struct<code:string,name:string,clause:string,note:string>>"


def categories(text: Column) -> Column:
    """CATEGORY from {"categories": [...]} or {"categories": {code: {...}}, "clause_map": {...}}; null if neither holds one.

    Of an array, entries without a code go, and a missing clause is the standard. Of a map, the clause is the
    standard's by the document's clause_map or the package's, or else the standard itself. Names default to the code.
    """
    known = knowledge_base().allergens["clause_map"]
    whole = F.get_json_object(text, "$.categories")
    own = F.coalesce(F.from_json(F.get_json_object(text, "$.clause_map"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    none = F.lit("")

    def or_else(x: Column, y: Column) -> Column:
        return F.when(F.coalesce(x, none) != "", x).otherwise(y)

    def row(code: Column, x: Column, clause: Column) -> Column:
        return F.struct(code.alias("code"), or_else(x["name"], code).alias("name"), clause.alias("clause"), F.coalesce(x["note"], none).alias("note"))

    fields = "name:string,standard:string,clause:string,note:string"
    listed = F.from_json(F.when(whole.startswith("["), whole), f"array<struct<code:string,{fields}>>")
    of_list = F.filter(F.transform(listed, lambda x: row(x["code"], x, or_else(x["clause"], F.coalesce(x["standard"], none)))), lambda r: F.coalesce(r["code"], none) != "")
    mapped = F.from_json(F.when(whole.startswith("{"), whole), f"map<string,struct<{fields}>>")
    package = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))

    def of_entry(e: Column) -> Column:
        standard = F.coalesce(e["value"]["standard"], none)
        clause = F.coalesce(F.try_element_at(own, standard), F.try_element_at(package, standard), standard)
        return row(e["key"], e["value"], clause)

    found = F.coalesce(of_list, F.transform(F.map_entries(mapped), of_entry))
    return F.when(F.size(found) > 0, found)


def built_in(kb: KnowledgeBase | None = None) -> Column:
    """The package's own categories."""
    kb = kb or knowledge_base()
    rows = [(c, x["name"], kb.allergens["clause_map"].get(x["standard"], x["standard"]), x["note"] or "") for c, x in kb.allergens["categories"].items()]
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("code", "name", "clause", "note"), strict=True))) for r in rows))


def with_categories(sources: DataFrame, text: str, out: str = "categories") -> DataFrame:
    """sources with their categories; the package's own for null, broken or empty documents, so that a list is never blank."""
    return sources.withColumn(out, F.coalesce(categories(F.col(text)), built_in()))


def short_name(code: Column, name: Column) -> Column:
    """A category's short name: a fixed one, or the name without its ending."""
    table = F.create_map(*(F.lit(v) for kv in SHORT.items() for v in kv))
    plain = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(code)
    return F.coalesce(F.try_element_at(table, code), F.regexp_replace(plain, ENDING + "$", ""))
