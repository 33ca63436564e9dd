"""Ingredient terms to standard names: exact, then longest contained word, then fuzzy, each only for what is left.

Exact and contained words are expressions over the knowledge base as a literal. Only the fuzzy stage needs Python: an
Arrow UDF that gets the terms still unknown, mostly none, and remembers what it has worked out.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from ..functions import sql as F
from ..functions.sql import Column

from ..functions import scalars as S
from ..sources.kb import KnowledgeBase

# Fixed values.
NOISE = ("食品添加剂", "复配", "食用", "精制", "优质", "特级", "一级")
FUZZY_FROM, LONGEST_GAP = 0.86, 5

ENTRY = "standard:string,groups:array<string>,is_additive:boolean,function:string,confidence:double"
INGREDIENT = "struct<raw:string,standard:string,groups:array<string>,is_additive:boolean,function:string,confidence:double,position:int,level:int>"


def entry(kb: KnowledgeBase, raw: str, standard: str, confidence: float, fuzzy_from: str | None = None) -> dict:
    additive = next((kb.additive_index[x] for x in (standard, raw, fuzzy_from) if x in kb.additive_index), None)
    return {"standard": standard, "groups": kb.standards.get(standard, []), "is_additive": additive is not None, "function": kb.additive_function.get(additive) if additive else None, "confidence": confidence}


def exact_entries(kb: KnowledgeBase) -> dict[str, dict]:
    """Every term that is known as it stands; earlier dictionaries win."""
    out: dict[str, dict] = {}
    for f in kb.functions:
        out[f] = {"standard": f, "groups": [], "is_additive": True, "function": f, "confidence": 0.9}
        out["复配" + f] = out[f] | {"confidence": 0.85}
    out |= {t: entry(kb, t, s, 1.0) for t, s in kb.additive_index.items()}
    out |= {s: entry(kb, s, s, 1.0) for s in kb.standards}
    return out | {a: entry(kb, a, s, 1.0) for a, s in kb.aliases.items()}


def contained_entries(kb: KnowledgeBase) -> list[dict]:
    """The vocabulary, longest first, in its own order within a length."""
    words = sorted((w for w in kb.vocabulary if len(w) > 1), key=len, reverse=True)
    return [entry(kb, "", kb.aliases.get(w, w), 0.0) | {"word": w} for w in words]


def exact(term: Column, kb: KnowledgeBase) -> Column:
    table = F.from_json(F.lit(json.dumps(exact_entries(kb), ensure_ascii=False)), f"map<string,struct<{ENTRY}>>")
    return F.try_element_at(table, term)


def stripped(term: Column) -> Column:
    for p in NOISE:
        term = F.regexp_replace(term, f"^{p}", "")
    return term


def contained(term: Column, kb: KnowledgeBase) -> Column:
    table = F.from_json(F.lit(json.dumps(contained_entries(kb), ensure_ascii=False)), f"array<struct<word:string,{ENTRY}>>")

    def longest(t: Column) -> Column:
        return F.get(F.filter(table, lambda w: t.contains(w["word"])), F.lit(0))

    def judged(best: Column) -> Column:
        n, whole = F.length(best["word"]), F.length(term)
        confidence = S.rounded(F.least(F.lit(0.98), F.lit(0.75) + F.lit(0.2) * n / F.greatest(whole, F.lit(1))), 4)
        found = F.struct(best["standard"].alias("standard"), best["groups"].alias("groups"), best["is_additive"].alias("is_additive"), best["function"].alias("function"), confidence.alias("confidence"))
        return F.when(best.isNotNull() & ~((n <= 2) & (whole - n >= LONGEST_GAP)), found)

    return S.let(F.coalesce(longest(term), S.let(stripped(term), longest)), judged)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def fuzzy_match(term: str, vocabulary: list[str]) -> tuple[str, float] | None:
    """The first best word of about the term's length, if it is alike enough."""
    best, top = None, 0.0
    if len(term) > 3:  # shorter unequal terms cannot reach the threshold
        for w in vocabulary:
            d, total = abs(len(w) - len(term)), len(w) + len(term)
            if len(w) > 1 and d <= 2 and 2 * min(len(w), len(term)) / total >= max(top, FUZZY_FROM):
                r = ratio(term, w)
                if r > top:
                    best, top = w, r
    return (best, top) if best is not None and top >= FUZZY_FROM else None


def fuzzy(kb: KnowledgeBase):
    """A UDF: array of unknown terms -> array of entries, null where there is none."""
    vocabulary, memory = kb.vocabulary, {}
    entries = {w: entry(kb, "", kb.aliases.get(w, w), 0.0, w) for w in vocabulary}

    def one(term: str):
        if term not in memory:
            if len(memory) > 100_000:
                memory.clear()
            m = fuzzy_match(term, vocabulary)
            memory[term] = entries[m[0]] | {"confidence": float(int(m[1] * 1e4 + 0.5) / 1e4)} if m else None
        return memory[term]

    @pandas_udf(f"array<struct<{ENTRY}>>")
    def match(terms: pd.Series) -> pd.Series:
        return terms.map(lambda ts: [one(t) for t in ts] if ts is not None else None)

    return match.asNondeterministic()  # so that it stays a step of its own


def known(parts: Column, kb: KnowledgeBase) -> Column:
    """array<struct<raw, level>> -> array of struct(raw, term, level, hit) by the exact and the contained stage."""
    def one(p: Column) -> Column:
        hit = F.when(p["term"] != "", F.coalesce(exact(p["term"], kb), contained(p["term"], kb)))
        return F.struct(p["raw"].alias("raw"), p["term"].alias("term"), p["level"].alias("level"), hit.alias("hit"))

    return F.transform(F.transform(parts, lambda p: F.struct(p["raw"].alias("raw"), S.clean_term(p["raw"]).alias("term"), p["level"].alias("level"))), one)


def finished(parts: Column, unknown: Column, matched: Column) -> Column:
    """Known parts with the fuzzy stage's entries for the others; what is still unknown has a null standard and confidence 0."""
    def one(p: Column, i: Column) -> Column:
        hit = F.coalesce(p["hit"], F.get(matched, F.array_position(unknown, p["term"]).cast("int") - 1))
        return S.let(hit, lambda h: F.struct(
            F.when(h.isNull(), S.trim(p["raw"])).otherwise(p["term"]).alias("raw"), h["standard"].alias("standard"), F.coalesce(h["groups"], F.array().cast("array<string>")).alias("groups"),
            F.coalesce(h["is_additive"], F.lit(False)).alias("is_additive"), h["function"].alias("function"), F.coalesce(h["confidence"], F.lit(0.0)).alias("confidence"), i.alias("position"), p["level"].alias("level"),
        ))

    return F.transform(parts, one)


def with_ingredients(df, parts: str, out: str, kb: KnowledgeBase):
    """df with out: the ingredients of the array of parts in a column."""
    own = [c for c in df.columns if c != out]
    df = F.with_columns(df, {"_known": known(F.col(parts), kb)})
    df = F.with_columns(df, {"_unknown": F.array_distinct(F.transform(F.filter("_known", lambda p: p["hit"].isNull()), lambda p: p["term"]))})
    df = df.withColumn("_fuzzy", fuzzy(kb)("_unknown"))
    return F.select(df, *own, finished(F.col("_known"), F.col("_unknown"), F.col("_fuzzy")).alias(out))
