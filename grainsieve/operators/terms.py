"""Terms and names looked up as relations: every distinct one once, by hash joins with the dictionaries.

A term that no dictionary has as it stands is taken apart into its pieces of the vocabulary's lengths, which meet the
words by an equi-join; each stage sees only what the stages before have left. The last stage is a similarity join: a term
and a word become a pair only if their lengths allow the likeness asked for and they share a letter that no pair that
alike can do without; only pairs reach the exact measure. What comes out equals normalize.with_ingredients and
allergens.detect, which work within a row and so look at every word for every ingredient.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import scalars as S
from ..functions import sql as E
from ..runtime import Scratch, ship
from ..sources.kb import KnowledgeBase
from . import normalize
from .allergens import GAP, INNER

ENTRY = ["standard", "groups", "is_additive", "function"]
_FIELDS = "standard string, groups array<string>, is_additive boolean, function string"
#: Characters of a long term looked at at a time.
SEGMENT = 200


def exact_words(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """(word, entry, confidence): every term that is known as it stands."""
    return spark.createDataFrame([(w, *(e[c] for c in ENTRY), e["confidence"]) for w, e in normalize.exact_entries(kb).items()], f"word string, {_FIELDS}, confidence double")


def contained_words(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """(word, ord, entry): the vocabulary, longest first."""
    return spark.createDataFrame([(e["word"], k, *(e[c] for c in ENTRY)) for k, e in enumerate(normalize.contained_entries(kb))], f"word string, ord int, {_FIELDS}")


def similar_words(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """(word, ord, entry): the vocabulary in its own order."""
    rows = [(w, k, *(normalize.entry(kb, "", kb.aliases.get(w, w), 0.0, w)[c] for c in ENTRY)) for k, w in enumerate(kb.vocabulary) if len(w) > 1]
    return spark.createDataFrame(rows, f"word string, ord int, {_FIELDS}")


def with_pieces(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """df with piece: a row for each distinct piece of so many characters in each segment of a text; segments overlap, so no piece is missed."""
    longest = max(lengths)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(SEGMENT))
    cut = df.withColumn("_part", F.explode(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(SEGMENT + longest - 1))))).drop(text)

    def of(n: int) -> Column:
        places = F.when(F.length("_part") >= n, F.sequence(F.lit(1), F.length("_part") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.substring("_part", p, F.lit(n)))

    return cut.withColumn("piece", F.explode(F.array_distinct(F.concat(*map(of, lengths))))).drop("_part")


def _longest(terms: DataFrame, words: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, best): the longest word within each text, the first of equals."""
    met = with_pieces(terms, "text", lengths).join(F.broadcast(words), F.col("piece") == F.col("word"))
    return met.groupBy("key").agg(F.min_by(F.struct("word", *ENTRY), F.col("ord")).alias("best"))


def _tokens(text: Column) -> Column:
    """A text's letters, each with which occurrence it is, in the order of their code points: an ordered set, whatever repeats."""
    letters = F.split(text, "")
    return F.array_sort(F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string"))))


def _needed(a: Column, b: Column, least: float) -> Column:
    """How many letters texts of these lengths must share to be so alike."""
    return F.ceil((a + b) * (least / 2) - 1e-9).cast("int")


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_pairs(terms: DataFrame, words: DataFrame, least: float = normalize.FUZZY_FROM, apart: int = 2) -> DataFrame:
    """(key, text, word, ord): pairs of a text of (key, text) and a word that may be so alike, lengths at most `apart` from each other.

    Texts of a and b letters are at most 2 * shared / (a + b) alike. So of the letters in order the first a - needed + 1 of one
    and b - needed + 1 of the other have one in common, and the join is on these. Candidates must share enough letters, too.
    """
    def keys(df: DataFrame, text: str, mine: str, other: str) -> DataFrame:
        n = F.length(text)
        near = F.filter(F.transform(F.sequence(F.lit(-apart), F.lit(apart)), lambda d: n + d), lambda m: (m > 1) & (2 * F.least(n, m) >= least * (n + m) - 1e-9))
        df = df.withColumn("tokens", _tokens(F.col(text))).withColumn(mine, n).withColumn(other, F.explode(near))
        first = F.slice("tokens", F.lit(1), F.col(mine) - _needed(F.col(mine), F.col(other), least) + 1)
        return df.withColumn("token", F.explode(first))

    a = keys(terms.where(F.length("text") > 3), "text", "n_text", "n_word").withColumnRenamed("tokens", "tokens_a")
    b = keys(words.select("word", "ord"), "word", "n_word", "n_text").withColumnRenamed("tokens", "tokens_b")
    met = a.join(F.broadcast(b), ["n_text", "n_word", "token"]).dropDuplicates(["key", "ord"])
    return met.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= _needed(F.col("n_text"), F.col("n_word"), least)).select("key", "text", "word", "ord")


def resolved(terms: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """(term, standard, groups, is_additive, function, confidence, stage) of the distinct terms of a column `term`.

    stage: exact, contained, stripped (contained once words like `refined` are taken off), similar, or null where nothing
    is known; then standard and function are null, groups empty and confidence 0. Null and empty terms have no row.
    """
    spark = terms.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    own = scratch.write(terms.where("term <> ''").select("term").distinct().withColumn("key", F.sha2("term", 256)), "terms")  # every stage reads it
    known = own.join(F.broadcast(exact_words(spark, kb).withColumnRenamed("word", "term")), "term").select("key", *ENTRY, "confidence", F.lit("exact").alias("stage"))
    words = contained_words(spark, kb)
    lengths = sorted({len(w) for w in kb.vocabulary if len(w) > 1})
    left = own.join(F.broadcast(exact_words(spark, kb).select(F.col("word").alias("term"))), "term", "left_anti").select("key", F.col("term").alias("text"), F.length("term").alias("whole"))
    within = _longest(left.select("key", "text"), words, lengths).withColumn("stage", F.lit("contained"))
    bare = E.select(left, "key", normalize.stripped(E.col("text")).alias("text"), "text", "whole").toDF("key", "text", "given", "whole").where("text <> given")
    stripped = _longest(bare.join(within, "key", "left_anti").select("key", "text"), words, lengths).withColumn("stage", F.lit("stripped"))
    n, whole = F.length("best.word"), F.col("whole")
    confidence = F.floor(F.least(F.lit(0.98), F.lit(0.75) + F.lit(0.2) * n / F.greatest(whole, F.lit(1))) * 1e4 + 0.5) / 1e4
    held = within.unionByName(stripped).join(left.select("key", "whole"), "key").where(~((n <= 2) & (whole - n >= normalize.LONGEST_GAP)))
    held = held.select("key", *(F.col(f"best.{c}").alias(c) for c in ENTRY), confidence.alias("confidence"), "stage")
    pairs = similar_pairs(left.join(held, "key", "left_anti").select("key", "text"), similar_words(spark, kb)).withColumn("r", _ratio("text", "word")).where(F.col("r") >= normalize.FUZZY_FROM)
    best = pairs.groupBy("key").agg(F.min_by(F.struct("word", "r"), F.struct(-F.col("r"), "ord")).alias("x")).select("key", "x.word", "x.r")
    near = best.join(F.broadcast(similar_words(spark, kb)), "word").select("key", *ENTRY, (F.floor(F.col("r") * 1e4 + 0.5) / 1e4).alias("confidence"), F.lit("similar").alias("stage"))
    out = own.join(known.unionByName(held).unionByName(near), "key", "left")
    out = out.select("term", "standard", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), F.coalesce("is_additive", F.lit(False)).alias("is_additive"), "function", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "stage")
    out = scratch.write(out, "resolved")
    scratch.drop("terms")
    return out


def ingredient_rows(parts: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """parts (raw and any other columns) with term's entry beside it: standard, groups, is_additive, function, confidence, and raw as a report shows it."""
    own = Scratch(parts.sparkSession).write(E.with_columns(parts, {"term": S.clean_term(E.col("raw"))}), "parts")  # read for its distinct terms and for their entries; split but once
    both = own.join(resolved(own, kb), "term", "left")
    shown = F.when(F.col("standard").isNull(), F.btrim("raw", F.lit(S.SPACES))).otherwise(F.col("term"))
    return both.select(*(c for c in parts.columns if c != "raw"), shown.alias("raw"), "standard", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), F.coalesce("is_additive", F.lit(False)).alias("is_additive"), "function", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def allergen_names(names: DataFrame, kb: KnowledgeBase, gap: int = GAP, inner: int = INNER) -> DataFrame:
    """(name, code, alias, ord, level): aliases found in the distinct names of a column `name`; level: exact, or contains where no guard speaks against chance."""
    spark = names.sparkSession
    guards = kb.allergens["ambiguous"], kb.allergens["single_char"]
    rows = [(c, a, i, guards[0].get(a, []) + (guards[1].get(a, []) if len(a) == 1 else [])) for c, a, i in kb.allergen_aliases()]
    aliases = spark.createDataFrame(rows, "code string, alias string, ord int, blocked array<string>")
    own = Scratch(spark).write(names.where("name <> ''").select("name").distinct().withColumn("key", F.sha2("name", 256)), "names")
    met = with_pieces(own.select("key", F.col("name").alias("text")), "text", sorted({len(a) for _, a, *_ in rows})).join(F.broadcast(aliases), F.col("piece") == F.col("alias"))
    met = met.drop("piece").dropDuplicates(["key", "ord"]).join(own, "key")
    n, m, at = F.length("name"), F.length("alias"), F.instr("name", F.col("alias")) - 1
    chance = F.when(m == 1, (at > 0) & (at < n - 1) & (n > inner)).when(m == 2, n - m >= gap).otherwise(F.lit(False))
    level = F.when(F.col("name") == F.col("alias"), "exact").when(~F.exists("blocked", lambda w: F.col("name").contains(w)) & ~chance, "contains")
    return met.select("name", "code", "alias", "ord", level.alias("level")).where("level is not null")


def allergen_rows(ingredients: DataFrame, key: str, kb: KnowledgeBase, gap: int = GAP, inner: int = INNER) -> DataFrame:
    """(key, code, ingredient, alias, level) of ingredients (key, raw, standard): each ingredient's best alias of each category.

    Both names count; of several aliases the exact one is best, then the longest, then the first.
    """
    both = ingredients.select(key, F.coalesce("raw", "standard").alias("ingredient"), F.posexplode(F.array("standard", "raw")).alias("nord", "name")).where("name <> ''")
    found = both.join(allergen_names(both, kb, gap, inner), "name")
    one = found.groupBy(key, "ingredient", "code", "alias", "ord").agg(F.min_by("level", "nord").alias("level"))
    best = F.struct(F.when(F.col("level") == "exact", 0).otherwise(1), -F.length("alias"), "ord")
    return one.groupBy(key, "code", "ingredient").agg(F.min_by(F.struct("alias", "level"), best).alias("x")).select(key, "code", "ingredient", "x.alias", "x.level")
