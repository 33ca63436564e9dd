"""Queries over terms, names and texts as relations, on inputs that vary with the tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plain
from .functions import sql as E
from .operators import parse, terms
from .plans import rows as R
from .queries import _ALLERGEN, KB, LABELS, labels, q, query, values
from .runtime import ship, table


def _parts_of_labels(spark, sf_dir):
    parts = E.with_columns(labels(spark, sf_dir), {"parts": parse.split_ingredients(E.col("ingredients_text"))})
    return R.exploded(parts, "parts", "label_id", called="p", place="pos").select("label_id", "pos", "p.raw")


@query(LABELS.rstrip().rstrip(",") + " SELECT label_id, pos::INT AS pos, raw, standard, is_additive, func AS function, confidence::DOUBLE AS confidence, len(groups)::INT AS n_groups FROM ing")
def ingredients_by_terms(spark, sf_dir):
    rows = terms.ingredient_rows(_parts_of_labels(spark, sf_dir), KB)
    return rows.select("label_id", "pos", "raw", "standard", "is_additive", "function", "confidence", F.size("groups").alias("n_groups"))


@query(_ALLERGEN + " SELECT label_id, code, ingredient, alias, level FROM best WHERE r = 1")
def allergens_by_terms(spark, sf_dir):
    rows = terms.ingredient_rows(_parts_of_labels(spark, sf_dir), KB)
    return terms.allergen_rows(rows, "label_id", KB)


_WORDS = plain.vocabulary()
_LEADS = ["", *plain.NOISE, "食品添加剂优质"]


def _vocabulary() -> str:
    rows = []
    for k, w in enumerate(_WORDS):
        d = plain.described(plain.standard_of(w))
        rows.append((w, k, d["standard"], len(d["groups"]), d["is_additive"], d["function"]))
    return values(rows, "word, ord, standard, n_groups, is_additive, function")


def _known() -> str:
    additives = plain.document("additives")
    every = dict.fromkeys([*_WORDS, *additives["functions"], *("复配" + f for f in additives["functions"])])
    rows = [(t, k["standard"], len(k["groups"]), k["is_additive"], k["function"], float(k["confidence"])) for t in every if (k := plain.known(t))]
    return values(rows, "term, standard, n_groups, is_additive, function, confidence")


def _bare(text: str) -> str:
    for lead in plain.NOISE:
        text = f"regexp_replace({text}, '^{lead}', '')"
    return text


_BEST = "row_number() OVER (PARTITION BY term ORDER BY length(word) DESC, ord) AS r"


@query(f"""WITH v AS {_vocabulary()}, known AS {_known()},
t AS (SELECT p_partkey AS id, {q(_LEADS)}[(p_size % {len(_LEADS)} + 1)::INT] || CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE {q(_WORDS)}[((p_partkey * 7 + p_size) % {len(_WORDS)} + 1)::INT] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE substr(p_name, 1, (p_size % 11)::INT) END END AS term FROM part),
c AS (SELECT term, {_bare("term")} AS bare FROM (SELECT DISTINCT term FROM t WHERE term <> '') WHERE term NOT IN (SELECT term FROM known)),
b1 AS (SELECT term, v.*, {_BEST} FROM c JOIN v ON length(word) > 1 AND contains(term, word)), b2 AS (SELECT term, v.*, {_BEST} FROM c JOIN v ON length(word) > 1 AND contains(bare, word) WHERE term NOT IN (SELECT term FROM b1)),
held AS (SELECT *, 'contained' AS stage FROM b1 WHERE r = 1 UNION ALL SELECT *, 'stripped' FROM b2 WHERE r = 1),
x AS (SELECT term, standard, n_groups, is_additive, function, confidence, 'exact' AS stage FROM known UNION ALL
  SELECT term, standard, n_groups, is_additive, function, floor(least(0.98::DOUBLE, 0.75::DOUBLE + 0.2::DOUBLE * length(word) / length(term)) * 1e4 + 0.5) / 1e4, stage FROM held WHERE NOT (length(word) <= 2 AND length(term) - length(word) >= 5))
SELECT id, t.term, standard, coalesce(n_groups, 0)::INT AS n_groups, coalesce(is_additive, false) AS is_additive, function, coalesce(confidence, 0.0)::DOUBLE AS confidence, stage FROM t LEFT JOIN x USING (term)""")
def terms_resolved(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda items, n: F.get(F.array(*map(F.lit, items)), (n % len(items)).cast("int"))
    word = F.concat(pick(_WORDS, k * 7 + size), F.when(k % 3 == 0, "").otherwise(F.substring("p_name", F.lit(1), size % 11)))
    made = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(pick(_LEADS, size), F.when(k % 5 == 0, F.col("p_name")).otherwise(word)).alias("term"))
    found = made.join(terms.resolved(made, KB), "term", "left")
    return found.select("id", "term", "standard", F.coalesce(F.size("groups"), F.lit(0)).alias("n_groups"), F.coalesce("is_additive", F.lit(False)).alias("is_additive"), "function", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "stage")


_LONG = [w for w in _WORDS if len(w) > 4]


def _edited(w: str, at: int, how: int) -> str:
    """A letter replaced, taken out, put in, or swapped with the next."""
    return (w[:at] + "某" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "某" + w[at:], w[:at] + w[at + 1 : at + 2] + w[at] + w[at + 2 :])[how]


def _edits() -> str:
    """Every edit's answer, from the likeness of the standard library, measured against the whole vocabulary."""
    rows = []
    for k, w in enumerate(_LONG):
        for at in range(len(w)):
            for how in range(4):
                n = plain.normalize(_edited(w, at, how))
                rows.append((k, at, how, n["raw"], n["standard"], n["confidence"]))
    e = values(rows, "word, spot, how, term, standard, confidence")
    return f"SELECT p_partkey AS id, term, standard, confidence::DOUBLE AS confidence FROM (SELECT *, p_partkey % {len(_LONG)} AS w FROM part) JOIN (SELECT * FROM {values([(k, len(w)) for k, w in enumerate(_LONG)], 'w, n')}) USING (w) JOIN {e} e ON e.word = w AND e.spot = p_size % n AND e.how = (p_partkey // {len(_LONG)} + p_size) % 4"


@query(_edits)
def terms_similar(spark, sf_dir):
    ship(spark)
    k, size = F.col("p_partkey"), F.col("p_size")
    w = F.get(F.array(*map(F.lit, _LONG)), (k % len(_LONG)).cast("int"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), w.alias("w"), (size % F.length(w)).alias("at"), ((F.floor(k / len(_LONG)) + size) % 4).alias("how"))
    head, letter, tail = F.substring("w", F.lit(1), F.col("at")), F.substring("w", F.col("at") + 1, F.lit(1)), F.substring("w", F.col("at") + 2, F.lit(99))
    swapped = F.concat(head, F.substring(tail, 1, 1), letter, F.substring(tail, 2, 99))
    term = F.when(F.col("how") == 0, F.concat(head, F.lit("某"), tail)).when(F.col("how") == 1, F.concat(head, tail)).when(F.col("how") == 2, F.concat(head, F.lit("某"), letter, tail)).otherwise(swapped)
    made = rows.select("id", term.alias("term"))
    return made.join(terms.resolved(made, KB), "term", "left").select("id", "term", "standard", "confidence")
