"""Queries of the knowledge base for what the tables ask: keywords, cited clauses, additives found, and its own consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plain
from .operators import lookups
from .plans import rows as R
from .plans.verify import parsed
from .queries import _FOUND, _VERDICT, KB, LABELS, labels, q, query, reports, values
from .runtime import table
from .sources.kb import dimensions

_CLAUSES = values([(i, c["standard"], c["section"], c["summary"], c["usage"]) for i, c in plain.document("clauses")["clauses"].items()], "id, standard, section, summary, usage")
_CITED = values([(c["id"], x) for c in plain.document("claims")["claims"] for x in c["clauses"]], "pattern_id, id")
_KEYS = {"clause": ["声称", "蔗糖", "GB", "28050", "防腐", "脂肪", "7718"], "additive": ["钠", "钾", "酸", "糖", "胶"], "alias": ["糖", "油", "酸", "粉", "奶", "盐"]}


def _keyword(kind: str, other: str) -> str:
    """SQL: one of the keywords, or a column of the table itself, by the part's size."""
    keys = _KEYS[kind]
    return f"CASE WHEN p_size % {len(keys) + 1} = {len(keys)} THEN {other} ELSE {q(keys)}[(p_size % {len(keys) + 1} + 1)::INT] END"


def _asked(spark, sf_dir, kind: str, other: str, *more):
    keys = _KEYS[kind]
    n = F.col("p_size") % (len(keys) + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(n == len(keys), F.col(other)).otherwise(F.get(F.array(*map(F.lit, keys)), n)).alias("keyword"), *more)


@query(f"SELECT p_partkey AS id, keyword, c.id AS clause, standard FROM (SELECT *, {_keyword('clause', 'p_name')} AS keyword FROM part) JOIN {_CLAUSES} c ON contains(c.id || standard || section || summary || usage, keyword)")
def kb_clause_search(spark, sf_dir):
    asked = _asked(spark, sf_dir, "clause", "p_name")
    found = lookups.clause_search(asked, dimensions(spark, KB)["clause"]).withColumnRenamed("id", "clause")
    return asked.join(found, "keyword").select("id", "keyword", "clause", "standard")


def _cited(spark, sf_dir):
    return R.exploded(R.verdict_rows(reports(spark, sf_dir)), "clauses", "label_id", "pattern_id", called="id")


_OF_VERDICTS = LABELS + _FOUND + _VERDICT.rstrip().rstrip(",") + f", cited AS (SELECT v.label_id, v.pattern_id, c.id FROM verdict v JOIN {_CITED} c USING (pattern_id)), clause AS {_CLAUSES}"


@query(_OF_VERDICTS + " SELECT row_number() OVER (ORDER BY standard)::INT AS place, standard, count(DISTINCT id) AS n_clauses, count(DISTINCT label_id) AS n_keys, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM cited JOIN clause USING (id) GROUP BY standard")
def kb_clauses_by_standard(spark, sf_dir):
    cited = _cited(spark, sf_dir).select("id", F.col("label_id").alias("key"))
    return lookups.clauses_by_standard(cited, dimensions(spark, KB)["clause"]).withColumn("ids", F.array_join("ids", ","))


@query(_OF_VERDICTS + " SELECT label_id, pattern_id, id, coalesce(trim(standard || ' ' || section) || '　' || summary, id) AS summary FROM (SELECT label_id, pattern_id, CASE WHEN label_id LIKE '%7' THEN id || '?' ELSE id END AS id FROM cited) LEFT JOIN clause USING (id)")
def clause_summaries(spark, sf_dir):
    """Clauses of verdicts in words; ids of labels that end in 7 are made unknown ones, which stay as they are."""
    cited = _cited(spark, sf_dir).withColumn("id", F.when(F.col("label_id").endswith("7"), F.concat("id", F.lit("?"))).otherwise(F.col("id")))
    return lookups.clause_summaries(cited, dimensions(spark, KB)["clause"]).select("label_id", "pattern_id", "id", "summary")


_FUNCTIONS = list(plain.document("additives")["functions"])
_ADDITIVES = values([(n, a["function"], [n, *a["aliases"]]) for n, a in plain.document("additives")["additives"].items()], "name, function, called")


@query(LABELS.rstrip().rstrip(",") + f" SELECT ord::INT AS ord, function, n_additives FROM (SELECT func AS function, count(DISTINCT standard) AS n_additives FROM ing WHERE is_additive AND func IS NOT NULL GROUP BY func) JOIN {values([(f, k) for k, f in enumerate(_FUNCTIONS)], 'function, ord')} USING (function)")
def kb_additive_by_function(spark, sf_dir):
    found = R.exploded(parsed(labels(spark, sf_dir)), "ingredients", "label_id", called="i").where("i.is_additive").select(F.col("i.standard").alias("name"), F.col("i.function").alias("function"))
    return lookups.additives_by_function(found, dimensions(spark, KB)["function"])


@query(f"""SELECT p_partkey AS id, keyword, a.name, a.function FROM (SELECT *, {_keyword('additive', 'p_brand')} AS keyword, CASE WHEN p_partkey % 3 > 0 THEN {q(_FUNCTIONS)}[(p_partkey % {len(_FUNCTIONS)} + 1)::INT] END AS asked FROM part)
JOIN {_ADDITIVES} a ON len(list_filter(called, lambda x: contains(x, keyword))) > 0 AND (asked IS NULL OR asked = a.function)""")
def kb_additive_search(spark, sf_dir):
    k = F.col("p_partkey")
    asked = _asked(spark, sf_dir, "additive", "p_brand", F.when(k % 3 > 0, F.get(F.array(*map(F.lit, _FUNCTIONS)), (k % len(_FUNCTIONS)).cast("int"))).alias("function"))
    d = dimensions(spark, KB)
    found = lookups.additive_search(asked, d["additive"], d["additive_alias"]).withColumnRenamed("keyword", "k").withColumnRenamed("function", "f")
    return asked.join(found, (F.col("keyword") == F.col("k")) & F.col("function").eqNullSafe(F.col("f"))).select("id", "keyword", "name", F.col("of").alias("function"))


_INGREDIENTS = plain.document("ingredients")


@query(f"""WITH a AS {values([(a, s, i) for i, (a, s) in enumerate(_INGREDIENTS['aliases'].items())], 'alias, standard, ord')}, s AS {values(list(_INGREDIENTS['standards'].items()), 'standard, groups')}, g AS {values(list(_INGREDIENTS['groups'].items()), 'code, name')},
p AS (SELECT p_partkey AS id, {_keyword('alias', 'p_type')} AS keyword FROM part), h AS (SELECT keyword, a.*, row_number() OVER (PARTITION BY keyword ORDER BY ord) AS place FROM (SELECT DISTINCT keyword FROM p) JOIN a ON contains(alias, keyword) OR contains(standard, keyword)),
n AS (SELECT standard, string_agg(coalesce(g.name, code), '、' ORDER BY encode(coalesce(g.name, code))) AS group_names FROM (SELECT standard, unnest(groups) AS code FROM s) LEFT JOIN g USING (code) GROUP BY standard)
SELECT id, keyword, place::INT AS place, alias, standard, coalesce(group_names, '') AS group_names FROM p JOIN h USING (keyword) LEFT JOIN n USING (standard) WHERE place <= 60""")
def kb_alias_lookup(spark, sf_dir):
    d = dimensions(spark, KB)
    asked = _asked(spark, sf_dir, "alias", "p_type")
    return asked.join(lookups.alias_lookup(asked, d["alias"], d["standard"], d["group"]), "keyword").select("id", "keyword", "place", "alias", "standard", "group_names")


_STANDARDS = list(_INGREDIENTS["standards"])
_CODES = list(plain.document("allergens")["categories"])


@query(f"""WITH a AS (SELECT p_name || p_size AS alias, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE {q(_STANDARDS)}[(p_partkey % {len(_STANDARDS)} + 1)::INT] END AS standard, {q(_CODES)}[(p_size % {len(_CODES)} + 1)::INT] AS code FROM part)
SELECT DISTINCT 'dangling_alias' AS problem, standard AS what FROM a WHERE standard NOT IN (SELECT unnest({q(_STANDARDS)})) UNION ALL SELECT 'alias_of_two_allergens', x FROM (SELECT p_name || (p_partkey % 900) AS x, {q(_CODES)}[(p_size % {len(_CODES)} + 1)::INT] AS code FROM part) GROUP BY x HAVING count(DISTINCT code) > 1""")
def kb_issues(spark, sf_dir):
    """A dictionary made from the parts, checked against the documents' standard names: it has unknown ones, and names of two categories."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda items, n: F.get(F.array(*map(F.lit, items)), (n % len(items)).cast("int"))
    parts = table(spark, sf_dir, "part")
    aliases = parts.select(F.concat("p_name", size.cast("string")).alias("alias"), F.when(k % 5 == 0, F.col("p_brand")).otherwise(pick(_STANDARDS, k)).alias("standard"))
    categories = parts.select(pick(_CODES, size).alias("code"), F.concat("p_name", (k % 900).cast("string")).alias("alias"))
    return lookups.inconsistencies(aliases, dimensions(spark, KB)["standard"], categories)


_NAMES = values(
    [("additive", n) for n in plain.document("additives")["additives"]] + [("alias", a) for a in _INGREDIENTS["aliases"]] + [("standard", s) for s in _STANDARDS] + [("allergen_alias", a) for c in plain.document("allergens")["categories"].values() for a in c["aliases"]],
    "kind, name",
)


@query(LABELS.rstrip().rstrip(",") + f" SELECT kind, count(*) AS n, count(u.name) AS n_used FROM {_NAMES} x LEFT JOIN (SELECT DISTINCT raw AS name FROM ing) u USING (name) GROUP BY kind")
def kb_counts(spark, sf_dir):
    used = R.exploded(parsed(labels(spark, sf_dir)), "ingredients", "label_id", called="i").select(F.col("i.raw").alias("name"))
    return lookups.document_counts(dimensions(spark, KB), used)
