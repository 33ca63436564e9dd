"""The knowledge base: fixed documents of the package, or any folder of the same documents, as plain values and as dimension tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = ("claims", "thresholds", "populations", "clauses", "allergens", "additives", "ingredients")
WORDING = "可能含有"
UNREGULATED = "这一说法没有法定的定义，以下按一般理解核对。"


@dataclass
class KnowledgeBase:
    """A few hundred rows of rules, read once on the driver; expressions take them in as literals."""

    claims: list[dict]
    thresholds: dict
    populations: dict
    clauses: dict
    allergens: dict
    additives: dict
    ingredients: dict
    additive_index: dict[str, str] = field(default_factory=dict)
    additive_function: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, row in self.additives["additives"].items():
            self.additive_function[name] = row["function"]
            self.additive_index[name] = name
            for a in row["aliases"]:
                self.additive_index[a] = name
        for name in self.preservatives:
            self.additive_index.setdefault(name, name)

    @property
    def functions(self) -> list[str]:
        return self.additives["functions"]

    @property
    def preservatives(self) -> list[str]:
        return self.additives["preservatives"]

    @property
    def standards(self) -> dict[str, list[str]]:
        return self.ingredients["standards"]

    @property
    def aliases(self) -> dict[str, str]:
        return self.ingredients["aliases"]

    @property
    def nutrients(self) -> dict[str, str]:
        return self.ingredients["nutrients"]

    @property
    def nutrient_names(self) -> list[str]:
        """All names and standard names, longest first."""
        both = dict.fromkeys(x for kv in self.nutrients.items() for x in kv)
        return sorted(both, key=len, reverse=True)

    @property
    def vocabulary(self) -> list[str]:
        return list(dict.fromkeys([*self.aliases, *self.standards, *self.additive_index]))

    @property
    def match_words(self) -> list[tuple[str, str]]:
        """(word, claim id), longest first."""
        return sorted(((w, c["id"]) for c in self.claims for w in c["words"]), key=lambda x: len(x[0]), reverse=True)

    def allergen_aliases(self) -> list[tuple[str, str, int]]:
        """(code, alias, ord)."""
        rows = [(code, a) for code, c in self.allergens["categories"].items() for a in c["aliases"]]
        return [(c, a, i) for i, (c, a) in enumerate(rows)]

    def issues(self) -> list[tuple[str, str]]:
        """What is inconsistent in the documents: (check, what). None for the package's own."""
        out = [("dangling_alias", t) for t in self.aliases.values() if t not in self.standards]
        out += [("unknown_function", f) for f in self.additive_function.values() if f not in self.functions]
        out += [("dangling_threshold", x["threshold"]) for c in self.claims for x in c["conditions"] if x.get("threshold") and x["threshold"] not in self.thresholds["claims"]]
        out += [("dangling_clause", x) for c in self.claims for x in c["clauses"] if x not in self.clauses]
        owner: dict[str, str] = {}
        for code, alias, _ in self.allergen_aliases():
            if owner.setdefault(alias, code) != code:
                out.append(("alias_of_two_allergens", alias))
        for code, c in self.allergens["categories"].items():
            if not c.get("name") or c.get("standard") not in self.allergens["clause_map"] or not c["aliases"]:
                out.append(("allergen_category", code))
        for ch, words in self.allergens["single_char"].items():
            if len(ch) != 1 or ch not in owner:
                out.append(("guard_character", ch))
            out += [("guard_word", w) for w in words if ch not in w]
        out += [("guard_alias", a) for a, words in self.allergens["ambiguous"].items() if a not in owner or not words]
        words = [w for w, _ in self.match_words]
        out += [("repeated_match_word", w) for w in dict.fromkeys(words) if words.count(w) > 1]
        return out


def _built(docs: dict) -> KnowledgeBase:
    return KnowledgeBase(docs["claims"]["claims"], docs["thresholds"], docs["populations"]["populations"], docs["clauses"]["clauses"], docs["allergens"], docs["additives"], docs["ingredients"])


@cache
def knowledge_base() -> KnowledgeBase:
    """The package's own documents."""
    return _built({n: json.loads((files("grainsieve") / "kb" / f"{n}.json").read_text("utf-8")) for n in DOCUMENTS})


def load(spark: SparkSession, folder: str) -> KnowledgeBase:
    """The same documents from any folder that Spark reads. It fails at once if one is missing or is not JSON."""
    docs = {n: json.loads(spark.read.text(f"{folder.rstrip('/')}/{n}.json", wholetext=True).first()[0]) for n in DOCUMENTS}
    return _built(docs)


def dimensions(spark: SparkSession, kb: KnowledgeBase) -> dict[str, DataFrame]:
    """The knowledge base as dimension tables, each row with its place `ord` where order matters."""
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    conditions = [(c["id"], k, x["kind"], x["type"], x.get("nutrient"), x.get("threshold"), x.get("groups"), x.get("function"), x.get("functions"), x.get("value"), x.get("weight"), x.get("clause")) for c in kb.claims for k, x in enumerate(c["conditions"])]
    return {
        "additive": df([(n, f, i) for i, (n, f) in enumerate(kb.additive_function.items())], "name string, function string, ord int"),
        "additive_alias": df([(a, n) for a, n in kb.additive_index.items()], "alias string, name string"),
        "function": df(list(zip(kb.functions, range(99), strict=False)), "function string, ord int"),
        "claim": df([(c["id"], c["name"], c["regulated"], None if c["regulated"] else UNREGULATED, c["clauses"], i) for i, c in enumerate(kb.claims)], "id string, name string, regulated boolean, note string, clauses array<string>, ord int"),
        "match_word": df([(w, len(w), p, i) for i, (w, p) in enumerate(kb.match_words)], "word string, len int, claim_id string, ord int"),
        "condition": df(conditions, "claim_id string, ord int, kind string, type string, nutrient string, threshold string, groups array<string>, function string, functions array<string>, value int, weight string, clause string"),
        "threshold": df([(r, t["nutrient"], float(t["solid"]), float(t["liquid"]), t["unit"], t["clause"]) for r, t in kb.thresholds["claims"].items()], "ref string, nutrient string, solid double, liquid double, unit string, clause string"),
        "risk": df([(n, r["unit"], float(r["medium"]), float(r["high"]), float(r["weight"]), i) for i, (n, r) in enumerate(kb.thresholds["risk"].items())], "nutrient string, unit string, medium double, high double, weight double, ord int"),
        "population": df([(n, p["desc"], i) for i, (n, p) in enumerate(kb.populations.items())], "name string, description string, ord int"),
        "clause": df([(i, c["standard"], c["title"], c["section"], c["summary"], c["usage"]) for i, c in kb.clauses.items()], "id string, standard string, title string, section string, summary string, usage string"),
        "allergen": df([(c, a["name"], a["standard"], kb.allergens["clause_map"].get(a["standard"], a["standard"]), a["note"], i) for i, (c, a) in enumerate(kb.allergens["categories"].items())], "code string, name string, standard string, clause string, note string, ord int"),
        "allergen_alias": df(kb.allergen_aliases(), "code string, alias string, ord int"),
        "standard": df([(s, g, i) for i, (s, g) in enumerate(kb.standards.items())], "standard string, groups array<string>, ord int"),
        "alias": df([(a, s, i) for i, (a, s) in enumerate(kb.aliases.items())], "alias string, standard string, ord int"),
        "group": df(list(kb.ingredients["groups"].items()), "code string, name string"),
        "issue": df(kb.issues(), "problem string, what string"),
    }
