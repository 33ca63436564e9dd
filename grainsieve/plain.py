"""The knowledge base's documents as they stand and terms looked up in them by plain loops: what the oracles' dimension rows are made from. The engine's operators are not used here."""

from __future__ import annotations

import json
import math
from difflib import SequenceMatcher
from functools import cache
from importlib.resources import files


@cache
def document(name: str) -> dict:
    return json.loads((files("grainsieve") / "kb" / f"{name}.json").read_text("utf-8"))


@cache
def additives() -> dict[str, str]:
    """Names and aliases of additives, each with the additive that it names."""
    doc = document("additives")
    out = {}
    for name, row in doc["additives"].items():
        for called in (name, *row["aliases"]):
            out[called] = name
    for name in doc["preservatives"]:
        if name not in out:
            out[name] = name
    return out


@cache
def vocabulary() -> list[str]:
    doc = document("ingredients")
    seen = []
    for words in (doc["aliases"], doc["standards"], additives()):
        seen += [w for w in words if w not in set(seen)]
    return seen


def described(standard: str, *called: str) -> dict:
    """What is known of a standard name; the additive is the one that the standard name, or else one of the others, stands for."""
    additive = None
    for name in (standard, *called):
        if additive is None:
            additive = additives().get(name)
    function = document("additives")["additives"][additive]["function"] if additive in document("additives")["additives"] else None
    return {"standard": standard, "groups": document("ingredients")["standards"].get(standard, []), "is_additive": additive is not None, "function": function}


def standard_of(word: str) -> str:
    return document("ingredients")["aliases"].get(word, word)


def known(term: str) -> dict | None:
    """A term that some dictionary has: aliases first, then standard names, additives and the names of functions."""
    ingredients = document("ingredients")
    if term in ingredients["aliases"] or term in ingredients["standards"]:
        return described(standard_of(term), term) | {"confidence": 1.0}
    if term in additives():
        return described(additives()[term], term) | {"confidence": 1.0}
    for function in document("additives")["functions"]:
        if term in (function, "复配" + function):
            return {"standard": function, "groups": [], "is_additive": True, "function": function, "confidence": 0.9 if term == function else 0.85}
    return None


NOISE = ("食品添加剂", "复配", "食用", "精制", "优质", "特级", "一级")  # fixed values


def bare(term: str) -> str:
    for lead in NOISE:
        if term.startswith(lead):
            term = term[len(lead) :]
    return term


def four(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


def held(term: str) -> str | None:
    """The longest word of two letters or more within a term, the first of equals."""
    best = None
    for w in vocabulary():
        if len(w) > 1 and w in term and (best is None or len(w) > len(best)):
            best = w
    return best


def alike(term: str) -> tuple[str, float] | None:
    """The first of the words most like a term of four letters or more, of about its length, if they are alike enough."""
    found = []
    if len(term) > 3:
        for place, w in enumerate(vocabulary()):
            if len(w) > 1 and abs(len(w) - len(term)) <= 2:
                r = SequenceMatcher(None, term, w, autojunk=False).ratio()
                if r >= 0.86:
                    found.append((-r, place, w))
    return (min(found)[2], -min(found)[0]) if found else None


def normalize(term: str) -> dict:
    """A term's standard name, groups, additive, function and confidence."""
    hit = known(term)
    if hit is None:
        word = held(term) or held(bare(term))
        if word is not None and not (len(word) <= 2 and len(term) - len(word) >= 5):
            hit = described(standard_of(word)) | {"confidence": four(min(0.98, 0.75 + 0.2 * len(word) / len(term)))}
    if hit is None and (near := alike(term)):
        hit = described(standard_of(near[0]), near[0]) | {"confidence": four(near[1])}
    return {"raw": term} | (hit or {"standard": None, "groups": [], "is_additive": False, "function": None, "confidence": 0.0})
