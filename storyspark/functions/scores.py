"""Lexicon scores: one array of (category, score) a text, in the lexicon's order."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textfn import cnt, col, has, once

Lexicon = dict[str, list[str]]


def scores(text: str | Column, lexicon: Lexicon, how: str = "count") -> Column:
    """``how``: ``count`` sums occurrences, ``presence`` counts the keywords that occur.

    A keyword that is listed twice counts twice. Every category is there, also with score 0.
    """
    if how not in ("count", "presence"):
        raise ValueError(how)
    one = cnt if how == "count" else lambda t, k: has(t, k).cast("int")
    return F.array(*[F.struct(F.lit(c).alias("category"), reduce(add, [one(text, k) for k in keys]).alias("score")) for c, keys in lexicon.items()])


def best(found: str | Column) -> Column:
    """The highest score."""
    return F.array_max(F.transform(col(found), lambda s: s["score"]))


def total(found: str | Column) -> Column:
    """The sum of the scores."""
    return F.aggregate(col(found), F.lit(0).cast("long"), lambda a, s: a + s["score"])


def top(found: str | Column) -> Column:
    """The category with the highest score, the first of several; with all scores 0 the first.

    One fold, in which the scores are named once: naming them twice would compute them twice.
    """
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(float("-inf")).alias("score"))
    own = lambda s: F.struct(s["category"].alias("category"), s["score"].cast("double").alias("score"))
    return F.aggregate(col(found), none, lambda a, s: F.when(s["score"] > a["score"], own(s)).otherwise(a), lambda a: a["category"])


def score_of(found: str | Column, category: str) -> Column:
    return F.get(F.filter(col(found), lambda s: s["category"] == category), F.lit(0))["score"]


def shares(found: str | Column) -> Column:
    """Map of category to its share of all scores; equal shares where all are 0."""
    share = lambda f, n: F.transform(f, lambda s: F.struct(s["category"], F.when(n > 0, s["score"] / n).otherwise(1 / F.size(f))))
    return F.map_from_entries(once(col(found), lambda f: once(total(f), lambda n: share(f, n))))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant for a category, from a small literal table; a list becomes an array."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
