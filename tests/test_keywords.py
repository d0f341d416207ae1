"""Keywords of a table in one pass, against counting each alone."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from storyspark.functions import schemas
from storyspark.operators import keywords, rules
from storyspark.operators.keywords import Automaton


def slow(text, words):
    return {w: n for w in words if (n := text.count(w))}


def test_counts_of_overlapping_keywords():
    rng = random.Random(1)
    words = ["a", "aa", "aaa", "ab", "aba", "abab", "ba", "b", "bb", "é", "éé", "日本", "日", "abc"]
    own = Automaton(words)
    for _ in range(3000):
        text = "".join(rng.choice("aaabbcé日本") for _ in range(rng.randint(0, 60)))
        ks, ns = own.hits(text)
        assert {words[k]: n for k, n in zip(ks.tolist(), ns.tolist(), strict=True)} == slow(text, words)


@pytest.mark.parametrize("most", [1 << 20, 9])
def test_hits_in_one_or_several_passes(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_CHARS", most)
    texts = [(1, "the cat sat on the mat"), (1, "cat"), (2, None), (3, ""), (4, "cattheca")]
    words = ["the", "cat", "at", "zz", "", None, "cat", "sat on"]
    hits = keywords.keyword_hits(spark.createDataFrame(texts, "novel_id long, text string").withColumn("keyword", F.lit("x")), spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = sorted((i, w, n) for i, t in texts for w, n in slow(t or "", {w for w in words if w}).items())
    assert sorted((r.novel_id, r.keyword, r.n) for r in hits.collect()) == want


@pytest.mark.parametrize("most", [1 << 20, 9])
def test_lexicon_and_rules(spark, monkeypatch, most):
    """Categories with shared and repeated keywords; rules with several, none and null ones."""
    monkeypatch.setattr(keywords, "MOST_CHARS", most)
    texts = {1: "red blue red", 2: "green", 3: None, 4: ""}
    books = spark.createDataFrame(list(texts.items()), "novel_id long, text string")
    lexicon = {("warm", 0): ["red", "red", "ree"], ("cold", 1): ["blue", "e"], ("none", 2): [""]}
    rows = [(*c, w) for c, ws in lexicon.items() for w in ws]
    got = {(r.novel_id, r.category): (r.n, r.present) for r in rules.lexicon_scores(books, spark.createDataFrame(rows, "category string, cat_ord int, keyword string")).collect()}
    want = {(i, c[0]): (sum((t or "").count(w) for w in ws if w), sum(w in (t or "") for w in ws if w)) for i, t in texts.items() for c, ws in lexicon.items()}
    assert got == want
    table = [
        ("a", 0, "A", "f", "keyword", ["blue", "red", "pink"], None, None, 1.0, True, None),
        ("b", 1, "B", "f", "keyword", [], None, "never", 1.0, True, None),
        ("c", 2, "C", "g", "keyword", None, None, "never", 1.0, True, None),
        ("d", 3, "D", "g", "regex", None, "RE", None, 0.5, True, None),
        ("e", 4, "E", "g", "keyword", ["green", "green"], None, "leaf", 0.5, True, None),
        ("x", 5, "X", "g", "keyword", ["red"], None, "off", 0.5, False, None),
    ]
    found = sorted((r.novel_id, r.rule_id, r.value, round(r.score, 6)) for r in rules.rule_scores(books, spark.createDataFrame(table, schemas.RULES)).collect())
    assert found == [(1, "a", "blue", 0.666667), (1, "d", "D", 0.2), (2, "d", "D", 0.1), (2, "e", "leaf", 1.0)]


def test_a_hundred_thousand_keywords():
    """The time for a text hardly grows with the number of keywords."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
    words = list({word() for _ in range(100_000)})
    text = " ".join(rng.choice(words[:500] if rng.random() < 0.1 else [word()]) for _ in range(30_000))
    took = {}
    for n in (1000, len(words)):
        own = Automaton(words[:n])
        start = time.perf_counter()
        ks, ns = own.hits(text)
        took[n] = time.perf_counter() - start
        some = sorted(words[:n])[:: max(1, n // 300)]
        found = {words[k]: c for k, c in zip(ks.tolist(), ns.tolist(), strict=True)}
        assert {w: found.get(w, 0) for w in some} == {w: text.count(w) for w in some}
    assert took[len(words)] < 8 * took[1000] + 0.2


def test_no_keywords(spark):
    books = spark.createDataFrame([(1, "x")], "novel_id long, text string")
    assert keywords.keyword_hits(books, spark.createDataFrame([], "keyword string")).count() == 0
    assert rules.lexicon_scores(books, spark.createDataFrame([], "category string, cat_ord int, keyword string")).count() == 0
    assert rules.rule_scores(books, spark.createDataFrame([], schemas.RULES)).count() == 0
