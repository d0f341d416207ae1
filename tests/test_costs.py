"""What is asked for several times is worked out once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from storyspark.functions.textfn import WHITE, strip
from storyspark.operators import character
from storyspark.plans import bindings, q_books, q_fusion

from .conftest import SF


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_strip_equals_its_pattern_without_one(spark):
    space = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in "\x1c\x1d\x1e\x1f" and chr(c).isspace()]
    assert sorted(space) == sorted(WHITE)
    texts = ["", " ", "a", "\n a b\t\r\n", "a\n \n", "\x1ca\x1f", "​a​", None, *[f"{w}é{w}日{w}{w}" for w in WHITE]]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    rows = rows.select("x", strip("x").alias("a"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("b"))
    assert "regexp" not in _plan(rows.select(strip("x")))
    assert all(r.a == r.b for r in rows.collect())


def test_tags_are_counted_once(spark):
    t = bindings.Tables(spark, SF)
    plan = _plan(q_books._tags(t))
    assert plan.count("regexp_extract_all") <= 1 + len(bindings.BEHAVIOURS) and plan.count("replace(") <= len(bindings.HABITS)


def test_roles_are_counted_by_sentence(spark):
    chapters = spark.createDataFrame([(1, 1, "Ann helps.Bob. Ann helps, helps foe"), (1, 2, "foe foe.Bob foe"), (2, 1, "Cy")], "novel_id long, chapter_number int, content string")
    persons = spark.createDataFrame([(1, "Ann", 3), (1, "Bob", 2), (1, "Eve", 1), (2, "Dan", 1)], "novel_id long, person string, mentions long")
    lexicon = {"help": ["helps", "s\nB"], "foe": ["foe"]}
    rows = chapters.join(persons.groupBy("novel_id").agg(F.collect_list(F.struct("person", "mentions")).alias("p")), "novel_id")
    got = {(r.novel_id, r.chapter_number): [tuple(x) for x in r.s] for r in rows.select("novel_id", "chapter_number", character.said_scores("content", "p", lexicon, ".").alias("s")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {(1, 1): [("Ann", 3, 3, 1), ("Bob", 2, 0, 0)], (1, 2): [("Bob", 2, 0, 1)], (2, 1): []}
    roles = {r.role_name: r.function_type for r in character.supporting_roles(chapters, persons, lexicon, ".").collect()}
    assert roles == {"Ann": "help", "Bob": "foe"}


def test_comparisons_read_the_texts_once(spark):
    plan = q_fusion.v1_benchmark_comparisons(bindings.Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan.*documents\.parquet", plan)) <= 2  # those of the library
