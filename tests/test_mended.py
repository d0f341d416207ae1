"""Plans and rows that once went wrong: repeated updates, scores computed twice, missing fields, empty libraries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storyspark.functions import schemas
from storyspark.functions import scores as S
from storyspark.functions import textfn
from storyspark.operators import benchmark as BM
from storyspark.operators import character as C
from storyspark.operators import deep
from storyspark.operators import model as P
from storyspark.operators import narrative as N
from storyspark.operators import rules as R
from storyspark.operators import search as Q
from storyspark.operators import text as T
from storyspark.plans import bindings, q_fusion, q_text
from storyspark.sources import files, tables

from .conftest import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_updates_leave_one_row_for_each_key(spark):
    table = spark.createDataFrame([(1, "a", 1)], "id long, name string, v int")
    ups = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "d", 1), (2, "d", 1)], "id long, name string, v int")
    assert [tuple(r) for r in tables.upsert(table, ups, ["id"], "v").orderBy("id").collect()] == [(1, "c", 3), (2, "d", 1)]
    assert [r.id for r in tables.upsert(table, ups, ["id"]).orderBy("id").collect()] == [1, 2]
    changed = tables.update_columns(table, ups, "id", ["name"]).collect()
    assert len(changed) == 1 and changed[0].changed
    maps = spark.createDataFrame([(1, {"x": 1.0}, ["t"], True), (1, {"x": 2.0}, None, None)], "benchmark_id long, market_data map<string,double>, tags array<string>, is_active boolean")
    assert tables.add_benchmark(maps.limit(0), maps).count() == 1


def test_a_text_is_scored_once(spark):
    books = bindings.Tables(spark, SF).books
    keys = [k for keys in bindings.LATIN.values() for k in keys]
    for df in (books.select(S.top(S.scores("text", bindings.LATIN))), books.select(S.shares(S.scores("text", bindings.LATIN)))):
        assert plan_of(df).count("replace(text#") == len(keys)
    none = spark.createDataFrame([(["a"], "")], "x array<string>, text string").select(S.top(S.scores("text", {"p": ["q"], "r": ["s"]})).alias("t"), S.top(F.array().cast("array<struct<category:string,score:int>>")).alias("u"))
    assert tuple(none.first()) == ("p", None)


def test_the_best_benchmarks_are_broadcast_not_the_novels(spark):
    plan = physical(q_fusion.b2_benchmark_similarity(bindings.Tables(spark, SF)))
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_books_are_cut_without_a_shuffle(spark):
    books = spark.createDataFrame([(1, "before\nChapter 1\na\n\n b\nChapter 2\nChapter 3\nc"), (2, "no title"), (3, None), (4, "Chapter 9"), (5, "")], "novel_id long, text string")
    out = T.split_chapters(books)
    assert "Exchange" not in physical(out)
    got = sorted((r.novel_id, r.chapter_number, r.title, r.content) for r in out.collect())
    assert got == [(1, 1, "Chapter 1", "a\nb"), (1, 3, "Chapter 3", "c"), (2, 1, None, "no title"), (3, 1, None, None), (4, 1, None, "Chapter 9"), (5, 1, None, "")]


def test_a_missing_field_is_no_filter(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0.9), (2, "a", None, 0.8), (3, None, None, 0.1), (4, "b", "x", 0.7)], "novel_id long, w string, v string, confidence_score double")
    got = {}
    for r in Q.similar_by_features(rows, ["w", "v"]).orderBy("place").collect():
        got.setdefault(r.novel_id, []).append(r.other_id)
    assert got == {2: [1], 3: [1, 2, 4]}


def test_roles_are_reusable_elements_and_have_descriptions(spark):
    row = spark.createDataFrame([("T", "r", "r", "每1章", [("师兄", "tool_info", 0.95), ("x", "contrast_foil", 0.75), ("y", "tool_info", 0.95)])], "title string, a string, b string, rhythm string, roles array<struct<role_name:string,function_type:string,reusability:double>>")
    c = F.col
    found = row.select(BM.reusable_elements(c("title"), c("a"), c("b"), F.lit(0.5), c("rhythm"), c("roles")).alias("e")).first().e
    assert [(e.element, e.description, e.score) for e in found] == [("冲突公式", "可复用《T》的冲突公式结构", 0.5), ("配角模板", "『师兄』类型的tool_info配角可复用", 0.95), ("爽点节奏", "可复用节奏模式：每1章", 0.75)]
    chapters = spark.createDataFrame([(1, 1, "小王师兄送来消息和情报。小王师兄又来。")], "novel_id long, chapter_number int, content string")
    persons = spark.createDataFrame([(1, "小王师兄", 2)], "novel_id long, person string, mentions long")
    role = C.supporting_roles(chapters, persons).first()
    assert role.relationship == "同门" and role.role_description and role.plot_function


def test_a_novel_without_benchmarks_is_told_so(spark):
    t = bindings.Tables(spark, SF)
    rows = BM.comparison(q_fusion._profiles(t), q_fusion._shelf(t).limit(0), describe=q_fusion._described).limit(3).collect()
    assert len(rows) == 3
    for r in rows:
        assert [x.suggestion for x in r.suggestions] == [BM.NO_LIBRARY] and (r.similar, r.reusable, r.differentiation) == ([], [], [])


def test_model_calls_leave_the_partitions_alone(spark):
    rows = spark.range(40).repartition(7).select(F.col("id").alias("novel_id"), F.col("id").cast("string").alias("prompt"))
    out = P.apply_model(rows, lambda p: p + "!")
    assert out.rdd.getNumPartitions() == 7 and {(r.novel_id, r.response) for r in out.collect()} == {(i, f"{i}!") for i in range(40)}


def test_declared_tables_are_small(spark, monkeypatch):
    """Patterns and categories are declared tables of bounded size; keywords have no bound any more."""
    monkeypatch.setattr(textfn, "MOST_DECLARED", 3)
    books = spark.createDataFrame([(1, "x")], "novel_id long, text string")
    with pytest.raises(ValueError):
        R.lexicon_scores(books, spark.range(4).select(F.col("id").cast("string").alias("category"), F.lit(0).alias("cat_ord"), F.lit("x").alias("keyword")))
    patterns = [(str(k), k, "p", "f", "regex", None, "x", "v", 1.0, True, None) for k in range(4)]
    with pytest.raises(ValueError):
        R.rule_scores(books, spark.createDataFrame(patterns, schemas.RULES))
    many = spark.range(20).select(F.lit("c").alias("category"), F.lit(0).alias("cat_ord"), F.concat(F.lit("x"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("keyword"))
    assert [tuple(r) for r in R.lexicon_scores(books, many).select("n", "present").collect()] == [(1, 1)]


def test_relational_scan_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("TWICE")).write.jdbc(f"{url};create=true", "NUMBERS")
    rows = files.read_relational(spark, url, "NUMBERS", "ID", 0, 1000, 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 1000
    assert sorted(tuple(r) for r in files.relational(rows, ["TWICE + 1 as n"], "ID < 3").collect()) == [(1,), (3,), (5,)]


def test_deep_features_are_compared_with_the_library(spark):
    t = bindings.Tables(spark, SF)
    books = t.books.where("novel_id < 12").select("novel_id", "text")
    chapters = t.chapters.where("novel_id < 12")
    library = q_fusion._library(t).withColumn("genre", F.lit("city"))  # the first genre of one formula
    rows = deep.deep_features(books, chapters, q_fusion.DEEP, library).select("novel_id", "formula_name", "benchmark_comparisons").collect()
    assert len(rows) == books.count()
    for r in rows:
        lists = r.benchmark_comparisons
        assert len(lists.similar) == (3 if r.formula_name == "rise" else 0)
        assert ([x.suggestion for x in lists.suggestions] == [BM.NO_LIBRARY]) == (not lists.similar)
    assert {bool(r.benchmark_comparisons.similar) for r in rows} == {True, False}


def test_incremental_parsing_without_new_chapters_changes_nothing(spark):
    was = spark.createDataFrame([(1, "old", None, 0.1)], "novel_id long, world_type string, task_structure string, confidence_score double")
    chapters = spark.createDataFrame([(1, 1, "the and", "h1")], "novel_id long, chapter_number int, content string, chapter_hash string")
    rules = q_text.rule_table(bindings.Tables(spark, SF), q_text.FIELD_ROWS)
    assert [tuple(r) for r in deep.incremental_features(chapters, was, chapters, rules).collect()] == [(1, "old", None, 0.1)]
    out = deep.incremental_features(chapters, was, chapters.withColumn("chapter_hash", F.lit("h2")), rules).first()
    assert out.world_type == "english" and out.confidence_score > 0.1


def test_a_mean_mystery_at_the_bound_counts_no_more(spark):
    kinds = {k: [k] for k in ("aa", "bb", "cc")}
    for held in ((1, 2, 3), (3, 2, 1), (1, 1, 4), (2, 2, 2)):  # six of fifteen: the mean is 0.6, which floating sums may miss
        rows = [(1, i + 1, " ".join(k for k, h in zip(kinds, held, strict=True) if i < h)) for i in range(5)]
        chapters = spark.createDataFrame(rows, "novel_id long, chapter_number int, content string")
        cast = spark.createDataFrame([(1, [])], "novel_id long, cast array<struct<person: string, mentions: long>>")
        assert deep.chapter_features(chapters, cast, {"narrative": {"kinds": kinds}}).first().mean_mystery == 0.6
    found = N.mean_mystery(F.lit(3), F.lit(6), F.lit(5))
    assert spark.range(1).select(N.difficulty(F.lit(0.1), F.lit(3), found).alias("d")).first().d == 4


def test_equal_scores_go_by_the_order_of_rules(spark):
    text, words = " ".join("abcdefghij"), list("abcdefghij")
    rows = [("one", 0, ["a", "0"], "first", 0.6)] + [(f"r{i}", i, [w], "second", 0.1) for i, w in enumerate(words[:3], 1)]  # 0.1 + 0.1 + 0.1 > 0.3
    table = [(rule, k, rule, "f", "keyword", keys, None, value, weight, True, None) for rule, k, keys, value, weight in rows]
    found = R.apply_rules(spark.createDataFrame([(1, text)], "novel_id long, text string"), spark.createDataFrame(table, schemas.RULES))
    assert found.first().value == "first"


def _sums_of_three_tenths(spark):
    """A novel and two benchmarks of similarity 0.3: 0.15 + 0.15 is the more read, 0.2 + 0.1 the larger as a floating sum."""
    fields = "genre string, conflict_type string, gf_type string, arc_type string, rhythm_pattern string, short_ratio double, top_hook string"
    novels = spark.createDataFrame([(1, "g", "c", "f", "a", "每", 0.1, "h")], f"novel_id long, {fields}")
    library = [(7, "B7", True, 9, "g", "-", "f", "a", "-", 0.1, "h"), (8, "B8", True, 5, "g", "c", "-", "-", "每", 0.1, "h")]
    return novels, spark.createDataFrame(library, f"benchmark_id long, title string, is_active boolean, read_count int, {fields}")


def test_equal_similarities_go_by_reads(spark):
    rows = BM.compare(*_sums_of_three_tenths(spark)).orderBy("place").collect()
    assert [r.benchmark_id for r in rows] == [7, 8] and [round(r.similarity, 9) for r in rows] == [0.3, 0.3]


def test_reusable_elements_follow_reads_of_equal_similarities(spark):
    novels, library = _sums_of_three_tenths(spark)
    c = F.col
    elements = BM.reusable_elements(c("title"), c("conflict_type"), c("__conflict_type"), F.lit(0.5), c("rhythm_pattern"))
    rows = BM.compare(novels, library).orderBy("place").select(elements["source"].alias("s")).collect()
    assert [r.s for r in rows] == [["B7"], ["B8", "B8"]]
