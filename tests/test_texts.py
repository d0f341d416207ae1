"""Operators on small Chinese texts, with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storyspark.functions import lexicons as L
from storyspark.functions import scores as S
from storyspark.functions.textfn import cnt, strip
from storyspark.operators import character, commercial, deep, fusion, model, narrative, rules, setting, story, text

NOVEL = """书名：测试修仙小说
作者：测试作者
简介：这是一个测试。

第一章 开始
张三师兄说道：“走。”
他在修炼。

第二章 突破
他终于筑基。

第3章：结尾
完。
"""


def books(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "novel_id string, text string")


def one(df):
    (row,) = df.collect()
    return row


def value(spark, expr, text):
    return one(books(spark, text).select(expr.alias("x"))).x


def test_clean_text(spark):
    said = value(spark, text.clean_text("text"), "　VIP章节请订阅\r\n正文\t\t内容\x07\n\n\n\n尾WWW.abc.COM　 ")
    assert said == "正文 内容\n\n尾"
    assert value(spark, strip("text"), "　 a b\n") == "a b"


def test_count_does_not_overlap(spark):
    assert value(spark, cnt("text", "aa"), "aaaaa") == 2 and value(spark, cnt("text", "x"), None) == 0


def test_split_and_metadata(spark):
    got = text.parse_book(books(spark, NOVEL)).orderBy("chapter_number").collect()
    assert [(r.chapter_number, r.title, r.content) for r in got] == [(1, "第一章 开始", "张三师兄说道：“走。”\n他在修炼。"), (2, "第二章 突破", "他终于筑基。"), (3, "第3章：结尾", "完。")]
    assert (got[0].novel_title, got[0].novel_author, got[0].novel_description) == ("测试修仙小说", "测试作者", "这是一个测试。")
    assert all(r.is_core for r in got) and got[0].total_word_count == sum(r.word_count for r in got)


def test_split_edges(spark):
    plain = "no title here\nsecond line"
    empty = "第一章 空\n第二章 满\n字"
    before = "序言\nChapter 7 x\ncontent\n第一章"
    got = {(r.novel_id, r.chapter_number): r.content for r in text.split_chapters(books(spark, plain, empty, before)).collect()}
    assert got == {("0", 1): plain, ("1", 2): "字", ("2", 1): "content\n第一章"}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 20, 21, 30])
def test_core_and_sampling(spark, n):
    ch = spark.createDataFrame([("a", i + 1, f"第{i + 1}章内容") for i in range(n)], "novel_id string, chapter_number int, content string")
    core = {r.chapter_number - 1 for r in text.mark_core_chapters(ch).where("is_core").collect()}
    assert core == {i for i in range(n) if n <= 20 or i < 10 or i >= n - 5 or (10 <= i < n - 5 and (i - 10) % 10 == 0)}
    picked = sorted(r.chapter_number - 1 for r in text.select_chapters(ch, "sampling").collect())
    want = []
    for start in (0, n // 4, n // 2, n * 3 // 4, n - 3):
        want += [k % n for k in range(start, start + 3) if n and -n <= k < n]
    assert picked == sorted(want)
    with pytest.raises(ValueError):
        text.select_chapters(ch, "other")


def test_rules_on_cultivation_text(spark):
    said = "他开始修真修仙，灵根觉醒，筑基成功，结成金丹，元婴渡劫。系统面板弹出，系统提示：叮！任务完成，奖励发放。"
    row = one(rules.rule_features(books(spark, said), rules.builtin_rules(spark)))
    assert (row.background_world_type, row.background_power_system, row.task_task_structure) == ("仙侠", "修仙境界", "系统流")
    assert row.confidence_score == pytest.approx((0.8 + 0.9 + 0.85) / 3)
    pattern = next(r[4] for r in L.RULES if r[0] == "rule_write_firstperson")
    assert value(spark, rules.regex_rule_score("text", pattern), "我是一个人。他在修炼。") == 0
    assert value(spark, rules.regex_rule_score("text", pattern), "我，来了。") == pytest.approx(0.1)


def test_top_category_ties(spark):
    lex = {"b": ["x"], "a": ["y"]}
    assert value(spark, S.top(S.scores("text", lex)), "xy") == "b" and value(spark, S.top(S.scores("text", lex)), "") == "b"
    assert value(spark, S.score_of(S.scores("text", {"k": ["x", "x"]}), "k"), "xx") == 4


def test_repeated_keywords_stay():
    assert L.CONFLICT["survival"].count("危机") == 2 and L.CONSTRAINTS["副作用"].count("副作用") == 2


def test_merge_and_select(spark):
    row = one(spark.sql("select array('a','b','c') r, array('b','c','d') m").select(fusion.merge_lists(F.col("r"), F.col("m")).alias("x")))
    assert row.x == ["b", "c", "d", "a"]
    pick = lambda r, m, w: one(spark.range(1).select(fusion.select_best(F.lit(r).cast("string"), F.lit(m).cast("string"), w).alias("x"))).x
    assert [pick(None, None, 0.5), pick("r", None, 0.6), pick(None, "m", 0.3), pick("r", "m", 0.7), pick("r", "m", 0.3), pick("s", "s", 0.5)] == [None, "r", "m", "m", "r", "s"]


def test_constraints_and_exploits(spark):
    said = "他付出代价，会死。他付出代价，会死。使用有限制。每日只能三次，后果严重。条件"
    got = setting.constraints(books(spark, said)).orderBy("place").collect()
    assert [(r.constraint_type, r.description, r.severity) for r in got] == [("代价", "他付出代价，会死。", 5), ("限制", "使用有限制。", 3), ("限制", "每日只能三次，后果严重。", 4)]
    ch = spark.createDataFrame([("0", 1, "没有。他发现漏洞。又一个漏洞")], "novel_id string, chapter_number int, content string")
    assert [(r.chapter_number, r.description) for r in setting.rule_exploits(ch).collect()] == [(1, "他发现漏洞")]


def test_hooks(spark):
    ch = spark.createDataFrame([("0", 1, "嘲讽" + "一" * 30 + "震惊"), ("0", 4, "平静")], "novel_id string, chapter_number int, content string")
    got = [(r.keyword, r.position, r.intensity) for r in story.hook_matches(ch).where("hook_type = 'face_slap'").orderBy("keyword").collect()]
    assert got == [("嘲讽", "开头", 2), ("震惊", "结尾", 2)]
    assert one(story.rhythm_pattern(ch)).rhythm_pattern == "钩子分布稀疏"


def test_characters(spark):
    said = "王五师兄来了。李四哥说。'好吧'他说。\"走啊\"他说。"
    assert {r.person for r in character.person_mentions(books(spark, said)).collect()} >= {"王五"}
    tags = character.character_tags(books(spark, said)).collect()
    assert [(t.tag_type, t.frequency) for t in tags] == [("语言", 2)]
    assert value(spark, character.infer_relationship("text"), "大师兄") == "同门" and value(spark, character.infer_relationship("text"), "李四") == "其他"


def test_narrative(spark):
    row = one(narrative.sentence_stats(books(spark, "短。" + "长" * 31 + "！　？")))
    assert (row.sentences, row.short_ratio, row.long_ratio, row.average_length) == (2, 0.5, 0.5, 16.0)
    row = one(narrative.sentence_stats(books(spark, "")))
    assert (row.short_ratio, row.long_ratio, row.average_length) == (0.3, 0.2, 15.0)
    assert one(narrative.perspective(books(spark, "我我我他"))).perspective == "第一人称"


def test_commercial(spark):
    assert one(commercial.audience(books(spark, "大学宿舍室友，老板"))).segment == "student_college"
    rows = commercial.adaptations(books(spark, "系统升级装备技能副本任务战斗" * 6)).collect()
    assert rows[0].adaptation_type == "game" and rows[0].suitability == pytest.approx(0.6) and rows[0].key_points == ["系统", "升级", "装备"]


def test_deep_features_of_a_small_book(spark):
    b = books(spark, NOVEL)
    ch = text.split_chapters(b).select("novel_id", "chapter_number", "content")
    row = one(deep.deep_features(b, ch))
    assert 0 <= row.overall_quality <= 0.84 and len(row.reusable_tags) >= 5 and row.reverse_summary.count("\n") == 3
    got, features, progress = deep.basic_features(b, rules.builtin_rules(spark))
    assert progress.count() == 6 and got.count() == 3 and one(features).power_system == "修仙境界"


def test_model_run_and_parsing(spark):
    from storyspark.plans.q_fusion import echo

    rows = spark.createDataFrame([("a", "1234567"), ("b", "123")], "novel_id string, prompt string")
    got = {r.novel_id: r for r in model.apply_model(rows, echo, concurrency=2).collect()}
    assert got["a"].error.startswith("ValueError") and got["a"].attempts == 3 and got["b"].response == "3"
    said = '前言 {"plot": {"plot_twists": 3}} 后记'
    assert value(spark, model.parse_response(F.col("text")), said).plot.plot_twists == 3 and value(spark, model.parse_response(F.col("text")), "[]") is None
