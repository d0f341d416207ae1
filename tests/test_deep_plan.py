"""The chain of all dimensions reads and joins little; its parts equal the operators of their own."""

from __future__ import annotations

from storyspark.operators import character, commercial, deep, narrative, setting, story
from storyspark.plans import bindings, q_fusion

from .conftest import SF


def test_three_scans_and_two_joins(spark):
    t = bindings.Tables(spark, SF)
    plan = q_fusion.v6_deep_fuse(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and plan.count("SortMergeJoin") <= 2 and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def test_parts_equal_their_operators(spark):
    """Columns that the registered chain doesn't return, against the operators with the built-in word lists."""
    text = {
        1: "他很弱。系统提示：任务完成！必须付出代价。「你好」李明说道。李明是师父。\n突然，他突破了。震惊！震惊！震惊！震惊！\n成长，复仇。打脸打脸。他笑了。张三道：好。",
        2: "我来到这里。只能如此。不能离开。\n我看见光。规则利用。",
        3: "",
        4: None,
    }
    books = spark.createDataFrame(list(text.items()), "novel_id long, text string")
    chapters = [(b, i + 1, x) for b, t in text.items() if t for i, x in enumerate(t.split("\n"))]
    chapters = spark.createDataFrame(chapters, "novel_id long, chapter_number int, content string")
    got = {r.novel_id: r for r in deep.deep_features(books, chapters).collect()}
    assert set(got) == set(text)
    held = setting.constraints(books)
    parts = {
        story.value_proposition(books): ["core_value", "relatability"],
        story.rhythm_pattern(chapters): ["hook_chapters", "rhythm_pattern"],
        story.top_hook(chapters): ["top_hook", "total_hooks", "types_used"],
        setting.growth_type(books): ["growth_type"],
        setting.innovations(books, held): ["innovations"],
        setting.fit(setting.early_text(chapters), setting.gf_type(books)): ["pain_keyword", "pain_point", "fit_score"],
        character.arc_type(chapters): ["arc_type"],
        character.arc_completion(chapters): ["n_turning_points", "completion"],
        narrative.chapter_structure(chapters): ["paragraph_length", "dialogue_ratio", "hook_ratio"],
        narrative.sentence_stats(books): ["sentences", "short_ratio", "long_ratio", "average_length"],
        narrative.perspective(books): ["switches", "perspective"],
        commercial.audience(books): ["segment", "secondary", "age_low", "age_high"],
        commercial.payment_behavior(books): ["motivation", "triggers"],
    }
    for part, names in parts.items():
        for r in part.collect():
            assert [r[n] for n in names] == [got[r.novel_id][n] for n in names], (r, names)
    for b, own in ((b, [r for r in held.collect() if r.novel_id == b]) for b in text):
        assert got[b].constraint_types == [r.constraint_type for r in sorted(own, key=lambda r: r.place)]
    roles = character.supporting_roles(chapters, character.person_mentions(books)).collect()
    for b in text:
        assert [r.role_name for r in got[b].roles or []] == [r.role_name for r in sorted((r for r in roles if r.novel_id == b), key=lambda r: r.place)]
    assert any(got[b].roles for b in text)
