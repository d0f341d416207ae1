"""Fusion of rule and model features, quality checks and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textfn import compact, mean_of

#: Weight of the model's value for each single-valued field; below 0.5 the rules' value wins.
WEIGHTS = {
    "main_task": 0.7, "task_structure": 0.6, "task_difficulty": 0.7, "world_type": 0.4, "era_setting": 0.6, "power_system": 0.3,
    "narrative_perspective": 0.3, "pacing": 0.5, "sentence_structure": 0.6, "humor_style": 0.5, "plot_structure": 0.7, "climax_distribution": 0.6,
}
LISTS = ["sub_tasks", "major_factions", "world_rules", "character_archetypes", "rhetoric_style", "suspense_techniques", "conflict_types", "foreshadowing"]
MODEL_FIRST = ["protagonist"]
AGREED = ["world_type", "power_system", "narrative_perspective", "task_structure"]
SINGLE_FILLED = ["main_task", "task_structure", "world_type", "power_system", "protagonist", "narrative_perspective", "pacing", "plot_structure"]
LIST_FILLED = ["sub_tasks", "conflict_types"]


def select_best(rule: Column, model: Column, weight: float = 0.5) -> Column:
    """The side that has a value; of two the model's from weight 0.5 on, else the rules'."""
    return F.coalesce(model, rule) if weight >= 0.5 else F.coalesce(rule, model)


def merge_lists(rule: Column, model: Column) -> Column:
    """The model's items, then the rules', without empty ones and repeats."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(model, none), F.coalesce(rule, none)), lambda x: x.isNotNull() & (x != "")))


def consistency(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of fields, among those that both sides have, that agree; 0.5 where there is none."""
    both = [(a.isNotNull() & (a != "") & b.isNotNull() & (b != ""), a == b) for a, b in pairs]
    n = reduce(lambda x, y: x + y, [F.when(x, 1).otherwise(0) for x, _ in both])
    same = reduce(lambda x, y: x + y, [F.when(x & y, 1).otherwise(0) for x, y in both])
    return F.when(n > 0, same / n).otherwise(0.5)


def completeness(single: list[Column], lists: list[Column]) -> Column:
    """Share of fields that are filled."""
    flags = [c.isNotNull().cast("int") for c in single] + [F.coalesce((F.size(c) > 0).cast("int"), F.lit(0)) for c in lists]
    return reduce(lambda x, y: x + y, flags) / len(flags)


def fusion_confidence(rule: Column, model: Column, agreed: Column, filled: Column) -> Column:
    return F.least((rule * 0.4 + model * 0.6) * 0.6 + agreed * 0.2 + filled * 0.2, F.lit(1.0))


def fuse_features(rules: DataFrame, model: DataFrame) -> DataFrame:
    """One fused row for each novel in either table; fields are columns of those names, where there.

    A side without the novel counts as empty with confidence 0.
    """
    names = [c for c in dict.fromkeys(rules.columns + model.columns) if c != "novel_id"]
    side = lambda df, p: df.select("novel_id", *[(F.col(c) if c in df.columns else F.lit(None).cast(dict(rules.dtypes + model.dtypes)[c])).alias(f"{p}_{c}") for c in names])
    both = side(rules, "r").join(side(model, "m").hint("merge"), "novel_id", "full_outer")
    r, m = (lambda c: F.col(f"r_{c}")), (lambda c: F.col(f"m_{c}"))
    out = {}
    for c in names:
        if c in WEIGHTS:
            out[c] = select_best(r(c), m(c), WEIGHTS[c])
        elif c in LISTS:
            out[c] = merge_lists(r(c), m(c))
        elif c in MODEL_FIRST:
            out[c] = F.coalesce(m(c), r(c))
        elif c == "plot_twists":
            out[c] = F.when(F.coalesce(m(c), F.lit(0)) > 0, m(c)).otherwise(F.coalesce(r(c), F.lit(0)))
    agreed = consistency([(r(c), m(c)) for c in AGREED if c in names])
    filled = completeness([out.get(c, F.lit(None).cast("string")) for c in SINGLE_FILLED], [out.get(c, F.array()) for c in LIST_FILLED])
    sure = fusion_confidence(F.coalesce(r("confidence_score"), F.lit(0.0)), F.coalesce(m("confidence_score"), F.lit(0.0)), agreed, filled)
    return both.select("novel_id", *[v.alias(k) for k, v in out.items()], agreed.alias("consistency"), filled.alias("completeness"), sure.alias("confidence_score"), F.lit("fusion").alias("extraction_method"))


def engine_switch(rules: DataFrame | None, model: DataFrame | None) -> DataFrame | None:
    """Both: fused; one: that one; none: nothing."""
    return fuse_features(rules, model) if rules is not None and model is not None else rules if rules is not None else model


def validate_features(confidence: Column, world_type: Column, task_structure: Column, power_system: Column, least: float = 0.7, cultivation: str = "仙侠") -> Column:
    """Array of issues; empty where the features are valid."""
    missing = lambda c: c.isNull() | (c == "")
    return compact(
        F.when(confidence < least, "Confidence score too low"), F.when(missing(world_type), "Missing world_type"),
        F.when(missing(task_structure), "Missing task_structure"), F.when((world_type == cultivation) & missing(power_system), "Xianxia novel missing power_system"),
    )


def merge_by_confidence(old: DataFrame, new: DataFrame, key: str = "novel_id", by: str = "confidence_score") -> DataFrame:
    """The new row only where its confidence is strictly higher; rows of one side stay."""
    a = old.select(F.col(key), F.struct(*old.columns).alias("__old"))
    b = new.select(F.col(key), F.struct(*old.columns).alias("__new"))
    take = F.col("__old").isNull() | (F.col(f"__new.{by}") > F.col(f"__old.{by}"))
    return a.join(b.hint("merge"), key, "full_outer").select(F.when(F.col("__new").isNotNull() & take, F.col("__new")).otherwise(F.col("__old")).alias("row")).select("row.*")


def incremental_chapters(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """The chapters whose hash is not known yet."""
    return incoming.join(known.select("chapter_hash").distinct().hint("merge"), "chapter_hash", "left_anti")


def overall_quality(reuse: Column, unique: Column, coherent: Column, novel: Column, satisfying: Column, memorable: Column, rhythm: Column, difficulty: Column) -> Column:
    total = (reuse * 0.15 + unique * 0.10) + (coherent * 0.10 + novel * 0.10) + (satisfying * 0.15 + memorable * 0.10) + (rhythm * 0.10 + (1 - difficulty / 5) * 0.10)
    return F.least(total, F.lit(1.0))


def reusable_tags(formula: Column, gf: Column, growth: Column, rhythm: Column, arc: Column, innovations: Column) -> Column:
    fixed = [F.concat(F.lit(f"{label}:"), c) for label, c in zip(("冲突公式", "金手指", "成长性", "情绪节奏", "人物弧光"), (formula, gf, growth, rhythm, arc), strict=True)]
    return F.concat(F.array(*fixed), F.transform(innovations, lambda x: F.concat(F.lit("创新:"), F.substr(x, F.lit(1), F.lit(20)))))


def reverse_summary(desire: Column, obstacle: Column, path: Column, gf: Column, growth: Column, power: Column, start: Column, end: Column, arc: Column, hook: Column, rhythm: Column) -> Column:
    lit = F.lit
    return F.concat_ws(
        "\n",
        F.concat(lit("这是一个关于『"), desire, lit("』的故事，主角面临『"), obstacle, lit("』的阻碍，通过『"), path, lit("』实现目标。")),
        F.concat(lit("主角拥有『"), gf, lit("』金手指，具有『"), growth, lit("』特性，初始能力为『"), power, lit("』。")),
        F.concat(lit("主角从『"), start, lit("』成长为『"), end, lit("』，完成『"), arc, lit("』的人物弧光。")),
        F.concat(lit("故事以『"), hook, lit("』为主要情绪驱动，形成『"), rhythm, lit("』的阅读体验。")),
    )


def consistency_check(conflict: Column, growth: Column, formula: Column, arc: Column, scenarios: Column, rhythm: Column, n_constraints: Column, difficulty: Column, compat: bool = True) -> Column:
    """Mean of the checks that apply. ``compat`` keeps whole-item membership, by which the pace check never applies."""
    fast = F.array_contains(scenarios, "快节奏") if compat else F.exists(scenarios, lambda x: F.startswith(x, F.lit("快节奏")))
    part = lambda t, w: F.contains(t, F.lit(w))
    checks = compact(
        F.when(conflict.isin("underdog_revenge", "revenge"), F.when(growth.isin("dynamic_linear", "dynamic_exp"), 1.0).otherwise(0.7)),
        F.when(part(formula, "逆袭") & (arc == "weak_to_strong"), 1.0).when(part(formula, "成长") & (arc == "coming_of_age"), 1.0).otherwise(0.8),
        F.when(fast, F.when(part(rhythm, "每1-3章"), 1.0).otherwise(0.8)),
        F.when(n_constraints >= 2, F.when(difficulty >= 3, 1.0).otherwise(0.8)),
    )
    return mean_of(checks, 0.8)


def formula_string(desire: Column, obstacle: Column, path: Column) -> Column:
    return F.concat_ws(" + ", desire, obstacle, path)


def formula_summary(formula: Column, gf: Column, growth: Column, arc: Column, rhythm: Column) -> Column:
    return F.concat_ws(" | ", formula, F.concat(gf, F.lit("/"), growth), arc, rhythm)


def creative_report(deep: DataFrame) -> DataFrame:
    """``(novel_id, report)``: a nested projection as JSON."""
    report = F.struct(
        formula_string(F.col("desire"), F.col("obstacle"), F.col("path")).alias("core_formula"), F.col("rhythm_pattern").alias("emotional_rhythm"),
        F.struct(F.col("gf_type").alias("type"), F.col("growth_type").alias("growth"), F.col("constraint_types").alias("constraints")).alias("golden_finger_design"),
        F.struct(F.col("arc_type").alias("type"), F.col("completion")).alias("character_arc"),
        F.struct(F.col("segment").alias("target_audience"), F.col("best_adaptation"), F.col("monetization_path")).alias("commercial_highlights"),
        F.struct(F.col("reusable_tags").alias("tags"), F.col("genres").alias("applicable_genres")).alias("reusable_template"),
    )
    return deep.select("novel_id", F.to_json(report).alias("report"))


def comparison_report(compared: DataFrame) -> DataFrame:
    """``(novel_id, report)`` from the lists ``differentiation``, ``reusable`` and ``suggestions``."""
    rule = "=" * 60
    parts = [
        F.array(F.lit(rule), F.lit("对比分析报告"), F.lit(rule), F.lit(""), F.lit("【差异化优势】")),
        F.flatten(F.transform("differentiation", lambda d: F.array(F.concat(F.lit("• ["), d["dimension"], F.lit("] "), d["point"]), F.concat(F.lit("  独特性评分: "), d["score"].cast("string")), F.lit("")))),
        F.array(F.lit("【可复用元素】")),
        F.flatten(F.transform("reusable", lambda d: F.array(F.concat(F.lit("• ["), d["element"], F.lit("] 来源:《"), d["source"], F.lit("》")), F.concat(F.lit("  "), d["description"]), F.concat(F.lit("  可复用性: "), d["score"].cast("string")), F.lit("")))),
        F.array(F.lit("【优化建议】")),
        F.flatten(F.transform("suggestions", lambda d: F.array(F.concat(F.when(d["priority"] == "high", "🔴").otherwise("🟡"), F.lit(" ["), d["category"], F.lit("] "), d["suggestion"]), F.concat(F.lit("   参考: "), d["reference"]), F.lit("")))),
        F.array(F.lit(rule)),
    ]
    none = (F.size("differentiation") + F.size("reusable") + F.size("suggestions")) == 0
    return compared.select("novel_id", F.when(none, "暂无基准对比数据").otherwise(F.array_join(F.concat(*parts), "\n")).alias("report"))


def extract_keywords(*fields: Column) -> Column:
    """The fields that have a value."""
    return compact(*[F.nullif(f, F.lit("")) for f in fields])


def range_checks(columns: dict[str, tuple[float, float]]) -> Column:
    """Names of the columns outside their bounds; values are told, not changed."""
    return compact(*[F.when((F.col(c) < low) | (F.col(c) > high), F.lit(c)) for c, (low, high) in columns.items()])
