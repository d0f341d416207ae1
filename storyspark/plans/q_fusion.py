"""Queries of fusion, checks, reports, benchmarks and model output (F, V, B, P)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.schemas import FEATURES
from ..functions.scores import scores, top
from ..operators import benchmark as BM
from ..operators import character as C
from ..operators import deep
from ..operators import fusion as U
from ..operators import model as P
from . import bindings as B
from .bindings import BOOKS, CHAPTERS, LATIN, Tables, case, cols, query, s, scored, with_
from .bindings import top as sql_top
from .q_books import C1, C2, C3, C5, C6, C7, D1, D5, D6, DERIVED, FINGERS, G1, G2, G3, G9, HC, HT, INNOVATIONS, M1, M3, M4, M5, M8, MYSTERY, N1, N2, N3, N4, SCENE, SYSTEMS, VIEW
from .q_text import CORE_TEXTS, FIELD_ROWS, FOUND, PARSE, PARSED, rule_table, titled

#: Rule rows, model rows or both for each document, by its length.
_SIDES = f"""sides as (select novel_id, genre, text, n_chars, {sql_top(LATIN, cols(LATIN))} as guess from (select *, {scored(LATIN)} from books)),
ru as (select novel_id, case when n_chars % 3 = 0 then null else genre end as world_type, guess as task_structure, case when n_chars % 2 = 0 then 'first' end as narrative_perspective, case when n_chars % 5 = 0 then 'qi' end as power_system, [genre, 'x', ''] as conflict_types, cast(n_chars % 10 as double) / 10 as confidence_score, case when n_chars % 4 = 0 then 'fast' end as pacing from sides where n_chars % 5 <> 3),
mo as (select novel_id, guess as world_type, genre as task_structure, 'first' as narrative_perspective, case when n_chars % 7 > 3 then 'mana' end as power_system, ['y', genre, 'y'] as conflict_types, cast(n_chars % 8 as double) / 8 as confidence_score, substring(text, 1, 5) as main_task from sides where n_chars % 5 <> 1)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = F.col("n_chars")
    rows = t.books.withColumn("guess", top(scores("text", LATIN)))
    ru = rows.where("n_chars % 5 != 3").select(
        "novel_id", F.when(n % 3 != 0, F.col("genre")).alias("world_type"), F.col("guess").alias("task_structure"), F.when(n % 2 == 0, "first").alias("narrative_perspective"), F.when(n % 5 == 0, "qi").alias("power_system"),
        F.array("genre", F.lit("x"), F.lit("")).alias("conflict_types"), ((n % 10).cast("double") / 10).alias("confidence_score"), F.when(n % 4 == 0, "fast").alias("pacing"),
    )
    mo = rows.where("n_chars % 5 != 1").select(
        "novel_id", F.col("guess").alias("world_type"), F.col("genre").alias("task_structure"), F.lit("first").alias("narrative_perspective"), F.when(n % 7 > 3, "mana").alias("power_system"),
        F.array(F.lit("y"), F.col("genre"), F.lit("y")).alias("conflict_types"), ((n % 8).cast("double") / 8).alias("confidence_score"), F.substr(F.col("text"), F.lit(1), F.lit(5)).alias("main_task"),
    )
    return ru, mo


_SAME = " + ".join(f"coalesce(case when r.{c} <> '' and m.{c} <> '' and r.{c} = m.{c} then 1 end, 0)" for c in U.AGREED)
_BOTH = " + ".join(f"coalesce(case when r.{c} <> '' and m.{c} <> '' then 1 end, 0)" for c in U.AGREED)
_FUSED = _SIDES + f""",
ff as (select coalesce(r.novel_id, m.novel_id) as novel_id, coalesce(r.world_type, m.world_type) as world_type, coalesce(m.task_structure, r.task_structure) as task_structure,
  coalesce(r.narrative_perspective, m.narrative_perspective) as narrative_perspective, coalesce(r.power_system, m.power_system) as power_system, r.pacing, m.main_task,
  array_to_string(list_filter(list_concat(coalesce(m.conflict_types[1:2], []), list_filter(coalesce(r.conflict_types, []), lambda x: x <> '' and not list_contains(coalesce(m.conflict_types, []), x))), lambda z: z <> ''), ',') as conflict_types,
  case when {_BOTH} > 0 then ({_SAME}) / ({_BOTH}) else 0.5e0 end as consistency, coalesce(r.confidence_score, 0.0e0) as rc, coalesce(m.confidence_score, 0.0e0) as mc from ru r full join mo m on r.novel_id = m.novel_id),
fc as (select *, (cast(main_task is not null as int) + cast(task_structure is not null as int) + cast(world_type is not null as int) + cast(power_system is not null as int) + cast(narrative_perspective is not null as int) + cast(pacing is not null as int) + cast(conflict_types <> '' as int)) / 10 as completeness from ff),
fd as (select *, least((rc * 0.4e0 + mc * 0.6e0) * 0.6e0 + consistency * 0.2e0 + completeness * 0.2e0, 1.0e0) as confidence_score from fc)"""


def _fused(t: Tables) -> DataFrame:
    return U.fuse_features(*_sides(t))


@query(with_(BOOKS, _SIDES) + "select coalesce(r.novel_id, m.novel_id) as novel_id, coalesce(r.world_type, m.world_type) as low_weight, coalesce(m.world_type, r.world_type) as high_weight from ru r full join mo m on r.novel_id = m.novel_id")
def f1_select_best(t: Tables) -> DataFrame:
    ru, mo = _sides(t)
    both = ru.select("novel_id", F.col("world_type").alias("r")).join(mo.select("novel_id", F.col("world_type").alias("m")).hint("merge"), "novel_id", "full_outer")
    return both.select("novel_id", U.select_best(F.col("r"), F.col("m"), 0.4).alias("low_weight"), U.select_best(F.col("r"), F.col("m"), 0.5).alias("high_weight"))


@query(with_(BOOKS, _FUSED) + "select novel_id, conflict_types from ff")
def f2_merge_lists(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", F.array_join("conflict_types", ",").alias("conflict_types"))


@query(with_(BOOKS, _FUSED) + "select novel_id, world_type, task_structure, narrative_perspective, power_system, pacing, main_task from ff")
def f3_fuse_features(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", "world_type", "task_structure", "narrative_perspective", "power_system", "pacing", "main_task")


@query(with_(BOOKS, _FUSED) + "select novel_id, consistency from fd")
def f4_consistency(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", "consistency")


@query(with_(BOOKS, _FUSED) + "select novel_id, completeness from fd")
def f5_completeness(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", "completeness")


@query(with_(BOOKS, _FUSED) + "select novel_id, confidence_score from fd")
def f6_fusion_confidence(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", "confidence_score")


@query(with_(BOOKS, _FUSED) + "select novel_id, array_to_string(list_filter([case when confidence_score < 0.7e0 then 'Confidence score too low' end, case when coalesce(world_type, '') = '' then 'Missing world_type' end, case when coalesce(task_structure, '') = '' then 'Missing task_structure' end, case when world_type = 'en' and coalesce(power_system, '') = '' then 'Xianxia novel missing power_system' end], lambda x: x is not null), '|') as issues from fd")
def f7_validate_features(t: Tables) -> DataFrame:
    issues = U.validate_features(F.col("confidence_score"), F.col("world_type"), F.col("task_structure"), F.col("power_system"), cultivation="en")
    return _fused(t).select("novel_id", F.array_join(issues, "|").alias("issues"))


@query(with_(BOOKS, _FUSED) + " union all ".join(f"select '{k}' as engine, novel_id, world_type, confidence_score from {v}" for k, v in (("rules", "ru"), ("model", "mo"), ("both", "fd"))))
def f8_engine_switch(t: Tables) -> DataFrame:
    ru, mo = _sides(t)
    parts = {"rules": (ru, None), "model": (None, mo), "both": (ru, mo)}
    return reduce(DataFrame.unionByName, [U.engine_switch(*v).select(F.lit(k).alias("engine"), "novel_id", "world_type", "confidence_score") for k, v in parts.items()])


@query(with_(BOOKS, _SIDES) + "select coalesce(o.novel_id, n.novel_id) as novel_id, case when n.novel_id is not null and (o.novel_id is null or n.confidence_score > o.confidence_score) then n.world_type else o.world_type end as world_type, case when n.novel_id is not null and (o.novel_id is null or n.confidence_score > o.confidence_score) then n.confidence_score else o.confidence_score end as confidence_score from ru o full join mo n on o.novel_id = n.novel_id")
def f9_merge_by_confidence(t: Tables) -> DataFrame:
    old, new = (x.select("novel_id", "world_type", "confidence_score") for x in _sides(t))
    return U.merge_by_confidence(old, new)


_Q = "select novel_id, cast(n_chars % 11 as double) / 10 as a, cast(n_chars % 7 as double) / 6 as b, cast(n_chars % 3 + 3 as int) as k, genre, source from books"


def _numbers(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.books.select("novel_id", ((n % 11).cast("double") / 10).alias("a"), ((n % 7).cast("double") / 6).alias("b"), (n % 3 + 3).cast("int").alias("k"), "genre", "source")


@query(with_(BOOKS) + f"select novel_id, least((a * 0.15e0 + b * 0.10e0) + (b * 0.10e0 + a * 0.10e0) + (a * 0.15e0 + a * 0.10e0) + (b * 0.10e0 + (1 - k / 5) * 0.10e0), 1.0e0) as quality from ({_Q})")
def f10_overall_quality(t: Tables) -> DataFrame:
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    return _numbers(t).select("novel_id", U.overall_quality(a, b, b, a, a, a, b, k).alias("quality"))


@query(with_(BOOKS) + "select novel_id, '冲突公式:' || genre || '|金手指:' || source || '|成长性:g|情绪节奏:r|人物弧光:a|创新:' || substring(text, 1, 20) as tags from books")
def f11_reusable_tags(t: Tables) -> DataFrame:
    tags = U.reusable_tags(F.col("genre"), F.col("source"), F.lit("g"), F.lit("r"), F.lit("a"), F.array(F.col("text")))
    return t.books.select("novel_id", F.array_join(tags, "|").alias("tags"))


@query(with_(BOOKS) + "select novel_id, md5('这是一个关于『' || genre || '』的故事，主角面临『o』的阻碍，通过『p』实现目标。' || chr(10) || '主角拥有『' || source || '』金手指，具有『g』特性，初始能力为『i』。' || chr(10) || '主角从『s』成长为『e』，完成『a』的人物弧光。' || chr(10) || '故事以『h』为主要情绪驱动，形成『r』的阅读体验。') as summary_md5 from books")
def f12_reverse_summary(t: Tables) -> DataFrame:
    lit = F.lit
    text = U.reverse_summary(F.col("genre"), lit("o"), lit("p"), F.col("source"), lit("g"), lit("i"), lit("s"), lit("e"), lit("a"), lit("h"), lit("r"))
    return t.books.select("novel_id", F.md5(text).alias("summary_md5"))


_CHECKS = "list_filter([case when c in ('underdog_revenge', 'revenge') then case when g in ('dynamic_linear', 'dynamic_exp') then 1.0e0 else 0.7e0 end end, case when contains(f, '逆袭') and a = 'weak_to_strong' then 1.0e0 else 0.8e0 end, case when k >= 4 then case when k >= 5 then 1.0e0 else 0.8e0 end end], lambda x: x is not null)"


@query(with_(BOOKS) + f"select novel_id, list_sum({_CHECKS}) / len({_CHECKS}) as score from (select novel_id, cast(n_chars % 3 + 3 as int) as k, case genre when 'en' then 'revenge' else 'love' end as c, case when n_chars % 2 = 0 then 'dynamic_exp' else 'static' end as g, case when n_chars % 5 = 0 then '底层逆袭公式' else 'x' end as f, case when n_chars % 7 > 2 then 'weak_to_strong' else 'y' end as a from books)")
def f13_consistency_check(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    k = (n % 3 + 3).cast("int")
    score = U.consistency_check(
        F.when(F.col("genre") == "en", "revenge").otherwise("love"), F.when(n % 2 == 0, "dynamic_exp").otherwise("static"), F.when(n % 5 == 0, "底层逆袭公式").otherwise("x"),
        F.when(n % 7 > 2, "weak_to_strong").otherwise("y"), F.array(F.lit("快节奏爽文")), F.lit("每1-3章"), F.when(k >= 4, 2).otherwise(1), F.when(k >= 5, 3).otherwise(2),
    )
    return t.books.select("novel_id", score.alias("score"))


@query(with_(BOOKS) + "select novel_id, genre || ' + ' || source || ' + z' as formula, genre || ' | ' || source || '/g | a | r' as summary from books")
def f14_formulas(t: Tables) -> DataFrame:
    lit = F.lit
    return t.books.select("novel_id", U.formula_string(F.col("genre"), F.col("source"), lit("z")).alias("formula"), U.formula_summary(F.col("genre"), F.col("source"), lit("g"), lit("a"), lit("r")).alias("summary"))


@query(with_(BOOKS) + "select novel_id, '{\"core_formula\":\"' || genre || ' + o + p\",\"emotional_rhythm\":\"r\",\"golden_finger_design\":{\"type\":\"' || source || '\",\"growth\":\"g\",\"constraints\":[\"c\"]},\"character_arc\":{\"type\":\"a\",\"completion\":0.5},\"commercial_highlights\":{\"target_audience\":\"s\",\"best_adaptation\":\"b\",\"monetization_path\":\"m\"},\"reusable_template\":{\"tags\":[\"t\"],\"applicable_genres\":[\"x\",\"y\"]}}' as report from books")
def f15_creative_report(t: Tables) -> DataFrame:
    fixed = {"obstacle": "o", "path": "p", "rhythm_pattern": "r", "growth_type": "g", "arc_type": "a", "segment": "s", "best_adaptation": "b", "monetization_path": "m"}
    rows = t.books.select("novel_id", F.col("genre").alias("desire"), F.col("source").alias("gf_type"), F.array(F.lit("c")).alias("constraint_types"), F.lit(0.5).alias("completion"), F.array(F.lit("t")).alias("reusable_tags"), F.array(F.lit("x"), F.lit("y")).alias("genres"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return U.creative_report(rows)


@query(with_(BOOKS) + "select novel_id, md5(case when n_chars % 4 = 0 then '暂无基准对比数据' else array_to_string([repeat('=', 60), '对比分析报告', repeat('=', 60), '', '【差异化优势】', '• [' || genre || '] ' || source, '  独特性评分: 0.8', '', '【可复用元素】', '【优化建议】', '🟡 [' || genre || '] s', '   参考: r', '', repeat('=', 60)], chr(10)) end) as report_md5 from books")
def f16_comparison_report(t: Tables) -> DataFrame:
    some = F.col("n_chars") % 4 != 0
    diff = F.struct(F.col("genre").alias("dimension"), F.col("source").alias("point"), F.lit(0.8).alias("score"))
    tip = F.struct(F.col("genre").alias("category"), F.lit("s").alias("suggestion"), F.lit("medium").alias("priority"), F.lit("r").alias("reference"))
    none = F.array().cast("array<struct<element:string,source:string,description:string,score:double>>")
    rows = t.books.select("novel_id", F.filter(F.array(diff), lambda x: some).alias("differentiation"), none.alias("reusable"), F.filter(F.array(tip), lambda x: some).alias("suggestions"))
    return U.comparison_report(rows).select("novel_id", F.md5("report").alias("report_md5"))


@query(with_(BOOKS, _FUSED) + "select novel_id, array_to_string(list_filter([world_type, power_system, task_structure, narrative_perspective], lambda x: x is not null and x <> ''), ',') as keywords from ff")
def f17_extract_keywords(t: Tables) -> DataFrame:
    return _fused(t).select("novel_id", F.array_join(U.extract_keywords(F.col("world_type"), F.col("power_system"), F.col("task_structure"), F.col("narrative_perspective")), ",").alias("keywords"))


#: Known are two thirds of the chapters; of those that come in, every fifth has changed.
_NEW = (
    CHAPTERS + ", old as (select distinct md5(content) as h from chapters where chapter_number % 3 > 0), inc as (select novel_id, chapter_number, case when chapter_number % 5 = 0 then content || '!' else content end as content from chapters), "
    "books as (select novel_id, string_agg(content, chr(10) || chr(10) order by chapter_number) as text from inc where md5(content) not in (select h from old) group by 1), "
    "was as (select doc_id as novel_id, 'old' as world_type, null as task_structure, cast(n_chars % 10 as double) / 10 as confidence_score from documents)"
)


@query(with_(_NEW, FOUND) + "select o.novel_id, case when n.confidence_score > o.confidence_score then n.world_type else o.world_type end as world_type, case when n.confidence_score > o.confidence_score then n.task_structure else o.task_structure end as task_structure, case when n.confidence_score > o.confidence_score then n.confidence_score else o.confidence_score end as confidence_score from was o left join found n using (novel_id)")
def v2_incremental_features(t: Tables) -> DataFrame:
    n = F.col("chapter_number")
    known = t.chapters.where(n % 3 > 0).withColumn("chapter_hash", F.md5("content"))
    new = t.chapters.withColumn("content", F.when(n % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("chapter_hash", F.md5("content"))
    was = t.books.select("novel_id", F.lit("old").alias("world_type"), F.lit(None).cast("string").alias("task_structure"), ((F.col("n_chars") % 10).cast("double") / 10).alias("confidence_score"))
    return deep.incremental_features(known, was, new, rule_table(t, FIELD_ROWS))


@query(with_(BOOKS) + f"select novel_id, array_to_string(list_filter([case when a < 0 or a > 0.9e0 then 'a' end, case when b < 0.1e0 or b > 1 then 'b' end, case when k < 1 or k > 4 then 'k' end], lambda x: x is not null), ',') as issues from ({_Q})")
def v3_range_checks(t: Tables) -> DataFrame:
    return _numbers(t).select("novel_id", F.array_join(U.range_checks({"a": (0, 0.9), "b": (0.1, 1), "k": (1, 4)}), ",").alias("issues"))


# --- composites

DEEP = {
    "story": dict(conflict=LATIN, hooks=LATIN, values=LATIN, formulas=B.FORMULAS, default=B.FORMULA_DEFAULT, common=("en", "fr")),
    "setting": dict(fingers=FINGERS, growth=B.GROWTH, limits=B.LIMITS, stop=".", gravest=["ea", "sch"], grave=["on", "los"], systems=SYSTEMS, resources=["lles", "thing"], pains=B.PAINS, solves=(("system", "ing"), ("item", "eau")), mood="eaux", price="price"),
    "character": dict(arcs=B.ARCS, turnings=B.TURNINGS, persons=B.PERSONS, roles=B.ROLES, stop=".", speech=B.SPEECH, behaviours=B.BEHAVIOURS, habits=B.HABITS, reusable=["info", "foe"], popular=["a", "c"]),
    "narrative": dict(kinds=B.INFO, methods=B.METHODS, marks="[.!?;]", other="found", **VIEW),
    "commercial": dict(audiences=B.SEGMENTS, triggers=LATIN, kinds=B.KINDS, ages=B.AGES, base=B.ARPU, motives=B.MOTIVES, costs=B.COSTS, scene=SCENE, **DERIVED),
}
#: The chain of all dimensions, from the SQL of their parts; books stand for the quoted ones.
_DEEP_PARTS = (
    "quoted as (select novel_id, text from books)", HC, D1, D5, D6, HT, G1, G2, G3, G9, C1, C2, C3, C5, C6, C7, N1, N2, N3, N4, M1, M3, M4, M5, M8,
    f"h as (select novel_id, bool_or(constraint_type = 'price') as priced, max(severity) >= 4 as grave, count(*) as n_constraints from g3 group by 1), inn as (select novel_id, {INNOVATIONS} as innovations from books left join h using (novel_id))",
    "k9 as (select novel_id, count(*) as n_rules from g9 group by 1), k5 as (select novel_id, count(*) as n_tags from c5 group by 1), k7 as (select novel_id, count(*) as n_roles from c7 group by 1), k2 as (select novel_id, count(*) as n_releases, " + MYSTERY + " as mystery from n2 group by 1), roi as (select novel_id, max(roi) as max_roi from m5 group by 1)",
    f"""deep as (select b.novel_id, d1.conflict_type, d1.formula_name, desire, obstacle, path, d1.reusability, coalesce(rhythm_pattern, '无明显节奏') as rhythm_pattern, coalesce(top_hook, 'en') as top_hook, value_type,
 least(case when d1.conflict_type in ('en', 'fr') then 0.7e0 else 0.85e0 end + coalesce(types_used, 0) / 4 * 0.2e0 + case when contains(coalesce(rhythm_pattern, ''), '大爽点') then 0.1e0 else 0.0e0 end, 1.0e0) as uniqueness,
 gf_type, growth_type, coalesce(n_constraints, 0) as n_constraints, innovations, least(0.8e0 + coalesce(n_constraints, 0) * 0.05e0 + coalesce(n_rules, 0) * 0.05e0, 1.0e0) as coherence,
 1 - greatest(case when (gf_type, growth_type) in (('system', 'dynamic_linear'), ('rebirth', 'static')) then 0.7e0 else 0.5e0 end - coalesce(n_constraints, 0) * 0.1e0, 0.1e0) as novelty,
 coalesce(arc_type, 'a') as arc_type, least(case when coalesce(arc_type, 'a') in ('a', 'c') then 0.75e0 else 0.7e0 end + coalesce(completion, 0.5e0) * 0.25e0, 1.0e0) as satisfaction,
 least(0.6e0 + coalesce(completion, 0.5e0) * 0.15e0 + least(coalesce(n_tags, 0) * 0.03e0, 0.15e0) + least(coalesce(n_roles, 0) * 0.02e0, 0.1e0), 1.0e0) as memorability,
 perspective, greatest(least(0.5e0 + (short_ratio - 0.3e0) * 0.5e0 - least(switches * 0.02e0, 0.1e0), 1.0e0), 0.0e0) as rhythm_score, least(3 + cast(coalesce(n_releases, 0) > 2 as int) + cast(coalesce(mystery, 0) > 0.6e0 as int), 5) as difficulty,
 m1.segment, least(least(arpu / 100, 1.0e0) * 0.3e0 + case when max_roi is null then 0.1e0 else max_roi / 5 * 0.4e0 end + case when len(p) > 0 then list_sum(p) / len(p) * 0.3e0 else 0.1e0 end, 1.0e0) as commercial_score, {case('gf_type', {k: v for k, v in L.INITIAL_POWERS.items()}, s('未知初始能力'))} as initial_power
 from books b join d1 using (novel_id) join d6 using (novel_id) left join d5 using (novel_id) left join th using (novel_id) join g1 using (novel_id) join g2 using (novel_id) left join h using (novel_id) join inn using (novel_id) left join k9 using (novel_id)
 left join c1 using (novel_id) left join c3 using (novel_id) left join k5 using (novel_id) left join k7 using (novel_id) join n3 using (novel_id) join n4 using (novel_id) left join k2 using (novel_id) join m1 using (novel_id) join m4 using (novel_id) join m8 using (novel_id) left join roi using (novel_id))""",
    f"""fused as (select *, least((reusability * 0.15e0 + uniqueness * 0.10e0) + (coherence * 0.10e0 + novelty * 0.10e0) + (satisfaction * 0.15e0 + memorability * 0.10e0) + (rhythm_score * 0.10e0 + (1 - difficulty / 5) * 0.10e0), 1.0e0) as overall_quality,
 case when n_constraints >= 2 then 0.9e0 else 0.8e0 end as consistency_score,
 '冲突公式:' || formula_name || '|金手指:' || gf_type || '|成长性:' || growth_type || '|情绪节奏:' || rhythm_pattern || '|人物弧光:' || arc_type || coalesce('|' || array_to_string(list_transform(innovations, lambda x: '创新:' || substring(x, 1, 20)), '|'), '') as tags,
 '这是一个关于『' || desire || '』的故事，主角面临『' || obstacle || '』的阻碍，通过『' || path || '』实现目标。' || chr(10) || '主角拥有『' || gf_type || '』金手指，具有『' || growth_type || '』特性，初始能力为『' || initial_power || '』。' || chr(10) || '主角从『普通状态』成长为『成长后的状态』，完成『' || arc_type || '』的人物弧光。' || chr(10) || '故事以『' || top_hook || '』为主要情绪驱动，形成『' || rhythm_pattern || '』的阅读体验。' as reverse_summary,
 formula_name || ' | ' || gf_type || '/' || growth_type || ' | ' || arc_type || ' | ' || rhythm_pattern as formula_summary from deep)""",
)
_DEEP = with_(BOOKS, CHAPTERS, *_DEEP_PARTS)


def _deep(t: Tables) -> DataFrame:
    return deep.deep_features(t.books.select("novel_id", "text"), t.chapters, DEEP)


_V1 = ["conflict_type", "gf_type", "arc_type", "perspective", "segment", "rhythm_pattern", "value_type", "uniqueness", "coherence", "novelty", "satisfaction", "memorability", "rhythm_score", "difficulty", "commercial_score"]


@query(_DEEP + f"select novel_id, {', '.join(_V1)} from fused")
def v1_deep_features(t: Tables) -> DataFrame:
    return _deep(t).select("novel_id", *_V1)


@query(_DEEP + "select novel_id, overall_quality, consistency_score, rtrim(tags, '|') as reusable_tags, reverse_summary, formula_summary from fused")
def v6_deep_fuse(t: Tables) -> DataFrame:
    return _deep(t).select("novel_id", "overall_quality", "consistency_score", F.array_join("reusable_tags", "|").alias("reusable_tags"), "reverse_summary", "formula_summary")


_ISSUES = "array_to_string(list_filter([case when confidence_score < 0.7e0 then 'Confidence score too low' end, case when coalesce(world_type, '') = '' then 'Missing world_type' end, case when coalesce(task_structure, '') = '' then 'Missing task_structure' end], lambda x: x is not null), '|')"


@query(with_(PARSED, CORE_TEXTS, FOUND) + f"select novel_id, task_structure, world_type, confidence_score, {_ISSUES} as issues, 6 as steps, 100.0e0 as progress, chapters from found join (select novel_id, count(*) as chapters from split group by 1) using (novel_id)")
def v4_basic_features(t: Tables) -> DataFrame:
    out = deep.basic_features(titled(t), rule_table(t, FIELD_ROWS), **PARSE)
    steps = out.progress.groupBy("novel_id").agg(F.count("*").cast("int").alias("steps"), F.max_by("progress", "ord").alias("progress"))
    n = out.chapters.groupBy("novel_id").agg(F.count("*").alias("chapters"))
    return out.features.select("novel_id", "task_structure", "world_type", "confidence_score", F.array_join("issues", "|").alias("issues")).join(steps.hint("merge"), "novel_id").join(n.hint("merge"), "novel_id")


@query(_DEEP + "select novel_id, conflict_type, uniqueness, gf_type, coherence, arc_type, memorability, perspective, rhythm_score, segment, commercial_score, overall_quality from fused")
def v5_dimension_structs(t: Tables) -> DataFrame:
    rows = deep.dimension_structs(_deep(t))
    told = "story_core.conflict_type story_core.uniqueness core_setting.gf_type core_setting.coherence character_analysis.arc_type character_analysis.memorability narrative_technique.perspective narrative_technique.rhythm_score commercial_value.segment commercial_value.commercial_score"
    return rows.select("novel_id", *told.split(), "overall_quality")


@query(with_(PARSED, CORE_TEXTS, FOUND) + "select novel_id, world_type, confidence_score from found where novel_id in (select doc_id from labels)")
def p6_parse_novels_batch(t: Tables) -> DataFrame:
    wanted = t.read("labels").select(F.col("doc_id").alias("novel_id"))
    return deep.parse_batch(titled(t), wanted, rule_table(t, FIELD_ROWS), **PARSE).select("novel_id", "world_type", "confidence_score")


#: What a model told of most of the books, and the features that rules and model give together.
_MODEL = "mo as (select doc_id as novel_id, source as world_type, lang as task_structure, cast(n_chars % 8 as double) / 8 as confidence_score from documents where n_chars % 5 <> 1)"
_WITH_MODEL = f"""{_MODEL}, fm as (select coalesce(r.novel_id, m.novel_id) as novel_id, coalesce(r.world_type, m.world_type) as world_type, coalesce(m.task_structure, r.task_structure) as task_structure,
 case when ({{both}}) > 0 then ({{same}}) / ({{both}}) else 0.5e0 end as consistency, coalesce(r.confidence_score, 0.0e0) as rc, coalesce(m.confidence_score, 0.0e0) as mc from found r full join mo m using (novel_id)),
fused as (select novel_id, world_type, task_structure, consistency, least((rc * 0.4e0 + mc * 0.6e0) * 0.6e0 + consistency * 0.2e0 + (cast(world_type is not null as int) + cast(task_structure is not null as int)) / 10 * 0.2e0, 1.0e0) as confidence_score from fm)""".format(
    both=" + ".join(f"coalesce(case when r.{c} <> '' and m.{c} <> '' then 1 end, 0)" for c in ("world_type", "task_structure")),
    same=" + ".join(f"coalesce(case when r.{c} <> '' and m.{c} <> '' and r.{c} = m.{c} then 1 end, 0)" for c in ("world_type", "task_structure")),
)


def _said(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.books.where("n_chars % 5 != 1").select("novel_id", F.col("source").alias("world_type"), F.col("genre").alias("task_structure"), ((n % 8).cast("double") / 8).alias("confidence_score"))


@query(with_(PARSED, CORE_TEXTS, FOUND, _WITH_MODEL) + f"select novel_id, world_type, task_structure, consistency, confidence_score, {_ISSUES} as issues from (select * from fused union all select -1 - novel_id, world_type, task_structure, consistency, confidence_score from fused where novel_id % 2 = 0)")
def v4_model_features(t: Tables) -> DataFrame:
    """Basic parsing with a model's answers and a table of known features, of which some belong to other books."""
    first = deep.basic_features(titled(t), rule_table(t, FIELD_ROWS), _said(t), **PARSE).features
    old = first.where("novel_id % 2 = 0")
    known = old.withColumn("novel_id", -1 - F.col("novel_id")).unionByName(old.withColumn("world_type", F.lit("old")))
    out = deep.basic_features(titled(t), rule_table(t, FIELD_ROWS), _said(t), known, **PARSE).features
    return out.select("novel_id", "world_type", "task_structure", "consistency", "confidence_score", F.array_join("issues", "|").alias("issues"))


_WANTED = "(select doc_id from labels)"


@query(with_(PARSED, f"books as (select novel_id, string_agg(content, chr(10) || chr(10) order by chapter_number) as text from split where novel_id in {_WANTED} group by 1), chapters as (select novel_id, chapter_number, content from split where novel_id in {_WANTED})", *_DEEP_PARTS) + f"select novel_id, {', '.join(_V1)}, overall_quality from fused")
def p6_deep_batch(t: Tables) -> DataFrame:
    """Batch parsing in deep mode: the labelled books, cut into chapters by their titles."""
    wanted = t.read("labels").select(F.col("doc_id").alias("novel_id"))
    return deep.parse_batch(titled(t), wanted, rule_table(t, FIELD_ROWS), "deep", DEEP, **PARSE).select("novel_id", *_V1, "overall_quality")


# --- benchmark library

_LIB = f"lib as (select novel_id as benchmark_id, 'B' || novel_id as title, genre, n_chars % 4 > 0 as is_active, case when n_chars % 6 > 0 then n_chars % 97 end as read_count, {sql_top(LATIN, cols(LATIN))} as conflict_type, source as gf_type, case when n_chars % 3 = 0 then 'a' else 'b' end as arc_type, case when n_chars % 2 = 0 then '每' else '-' end as rhythm_pattern, cast(n_chars % 10 as double) / 10 as short_ratio, case when n_chars % 5 > 1 then 'h1' else 'h2' end as top_hook, n_chars from (select *, {scored(LATIN)} from books))"


def _described(rows: DataFrame) -> DataFrame:
    return rows.withColumn("conflict_type", top(scores("text", LATIN)))


def _library(t: Tables) -> DataFrame:
    return _described(_shelf(t)).drop("text")


def _shelf(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.books.select(
        F.col("novel_id").alias("benchmark_id"), F.concat(F.lit("B"), F.col("novel_id").cast("string")).alias("title"), "genre", (n % 4 > 0).alias("is_active"), F.when(n % 6 > 0, n % 97).alias("read_count"),
        "text", F.col("source").alias("gf_type"), F.when(n % 3 == 0, "a").otherwise("b").alias("arc_type"), F.when(n % 2 == 0, "每").otherwise("-").alias("rhythm_pattern"),
        ((n % 10).cast("double") / 10).alias("short_ratio"), F.when(n % 5 > 1, "h1").otherwise("h2").alias("top_hook"), "n_chars", F.array(F.col("source"), F.col("genre")).alias("tags"),
    )


_NOVELS = "nov as (select benchmark_id as novel_id, * exclude (benchmark_id, title, is_active, read_count) from lib where n_chars % 4 <> 1)"
_SIMS = """bestb as (select * from (select *, row_number() over (partition by genre order by read_count desc nulls last, benchmark_id) as rd from lib where is_active) where rd <= 6),
cmp as (select *, row_number() over (partition by novel_id order by round(similarity, 9) desc, rd) as place from (select n.novel_id, b.benchmark_id, b.title, b.rd, n.conflict_type as nc, b.conflict_type as bc, n.top_hook as nh, b.top_hook as bh, n.arc_type as na, b.arc_type as ba, n.rhythm_pattern as nr, n.short_ratio as ns,
 case when n.conflict_type = b.conflict_type then 0.2e0 else 0.0e0 end + case when n.gf_type = b.gf_type then 0.15e0 else 0.0e0 end + case when n.arc_type = b.arc_type then 0.15e0 else 0.0e0 end + case when contains(n.rhythm_pattern, '每') and contains(b.rhythm_pattern, '每') then 0.1e0 else 0.0e0 end + case when n.short_ratio > 0.4e0 and b.short_ratio > 0.4e0 then 0.1e0 else 0.0e0 end as similarity from nov n join bestb b using (genre)))"""


def _novels(t: Tables) -> DataFrame:
    return _library(t).where("n_chars % 4 <> 1").withColumnRenamed("benchmark_id", "novel_id").drop("title", "is_active", "read_count", "tags")


def _compared(t: Tables) -> DataFrame:
    return BM.compare(_novels(t), _shelf(t), describe=_described)


@query(with_(BOOKS, _LIB) + "select benchmark_id, read_count from lib where is_active and genre = 'en' and (gf_type = 'src1' or gf_type = 'src0') order by read_count desc nulls last, benchmark_id limit 20")
def b1_list_benchmarks(t: Tables) -> DataFrame:
    return BM.list_benchmarks(_library(t), "en", ["src0", "src1"]).select("benchmark_id", "read_count")


@query(with_(BOOKS, _LIB, _NOVELS, _SIMS) + "select novel_id, benchmark_id, similarity from cmp where place <= 3")
def b2_benchmark_similarity(t: Tables) -> DataFrame:
    return _compared(t).select("novel_id", "benchmark_id", "similarity")


#: Novels of one language have no benchmark of their genre here; roles, and the numbers that suggestions go by, are made from the length.
_FOUR = """novs as (select *, 'R' || (n_chars % 7) as role, cast(n_chars % 10 as double) / 10 as role_score, n_chars % 40 as hooks, n_chars % 4 as limits, cast(n_chars % 11 as double) / 10 as done, cast(n_chars % 7 as double) / 6 as money from nov),
told as (select c.*, array_to_string(list_filter([case when nc = bc then '可复用《' || title || '》的冲突公式结构' end, case when role_score > 0.8e0 then '『' || role || '』类型的info配角可复用' end, case when contains(nr, '每') then '可复用节奏模式：' || nr end], lambda x: x is not null), '|') as again from cmp c join novs v using (novel_id) where place <= 3 and v.genre <> 'fr'),
four as (select novel_id, string_agg(title, ',' order by place) as similar,
 coalesce(string_agg(array_to_string(list_filter([case when ns > 0.5e0 then '相比《' || title || '》，本作金手指具有创新性：new' end, case when nh <> bh then '《' || title || '》以' || bh || '为主，本作以' || nh || '为主' end, case when na <> ba then '人物弧光类型不同：' || na || ' vs ' || ba end], lambda x: x is not null), '|'), '|' order by place) filter (place = 1), '') as points,
 coalesce(string_agg(again, '|' order by place) filter (place <= 2 and again <> ''), '') as reusable from told group by 1)"""
_TIPS = "array_to_string(list_filter([case when hooks < 20 then '情绪节奏' end, case when limits < 2 then '设定设计' end, case when done < 0.6e0 then '人物塑造' end, case when money < 0.6e0 then '商业潜力' end], lambda x: x is not null), '|')"


def _profiles(t: Tables) -> DataFrame:
    """Novels with all that a comparison takes."""
    n = F.col("n_chars")
    role = F.struct(F.concat(F.lit("R"), (n % 7).cast("string")).alias("role_name"), F.lit("info").alias("function_type"), ((n % 10).cast("double") / 10).alias("reusability"))
    return _novels(t).withColumns({
        "innovations": F.when(F.col("short_ratio") > 0.5, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")), "reusability": F.lit(0.5), "roles": F.array(role),
        "total_hooks": n % 40, "n_constraints": n % 4, "completion": (n % 11).cast("double") / 10, "commercial_score": (n % 7).cast("double") / 6,
    })


def _told(t: Tables) -> DataFrame:
    return BM.comparison(_profiles(t), _shelf(t).where("genre != 'fr'"), describe=_described)


@query(with_(BOOKS, _LIB, _NOVELS, _SIMS, _FOUR) + f"select v.novel_id, coalesce(f.similar, '') as similar, coalesce(points, '') as differentiation, coalesce(reusable, '') as reusable, case when f.novel_id is null then {s(BM.NO_LIBRARY)} else {_TIPS} end as suggestions from novs v left join four f using (novel_id)")
def b3_compare_with_benchmarks(t: Tables) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c), "|")
    tips = F.array_join(F.transform("suggestions", lambda x: F.when(x["category"] == "", x["suggestion"]).otherwise(x["category"])), "|")
    return _told(t).select("novel_id", F.array_join(F.col("similar.title"), ",").alias("similar"), joined("differentiation.point").alias("differentiation"), joined("reusable.description").alias("reusable"), tips.alias("suggestions"))


@query(with_(BOOKS, _LIB, _NOVELS, _SIMS) + "select novel_id, array_to_string(list_filter([case when ns > 0.5e0 then '相比《' || title || '》，本作金手指具有创新性：new' end, case when nh <> bh then '《' || title || '》以' || bh || '为主，本作以' || nh || '为主' end, case when na <> ba then '人物弧光类型不同：' || na || ' vs ' || ba end], lambda x: x is not null), '|') as points from cmp where place = 1")
def b4_differentiation(t: Tables) -> DataFrame:
    d = BM.differentiation(F.col("title"), F.when(F.col("short_ratio") > 0.5, "new"), F.col("own_hook"), F.col("top_hook"), F.col("arc_type"), F.col("__arc_type"))
    return _compared(t).where("place = 1").select("novel_id", F.array_join(d["point"], "|").alias("points"))


@query(with_(BOOKS, CHAPTERS, C6, C7, _LIB, _NOVELS, _SIMS) + ", rr as (select novel_id, role_name, function_type, reusability, place as role_place from c7 where place <= 2 and reusability > 0.8e0) "
    + "select novel_id, nullif(string_agg(d, '|' order by place, k, role_place), '') as reusable from (select novel_id, place, 0 as k, 0 as role_place, '可复用《' || title || '》的冲突公式结构' as d from cmp where place <= 2 and nc = bc "
    + "union all select novel_id, cmp.place, 1, role_place, '『' || role_name || '』类型的' || function_type || '配角可复用' from cmp join rr using (novel_id) where cmp.place <= 2 "
    + "union all select novel_id, place, 2, 0, '可复用节奏模式：' || nr from cmp where place <= 2 and contains(nr, '每') union all select novel_id, place, 3, 0, null from cmp where place <= 2) group by 1")
def b5_reusable_elements(t: Tables) -> DataFrame:
    cast = C.supporting_roles(t.chapters, C.person_mentions(t.books, B.PERSONS), B.ROLES, ".", ["info", "foe"])
    item = F.struct("place", F.struct("role_name", "function_type", "reusability").alias("role"))
    cast = cast.groupBy("novel_id").agg(F.array_sort(F.collect_list(item))["role"].alias("roles"))
    d = BM.reusable_elements(F.col("title"), F.col("conflict_type"), F.col("__conflict_type"), F.lit(0.5), F.col("rhythm_pattern"), F.col("roles"))["description"]
    rows = _compared(t).where("place <= 2").join(cast.hint("merge"), "novel_id", "left").select("novel_id", "place", d.alias("d"))
    merged = F.flatten(F.array_sort(F.collect_list(F.struct("place", "d")))["d"])
    return rows.groupBy("novel_id").agg(F.nullif(F.array_join(merged, "|"), F.lit("")).alias("reusable"))


@query(with_(BOOKS) + f"select novel_id, array_to_string(list_filter([case when k * 6 < 20 then '情绪节奏:high' end, case when k < 4 then '设定设计:medium' end, case when a < 0.6e0 then '人物塑造:high' end, case when b < 0.6e0 then '商业潜力:medium' end], lambda x: x is not null), '|') as suggestions from ({_Q})")
def b6_suggestions(t: Tables) -> DataFrame:
    found = BM.suggestions(F.col("k") * 6, F.when(F.col("k") < 4, 1).otherwise(2), F.col("a"), F.col("b"))
    return _numbers(t).select("novel_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["category"], x["priority"])), "|").alias("suggestions"))


@query(
    with_(BOOKS, _LIB)
    + ", r as (select * from lib where is_active and n_chars % 30 >= 8 order by read_count desc nulls last, benchmark_id limit 50), u as (select 'conflict_type' as dimension, conflict_type as value from r union all select 'gf_type', gf_type from r union all select 'arc_type', arc_type from r) "
    + "select dimension, cast(place as int) as place, value, n from (select dimension, value, count(*) as n, row_number() over (partition by dimension order by count(*) desc, value) as place from u group by 1, 2) where place <= 3"
)
def b8_trending_features(t: Tables) -> DataFrame:
    rows = _library(t).withColumn("updated_at", F.timestamp_seconds(F.col("n_chars") % 30))
    return BM.trending_features(rows, F.timestamp_seconds(F.lit(8)), ["conflict_type", "gf_type", "arc_type"])


# --- model calls

@query(with_(BOOKS) + "select novel_id, md5('ASK ' || substring(text, 1, 8000) || ' END') as prompt_md5 from books")
def p1_build_prompt(t: Tables) -> DataFrame:
    return t.books.select("novel_id", F.md5(P.build_prompt(F.col("text"), "ASK ", " END")).alias("prompt_md5"))


_JSON = "'{\"background\":{\"world_type\":\"' || genre || '\"},\"confidence_score\":' || (n_chars % 10) || '.5}'"
_RESP = f"resp as (select novel_id, genre, n_chars, case n_chars % 4 when 0 then {_JSON} when 1 then 'Sure:' || chr(10) || '```json' || chr(10) || {_JSON} || chr(10) || '```' when 2 then 'It is ' || {_JSON} || ' I think' else 'no answer' end as response from books)"


def _responses(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"background":{"world_type":"'), F.col("genre"), F.lit('"},"confidence_score":'), (F.col("n_chars") % 10).cast("string"), F.lit(".5}"))
    k = F.col("n_chars") % 4
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), body, F.lit(" I think"))).otherwise("no answer")
    return t.books.select("novel_id", "genre", "n_chars", said.alias("response"))


@query(with_(BOOKS, _RESP) + "select novel_id, case when n_chars % 4 < 3 then genre end as world_type, case when n_chars % 4 < 3 then n_chars % 10 + 0.5e0 end as confidence from resp")
def p2_parse_model_response(t: Tables) -> DataFrame:
    found = P.parse_response(F.col("response"), FEATURES)
    return _responses(t).select("novel_id", found.alias("f")).select("novel_id", F.col("f.background.world_type").alias("world_type"), F.col("f.confidence_score").alias("confidence"))


@query(with_(BOOKS, _RESP) + "select novel_id, case when n_chars % 4 < 3 then n_chars % 10 + 0.5e0 end as confidence_score, case when n_chars % 4 = 3 then 'unreadable response' end as error from resp")
def p3_model_features(t: Tables) -> DataFrame:
    return P.model_features(_responses(t)).select("novel_id", "confidence_score", "error")


def echo(prompt: str) -> str:
    """A stand-in for a model: fails on some prompts, always alike."""
    if len(prompt) % 7 == 0:
        raise ValueError("refused")
    return f"{len(prompt)}"


def _run(t: Tables) -> DataFrame:
    return P.apply_model(t.books.select("novel_id", F.col("text").alias("prompt")), echo)


@query(with_(BOOKS) + "select novel_id, case when length(text) % 7 > 0 then cast(length(text) as varchar) end as response, case when length(text) % 7 = 0 then 'ValueError: refused' end as error, case when length(text) % 7 = 0 then 3 else 1 end as attempts from books")
def p4_apply_model(t: Tables) -> DataFrame:
    return _run(t)


@query(with_(BOOKS) + "select count(*) as total, count(*) filter (length(text) % 7 > 0) as processed, count(*) filter (length(text) % 7 = 0) as failed, avg(cast(length(text) % 7 > 0 as int)) as share from books")
def p5_batch_run_summary(t: Tables) -> DataFrame:
    return P.batch_run_summary(_run(t))


#: The chain's rows as novels of a library whose benchmarks all have one genre.
_COMPARED = (
    _LIB.replace("lib as (", "lib0 as (", 1), "lib as (select * replace ('city' as genre) from lib0)",
    "nov as (select f.novel_id, f.conflict_type, f.gf_type, f.arc_type, f.rhythm_pattern, f.top_hook, n3.short_ratio, string_split(d1.genres, ',')[1] as genre from fused f join n3 using (novel_id) join d1 using (novel_id))", _SIMS,
    "rl as (select novel_id, list('『' || role_name || '』类型的' || function_type || '配角可复用' order by place) filter (place <= 2 and reusability > 0.8e0) as said from c7 group by 1)",
    """lists as (select c.novel_id, string_agg(title, ',' order by place) as similar,
 string_agg(array_to_string(list_filter([case when innovations[1] is not null then '相比《' || title || '》，本作金手指具有创新性：' || innovations[1] end, case when nh <> bh then '《' || title || '》以' || bh || '为主，本作以' || nh || '为主' end, case when na <> ba then '人物弧光类型不同：' || na || ' vs ' || ba end], lambda x: x is not null), '|'), '|') filter (place = 1) as points,
 array_to_string(flatten(list(list_filter(list_concat([case when nc = bc then '可复用《' || title || '》的冲突公式结构' end], coalesce(rl.said, []), [case when contains(nr, '每') then '可复用节奏模式：' || nr end]), lambda x: x is not null) order by place) filter (place <= 2)), '|') as again
 from cmp c join fused f using (novel_id) left join rl using (novel_id) where place <= 3 group by 1)""",
)


@query(
    with_(BOOKS, CHAPTERS, *_DEEP_PARTS, *_COMPARED)
    + f"""select f.novel_id, coalesce(l.similar, '') as similar, coalesce(points, '') as differentiation, coalesce(again, '') as reusable, case when l.novel_id is null then {s(BM.NO_LIBRARY)} else array_to_string(list_filter([
 case when coalesce(th.total_hooks, 0) < 20 then '情绪节奏' end, case when f.n_constraints < 2 then '设定设计' end, case when coalesce(c3.completion, 0.5e0) < 0.6e0 then '人物塑造' end, case when f.commercial_score < 0.6e0 then '商业潜力' end], lambda x: x is not null), '|') end as suggestions
 from fused f left join lists l using (novel_id) left join th using (novel_id) left join c3 using (novel_id)"""
)
def v1_benchmark_comparisons(t: Tables) -> DataFrame:
    """Deep features with a benchmark library: what each book has in common with the best of its genre, and what not."""
    library = _shelf(t).withColumn("genre", F.lit("city"))
    rows = deep.comparisons(deep.deep_features(t.books.select("novel_id", "text"), t.chapters, DEEP), library, _described)
    joined = lambda c: F.array_join(F.col(c), "|")
    tips = F.array_join(F.transform("suggestions", lambda x: F.when(x["category"] == "", x["suggestion"]).otherwise(x["category"])), "|")
    return rows.select("novel_id", F.array_join(F.col("similar.title"), ",").alias("similar"), joined("differentiation.point").alias("differentiation"), joined("reusable.description").alias("reusable"), tips.alias("suggestions"))
