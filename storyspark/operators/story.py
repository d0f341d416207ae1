"""Story core (D1-D9): conflict, hooks, rhythm and value of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import best, lookup, scores, top, total
from ..functions.textfn import alternation

UNDERDOGS = ("underdog_revenge", "revenge")


def conflict_formula(books: DataFrame, lexicon=L.CONFLICT, formulas=L.FORMULAS, default=L.FORMULA_DEFAULT) -> DataFrame:
    """``(novel_id, conflict_type, formula_name, desire, obstacle, path, genres, reusability)``."""
    rows = books.select("novel_id", scores("text", lexicon, "presence").alias("found"))
    rows = rows.select("novel_id", "found", top("found").alias("conflict_type"))
    return rows.select("novel_id", "conflict_type", *[c.alias(n) for n, c in conflict_columns("found", F.col("conflict_type"), formulas, default).items()])


def conflict_columns(found: str, kind: Column, formulas=L.FORMULAS, default=L.FORMULA_DEFAULT) -> dict[str, Column]:
    """The formula of a conflict type, and how far the type leads in the scores."""
    named = {n: lookup(kind, {k: v[i] for k, v in formulas.items()}, default[i]) for i, n in enumerate(("formula_name", "desire", "obstacle", "path", "genres"))}
    return named | {"reusability": F.when(total(found) > 0, best(found) / total(found)).otherwise(0.5)}


def hook_matches(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """Each match: ``(novel_id, chapter_number, hook_type, keyword, position, intensity)``."""
    size = F.length("content")
    found = F.array(*[F.struct(F.lit(t).alias("hook_type"), F.regexp_extract_all("content", F.lit(alternation(k)), F.lit(0)).alias("hits")) for t, k in lexicon.items()])
    rows = chapters.select("novel_id", "chapter_number", "content", F.explode(found).alias("f"))
    rows = rows.select("novel_id", "chapter_number", "content", "f.hook_type", F.least(F.size("f.hits"), F.lit(5)).alias("intensity"), F.explode("f.hits").alias("keyword"))
    at = F.instr(F.col("content"), F.col("keyword")) - 1
    place = F.when(at < size * 0.2, "开头").when(at > size * 0.8, "结尾").otherwise("中间")
    return rows.select("novel_id", "chapter_number", "hook_type", "keyword", place.alias("position"), "intensity")


def hook_counts(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """Matches by chapter and type, zeros included, without making a row for each match."""
    found = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(t).alias("hook_type"), F.regexp_count("content", F.lit(alternation(w))).alias("n")) for k, (t, w) in enumerate(lexicon.items())])
    return chapters.select("novel_id", "chapter_number", F.explode(found).alias("f")).select("novel_id", "chapter_number", "f.*")


def hook_type_distribution(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """``(novel_id, ord, hook_type, n)`` for every type."""
    return hook_counts(chapters, lexicon).groupBy("novel_id", "ord", "hook_type").agg(F.sum("n").alias("n"))


def intensity_curve(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """``(novel_id, chapter_number, intensity, is_peak)``: hooks of a chapter up to 5, peaks from 4."""
    per = hook_counts(chapters, lexicon).groupBy("novel_id", "chapter_number").agg(F.least(F.sum("n"), F.lit(5)).cast("int").alias("intensity"))
    return per.withColumn("is_peak", F.col("intensity") >= 4)


def rhythm_pattern(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """``(novel_id, hook_chapters, rhythm_pattern)`` from the mean gaps between chapters with hooks.

    A chapter is a major one if one of its types has at least four matches. The mean gap of a sorted
    list is its range over the number of gaps.
    """
    per = hook_counts(chapters, lexicon).groupBy("novel_id", "chapter_number").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    major = F.when(F.col("most") >= 4, F.col("chapter_number"))
    own = F.when(F.col("n") > 0, F.col("chapter_number"))
    rows = per.groupBy("novel_id").agg(
        F.count(own).alias("k"), ((F.max(own) - F.min(own)) / F.nullif(F.count(own) - 1, F.lit(0))).alias("gap"),
        ((F.max(major) - F.min(major)) / F.nullif(F.count(major) - 1, F.lit(0))).alias("major_gap"),
    )
    return rows.select("novel_id", F.col("k").alias("hook_chapters"), rhythm_text(F.col("k"), F.col("gap"), F.col("major_gap")).alias("rhythm_pattern"))


def rhythm_text(k: Column, gap: Column, major_gap: Column) -> Column:
    """Words for the number of chapters with hooks and the mean gaps between them and between the major ones."""
    small = F.when(gap <= 3, "每1-3章1个小爽点").when(gap <= 5, "每3-5章1个小爽点").otherwise("每5章以上1个小爽点")
    large = F.when(major_gap.isNull(), "无明显大爽点节奏").when(major_gap <= 10, "每10章1个大爽点").when(major_gap <= 20, "每10-20章1个大爽点").otherwise("每20章以上1个大爽点")
    return F.when(k == 0, "无明显节奏").when(k < 2, "钩子分布稀疏").otherwise(F.concat(small, F.lit("，"), large))


def value_proposition(books: DataFrame, lexicon=L.VALUES) -> DataFrame:
    """``(novel_id, value_type, core_value, relatability)``."""
    rows = books.select("novel_id", scores("text", lexicon).alias("found")).select("novel_id", top("found").alias("value_type"), best("found").alias("n"))
    return rows.select("novel_id", "value_type", F.concat("value_type", F.lit("的价值")).alias("core_value"), F.least(F.col("n") / 100, F.lit(1.0)).alias("relatability"))


def top_hook(chapters: DataFrame, lexicon=L.HOOKS) -> DataFrame:
    """``(novel_id, top_hook, total_hooks, types_used)``; the first type of equals."""
    per = hook_type_distribution(chapters, lexicon)
    return per.groupBy("novel_id").agg(
        F.max_by("hook_type", F.struct("n", -F.col("ord"))).alias("top_hook"), F.sum("n").alias("total_hooks"), F.count_if(F.col("n") > 0).alias("types_used")
    )


def core_attraction(formula_name: Column, hook: Column, value_type: Column, rhythm: Column) -> Column:
    return F.concat(F.lit("以『"), formula_name, F.lit("』为核心冲突，通过『"), hook, F.lit("』类情绪钩子驱动剧情，传递『"), value_type, F.lit("』的价值主张，形成"), rhythm, F.lit("的阅读节奏。"))


def uniqueness(conflict_type: Column, types_used: Column, rhythm: Column, n_types: int = 8, common=UNDERDOGS) -> Column:
    base = F.when(conflict_type.isin(*common), 0.7).otherwise(0.85)
    return F.least(base + types_used / n_types * 0.2 + F.when(F.contains(rhythm, F.lit("大爽点")), 0.1).otherwise(0.0), F.lit(1.0))


def emotional_response(hook_type: Column, table=L.HOOK_RESPONSES, default: str = "情绪共鸣") -> Column:
    return lookup(hook_type, table, default)


def story_core(books: DataFrame, chapters: DataFrame, conflict=L.CONFLICT, hooks=L.HOOKS, values=L.VALUES, formulas=L.FORMULAS, default=L.FORMULA_DEFAULT, common=UNDERDOGS) -> DataFrame:
    """All of the story core, one row a book."""
    out = conflict_formula(books, conflict, formulas, default).join(value_proposition(books, values).hint("merge"), "novel_id")
    out = out.join(rhythm_pattern(chapters, hooks).hint("merge"), "novel_id", "left").join(top_hook(chapters, hooks).hint("merge"), "novel_id", "left")
    out = out.withColumn("rhythm_pattern", F.coalesce("rhythm_pattern", F.lit("无明显节奏"))).withColumn("types_used", F.coalesce("types_used", F.lit(0)))
    out = out.withColumn("top_hook", F.coalesce("top_hook", F.lit(next(iter(hooks))))).withColumn("total_hooks", F.coalesce("total_hooks", F.lit(0)))
    out = out.withColumn("uniqueness", uniqueness(F.col("conflict_type"), F.col("types_used"), F.col("rhythm_pattern"), len(hooks), common))
    return out.withColumn("core_attraction", core_attraction(F.col("formula_name"), F.col("top_hook"), F.col("value_type"), F.col("rhythm_pattern")))
