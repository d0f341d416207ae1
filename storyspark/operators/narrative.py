"""Narrative technique (N1-N9): structure, release of information, sentences, view and senses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import scores, shares
from ..functions.textfn import clamp, compact, has_any, matches
from .text import paragraphs, sentences

HOOK, DEVELOPMENT, CLIFFHANGER = 0.1, 0.8, 0.1
QUOTED = r"""['"].*?['"]"""


def chapter_structure(chapters: DataFrame) -> DataFrame:
    """``(novel_id, hook_ratio, development_ratio, cliffhanger_ratio, paragraph_length, dialogue_ratio)``.

    The first three are fixed shares; lengths are averaged over paragraphs, quoted shares over chapters.
    """
    rows = chapters.select("novel_id", F.col("content"), paragraphs("content").alias("p")).where(F.size("p") > 0)
    add = lambda a, x: a + F.length(x)
    zero = F.lit(0).cast("int")
    rows = rows.select("novel_id", F.size("p").alias("n"), F.aggregate("p", zero, add).alias("size"), (F.aggregate(matches("content", QUOTED), zero, add) / F.length("content")).alias("quoted"))
    out = rows.groupBy("novel_id").agg((F.sum("size") / F.sum("n")).alias("paragraph_length"), F.avg("quoted").alias("dialogue_ratio"))
    return out.select("novel_id", F.lit(HOOK).alias("hook_ratio"), F.lit(DEVELOPMENT).alias("development_ratio"), F.lit(CLIFFHANGER).alias("cliffhanger_ratio"), "paragraph_length", "dialogue_ratio")


def info_releases(chapters: DataFrame, kinds=L.INFO_TYPES, methods=L.RELEASE_METHODS, other: str = L.RELEASE_OTHER) -> DataFrame:
    """``(novel_id, ord, info_type, release_method, release_chapters, mystery_ratio)``."""
    method = F.lit(other)
    for name, keys in reversed(methods.items()):
        method = F.when(has_any("content", keys), name).otherwise(method)
    flags = F.array(*[F.when(has_any("content", keys), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("info_type"))) for k, (name, keys) in enumerate(kinds.items())])
    rows = chapters.select("novel_id", "chapter_number", method.alias("method"), F.explode(F.array_compact(flags)).alias("f")).select("novel_id", "chapter_number", "method", "f.*")
    by = rows.groupBy("novel_id", "ord", "info_type", "method").agg(F.count("*").alias("n"), F.min("chapter_number").alias("first"))
    by = by.groupBy("novel_id", "ord", "info_type").agg(F.max_by("method", F.struct("n", -F.col("first"))).alias("release_method"), F.sum("n").alias("release_chapters"))
    size = chapters.groupBy("novel_id").agg(F.count("*").alias("n_chapters"))
    return by.join(size.hint("merge"), "novel_id").select("novel_id", "ord", "info_type", "release_method", "release_chapters", (1 - F.col("release_chapters") / F.col("n_chapters")).alias("mystery_ratio"))


def mean_mystery(kinds: Column, releases: Column, chapters: Column) -> Column:
    """Mean of the kinds' ``1 - releases / chapters``, from whole sums with one division: a mean of 0.6 is 0.6 in any order."""
    return (kinds * chapters - releases) / F.nullif(kinds * chapters, F.lit(0))


def sentence_stats(books: DataFrame, marks: str = "[。！？；]", short: int = 10, long: int = 30) -> DataFrame:
    """``(novel_id, sentences, short_ratio, long_ratio, average_length)``; fixed values without sentences."""
    rows = books.select("novel_id", sentence_lengths("text", marks).alias("n"))
    return rows.select("novel_id", *[c.alias(n) for n, c in sentence_columns("n", short, long).items()])


def sentence_lengths(text: str, marks: str = "[。！？；]") -> Column:
    return F.transform(sentences(text, marks), lambda s: F.length(s))


def sentence_columns(n: str, short: int = 10, long: int = 30) -> dict[str, Column]:
    size = F.size(n)
    share = lambda f, d: F.when(size > 0, F.size(F.filter(n, f)) / size).otherwise(d)
    average = F.when(size > 0, F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) / size).otherwise(15.0)
    return {"sentences": F.greatest(size, F.lit(0)), "short_ratio": share(lambda x: x < short, 0.3), "long_ratio": share(lambda x: x > long, 0.2), "average_length": average}


def perspective(books: DataFrame, first: str = L.FIRST_PERSON, third: str = L.THIRD_PERSON, switch: str = L.SWITCH_PATTERN, head: int = 10_000) -> DataFrame:
    """``(novel_id, switches, perspective)``; twice as many markers of one kind decide, else switches are counted."""
    rows = books.select("novel_id", *[c.alias(n) for n, c in view_counts("text", first, third, switch, head).items()])
    return rows.select("novel_id", *[c.alias(n) for n, c in view_columns().items()])


def view_counts(text: str, first: str = L.FIRST_PERSON, third: str = L.THIRD_PERSON, switch: str = L.SWITCH_PATTERN, head: int = 10_000) -> dict[str, Column]:
    """Markers of the first and third person, and switches in the text's beginning."""
    count = lambda t, p: F.regexp_count(t, F.lit(f"(?d){p}"))
    return {"__first": count(F.col(text), first), "__third": count(F.col(text), third), "__switch": count(F.substr(F.col(text), F.lit(1), F.lit(head)), switch)}


def view_columns() -> dict[str, Column]:
    a, b, s = F.col("__first"), F.col("__third"), F.col("__switch")
    view = F.when(a > b * 2, "第一人称").when(b > a * 2, "第三人称").when(s > 5, "多视角").otherwise("第三人称")
    return {"switches": F.when((a > b * 2) | (b > a * 2), 0).otherwise(s), "perspective": view}


def sensory_distribution(books: DataFrame, lexicon=L.SENSES) -> DataFrame:
    """``(novel_id, senses)``: map of sense to its share."""
    return books.select("novel_id", scores("text", lexicon).alias("found")).select("novel_id", shares("found").alias("senses"))


def rhythm_score(short_ratio: Column, switches: Column) -> Column:
    return clamp(F.lit(0.5) + (short_ratio - 0.3) * 0.5 - F.least(switches * 0.02, F.lit(0.1)), 0.0, 1.0)


def scenarios(hook_ratio: Column, dialogue_ratio: Column, short_ratio: Column, long_ratio: Column) -> Column:
    return compact(
        F.when(hook_ratio > 0.15, "快节奏爽文").otherwise("慢热型作品"), F.when(dialogue_ratio > 0.4, "对话驱动型").otherwise("叙述驱动型"),
        F.when(short_ratio > 0.4, "快节奏战斗场景"), F.when(long_ratio > 0.3, "氛围渲染场景"),
    )


def difficulty(hook_ratio: Column, n_releases: Column, mean_mystery: Column) -> Column:
    extra = [F.abs(hook_ratio - 0.1) > 0.05, n_releases > 2, F.coalesce(mean_mystery, F.lit(0.0)) > 0.6]
    return F.least(F.lit(3) + sum((F.coalesce(x, F.lit(False)).cast("int") for x in extra[1:]), extra[0].cast("int")), F.lit(5))


def validate_ratios(hook: Column, development: Column, cliffhanger: Column) -> Column:
    return F.abs(hook + development + cliffhanger - 1) < 0.01
