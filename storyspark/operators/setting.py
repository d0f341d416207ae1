"""Core setting (G1-G11): the hero's advantage, its limits, and the rules of the world."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import lookup, score_of, scores, top
from ..functions.textfn import compact, first_present, has, has_any, once, strip


def gf_type(books: DataFrame, lexicon=L.GOLDEN_FINGERS) -> DataFrame:
    return books.select("novel_id", scores("text", lexicon).alias("found")).select("novel_id", top("found").alias("gf_type"))


def growth_type(books: DataFrame, lexicon=L.GROWTH) -> DataFrame:
    found = books.select("novel_id", scores("text", lexicon).alias("found"))
    return found.select("novel_id", growth_of("found").alias("growth_type"))


def growth_of(found: str) -> Column:
    static, growth, exp = (score_of(found, k) for k in ("static", "growth", "exp"))
    return F.when(exp > 5, "dynamic_exp").when(growth > static, "dynamic_linear").when(static > growth, "static").otherwise("dynamic_step")


def constraints(books: DataFrame, lexicon=L.CONSTRAINTS, stop: str = "。", gravest=L.SEVERITY_GRAVEST, grave=L.SEVERITY_GRAVE, per_keyword: int = 3, most: int = 5) -> DataFrame:
    """``(novel_id, place, constraint_type, description, severity, plot_impact)``: sentences that hold a keyword.

    Of each keyword the first few, in list order; of equal descriptions the first; then the first few.
    """
    rows = books.select("novel_id", ended_sentences("text", stop).alias("__ended"))
    rows = rows.select("novel_id", constraint_items("__ended", lexicon, gravest, grave, per_keyword, most).alias("__items"))
    rows = rows.select("novel_id", F.posexplode("__items").alias("place", "r")).select("novel_id", (F.col("place") + 1).alias("place"), "r.*")
    return rows.withColumn("plot_impact", lookup(F.col("constraint_type"), L.PLOT_IMPACTS, "影响剧情发展"))


def ended_sentences(text: str, stop: str = "。") -> Column:
    """The pieces up to each mark; the last piece has none behind it and is no sentence."""
    pieces = F.split(text, rf"\Q{stop}\E", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.concat(x, F.lit(stop)))


def constraint_items(ended: str, lexicon=L.CONSTRAINTS, gravest=L.SEVERITY_GRAVEST, grave=L.SEVERITY_GRAVE, per_keyword: int = 3, most: int = 5) -> Column:
    """Array of (constraint_type, description, severity) of a book, from its ``ended`` sentences."""

    def item(kind: str):
        severity = lambda m: F.when(has_any(m, gravest), 5).when(has_any(m, grave), 4).otherwise(3)
        return lambda m: F.struct(F.lit(kind).alias("constraint_type"), strip(m).alias("description"), severity(m).alias("severity"))

    def with_key(key: str):
        return lambda x: F.contains(x, F.lit(key))

    parts = [F.transform(F.slice(F.filter(ended, with_key(key)), 1, per_keyword), item(kind)) for kind, keys in lexicon.items() for key in keys]
    first = lambda rows: F.filter(rows, lambda x, i: F.array_position(rows["description"], x["description"]) == i + 1)
    return F.slice(once(F.flatten(F.array(*parts)), first), 1, most)


def early_text(chapters: DataFrame, first: int = 5) -> DataFrame:
    """The first chapters' contents, with a space between."""
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy("chapter_number"))
    rows = chapters.withColumn("__place", place).where(F.col("__place") <= first)
    return rows.groupBy("novel_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chapter_number", "content")))["content"], " ").alias("early_text"))


def fit(early: DataFrame, types: DataFrame, pains=L.PAINS, solves=(("system", "弱"), ("item", "穷"))) -> DataFrame:
    """``(novel_id, pain_keyword, pain_point, fit_score)``."""
    rows = types.join(early.hint("merge"), "novel_id", "left").withColumn("early_text", F.coalesce("early_text", F.lit("")))
    pain = first_present("early_text", pains)
    return rows.select("novel_id", pain.alias("pain_keyword"), *[c.alias(n) for n, c in fit_columns(F.col("gf_type"), pain, lambda w: has("early_text", w), solves).items()])


def fit_columns(kind: Column, pain: Column, early: Callable[[str], Column], solves=(("system", "弱"), ("item", "穷"))) -> dict[str, Column]:
    """The pain in words, and how well the type fits; ``early`` tells whether the first chapters hold a word."""
    good = F.lit(False)
    for name, word in solves:
        good = good | ((kind == name) & early(word))
    said = F.when(pain.isNull(), "主角初期处于普通状态").otherwise(F.concat(F.lit("主角初期面临"), pain, F.lit("的困境")))
    return {"pain_point": said, "fit_score": F.when(good, 0.8).otherwise(0.5)}


def innovations(books: DataFrame, found: DataFrame, lexicon=L.GOLDEN_FINGERS, mood: str = "情绪值", price: str = "代价") -> DataFrame:
    """``(novel_id, innovations)``: up to three tags; ``found`` are the book's constraints."""
    heavy = found.groupBy("novel_id").agg((F.count_if(F.col("constraint_type") == price) > 0).alias("priced"), (F.max("severity") >= 4).alias("grave"))
    rows = books.join(heavy.hint("merge"), "novel_id", "left").withColumn("__types", several_types("text", lexicon))
    return rows.select("novel_id", innovation_tags("text", "__types", F.col("priced") & F.col("grave"), mood).alias("innovations"))


def several_types(text: str, lexicon=L.GOLDEN_FINGERS) -> Column:
    """The types of which one of the first three keywords occurs."""
    return F.filter(F.array(*[F.when(has_any(text, keys[:3]), F.lit(t)) for t, keys in lexicon.items()]), lambda x: x.isNotNull())


def innovation_tags(text: str, types: str, dear: Column, mood: str = "情绪值") -> Column:
    return compact(
        F.when(has(text, mood), "使用'情绪值'作为系统兑换资源，而非传统积分"), F.when(dear, "金手指使用需要付出沉重代价，增加剧情张力"),
        F.when(F.size(types) > 1, F.concat(F.lit("多金手指组合："), F.array_join(types, ", "))),
    )


def similarity_to_common(kind: Column, growth: Column, n_constraints: Column, pairs=L.COMMON_PAIRS) -> Column:
    usual = F.lit(False)
    for a, b in pairs:
        usual = usual | ((kind == a) & (growth == b))
    return F.greatest(F.when(usual, 0.7).otherwise(0.5) - n_constraints * 0.1, F.lit(0.1))


def novelty(similarity: Column) -> Column:
    return 1 - similarity


def gf_name(text: str, kind: Column, patterns=L.GF_NAMES) -> Column:
    """The first name that fits the pattern of the type."""
    out = F.lit(None).cast("string")
    for k, p in patterns.items():
        out = F.when(kind == k, F.nullif(F.regexp_extract(text, p, 1), F.lit(""))).otherwise(out)
    return out


def initial_power(kind: Column, table=L.INITIAL_POWERS) -> Column:
    return lookup(kind, table, "未知初始能力")


def max_potential(text: str, peaks=L.PEAKS) -> Column:
    found = first_present(text, peaks)
    return F.when(found.isNull(), "潜力巨大，上限未知").otherwise(F.concat(F.lit("可达到"), found, F.lit("境界")))


def world_rules(books: DataFrame, systems=L.POWER_SYSTEMS, resources=L.RESOURCES) -> DataFrame:
    """``(novel_id, ord, rule_name, rule_category, consistency)``."""
    return books.select("novel_id", F.explode(world_rule_items("text", systems, resources)).alias("r")).select("novel_id", "r.*")


def world_rule_items(text: str, systems=L.POWER_SYSTEMS, resources=L.RESOURCES) -> Column:
    """Array of (ord, rule_name, rule_category, consistency) of a book."""
    rows = [F.when(has_any(text, keys), F.struct(F.lit(i).alias("ord"), F.lit(f"{name}体系").alias("rule_name"), F.lit("力量体系").alias("rule_category"), F.lit(0.9).alias("consistency"))) for i, (name, keys) in enumerate(systems.items())]
    rows.append(F.when(has_any(text, resources), F.struct(F.lit(len(systems)).alias("ord"), F.lit("资源分配规则").alias("rule_name"), F.lit("资源分配").alias("rule_category"), F.lit(0.8).alias("consistency"))))
    return compact(*rows)


def rule_exploits(chapters: DataFrame, keywords=L.EXPLOITS, stop: str = "。", most: int = 3) -> DataFrame:
    """``(novel_id, place, chapter_number, description)``: first sentences that hold a keyword."""
    pieces = F.split("content", f"[{stop}]", -1)

    def first_with(word: str) -> Column:
        return strip(F.get(F.filter(pieces, lambda x: F.contains(x, F.lit(word))), F.lit(0)))

    rows = [F.struct(F.lit(k).alias("kw_ord"), first_with(w).alias("description")) for k, w in enumerate(keywords)]
    found = chapters.where(has_any("content", keywords)).select("novel_id", "chapter_number", F.explode(F.filter(F.array(*rows), lambda r: r["description"].isNotNull())).alias("r")).select("novel_id", "chapter_number", "r.*")
    first = F.row_number().over(Window.partitionBy("novel_id", "description").orderBy("chapter_number", "kw_ord"))
    found = found.withColumn("__first", first).where("__first = 1")
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy("chapter_number", "kw_ord"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("novel_id", "place", "chapter_number", "description")


def coherence(n_constraints: Column, n_rules: Column) -> Column:
    return F.least(F.lit(0.8) + n_constraints * 0.05 + n_rules * 0.05, F.lit(1.0))
