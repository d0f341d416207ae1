"""Commercial value (M1-M10): readers, payment, adaptations and derived products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import lookup, scores, shares, top
from ..functions.textfn import cnt, compact, has, has_any, mean_of


def audience(books: DataFrame, lexicon=L.AUDIENCES, ages=L.AGE_RANGES) -> DataFrame:
    """``(novel_id, segment, secondary, age_low, age_high)``; up to two others that score, in list order."""
    rows = books.select("novel_id", scores("text", lexicon).alias("found")).withColumn("segment", top("found"))
    return rows.select("novel_id", "segment", *[c.alias(n) for n, c in audience_columns("found", F.col("segment"), ages).items()])


def audience_columns(found: str, segment: Column, ages=L.AGE_RANGES) -> dict[str, Column]:
    others = F.slice(F.filter(found, lambda s: (s["score"] > 0) & (s["category"] != segment))["category"], 1, 2)
    low, high = (lookup(segment, {k: v[i] for k, v in ages.items()}, d) for i, d in ((0, 18), (1, 45)))
    return {"secondary": others, "age_low": low, "age_high": high}


def gender_split(books: DataFrame, lexicon=L.GENDERS) -> DataFrame:
    return books.select("novel_id", scores("text", lexicon).alias("found")).select("novel_id", shares("found").alias("genders"))


def payment_behavior(books: DataFrame, lexicon=L.PAYMENT_TRIGGERS, motives=L.MOTIVATIONS, above: int = 5) -> DataFrame:
    """``(novel_id, motivation, triggers)``."""
    rows = books.select("novel_id", scores("text", lexicon).alias("found"))
    return rows.select("novel_id", *[c.alias(n) for n, c in payment_columns("found", motives, above).items()])


def payment_columns(found: str, motives=L.MOTIVATIONS, above: int = 5) -> dict[str, Column]:
    return {"motivation": lookup(top(found), motives, "综合需求"), "triggers": F.filter(found, lambda s: s["score"] > above)["category"]}


def arpu(segment: Column, motivation: Column, base=L.BASE_ARPU, factor=L.MOTIVATION_FACTOR) -> Column:
    return lookup(segment, base, 30.0) * lookup(motivation, factor, 1.0)


def adaptation_cost(kind: Column, scenes: Column, speakers: Column, base=L.BASE_COST) -> Column:
    low = F.when(scenes > 20, 0.1).otherwise(0.0) + F.when(speakers > 30, 0.1).otherwise(0.0)
    return F.greatest(lookup(kind, base, 0.5) - low, F.lit(0.1))


def roi(suitability: Column, cost: Column) -> Column:
    return F.least((suitability * 0.7 + cost * 0.3) / F.greatest(1 - cost, F.lit(0.1)), F.lit(5.0))


def distinct_matches(text: str, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def adaptations(books: DataFrame, lexicon=L.ADAPTATIONS, base=L.BASE_COST, speaker: str = L.SPEAKER_PATTERN, scene: str = L.SCENE_PATTERN, least: float = 0.3, most: int = 3) -> DataFrame:
    """``(novel_id, place, adaptation_type, suitability, key_points, cost, roi)``, the best return first."""
    rows = books.select("novel_id", *[c.alias(n) for n, c in adaptation_counts("text", lexicon, speaker, scene).items()])
    rows = rows.select("novel_id", F.posexplode(adaptation_items(base, least, most)).alias("p", "b"))
    return rows.select("novel_id", (F.col("p") + 1).alias("place"), "b.adaptation_type", "b.suitability", "b.key_points", "b.cost", "b.roi")


def adaptation_counts(text: str, lexicon=L.ADAPTATIONS, speaker: str = L.SPEAKER_PATTERN, scene: str = L.SCENE_PATTERN) -> dict[str, Column]:
    """Scenes, speakers, and each kind's keywords with their numbers, each counted once."""
    kinds = []
    for k, (kind, keys) in enumerate(lexicon.items()):
        kinds.append(F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("adaptation_type"), F.array(*[F.struct(F.lit(w).alias("word"), cnt(text, w).alias("n")) for w in keys]).alias("words")))
    return {"__scenes": distinct_matches(text, scene), "__speakers": distinct_matches(text, speaker), "__kinds": F.array(*kinds)}


def adaptation_items(base=L.BASE_COST, least: float = 0.3, most: int = 3) -> Column:
    """Array of (adaptation_type, suitability, key_points, cost, roi) from ``adaptation_counts``, the best return first."""
    n = lambda k: F.aggregate(k["words"], F.lit(0), lambda a, w: a + w["n"])
    points = lambda k: F.slice(F.filter(k["words"], lambda w: w["n"] > 5)["word"], 1, 3)
    own = F.transform("__kinds", lambda k: F.struct(k["ord"].alias("ord"), k["adaptation_type"].alias("adaptation_type"), F.least(n(k) / (10 * F.size(k["words"])), F.lit(1.0)).alias("suitability"), points(k).alias("key_points")))
    own = F.filter(own, lambda k: k["suitability"] > least)
    priced = F.transform(own, lambda k: F.struct(*[k[c].alias(c) for c in ("ord", "adaptation_type", "suitability", "key_points")], adaptation_cost(k["adaptation_type"], F.col("__scenes"), F.col("__speakers"), base).alias("cost")))
    valued = F.transform(priced, lambda k: F.struct(*[k[c].alias(c) for c in ("ord", "adaptation_type", "suitability", "key_points", "cost")], roi(k["suitability"], k["cost"]).alias("roi")))
    ordered = F.array_sort(F.transform(valued, lambda k: F.struct((-F.round(k["roi"], 2)).alias("by"), *[k[c].alias(c) for c in ("ord", "adaptation_type", "suitability", "key_points", "cost", "roi")])))
    return F.slice(ordered, 1, most)


def derivatives(text: str = "text", system: str = "系统", world: str = "世界观", branch=("选择", "分支"), speaker: str = L.SPEAKER_PATTERN, long: int = 500_000) -> Column:
    """Array of (derivative_type, difficulty, potential)."""
    item = lambda name, hard, worth: F.struct(F.lit(name).alias("derivative_type"), F.lit(hard).alias("difficulty"), F.lit(worth).alias("potential"))
    return compact(
        F.when(has(text, system), item("金手指系统小程序", 3, 0.7)), F.when(distinct_matches(text, speaker) >= 5, item("人设周边", 2, 0.6)),
        F.when(has(text, world) | (F.length(text) > long), item("系列文开发", 4, 0.8)), F.when(has_any(text, list(branch)), item("互动小说", 3, 0.65)),
    )


def commercial_score(arpu_: Column, best_roi: Column, potentials: Column) -> Column:
    """``best_roi`` is null without adaptations; ``potentials`` is an array."""
    adapted = F.when(best_roi.isNull(), 0.1).otherwise(best_roi / 5 * 0.4)
    derived = F.when(F.size(potentials) > 0, mean_of(potentials, 0.0) * 0.3).otherwise(0.1)
    return F.least(F.least(arpu_ / 100, F.lit(1.0)) * 0.3 + adapted + derived, F.lit(1.0))


def monetization_path(segment: Column, adaptation: Column, best_roi: Column) -> Column:
    adapted = F.when(adaptation.isNotNull(), F.concat(adaptation, F.lit("改编（ROI预测："), F.format_number(best_roi, 1), F.lit("倍）")))
    return F.concat_ws(" → ", F.concat(F.lit("付费阅读（核心受众："), segment, F.lit("）")), adapted, F.lit("IP衍生开发（周边、游戏、系列文）"))
