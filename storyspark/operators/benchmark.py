"""Benchmark library (B1-B8): lists, comparison, differences, reuse, suggestions and trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textfn import compact


def list_benchmarks(rows: DataFrame, genre: str | None = None, tags: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Active rows, the most read first."""
    found = rows.where("is_active")
    if genre is not None:
        found = found.where(F.col("genre") == genre)
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return found.orderBy(F.col("read_count").desc_nulls_last(), "benchmark_id").limit(limit)


def similarity(ours: dict[str, Column], theirs: dict[str, Column]) -> Column:
    """Sum of the parts that agree: conflict, advantage, arc, rhythm, short sentences."""
    same = lambda name, worth: F.when(ours[name] == theirs[name], worth).otherwise(0.0)
    each = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("每"))
    out = same("conflict_type", 0.2) + same("gf_type", 0.15) + same("arc_type", 0.15)
    out = out + F.when(each(ours["rhythm_pattern"]) & each(theirs["rhythm_pattern"]), 0.1).otherwise(0.0)
    return out + F.when((ours["short_ratio"] > 0.4) & (F.coalesce(theirs["short_ratio"], F.lit(0.0)) > 0.4), 0.1).otherwise(0.0)


FIELDS = ["conflict_type", "gf_type", "arc_type", "rhythm_pattern", "short_ratio"]


#: Rows of the library's best that may be broadcast.
MOST_BROADCAST = 100_000


def compare(novels: DataFrame, library: DataFrame, top: int = 3, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(novel_id, place, benchmark_id, title, similarity)``.

    The ``2 * top`` most read active benchmarks of the novel's genre are ranked by similarity, equal ones by
    reads; sums that differ only by floating point are equal. Only that many rows of the library can meet a novel, so the join grows with the novels alone: these rows are
    broadcast once their number is checked. ``describe`` adds the fields to library rows that lack
    them; it sees the best rows alone.
    """
    read = F.row_number().over(Window.partitionBy("genre").orderBy(F.col("read_count").desc_nulls_last(), "benchmark_id"))
    ids = library.where("is_active").select("genre", "benchmark_id", "read_count").withColumn("__read", read).where(F.col("__read") <= 2 * top).select("benchmark_id", "__read")
    how = "broadcast" if ids.count() <= MOST_BROADCAST else "merge"
    best = library.join(ids.hint(how), "benchmark_id")
    best = describe(best) if describe else best
    best = best.select("genre", "benchmark_id", "title", "__read", *[F.col(c).alias(f"__{c}") for c in FIELDS], *[c for c in ("top_hook",) if c in library.columns])
    pairs = novels.withColumnRenamed("top_hook", "own_hook").join(best.hint(how), "genre")
    pairs = pairs.withColumn("similarity", similarity({c: F.col(c) for c in FIELDS}, {c: F.col(f"__{c}") for c in FIELDS}))
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc(F.round("similarity", 9)), "__read"))
    return pairs.withColumn("place", place).where(F.col("place") <= top)


def differentiation(title: Column, innovation: Column, own_hook: Column, hook: Column, own_arc: Column, arc: Column) -> Column:
    """Array of (dimension, point, score) against the most similar benchmark."""
    item = lambda d, p, s: F.struct(F.lit(d).alias("dimension"), p.alias("point"), F.lit(s).alias("score"))
    return compact(
        F.when(innovation.isNotNull(), item("金手指设定", F.concat(F.lit("相比《"), title, F.lit("》，本作金手指具有创新性："), innovation), 0.8)),
        F.when(own_hook != hook, item("情绪驱动", F.concat(F.lit("《"), title, F.lit("》以"), hook, F.lit("为主，本作以"), own_hook, F.lit("为主")), 0.7)),
        F.when(own_arc != arc, item("人物成长", F.concat(F.lit("人物弧光类型不同："), own_arc, F.lit(" vs "), arc), 0.6)),
    )


#: Roles of a novel that are looked at, and the reusability above which one is a template.
ROLES, ROLE_LEAST = 2, 0.8


def reusable_elements(title: Column, own_conflict: Column, conflict: Column, reuse: Column, rhythm: Column, roles: Column | None = None) -> Column:
    """Array of (element, source, description, score) against one benchmark.

    ``roles`` are the novel's supporting roles, best first: structs with role_name, function_type, reusability.
    """
    item = lambda e, d, s: F.struct(F.lit(e).alias("element"), title.alias("source"), d.alias("description"), s.cast("double").alias("score"))
    formula = compact(F.when(own_conflict == conflict, item("冲突公式", F.concat(F.lit("可复用《"), title, F.lit("》的冲突公式结构")), reuse)))
    pace = compact(F.when(F.contains(rhythm, F.lit("每")), item("爽点节奏", F.concat(F.lit("可复用节奏模式："), rhythm), F.lit(0.75))))
    if roles is None:
        return F.concat(formula, pace)
    good = F.filter(F.slice(roles, 1, ROLES), lambda r: r["reusability"] > ROLE_LEAST)
    said = lambda r: F.concat(F.lit("『"), r["role_name"], F.lit("』类型的"), r["function_type"], F.lit("配角可复用"))
    templates = F.transform(good, lambda r: item("配角模板", said(r), r["reusability"]))
    return F.concat(formula, F.coalesce(templates, F.slice(formula, 1, 0)), pace)  # a novel without roles has none


def suggestions(total_hooks: Column, n_constraints: Column, completion: Column, commercial: Column) -> Column:
    """Array of (category, suggestion, priority, reference)."""
    item = lambda c, s, p, r: F.struct(F.lit(c).alias("category"), F.lit(s).alias("suggestion"), F.lit(p).alias("priority"), F.lit(r).alias("reference"))
    return compact(
        F.when(total_hooks < 20, item("情绪节奏", "情绪钩子密度偏低，建议增加爽点/悬念的分布密度", "high", "标杆作品平均钩子数：50+")),
        F.when(n_constraints < 2, item("设定设计", "金手指约束条件较少，建议增加'代价/限制'类约束以提升剧情张力", "medium", "优秀作品的约束条件数：2-4个")),
        F.when(completion < 0.6, item("人物塑造", "人物弧光完成度不足，建议增加关键转折点", "high", "标杆作品完成度：0.8+")),
        F.when(commercial < 0.6, item("商业潜力", "商业潜力评分偏低，建议优化受众定位或增加改编适配点", "medium", "高商业潜力作品特征：明确受众+强改编适配性")),
    )


#: What is suggested where the library has no benchmark of the novel's genre.
NO_LIBRARY = "暂无标杆数据，建议添加同类标杆进行对比"


def comparison(novels: DataFrame, library: DataFrame, top: int = 3, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(novel_id, differentiation, reusable, suggestions, similar)``: four lists for each novel.

    Novels have the fields of ``compare`` and innovations, reusability, roles, total_hooks, n_constraints,
    completion, commercial_score. Differences are told against the most similar benchmark, reusable
    elements against the first two. A novel without a benchmark of its genre has empty lists, but for one
    suggestion, ``NO_LIBRARY``.
    """
    c = F.col
    rows = compare(novels, library, top, describe)
    diff = differentiation(c("title"), F.get("innovations", F.lit(0)), c("own_hook"), c("top_hook"), c("arc_type"), c("__arc_type"))
    again = reusable_elements(c("title"), c("conflict_type"), c("__conflict_type"), c("reusability"), c("rhythm_pattern"), c("roles"))
    item = F.struct("place", F.struct("benchmark_id", "title", "similarity").alias("similar"), F.when(c("place") == 1, diff).alias("differentiation"), F.when(c("place") <= 2, again).alias("reusable"))
    told = rows.groupBy("novel_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    own = suggestions(c("total_hooks"), c("n_constraints"), c("completion"), c("commercial_score"))
    lonely = F.array(F.struct(F.lit("").alias("category"), F.lit(NO_LIBRARY).alias("suggestion"), F.lit("").alias("priority"), F.lit("").alias("reference")))
    lists = {n: F.coalesce(F.flatten(F.array_compact(c(f"rows.{n}"))), F.array()) for n in ("differentiation", "reusable")}
    out = novels.select("novel_id", own.alias("own")).join(told.hint("merge"), "novel_id", "left")
    return out.select("novel_id", *[v.alias(n) for n, v in lists.items()], F.when(c("rows").isNull(), lonely).otherwise(c("own")).alias("suggestions"), F.coalesce("rows.similar", F.array()).alias("similar"))


def trending_features(library: DataFrame, since: Column, dimensions: list[str], genre: str | None = None, sample: int = 50, top: int = 3) -> DataFrame:
    """``(dimension, place, value, n)``: the most common values among the most read recent rows."""
    rows = library.where(F.col("is_active") & (F.col("updated_at") >= since))
    if genre is not None:
        rows = rows.where(F.col("genre") == genre)
    rows = rows.orderBy(F.col("read_count").desc_nulls_last(), "benchmark_id").limit(sample)
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("d")
    counts = rows.select(named).select("d.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("dimension", "place", "value", "n")
