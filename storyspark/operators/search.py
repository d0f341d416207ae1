"""Search, lists and statistics over feature and task tables (Q1-Q14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def search_features(rows: DataFrame, equal: dict[str, object] | None = None, min_confidence: float | None = None, sort: str = "created_at", ascending: bool = False, key: str = "novel_id", skip: int = 0, limit: int = 20, score: str = "confidence_score") -> tuple[DataFrame, DataFrame]:
    """A page of the rows that fit, and their number. Filters reach the scan; ties in the sort go by key.

    Names with dots are paths into nested columns; a plain name that is no column is looked up in the
    map ``custom_fields``.
    """
    found = rows
    for name, value in (equal or {}).items():
        at = F.col(name) if "." in name or name in rows.columns else F.col("custom_fields")[name]
        found = found.where(at == value)
    if min_confidence is not None:
        found = found.where(F.col(score) >= min_confidence)
    order = F.col(sort).asc_nulls_first() if ascending else F.col(sort).desc_nulls_last()
    return found.orderBy(order, key).offset(skip).limit(limit), found.agg(F.count("*").alias("total"))


def text_search(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold any term of the query, with the number of terms as ``matched``."""
    terms = list(dict.fromkeys(query.lower().split()))
    n = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return rows.withColumn("matched", n).where("matched > 0")


def similar_by_features(rows: DataFrame, same: list[str], key: str = "novel_id", score: str = "confidence_score", least: float = 0.6, limit: int = 10) -> DataFrame:
    """``(novel_id, place, other_id)``: others with the same fields, the most confident first.

    A row is searched by the fields it has; one that lacks all of them may be like any other. A row that may be found stands
    under each choice of its fields, and only the ``limit`` + 1 best of each combination of values can be among the answers, so
    one window and one join do; no group meets itself whole. Meant for a few fields.
    """
    at = [f"__k{i}" for i in range(len(same))]
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(same)), F.lit(0))
    asked = rows.select(key, mask.alias("__m"), *[F.col(c).alias(a) for a, c in zip(at, same, strict=True)])
    kinds = dict(rows.dtypes)

    def under(m: int) -> Column:
        own = [F.col(c) if m >> i & 1 else F.lit(None).cast(kinds[c]) for i, c in enumerate(same)]
        held = [F.col(c).isNotNull() for i, c in enumerate(same) if m >> i & 1]
        return F.when(reduce(lambda a, b: a & b, held, F.lit(True)), F.struct(F.lit(m).alias("m"), *[x.alias(a) for a, x in zip(at, own, strict=True)]))

    choices = F.array_compact(F.array(*[under(m) for m in range(1 << len(same))]))
    good = rows.where(F.col(score) >= least).select(F.col(key).alias("other_id"), F.col(score).alias("__s"), F.explode(choices).alias("c"))
    good = good.select("other_id", "__s", F.col("c.m").alias("__of_m"), *[F.col(f"c.{a}").alias(f"__of{a}") for a in at])
    place = F.row_number().over(Window.partitionBy("__of_m", *[f"__of{a}" for a in at]).orderBy(F.desc("__s"), "other_id"))
    good = good.withColumn("__p", place).where(F.col("__p") <= limit + 1).drop("__p")
    same_key = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"__of{a}")) for a in at], F.col("__m") == F.col("__of_m"))
    pairs = asked.join(good.hint("merge"), same_key).where(F.col(key) != F.col("other_id")).select(key, "other_id", "__s")
    mine = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__s"), "other_id"))
    return pairs.withColumn("place", mine).where(F.col("place") <= limit).select(key, "place", "other_id")


def feature_stats(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """``(dimension, value, n)``: counts by each dimension alone, in one pass; nulls are left out."""
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("d")
    return rows.select(named).select("d.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def dashboard(rows: DataFrame, now: Column, created: str = "created_at", score: str = "confidence_score") -> DataFrame:
    """Number of rows, of those since the day began, and mean confidence."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(created) >= F.date_trunc("day", now)).alias("today"), F.avg(score).alias("mean_confidence"))


def list_all(rows: DataFrame, key: str, skip: int = 0, limit: int = 100, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(key).offset(skip).limit(limit)


def get_by_key(rows: DataFrame, key: str, keys: DataFrame | list) -> DataFrame:
    """The rows with a key: a short list becomes a filter, a table a semi join."""
    return rows.where(F.col(key).isin(keys)) if isinstance(keys, list) else rows.join(keys.select(key).distinct().hint("merge"), key, "left_semi")


def with_features(catalog: DataFrame, features: DataFrame, key: str = "novel_id") -> DataFrame:
    return catalog.join(features, key, "left")


def pending_tasks(tasks: DataFrame, limit: int = 10) -> DataFrame:
    """Waiting tasks: the highest priority, then the oldest."""
    return tasks.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def split_expired(tasks: DataFrame, cutoff: Column, final: tuple[str, ...] = ("completed", "failed", "cancelled")) -> tuple[DataFrame, DataFrame]:
    """Tasks that stay, and finished ones from before the cutoff."""
    old = F.coalesce((F.col("created_at") < cutoff) & F.col("status").isin(*final), F.lit(False))
    return tasks.where(~old), tasks.where(old)


def status_transitions(events: DataFrame, start: str = "preprocessing", end: str = "completed") -> DataFrame:
    """Latest state of each task from its log ``(task_id, ts, seq, status, progress, stage)``."""
    last = F.struct("ts", "seq")
    return events.groupBy("task_id").agg(
        F.max_by("status", last).alias("status"), F.max_by("progress", last).alias("progress"), F.max_by("stage", last).alias("current_stage"),
        F.min(F.when((F.col("stage") == start) & (F.col("progress") == 0), F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status") == end, F.col("ts"))).alias("completed_at"),
        F.count("*").alias("n_updates"),
    )


def stage_progress(events: DataFrame) -> DataFrame:
    """Last progress and duration of each task and stage; a stage lasts until the next sample of the task."""
    rows = scan.dealt(events.select("task_id", "ts", "seq", "stage", "progress"), ["task_id"], ["ts", "seq"])
    rows = scan.scanned(rows, ["task_id"], ["ts", "seq"], after={"__next": F.col("ts")})
    rows = rows.withColumn("__s", F.coalesce(F.unix_seconds("__next") - F.unix_seconds("ts"), F.lit(0)))
    return rows.groupBy("task_id", "stage").agg(F.max_by("progress", F.struct("ts", "seq")).alias("progress"), F.sum("__s").alias("seconds"))
