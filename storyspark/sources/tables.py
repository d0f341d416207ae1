"""Upserts, partial updates and deletes as whole-table rewrites.

Plain Parquet has no update, so each operator takes tables and returns the new table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vectors import l2_normalize
from .scratch import discard, scratch, stored  # noqa: F401


def one_each(rows: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row for each key: the highest ``version``, where one is named, then the smallest hash of the row."""
    order = [F.col(version).desc_nulls_last()] if version else []
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.xxhash64(F.to_json(F.struct(*rows.columns)))))
    return rows.withColumn("__p", place).where("__p = 1").drop("__p")


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Replace or insert by key. Of several updates of a key one stands, see ``one_each``."""
    updates = one_each(updates, keys, version)
    return table.join(updates.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(updates)


def append_chapters(chapters: DataFrame) -> DataFrame:
    """Chapter rows with the hash of their content, ready to append."""
    return chapters.withColumn("chapter_hash", F.md5("content"))


def update_columns(table: DataFrame, updates: DataFrame, key: str, columns: list[str], version: str | None = None) -> DataFrame:
    """Set columns where an update has a value; ``changed`` tells whether a row is another now.

    Of several updates of a key one stands, see ``one_each``.
    """
    own = one_each(updates, [key], version).select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = table.join(own.hint("merge"), key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    rows = rows.withColumn("changed", changed)
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def delete_by_key(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted keys."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys.hint("merge"), key, "left_anti") for name, t in tables.items()}


def add_benchmark(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert benchmarks; missing market data are an empty map, missing tags an empty list."""
    own = rows.withColumns({"market_data": F.coalesce("market_data", F.create_map().cast("map<string,double>")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "is_active": F.coalesce("is_active", F.lit(True))})
    return upsert(table, own, ["benchmark_id"])


def insert_vectors(rows: DataFrame, vector: str = "vector", title: str | None = None, longest: int = 256) -> DataFrame:
    """Unit vectors and titles of bounded length, ready to append."""
    out = rows.withColumn(vector, l2_normalize(F.col(vector)))
    return out.withColumn(title, F.substr(F.col(title), F.lit(1), F.lit(longest))) if title else out


def create_rows(rows: DataFrame, parts: list[str], name: str = "id") -> DataFrame:
    """Add an id that is a hash of the row's own values, so that a repeated task makes the same id."""
    return rows.withColumn(name, F.sha2(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]), 256))
