"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_books, q_fusion, q_tables, q_text  # noqa: F401  registers the queries
from .bindings import _FOUND, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FOUND["flagship_top_categories"][0](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
