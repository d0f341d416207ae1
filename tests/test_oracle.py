"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from storyspark.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Approximate searches, whose recall is tested; run here for their rows alone.
ROWS_ONLY = {"k7_knn_approx", "k7_knn_graph", "k7_knn_lsh"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) + 0.0 if isinstance(v, float) else str(v) if isinstance(v, pd.Timestamp) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def test_every_query_has_sql_or_is_listed():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name not in ROWS_ONLY:
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
