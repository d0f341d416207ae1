"""Running sums and neighbours of ordered groups, with a large group dealt over all tasks.

A window by key puts a key's rows in one task. Here rows are dealt by ranges of (key, order), so that a
key with a third of all rows lies in a third of the parts. Each part is scanned alone; what a part must
know of the parts before (or after) it is one small row for each key that lies in several parts. A part
has at most two such keys, its first and its last, so these rows are at most twice the parts, and are
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Columns that ``dealt`` adds: the part, and a number that tells equal rows apart.
PART, TIE = "__part", "__tie"

_KINDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(a, b)
    return F.coalesce(a + b if kind == "sum" else a.bitwiseXOR(b), a, b)


def dealt(rows: DataFrame, keys: list[str], order: list[str], store: Callable[[DataFrame, str], DataFrame] = stored, parts: int | None = None) -> DataFrame:
    """The rows with ``PART`` and ``TIE``, dealt by ranges of keys and order, and written by ``store``.

    Nulls come first. Which of two rows with equal keys and order is first is open, but stays the same
    from here on. Without ``parts`` the session decides how many there are.
    """
    by = [*keys, *order, TIE]
    rows = rows.withColumn(TIE, F.monotonically_increasing_id())
    out = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return store(out.withColumn(PART, F.spark_partition_id()), "parts")


def _matching(names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names])


def _renamed(small: DataFrame, names: list[str]) -> DataFrame:
    return F.broadcast(small.withColumnsRenamed({n: f"__of_{n}" for n in names}))


def spread_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in more than one part: at most one for each part."""
    key = F.struct(*keys)
    ends = rows.groupBy(PART).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    ends = ends.select(PART, F.explode(F.array("a", "b")).alias("k")).distinct()
    return ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.*")


def by_part(rows: DataFrame, keys: list[str], *told: Column) -> DataFrame:
    """Aggregates of each part of the keys that lie in several: at most two rows for each part."""
    wide = _renamed(spread_keys(rows, keys), keys)
    return rows.join(wide, _matching(keys), "left_semi").groupBy(PART, *keys).agg(*told)


def carried(rows: DataFrame, keys: list[str], small: DataFrame) -> DataFrame:
    """Rows with the columns of a table ``by_part``, null for all other keys."""
    names = [PART, *keys]
    return rows.join(_renamed(small, names), _matching(names), "left").drop(*[f"__of_{n}" for n in names])


def scanned(
    rows: DataFrame, keys: list[str], order: list[str], running: dict[str, tuple[str, Column]] | None = None,
    after: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values and values of neighbours; ``rows`` come from ``dealt`` with these keys and order.

    ``running`` names a kind (sum, max, min or xor) and a column for each new column: its value over the key's rows up to
    and with this one. ``after`` and ``before`` name columns of the key's next row and of the one before, null where
    there is none. What the parts tell each other comes from one aggregate of the keys that lie in several.
    """
    running, after, before = running or {}, after or {}, before or {}
    at = F.struct(*order, TIE)
    told = [_KINDS[k](c).alias(f"__c_{n}") for n, (k, c) in running.items()]
    own = Window.partitionBy(PART, *keys).orderBy(*order, TIE)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    new = {n: _KINDS[k](c).over(so_far) for n, (k, c) in running.items()}
    parts = Window.partitionBy(*keys).orderBy(PART)
    up_to = parts.rowsBetween(Window.unboundedPreceding, -1)
    carry = [_KINDS[k](f"__c_{n}").over(up_to).alias(f"__c_{n}") for n, (k, _) in running.items()]
    for wanted, name, step, first in ((after, "__s_after", F.lead, F.min_by), (before, "__s_before", F.lag, F.max_by)):
        if wanted:
            told.append(first(F.struct(*[c.alias(n) for n, c in wanted.items()]), at).alias(name))
            carry.append(step(name).over(parts).alias(name))
            new |= {n: step(c).over(own) for n, c in wanted.items()} | {f"{name}_in": step(F.lit(1)).over(own)}
    small = by_part(rows, keys, *told).select(PART, *keys, *carry)
    out = carried(rows.withColumns(new), keys, small)
    joined = {n: _both(k, F.col(n), F.col(f"__c_{n}")) for n, (k, _) in running.items()}
    for wanted, name in ((after, "__s_after"), (before, "__s_before")):
        joined |= {n: F.when(F.col(f"{name}_in").isNotNull(), F.col(n)).otherwise(F.col(f"{name}.{n}")) for n in wanted}
    return out.withColumns(joined).drop("__s_after", "__s_before", "__s_after_in", "__s_before_in", *[f"__c_{n}" for n in running])


def prefixes(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    return scanned(rows, keys, order, running=wanted)


def bare(rows: DataFrame) -> DataFrame:
    """Without the columns that ``dealt`` has added."""
    return rows.drop(PART, TIE)
