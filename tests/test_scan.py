"""Running values and neighbours of groups that are dealt over many tasks, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storyspark.operators import scan, telemetry

SCHEMA = "k string, ts long, seq long, v long"


def events(n=3000, seed=1):
    """A third of all rows have one key; keys, times and values may be null, times repeat."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [None, *"abcdefghijk"]
    return [(rng.choice(keys), rng.choice([None, *range(400)]), i, rng.choice([None, *range(-9, 9)])) for i in range(n)]


def ordered(rows):
    """By key, time and number, nulls first; for each key its rows."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_prefixes_and_neighbours(spark, parts):
    rows = events()
    by = scan.dealt(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts", "seq"], parts=parts)
    wanted = {"s": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "m": ("max", F.col("v")), "l": ("min", F.col("v")), "x": ("xor", F.col("v"))}
    out = scan.scanned(by, ["k"], ["ts", "seq"], wanted, {"after": F.col("v"), "after_seq": F.col("seq")}, {"before": F.col("v")})
    got = {r.seq: (r.s, r.n, r.m, r.l, r.x, r.after, r.after_seq, r.before) for r in out.collect()}
    want = {}
    for own in ordered(rows).values():
        s = m = lo = x = None
        for i, r in enumerate(own):
            if (v := r[3]) is not None:
                s, m, lo, x = (s or 0) + v, v if m is None else max(m, v), v if lo is None else min(lo, v), (x or 0) ^ v
            ahead = own[i + 1] if i + 1 < len(own) else (None,) * 4
            want[r[2]] = (s, i + 1, m, lo, x, ahead[3], ahead[2], own[i - 1][3] if i else None)
    assert got == want


def test_a_hot_key_is_dealt_over_all_tasks(spark):
    by = scan.dealt(spark.createDataFrame(events(6000), SCHEMA), ["k"], ["ts", "seq"], parts=30)
    many = [r["count"] for r in by.groupBy(scan.PART).count().collect()]
    assert len(many) > 25 and max(many) < 3 * 6000 / 30
    assert by.where("k = 'hot'").select(scan.PART).distinct().count() >= 8
    assert scan.spread_keys(by, ["k"]).count() <= 30


def test_equal_rows_are_dealt_too(spark):
    by = scan.dealt(spark.createDataFrame([("a", 1, 1, 1)] * 1000, SCHEMA), ["k"], ["ts", "seq"], parts=10)
    assert by.select(scan.PART).distinct().count() >= 8
    out = scan.prefixes(by, ["k"], ["ts", "seq"], {"n": ("sum", F.lit(1))})
    assert sorted(r.n for r in out.collect()) == list(range(1, 1001))


def test_no_rows(spark):
    by = scan.dealt(spark.createDataFrame([], SCHEMA), ["k"], ["ts", "seq"])
    out = scan.scanned(by, ["k"], ["ts", "seq"], {"n": ("sum", F.lit(1))}, {"a": F.col("v")})
    assert out.count() == 0


def test_rate_limit_of_a_hot_key(spark):
    """Calls since the last silence of 60 s, by a plain loop."""
    rng = random.Random(4)
    rows, now = [], 0
    for i in range(2000):
        now += rng.choice([1, 5, 59, 60, 61])
        rows.append(("hot" if i % 3 else "other", now, i))
    frame = spark.createDataFrame(rows, "k string, s long, seq long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.seq: (r.calls, r.limited) for r in telemetry.rate_limit_count(frame, "k", seq="seq", limit=3).collect()}
    last, calls, want = {}, {}, {}
    for k, s, i in rows:
        calls[k] = 1 if k not in last or s - last[k] >= 60 else calls[k] + 1
        last[k] = s
        want[i] = (calls[k], calls[k] > 3)
    assert got == want
