"""Alerts of very busy keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark.operators import telemetry


def test_alert_cooldown_gathers_no_key(spark):
    times = [(k % 3 or None, k * 7 % 5000) for k in range(5000)] + [(1, None)]
    events = spark.createDataFrame(times, "k long, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    out = telemetry.alert_cooldown(events, "k", seconds=60)
    plan = out._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan
    want = []
    for key in {k for k, _ in times}:
        last = None
        for t in sorted(t for k, t in times if k == key and t is not None):
            if last is None or t - last >= 60:
                last = t
                want.append((key or -1, t))
    assert sorted((r.k or -1, r.s) for r in out.select("k", F.unix_seconds("ts").alias("s")).collect()) == sorted(want)
