"""Telemetry (W1-W14) in batch: counters, histograms, gauges, alerts, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import scan


def counter_totals(events: DataFrame, labels: list[str], width: str = "1 day", ts: str = "ts", value: str = "value") -> DataFrame:
    """``(window_start, labels, n, total)``."""
    by = events.groupBy(F.window(ts, width).alias("w"), *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("window_start"), *labels, "n", "total")


def running_total(events: DataFrame, labels: list[str], width: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts of windows, summed up: a window has few rows for each label, whatever the input."""
    by = counter_totals(events.withColumn("value", F.lit(1)), labels, width, ts)
    return by.select("window_start", *labels, F.sum("n").over(Window.partitionBy(*labels).orderBy("window_start")).alias("so_far"))


def histogram_buckets(events: DataFrame, bounds: list[float], labels: list[str], value: str = "value") -> DataFrame:
    """``(labels, le, n, total_sum, total_n)``: cumulative counts up to each bound, and without bound."""
    by = events.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("total_n"), F.sum(value).alias("total_sum"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("total_n").alias("n"))]
    return by.select(*labels, F.explode(F.array(*rows)).alias("b"), "total_sum", "total_n").select(*labels, "b.le", "b.n", "total_sum", "total_n")


def in_progress_gauge(changes: DataFrame, key: str, ts: str = "ts", seq: str = "event_id", change: str = "change") -> DataFrame:
    """Add ``running``: the sum of the key's changes so far. A key's rows are dealt over many tasks."""
    rows = scan.dealt(changes, [key], [ts, seq])
    return scan.bare(scan.prefixes(rows, [key], [ts, seq], {"running": ("sum", F.col(change))}))


def duration_by_stage(events: DataFrame, key: str, stage: str, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """``(stage, n, seconds, longest)``: from each event to the key's next. A key's rows are dealt over many tasks."""
    rows = scan.dealt(events.select(key, stage, ts, seq), [key], [ts, seq])
    rows = scan.scanned(rows, [key], [ts, seq], after={"__next": F.col(ts)})
    rows = rows.withColumn("__s", F.unix_seconds(F.col("__next").cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))).where("__s is not null")
    return rows.groupBy(stage).agg(F.count("*").alias("n"), F.sum("__s").alias("seconds"), F.max("__s").alias("longest"))


def share_by_window(events: DataFrame, good: Column, within: Column, width: str = "1 hour", ts: str = "ts", slide: str | None = None) -> DataFrame:
    """``(window_start, n, hits, share)`` of the rows within; used for hit ratios and failure rates."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    by = events.where(within).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(good).alias("hits"))
    return by.select(F.col("w.start").alias("window_start"), "n", "hits", (F.col("hits") / F.col("n")).alias("share"))


def failure_rate_alert(events: DataFrame, failed: Column, within: Column, threshold: float = 0.2, width: str = "1 hour", ts: str = "ts", slide: str | None = None) -> DataFrame:
    return share_by_window(events, failed, within, width, ts, slide).where(F.col("share") > threshold)


def alert_cooldown(events: DataFrame, key: str, ts: str = "ts", seconds: int = 300) -> DataFrame:
    """``(key, ts)`` of alerts that are let through: at least ``seconds`` after the last one let through.

    The rule depends on what was let through before, so the times of a key pass in order through one
    task, which holds only the last one let through.
    """
    rows = events.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("t is not null")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for batch in batches:
            kept = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or not (k == now or (k != k and now != now)):
                    go = True
                else:
                    go = t - last >= seconds * 1_000_000
                if go:
                    now, last = k, t
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    dealt = rows.repartition(key).sortWithinPartitions(key, "t")
    return dealt.mapInArrow(told, dealt.schema).select(key, F.timestamp_micros("t").alias("ts"))


def model_health(calls: DataFrame, good: Column, least: float = 0.8, width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """``(window_start, n, hits, share, healthy)``: the share of model calls that succeeded, and whether it is enough."""
    return share_by_window(calls, good, F.lit(True), width, ts).withColumn("healthy", F.col("share") >= least)


def queue_backlog(tasks: DataFrame, per_worker: int = 10) -> DataFrame:
    n = F.count_if(F.col("status") == "pending")
    return tasks.agg(n.alias("pending"), F.ceil(n / per_worker).alias("workers"))


def rate_limit_count(events: DataFrame, key: str, ts: str = "ts", seq: str = "event_id", silence: int = 60, limit: int = 60) -> DataFrame:
    """Add ``calls`` since the key's last silence, and ``limited``. A gap of exactly ``silence`` ends it.

    Calls are the key's rows so far, less those before the last row that a silence precedes: two running
    values, so that a key's rows are dealt over many tasks.
    """
    by = [ts, seq]
    rows = scan.scanned(scan.dealt(events, [key], by), [key], by, running={"__n": ("sum", F.lit(1))}, before={"__before": F.col(ts)})
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__before").cast("timestamp"))
    rows = stored(rows.withColumn("__new", F.when(F.coalesce(gap >= silence * 1_000_000, F.lit(True)), F.col("__n"))).drop("__before"), "calls")
    rows = scan.scanned(rows, [key], by, running={"__since": ("max", F.col("__new"))})
    calls = (F.col("__n") - F.col("__since") + 1).cast("int")
    return scan.bare(rows.withColumn("calls", calls).withColumn("limited", calls > limit).drop("__new", "__n", "__since"))


def named_counters(events: DataFrame, name: str, value: Column) -> DataFrame:
    return events.groupBy(name).agg(F.sum(value).alias("total"))


def request_stats(requests: DataFrame, path: str, status: str, seconds: str, bounds: list[float]) -> DataFrame:
    """Counts, mean time and cumulative buckets of each path and status."""
    own = [F.count_if(F.col(seconds) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return requests.groupBy(path, status).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"), *own)


def system_stats(novels: DataFrame, tasks: DataFrame, done: str = "completed") -> DataFrame:
    n = novels.agg(F.count("*").alias("novels"))
    t = tasks.agg(F.count("*").alias("tasks"), F.avg((F.col("status") == done).cast("int")).alias("success_rate"), F.avg("duration_seconds").alias("mean_seconds"))
    return n.crossJoin(F.broadcast(t))
