"""Structured Streaming twins of the telemetry and ingest operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import text
from ..sources.buckets import BucketTable, sink
from ..sources.scratch import scratch
from ..sources.tables import one_each


def counter_totals(events: DataFrame, labels: list[str], width: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    by = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *labels).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), *labels, "n", "total")


def failure_rates(events: DataFrame, failed: Column, within: Column, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    by = events.where(within).withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("hits"))
    return by.select(F.col("w.start").alias("window_start"), "n", "hits", (F.col("hits") / F.col("n")).alias("share"))


def sessions(events: DataFrame, key: str, silence: str = "60 seconds", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """``(key, session_start, calls)`` of sessions that a silence ends."""
    by = events.withWatermark(ts, late).groupBy(F.session_window(ts, silence).alias("s"), key).agg(F.count("*").alias("calls"))
    return by.select(key, F.col("s.start").alias("session_start"), "calls")


def alert_cooldown(events: DataFrame, key: str, seconds: int = 300, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Alerts that are let through; the state of a key is the time of its last one.

    Alerts that come more than ``late`` behind are dropped. So is a key's state, once every alert that may
    still come would be let through.
    """
    kind = dict(events.dtypes)[key]

    def told(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for p in parts for x in p[ts].tolist()):
            at = int(pd.Timestamp(t).value // 1000)
            if last is None or at - last >= seconds * 1_000_000:
                out.append(t)
                last = at
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), ts: out})

    return events.select(key, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(told, f"{key} {kind}, {ts} timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def new_chapters(chapters: DataFrame, ts: str = "ts", remember: str = "30 days") -> DataFrame:
    """Chapters whose hash was not seen within the time remembered."""
    return chapters.withWatermark(ts, remember).dropDuplicatesWithinWatermark(["chapter_hash"])


def ingest(books: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch to a sink, once each."""
    return books.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed_books(books: DataFrame, chapters: BucketTable, checkpoint: str, version: str | None = None, **parse):
    """Parse the books of a stream as they come, and keep each book's chapters in a table: exactly once.

    ``chapters`` has the key ``novel_id`` and the columns of ``text.parse_book``. A book that comes again replaces its
    chapters, of several in one micro-batch one stands (see ``tables.one_each``). A micro-batch that runs again after a failure
    changes nothing. Returns the started query.
    """
    made = lambda batch: text.parse_book(one_each(batch, ["novel_id"], version).select("novel_id", "text"), **parse)
    return ingest(books, sink(chapters, made, whole=True), checkpoint)


def durations(starts: DataFrame, ends: DataFrame, keys: list[str], longest: str = "1 hour", late: str = "1 hour", ts: str = "ts", also: list[str] | None = None) -> DataFrame:
    """``(keys, also, started, ended)``: each start with the ends that follow within ``longest``; null where none comes.
    ``also`` names further columns of the starts.

    Two streams are joined; both have watermarks, so that a start is held only until no end can come any more.
    """
    a = starts.withWatermark(ts, late).select(*keys, *(also or []), F.col(ts).alias("started"))
    b = ends.withWatermark(ts, late).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(ts).alias("ended"))
    match = F.expr(f"ended >= started and ended <= started + interval {longest}")
    for k in keys:
        match = match & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, match, "leftOuter").select(*keys, *(also or []), "started", "ended")


class _Latest(StatefulProcessor):
    """The latest state of each task of a bucket, and how often it changed; the bucket's timer ends the tasks that are silent.

    A bucket's states are read and written as one value: each message to the state store, and each frame that is handed on, is
    for all its tasks.
    """

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tasks array<struct<task: string, ts: long, seq: long, status: string, progress: double, n: long>>")

    def held(self) -> dict:
        return {row[0]: tuple(row)[1:] for row in self.last.get()[0]} if self.last.exists() else {}

    def ends(self, ts: int) -> int:
        return ts // 1000 + self.silence * 1000

    def first(self, tasks: dict) -> int | None:
        return min((self.ends(x[0]) for x in tasks.values()), default=None)

    def keep(self, tasks: dict) -> None:
        if tasks:
            self.last.update(([(task, *x) for task, x in tasks.items()],))
        else:
            self.last.clear()

    def told(self, tasks: dict, ended: bool) -> pd.DataFrame:
        _, _, status, progress, n = zip(*tasks.values(), strict=True)
        return pd.DataFrame({"task": list(tasks), "status": list(status), "progress": list(progress), "n_updates": list(n), "ended": [ended] * len(tasks)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tasks, seen = self.held(), {}
        was = self.first(tasks)
        for part in rows:
            at = (part["ts"].astype("int64") // (1000 if str(part["ts"].dtype).startswith("datetime64[ns") else 1)).tolist()
            for task, t, s, a, p in zip(part["task"].tolist(), at, part["seq"].tolist(), part["status"].tolist(), part["progress"].tolist(), strict=True):
                ts, seq, status, progress, n = seen.get(task) or tasks.get(task) or (-(1 << 62), -(1 << 62), None, None, 0)
                seen[task] = (t, s, a, p, n + 1) if (t, s) > (ts, seq) else (ts, seq, status, progress, n + 1)
        tasks |= seen
        self.keep(tasks)
        now = self.first(tasks)
        if now != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(now)
        yield self.told(seen, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tasks, mark = self.held(), timerValues.getCurrentWatermarkInMs()
        over = {task: x for task, x in tasks.items() if self.ends(x[0]) < mark}
        tasks = {task: x for task, x in tasks.items() if task not in over}
        self.keep(tasks)
        if tasks:
            self.handle.registerTimer(self.first(tasks))
        if over:
            yield self.told(over, True)

    def close(self) -> None:
        pass


def task_states(log: DataFrame, silence: int = 3600, late: str = "1 hour", buckets: int = 2048) -> DataFrame:
    """``(task_id, status, progress, n_updates, ended)``: a row for each task that a micro-batch changes, by the latest of its updates.

    ``log`` has ``(task_id, ts, seq, status, progress)``. Updates that come late or twice leave a later status alone. A task of which
    nothing was heard for ``silence`` seconds of event time ends: it gets a last row, and its state goes. The session must use the
    RocksDB state store. Tasks are dealt over ``buckets`` by a hash; a micro-batch reads and writes the states of the buckets that it
    touches, so many more tasks at a time ask for more buckets.
    """
    kind = dict(log.dtypes)["task_id"]
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = log.select(bucket, F.col("task_id").cast("string").alias("task"), "ts", "seq", "status", F.col("progress").cast("double").alias("progress")).withWatermark("ts", late)
    told = rows.groupBy("bucket").transformWithStateInPandas(_Latest(silence), "task string, status string, progress double, n_updates long, ended boolean", "append", "eventTime")
    return told.select(F.col("task").cast(kind).alias("task_id"), "status", "progress", "n_updates", "ended")


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its result.

    ``append`` adds each micro-batch to a table, ``complete`` replaces the table by each. The table and the
    query's checkpoint are in the shared folder that the session names.
    """
    spark = rows.sparkSession
    path = scratch(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        target = f"{path}/table" if mode == "complete" else f"{path}/table/batch={n}"
        batch.write.mode("overwrite").parquet(target)  # a batch that is run again replaces itself

    query = rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")
