"""Tables in buckets: only the touched parts change, a batch counts once, a cut publication is taken up again."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from storyspark.operators import text as T
from storyspark.sources.buckets import BucketTable
from storyspark.sources.scratch import scratch
from storyspark.streaming import streams

ROW = "id long, name string, v int"


def table(spark, rows=()):
    t = BucketTable(spark, scratch(spark, "table"), spark.createDataFrame([], ROW).schema, ["id"], buckets=16)
    if rows:
        t.upsert(spark.createDataFrame(list(rows), ROW))
    return t


def told(t):
    return sorted(map(tuple, t.read().collect()))


def files(t):
    return {os.path.join(d, n) for d, _, names in os.walk(t.path.removeprefix("file:")) for n in names if n.endswith(".parquet") and "/_" not in d.removeprefix(t.path)}


def test_an_upsert_of_few_keys_rewrites_their_buckets_only(spark):
    t = table(spark, [(k, "a", 0) for k in range(400)])
    before = files(t)
    t.upsert(spark.createDataFrame([(7, "b", 2), (7, "c", 1), (900, "n", 1)], ROW), "v")
    assert len(before - files(t)) <= 2 and len(before & files(t)) >= len(before) - 2
    want = {k: (k, "a", 0) for k in range(400)} | {7: (7, "b", 2), 900: (900, "n", 1)}
    assert told(t) == sorted(want.values())
    t.delete(spark.createDataFrame([(k,) for k in range(400)] + [(5000,)], "id long"))
    assert told(t) == [(900, "n", 1)]
    t.delete(spark.createDataFrame([(900,)], "id long"))
    assert told(t) == []


def test_a_batch_that_runs_twice_changes_nothing(spark):
    t = table(spark, [(1, "a", 0)])
    t.upsert(spark.createDataFrame([(1, "b", 1), (2, "b", 1)], ROW), batch=0)
    t.upsert(spark.createDataFrame([(1, "c", 2)], ROW), batch=1)
    t.upsert(spark.createDataFrame([(1, "b", 1), (2, "b", 1)], ROW), batch=0)
    assert told(t) == [(1, "c", 2), (2, "b", 1)] and t.done(1) and not t.done(2)


def test_a_publication_that_was_cut_short_is_taken_up(spark, monkeypatch):
    """The table lost a bucket's files in the middle; the second run publishes what the first had written."""
    t = table(spark, [(k, "a", 0) for k in range(50)])
    lost = sorted(files(t))[0]

    def cut(self, stage):
        os.remove(lost)
        raise OSError("lost")

    ups = spark.createDataFrame([(k, "b", 1) for k in range(0, 50, 3)], ROW)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_publish", cut)
        with pytest.raises(OSError):
            t.upsert(ups, batch=4)
    assert len(told(t)) < 50 and not t.done(4)
    t.upsert(ups, batch=4)
    assert told(t) == sorted((k, "ab"[k % 3 == 0], int(k % 3 == 0)) for k in range(50)) and t.done(4)


def test_books_of_a_stream_are_parsed_once(spark, tmp_path, monkeypatch):
    """The query fails in its second micro-batch and is started again; a book that comes twice keeps its last chapters."""
    first = [(1, 1, "Chapter 1\na\nChapter 2\nb"), (2, 1, "plain")]
    second = [(1, 2, "Chapter 1\nnew"), (3, 1, "Chapter 1\nx"), (3, 2, "Chapter 1\ny\nChapter 2\nz")]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "novel_id long, version int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if "batch" not in f.name:
                f.rename(f.with_name(f"batch{k}.parquet"))
    for k in (0, 1):
        os.utime(tmp_path / "in" / f"batch{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    live = spark.readStream.schema("novel_id long, version int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    schema = T.parse_book(spark.createDataFrame(first, "novel_id long, version int, text string")).schema
    t = BucketTable(spark, scratch(spark, "chapters"), schema, ["novel_id"], buckets=4)
    publish = BucketTable._publish

    def fails(self, stage):
        if "batch=1" in stage:
            raise OSError("lost")
        publish(self, stage)

    checkpoint = scratch(spark, "state")
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_publish", fails)
        with pytest.raises(Exception, match="lost"):
            streams.parsed_books(live, t, checkpoint, "version").awaitTermination()
    assert t.done(0) and not t.done(1)
    streams.parsed_books(live, t, checkpoint, "version").awaitTermination()
    got = sorted((r.novel_id, r.chapter_number, r.content) for r in t.read().collect())
    assert got == [(1, 1, "new"), (2, 1, "plain"), (3, 1, "y"), (3, 2, "z")]
    streams.parsed_books(live, t, scratch(spark, "state"), "version").awaitTermination()  # the same batches under their old numbers
    assert sorted((r.novel_id, r.chapter_number, r.content) for r in t.read().collect()) == got


def test_starts_without_ends(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = [(1, "start", 0), (1, "end", 30), (1, "end", 50), (2, "start", 10), (2, "end", 4000), (3, "start", 20), (9, "end", 20_000), (8, "start", 20_000)]  # the last ones move both watermarks on
    frame = spark.createDataFrame(rows, "task long, what string, s long").withColumn("ts", at(F.col("s")))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = streams.drained(streams.durations(live.where("what = 'start'"), live.where("what = 'end'"), ["task"], "1 hour", "10 minutes"))
    zero = 1_700_000_000
    got = sorted((r.task, int(r.started.timestamp()) - zero, r.ended and int(r.ended.timestamp()) - zero) for r in out.collect())
    assert got == [(1, 0, 30), (1, 0, 50), (2, 10, None), (3, 20, None)]


def test_task_states_of_late_and_repeated_updates(spark, tmp_path):
    """Three files in turn: a late update leaves the status alone, a repeated one counts, a silent task ends."""
    zero = 1_700_000_000
    turns = [[("a", 100, 1, "run", 0.1), ("b", 100, 2, "run", 0.2)], [("a", 90, 0, "old", 0.0), ("a", 100, 1, "run", 0.1), ("b", 200, 3, "done", 1.0)], [("c", 40_000, 9, "run", 0.5)], [("c", 50_000, 10, "done", 1.0)]]
    for k, rows in enumerate(turns):
        frame = spark.createDataFrame(rows, "task_id string, s long, seq long, status string, progress double").withColumn("ts", F.timestamp_seconds(F.col("s") + zero))
        frame.coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        (src,) = (tmp_path / f"t{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        src.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (zero + k, zero + k))
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.drained(streams.task_states(live, silence=3600, late="10 minutes"))
        got = [tuple(r)[:5] for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ended = sorted(r[:4] for r in got if r[4])
    assert ended[:2] == [("a", "run", 0.1, 3), ("b", "done", 1.0, 2)]
    assert ("a", "run", 0.1, 3, False) in got and ("b", "done", 1.0, 2, False) in got and ("c", "run", 0.5, 1, False) in got


def test_the_rows_of_a_batch_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(x: int) -> int:
        seen.add(1)
        return x

    rows = spark.range(0, 50, 1, 2).select(F.udf(told, "long")("id").alias("id"), F.lit("a").alias("name"))
    table = BucketTable(spark, str(tmp_path / "once"), rows.schema, ["id"], 4)
    table.replace(rows, ["id"], 0)
    table.replace(rows.limit(0), ["id"], 1)
    assert table.read().count() == 50
    assert seen.value == 50


def test_tasks_of_one_bucket_end_one_by_one(spark, tmp_path):
    """All tasks in one bucket: one state and one timer for them, results as for each alone; ids are beyond a double's."""
    zero, big = 1_700_000_000, 1 << 60
    turns = [[(big, 100, 1, "run"), (big + 1, 3000, 2, "run"), (None, 200, 3, "run")], [(big + 1, 3100, 4, "done"), (big + 1, 2900, 0, "old"), (7, 6000, 5, "run")], [(8, 9000, 6, "run")], [(9, 9100, 7, "run")]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(turns):
        frame = spark.createDataFrame(rows, "task_id long, s long, seq long, status string").selectExpr("task_id", "timestamp_seconds(s + 1700000000) as ts", "seq", "status", "cast(seq as double) as progress")
        frame.coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        (src,) = (tmp_path / f"t{k}").glob("*.parquet")
        src.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (zero + k, zero + k))
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.drained(streams.task_states(live, silence=3600, late="10 minutes", buckets=1))
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    assert out.schema["task_id"].dataType.simpleString() == "bigint"
    assert sorted((r[0] or 0, *r[1:4]) for r in got if r[4]) == [(0, "run", 3.0, 1), (big, "run", 1.0, 1), (big + 1, "done", 4.0, 3)]
    assert sorted((r[0] or 0, *r[1:4]) for r in got if not r[4]) == [(0, "run", 3.0, 1), (7, "run", 5.0, 1), (8, "run", 6.0, 1), (9, "run", 7.0, 1), (big, "run", 1.0, 1), (big + 1, "done", 4.0, 3), (big + 1, "run", 2.0, 1)]
