"""Readers, table rewrites, and streams against their batch forms."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from storyspark.operators import telemetry as W
from storyspark.sources import files, tables
from storyspark.streaming import streams

from .conftest import SF


def test_directory_decoding_and_catalog(spark, tmp_path):
    (tmp_path / "一.txt").write_bytes("测试文本".encode())
    (tmp_path / "b.txt").write_bytes("测试文本，更多的字".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xff\xff\xff")
    (tmp_path / "d.pdf").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"")
    rows = files.read_directory(spark, str(tmp_path), "*")
    got = {r.title: r for r in files.decode_charset(rows).collect()}
    assert got["b"].text == "测试文本，更多的字" and got["b"].encoding == "gb18030" and got["c"].error and "d" not in got
    got = {r.title: r.reject_reason for r in files.catalog_files(rows, 15).collect()}
    assert got["b"] == "too large" and got["一"] is None and "e" not in got  # Spark lists no rows for empty files
    assert files.read_text_corpus(spark, str(tmp_path / "*.txt")).count() >= 3
    assert files.source("TXT") is files.read_text_corpus
    with pytest.raises(ValueError):
        files.source("mobi")


def test_html_chapters(spark):
    body = "<main><h1>Title <b>x</b></h1><p>" + "word " * 40 + "&amp; end</p><script>var a</script></main>"
    pages = spark.createDataFrame([(1, f"<html><title>t</title>{body}</html>"), (2, "<p>short</p>")], "page_id int, html string")
    (row,) = files.html_chapters(pages).collect()
    assert row.title == "Title x" and row.content.endswith("& end") and "var" not in row.content


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, version int")
    once = tables.upsert(old, new, ["k"], "version")
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, tables.upsert(once, new, ["k"], "version").collect())) == sorted(map(tuple, once.collect()))


def drain(spark, df, mode="append"):
    name = f"t{abs(hash(tempfile.mkdtemp())) % 10**9}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), rows


def test_streams_equal_batches(spark, tmp_path):
    live, rows = stream(spark, tmp_path)
    late = "400 days"  # files come in any order
    got = drain(spark, streams.counter_totals(live, ["event_type"], late=late), "complete")
    want = W.counter_totals(rows, ["event_type"])
    assert sorted((r.window_start, r.event_type, r.n) for r in got.collect()) == sorted((r.window_start, r.event_type, r.n) for r in want.collect())
    failed, within = F.col("event_type") == "error", F.col("event_type").isin("click", "error", "view")
    got = drain(spark, streams.failure_rates(live, failed, within, late=late), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.share_by_window(rows, failed, within).collect()))


def test_stream_cooldown(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, streams.alert_cooldown(live, "user_id", 21_600, late="400 days"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.alert_cooldown(rows, "user_id", seconds=21_600).collect()))


def test_stream_chapters_and_ingest(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.md5("text").alias("chapter_hash"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert drain(spark, streams.new_chapters(live)).count() == rows.distinct().count()
    seen = []
    q = streams.ingest(live, lambda df, n: seen.append(df.count()), tempfile.mkdtemp(prefix="spark-"))
    q.awaitTermination()
    assert sum(seen) == rows.count()
