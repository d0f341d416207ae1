"""The Python data source in batch and as a stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from storyspark.sources import corpus
from storyspark.sources.scratch import scratch
from storyspark.streaming import streams


def put(folder, name, data, time):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    os.utime(path, (time, time))


def test_batch(spark, tmp_path):
    for k in range(20):
        put(tmp_path, f"sub{k % 3}/book{k}.txt", f"text {k}" * 10, 1000 + k)
    put(tmp_path, "big5.txt", "昨天晚上我和朋友一起去看了一場電影，電影講的是一個年輕人離開家鄉的故事。".encode("big5"), 2000)
    put(tmp_path, "_hidden/x.txt", "no", 1)
    put(tmp_path, "other.md", "no", 1)
    corpus.register(spark)
    rows = spark.read.format("corpus").option("path", f"file://{tmp_path}").option("group_bytes", 300).load()
    assert rows.rdd.getNumPartitions() > 4
    got = {r.title: r.text for r in rows.collect()}
    assert got == {f"book{k}": f"text {k}" * 10 for k in range(20)} | {"big5": "昨天晚上我和朋友一起去看了一場電影，電影講的是一個年輕人離開家鄉的故事。"}
    assert spark.read.format("corpus").option("path", str(tmp_path / "none")).load().count() == 0
    put(tmp_path, "b.jsonl", '{"title": "t", "text": "x"}\nbroken\n[1]\n{"text": "y"}\n', 3000)
    rows = spark.read.format("corpus_jsonl").option("path", str(tmp_path)).option("suffix", ".jsonl").load()
    assert sorted((r.title or "", r.text) for r in rows.collect()) == [("", "y"), ("t", "x")]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    corpus.register(spark)
    state, out = scratch(spark, "state"), scratch(spark, "out")

    def run():
        rows = spark.readStream.format("corpus").option("path", str(tmp_path)).load()
        streams.ingest(rows, lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out), state).awaitTermination()
        return sorted(r.title for r in spark.read.parquet(out).collect())

    put(tmp_path, "a.txt", "1", 1000)
    put(tmp_path, "b.txt", "2", 1000)
    assert run() == ["a", "b"]
    put(tmp_path, "c.txt", "3", 2000)
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_groups():
    files = [corpus.Found(k, f"f{k}", size) for k, size in enumerate([5, 5, 20, 1, 1, 9])]
    assert [g.paths for g in corpus.groups(files, 10)] == [("f0", "f1"), ("f2",), ("f3", "f4"), ("f5",)]
