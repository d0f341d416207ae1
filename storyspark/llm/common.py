"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers each that may be broadcast, once they have been counted.
MAX_BROADCAST_ROWS = 100_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="storyspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, as a path with its scheme.

    Only a local session may do without that setting, as tests do; on a cluster tasks would write to their
    own disks. A path without scheme is in the cluster's default file system, as it is for Spark.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        return _own_dir()
    store = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if ":" not in named.split("/")[0] and not store.startswith("file:"):
        named = store.rstrip("/") + named
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is written yet."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def discard(spark: SparkSession) -> None:
    """Remove what the operators have written so far; to be called when their results are stored or no longer wanted."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage (a lost executor costs at most this table's own tasks), fixes what a
    Python stage produced, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_shuffles(spark: SparkSession):
    """For what is run inside, a job's shuffle files go as soon as it ends, not when the driver collects its plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays small in memory.

    Spark reads the setting when a result is run, so it is only ever lowered: the smallest bound holds for all.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts have about ``most_bytes`` at most; a single row may have more."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at, before = end, int(ends[end - 1])


def gathered(batches: Iterator[pa.RecordBatch], rows: int, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches joined until they have ``rows`` rows or ``most_bytes`` of texts, for work that goes through texts side by side."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
        if sum(b.num_rows for b in held) >= rows or size >= most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Links that a node of a tree has to nodes after it.
FAN = 16


def tree_links(nodes: list[int]) -> list[tuple[int, int]]:
    """Links that join nodes as a shallow tree, the smallest at its root; no node gets over ``FAN`` + 1."""
    rows = sorted(nodes)
    return [(x, rows[(i - 1) // FAN]) for i, x in enumerate(rows) if i]
