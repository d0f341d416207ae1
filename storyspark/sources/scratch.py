"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a local session may do without that setting; on a cluster tasks would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-")
    _MADE.append(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def discard(spark: SparkSession) -> None:
    """Remove what was written to ``scratch`` paths so far; to be called when the results are stored or no longer wanted."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The table, written to a ``scratch`` path and read back: it has true sizes, and a lost executor costs only its own tasks."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
