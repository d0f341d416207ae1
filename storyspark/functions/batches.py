"""Bounds of what a Python worker holds of a column of texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of texts; a single row may have more.
MOST_BYTES = 1 << 20


def small_batches(spark: SparkSession, most: int = MOST_BYTES) -> None:
    """Bound the bytes of an Arrow batch, so that a worker's memory follows neither the rows of a split nor their length.

    Spark reads the setting when a result is run, so it is only ever lowered: the smallest bound holds for all.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= most:
        spark.conf.set(key, f"{most}b")
