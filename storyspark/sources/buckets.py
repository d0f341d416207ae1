"""Tables in folders by a hash of their key, so that a write touches only the parts that change.

An upsert or delete reads and replaces the buckets of its keys; the others' files stay as they are. What is to
be published is written beside the table first. A batch with a number is entered in a ledger when it is
published: one that runs again changes nothing, and one that was cut short while it was published is
published again from what was written, never worked out from a half-replaced table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .tables import one_each

BUCKET = "bucket"


class BucketTable:
    """A table under ``path`` with ``keys``; ``schema`` is that of its rows, without the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema
        self.full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self) -> DataFrame:
        fs, at = self._fs(self.path)
        fs.mkdirs(at)
        return self.spark.read.schema(self.full).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().drop(BUCKET)

    def done(self, batch: int) -> bool:
        """Whether a batch is in the ledger."""
        return self._exists(f"{self.path}/_ledger/batch={batch}/_SUCCESS")

    def upsert(self, updates: DataFrame, version: str | None = None, batch: int | None = None) -> None:
        """Replace or insert by key. Of several updates of a key one stands, see ``tables.one_each``."""
        self._change(one_each(updates.select(*self.schema.names), self.keys, version), self.keys, batch)

    def replace(self, updates: DataFrame, group: list[str], batch: int | None = None) -> None:
        """All rows of each ``group`` that the updates have are replaced by the updates' rows.

        The group's columns must be those that the buckets are made of.
        """
        if group != self.keys:
            raise ValueError("a group must be the table's keys")
        self._change(updates.select(*self.schema.names), group, batch)

    def delete(self, gone: DataFrame, batch: int | None = None) -> None:
        """The rows with these keys go."""
        keys = gone.select(*self.keys).distinct()
        self._change(self.spark.createDataFrame([], self.schema), self.keys, batch, keys)

    def _change(self, rows: DataFrame, keys: list[str], batch: int | None, gone: DataFrame | None = None) -> None:
        if batch is not None and self.done(batch):
            return
        stage = f"{self.path}/_stage/{uuid.uuid4().hex if batch is None else f'batch={batch}'}"
        if not self._exists(f"{stage}/touched/_SUCCESS"):
            rows.withColumn(BUCKET, self._bucket()).select(*self.full.names).write.mode("overwrite").parquet(f"{stage}/new")  # worked out once, used twice
            new = self.spark.read.schema(self.full).parquet(f"{stage}/new")
            keyed = (new if gone is None else gone).select(*keys).distinct().withColumn(BUCKET, self._bucket())
            keyed.write.mode("overwrite").parquet(f"{stage}/keys")
            known = self.spark.read.schema(keyed.schema).parquet(f"{stage}/keys")
            touched = [r[0] for r in known.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
            stay = self._files().where(F.col(BUCKET).isin(touched)).join(known.drop(BUCKET).hint("merge"), keys, "left_anti")
            stay.select(*self.full.names).unionByName(new).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{stage}/rows")
            self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{stage}/touched")
        self._publish(stage)
        if batch is not None:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/_ledger/batch={batch}")
        fs, at = self._fs(stage)
        fs.delete(at, True)

    def _publish(self, stage: str) -> None:
        """Put the written buckets in the place of the table's; a bucket that is empty now goes."""
        touched = [r[0] for r in self.spark.read.schema("bucket int").parquet(f"{stage}/touched").collect()]
        full = {b for b in touched if self._exists(f"{stage}/rows/{BUCKET}={b}")}
        if full:
            rows = self.spark.read.schema(self.full).parquet(f"{stage}/rows")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)  # its files are by bucket already
        for b in set(touched) - full:
            fs, at = self._fs(f"{self.path}/{BUCKET}={b}")
            fs.delete(at, True)


def sink(table: BucketTable, made: Callable[[DataFrame], DataFrame], whole: bool = False, version: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: the rows made of a micro-batch, upserted once (or, ``whole``, in place of their keys' rows)."""

    def put(batch: DataFrame, n: int) -> None:
        rows = made(batch)
        table.replace(rows, table.keys, n) if whole else table.upsert(rows, version, n)

    return put
