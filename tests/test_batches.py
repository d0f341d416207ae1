"""Arrow batches of texts are bounded by bytes: what a Python worker holds does not follow the rows of a split."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyspark.functions import batches
from storyspark.operators import keywords
from storyspark.sources import files

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(parts):
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], ["size"])


CALLS = {
    "charsets": lambda rows: files.decode_charset(rows.select(F.encode("text", "UTF-16LE").alias("content"))),
    "pages": lambda rows: files.html_chapters(rows.select(F.lit(1).alias("page_id"), F.col("text").alias("html"))),
    "keywords": lambda rows: keywords.keyword_hits(rows.select(F.lit(1).alias("novel_id"), "text"), rows.sparkSession.createDataFrame([("ab",)], "keyword string")),
}


@pytest.mark.parametrize("name", CALLS)
def test_batches_of_texts_are_small(spark, name):
    rows = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("ab "), 7000).alias("text"))
    spark.conf.unset(KEY)
    CALLS[name](rows)
    sizes = [r.size for r in rows.mapInArrow(_largest, "size long").collect()]
    assert sum(sizes) > 12_000_000 and max(sizes) < 2 * batches.MOST_BYTES


def test_a_lower_bound_stays(spark):
    spark.conf.set(KEY, "1k")
    batches.small_batches(spark)
    assert spark.conf.get(KEY) == "1k"
    spark.conf.unset(KEY)
