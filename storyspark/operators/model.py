"""Model calls (P1-P6): prompts, tolerant parsing, fan-out of a caller's function, run summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import FEATURES


def build_prompt(text: Column, before: str, after: str, limit: int = 8000) -> Column:
    """A template around the first ``limit`` characters, which is what a model takes."""
    return F.concat(F.lit(before), F.substr(text, F.lit(1), F.lit(limit)), F.lit(after))


def parse_response(response: Column, schema: str = FEATURES) -> Column:
    """The JSON of a response: plain, fenced, or between its outermost braces; else null."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.when(F.json_object_keys(t).isNotNull(), t)
    return F.from_json(F.coalesce(valid(F.trim(response)), valid(F.trim(fenced)), valid(inner)), schema)


def model_features(responses: DataFrame, response: str = "response", schema: str = FEATURES) -> DataFrame:
    """Parsed features beside the other columns; confidence 0.5 where none is told; ``error`` if unreadable."""
    rows = responses.withColumn("features", parse_response(F.col(response), schema))
    sure = F.coalesce(F.col("features.confidence_score"), F.lit(0.5))
    return rows.withColumn("confidence_score", F.when(F.col("features").isNotNull(), sure)).withColumn("error", F.when(F.col("features").isNull(), "unreadable response"))


def apply_model(rows: DataFrame, call: Callable[[str], str], key: str = "novel_id", prompt: str = "prompt", concurrency: int = 5, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """``(key, response, error, attempts)``: the caller's function on each prompt.

    Rows stay in their partitions; each task has up to ``concurrency`` calls under way, which wait rather
    than compute. A call that raises is tried again, with pauses that double; what still fails is told as
    an error, and the run goes on.
    """
    kind = dict(rows.dtypes)[key]

    def one(text: str | None) -> tuple[str | None, str | None, int]:
        said = error = None
        for n in range(1, attempts + 1):
            try:
                said, error = call(text), None
                break
            except Exception as e:  # the caller's function may raise anything; it is told in the row
                error = f"{type(e).__name__}: {e}"
                if n < attempts:
                    time.sleep(pause * 2 ** (n - 1))
        return said, error, n

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                out = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32())))], [key, "response", "error", "attempts"])

    return rows.select(key, prompt).mapInArrow(told, f"`{key}` {kind}, response string, error string, attempts int")


def batch_run_summary(results: DataFrame) -> DataFrame:
    """Numbers of results, successes and errors, and the share that succeeded."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg(F.col("error").isNull().cast("int")).alias("share"))
