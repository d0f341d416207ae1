"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

1. language ID: documents without a clear language go;
2. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the
   document with the smallest id stays;
3. benchmark decontamination: documents that hold parts of benchmark items go;
4. secret scan: secret spans are replaced in the texts, no document goes;
5. byte-level BPE: the remaining texts as ids, with digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storyspark.llm import bytebpe, decontaminate, language, nearcopies, secrets
from storyspark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.encode_texts(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot express the trained models of the first and fourth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
