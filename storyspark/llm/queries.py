"""Registered queries of the training-data operators: thin wrappers that return digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtrack, bytebpe, chat, decontaminate, language, neighbours, repair, secrets, simhash, substrings, tokenfiles, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs), with_spans=False)
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_ids(files, with_ids=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(rows.unionByName(extra))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair(rows, with_turns=False).withColumnRenamed("conv", "conv_id")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_warc, op3_language, op4_substring_dedup, op5_decontaminate, op6_neighbours, op7_token_files, op8_byte_bpe, op9_chat, op10_secrets, op11_repair, op12_bpe, op13_trie)
    return {f.__name__: f for f in found}


#: SQL for the operators that it can express over whole tables.
ORACLES = {
    "op2_warc": """
        with p as (
            select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages
        ), w as (
            select body, count(*) as copies, max(page_id) as keeper from p where n >= 1000 group by body
        )
        select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
            case when w.copies > 1 and p.page_id <> w.keeper then 'revisit' else 'response' end as record_type,
            case when w.copies > 1 and p.page_id <> w.keeper then w.keeper end as refers_to
        from p left join w on p.body = w.body
    """,
    "op4_substring_dedup": """
        with w as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
        ), starts as (
            select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35
        ), windows as (
            select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from starts
        ), hits as (
            select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from windows) where n > 1
        ), covered as (
            select distinct doc_id, unnest(range(i, i + 35)) as pos from hits
        ), words as (
            select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w
        ), kept as (
            select words.doc_id, count(covered.pos) as removed, string_agg(word, ' ' order by words.pos) filter (covered.pos is null) as said
            from words left join covered on words.doc_id = covered.doc_id and words.pos = covered.pos group by 1
        )
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(said, '')) as kept_sha256
        from w left join kept on w.doc_id = kept.doc_id
    """,
    "op9_chat": """
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), e as (
            select *, length(replace(replace(replace(text, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')) as text_size,
                length(replace(replace(replace(replace(role, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>'), ': ', ':\\ ')) as role_size
            from t
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(length('### ') + role_size + length(': ') + text_size + length('</turn>') + 1) as bigint) as formatted_chars
        from e group by conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
