"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe, chat_format, exact_dedup, ngram_join, packing, quality, secret_scan, token_counts, token_files, toxicity
from wayfold.llm.common import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.neighbours_as_pairs(read_table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_exact_dedup, op3_packing, op4_bpe, op5_token_counts, op6_secrets, op7_toxicity, op8_chat_format, op9_token_files, op10_quality)}

_PLAIN = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_PLAIN}) AS text_sha256, length(coalesce(text, '')) AS points FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op8_chat_format": chat_format.PAIRS_SQL,
}
