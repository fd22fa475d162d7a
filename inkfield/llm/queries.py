"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkfield.llm.ann import nearest
from inkfield.llm.chat import TURNS, chat_digest
from inkfield.llm.covertree import near_vectors
from inkfield.llm.langid import language_digest
from inkfield.llm.linededup import dedup_digest, dedup_lines
from inkfield.llm.minhash import near_duplicates
from inkfield.llm.mixing import mix
from inkfield.llm.oracles import ORACLES
from inkfield.llm.packing import pack, pack_digest
from inkfield.llm.tokencount import count_tokens
from inkfield.llm.tokenfile import token_file_digest

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(dedup_lines(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], TURNS)
    return chat_digest(table(spark, sf_dir, "conversations"), extra)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


OPERATORS = (
    op1_packing,
    op2_pfair_mixing,
    op3_cover_tree,
    op4_minhash,
    op5_language_id,
    op6_nearest,
    op7_token_counts,
    op8_line_dedup,
    op9_chat_format,
    op10_token_files,
)
QUERIES = {f.__name__: f for f in OPERATORS}
__all__ = ["ORACLES", "QUERIES"]
