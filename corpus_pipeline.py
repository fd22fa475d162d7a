"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents. Nulls may stand in any column,
rows may be repeated, other columns may clash with these in name and are left out; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import Written, pick
from inkfield.llm.langid import identify, learn
from inkfield.llm.linededup import dedup_lines
from inkfield.llm.minhash import near_duplicates
from inkfield.llm.mixing import mixed_documents
from inkfield.llm.packing import pack, pack_digest

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go, null and empty texts among them."""
    told = identify(docs, learn(docs), keep=COLUMNS)
    return told.where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; a document goes if dedup leaves nothing of it but space.

    Null and empty texts stay as they are; rows with one id and text come out alike; n_chars is counted again.
    """
    told = dedup_lines(docs, keep=("lang", "source"))
    told = told.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return told.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id stay if their whole group has none; rows that repeat an id and a text are one document.
    """
    found = near_duplicates(docs, words=WORDS, percent=PERCENT)
    kept = found.where("kept or (doc_id is null and component_id is null)").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    rows = pick(docs, *COLUMNS).withColumn("h", F.xxhash64("text"))
    return rows.join(kept, rows.doc_id.eqNullSafe(kept.k_id) & (rows.h == kept.k_hash), "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the mixture of sources; a null source is a source of its own."""
    return mixed_documents(pick(docs, *COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, numbered along the mixture.

    Spark deals files out by size when the mixture is read again, so the order is made anew
    here: tasks, and in them windows of the packer, follow the mixture; inside a window lengths decide.
    """
    return pack_digest(pack(mixed_documents(pick(docs, *COLUMNS)), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixture", mixture), ("packing", packing)]
#: Compression, edit distance on all lines, scheduling and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's table goes when the next one's is written, the last one's input at the driver's end."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = Written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            last.drop()
        docs, last = now.read(), now
    return STAGES[-1][1](spark, docs, sf_dir)
