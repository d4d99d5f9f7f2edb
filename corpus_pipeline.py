"""The corpus pipeline: five stages, each on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last
returns token ids. ``run`` writes each stage to the shared folder and reads it again.
Stages keep empty and null texts; they decide only on what a text says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import op04_bpe, op06_minhash, op07_substring, op08_decontaminate, op10_toxicity
from newsloom.llm.common import read, shared_path, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is learned from labelled documents of the input."""
    docs = docs.select(*COLUMNS)
    model = op10_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return op10_toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates."""
    small_batches(spark)
    return op06_minhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a smaller doc_id holds; other texts as they were."""
    docs = docs.select(*COLUMNS)
    small_batches(spark)
    rest = op07_substring.removal(docs, COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return rest.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return op08_decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each whole text."""
    small_batches(spark)
    coded = op04_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: Compression, hashing and alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
