"""Corpus pipeline over ``documents``: drop toxic documents, repeated lines and near
duplicates, mix the sources, encode.

Each stage takes the documents its predecessor kept and returns documents (the last
one: their ids); ``run`` writes every stage's result to the shared folder as Parquet
and reads it back, so a lost executor costs at most one stage's recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm import op2_lines, op7_near_dups, op8_bpe, op9_toxicity, op10_mixing
from halflife.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject (score under 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = op9_toxicity.learn(docs, op9_toxicity.teachable(labels))
    scored = op9_toxicity.score_toxicity(docs, grammar, out="__score")
    return scored.where("__score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, up to one word."""
    return op2_lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return op7_near_dups.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op10_mixing.apply_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (packed little-endian unsigned 32-bit), and whether they decode to the text."""
    both = op8_bpe.decode(op8_bpe.encode(docs))
    return both.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

# Toxicity scores and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
