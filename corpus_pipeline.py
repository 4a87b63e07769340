"""The corpus pipeline: quality rules, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aeroweave.llm import jaccard_join, packing, quality, substring
from aeroweave.llm.shared import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the rules learned from ``labels`` reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % common five-word shingles, the one with the smallest id."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that a document with a smaller id has; ``n_chars`` follows the text."""
    cut = substring.drop_repeats(docs, window=13, period=7)
    if "n_chars" not in docs.columns:
        return cut
    return cut.selectExpr(*("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their window of 2048 tokens and their place in it."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


#: Each takes ``(spark, docs, sf_dir)``; its result is written and read again as the next one's ``docs``.
STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_copy),
    ("substring_dedup", drop_repeats),
    ("packing", pack_windows),
]

#: Learned rules, links and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
