"""Training-data pipeline over the table ``documents``: five stages, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of each group of near duplicates (five-word shingles, similarity 0.8) the one with the least doc_id stays; words that a repeated
window of 20 words covers go, and so do documents left without a word; sources are brought to their target weights, documents then occurring up to twice;
the rest is packed into sequences of 2048 tokens.

A stage takes ``docs`` with the columns ``doc_id, text, source`` and any others, and returns them all; the last returns pieces of sequences.  Null and empty texts pass
on as they are; a null source is a source; an empty table gives an empty result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import jaccard_join, mixing, packing, quality_net, repeats
from loamgrid.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net, odds = quality_net.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_net.scored(docs, net, odds, keep=True)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    kept = repeats.without_repeats(docs, texts=True).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def at_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", at_target_weights),
    ("packing", packed),
]

ORACLE_SQL = None                    # SQL can express neither the network nor the tokenizer; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
