"""Registered queries of this subpackage, one per operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import (filter_audit, fingerprints, jaccard_join, mixing, neighbours, packing, quality_net, repeats, target_sampling,
                          token_counts, token_files, toxicity, url_filters)
from loamgrid.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, from small-world graphs."""
    return neighbours.search_every(_table(spark, sf_dir, "embeddings"), step=20, k=20)


@_query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar to 90 %, and how many links each has."""
    return jaccard_join.jaccard_links(_table(spark, sf_dir, "documents"), size=3, similar=90, out_of=100)


@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048)


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, with its source's size and target."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.planned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL["op5_mixing"] = mixing.ORACLE_SQL


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a byte-level convolutional network."""
    return quality_net.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


@_query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls, by rules and by propagation over hosts."""
    return url_filters.judged(_table(spark, sf_dir, "pages"), least=url_filters.LEAST)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with the offending offsets."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed because a window of 20 words over them also starts earlier."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), length=20)


@_query
def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score towards the benchmark's words; a tenth of the longer ones is drawn and ranked."""
    return target_sampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_target_sampling"] = target_sampling.oracle_sql()


@_query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to Parquet files in their order and read back."""
    path = shared_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, by source, for every order and step."""
    return filter_audit.interaction_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE_SQL["op13_filter_audit"] = filter_audit.ORACLE_SQL
