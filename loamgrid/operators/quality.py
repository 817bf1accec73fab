"""Consistency of the stores: joins between registries, entries, chunk copies and vectors."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_rollup(entries: DataFrame) -> DataFrame:
    return (entries.where(F.col("source_url").isNotNull() & (F.col("source_url") != "")).groupBy("source_url")
            .agg(F.count("*").alias("total_chunks"), F.count("vector_id").alias("vectors"), F.min("namespace").alias("namespace"),
                 F.min("category").alias("category"), F.avg(F.length("content")).alias("avg_chunk_size")))


def pages_with_chunks(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Live pages with the figures of their chunks; a page without any keeps its own count or zero."""
    agg = url_rollup(entries).select(F.col("source_url").alias("url"), F.col("total_chunks").alias("_n"), "vectors", "namespace",
                                     "category", "avg_chunk_size")
    return (pages.where(F.col("deleted_at").isNull()).join(agg, "url", "left")
            .select(*[pages[c] for c in pages.columns if c not in ("chunk_count", "deleted_at")],
                    F.coalesce("_n", "chunk_count", F.lit(0)).alias("total_chunks"), F.coalesce("namespace", F.lit("unknown")).alias("namespace"),
                    F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("vectors", F.lit(0)).alias("vectors"),
                    F.coalesce(F.round("avg_chunk_size"), F.lit(0.0)).alias("avg_chunk_size")))


def entries_of_pages(entries: DataFrame, copies: DataFrame) -> DataFrame:
    """Entries matched to their chunk copies by vector id."""
    return entries.join(copies.select(F.col("vector_id").alias("id"), "page_id", F.col("chunk_index").alias("copy_index")),
                        "id")


def failures_of_latest_run(failures: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Newest failures of the run that started last."""
    latest = runs.agg(F.max_by("id", F.struct("started_at", "id"))).scalar()
    return (failures.where(F.col("run_id") == latest).orderBy(F.desc("attempted_at"), "url").limit(limit))


def vectors_without_entry(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    known = entries.select(F.explode(F.array("id", "vector_id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    return vectors.select("id", "namespace").join(known, "id", "left_anti")


def entries_without_vector(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries that claim a vector which is not stored."""
    return (entries.where(F.col("vector_id").isNotNull()).select("id", "vector_id", F.coalesce("category", F.lit("unknown")).alias("category"))
            .join(vectors.select(F.col("id").alias("vector_id")).distinct(), "vector_id", "left_anti"))


def never_synced(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("synced_at").isNull() & F.col("vector_id").isNotNull())


def namespace_rollup(entries: DataFrame, crawled_types: Sequence[str] = ("webpage",)) -> DataFrame:
    has_url = F.col("source_url").isNotNull() & (F.col("source_url") != "")
    return (entries.where(F.col("namespace").isNotNull()).groupBy("namespace").agg(
        F.countDistinct(F.when(has_url, F.col("source_url"))).alias("total_urls"), F.count("*").alias("total_chunks"),
        F.avg(F.length("content")).alias("avg_chunk_size"), F.max("updated_at").alias("last_updated"),
        F.count_if(F.col("source_type") == "manual").alias("manual_count"),
        F.count_if(F.col("source_type").isin(*crawled_types)).alias("crawled_count"),
        F.count("vector_id").alias("synced_vectors"), F.count_if(F.col("vector_id").isNull()).alias("unsynced_count")))


def namespace_health(entries: DataFrame, vectors: DataFrame, tolerance: int = 5) -> DataFrame:
    """Both stores side by side, one-sided namespaces included."""
    stored = entries.where(F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count("*").alias("_chunks"))
    indexed = vectors.groupBy("namespace").agg(F.count("*").alias("_vectors"))
    gap = F.abs(F.col("_vectors") - F.col("_chunks"))
    health = (F.when(F.col("_chunks").isNull(), "orphaned").when(F.col("_vectors").isNull(), "unknown")
              .when(gap < tolerance, "healthy").otherwise("degraded"))
    return (stored.join(indexed, "namespace", "full_outer")
            .select("namespace", F.coalesce("_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("_vectors", F.lit(0)).alias("vectors"),
                    health.alias("sync_health")))


def health_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.count("*").alias("namespaces"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("chunks"),
                      F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"),
                      F.count_if(F.col("sync_health") == "healthy").alias("healthy"))


def vector_counts(vectors: DataFrame) -> DataFrame:
    """Vectors per namespace (the unnamed one as an empty string) with the total."""
    per = vectors.groupBy(F.coalesce("namespace", F.lit("")).alias("namespace")).agg(F.count("*").alias("vectors"))
    return per.withColumn("total", vectors.agg(F.count("*")).scalar())


def sync_gap(a: DataFrame, b: DataFrame, tolerance: int = 5) -> DataFrame:
    """Difference of two row counts, and whether it is tolerable."""
    return (a.agg(F.count("*").alias("left_rows")).select("left_rows", b.agg(F.count("*")).scalar().alias("right_rows"))
            .withColumn("gap", F.abs(F.col("left_rows") - F.col("right_rows")))
            .withColumn("in_sync", F.col("gap") <= tolerance))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"with_{c}") for c in columns])


def label_with(df: DataFrame, dimension: DataFrame, on: str, columns: Sequence[str], defaults: dict[str, Column | str] | None = None) -> DataFrame:
    """Look labels up in a small table; Spark broadcasts it if its measured size allows."""
    joined = df.join(dimension.select(on, *columns), on, "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def learned_corrections(messages: DataFrame, corrections: DataFrame, newest: int, opening: int) -> DataFrame:
    """Corrections whose question contains the first ``opening`` characters of a message: ``message_id, answers``.

    Only the newest ``newest`` corrections exist for this rule, so they travel with each message as one array."""
    memory = (corrections.orderBy(F.desc("created_at"), F.desc("correction_id")).limit(newest)
              .agg(F.sort_array(F.collect_list(F.struct("created_at", "correction_id", F.lower("question").alias("q"), "answer")),
                                asc=False)).scalar())
    key = F.left(F.lower("text"), F.lit(opening))
    return (messages.withColumn("_m", memory).withColumn("_key", key)
            .withColumn("_hits", F.filter("_m", lambda c: F.contains(c["q"], F.col("_key"))))
            .where(F.size("_hits") > 0)
            .select("message_id", F.size("_hits").alias("n_answers"), F.array_join(F.col("_hits.answer"), " | ").alias("answers")))
