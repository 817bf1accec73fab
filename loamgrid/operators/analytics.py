"""Dashboard figures.  Times are relative to ``as_of``, never to the clock."""
from __future__ import annotations

from datetime import datetime
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.messages import percent


def since(as_of: datetime, days: int) -> Column:
    return F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")


def counts_by(df: DataFrame, column: str, default: str | None = "unknown") -> DataFrame:
    key = F.col(column) if default is None else F.coalesce(F.col(column), F.lit(default))
    return df.groupBy(key.alias(column)).agg(F.count("*").alias("n"))


def counts_by_each(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by several keys and in total, in one pass: ``dimension, value, n``."""
    marks = [F.grouping(c) == 0 for c in columns]
    sets = df.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(
        F.count("*").alias("n"), *[m.alias(f"_is_{c}") for m, c in zip(marks, columns)])
    dimension, value = F.lit("total"), F.lit("")
    for c in columns:
        dimension = F.when(F.col(f"_is_{c}"), F.lit(c)).otherwise(dimension)
        value = F.when(F.col(f"_is_{c}"), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def headline(conversations: DataFrame, as_of: datetime, created: str = "created_at", session: str = "session_id") -> DataFrame:
    t = F.col(created)
    return conversations.agg(F.count_if(t >= since(as_of, 1)).alias("today"), F.count_if(t >= since(as_of, 7)).alias("this_week"),
                             F.count_if(t >= since(as_of, 30)).alias("this_month"), F.countDistinct(session).alias("total_users"),
                             F.count("*").alias("total_messages"))


def latency(log: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    recent = log.where(F.col("created_at") > since(as_of, days))
    return recent.agg(F.coalesce(F.avg("retrieval_ms"), F.lit(0.0)).alias("avg_retrieval"),
                      F.coalesce(F.avg("total_ms"), F.lit(0.0)).alias("avg_total"),
                      F.coalesce(F.avg(F.when(F.col("cache_hit"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("cache_hit_rate"))


def unanswered_rate(conversations: DataFrame, unanswered: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    recent = F.col("created_at") > since(as_of, days)
    missing = unanswered.where(recent).agg(F.count("*")).scalar()
    return (conversations.where(recent).agg(F.count("*").alias("total")).withColumn("no_data_count", missing)
            .withColumn("no_data_percent", percent(F.col("no_data_count"), F.col("total"), 1)))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Share of the total and of the largest, for a table of counts."""
    total, largest = counts.agg(F.sum(n)).scalar(), counts.agg(F.max(n)).scalar()
    return counts.withColumns({"share_of_total": F.col(n) / total, "share_of_max": F.col(n) / largest})


def status_summary(df: DataFrame, status: str, statuses: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses],
                  *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def category_breakdown(entries: DataFrame) -> DataFrame:
    return entries.groupBy("category").agg(F.count("id").alias("entry_count"),
                                           F.coalesce(F.sum("total_chunks"), F.count("id")).alias("chunk_count"),
                                           F.max("updated_at").alias("last_updated"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def distribution(df: DataFrame, key: str, value: str = "namespace") -> DataFrame:
    """Counts of ``value`` per key as a map; the map has one entry per value, not per row."""
    return (df.groupBy(key, value).agg(F.count("*").alias("_n")).groupBy(key)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias("distribution")))


def ingest_summary(chunks: DataFrame, stored_hashes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: pages, kept chunks, tokens of all chunks, duplicates left out, namespaces as a map."""
    known = stored_hashes.select("content_hash").distinct().withColumn("_known", F.lit(True))
    joined = chunks.join(known, "content_hash", "left")
    figures = joined.groupBy(doc).agg(F.countDistinct("page_number").alias("total_pages"),
                                      F.count_if(F.col("_known").isNull()).alias("total_chunks"),
                                      F.sum(tx.token_estimate(F.col("content"))).alias("total_tokens"),
                                      F.count_if(F.col("_known").isNotNull()).alias("duplicate_chunks_removed"))
    return figures.join(distribution(chunks, doc).withColumnRenamed("distribution", "namespace_distribution"), doc)


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of each run from its page outcomes (run_id, status, chunks, at)."""
    s = F.col("status")
    return outcomes.groupBy("run_id").agg(
        F.count_if(s == "success").alias("pages_crawled"), F.count_if(s == "skipped").alias("pages_skipped"),
        F.count_if(s == "failed").alias("pages_failed"), F.coalesce(F.sum(F.when(s == "success", F.col("chunks"))), F.lit(0)).alias("chunks_created"),
        (F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))).alias("duration_seconds"))


def latest_per_url(entries: DataFrame, columns: Sequence[str] = ("title", "page_type")) -> DataFrame:
    """Newest row of each source, by partial aggregation."""
    return (entries.where(F.col("source_url").isNotNull() & (F.col("source_url") != "")).groupBy("source_url")
            .agg(F.max_by(F.struct("updated_at", "id", *columns), F.struct("updated_at", "id")).alias("_r"))
            .select("source_url", "_r.*"))


def recent_updates(entries: DataFrame, limit: int = 10) -> DataFrame:
    return latest_per_url(entries).orderBy(F.desc("updated_at"), "source_url").limit(limit)


def most_asked(conversations: DataFrame, as_of: datetime, days: int = 30, limit: int = 10, message: str = "user_message") -> DataFrame:
    return (conversations.where(F.col("created_at") >= since(as_of, days)).groupBy(F.col(message).alias("query"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit))


def newest_rows(df: DataFrame, by: str, tiebreak: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(by), tiebreak).limit(limit)


def daily_volume(df: DataFrame, as_of: datetime, days: int = 7, created: str = "created_at") -> DataFrame:
    return (df.where(F.col(created) >= since(as_of, days)).groupBy(F.date_trunc("day", F.col(created)).alias("day"))
            .agg(F.count("*").alias("n")))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def known_namespaces(entries: DataFrame, static: Sequence[str]) -> DataFrame:
    """The fixed namespaces and those observed."""
    fixed = entries.sparkSession.createDataFrame([(n,) for n in static], "namespace string")
    return union_distinct(entries.where(F.col("namespace").isNotNull()).select("namespace"), fixed)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, in one job."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_counts(spark, pattern: str = "*") -> DataFrame:
    return table_counts({t.name: spark.table(t.name) for t in spark.catalog.listTables(pattern=pattern)})
