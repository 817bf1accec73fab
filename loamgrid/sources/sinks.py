"""Writers.  Every writer is a plain Spark write; what is written is planned by the operators."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.listing import latest_per_key
from ..session import cut_lineage


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace a table (a new folder each time is the safe form when the plan reads the old one)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_vectors(df: DataFrame, path: str, buckets: int = 64, order: Sequence[str] = (), rows_per_file: int = 2_000_000) -> None:
    """Upsert of vectors by namespace and id; the table is partitioned by namespace and by ``bucket``, a hash of the id.

    Of several incoming rows of one id the last by ``order`` (then by the vector) counts.  Only the partitions that an incoming id falls into are read and
    written again; stored rows with other ids stay.  A table keeps the number of buckets it was made with."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in ("id", "namespace")]
    new = latest_per_key(df, ["id", "namespace"], [*order, *[c for c in rest if c not in order]])
    new = cut_lineage(new.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")))
    rows = new
    if is_table(spark, path):
        touched = new.select("namespace", "bucket").distinct()
        stored = spark.read.schema(new.schema).parquet(path).join(touched, ["namespace", "bucket"], "left_semi")
        rows = cut_lineage(stored.join(new.select("id", "namespace", "bucket"), ["id", "namespace", "bucket"], "left_anti").unionByName(new))
    (rows.repartition("namespace", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("namespace", "bucket").parquet(path))


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether a table lies at the path, on whatever storage the session reads."""
    try:
        spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def write_postings(df: DataFrame, table: str, buckets: int = 512) -> None:
    """Inverted table bucketed by term: question terms then join without moving it."""
    df.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def hit_rows(results: DataFrame, log_id: str = "log_id", hits: str = "hits") -> DataFrame:
    """One row per hit of a logged query: ``log_id, hit_no, chunk_id, score, source_url``."""
    return (results.select(log_id, F.posexplode(hits).alias("hit_no", "_h"))
            .select(log_id, "hit_no", F.col("_h.id").alias("chunk_id"), F.coalesce("_h.score", F.lit(0.0)).alias("score"),
                    F.coalesce("_h.source_url", F.lit("")).alias("source_url")))


def with_search_fields(df: DataFrame, as_of: datetime) -> DataFrame:
    """Search text by weight class (A title, B category and page type, C content) and the time of the write."""
    def field(*names: str):
        return F.array_join(F.flatten(F.array(*[tx.words(F.coalesce(F.col(n), F.lit(""))) for n in names])), " ")
    return df.withColumns({"search_a": field("title"), "search_b": field("category", "page_type"), "search_c": field("content"),
                           "updated_at": F.lit(as_of)})
