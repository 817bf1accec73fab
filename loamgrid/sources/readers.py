"""Scans."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table; name the columns you need and Parquet reads no others."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None, merge_schema: bool = False) -> DataFrame:
    """The chunk table; name the columns you need and Parquet reads no others.  Merging schemas opens every file's footer."""
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    return df.select(*columns) if columns else df


def read_text_corpus(spark: SparkSession, root: str, suffixes: Sequence[str] = ("txt", "md")) -> DataFrame:
    """Text files under one folder per department: ``department, file_name, title, text``, one row per file."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
           .text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))
    parts = F.split(F.coalesce(F.try_url_decode("path"), F.col("path")), "/")
    name = F.element_at(parts, -1)
    return raw.select(F.element_at(parts, -2).alias("department"), name.alias("file_name"), tx.file_title(name).alias("title"),
                      F.col("value").alias("text"))


# Least characters of a page's markup and of its text.
MIN_HTML, MIN_TEXT = 200, 50


def admission_status(html: Column, text: Column, min_html: int | Column = MIN_HTML, min_text: int = MIN_TEXT) -> Column:
    """Reason a page is not taken in, null if it is."""
    return (F.when(F.length(F.coalesce(html, F.lit(""))) < min_html, "insufficient_html")
            .when(F.length(F.coalesce(text, F.lit(""))) < min_text, "insufficient_text"))


def admit_pages(pages: DataFrame, html: str = "html", text: str = "content", min_html: int | Column = MIN_HTML, min_text: int = MIN_TEXT) -> DataFrame:
    """Add ``status`` (accepted, rejected or failed) and ``reason``; what is not accepted is written to its own table.

    Where there is a column ``problem``, a page with one failed, and that is its reason."""
    problem = F.col("problem") if "problem" in pages.columns else F.lit(None).cast("string")
    return (pages.withColumn("reason", F.coalesce(problem, admission_status(F.col(html), F.col(text), min_html, min_text)))
            .withColumn("status", F.when(problem.isNotNull(), "failed").when(F.col("reason").isNull(), "accepted").otherwise("rejected")))


def rows_to_text(df: DataFrame, columns: Sequence[str], separator: str = " | ") -> DataFrame:
    """One line per table row: trimmed cells, empty ones dropped; rows without any cell are left out."""
    cells = F.filter(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), lambda c: c != "")
    return df.withColumn("line", F.array_join(cells, separator)).where(F.col("line") != "")


def sheet_heading(name: Column) -> Column:
    return F.concat(F.lit("\n## Sheet: "), name, F.lit("\n"))


def sheets_to_text(df: DataFrame, sheet: str, row_no: str, columns: Sequence[str]) -> DataFrame:
    """Text lines of all sheets in order: line 0 of a sheet is its heading."""
    lines = rows_to_text(df, columns).select(sheet, F.col(row_no).alias("line_no"), "line")
    heads = df.select(sheet).distinct().select(sheet, F.lit(-1).cast(df.schema[row_no].dataType).alias("line_no"),
                                               sheet_heading(F.col(sheet)).alias("line"))
    return heads.unionByName(lines)
