"""Listings, predicates and row patches."""
from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def any_column_contains(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive substring test on any of the columns; blanks and wildcards are taken literally."""
    low = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in columns])


def matching(df: DataFrame, search: str | None = None, columns: Sequence[str] = (),
             filters: Mapping[str, object] | None = None) -> DataFrame:
    """Optional substring search and optional equality filters, as one predicate."""
    for name, value in (filters or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.where(any_column_contains(columns, search)) if search else df


def list_entries(df: DataFrame, search: str | None = None, columns: Sequence[str] = ("title", "content"),
                 filters: Mapping[str, object] | None = None, limit: int = 50, offset: int = 0,
                 newest_by: str = "updated_at", tiebreak: str = "id") -> DataFrame:
    """One page of matching rows, newest first, nulls last."""
    rows = matching(df, search, columns, filters).orderBy(F.col(newest_by).desc_nulls_last(), F.col(tiebreak))
    return (rows.offset(offset) if offset else rows).limit(limit)


def count_entries(df: DataFrame, search: str | None = None, columns: Sequence[str] = ("title", "content"),
                  filters: Mapping[str, object] | None = None) -> DataFrame:
    return matching(df, search, columns, filters).agg(F.count("*").alias("total"))


def with_sizes(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumns({"char_count": F.length(content), "approx_token_count": tx.approx_tokens(F.col(content))})


def doc_tokens(df: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    return df.groupBy(doc).agg(F.sum(tx.token_estimate(F.col(content))).alias("total_tokens"))


def within_days(column: Column, as_of: datetime, days: int) -> Column:
    return column >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")


def chunks_of(df: DataFrame, url: str, limit: int | None = None) -> DataFrame:
    """Chunks of one address in order; all of them unless a limit is given."""
    rows = with_sizes(df.where(F.col("source_url") == url)).orderBy("chunk_index", "id")
    return rows if limit is None else rows.limit(limit)


def semi(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose key is listed; the list may be of any size."""
    return df.join(ids.select(on), on, "left_semi")


def keyword_audit(df: DataFrame, columns: Sequence[str], words: Sequence[str], content: str = "content",
                  preview_length: int = 100) -> DataFrame:
    """Rows in which any column holds any of the words, with the words found and a preview."""
    found = F.filter(F.array(*[F.when(any_column_contains(columns, w), F.lit(w)) for w in words]),
                     lambda w: w.isNotNull())
    return (df.where(reduce(lambda a, b: a | b, [any_column_contains(columns, w) for w in words]))
            .withColumn("words_found", F.array_join(found, ","))
            .withColumn("preview", tx.preview(F.col(content), preview_length)))


def audit_by_category(df: DataFrame, columns: Sequence[str], words: Sequence[str],
                      category: str = "category") -> DataFrame:
    return (keyword_audit(df, columns, words).groupBy(category).agg(F.count("*").alias("n")))


def category_like(df: DataFrame, pattern: str, column: str = "category") -> DataFrame:
    return df.where(F.col(column).rlike("(?i)" + pattern))


def urls_matching(df: DataFrame, keyword: str, source_types: Sequence[str] = ("webpage", "document"),
                  limit: int = 100) -> DataFrame:
    """Distinct web addresses of stored entries that mention the keyword in address, title or category."""
    return (df.where(F.col("source_type").isin(*source_types) & F.col("source_url").startswith("http"))
            .where(any_column_contains(("source_url", "title", "category"), keyword))
            .select("source_url").distinct().orderBy("source_url").limit(limit))


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the others with the reason in column ``problem``."""
    marked = df.withColumn("problem", problem)
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull())


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` of each key, by partial aggregation (no window over the key)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row of each key by ``order``, so that a join on the key neither multiplies rows nor depends on chance."""
    return latest_per_key(df, keys, [c for c in order if c not in keys] or list(keys)) if set(df.columns) - set(keys) else df.distinct()


def resolve_questions(questions: DataFrame, updates: DataFrame, as_of: datetime) -> DataFrame:
    """Set the resolution flag and entry of the listed questions; only a resolved one gets a time.

    Of several updates of one question the greatest (resolved over not, then by entry) counts."""
    new = one_per_key(updates, ["id"], ["resolved", "resolved_entry_id"]).select("id", F.col("resolved").alias("_resolved"), F.col("resolved_entry_id").alias("_entry"))
    listed = F.col("_resolved").isNotNull()
    return (questions.join(new, "id", "left")
            .withColumn("resolved", F.coalesce("_resolved", "resolved"))
            .withColumn("resolved_entry_id", F.when(listed, F.col("_entry")).otherwise(F.col("resolved_entry_id")))
            .withColumn("resolved_at", F.when(F.col("_resolved"), F.lit(as_of))
                        .when(listed, F.lit(None).cast("timestamp")).otherwise(F.col("resolved_at")))
            .drop("_resolved", "_entry"))


def patch(df: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "id",
          order: Sequence[str] = ()) -> DataFrame:
    """Overwrite the listed columns where the update has a value; keep the old value where it is null.

    Of several updates of one key the last by ``order`` (then by the columns themselves) counts."""
    new = one_per_key(updates, [key], [*order, *columns]).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(
        *[f"_new_{c}" for c in columns])


def apply_feedback(conversations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Latest valid feedback per conversation and session; both must match."""
    valid = feedback.where(F.col("feedback").isin("thumbs_up", "thumbs_down") & F.col("conversation_id").isNotNull())
    last = valid.groupBy("conversation_id", "session_id").agg(
        F.max_by("feedback", F.struct("created_at", "feedback")).alias("_feedback"))
    joined = conversations.join(last, (F.col("id") == F.col("conversation_id"))
                                & (conversations["session_id"] == last["session_id"]), "left")
    return joined.select(*[conversations[c] for c in conversations.columns if c != "feedback"],
                         F.coalesce(F.col("_feedback"), conversations["feedback"]).alias("feedback"))
