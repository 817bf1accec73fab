"""Reranking of candidates with seven features, and with scores from outside."""
from __future__ import annotations

from datetime import datetime
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import TIME_QUERY_PATTERN, TYPE_BOOSTS, TypeBoost

# Feature weights.
WEIGHTS = {"retrieval": 0.25, "content": 0.20, "title": 0.20, "phrase": 0.15, "keywords": 0.10, "type": 0.07, "recency": 0.03}
TITLE_FACTOR, KEYWORD_FACTOR = 1.8, 0.3


def overlap(query_tokens: Column, target_tokens: Column) -> Column:
    """Share of the question's tokens that the target has; zero for a question without tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query_tokens, target_tokens)).cast("double"),
                                   F.size(query_tokens).cast("double")), F.lit(0.0))


def phrase_bonus(query: Column, text: Column) -> Column:
    q, low = F.trim(F.lower(query)), F.lower(text)
    opening = F.array_join(F.slice(F.split(q, " "), 1, 3), " ")
    return (F.when(F.contains(low, q), F.lit(0.35))
            .when((F.length(opening) > 6) & F.contains(low, opening), F.lit(0.15)).otherwise(F.lit(0.0)))


def type_boost(query: Column, page_type: Column, boosts: Sequence[TypeBoost] = TYPE_BOOSTS) -> Column:
    """Weight of the first rule that matches the question and favours the page type."""
    out = F.lit(0.0)
    for rule in reversed(boosts):
        out = F.when(query.rlike("(?i)" + rule.pattern) & page_type.isin(*rule.page_types), F.lit(rule.weight)).otherwise(out)
    return out


def recency_boost(query: Column, seen_at: Column, as_of: datetime) -> Column:
    now = F.lit(as_of)
    boost = F.lit(0.0)
    for days, value in ((30, 0.10), (7, 0.20), (1, 0.30)):
        boost = F.when(seen_at >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(value)).otherwise(boost)
    return F.when(query.rlike(TIME_QUERY_PATTERN) & seen_at.isNotNull(), boost).otherwise(F.lit(0.0))


def keyword_boost(query_tokens: Column, keywords: Column) -> Column:
    known = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(k))
    long_ones = F.filter(query_tokens, lambda t: F.length(t) > 3)
    hits = F.size(F.array_intersect(long_ones, known)).cast("double")
    return F.coalesce(F.try_divide(hits, F.size(query_tokens).cast("double")), F.lit(0.0)) * KEYWORD_FACTOR


def rerank(candidates: DataFrame, as_of: datetime, n: int | Column = 10, query: str = "query_text") -> DataFrame:
    """Weighted sum of the features; ``final_rank`` 1..n per question.  ``n`` may be a column (list questions)."""
    q = F.col(query)
    staged = candidates.withColumn("_qt", tx.query_tokens(q)).withColumns({
        "f_retrieval": F.least(F.coalesce("rrf_score", "score", F.lit(0.0)) * 10.0, F.lit(1.0)),
        "f_content": overlap(F.col("_qt"), tx.query_tokens(F.coalesce("content", F.lit("")))),
        "f_title": overlap(F.col("_qt"), tx.query_tokens(F.coalesce("title", F.lit("")))) * TITLE_FACTOR,
        "f_phrase": phrase_bonus(q, F.coalesce("content", F.lit(""))),
        "f_keywords": keyword_boost(F.col("_qt"), F.col("keywords")),
        "f_type": type_boost(q, F.coalesce("page_type", F.lit("general"))),
        "f_recency": recency_boost(q, F.col("updated_at"), as_of)}).drop("_qt")
    total = sum((F.col(f"f_{name}") * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), "id")
    limit = n if isinstance(n, Column) else F.lit(n)
    return (staged.withColumn("rerank_score", total).withColumn("final_rank", F.row_number().over(w))
            .where(F.col("final_rank") <= limit))


def rerank_external(candidates: DataFrame, scores: DataFrame, n: int = 5, depth: int = 10) -> DataFrame:
    """Reorder the first ``depth`` rows by given scores from 0 to 10 (missing counts 0)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return (candidates.where(F.col("rank") <= depth)
            .join(scores.select("query_id", "id", F.col("score").alias("_given")), ["query_id", "id"], "left")
            .withColumn("rerank_score", F.coalesce(F.col("_given"), F.lit(0.0)) / 10.0)
            .withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= n).drop("_given"))
