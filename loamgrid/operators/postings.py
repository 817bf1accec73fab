"""Keyword search for a table of questions over a table of chunks."""
from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import spread, with_once

# Field weights: title counts most, category and page type less, content least.
FIELD_WEIGHTS = {"title": 1.0, "category": 0.4, "page_type": 0.4, "content": 0.2}


def term_uses(df: DataFrame, key: str = "id", fields: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Every use of every term: ``key, weight, term, tf`` with ``tf`` 1.

    The rows are dealt by key once; sums per key and term, and per key and question, then need no further shuffle."""
    tagged = F.array(*[F.struct(F.lit(float(w)).alias("weight"), tx.words(F.coalesce(F.col(c), F.lit(""))).alias("terms"))
                       for c, w in fields.items()])
    # The array stands alone before it is exploded; inside a struct it would be copied into every row.
    return (spread(df.select(key, *fields), key).select(key, F.explode_outer(tagged).alias("_f"))
            .select(key, F.col("_f.weight").alias("weight"), F.col("_f.terms").alias("_terms"))
            .select(key, "weight", F.explode_outer("_terms").alias("term"), F.lit(1).cast("long").alias("tf"))
            .where(F.col("term").isNotNull()))


def postings(df: DataFrame, key: str = "id", fields: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """The stored inverted table ``key, field, weight, term, tf``; write it bucketed by ``term``."""
    tagged = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(float(w)).alias("weight"),
                                tx.words(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for c, w in fields.items()])
    return (spread(df.select(key, *fields), key).select(key, F.explode_outer(tagged).alias("_f"))
            .select(key, "_f.field", "_f.weight", F.col("_f.terms").alias("_terms"))
            .select(key, "field", "weight", F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
            .groupBy(key, "field", "weight", "term").agg(F.count("*").alias("tf")))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(tx.words(F.col(text)))).alias("term"))


def top_per_query(scored: DataFrame, score: Column, k: int, query_id: str = "query_id", key: str = "id") -> DataFrame:
    """Best ``k`` per query, ties by key; Spark cuts each task's rows to ``k`` before they are shuffled."""
    w = Window.partitionBy(query_id).orderBy(score.desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_topk(queries: DataFrame, terms: DataFrame, k: int = 40, key: str = "id") -> DataFrame:
    """Weighted term counts summed over the terms of the question (any term may match), squashed to s/(s+1).

    ``terms`` is the output of ``term_uses`` or ``postings``.  Terms no question asks for go first, and the uses of
    a term in a chunk are one row before questions are joined.  Spark broadcasts a short question table, and all of
    this stays where the chunk is; a long one is joined by term, where adaptive execution splits hot terms."""
    wanted = query_terms(queries)
    uses = (terms.join(wanted.select("term").distinct(), "term", "left_semi")
            .groupBy(key, "term").agg(F.sum(F.col("weight") * F.col("tf")).alias("_w")))
    scored = uses.join(wanted, "term").groupBy("query_id", key).agg(F.sum("_w").alias("_s"))
    score = (F.col("_s") / (F.col("_s") + 1.0))
    return top_per_query(scored.withColumn("keyword_score", score), F.round("keyword_score", 12), k, key=key).drop("_s")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 40, k1: float = 1.2, b: float = 0.75, key: str = "id",
              text: str = "content") -> DataFrame:
    """Okapi BM25 over one text column.  Counts are kept for question terms only."""
    tokens = with_once(spread(docs.select(key, text), key), "_w", tx.words(F.col(text))).select(key, F.size("_w").alias("_dl"), "_w")
    lengths = docs.select(F.size(tx.words(F.col(text))).alias("_dl"))
    n_docs = lengths.agg(F.count("*")).scalar()
    mean_length = lengths.agg(F.avg("_dl")).scalar()
    wanted = query_terms(queries)
    counts = (tokens.select(key, "_dl", F.explode_outer("_w").alias("term")).where(F.col("term").isNotNull())
              .join(wanted.select("term").distinct(), "term", "left_semi")
              .groupBy(key, "_dl", "term").agg(F.count("*").alias("_tf")))
    spread_of = counts.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.ln(F.lit(1.0) + (n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("_dl") / mean_length)
    gain = idf * F.col("_tf") * (k1 + 1.0) / (F.col("_tf") + norm)
    weighted = counts.join(spread_of, "term").withColumn("_gain", gain).select(key, "term", "_gain")
    scored = (weighted.join(wanted, "term").groupBy("query_id", key).agg(F.sum("_gain").alias("bm25_score")))
    return top_per_query(scored, F.round("bm25_score", 9), k, key=key)


def newest(docs: DataFrame, n: int = 5, score: float = 0.5, by: str = "updated_at", key: str = "id") -> DataFrame:
    return (docs.orderBy(F.col(by).desc_nulls_last(), F.col(key)).limit(n)
            .select(F.col(key), F.lit(score).alias("score"), F.col(by)))


def keyword_or_recent(queries: DataFrame, docs: DataFrame, hits: DataFrame, recent: int = 5, key: str = "id") -> DataFrame:
    """Keyword ``hits`` of the questions; a question without any gets the ``recent`` newest rows at score 0.5.

    The newest rows (a fixed handful) ride along as one array per unmatched question."""
    hits = hits.select("query_id", key, "keyword_score", F.lit(0.0).alias("score"), "rank")
    latest = newest(docs, recent, key=key)
    packed = latest.agg(F.sort_array(F.collect_list(F.struct(F.col("updated_at"), F.col(key))), asc=False)).scalar()
    unmatched = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    filled = (unmatched.select("query_id", F.posexplode(packed).alias("_i", "_r"))
              .select("query_id", F.col(f"_r.{key}").alias(key), F.lit(None).cast("double").alias("keyword_score"),
                      F.lit(0.5).alias("score"), (F.col("_i") + 1).alias("rank")))
    return hits.unionByName(filled)
