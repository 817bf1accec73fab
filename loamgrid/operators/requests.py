"""Request history: rates, windows, cache hits, sessions, and the last turns of a conversation.

An id may send a large part of all requests, so everything here is dealt along time (see ``ordered``)."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ordered_fold, previous, running_last


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def recent_requests(df: DataFrame, key: str, ts: str, event: str, window_seconds: int = 60, limit: int = 20,
                    block_seconds: int = 3600) -> DataFrame:
    """Requests of the same id in the window that ends at each request; ``refused`` above the limit.

    Each block of time also gets the last ``window_seconds`` of the block before, so blocks are independent."""
    span = window_seconds * 1_000_000
    size = max(block_seconds, window_seconds) * 1_000_000
    at = df.withColumn("_t", _micros(F.col(ts))).withColumn("_b", F.floor(F.col("_t") / F.lit(size)))
    near_end = F.col("_t") >= (F.col("_b") + 1) * F.lit(size) - F.lit(span)
    placed = at.withColumn("_block", F.explode(F.when(near_end, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))))
    w = Window.partitionBy(key, "_block").orderBy("_t").rangeBetween(-span, 0)
    return (placed.withColumn("requests", F.count("*").over(w)).where(F.col("_block") == F.col("_b"))
            .withColumn("refused", F.col("requests") > limit).drop("_t", "_b", "_block"))


def with_gap(df: DataFrame, key: str, ts: str, event: str) -> DataFrame:
    """Add ``previous_at``, the time of the same id's request before."""
    return previous(df, [key], [ts, event], F.col(ts), "previous_at")


def islands(df: DataFrame, key: str, ts: str, event: str, gap_seconds: int) -> DataFrame:
    """Add ``island``: the time at which the current run of requests without a gap over ``gap_seconds`` began."""
    gapped = with_gap(df, key, ts, event)
    far = F.col("previous_at").isNull() | (_micros(F.col(ts)) - _micros(F.col("previous_at")) > gap_seconds * 1_000_000)
    marked = gapped.withColumn("_start", F.when(far, F.col(ts)))
    return running_last(marked, [key], [ts, event], F.col("_start"), "island").drop("_start", "previous_at")


def fixed_windows(df: DataFrame, key: str, ts: str, event: str, window_seconds: int = 60, limit: int = 20) -> DataFrame:
    """Windows that open at an id's first request and close ``window_seconds`` later; ``window_start``,
    ``request_no`` in it, and ``refused`` above the limit.

    After a gap longer than the window a new one must open, so islands between such gaps are folded side by side."""
    span = window_seconds * 1_000_000
    cut = islands(df, key, ts, event, window_seconds).withColumn("_t", _micros(F.col(ts)))

    def step(state: list, row: dict) -> tuple:
        if not state or row["_t"] > state[0] + span:
            state[:] = [row["_t"], 0]
        state[1] += 1
        return state[0], state[1], state[1] > limit
    folded = ordered_fold(cut, [key, "island"], [ts, event], list, step, "_w bigint, request_no int, refused boolean")
    return folded.withColumn("window_start", F.timestamp_micros("_w")).drop("_w", "_t", "island")


def cache_hits(df: DataFrame, key: str, ts: str, event: str, ttl_seconds: int = 3600, renewed_on_read: bool = True) -> DataFrame:
    """Would each request find its answer cached?  Either every read renews the entry, or it lives a fixed time
    from when it was stored."""
    if renewed_on_read:
        gapped = with_gap(df, key, ts, event)
        near = _micros(F.col(ts)) - _micros(F.col("previous_at")) <= ttl_seconds * 1_000_000
        return gapped.withColumn("cache_hit", F.coalesce(near, F.lit(False))).drop("previous_at")
    held = fixed_windows(df, key, ts, event, ttl_seconds)
    return held.withColumn("cache_hit", F.col("request_no") > 1).drop("window_start", "request_no", "refused")


def sessions(df: DataFrame, key: str, ts: str, event: str, gap_seconds: int = 1800) -> DataFrame:
    """Runs of requests without a longer pause: ``key, session_start, session_end, n``."""
    return (islands(df, key, ts, event, gap_seconds).groupBy(key, F.col("island").alias("session_start"))
            .agg(F.max(ts).alias("session_end"), F.count("*").alias("n")))


def last_turns(turns: DataFrame, n: int = 3, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation as ``role: text`` lines, oldest first."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    tail = turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return (tail.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat("role", F.lit(": "), "text").alias("line")))).alias("_t"))
            .select(key, F.size("_t").alias("n_turns"), F.array_join(F.col("_t.line"), "\n").alias("history")))


def question_answer_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the turn after it if that is an answer."""
    following = previous(turns, [key], [order], F.struct("role", "text"), "_next", following=True)
    return (following.where(F.col("role") == "user")
            .select(key, order, F.col("text").alias("user_message"),
                    F.when(F.col("_next.role") == "assistant", F.col("_next.text")).alias("bot_response")))
