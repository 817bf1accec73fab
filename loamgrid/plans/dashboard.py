"""The figures of the two dashboards, each a small DataFrame over shared tables."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators import analytics as an
from ..operators import quality as qu


def conversation_dashboard(conversations: DataFrame, log: DataFrame, unanswered: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    return {"metrics": an.headline(conversations, as_of), "most_asked": an.most_asked(conversations, as_of),
            "live_feed": an.newest_rows(conversations, "created_at", "id", 50), "languages": an.counts_by(conversations, "language"),
            "log_distributions": an.counts_by_each(log, ["intent", "confidence"]), "volume": an.daily_volume(conversations, as_of),
            "latency": an.latency(log, as_of), "unanswered": an.unanswered_rate(conversations, unanswered, as_of)}


def corpus_dashboard(entries: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    health = qu.namespace_health(entries, vectors)
    return {"breakdown": an.category_breakdown(entries), "by_type": an.counts_by_each(entries, ["category", "source_type", "page_type"]),
            "namespaces": qu.namespace_rollup(entries), "health": health, "totals": qu.health_totals(health),
            "recent": an.recent_updates(entries), "vectors": qu.vector_counts(vectors)}
