"""Section J: request history in batch, and the same flows as streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import requests as rq
from ..schemas import EVENTS
from ..streaming import flows as fl
from .registry import query
from .tables import chat_rows, text_time, with_tables


def timed(t):
    return t.events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def event_stream(t):
    return fl.read_events(t.spark, t.dir, EVENTS, "events.parquet")


def stored(t, stream, name):
    """Run a stream over all input that is there, into a table, and read the table."""
    path, checkpoint = t.scratch(name), t.scratch(name + "-state")
    fl.run_to_end(fl._start(stream, checkpoint, "append", path=path))
    return t.spark.read.schema(stream.schema).parquet(path)


@query("j1_ingest_stream")
def _(t):
    """Fetched pages through extraction, near-copy removal and upsert into a change log."""
    source = t.scratch("fetched")
    t.pages.select("page_id", "url", "html", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("fetched_at")).write.parquet(source)
    pages = t.spark.readStream.schema("page_id long, url string, html string, fetched_at timestamp").parquet(source)
    changes = t.scratch("changes")
    fl.run_to_end(fl.ingest_stream(pages, changes, t.scratch("ingest"), prefix=None))
    return fl.current_chunks(t.spark, changes).groupBy("category").agg(F.count("*").alias("chunks"), F.countDistinct("source_url").alias("sources"))


@query("j2_daily_counts_stream", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _(t):
    return text_time(stored(t, fl.tumbling_counts(event_stream(t), ["event_type"]), "daily"), "window_start")


@query("j3_recent_requests", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS requests FROM events""")
def _(t):
    return rq.recent_requests(timed(t), "user_id", "ts", "event_id", window_seconds=3600).select("event_id", "requests")


@query("j3_sliding_counts_stream", """WITH w AS (SELECT user_id, epoch_us(ts) // 1800000000 - s.i AS k FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) s), c AS (SELECT k, user_id, count(*) AS n FROM w GROUP BY 1, 2)
SELECT strftime(make_timestamp(k * 1800000000), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, n FROM c WHERE n > 1 AND make_timestamp(k * 1800000000) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    stream = fl.sliding_request_counts(event_stream(t), "user_id", width="2 hours", slide="30 minutes", limit=1, watermark="1 hour")
    return text_time(stored(t, stream, "sliding"), "window_start")


def fixed_sql(key: str, span_seconds: int, columns: str) -> str:
    """A window opens at a key's first request and, after it has closed, at the next one."""
    span = span_seconds * 1_000_000
    return f"""WITH RECURSIVE asked AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t FROM events),
opened AS (SELECT k, min(t) AS s FROM asked GROUP BY k UNION ALL SELECT a.k, min(a.t) FROM opened o JOIN asked a ON a.k = o.k AND a.t > o.s + {span} GROUP BY a.k, o.s),
placed AS (SELECT event_id, a.k, t, max(s) AS s FROM asked a JOIN opened o ON o.k = a.k AND o.s <= a.t GROUP BY ALL),
numbered AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY k, s ORDER BY t, event_id) AS INTEGER) AS request_no FROM placed)
SELECT event_id, {columns} FROM numbered"""


@query("j3b_fixed_windows", fixed_sql("user_id", 36000, "request_no, request_no > 2 AS refused"))
def _(t):
    return rq.fixed_windows(timed(t), "user_id", "ts", "event_id", window_seconds=36000, limit=2).select("event_id", "request_no", "refused")


@query("j3b_fixed_windows_stream", fixed_sql("user_id", 36000, "request_no, request_no > 2 AS refused"))
def _(t):
    stream = fl.limited_requests(event_stream(t), "user_id", window_seconds=36000, limit=2)
    return stored(t, stream, "limited").select("event_id", "request_no", "refused")


@query("j4_cache_hits_renewed", """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, props ORDER BY ts, event_id)) <= 3600000000, FALSE) AS cache_hit FROM events""")
def _(t):
    keyed = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "event_type", "props").alias("cache_key"))
    return rq.cache_hits(keyed, "cache_key", "ts", "event_id").select("event_id", "cache_hit")


@query("j4_cache_hits_fixed", fixed_sql("event_type || '|' || props", 3600, "request_no > 1 AS cache_hit"))
def _(t):
    keyed = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "event_type", "props").alias("cache_key"))
    return rq.cache_hits(keyed, "cache_key", "ts", "event_id", renewed_on_read=False).select("event_id", "cache_hit")


SESSIONS = """g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)"""


@query("j5_sessions", f"WITH {SESSIONS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM i GROUP BY user_id, k")
def _(t):
    return text_time(rq.sessions(timed(t), "user_id", "ts", "event_id", 7200), "session_start", "session_end")


@query("j5_sessions_stream", f"WITH {SESSIONS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(t):
    out = stored(t, fl.session_counts(event_stream(t), "user_id", gap="2 hours"), "sessions")
    return text_time(out, "session_start").select("user_id", "session_start", "n")


@query("j6_unanswered_stream", "SELECT event_type || ' ' || props AS question_text, event_type AS persona, count(*) AS n FROM events WHERE value < 1 GROUP BY 1, 2")
def _(t):
    v = F.col("value")
    log = event_stream(t).select(F.concat_ws(" ", "event_type", "props").alias("query"), F.col("event_type").alias("intent"), F.when(v < 1, "no_data").otherwise("low").alias("confidence"), F.col("ts").alias("created_at"))
    path = t.scratch("unanswered")
    fl.run_to_end(fl.unanswered_stream(log, path, t.scratch("unanswered-state")))
    return t.spark.read.parquet(path).groupBy("question_text", "persona").agg(F.count("*").alias("n"))


@query("j7_feedback_stream", with_tables("chats", "SELECT e.event_id, c.id AS conversation_id FROM events e JOIN chats c ON c.id = CAST(e.user_id AS VARCHAR) || '-0' AND c.session_id = 's' || CAST(e.user_id // 3 AS VARCHAR) WHERE e.event_type IN ('click', 'view')"))
def _(t):
    user = F.col("user_id")
    mark = F.when(F.col("event_type") == "click", "thumbs_up").when(F.col("event_type") == "view", "thumbs_down").otherwise(F.col("event_type"))
    feedback = event_stream(t).select("event_id", F.concat(user.cast("string"), F.lit("-0")).alias("conversation_id"),
                                      F.concat(F.lit("s"), F.floor(user / 3).cast("string")).alias("session_id"), mark.alias("feedback"))
    path = t.scratch("feedback")
    fl.run_to_end(fl.feedback_stream(feedback, t.chats, path, t.scratch("feedback-state")))
    return t.spark.read.parquet(path).select("event_id", "conversation_id")
