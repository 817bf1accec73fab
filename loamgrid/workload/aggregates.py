"""Section D: aggregations, windows, top-n, set operations."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import STATIC_NAMESPACES
from ..operators import analytics as an
from ..operators import dedupe as dd
from ..operators import ordered, quality as qu, requests
from ..operators.upsert import change_matrix, reclassify
from ..operators.retrieval import merge_by_precedence
from .joins import linked
from .registry import query
from .tables import AS_OF, text_time, time_sql, with_tables


@query("d1_counts_by_intent", with_tables("log", "SELECT coalesce(intent, 'unknown') AS intent, count(*) AS n FROM log GROUP BY 1"))
def _(t):
    return an.counts_by(t.log, "intent")


@query("d1_counts_by_part_type", "SELECT coalesce(p_type, 'unknown') AS p_type, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return an.counts_by(t.part, "p_type")


@query("d2_counts_by_each", """SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'total', '', count(*) FROM lineitem""")
def _(t):
    return an.counts_by_each(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("d3_headline", with_tables("log", """SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-24') AS this_week,
count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-01') AS this_month, count(DISTINCT session_id) AS total_users, count(*) AS total_messages FROM log"""))
def _(t):
    return an.headline(t.log, AS_OF)


@query("d4_latency", with_tables("log", """SELECT round(coalesce(avg(retrieval_ms), 0), 6) AS avg_retrieval, round(coalesce(avg(total_ms), 0), 6) AS avg_total,
round(coalesce(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 0), 6) AS cache_hit_rate FROM log WHERE created_at > TIMESTAMP '2024-01-24'"""))
def _(t):
    out = an.latency(t.log, AS_OF)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("d5_unanswered_rate", with_tables("log", """SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'no_data') AS no_data_count,
round(100.0 * count(*) FILTER (WHERE confidence = 'no_data') / count(*), 1) AS no_data_percent FROM log WHERE created_at > TIMESTAMP '2024-01-01'"""))
def _(t):
    return an.unanswered_rate(t.log, t.log.where("confidence = 'no_data'"), AS_OF)


@query("d6_shares", """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(n / (SELECT sum(n) FROM c), 9) AS share_of_total, round(n / (SELECT max(n) FROM c), 9) AS share_of_max FROM c""")
def _(t):
    out = an.shares(an.counts_by(t.lineitem, "l_returnflag"))
    return out.withColumns({c: F.round(c, 9) for c in ("share_of_total", "share_of_max")})


@query("d7_status_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders""")
def _(t):
    return an.status_summary(t.orders, "o_orderstatus", ["F", "O", "P"], ["o_custkey"])


@query("d8_namespace_rollup", with_tables("entries", f"""SELECT namespace, count(DISTINCT source_url) AS total_urls, count(*) AS total_chunks, round(avg(length(content)), 6) AS avg_chunk_size,
{time_sql('max(updated_at)')} AS last_updated, count(*) FILTER (WHERE source_type = 'manual') AS manual_count, count(*) FILTER (WHERE source_type = 'webpage') AS crawled_count,
count(vector_id) AS synced_vectors, count(*) FILTER (WHERE vector_id IS NULL) AS unsynced_count FROM entries GROUP BY namespace"""))
def _(t):
    out = qu.namespace_rollup(t.entries)
    return text_time(out.withColumn("avg_chunk_size", F.round("avg_chunk_size", 6)), "last_updated")


@query("d9_url_rollup", with_tables("entries", """SELECT source_url, count(*) AS total_chunks, count(vector_id) AS vectors, min(namespace) AS namespace, min(category) AS category, round(avg(length(content)), 6) AS avg_chunk_size FROM entries GROUP BY 1"""))
def _(t):
    return qu.url_rollup(t.entries).withColumn("avg_chunk_size", F.round("avg_chunk_size", 6))


@query("d10_category_breakdown", with_tables("entries", f"""SELECT category, count(id) AS entry_count, CAST(coalesce(sum(total_chunks), count(id)) AS BIGINT) AS chunk_count, {time_sql('max(updated_at)')} AS last_updated FROM entries GROUP BY 1"""))
def _(t):
    return text_time(an.category_breakdown(t.entries), "last_updated")


@query("d11_distinct_counts", "SELECT count(DISTINCT l_orderkey) AS distinct_l_orderkey, count(DISTINCT l_partkey) AS distinct_l_partkey, count(DISTINCT l_suppkey) AS distinct_l_suppkey FROM lineitem")
def _(t):
    return an.distinct_counts(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@query("d12_group_members", with_tables("entries", """SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS member_no FROM entries WHERE content_hash IN (SELECT content_hash FROM entries GROUP BY 1 HAVING count(*) > 1)"""))
def _(t):
    return dd.group_members(t.entries, ["content_hash"]).select("content_hash", "id", "member_no")


@query("d12_group_sources", with_tables("entries", """SELECT DISTINCT content_hash, source_url FROM entries WHERE content_hash IN (SELECT content_hash FROM entries GROUP BY 1 HAVING count(*) > 1)"""))
def _(t):
    return dd.group_sources(t.entries, ["content_hash"])


@query("d13_distribution", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, '{' || string_agg('"' || lang || '":' || CAST(n AS VARCHAR), ',' ORDER BY lang) || '}' AS distribution FROM c GROUP BY source""")
def _(t):
    return an.distribution(t.documents, "source", "lang").select("source", F.to_json("distribution").alias("distribution"))


@query("d15_completeness", with_tables("entries", "SELECT count(*) AS total, count(vector_id) AS with_vector_id, count(last_scraped_at) AS with_last_scraped_at, count(synced_at) AS with_synced_at FROM entries"))
def _(t):
    return qu.completeness(t.entries, ["vector_id", "last_scraped_at", "synced_at"])


@query("d16_run_counters", """SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS pages_crawled, count(*) FILTER (WHERE event_type = 'click') AS pages_skipped,
count(*) FILTER (WHERE event_type = 'error') AS pages_failed, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END), 0) AS BIGINT) AS chunks_created,
CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS duration_seconds FROM events GROUP BY user_id""")
def _(t):
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "click", "skipped").when(F.col("event_type") == "error", "failed").otherwise("other")
    return an.run_counters(t.events.select(F.col("user_id").alias("run_id"), status.alias("status"), F.floor("value").alias("chunks"), F.col("ts").cast("timestamp").alias("at")))


@query("d17b_vector_counts", with_tables("vectors", "SELECT namespace, count(*) AS vectors, (SELECT count(*) FROM vectors) AS total FROM vectors GROUP BY namespace"))
def _(t):
    return qu.vector_counts(t.vectors)


@query("d18_latest_per_url", with_tables("entries", f"""SELECT source_url, id, title, page_type, {time_sql('updated_at')} AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY entries.updated_at DESC, id DESC) AS rn FROM entries) WHERE rn = 1"""))
def _(t):
    return text_time(an.latest_per_url(t.entries), "updated_at").select("source_url", "id", "title", "page_type", "updated_at")


@query("d18_recent_updates", with_tables("entries", f"""SELECT source_url, id FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY updated_at DESC, id DESC) AS rn FROM entries) WHERE rn = 1 ORDER BY updated_at DESC, source_url LIMIT 10"""))
def _(t):
    return an.recent_updates(t.entries).select("source_url", "id")


@query("d19_positions", """SELECT conv_id, turn, row_number() OVER w AS position, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def _(t):
    """Position and running length within a conversation, in one pass."""
    turns = t.conversations.select("conv_id", "turn", F.length("text").alias("chars"))
    return ordered.scan(turns, ["conv_id"], ["turn"], sums={"position": F.lit(1), "chars_upto": F.col("chars")}).select("conv_id", "turn", "position", "chars_upto")


@query("d19_previous_row", """SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS previous_part FROM lineitem""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return ordered.previous(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"], F.col("l_partkey"), "previous_part")


@query("d19_result_rank", """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3""")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), "o_totalprice").where("rank <= 3").drop("o_totalprice")


@query("d20_most_asked", with_tables("log", "SELECT query, count(*) AS n FROM log WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY query ORDER BY n DESC, query LIMIT 10"))
def _(t):
    return an.most_asked(t.log, AS_OF, message="query")


@query("d20_newest_orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t):
    return an.newest_rows(t.orders, "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_custkey")


@query("d21_daily_volume", with_tables("log", f"SELECT {time_sql('date_trunc(' + chr(39) + 'day' + chr(39) + ', created_at)')} AS day, count(*) AS n FROM log WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY 1"))
def _(t):
    return text_time(an.daily_volume(t.log, AS_OF), "day")


@query("d22_known_namespaces", "SELECT source AS namespace FROM documents UNION SELECT unnest([" + ", ".join(f"'{n}'" for n in STATIC_NAMESPACES) + "])")
def _(t):
    return an.known_namespaces(t.entries, STATIC_NAMESPACES)


@query("d23_union_by_precedence", """WITH a AS (SELECT l_orderkey AS query_id, l_suppkey AS id, min(l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_orderkey AS query_id, l_suppkey AS id, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2),
u AS (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.id = b.id))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s, r, id) AS rank FROM u""")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_linenumber").alias("rank"))
    first = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_linenumber").alias("rank"))
    return merge_by_precedence([first, lines])


@query("d24_difference", with_tables("entries vectors", "SELECT DISTINCT namespace FROM entries EXCEPT SELECT namespace FROM vectors"))
def _(t):
    return an.difference(t.entries.select("namespace").distinct(), t.vectors, ["namespace"])


ALL_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("d25_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ALL_TABLES))
def _(t):
    return an.table_counts({n: getattr(t, n) for n in ALL_TABLES})
