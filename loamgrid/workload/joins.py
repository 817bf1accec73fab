"""Section C: joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions.vocabulary import INTENT_KEYWORDS
from ..operators import analytics as an
from ..operators import quality as qu
from ..operators.dedupe import new_content_only
from .registry import query
from .tables import literal, text_time, time_sql, with_tables

# Entries whose source is a fetched page, so that registry and entries meet.
LINKED = """, linked AS (SELECT e.* REPLACE (p.url AS source_url) FROM entries e JOIN pages p ON CAST(e.id AS BIGINT) // 4 = p.page_id)"""


def linked(t):
    pages = t.pages.select(F.col("url").alias("_url"), "page_id")
    return (t.entries.join(pages, F.floor(F.col("id").cast("long") / 4) == F.col("page_id")).drop("source_url", "page_id")
            .withColumnRenamed("_url", "source_url"))


@query("c1_pages_with_chunks", with_tables("entries registry", LINKED + """, agg AS (SELECT source_url, count(*) AS n, count(vector_id) AS v, min(namespace) AS namespace, min(category) AS category, avg(length(content)) AS size FROM linked GROUP BY source_url)
SELECT r.id, r.url, coalesce(a.n, r.chunk_count, 0) AS total_chunks, coalesce(a.namespace, 'unknown') AS namespace, coalesce(a.category, 'unknown') AS category,
coalesce(a.v, 0) AS vectors, coalesce(round(a.size), 0) AS avg_chunk_size FROM registry r LEFT JOIN agg a ON r.url = a.source_url WHERE r.deleted_at IS NULL"""))
def _(t):
    return qu.pages_with_chunks(t.registry, linked(t)).select("id", "url", "total_chunks", "namespace", "category", "vectors", "avg_chunk_size")


@query("c2_entries_of_pages", with_tables("entries", "SELECT e.id, e.category, CAST(l.doc_id // 3 AS BIGINT) AS page_id, l.quality AS copy_index FROM entries e JOIN labels l ON CAST(l.doc_id AS VARCHAR) = e.id"))
def _(t):
    copies = t.labels.select(F.col("doc_id").cast("string").alias("vector_id"), F.floor(F.col("doc_id") / 3).alias("page_id"), F.col("quality").alias("chunk_index"))
    return qu.entries_of_pages(t.entries.select("id", "category"), copies)


@query("c3_latest_run_failures", r"""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT max_by(o_custkey, (o_orderdate, o_custkey)) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def _(t):
    """Orders as failures, customers as runs: the run that started last is the customer of the newest order."""
    failures = t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("url"), F.col("o_orderdate").alias("attempted_at"))
    runs = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("started_at"))
    return qu.failures_of_latest_run(failures, runs, 20).select(F.col("url").alias("o_orderkey"), F.col("run_id").alias("o_custkey"))


@query("c4_vectors_without_entry", with_tables("entries vectors", "SELECT id, namespace FROM vectors WHERE id NOT IN (SELECT id FROM entries WHERE vector_id IS NOT NULL)"))
def _(t):
    return qu.vectors_without_entry(t.vectors, t.entries.where(F.col("vector_id").isNotNull()))


@query("c4_entries_without_vector", with_tables("entries vectors", "SELECT id, vector_id, category FROM entries WHERE vector_id IS NOT NULL AND vector_id NOT IN (SELECT id FROM vectors)"))
def _(t):
    return qu.entries_without_vector(t.entries, t.vectors)


@query("c4_never_synced", with_tables("entries", "SELECT id FROM entries WHERE synced_at IS NULL AND vector_id IS NOT NULL"))
def _(t):
    return qu.never_synced(t.entries).select("id")


HEALTH = """, a AS (SELECT namespace, count(*) AS c FROM entries GROUP BY 1), b AS (SELECT namespace, count(*) AS v FROM vectors GROUP BY 1),
health AS (SELECT coalesce(a.namespace, b.namespace) AS namespace, coalesce(c, 0) AS total_chunks, coalesce(v, 0) AS vectors,
CASE WHEN c IS NULL THEN 'orphaned' WHEN v IS NULL THEN 'unknown' WHEN abs(v - c) < 5 THEN 'healthy' ELSE 'degraded' END AS sync_health FROM a FULL JOIN b ON a.namespace = b.namespace)"""


@query("c5_namespace_health", with_tables("entries vectors", HEALTH + " SELECT * FROM health"))
def _(t):
    return qu.namespace_health(t.entries, t.vectors)


@query("d17_health_totals", with_tables("entries vectors", HEALTH + " SELECT count(*) AS namespaces, CAST(sum(total_chunks) AS BIGINT) AS chunks, CAST(sum(vectors) AS BIGINT) AS vectors, count(*) FILTER (WHERE sync_health = 'healthy') AS healthy FROM health"))
def _(t):
    return qu.health_totals(qu.namespace_health(t.entries, t.vectors))


@query("c6_group_against_own_limit", r"""SELECT l_orderkey, count(*) AS entry_count FROM lineitem o GROUP BY l_orderkey HAVING count(*) > (SELECT coalesce(min(l_linenumber), 0) + 1 FROM lineitem i WHERE i.l_orderkey = o.l_orderkey)""")
def _(t):
    """The correlated limit is an aggregate of the same group, so no join is needed."""
    return (t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("entry_count"), F.min("l_linenumber").alias("_allowed"))
            .where(F.col("entry_count") > F.coalesce("_allowed", F.lit(0)) + 1).drop("_allowed"))


@query("c9_new_content_only", with_tables("entries", "SELECT id FROM entries WHERE content_hash NOT IN (SELECT content_hash FROM entries WHERE vector_id IS NOT NULL)"))
def _(t):
    return new_content_only(t.entries, t.entries.where(F.col("vector_id").isNotNull())).select("id")


@query("c10_learned_corrections", r"""WITH c AS (SELECT item_id, lower(text) AS q, 'a' || CAST(item_id AS VARCHAR) AS answer FROM benchmark ORDER BY item_id DESC LIMIT 100),
m AS (SELECT item_id AS message_id, left(lower(text), 25) AS k FROM benchmark)
SELECT message_id, CAST(count(*) AS INTEGER) AS n_answers, string_agg(answer, ' | ' ORDER BY item_id DESC) AS answers FROM m JOIN c ON contains(c.q, m.k) GROUP BY message_id""")
def _(t):
    corrections = t.benchmark.select(F.col("item_id").alias("correction_id"), F.col("text").alias("question"),
                                     F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("answer"), F.timestamp_seconds("item_id").alias("created_at"))
    return qu.learned_corrections(t.benchmark.select(F.col("item_id").alias("message_id"), "text"), corrections, newest=100, opening=25)


@query("c11_log_with_hits", with_tables("log", "SELECT l.id, l.intent, h.event_id AS hit FROM log l JOIN events h ON l.session_id = CAST(h.user_id AS VARCHAR) AND h.ts = l.created_at"))
def _(t):
    hits = t.events.select(F.col("event_id").alias("hit"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return t.log.join(hits, ["session_id", "created_at"]).select("id", "intent", "hit")


@query("c12_label_lookup", r"""SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    """Two dimension lookups behind a fact join; the dimensions are small enough for Spark to broadcast."""
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "n_nationkey")
    named = qu.label_with(facts, t.nation, "n_nationkey", ["n_name", "n_regionkey"])
    return qu.label_with(named.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey", ["r_name"]).select("o_orderkey", "n_name", "r_name")
