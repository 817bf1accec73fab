"""Sections A and B: scans, sinks, projections, predicates, patches."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions import text as tx
from ..operators import listing as ls
from ..operators.chunking import chunk_paged_documents
from ..operators.dedupe import keep_first  # noqa: F401
from ..operators.html import extract_pages
from ..operators.upsert import upsert_config
from ..sources import readers, sinks
from .registry import query
from .tables import AS_OF, text_time, time_sql, with_tables, words_sql


@query("a1_chunk_scan", with_tables("entries", "SELECT id, category, namespace FROM entries"))
def _(t):
    return t.entries.select("id", "category", "namespace")


@query("a2_text_corpus", r"""SELECT 'lang=' || lang AS department, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def _(t):
    """Writes the documents as text files in one folder per department, then reads the folders back."""
    root = t.scratch("corpus")
    t.documents.select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(root)
    return readers.read_text_corpus(t.spark, root).groupBy("department").agg(F.sum(F.length("text")).alias("chars"))


@query("a3_admit_pages", with_tables("page_tokens page_blocks page_content", """, r AS (SELECT CASE WHEN length(html) < 200 THEN 'insufficient_html' WHEN length(content) < 50 THEN 'insufficient_text' END AS reason FROM page_content)
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS n FROM r GROUP BY ALL"""))
def _(t):
    return readers.admit_pages(extract_pages(t.pages)).groupBy("status", "reason").agg(F.count("*").alias("n"))


@query("a3_admit_documents", r"""SELECT doc_id, CASE WHEN length(text) < 200 THEN 'insufficient_html' WHEN length(text) < 50 THEN 'insufficient_text' END AS reason,
CASE WHEN length(text) < 200 THEN 'rejected' ELSE 'accepted' END AS status FROM documents""")
def _(t):
    return readers.admit_pages(t.documents, "text", "text").select("doc_id", "reason", "status")


@query("a4_paged_documents")
def _(t):
    """Conversations as paged documents: a conversation is a document, a turn a page."""
    paged = t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")
    return chunk_paged_documents(paged).select("doc_id", "page_number", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"))


@query("a5_rows_to_text", r"""SELECT c_custkey, concat_ws(' | ', trim(c_name), trim(c_mktsegment), CAST(c_nationkey AS VARCHAR)) AS line FROM customer""")
def _(t):
    return readers.rows_to_text(t.customer, ["c_name", "c_mktsegment", "c_nationkey"]).select("c_custkey", "line")


@query("a5_sheets_to_text", r"""SELECT lang, doc_id AS line_no, concat_ws(' | ', source, CAST(n_chars AS VARCHAR)) AS line FROM documents
UNION ALL SELECT DISTINCT lang, -1, chr(10) || '## Sheet: ' || lang || chr(10) FROM documents""")
def _(t):
    return readers.sheets_to_text(t.documents, "lang", "doc_id", ["source", "n_chars"])


@query("a7_vector_sink", with_tables("vectors", "SELECT namespace, count(*) AS n FROM vectors GROUP BY namespace"))
def _(t):
    path = t.scratch("vectors")
    sinks.write_vectors(t.vectors, path, buckets=8)
    return t.spark.read.parquet(path).groupBy("namespace").agg(F.count("*").alias("n"))


@query("a7_vector_upsert", with_tables("vectors", """SELECT id, namespace, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 2 * embedding[1] ELSE embedding[1] END AS first FROM vectors
UNION ALL SELECT 'new-' || id, namespace, embedding[1] FROM vectors WHERE CAST(id AS BIGINT) % 5 = 0"""))
def _(t):
    """Vectors of which a third is written again, doubled and twice over, with others that are new."""
    path, v = t.scratch("vectors"), t.vectors
    sinks.write_vectors(v, path, buckets=8)
    changed = v.where("cast(id as long) % 3 = 0")
    doubled = changed.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float"))).withColumn("version", F.lit(2))
    new = v.where("cast(id as long) % 5 = 0").withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("version", F.lit(1))
    sinks.write_vectors(doubled.unionByName(changed.withColumn("version", F.lit(1))).unionByName(new), path, buckets=8, order=["version"])
    return t.spark.read.parquet(path).select("id", "namespace", F.col("embedding")[0].alias("first"))


@query("a8_log_sink", with_tables("log", "SELECT id AS log_id, CAST(h.hit_no AS INTEGER) AS hit_no, intent || '-' || CAST(h.hit_no AS VARCHAR) AS chunk_id, CAST(retrieval_ms / (h.hit_no + 1) AS DOUBLE) AS score, '' AS source_url FROM log, (SELECT unnest([0, 1]) AS hit_no) h"))
def _(t):
    path = t.scratch("hits")
    hits = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(
        F.concat_ws("-", "intent", i.cast("string")).alias("id"), (F.col("retrieval_ms") / (i + 1)).alias("score"), F.lit(None).cast("string").alias("source_url")))
    sinks.append_log(sinks.hit_rows(t.log.select(F.col("id").alias("log_id"), hits.alias("hits"))), path)
    return t.spark.read.parquet(path)


@query("a9_search_fields", with_tables("entries", f"""SELECT id, array_to_string({words_sql('title')}, ' ') AS search_a,
array_to_string(list_concat({words_sql('category')}, {words_sql('page_type')}), ' ') AS search_b, md5(array_to_string({words_sql('content')}, ' ')) AS search_c_md5,
'2024-01-31 00:00:00' AS updated_at FROM entries"""))
def _(t):
    out = sinks.with_search_fields(t.entries, AS_OF)
    return text_time(out.select("id", "search_a", "search_b", F.md5("search_c").alias("search_c_md5"), "updated_at"), "updated_at")


@query("a10_config_upsert", r"""WITH changes AS (SELECT event_type || '.' || CAST(user_id AS VARCHAR) AS key, props AS value, ts FROM events),
latest AS (SELECT key, max_by(value, ts) AS value FROM changes GROUP BY key)
SELECT key, value FROM latest UNION ALL SELECT DISTINCT source, 'default' FROM documents WHERE source NOT IN (SELECT key FROM latest)""")
def _(t):
    changes = t.events.select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"),
                              F.col("ts").cast("timestamp").alias("updated_at"))
    defaults = t.documents.select(F.col("source").alias("key"), F.lit("default").alias("value"), F.lit(AS_OF).alias("updated_at")).distinct()
    return upsert_config(changes.limit(0), changes, defaults).select("key", "value")


LISTED = "SELECT id, title, category FROM entries WHERE (contains(lower(title), 'tion') OR contains(lower(content), 'tion')) AND source_type = 'webpage'"


@query("b1_list_entries", with_tables("entries", LISTED + " ORDER BY updated_at DESC NULLS LAST, id LIMIT 50 OFFSET 10"))
def _(t):
    return ls.list_entries(t.entries, "tion", filters={"source_type": "webpage"}, offset=10).select("id", "title", "category")


@query("b1_count_entries", with_tables("entries", f"SELECT count(*) AS total FROM ({LISTED})"))
def _(t):
    return ls.count_entries(t.entries, "tion", filters={"source_type": "webpage"})


@query("b2_list_documents", r"""SELECT doc_id, source, lang FROM documents WHERE (lower(source) LIKE '%src1%' OR lower(lang) LIKE '%src1%') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100""")
def _(t):
    return ls.list_entries(t.documents, "SRC1", ("source", "lang"), {"lang": "en"}, limit=100, newest_by="n_chars", tiebreak="doc_id").select("doc_id", "source", "lang")


@query("b3_list_urls", with_tables("registry", f"""SELECT id, url, {time_sql('last_scraped_at')} AS last_scraped_at FROM registry WHERE deleted_at IS NULL AND contains(lower(url), '/en/') AND crawl_status = 'success' ORDER BY registry.last_scraped_at DESC NULLS LAST, id LIMIT 50"""))
def _(t):
    live = t.registry.where(F.col("deleted_at").isNull())
    return text_time(ls.list_entries(live, "/en/", ("url", "title"), {"crawl_status": "success"}, newest_by="last_scraped_at").select("id", "url", "last_scraped_at"), "last_scraped_at")


@query("b4_chunks_of_source", with_tables("entries", "SELECT id, chunk_index, CAST(length(content) AS INTEGER) AS char_count FROM entries WHERE source_url = 'https://kb.example.org/en/3' ORDER BY chunk_index, id LIMIT 500"))
def _(t):
    return ls.chunks_of(t.entries, "https://kb.example.org/en/3", limit=500).select("id", "chunk_index", "char_count")


@query("b5_sizes", with_tables("entries", "SELECT id, length(content) AS char_count, CAST(round(length(content) / 4.0) AS INTEGER) AS approx_token_count FROM entries"))
def _(t):
    return ls.with_sizes(t.entries).select("id", "char_count", "approx_token_count")


@query("b6_document_tokens", with_tables("entries", "SELECT source_url, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS total_tokens FROM entries GROUP BY source_url"))
def _(t):
    return ls.doc_tokens(t.entries, "source_url")


@query("b7_recent_rows", with_tables("log", "SELECT id FROM log WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"))
def _(t):
    return t.log.where(ls.within_days(F.col("created_at"), AS_OF, 7)).select("id")


@query("b8_id_membership", r"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return ls.semi(t.documents, t.labels.where("toxic = 1"), "doc_id").select("doc_id", "source")


AUDIT = "(contains(lower(title), 'ction') OR contains(lower(content), 'ction') OR contains(lower(title), 'heand') OR contains(lower(content), 'heand'))"


@query("b9_keyword_audit", with_tables("entries", f"""SELECT id, concat_ws(',', CASE WHEN contains(lower(title), 'ction') OR contains(lower(content), 'ction') THEN 'ction' END,
CASE WHEN contains(lower(title), 'heand') OR contains(lower(content), 'heand') THEN 'heand' END) AS words_found, left(content, 100) AS preview FROM entries WHERE {AUDIT}"""))
def _(t):
    return ls.keyword_audit(t.entries, ("title", "content"), ("ction", "heand")).select("id", "words_found", "preview")


@query("b9_audit_by_category", with_tables("entries", f"SELECT category, count(*) AS n FROM entries WHERE {AUDIT} GROUP BY category"))
def _(t):
    return ls.audit_by_category(t.entries, ("title", "content"), ("ction", "heand"))


@query("b10_category_pattern", with_tables("entries", "SELECT id, category FROM entries WHERE regexp_matches(category, '(?i)^(DE|fr)$')"))
def _(t):
    return ls.category_like(t.entries, "^(DE|fr)$").select("id", "category")


@query("b11_urls_matching", with_tables("entries", """SELECT DISTINCT source_url FROM entries WHERE source_type IN ('webpage', 'document') AND source_url LIKE 'http%'
AND (contains(lower(source_url), 'the') OR contains(lower(title), 'the') OR contains(lower(category), 'the')) ORDER BY source_url LIMIT 100"""))
def _(t):
    return ls.urls_matching(t.entries, "the")


@query("b12_message_check", r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 500 THEN 'too_long' END AS problem FROM conversations WHERE text IS NULL OR text = '' OR length(text) > 500""")
def _(t):
    return ls.split_valid(t.conversations, ms.message_problem(F.col("text")))[1].select("conv_id", "turn", "problem")


@query("b12_feedback_check", r"""SELECT event_id, 'invalid_feedback' AS problem FROM events WHERE event_type NOT IN ('click', 'view')""")
def _(t):
    return ls.split_valid(t.events, ms.feedback_problem(F.col("event_type"), ("click", "view")))[1].select("event_id", "problem")


def _questions(t):
    q = t.entries.select("id", F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("resolved_entry_id"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return q, t.labels.select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("resolved"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("resolved_entry_id"))


@query("b13_resolve_questions", with_tables("entries", """SELECT e.id, coalesce(l.quality = 1, FALSE) AS resolved, CASE WHEN l.doc_id IS NOT NULL THEN 'e' || e.id END AS resolved_entry_id,
CASE WHEN l.quality = 1 THEN '2024-01-31 00:00:00' END AS resolved_at FROM entries e LEFT JOIN labels l ON e.id = CAST(l.doc_id AS VARCHAR)"""))
def _(t):
    return text_time(ls.resolve_questions(*_questions(t), AS_OF), "resolved_at")


@query("b14_patch", with_tables("entries", """SELECT e.id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, e.category) AS category, coalesce(CASE WHEN l.quality = 0 THEN 'archived' END, e.page_type) AS page_type
FROM entries e LEFT JOIN labels l ON e.id = CAST(l.doc_id AS VARCHAR)"""))
def _(t):
    updates = t.labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "flagged").alias("category"), F.when(F.col("quality") == 0, "archived").alias("page_type"))
    return ls.patch(t.entries, updates, ["category", "page_type"]).select("id", "category", "page_type")


@query("b15_apply_feedback", with_tables("chats", """, f AS (SELECT CAST(doc_id // 5 AS VARCHAR) || '-' || CAST((doc_id % 5) // 3 AS VARCHAR) AS conversation_id, 's' || CAST((doc_id // 5) // 3 - toxic AS VARCHAR) AS session_id,
CASE WHEN quality = 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback, doc_id FROM labels),
last AS (SELECT conversation_id, session_id, max_by(feedback, doc_id) AS feedback FROM f GROUP BY 1, 2)
SELECT c.id, c.session_id, l.feedback FROM chats c LEFT JOIN last l ON c.id = l.conversation_id AND c.session_id = l.session_id"""))
def _(t):
    doc = F.col("doc_id")
    fb = t.labels.select(F.concat_ws("-", F.floor(doc / 5).cast("string"), F.floor(doc % 5 / 3).cast("string")).alias("conversation_id"),
                         F.concat(F.lit("s"), (F.floor(F.floor(doc / 5) / 3) - F.col("toxic")).cast("string")).alias("session_id"),
                         F.when(F.col("quality") == 1, "thumbs_up").otherwise("thumbs_down").alias("feedback"), F.timestamp_seconds(doc).alias("created_at"))
    return ls.apply_feedback(t.chats, fb).select("id", "session_id", "feedback")
