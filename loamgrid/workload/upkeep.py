"""Section G: upserts, synchronisation, re-indexing, frontier."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import CHUNK_DEFAULT, CHUNK_RULES, DENY_URL_PATTERNS, NAMESPACE_RULES
from ..operators import analytics as an
from ..operators import frontier as fr
from ..operators import html as hm
from ..operators import quality as qu
from ..operators import upsert as up
from ..operators.rules import classify_chunk
from ..sources import readers, sinks
from .registry import ORACLE, query
from .tables import AS_OF, literal, text_time, time_sql, with_tables
from .texts import LINKS, case_sql


def incoming(t):
    """A second crawl of the entries: sources of the long documents changed, French ones were moved, and English ones renamed."""
    e = t.entries
    changed = e.select("source_url", "source_type", "chunk_index", "title",
                       F.when(F.length("content") > 3000, F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content")).alias("content"),
                       F.col("category"), F.when(F.col("category") == "fr", F.lit("moved")).otherwise(F.col("namespace")).alias("namespace"))
    shifted = changed.withColumn("source_url", F.when(F.col("category") == "en", F.concat("source_url", F.lit("/new"))).otherwise(F.col("source_url")))
    return up.stamp_hash(shifted)


PLAN = """, inc AS (SELECT CASE WHEN category = 'en' THEN source_url || '/new' ELSE source_url END AS source_url, source_type, chunk_index, title,
CASE WHEN length(content) > 3000 THEN content || ' (revised)' ELSE content END AS content, category, CASE WHEN category = 'fr' THEN 'moved' ELSE namespace END AS namespace FROM entries),
st AS (SELECT source_url, source_type, chunk_index, min_by(id, (created_at, id)) AS old_id, min_by(content_hash, (created_at, id)) AS old_hash, min_by(namespace, (created_at, id)) AS old_namespace FROM entries GROUP BY 1, 2, 3),
plan AS (SELECT inc.*, coalesce(old_id, sha256(source_url || chr(31) || source_type || chr(31) || CAST(chunk_index AS VARCHAR))) AS id, old_namespace,
CASE WHEN old_id IS NULL THEN 'insert' WHEN old_hash <> sha256(content) THEN 'update' ELSE 'touch' END AS action FROM inc LEFT JOIN st USING (source_url, source_type, chunk_index))"""


@query("g1_upsert_plan", with_tables("entries", PLAN + " SELECT source_url, source_type, chunk_index, id, action, old_namespace FROM plan"))
def _(t):
    return up.plan_upsert(incoming(t), t.entries).select("source_url", "source_type", "chunk_index", "id", "action", "old_namespace")


@query("g1_repeated_keys", with_tables("entries", PLAN + " SELECT source_url, source_type, chunk_index, id, CASE WHEN old_namespace IS NULL THEN 'insert' ELSE 'update' END AS action FROM plan"))
def _(t):
    """The crawl with every row a second time, changed, and in that form the later one."""
    once = incoming(t).withColumn("version", F.lit(1))
    again = up.stamp_hash(once.withColumns({"content": F.concat("content", F.lit(" (again)")), "version": F.lit(2)}))
    plan = up.plan_upsert(once.unionByName(again), t.entries, version=["version"])
    return plan.select("source_url", "source_type", "chunk_index", "id", "action")


@query("g1_upsert_counts", with_tables("entries", PLAN + " SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'touch') AS skipped FROM plan"))
def _(t):
    return up.upsert_counts(up.plan_upsert(incoming(t), t.entries))


@query("g1_upserted_table", with_tables("entries", PLAN + f""" SELECT coalesce(e.id, p.id) AS id, md5(CASE WHEN p.action IN ('insert', 'update') THEN p.content ELSE e.content END) AS content_md5,
CASE WHEN p.action IN ('insert', 'update') THEN p.namespace ELSE e.namespace END AS namespace, strftime(coalesce(e.created_at, TIMESTAMP '2024-01-31'), '%Y-%m-%d %H:%M:%S') AS created_at,
strftime(CASE WHEN p.action IN ('insert', 'update') THEN TIMESTAMP '2024-01-31' ELSE e.updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM entries e FULL JOIN plan p ON e.id = p.id"""))
def _(t):
    out = up.apply_upsert(up.plan_upsert(incoming(t), t.entries), t.entries, AS_OF)
    return text_time(out.select("id", F.md5("content").alias("content_md5"), "namespace", "created_at", "updated_at"), "created_at", "updated_at")


ORACLE["a6_upsert_sink"] = ORACLE["g1_upserted_table"]


@query("a6_upsert_sink")
def _(t):
    """The table after the upsert, written and read back."""
    path = t.scratch("entries")
    sinks.write_table(up.apply_upsert(up.plan_upsert(incoming(t), t.entries), t.entries, AS_OF), path)
    out = readers.read_chunks(t.spark, path)
    return text_time(out.select("id", F.md5("content").alias("content_md5"), "namespace", "created_at", "updated_at"), "created_at", "updated_at")


@query("g1_single_entries", with_tables("entries", """, inc AS (SELECT id AS given, title, content, source_url, source_type, chunk_index, content_hash, namespace FROM entries)
SELECT CASE WHEN source_type = 'manual' THEN 'by_id' ELSE 'keyed' END AS kind, CASE WHEN source_type = 'manual' THEN CASE WHEN length(content) > 100 THEN 'update' ELSE 'touch' END ELSE
CASE WHEN o.old_hash IS NULL THEN 'insert' WHEN o.old_hash <> content_hash THEN 'update' ELSE 'touch' END END AS action, count(*) AS n
FROM inc LEFT JOIN (SELECT source_url, source_type, chunk_index, min_by(content_hash, (created_at, id)) AS old_hash FROM entries GROUP BY 1, 2, 3) o USING (source_url, source_type, chunk_index) GROUP BY 1, 2
UNION ALL SELECT 'manual', 'insert', count(*) FROM inc WHERE source_type = 'manual'"""))
def _(t):
    """Manual entries by their id (long ones forced), the rest by key, and each manual one again without an id."""
    e = t.entries.withColumn("entry_no", F.col("id")).withColumn("force", (F.col("source_type") == "manual") & (F.length("content") > 100))
    given = e.where("source_type = 'manual'")
    rest = e.where("source_type <> 'manual'").withColumn("id", F.lit(None).cast("string"))
    again = given.withColumn("id", F.lit(None).cast("string")).withColumn("force", F.lit(False))
    columns = ["id", "title", "content", "source_url", "source_type", "chunk_index", "content_hash", "namespace", "entry_no", "force"]
    plan = up.plan_single_entries(given.select(columns).unionByName(rest.select(columns)), t.entries)
    added = up.plan_single_entries(again.select(columns), t.entries)
    kind = F.when(F.col("source_type") == "manual", "by_id").otherwise("keyed")
    return (plan.select(kind.alias("kind"), "action").unionByName(added.select(F.lit("manual").alias("kind"), "action"))
            .groupBy("kind", "action").agg(F.count("*").alias("n")))


def lane(salt: str) -> str:
    return f"bit_xor(('0x' || left(md5('{salt}' || CAST(chunk_index AS VARCHAR) || ':' || content_hash), 15))::BIGINT)"


@query("g2_page_registry", with_tables("entries registry", f""", linked AS (SELECT e.* REPLACE (CASE WHEN CAST(e.id AS BIGINT) // 4 % 2 = 0 THEN p.url ELSE p.url || '/fresh' END AS source_url) FROM entries e JOIN pages p ON CAST(e.id AS BIGINT) // 4 = p.page_id),
s AS (SELECT source_url AS url, printf('%015x', {lane('a')}) || printf('%015x', {lane('b')}) AS h, CAST(count(*) AS INTEGER) AS n, max(title) AS title FROM linked GROUP BY 1)
SELECT coalesce(r.id, sha256(s.url)) AS id, coalesce(r.url, s.url) AS url, coalesce(s.title, r.title) AS title, h AS content_hash, coalesce(n, chunk_count) AS chunk_count,
CASE WHEN h IS NOT NULL THEN 'success' ELSE crawl_status END AS crawl_status, h IS NULL AND deleted_at IS NOT NULL AS still_deleted FROM registry r FULL JOIN s ON r.url = s.url"""))
def _(t):
    page = F.floor(F.col("id").cast("long") / 4)
    pages = t.pages.select(F.col("url").alias("_url"), "page_id")
    chunks = (t.entries.join(pages, page == F.col("page_id")).withColumn("source_url", F.when(F.col("page_id") % 2 == 0, F.col("_url")).otherwise(F.concat("_url", F.lit("/fresh"))))
              .withColumn("page_title", F.col("title")))
    registry = t.registry.withColumn("content_hash", F.lit(None).cast("string")).withColumn("sync_status", F.lit("synced"))
    out = up.upsert_pages(chunks, registry, AS_OF)
    return out.select("id", "url", "title", "content_hash", "chunk_count", "crawl_status", F.col("deleted_at").isNotNull().alias("still_deleted"))


@query("g3_moved_vectors", with_tables("entries", "SELECT e.id, e.namespace FROM entries e WHERE category = 'fr'"))
def _(t):
    moved = t.entries.withColumn("namespace", F.when(F.col("category") == "fr", "moved").otherwise(F.col("namespace")))
    return up.moved_vectors(moved, t.entries)


@query("g3_vectors_after_move", with_tables("entries vectors", "SELECT id, namespace FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.id = v.id AND category = 'en' AND e.namespace = v.namespace)"))
def _(t):
    gone = t.entries.where("category = 'en'").select("id", "namespace")
    return up.without(t.vectors, gone).select("id", "namespace")


@query("g4_pending_vectors", with_tables("entries vectors", "SELECT id, namespace FROM entries WHERE id NOT IN (SELECT id FROM vectors)"))
def _(t):
    return up.pending_vectors(t.entries, t.vectors).select("id", "namespace")


CHANGED = f"changed AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS old_category, {case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 0)} AS category, {case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 1)} AS namespace, {case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 2)} AS page_type FROM documents)"


@query("g5_reclassify", f"WITH {CHANGED} SELECT * FROM changed WHERE old_category <> category")
def _(t):
    return up.reclassify(t.entries)


@query("d14_change_matrix", f"WITH {CHANGED} SELECT old_category, category, count(*) AS n FROM changed WHERE old_category <> category GROUP BY 1, 2")
def _(t):
    return up.change_matrix(up.reclassify(t.entries))


@query("g6_sync_gap", with_tables("entries vectors", "SELECT (SELECT count(*) FROM entries) AS left_rows, (SELECT count(*) FROM vectors) AS right_rows, abs((SELECT count(*) FROM entries) - (SELECT count(*) FROM vectors)) AS gap, abs((SELECT count(*) FROM entries) - (SELECT count(*) FROM vectors)) <= 5 AS in_sync"))
def _(t):
    return qu.sync_gap(t.entries, t.vectors)


@query("g7_delete_documents", with_tables("entries", "SELECT id, source_url FROM entries WHERE source_url NOT IN (SELECT source_url FROM entries e JOIN labels l ON e.id = CAST(l.doc_id AS VARCHAR) WHERE toxic = 1)"))
def _(t):
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return up.delete_document(t.entries, t.entries.join(toxic, "id")).select("id", "source_url")


@query("g8_backfill", with_tables("entries", f"""SELECT id, coalesce(vector_id, id) AS vector_id, CASE WHEN category = 'de' THEN {case_sql("trim(lower(title))", NAMESPACE_RULES, ('general',), 0)} ELSE namespace END AS namespace FROM entries"""))
def _(t):
    """German entries lost their namespace; their title serves as category."""
    holes = t.entries.withColumn("namespace", F.when(F.col("category") != "de", F.col("namespace"))).withColumn("category", F.col("title"))
    return up.backfill(holes).select("id", "vector_id", "namespace")


@query("g9_ingest_summary", with_tables("entries", f""", c AS (SELECT *, {case_sql('lower(content)', CHUNK_RULES, CHUNK_DEFAULT, 1)} AS ns FROM entries), k AS (SELECT DISTINCT content_hash AS h FROM entries WHERE vector_id IS NOT NULL),
d AS (SELECT source_url, ns, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT source_url, '{{' || string_agg('"' || ns || '":' || CAST(n AS VARCHAR), ',' ORDER BY ns) || '}}' AS namespace_distribution FROM d GROUP BY 1)
SELECT c.source_url, count(DISTINCT chunk_index) AS total_pages, count(*) FILTER (WHERE h IS NULL) AS total_chunks, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS total_tokens,
count(*) FILTER (WHERE h IS NOT NULL) AS duplicate_chunks_removed, any_value(namespace_distribution) AS namespace_distribution FROM c LEFT JOIN k ON content_hash = h JOIN m USING (source_url) GROUP BY c.source_url"""))
def _(t):
    chunks = t.entries.withColumn("namespace", classify_chunk(F.col("content"))["namespace"]).withColumn("page_number", F.col("chunk_index"))
    out = an.ingest_summary(chunks, t.entries.where(F.col("vector_id").isNotNull()), "source_url")
    return out.withColumn("namespace_distribution", F.to_json("namespace_distribution"))


DENY = " OR ".join(f"regexp_matches(link, {literal(p)})" for p in DENY_URL_PATTERNS)
ADMITTED = LINKS + f""", hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages WHERE url LIKE 'https://%'),
adm AS (SELECT page_id, link_no, link FROM n WHERE link IS NOT NULL AND NOT ({DENY}) AND NOT regexp_matches(regexp_extract(link, '^https?://[^/?#]+(.*)', 1), '/an.*e') AND regexp_extract(link, '^https?://([^/?#]+)', 1) IN (SELECT host FROM hosts))"""


def admitted(t):
    hosts = t.pages.where(F.col("url").startswith("https://")).select(fr.urls.host(F.col("url")).alias("host"))
    return fr.admit_urls(hm.extract_links(t.pages), hosts, disallow=["/an*e"])


@query("g11_admitted_links", f"WITH {ADMITTED} SELECT page_id, CAST(link_no AS INTEGER) AS link_no, link FROM adm")
def _(t):
    return admitted(t).select("page_id", "link_no", "link")


@query("g10_frontier", f"""WITH {ADMITTED}, f AS (SELECT link AS url, 2 AS depth, CASE WHEN contains(link, 'profile.php') OR contains(link, 'faculty/') OR contains(link, 'staff/') THEN 1 WHEN contains(link, 'admiss') OR contains(link, 'fee') THEN 2
ELSE CAST(page_id % 4 AS INTEGER) + 1 END AS priority FROM adm) SELECT url, min(depth) AS depth, min(priority) AS priority FROM f WHERE url NOT IN (SELECT url FROM pages) GROUP BY url""")
def _(t):
    links = admitted(t).select("link", F.lit(1).alias("depth"), (F.col("page_id") % 4).cast("int").alias("priority"))
    return fr.expand_frontier(links, t.pages)


@query("g10_next_to_visit", with_tables("registry", "SELECT id, url FROM registry WHERE crawl_status = 'pending' ORDER BY chunk_count, last_scraped_at, url LIMIT 20"))
def _(t):
    queue = t.registry.select("id", "url", F.col("crawl_status").alias("status"), F.col("chunk_count").alias("priority"), F.col("last_scraped_at").alias("created_at"))
    return fr.next_to_visit(queue, 20).select("id", "url")


@query("g10_next_per_host", with_tables("registry", "SELECT id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, row_number() OVER (PARTITION BY host ORDER BY chunk_count, last_scraped_at, url) AS visit_no FROM registry WHERE crawl_status = 'pending' QUALIFY visit_no <= 3"))
def _(t):
    queue = t.registry.select("id", "url", F.col("crawl_status").alias("status"), F.col("chunk_count").alias("priority"), F.col("last_scraped_at").alias("created_at"))
    return fr.next_per_host(queue, 3).select("id", "host", "visit_no")


@query("g12_last_seen", with_tables("entries", f"""SELECT p.url, strftime(max(e.last_scraped_at), '%Y-%m-%d %H:%M:%S') AS last_scraped_at FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN (SELECT CASE WHEN CAST(id AS BIGINT) // 4 = page_id THEN url END AS source_url, last_scraped_at FROM entries JOIN pages ON CAST(id AS BIGINT) // 4 = page_id) e ON p.url = e.source_url GROUP BY p.url"""))
def _(t):
    from .joins import linked
    return text_time(fr.last_seen(t.pages.select("url").distinct(), linked(t)), "last_scraped_at")


@query("g13_error_category", "SELECT event_id, CASE WHEN contains(props, '4') AND contains(event_type || ' ' || props, '404') THEN '404' WHEN contains(event_type, 'timeout') THEN 'timeout' ELSE 'other' END AS category FROM (SELECT event_id, event_type, replace(replace(props, '9', '404'), 'x', 'y') AS props FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' ELSE event_type END AS event_type, props FROM events))")
def _(t):
    message = F.concat_ws(" ", F.when(F.col("event_type") == "error", "timeout").otherwise(F.col("event_type")), F.regexp_replace("props", "9", "404"))
    return t.events.select("event_id", fr.error_category(message).alias("category"))


@query("g14_matching_links", r"""WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS txt FROM pages)
SELECT DISTINCT root || href AS link FROM l WHERE contains(lower(root || href) || ' ' || lower(txt), 'tion') AND NOT regexp_matches(root || href, '(?i)\.(jpg|jpeg|png|gif|svg|ico|css|js|woff|ttf|eot|mp4|avi|zip|rar)(\?.*)?$')""")
def _(t):
    return fr.matching_links(hm.extract_anchors(t.pages), "tion")
