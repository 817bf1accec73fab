"""Section F: text preparation, chunking, duplicates, pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.vocabulary import (CHUNK_DEFAULT, CHUNK_RULES, HEADING_TAGS, NAMESPACE_RULES, PAGE_DEFAULT, PAGE_RULES, PROFILE_DEPARTMENTS, PROFILE_FIELDS,
                                    PROFILE_HEADING_PATTERN, PROFILE_LINES, PROFILE_NO_NAME, PROFILE_PATTERN, PROFILE_TITLE_NOISE, STOP_WORDS, TRACKING_PARAMETERS)
from ..operators import chunking as ch
from ..operators import dedupe as dd
from ..operators import html as hm
from ..operators import rules as rl
from ..session import with_once
from .registry import query
from .tables import literal, text_time, time_sql, with_tables, words_sql


def case_sql(text: str, rules, default, position: int) -> str:
    """First-match rules as a CASE over one label."""
    arms = " ".join(f"WHEN regexp_matches({text}, {literal('(?i)' + r.pattern)}) THEN {literal(r.labels[position])}" for r in rules)
    return f"CASE {arms} ELSE {literal(default[position])} END"


BLANKS = r"'[ \t\n\r]+'"


@query("f1_clean_text", r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\t', '  ', 'g'),
'(?m)[ \t]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \t\x{A0}]{3,}', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS a FROM s)
SELECT doc_id, md5(trim(array_to_string(list_filter(a, lambda x, i: i = 1 OR trim(x, ' ' || chr(160)) <> trim(a[i - 1], ' ' || chr(160))), chr(10)), ' ' || chr(10) || chr(160))) AS cleaned_md5 FROM l""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned_md5"))


@query("f2_sections")
def _(t):
    return ch.split_sections(t.documents.select("doc_id", "text")).select("doc_id", "section_no", "heading", F.length("content").alias("chars"))


@query("f3_packed_sentences")
def _(t):
    packed = ch.pack_sentences(F.col("text"), F.lit(""))
    return t.documents.select("doc_id", F.posexplode(packed).alias("pack_no", "_p")).select("doc_id", "pack_no", F.length("_p").alias("chars"), F.md5("_p").alias("text_md5"))


@query("f4_overlap")
def _(t):
    """Turns of a conversation as raw chunks of one text, each led by the end of the turn before."""
    from ..operators.ordered import previous
    turns = t.conversations.select("conv_id", "turn", "text")
    led = previous(turns, ["conv_id"], ["turn"], F.right("text", F.lit(ch.OVERLAP_CHARS)), "before")
    same = F.col("text").startswith(F.left("before", F.lit(ch.SAME_START_CHARS)))
    joined = F.when(F.col("before").isNull() | same, F.col("text")).otherwise(F.concat(F.lit(ch.CONTINUED), "before", F.lit("\n\n"), "text"))
    return led.select("conv_id", "turn", F.md5(joined).alias("text_md5"))


from .registry import ORACLE  # noqa: E402

ORACLE["f4_overlap"] = r"""WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN prev IS NULL OR starts_with(text, left(right(prev, 600), 40)) THEN text ELSE '[...continued]' || chr(10) || right(prev, 600) || chr(10) || chr(10) || text END) AS text_md5 FROM p"""


@query("f6_keywords", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \t\n\r\f-]', ' ', 'g'), '[ \t\n\r\f]+'),
lambda x: length(x) > 3 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains([""" + ", ".join(literal(s) for s in STOP_WORDS) + r"""], x)) AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i, a FROM w),
u AS (SELECT doc_id, word AS keyword, 0 AS pair, 1.0 AS weight, i FROM e UNION ALL
SELECT doc_id, word || ' ' || a[i + 1], 1, 1.5, i FROM e WHERE i < len(a) AND length(word || ' ' || a[i + 1]) BETWEEN 9 AND 39),
s AS (SELECT doc_id, keyword, pair, CAST(sum(weight) AS DOUBLE) AS weight, min(i) AS first FROM u GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pair, first) AS rank, keyword, weight FROM s QUALIFY rank <= 8""")
def _(t):
    return ch.keywords(t.documents, "doc_id", "text")


@query("f7_boilerplate", r"""SELECT doc_id, length(trim(text, ' ' || chr(10))) < 5 OR regexp_matches(trim(text, ' ' || chr(10)), '(?i)^(home|back|next|previous|menu|navigation|click here|read more|learn more|see all)$')
OR regexp_matches(trim(text, ' ' || chr(10)), '(?i)^(copyright|all rights reserved|terms|privacy|cookie)') OR regexp_matches(trim(text, ' ' || chr(10)), '^\s*\|\s*$') AS boilerplate FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.is_boilerplate(F.col("text")).alias("boilerplate"))


@query("f8_semantic_chunks")
def _(t):
    return ch.semantic_chunks(t.documents.select("doc_id", "text")).select("doc_id", "chunk_index", "total_chunks", "section", F.md5("content").alias("content_md5"))


@query("f9_fingerprint_whole", rf"""SELECT doc_id, left(md5(regexp_replace(lower(text), {BLANKS}, ' ', 'g')), 16) AS fingerprint FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.fingerprint(F.col("text"), None).alias("fingerprint"))


@query("f9_distinct_pages", rf"""SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(regexp_replace(lower(text), {BLANKS}, ' ', 'g'))""")
def _(t):
    return dd.drop_near_duplicate_pages(t.documents, "text", ["doc_id"], "doc_id", prefix=None).select("doc_id")


@query("f10_duplicate_content", with_tables("entries", f"""SELECT content_hash, count(*) AS occurrence_count, count(DISTINCT source_url) AS source_count, {time_sql('min(created_at)')} AS first_seen,
min_by(id, (created_at, id)) AS first_id, md5(min(content)) AS preview_md5 FROM entries GROUP BY 1 HAVING count(*) > 1"""))
def _(t):
    return text_time(dd.duplicate_content(t.entries), "first_seen").withColumn("preview_md5", F.md5("content_preview")).drop("content_preview")


@query("f11_duplicate_urls", with_tables("entries", f"""SELECT source_url, count(*) AS entry_count, count(DISTINCT content_hash) AS unique_hashes, {time_sql('min(created_at)')} AS first_seen, {time_sql('max(updated_at)')} AS last_updated
FROM entries WHERE source_url <> '' GROUP BY 1 HAVING count(*) > coalesce(min(total_chunks), 0) + 1"""))
def _(t):
    return text_time(dd.duplicate_urls(t.entries), "first_seen", "last_updated")


@query("f12_similar_entries", with_tables("entries", """SELECT title, category, count(*) AS n, count(DISTINCT source_url) AS source_count, min_by(id, (created_at, id)) AS first_id FROM entries GROUP BY 1, 2 HAVING count(*) > 1"""))
def _(t):
    return dd.similar_entries(t.entries)


@query("f12b_duplicate_pages", "SELECT source AS url, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return dd.duplicate_pages(t.documents.withColumnRenamed("source", "url"), "url", "doc_id")


@query("f13_duplicate_summary", with_tables("entries registry", """, u AS (SELECT source_url FROM entries GROUP BY 1 HAVING count(*) > coalesce(min(total_chunks), 0) + 1),
c AS (SELECT count(*) AS n FROM entries GROUP BY content_hash HAVING count(*) > 1), p AS (SELECT url FROM registry GROUP BY 1 HAVING count(*) > 1), s AS (SELECT 1 FROM entries GROUP BY title, category HAVING count(*) > 1)
SELECT (SELECT count(*) FROM u) AS duplicate_url_groups, (SELECT count(*) FROM c) AS duplicate_content_groups, (SELECT count(*) FROM p) AS duplicate_page_groups, (SELECT count(*) FROM s) AS similar_entry_groups,
(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM c) AS total_duplicate_entries"""))
def _(t):
    return dd.duplicate_summary(t.entries, t.registry)


@query("f14_remove_duplicates", with_tables("entries", "SELECT id, category FROM entries QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) = 1"))
def _(t):
    return dd.remove_duplicates(t.entries).select("id", "category")


@query("f15_plan_documents", with_tables("entries", """SELECT e.id AS name, r.first AS existing_id, CASE WHEN r.first IS NULL THEN 'ingest' ELSE 'skip' END AS action FROM entries e LEFT JOIN
(SELECT content_hash, min_by(id, (created_at, id)) AS first FROM entries WHERE vector_id IS NOT NULL GROUP BY 1) r ON e.content_hash = r.content_hash"""))
def _(t):
    registry = t.entries.where(F.col("vector_id").isNotNull()).select("id", F.col("content_hash").alias("document_hash"), "created_at")
    arriving = t.entries.select(F.col("id").alias("name"), F.col("content_hash").alias("document_hash"))
    return dd.plan_documents(arriving, registry, "skip").drop("document_hash")


@query("f16_page_blocks", with_tables("page_tokens page_blocks page_content", "SELECT page_id, CAST(block_no AS INTEGER) AS block_no, tag, md5(text) AS text_md5 FROM shown"))
def _(t):
    return hm.extract_blocks(t.pages).select("page_id", "block_no", "tag", F.md5("text").alias("text_md5"))


@query("f16_page_titles", r"""SELECT page_id, trim(left(trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\s+', ' ', 'g')), 200)) AS title FROM pages""")
def _(t):
    return hm.extract_pages(t.pages, title_length=200).select("page_id", "title")


LINKS = r"""l AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS a FROM pages),
e AS (SELECT page_id, root, unnest(a) AS href, generate_subscripts(a, 1) - 1 AS link_no FROM l),
n AS (SELECT page_id, link_no, href, CASE WHEN starts_with(href, '/') THEN lower(root) || CASE WHEN length(href) > 1 AND href LIKE '%/' THEN left(href, length(href) - 1) ELSE href END END AS link FROM e)"""


@query("f17_links", f"WITH {LINKS} SELECT page_id, CAST(link_no AS INTEGER) AS link_no, href, link FROM n")
def _(t):
    return hm.extract_links(t.pages).select("page_id", "link_no", "href", "link")


@query("f17_normalised_urls", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(""" + "|".join(TRACKING_PARAMETERS) + r""")(=|$)')) AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS link FROM p""")
def _(t):
    return t.pages.select("page_id", urls.normalise(F.col("url")).alias("link"))


def _field_sql(labels, pattern, group):
    return rf"coalesce(list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, {literal(labels)})), lambda x: trim(regexp_extract(x, {literal(pattern)}, {group}))), lambda v: v <> '')[1], '')"


@query("f18_profiles", with_tables("page_tokens page_blocks", rf""", headed AS (SELECT *, count(*) FILTER (WHERE tag IN ({", ".join(literal(x) for x in HEADING_TAGS)})) OVER (PARTITION BY page_id ORDER BY pos) AS head_no FROM page_blocks),
parts AS (SELECT page_id, head_no, min_by(text, pos) AS head, string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE tag NOT IN ({", ".join(literal(x) for x in HEADING_TAGS)})) AS body FROM headed WHERE head_no > 0 GROUP BY 1, 2),
secs AS (SELECT page_id, string_agg('## ' || head || chr(10) || body || chr(10), chr(10) ORDER BY head_no) AS secs FROM parts WHERE regexp_matches(head, {literal(PROFILE_HEADING_PATTERN)}) AND body <> '' GROUP BY 1),
said AS (SELECT page_id, list(text ORDER BY pos) FILTER (WHERE tag = 'p') AS lines FROM page_blocks GROUP BY 1),
named AS (SELECT page_id, url, trim(regexp_replace(split_part(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '|', 1), {literal(PROFILE_TITLE_NOISE)}, '', 'g')) AS n FROM pages),
facts AS (SELECT d.page_id, url, CASE WHEN n <> '' THEN n ELSE {literal(PROFILE_NO_NAME)} END AS name, {", ".join(f"{_field_sql(*PROFILE_FIELDS[f])} AS {f}" for f in PROFILE_FIELDS)}
FROM named d LEFT JOIN said USING (page_id))
SELECT page_id, name, email, phone, designation, department, md5(regexp_replace(concat_ws(chr(10), '# Teacher Profile: ' || name, {", ".join(f"CASE WHEN {c} <> '' THEN '- **{label}**: ' || {c} END" for label, c in PROFILE_LINES)},
'- **Official Profile**: ' || url, secs), '^\s+|\s+$', '', 'g')) AS content_md5 FROM facts LEFT JOIN secs USING (page_id)"""))
def _(t):
    return hm.extract_profile(t.pages).select("page_id", "name", "email", "phone", "designation", "department", F.md5("content").alias("content_md5"))


JOINED = "lower(concat_ws(' ', url, html))"
PROFILE = f"(contains(url, 'profile.php') OR regexp_matches({JOINED}, '(?i){PROFILE_PATTERN}'))"


@query("f19_page_labels", f"""SELECT page_id, CASE WHEN {PROFILE} THEN 'faculty' ELSE {case_sql(JOINED, PAGE_RULES, PAGE_DEFAULT, 0)} END AS page_type,
CASE WHEN {PROFILE} THEN 'Faculty' ELSE {case_sql(JOINED, PAGE_RULES, PAGE_DEFAULT, 1)} END AS category,
CASE WHEN {PROFILE} THEN {case_sql(JOINED, PROFILE_DEPARTMENTS, ('general',), 0)} ELSE {case_sql(JOINED, PAGE_RULES, PAGE_DEFAULT, 2)} END AS department FROM pages""")
def _(t):
    return with_once(t.pages, "c", rl.classify_page(F.col("url"), F.lit(None).cast("string"), F.col("html"))).select("page_id", "c.page_type", "c.category", "c.department")


@query("f20_chunk_labels", f"""SELECT doc_id, {case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 0)} AS category, {case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 1)} AS namespace,
{case_sql('lower(text)', CHUNK_RULES, CHUNK_DEFAULT, 2)} AS page_type FROM documents""")
def _(t):
    return with_once(t.documents, "c", rl.classify_chunk(F.col("text"))).select("doc_id", "c.category", "c.namespace", "c.page_type")


@query("f21_namespaces", f"""SELECT p_partkey, {case_sql('trim(lower(p_name))', NAMESPACE_RULES, ('general',), 0)} AS namespace FROM part""")
def _(t):
    return t.part.select("p_partkey", rl.namespace_of(F.col("p_name")).alias("namespace"))


TITLE_WORDS = r"array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


@query("f22_breadcrumbs", r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) > 0 THEN 'Home > ' || array_to_string(list_transform(parts, lambda s: regexp_replace(array_to_string(list_transform(string_split(regexp_replace(s, '[-_]', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '), '(?i)\.(html?|php|aspx?)$', '')), ' > ') ELSE 'Home' END AS breadcrumb FROM p""")
def _(t):
    return t.pages.select("page_id", tx.breadcrumb(F.col("url")).alias("breadcrumb"))


@query("f22_file_titles", r"""WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages), q AS (SELECT page_id, regexp_replace(regexp_replace(CASE WHEN name = '' THEN 'Document' ELSE name END, '\.[^.]+$', ''), '[-_]', ' ', 'g') AS s FROM p)
SELECT page_id, """ + TITLE_WORDS.format("s") + r" AS title FROM q")
def _(t):
    return t.pages.select("page_id", tx.file_title(F.col("url")).alias("title"))


@query("f23_slugs", r"""SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || '  ' || p_type)), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 40) AS slug FROM part""")
def _(t):
    return t.part.select("p_partkey", tx.slug(F.concat_ws("  ", "p_name", "p_type")).alias("slug"))


@query("f5_near_duplicates")
def _(t):
    return dd.near_duplicates(t.documents, "doc_id", "text", prefix=None)
