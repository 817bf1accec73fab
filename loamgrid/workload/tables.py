"""The given tables, and the library's tables derived from them (once in Spark, once in SQL for the checks)."""
from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import BLOCK_TAGS
from ..operators.keyword_index import Bm25, KeywordIndex, build_index
from ..operators.markup import ENDS_PARAGRAPH
from ..session import shared_path
from ..sources.readers import read_table

AS_OF = datetime(2024, 1, 31)
_INDEXES: dict[tuple[str, str], dict[str, KeywordIndex]] = {}
TEXTS = ("documents", "pages", "conversations")     # tables with costly work per row


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.dir}/{name}.parquet"
        self.__dict__[name] = read_table(self.spark, path) if name in TEXTS else self.spark.read.parquet(path)
        return self.__dict__[name]

    def scratch(self, name: str) -> str:
        """A new folder on the storage all executors share."""
        return shared_path(self.spark, name)

    @cached_property
    def entries(self) -> DataFrame:
        """Documents as chunk rows; a labelled document counts as embedded."""
        labelled = self.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        d = self.documents.join(labelled, "doc_id", "left")
        n, doc = F.col("n_chars"), F.col("doc_id")
        created = F.timestamp_seconds(F.lit(1704067200) + doc * 420)
        updated = F.timestamp_seconds(F.lit(1704067200) + doc * 420 + n)
        return d.select(
            doc.cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
            F.col("lang").alias("category"),
            F.concat(F.lit("https://kb.example.org/"), "lang", F.lit("/"), F.floor(doc / 5).cast("string")).alias("source_url"),
            F.when(n < 500, "manual").when(n < 2000, "webpage").otherwise("document").alias("source_type"),
            F.when(n < 300, "notice").when(n < 1000, "policy").when(n < 3000, "academic").otherwise("general").alias("page_type"),
            F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("array<string>").alias("keywords"),
            (doc % 5).cast("int").alias("chunk_index"), (F.lit(1) + n % 4).cast("int").alias("total_chunks"),
            F.when(F.col("quality").isNotNull(), doc.cast("string")).alias("vector_id"), F.col("source").alias("namespace"),
            F.lit(None).cast("string").alias("embedding_model"),
            F.when(F.col("quality") == 1, F.timestamp_seconds(F.lit(1704153600) + doc * 420)).alias("last_scraped_at"),
            created.alias("created_at"), updated.alias("updated_at"),
            F.when(F.col("toxic") == 0, updated).alias("synced_at"))

    def keyword_index(self, kind: str) -> KeywordIndex:
        """The stored index of a kind: ``entries`` (fields by weight), ``english`` (the same, by stems) or ``bm25`` (texts); built once per session and folder."""
        made = _INDEXES.setdefault((self.spark.sparkContext.applicationId, self.dir), {})
        if kind not in made:
            if kind == "bm25":
                made[kind] = build_index(self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), fields={"content": 1.0}, scoring=Bm25())
            else:
                made[kind] = build_index(self.entries, english=kind == "english")      # as in the SQL, entries without a text are found by category and type
        return made[kind]

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").cast("string").alias("id"),
                                      F.concat(F.lit("src"), F.col("label").cast("string")).alias("namespace"), "embedding")

    @cached_property
    def registry(self) -> DataFrame:
        size = F.length("html")
        return self.pages.select(
            F.col("page_id").cast("string").alias("id"), "url", F.lit(None).cast("string").alias("title"),
            F.when(size < 4000, "failed").when(size < 9000, "pending").otherwise("success").alias("crawl_status"),
            F.floor(size / 2000).cast("int").alias("chunk_count"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("last_scraped_at"),
            F.when(size > 20000, F.timestamp_seconds(F.lit(1706659200))).alias("deleted_at"))

    @cached_property
    def log(self) -> DataFrame:
        v = F.col("value")
        return self.events.select(
            F.col("event_id").cast("string").alias("id"), F.concat_ws(" ", "event_type", "props").alias("query"), F.col("event_type").alias("intent"),
            F.when(v < 1, "no_data").when(v < 5, "low").when(v < 20, "medium").otherwise("high").alias("confidence"),
            v.alias("retrieval_ms"), (v * 2 + 1).alias("total_ms"), (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("cache_hit"),
            F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))

    @cached_property
    def chats(self) -> DataFrame:
        """User turns with their answers, as conversation rows."""
        from ..operators.requests import question_answer_pairs
        return chat_rows(question_answer_pairs(self.conversations))

    @cached_property
    def questions(self) -> DataFrame:
        """Benchmark passages as questions."""
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")


def chat_rows(pairs: DataFrame) -> DataFrame:
    from ..functions.messages import language
    conv, turn = F.col("conv_id"), F.col("turn")
    return pairs.select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("id"), F.concat(F.lit("s"), F.floor(conv / 3).cast("string")).alias("session_id"),
        "user_message", "bot_response", language(F.col("user_message")).alias("language"), F.lit(None).cast("string").alias("feedback"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 60).alias("created_at"))


def text_time(df: DataFrame, *names: str) -> DataFrame:
    """Times as text, so that checks do not depend on a client's time zone."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CTE = {
    "entries": r"""entries AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS content, lang AS category,
  'https://kb.example.org/' || lang || '/' || CAST(d.doc_id // 5 AS VARCHAR) AS source_url,
  CASE WHEN n_chars < 500 THEN 'manual' WHEN n_chars < 2000 THEN 'webpage' ELSE 'document' END AS source_type,
  CASE WHEN n_chars < 300 THEN 'notice' WHEN n_chars < 1000 THEN 'policy' WHEN n_chars < 3000 THEN 'academic' ELSE 'general' END AS page_type,
  sha256(text) AS content_hash, CAST(d.doc_id % 5 AS INTEGER) AS chunk_index, CAST(1 + n_chars % 4 AS INTEGER) AS total_chunks,
  CASE WHEN l.quality IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) END AS vector_id, source AS namespace,
  CASE WHEN l.quality = 1 THEN TIMESTAMP '2024-01-02 00:00:00' + to_seconds(d.doc_id * 420) END AS last_scraped_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 420) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 420 + n_chars) AS updated_at,
  CASE WHEN l.toxic = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 420 + n_chars) END AS synced_at
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)""",
    "vectors": r"""vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'src' || CAST(label AS VARCHAR) AS namespace, embedding FROM embeddings)""",
    "registry": r"""registry AS (SELECT CAST(page_id AS VARCHAR) AS id, url, CAST(NULL AS VARCHAR) AS title,
  CASE WHEN length(html) < 4000 THEN 'failed' WHEN length(html) < 9000 THEN 'pending' ELSE 'success' END AS crawl_status,
  CAST(length(html) // 2000 AS INTEGER) AS chunk_count, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 60) AS last_scraped_at,
  CASE WHEN length(html) > 20000 THEN TIMESTAMP '2024-01-31 00:00:00' END AS deleted_at FROM pages)""",
    "log": r"""log AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' ' || props AS query, event_type AS intent,
  CASE WHEN value < 1 THEN 'no_data' WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS confidence,
  value AS retrieval_ms, value * 2 + 1 AS total_ms, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 2 = 0 AS cache_hit,
  CAST(user_id AS VARCHAR) AS session_id, ts AS created_at FROM events)""",
    "chats": r"""turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  chats AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 's' || CAST(conv_id // 3 AS VARCHAR) AS session_id,
  text AS user_message, CASE WHEN next_role = 'assistant' THEN next_text END AS bot_response,
  CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]', '', 'g'))) / length(text) > 0.12
    THEN 'urdu' ELSE 'english' END AS language,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created_at FROM turns WHERE role = 'user')""",
}


# Pages as tokens, and the blocks of their content: an element ends where it is closed, where its container is, or (a paragraph) where a block begins.  Said for the markup of the given
# pages, whose content is in ``main`` or ``article``.
_PLAIN = r"trim(regexp_replace(replace(replace(replace(regexp_replace({0}, '&amp;?', '&', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g'))"
CTE["page_tokens"] = r"""marks AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]+>|[^<]+') AS m FROM pages),
  page_tokens AS (SELECT page_id, pos, lower(regexp_extract(s, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, s LIKE '</%' AS closes, CASE WHEN s NOT LIKE '<%' THEN s END AS text
  FROM (SELECT page_id, unnest(m) AS s, generate_subscripts(m, 1) AS pos FROM marks))"""
CTE["page_blocks"] = rf"""opened AS (SELECT page_id, min_by(pos, (CASE tag WHEN 'main' THEN 0 ELSE 1 END, pos)) AS c_at, min_by(tag, (CASE tag WHEN 'main' THEN 0 ELSE 1 END, pos)) AS c_tag
  FROM page_tokens WHERE tag IN ('main', 'article') AND NOT closes GROUP BY page_id),
  container AS (SELECT o.page_id, c_at, coalesce(min(pos) FILTER (WHERE closes AND tag = c_tag AND pos > c_at), max(pos) + 1) AS c_end FROM opened o JOIN page_tokens t ON t.page_id = o.page_id GROUP BY o.page_id, c_at),
  starts AS (SELECT t.page_id, pos, tag, c_end FROM page_tokens t JOIN container c ON t.page_id = c.page_id AND pos > c_at AND pos < c_end WHERE NOT closes AND tag IN ({", ".join(literal(x) for x in BLOCK_TAGS)})),
  ends AS (SELECT s.page_id, s.pos, s.tag, least(s.c_end, coalesce(min(t.pos), s.c_end)) AS end_at FROM starts s LEFT JOIN page_tokens t ON t.page_id = s.page_id AND t.pos > s.pos
    AND ((t.closes AND t.tag = s.tag) OR (s.tag = 'p' AND NOT t.closes AND t.tag IN ({", ".join(literal(x) for x in sorted(ENDS_PARAGRAPH))}))) GROUP BY s.page_id, s.pos, s.tag, s.c_end),
  page_blocks AS (SELECT e.page_id, e.pos, e.tag, {_PLAIN.format("coalesce(string_agg(t.text, '' ORDER BY t.pos), '')")} AS text
  FROM ends e LEFT JOIN page_tokens t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.end_at GROUP BY e.page_id, e.pos, e.tag)"""
CTE["page_content"] = r"""shown AS (SELECT page_id, pos, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS block_no
  FROM (SELECT * FROM page_blocks WHERE length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY pos) = 1)),
  page_content AS (SELECT p.page_id, url, html, regexp_replace(regexp_replace(coalesce(string_agg(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN chr(10) || '## ' || text || chr(10)
    WHEN tag = 'h4' THEN chr(10) || '### ' || text || chr(10) WHEN tag = 'li' THEN '• ' || text WHEN tag IN ('td', 'th') THEN '| ' || text ELSE text END, chr(10) ORDER BY pos), ''), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'),
    '^\s+|\s+$', '', 'g') AS content FROM pages p LEFT JOIN shown s ON s.page_id = p.page_id GROUP BY p.page_id, url, html)"""


def with_tables(names: str, sql: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + " " + sql


# SQL fragments used by many checks.
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def words_sql(column: str) -> str:
    return WORDS.format(column)


def time_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
