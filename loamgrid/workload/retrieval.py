"""Section E: retrieval, reranking, context."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions import text as tx
from ..functions.english import STOP_WORDS, stems_sql
from ..functions.vocabulary import (DEFAULT_NAMESPACE, RETRY_SYNONYMS, ROUTING_RULES, SYNONYM_TRIGGER_PATTERN, SYNONYMS, TYPE_BOOSTS)
from ..operators import context as cx
from ..operators import dedupe as dd
from ..operators import postings as ps
from ..operators import rerank as rr
from ..operators import retrieval as rt
from ..operators.keyword_index import keyword_hits, search_index
from ..plans.answer import answer_context
from ..session import cut_lineage
from .registry import query
from .tables import AS_OF, literal, with_tables, words_sql


def messages(t):
    return t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text")


MESSAGES = "m AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id, text FROM conversations)"


def centroids(t):
    """One question per label: the mean vector of the label, asked of every namespace, its own being primary."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg("x").alias("x")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("embedding"))     # one entry per dimension
    names = t.vectors.agg(F.array_sort(F.collect_set("namespace"))).scalar()                                  # one entry per namespace
    return (means.select(F.col("label").alias("query_id"), F.lit(0).alias("variant_no"), "embedding", F.explode(names).alias("namespace"))
            .withColumn("is_primary", F.col("namespace") == F.concat(F.lit("src"), F.col("query_id").cast("string"))))


SCORED = """parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), means AS (SELECT label, d, avg(x) AS x FROM parts GROUP BY 1, 2),
cent AS (SELECT label AS query_id, list(x ORDER BY d) AS q FROM means GROUP BY 1),
scored AS (SELECT c.query_id, v.id, v.namespace, list_cosine_similarity(c.q, CAST(v.embedding AS DOUBLE[])) AS s FROM cent c, vectors v),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY round(s, 9) DESC, id) AS r FROM scored),
hits AS (SELECT query_id, id, namespace, s, CASE WHEN namespace = 'src' || CAST(query_id AS VARCHAR) THEN s + 0.15 ELSE s END AS score FROM cut WHERE r <= 30 AND s >= 0.10)"""


@query("e1_routing", f"WITH {MESSAGES}, hit AS (" + " UNION ".join(
    f"SELECT query_id, {literal(ns)} AS namespace FROM m WHERE regexp_matches(lower(text), {literal('(?i)' + r.pattern)})" for r in ROUTING_RULES for ns in r.labels)
    + f" UNION SELECT query_id, '{DEFAULT_NAMESPACE}' FROM m) SELECT query_id, namespace, namespace <> '{DEFAULT_NAMESPACE}' AS is_primary FROM hit")
def _(t):
    return rt.route(messages(t)).drop("text")


@query("e2_vector_topk", with_tables("vectors", ", " + SCORED + " SELECT query_id, id, round(max(score), 6) AS score FROM hits GROUP BY 1, 2"))
def _(t):
    return rt.vector_topk(centroids(t), t.vectors).withColumn("score", F.round("score", 6))


@query("e2_vector_topk_blocked", with_tables("vectors", ", " + SCORED + " SELECT query_id, id, round(max(score), 6) AS score FROM hits GROUP BY 1, 2"))
def _(t):
    """The same with both sides in blocks, as for a question table too long to broadcast."""
    return rt.vector_topk(centroids(t), t.vectors, max_broadcast=0, block_vectors=200, block_queries=5).withColumn("score", F.round("score", 6))


KEYWORD = f"""uses AS (SELECT id, 1.0 AS w, unnest({words_sql('title')}) AS term FROM entries UNION ALL SELECT id, 0.4, unnest({words_sql('category')}) FROM entries
UNION ALL SELECT id, 0.4, unnest({words_sql('page_type')}) FROM entries UNION ALL SELECT id, 0.2, unnest({words_sql('content')}) FROM entries),
q AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql('text')})) AS term FROM benchmark),
sums AS (SELECT query_id, id, CAST(sum(w) AS DOUBLE) AS s FROM uses JOIN q USING (term) GROUP BY 1, 2),
kw AS (SELECT query_id, id, s / (s + 1.0) AS keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (s + 1.0), 12) DESC, id) AS rank FROM sums QUALIFY rank <= 40)"""


@query("e3_keyword_topk", with_tables("entries", ", " + KEYWORD + " SELECT query_id, id, rank, round(keyword_score, 9) AS keyword_score FROM kw"))
def _(t):
    return keyword_hits(t.keyword_index("entries"), t.questions).withColumn("keyword_score", F.round("keyword_score", 9))


STEMMED = f"""uses AS (SELECT id, 1.0 AS w, unnest({words_sql('title')}) AS term FROM entries WHERE content_hash IS NOT NULL UNION ALL SELECT id, 0.4, unnest({words_sql('category')}) FROM entries
UNION ALL SELECT id, 0.4, unnest({words_sql('page_type')}) FROM entries UNION ALL SELECT id, 0.2, unnest({words_sql('content')}) FROM entries),
asked AS (SELECT item_id AS query_id, unnest({words_sql('text')}) AS term FROM benchmark), vocabulary AS (SELECT term FROM uses UNION SELECT term FROM asked),
{stems_sql('vocabulary', 'term')}, kept AS (SELECT word AS term, stem FROM stems WHERE word NOT IN ({', '.join(literal(w) for w in STOP_WORDS)})),
su AS (SELECT id, w, stem FROM uses JOIN kept USING (term)), sq AS (SELECT DISTINCT query_id, stem FROM asked JOIN kept USING (term)),
sums AS (SELECT query_id, id, CAST(sum(w) AS DOUBLE) AS s FROM su JOIN sq USING (stem) GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank, round(s / (s + 1.0), 9) AS keyword_score FROM sums QUALIFY rank <= 40"""


@query("e3_english_topk", with_tables("entries", ", " + STEMMED))
def _(t):
    """By stems of English words, without stop words."""
    return keyword_hits(t.keyword_index("english"), t.questions).withColumn("keyword_score", F.round("keyword_score", 9))


@query("e3_postings", f"""WITH u AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY 1, 2)
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM p GROUP BY term""")
def _(t):
    p = ps.postings(t.documents, "doc_id", {"text": 0.2})
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@query("e3b_bm25", f"""WITH d AS (SELECT doc_id AS id, {words_sql('text')} AS a FROM documents), s AS (SELECT count(*) AS n, avg(len(a)) AS avgdl FROM d),
u AS (SELECT id, len(a) AS dl, unnest(a) AS term FROM d), q AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql('text')})) AS term FROM benchmark),
c AS (SELECT id, dl, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
g AS (SELECT c.id, c.term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS gain FROM c JOIN f USING (term), s),
t AS (SELECT query_id, id, sum(gain) AS x FROM g JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, id) AS rank, round(x, 6) AS bm25_score FROM t QUALIFY rank <= 40""")
def _(t):
    return search_index(t.keyword_index("bm25"), t.questions).select("query_id", "id", "rank", F.round("score", 6).alias("bm25_score"))


@query("e4_keyword_or_recent", with_tables("entries", f""", uses AS (SELECT id, unnest({words_sql('title')}) AS term FROM entries), q AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql('text')})) AS term FROM benchmark),
sums AS (SELECT query_id, id, CAST(count(*) AS DOUBLE) AS s FROM uses JOIN q USING (term) GROUP BY 1, 2),
kw AS (SELECT query_id, id, 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (s + 1.0), 12) DESC, id) AS rank FROM sums QUALIFY rank <= 15),
new AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS rank FROM entries QUALIFY rank <= 5)
SELECT * FROM kw UNION ALL SELECT item_id, id, 0.5, rank FROM benchmark, new WHERE item_id NOT IN (SELECT query_id FROM kw)"""))
def _(t):
    """Title words only."""
    hits = ps.keyword_topk(t.questions, ps.term_uses(t.entries, fields={"title": 1.0}), 15)
    return ps.keyword_or_recent(t.questions, t.entries, hits).drop("keyword_score")


FUSED = """vr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM (SELECT query_id, id, max(score) AS score FROM hits GROUP BY 1, 2)),
kr AS (SELECT query_id, id, keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 9) DESC, id) AS r FROM kw),
fused AS (SELECT query_id, id, max(score) AS score, max(keyword_score) AS keyword_score, sum(part) AS rrf_score FROM (SELECT query_id, id, score, NULL AS keyword_score, 1.0 / (60 + r) AS part FROM vr
UNION ALL SELECT query_id, id, NULL, keyword_score, 1.0 / (60 + r) FROM kr) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, id) AS rank FROM fused)"""


def fused(t):
    """Vector hits of the label questions fused with keyword hits of the benchmark questions of the same number."""
    return rt.rrf(rt.vector_topk(centroids(t), t.vectors), keyword_hits(t.keyword_index("entries"), t.questions))


@query("e5_rank_fusion", with_tables("entries vectors", ", " + SCORED + ", " + KEYWORD + ", " + FUSED + " SELECT query_id, id, round(rrf_score, 9) AS rrf_score, rank FROM ranked"))
def _(t):
    return fused(t).select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def _keyword_rows(t):
    hits = keyword_hits(t.keyword_index("entries"), t.questions)
    ranked = hits.withColumns({"score": F.lit(None).cast("double"), "rrf_score": F.lit(1.0) / (F.lit(60) + F.col("rank"))})
    shown = t.entries.select("id", "title", "content", "source_url", "page_type", "category", "updated_at", "content_hash")
    return ranked.join(shown, "id")


@query("e6_dedupe_ranked")
def _(t):
    return dd.dedupe_ranked(_keyword_rows(t), prefix=None).select("query_id", "id", "rank")


@query("e7_citations", with_tables("entries", ", " + KEYWORD + """, f AS (SELECT query_id, rank, title, source_url AS url, page_type, category FROM kw JOIN entries USING (id) WHERE rank <= 10 AND source_url LIKE 'http%'
QUALIFY row_number() OVER (PARTITION BY query_id, source_url ORDER BY rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_no, title, url, page_type, category FROM f"""))
def _(t):
    return rt.citations(_keyword_rows(t))


LEVEL = """CASE WHEN n = 0 THEN 'no_data' WHEN n >= 5 AND top > 0.014 AND ev THEN 'high' WHEN n >= 5 AND top > 0.014 THEN 'low' WHEN n >= 2 AND top > 0.006 THEN 'medium' ELSE 'low' END"""


@query("e8_confidence", with_tables("entries vectors", ", " + SCORED + ", " + KEYWORD + ", " + FUSED + f""", g AS (SELECT query_id, count(*) AS n, min_by(rrf_score, rank) AS top, bool_or(rank <= 5 AND coalesce(keyword_score, 0) > 0) AS ev FROM ranked GROUP BY 1),
h AS (SELECT item_id AS query_id, coalesce(n, 0) AS n, coalesce(top, 0) AS top, coalesce(ev, FALSE) AS ev FROM benchmark LEFT JOIN g ON item_id = query_id)
SELECT query_id, n AS n_rows, round(top, 9) AS top_score, ev AS keyword_evidence, {LEVEL} AS confidence FROM h"""))
def _(t):
    return rt.confidence(t.questions, fused(t)).withColumn("top_score", F.round("top_score", 9))


def _rerank_input(t):
    return _keyword_rows(t).withColumn("keywords", F.array("category", "page_type")).join(t.questions.withColumnRenamed("text", "query_text"), "query_id")


TOKENS = "list_distinct(list_filter({0}, lambda x: length(x) > 2))"
BOOST = "CASE " + " ".join(f"WHEN regexp_matches(qt, {literal('(?i)' + b.pattern)}) AND page_type IN ({', '.join(literal(p) for p in b.page_types)}) THEN {b.weight}" for b in TYPE_BOOSTS) + " ELSE 0.0 END"
RERANKED = f"""x AS (SELECT kw.query_id, kw.id, kw.rank, e.title, e.content, e.category, e.page_type, e.updated_at, b.text AS qt, 1.0 / (60 + kw.rank) AS rrf FROM kw JOIN entries e USING (id) JOIN benchmark b ON b.item_id = kw.query_id),
y AS (SELECT *, {TOKENS.format(words_sql('qt'))} AS tk, {TOKENS.format(words_sql('content'))} AS ct, {TOKENS.format(words_sql('title'))} AS tt, trim(lower(qt)) AS ql FROM x),
z AS (SELECT *, len(list_intersect(tk, ct)) / len(tk) AS fc, len(list_intersect(tk, tt)) / len(tk) * 1.8 AS ft, array_to_string(string_split(ql, ' ')[1:3], ' ') AS op,
len(list_intersect(list_filter(tk, lambda x: length(x) > 3), [category, page_type])) / len(tk) * 0.3 AS fk, {BOOST} AS fb,
CASE WHEN regexp_matches(qt, '(?i)latest|recent|today|new|current|this week|this month|2024|2025|2026') THEN CASE WHEN updated_at >= TIMESTAMP '2024-01-30' THEN 0.3 WHEN updated_at >= TIMESTAMP '2024-01-24' THEN 0.2
WHEN updated_at >= TIMESTAMP '2024-01-01' THEN 0.1 ELSE 0.0 END ELSE 0.0 END AS fr FROM y),
scores AS (SELECT query_id, id, title, category, content, page_type, least(rrf * 10, 1.0) * 0.25 + fc * 0.20 + ft * 0.20 + CASE WHEN contains(lower(content), ql) THEN 0.35 WHEN length(op) > 6 AND contains(lower(content), op) THEN 0.15 ELSE 0.0 END * 0.15
+ fk * 0.10 + fb * 0.07 + fr * 0.03 AS score FROM z),
rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS final_rank FROM scores QUALIFY final_rank <= 10)"""


@query("e9_rerank", with_tables("entries", ", " + KEYWORD + ", " + RERANKED + " SELECT query_id, id, final_rank, round(score, 4) AS rerank_score FROM rer"))
def _(t):
    return rr.rerank(_rerank_input(t), AS_OF).select("query_id", "id", "final_rank", F.round("rerank_score", 4).alias("rerank_score"))


@query("e9a_term_overlap", f"""SELECT doc_id, round(coalesce(len(list_intersect({TOKENS.format(words_sql("split_part(text, chr(10), 1)"))}, {TOKENS.format(words_sql('lang || chr(32) || text'))})) / nullif(len({TOKENS.format(words_sql("split_part(text, chr(10), 1)"))}), 0), 0), 9) AS share FROM documents""")
def _(t):
    first = tx.query_tokens(F.substring_index("text", "\n", 1))
    return t.documents.select("doc_id", F.round(rr.overlap(first, tx.query_tokens(F.concat_ws(" ", "lang", "text"))), 9).alias("share"))


@query("e9b_phrase_bonus", f"""WITH p AS (SELECT doc_id, trim(lower(split_part(text, '.', 1))) AS q, lower(text) AS l FROM documents), o AS (SELECT *, array_to_string(string_split(q, ' ')[1:3], ' ') AS op FROM p)
SELECT doc_id, CASE WHEN contains(l, q || ' the') THEN 0.35 WHEN length(op) > 6 AND contains(l, op) THEN 0.15 ELSE 0.0 END AS bonus FROM (SELECT doc_id, q, l, array_to_string(string_split(q || ' the', ' ')[1:3], ' ') AS op FROM p)""")
def _(t):
    phrase = F.concat(F.trim(F.lower(F.substring_index("text", ".", 1))), F.lit(" the"))
    return t.documents.select("doc_id", rr.phrase_bonus(phrase, F.col("text")).alias("bonus"))


@query("e9c_type_boost", f"""WITH x AS (SELECT doc_id, text AS qt, CASE WHEN lang = 'en' THEN 'notice' WHEN lang = 'de' THEN 'policy' ELSE 'academic' END AS page_type FROM documents) SELECT doc_id, {BOOST} AS boost FROM x""")
def _(t):
    kind = F.when(F.col("lang") == "en", "notice").when(F.col("lang") == "de", "policy").otherwise("academic")
    return t.documents.select("doc_id", rr.type_boost(F.col("text"), kind).alias("boost"))


@query("e9d_recency_boost", with_tables("entries", """SELECT id, CASE WHEN regexp_matches(content, '(?i)latest|recent|today|new|current|this week|this month|2024|2025|2026') THEN CASE WHEN updated_at >= TIMESTAMP '2024-01-30' THEN 0.3 WHEN updated_at >= TIMESTAMP '2024-01-24' THEN 0.2
WHEN updated_at >= TIMESTAMP '2024-01-01' THEN 0.1 ELSE 0.0 END ELSE 0.0 END AS boost FROM entries"""))
def _(t):
    return t.entries.select("id", rr.recency_boost(F.col("content"), F.col("updated_at"), AS_OF).alias("boost"))


@query("e9e_keyword_boost", f"""WITH x AS (SELECT doc_id, {TOKENS.format(words_sql("split_part(text, chr(10), 1)"))} AS a, {words_sql("split_part(text, chr(10), 2)")} AS k FROM documents)
SELECT doc_id, round(coalesce(len(list_intersect(list_filter(a, lambda x: length(x) > 3), k)) / nullif(len(a), 0), 0) * 0.3, 9) AS boost FROM x""")
def _(t):
    first, second = F.get(F.split("text", "\n"), F.lit(0)), F.get(F.split("text", "\n"), F.lit(1))
    return t.documents.select("doc_id", F.round(rr.keyword_boost(tx.query_tokens(first), tx.words(second)), 9).alias("boost"))


@query("e10_external_rerank", with_tables("entries", ", " + KEYWORD + """, g AS (SELECT query_id, kw.id, kw.rank, coalesce(CASE WHEN l.quality IS NOT NULL THEN l.quality * 6.0 + l.toxic * 3.0 END, 0) / 10.0 AS rerank_score
FROM kw LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON kw.id = CAST(l.doc_id AS VARCHAR) WHERE kw.rank <= 10)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM g QUALIFY final_rank <= 5"""))
def _(t):
    hits = keyword_hits(t.keyword_index("entries"), t.questions)
    marks = t.labels.groupBy("doc_id").agg((F.max("quality") * 6.0 + F.max("toxic") * 3.0).alias("score"))
    scores = marks.join(hits.select("query_id", "id"), F.col("doc_id").cast("string") == F.col("id")).select("query_id", "id", "score")
    return rr.rerank_external(hits, scores).select("query_id", "id", "rerank_score", "final_rank")


def _expand_sql(column, synonyms, skip):
    low = f"lower({column})"
    arms = []
    for term, alternatives in synonyms:
        for a in alternatives:
            test = f"contains({low}, {literal(term)})" + (f" AND NOT contains({low}, {literal(a)})" if skip else "")
            arms.append(f"CASE WHEN {test} THEN {literal(a)} END")
    return f"concat_ws(' ', {column}, {', '.join(arms)})"


@query("e11_synonym_expansion", f"SELECT doc_id, md5({_expand_sql('text', SYNONYMS, True)}) AS expanded_md5, md5({_expand_sql('text', RETRY_SYNONYMS, False)}) AS retry_md5 FROM documents")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.md5(rt.expand_synonyms(text)).alias("expanded_md5"), F.md5(rt.expand_synonyms(text, RETRY_SYNONYMS, False)).alias("retry_md5"))


@query("e12_variants", f"""WITH {MESSAGES}, b AS (SELECT query_id, 0 AS variant_no, trim(text) AS text FROM m UNION ALL SELECT query_id, 1, text || ' again' FROM m),
x AS (SELECT query_id, 1000 AS variant_no, {_expand_sql('trim(text)', SYNONYMS, True)} AS text FROM m WHERE regexp_matches(text, '(?i)\\b(le|la|en|the|cs|bba)\\b'))
SELECT query_id, variant_no, md5(text) AS text_md5 FROM (SELECT * FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = x.query_id AND b.text = x.text))""")
def _(t):
    """Lengthened copies stand for given paraphrases; the trigger words are common ones."""
    q = messages(t)
    given = q.select("query_id", F.lit(1).alias("variant_no"), F.concat("text", F.lit(" again")).alias("text"))
    trigger = r"(?<![A-Za-z0-9_])(le|la|en|the|cs|bba)(?![A-Za-z0-9_])"
    return rt.variants(q, given, trigger=trigger).select("query_id", "variant_no", F.md5("text").alias("text_md5"))


@query("e14_result_size", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)all|list|multiple|who are|teachers|faculty|professors|staff|courses|programs') THEN 12 ELSE 10 END AS n FROM documents""")
def _(t):
    return t.documents.select("doc_id", ms.result_size(F.col("text")).alias("n"))


@query("e15_context", with_tables("entries", ", " + KEYWORD + """, f AS (SELECT kw.query_id, kw.rank, e.title, e.category, e.source_url, e.content FROM kw JOIN entries e USING (id) WHERE kw.rank <= 10
QUALIFY row_number() OVER (PARTITION BY kw.query_id, regexp_replace(lower(content), '[ \\t\\n\\r]', '', 'g') ORDER BY kw.rank) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM f),
e AS (SELECT query_id, no, '--- Context ' || CAST(no AS VARCHAR) || ' [Source: ' || title || ' | ' || category || ' | ' || source_url || '] ---' || chr(10) || content AS entry FROM n),
s AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY no) AS upto FROM e), r AS (SELECT *, CAST(6000 - (upto - length(entry)) AS BIGINT) AS rest FROM s),
c AS (SELECT query_id, no, CASE WHEN upto <= 6000 THEN entry WHEN rest > 200 THEN CASE WHEN regexp_extract(left(entry, rest), '(?s)^(.*[.?])', 1) <> '' THEN regexp_extract(left(entry, rest), '(?s)^(.*[.?])', 1)
ELSE left(entry, rest) END || chr(10) || '[truncated for context budget]' END AS part FROM r)
SELECT query_id, CAST(count(*) AS INTEGER) AS entries, md5(string_agg(part, chr(10) || chr(10) ORDER BY no)) AS context_md5 FROM c WHERE part IS NOT NULL GROUP BY query_id"""))
def _(t):
    """A budget of 6000 characters, so that it binds; beginnings are compared over the whole text."""
    rows = _keyword_rows(t).where("rank <= 10").withColumn("final_rank", F.col("rank"))
    return cx.build_context(rows, 6000, prefix=None).select("query_id", "entries", F.md5("context").alias("context_md5"))


@query("e16_coverage_test", with_tables("vectors", ", " + SCORED + """, five AS (SELECT query_id, namespace, s FROM cut WHERE r <= 5), g AS (SELECT query_id, namespace, count(*) AS hits, max(s) AS top FROM five GROUP BY 1, 2)
SELECT CAST(query_id AS VARCHAR) || '-' || namespace AS test_id, namespace, hits, round(top, 2) AS top_score, CASE WHEN top >= 0.75 THEN 'high' WHEN top >= 0.55 THEN 'medium' WHEN top >= 0.35 THEN 'low' ELSE 'none' END AS confidence, top >= 0.55 AS passed FROM g"""))
def _(t):
    tests = centroids(t).select(F.concat_ws("-", F.col("query_id").cast("string"), "namespace").alias("test_id"), "namespace", "embedding")
    return rt.coverage_test(tests, t.vectors)


@query("e17_retrieval_trace", with_tables("entries", ", " + KEYWORD + ", " + RERANKED + """, sizes AS (SELECT query_id, count(*) AS candidates FROM kw GROUP BY 1)
SELECT rer.query_id, final_rank, rer.id, 0.0 AS score, round(kw.keyword_score, 6) AS keyword_score, round(1.0 / (60 + kw.rank), 6) AS rrf_score, round(rer.score, 4) AS rerank_score, candidates
FROM rer JOIN kw ON kw.query_id = rer.query_id AND kw.id = rer.id JOIN sizes ON sizes.query_id = rer.query_id"""))
def _(t):
    rows = cut_lineage(_rerank_input(t))
    trace = rt.explain_retrieval(t.questions, rows, rr.rerank(rows, AS_OF))
    return trace.withColumns({"keyword_score": F.round("keyword_score", 6), "rrf_score": F.round("rrf_score", 6), "rerank_score": F.round("rerank_score", 4)})


@query("e18_text_vectors")
def _(t):
    out = rt.embed_text(t.documents.select("doc_id", "text"))
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("squared_length"))


@query("e13_staged_retrieval")
def _(t):
    """Questions against documents through all four stages, on hashed word vectors in the documents' own namespaces."""
    chunks = t.entries
    vectors = cut_lineage(rt.embed_text(chunks.select("id", F.lit(DEFAULT_NAMESPACE).alias("namespace"), "content"), "content").select("id", "namespace", "embedding"))
    rows, outcome = rt.retrieve_staged(t.questions, chunks, vectors, t.keyword_index("entries"), dedupe_prefix=None)
    return outcome.select("query_id", "stage", "confidence", "n_rows")


@query("e_answer_context")
def _(t):
    """The whole way from questions to context."""
    out = answer_context(t.questions, t.entries.withColumn("namespace", F.lit(DEFAULT_NAMESPACE)), AS_OF, index=t.keyword_index("entries"))
    return out["context"].select("query_id", "entries", F.length("context").alias("chars"))
