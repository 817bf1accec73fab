"""Section H: messages and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions import text as tx
from ..functions.vocabulary import FILLER_WORDS, INTENT_KEYWORDS, PERSONA_PATTERNS
from ..operators import requests as rq
from .registry import query
from .tables import AS_OF, literal, text_time, with_tables, words_sql

ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


@query("h1_language", rf"SELECT conv_id, turn, CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '{ARABIC}', '', 'g'))) / length(text) > 0.12 THEN 'urdu' ELSE 'english' END AS language FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", ms.language(F.col("text")).alias("language"))


@query("h2_right_to_left", rf"SELECT doc_id, regexp_matches(text, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]') AS rtl FROM documents")
def _(t):
    return t.documents.select("doc_id", ms.has_rtl(F.col("text")).alias("rtl"))


INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {literal(k)})" for k in words) + f" THEN {literal(name)}" for name, words in INTENT_KEYWORDS) + " ELSE 'general_question' END"


@query("h3_intent", f"SELECT conv_id, turn, {INTENT} AS intent FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", ms.intent(F.col("text")).alias("intent"))


@query("h4_persona", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {literal(p)}) THEN {literal(n)}" for n, p in PERSONA_PATTERNS) + " END AS persona FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", ms.persona(F.col("text")).alias("persona"))


@query("h5_flags", r"""SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^(hey|hi|hello|salam|assalam|dear|helo|hii|howdy|good morning|good evening|good afternoon)[\s!.،]*$') AS greeting,
contains(lower(text), 'wrong') OR contains(lower(text), 'incorrect') OR contains(lower(text), 'غلط') OR contains(lower(text), 'درست نہیں') AS correction,
regexp_matches(text, '(?i)don''t have info|don''t know|not found|معذرت|پاس معلومات نہیں|تصدیق شدہ معلومات نہیں') AS negative FROM conversations""")
def _(t):
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", ms.is_greeting(x).alias("greeting"), ms.is_correction(x).alias("correction"), ms.is_negative_answer(x).alias("negative"))


@query("h6_correction_text", r"""SELECT doc_id, CASE WHEN contains(lower(text), ' of ') THEN CASE WHEN trim(split_part(text, ' of ', 2), ' ' || chr(10)) = '' THEN 'Updated' ELSE trim(split_part(text, ' of ', 2), ' ' || chr(10)) END
WHEN contains(lower(text), ' de ') THEN CASE WHEN trim(split_part(text, ' de ', 2), ' ' || chr(10)) = '' THEN 'Updated' ELSE trim(split_part(text, ' de ', 2), ' ' || chr(10)) END END AS correction FROM documents""")
def _(t):
    """Common words as trigger words."""
    return t.documents.select("doc_id", ms.correction_text(F.col("text"), (" of ", " de ")).alias("correction"))


@query("h7_last_turns", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM r WHERE rn <= 4 GROUP BY conv_id""")
def _(t):
    return rq.last_turns(t.conversations, 4).select("conv_id", "n_turns", F.md5("history").alias("history_md5"))


@query("h7_question_answer_pairs", with_tables("chats", "SELECT conv_id, turn, md5(text) AS user_md5, CASE WHEN next_role = 'assistant' THEN md5(next_text) END AS bot_md5 FROM turns WHERE role = 'user'"))
def _(t):
    return rq.question_answer_pairs(t.conversations).select("conv_id", "turn", F.md5("user_message").alias("user_md5"), F.md5("bot_response").alias("bot_md5"))


@query("h8_cache_key", r"""WITH x AS (SELECT event_id, event_type, 'What is the ' || event_type || ' of ' || CAST(user_id AS VARCHAR) || '?' AS q FROM events)
SELECT event_id, 'answers:' || md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(q), '[?!.,،؟]', '', 'g'), '\b(""" + "|".join(FILLER_WORDS) + r""")\b', '', 'g'), '[ \t\n\r]+', ' ', 'g')) || '::' || event_type) AS cache_key FROM x""")
def _(t):
    q = F.concat(F.lit("What is the "), "event_type", F.lit(" of "), F.col("user_id").cast("string"), F.lit("?"))
    return t.events.select("event_id", ms.cache_key(q, F.col("event_type")).alias("cache_key"))


@query("h9_answer_parts", r"""SELECT event_id, event_type AS answer, CASE WHEN value < 5 THEN '' ELSE event_type || ',more' END AS suggestions FROM events""")
def _(t):
    """Answers with suggestions after the marker; small values get malformed JSON."""
    tail = F.when(F.col("value") < 5, F.lit("{broken")).otherwise(F.concat(F.lit('{"suggestions": ["'), "event_type", F.lit('", "more"]}')))
    raw = F.concat("event_type", F.lit(" \n[METADATA] "), tail)
    return t.events.select("event_id", ms.answer_text(raw).alias("answer"), F.array_join(ms.answer_suggestions(raw), ",").alias("suggestions"))


@query("h10_tokens", f"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter({words_sql('text')}, lambda x: length(x) > 2))), ' ')) AS tokens_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.array_join(F.array_sort(tx.query_tokens(F.col("text"))), " ")).alias("tokens_md5"))


@query("h11_shingle_jaccard", r"""WITH x AS (SELECT conv_id, turn, lower(text) AS a, lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS b FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(length(a) - 3, 1)), lambda i: substr(a, i, 5))) AS sa, list_distinct(list_transform(range(1, greatest(length(b) - 3, 1)), lambda i: substr(b, i, 5))) AS sb FROM x),
c AS (SELECT conv_id, turn, len(list_intersect(sa, sb)) AS i, len(sa) + len(sb) AS u FROM s)
SELECT conv_id, turn, round(CASE WHEN u = 0 THEN 1.0 ELSE i / (u - i) END, 9) AS similarity FROM c""")
def _(t):
    from ..operators.ordered import previous
    pairs = previous(t.conversations, ["conv_id"], ["turn"], F.col("text"), "next_text", following=True)
    staged = pairs.withColumns({"_a": tx.shingles(F.col("text")), "_b": tx.shingles(F.col("next_text"))})
    return staged.select("conv_id", "turn", F.round(tx.jaccard(F.col("_a"), F.col("_b")), 9).alias("similarity"))


@query("h12_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.sha256(F.col("text")).alias("sha"), F.md5("text").alias("md"))


@query("h13_previews", "SELECT doc_id, left(text, 150) AS short, md5(left(text, 6000)) AS long_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.preview(F.col("text"), 150).alias("short"), F.md5(tx.preview(F.col("text"), 6000)).alias("long_md5"))


@query("h14_defaults", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN upper(s_name) END, 'none') AS label, round(s_acctbal, 1) AS balance, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'high' END AS band FROM supplier")
def _(t):
    b = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", F.coalesce(F.when(b > 0, F.upper("s_name")), F.lit("none")).alias("label"), F.round(b, 1).alias("balance"),
                             F.when(b < 0, "debt").when(b < 1000, "low").otherwise("high").alias("band"))


@query("h15_dates", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day, CAST(date_diff('day', date_trunc('day', o_orderdate), DATE '2024-01-31') AS INTEGER) AS age_days FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format(F.date_trunc("day", "o_orderdate"), "yyyy-MM-dd").alias("day"), F.datediff(F.lit(AS_OF.date()), "o_orderdate").alias("age_days"))


@query("h16_json_map", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS kinds FROM c GROUP BY user_id""")
def _(t):
    """Counts per user as a JSON map, written and read back."""
    from ..operators.analytics import distribution
    text = distribution(t.events, "user_id", "event_type").select("user_id", F.to_json("distribution").alias("j"))
    read = text.select("user_id", F.from_json("j", "map<string,bigint>").alias("m"))
    return read.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("m").alias("kinds"))


@query("h17_clamp_percent", "SELECT event_id, least(greatest(value, 1.0), 100.0) AS clamped, round(100.0 * least(greatest(value, 1.0), 100.0) / 100.0, 1) AS percentage FROM events")
def _(t):
    c = ms.clamp(F.col("value"), 1.0, 100.0)
    return t.events.select("event_id", c.alias("clamped"), ms.percent(c, F.lit(100.0)).alias("percentage"))
