"""Column functions over user messages and answers."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip
from .vocabulary import (CORRECTION_WORDS, FILLER_WORDS, GREETING_PATTERN, INTENT_KEYWORDS, LIST_QUERY_PATTERN,
                         NEGATIVE_ANSWER_PATTERN, PERSONA_PATTERNS)


def language(col: Column, threshold: float = 0.12) -> Column:
    """``urdu`` if more than ``threshold`` of the characters are of the Arabic script, else ``english``."""
    others = F.regexp_replace(col, r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]", "")
    share = F.try_divide((F.length(col) - F.length(others)).cast("double"), F.length(col).cast("double"))
    return F.when(F.coalesce(share > threshold, F.lit(False)), "urdu").otherwise("english")


def has_rtl(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(
        r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def intent(col: Column, keyword_lists: Sequence[tuple[str, Sequence[str]]] = INTENT_KEYWORDS,
           default: str = "general_question") -> Column:
    """First list with a keyword that occurs as a substring."""
    low = F.lower(col)
    label = F.lit(default)
    for name, keywords in reversed(keyword_lists):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(low, F.lit(keyword))
        label = F.when(hit, F.lit(name)).otherwise(label)
    return label


def persona(col: Column, patterns: Sequence[tuple[str, str]] = PERSONA_PATTERNS) -> Column:
    low, label = F.lower(col), F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        label = F.when(low.rlike(pattern), F.lit(name)).otherwise(label)
    return label


def is_greeting(col: Column) -> Column:
    return strip(col).rlike(GREETING_PATTERN)


def is_negative_answer(col: Column) -> Column:
    return col.rlike(NEGATIVE_ANSWER_PATTERN)


def is_list_query(col: Column) -> Column:
    return col.rlike(LIST_QUERY_PATTERN)


def result_size(col: Column, usual: int = 10, listing: int = 12) -> Column:
    return F.when(is_list_query(col), F.lit(listing)).otherwise(F.lit(usual))


def is_correction(col: Column, trigger_words: Sequence[str] = CORRECTION_WORDS) -> Column:
    low, hit = F.lower(col), F.lit(False)
    for word in trigger_words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def correction_text(col: Column, trigger_words: Sequence[str] = CORRECTION_WORDS, default: str = "Updated") -> Column:
    """What stands between the first listed trigger word and its next occurrence; null for other messages."""
    low = F.lower(col)
    after = F.lit(None).cast("string")
    for word in reversed(trigger_words):
        tail = F.get(F.split(col, F.lit(r"\Q" + word + r"\E"), -1), F.lit(1))
        after = F.when(F.contains(low, F.lit(word)), F.coalesce(tail, F.lit(""))).otherwise(after)
    cleaned = strip(after)
    return F.when(cleaned == "", F.lit(default)).otherwise(cleaned)


def cache_key(col: Column, intent_col: Column | None = None, prefix: str = "answers:") -> Column:
    """Stable key of a question: lower case, punctuation and filler words dropped, blanks collapsed, MD5."""
    text = F.regexp_replace(F.lower(col), r"[?!.,،؟]", "")
    text = F.regexp_replace(text, r"(?<!\w)(" + "|".join(FILLER_WORDS) + r")(?!\w)", "")
    text = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    if intent_col is not None:
        text = F.concat(text, F.when(F.coalesce(intent_col, F.lit("")) != "", F.concat(F.lit("::"), intent_col)).otherwise(""))
    return F.concat(F.lit(prefix), F.md5(text))


def answer_text(col: Column, marker: str = "[METADATA]") -> Column:
    return strip(F.get(F.split(col, F.lit(r"\Q" + marker + r"\E"), -1), F.lit(0)))


def answer_suggestions(col: Column, marker: str = "[METADATA]") -> Column:
    """Suggestions after the marker; malformed or missing JSON gives an empty array."""
    tail = strip(F.get(F.split(col, F.lit(r"\Q" + marker + r"\E"), -1), F.lit(1)))
    parsed = F.from_json(tail, "struct<suggestions:array<string>>")
    return F.coalesce(parsed["suggestions"], F.array().cast("array<string>"))


def message_problem(col: Column, max_length: int = 500) -> Column:
    """Reason a message is refused, null if it is fine."""
    return (F.when(col.isNull() | (col == ""), "empty")
            .when(F.length(col) > max_length, "too_long"))


def feedback_problem(col: Column, allowed: Sequence[str] = ("thumbs_up", "thumbs_down")) -> Column:
    return F.when(col.isNull() | ~col.isin(*allowed), "invalid_feedback")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded to ``digits``; zero where the whole is zero."""
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(0.0)), digits)
