"""Column functions over text.  All are built-in expressions, so they stay inside whole-stage codegen or
Spark's own higher-order functions; none starts a Python worker."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import BOILERPLATE_PATTERNS

WORD_BREAK = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``; lambda bodies would evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def char_count(col: Column) -> Column:
    return F.length(col)


def approx_tokens(col: Column) -> Column:
    """Tokens for listings: a quarter of the characters, rounded."""
    return F.round(F.length(col) / F.lit(4)).cast("int")


def token_estimate(col: Column) -> Column:
    """Tokens for document totals: a quarter of the characters, rounded up."""
    return F.ceil(F.length(col) / F.lit(4)).cast("long")


def preview(col: Column, n: int) -> Column:
    return F.left(col, F.lit(n))


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def words(col: Column) -> Column:
    """Lower-case words of letters and digits of any script, in text order, repeats kept."""
    return F.array_remove(F.split(F.lower(col), WORD_BREAK), "")


def query_tokens(col: Column, min_length: int = 3) -> Column:
    """Distinct lower-case tokens of at least ``min_length`` characters; punctuation separates."""
    return F.array_distinct(F.filter(words(col), lambda w: F.length(w) >= min_length))


def shingles(col: Column, k: int = 5, prefix: int | None = None) -> Column:
    """Distinct character ``k``-grams of the lower-cased text (whole text unless ``prefix`` is given)."""
    low = F.lower(F.coalesce(col, F.lit("")))
    if prefix is not None:
        low = F.left(low, F.lit(prefix))

    def grams(letters: Column) -> Column:
        last = F.size(letters) - F.lit(k - 1)
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda i: F.array_join(F.slice(letters, i, F.lit(k)), ""))))
    return let(F.filter(F.split(low, ""), lambda c: c != ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct arrays; two empty ones count as equal."""
    def ratio(common: Column) -> Column:
        total = F.size(a) + F.size(b) - common
        return F.when(total == 0, F.lit(1.0)).otherwise(common / total)
    return let(F.size(F.array_intersect(a, b)), ratio)


def clean_text(col: Column) -> Column:
    """Normalise line ends, tabs, trailing blanks, blank runs and newline runs; drop a line equal to the one
    before it; trim the whole."""
    steps = [(r"\r\n?", "\n"), (r"\t", "  "), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n"),
             (r"(?U)[^\S\n]{3,}", " ")]
    out = col
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    def drop_repeats(lines: Column) -> Column:
        return F.filter(lines, lambda line, i: (i == 0) | (strip(line) != strip(F.get(lines, i - 1))))
    return strip(F.array_join(let(F.split(out, "\n", -1), drop_repeats), "\n"))


def is_boilerplate(col: Column) -> Column:
    """Navigation remnants, legal footers, bare separators, or anything under five characters."""
    def test(text: Column) -> Column:
        hit = F.length(text) < 5
        for pattern in BOILERPLATE_PATTERNS:
            hit = hit | text.rlike(pattern)
        return hit
    return let(strip(F.coalesce(col, F.lit(""))), test)


def fingerprint(col: Column, prefix: int | None = None) -> Column:
    """First 16 hex digits of the MD5 of the lower-cased text with blanks collapsed; ``prefix=None`` takes the
    whole text."""
    text = col if prefix is None else F.left(col, F.lit(prefix))
    return F.left(F.md5(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " ")), F.lit(16))


def slug(col: Column, max_length: int = 40) -> Column:
    dashed = F.regexp_replace(F.trim(F.lower(col)), r"[^a-z0-9-]+", "-")
    dashed = F.regexp_replace(F.regexp_replace(dashed, r"-+", "-"), r"^-|-$", "")
    return F.left(dashed, F.lit(max_length))


def ascii_words(col: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and dashes in text order; what is no such character separates."""
    return F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9 \t\n\r\f-]", " "), r"[ \t\n\r\f]+")


def title_words(col: Column) -> Column:
    """Upper-case the first letter of each word, leave the rest as it is."""
    return F.array_join(F.transform(F.split(col, " ", -1),
                                    lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def breadcrumb(url: Column) -> Column:
    """``Home > Part > Part`` from the path of an absolute URL; anything else gives ``Home``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    shown = F.transform(parts, lambda p: F.regexp_replace(
        title_words(F.regexp_replace(p, "[-_]", " ")), r"(?i)\.(html?|php|aspx?)$", ""))
    return F.when(F.size(parts) > 0, F.concat(F.lit("Home > "), F.array_join(shown, " > "))).otherwise(F.lit("Home"))


def file_title(url: Column, default: str = "Document") -> Column:
    """Readable title from the last path part: decoded, extension dropped, dashes to blanks, words capitalised."""
    name = F.element_at(F.split(url, "/", -1), -1)
    name = F.when(name == "", F.lit(default)).otherwise(F.coalesce(F.try_url_decode(name), name))
    name = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[-_]", " ")
    return title_words(name)


def attachment_title(url: Column) -> Column:
    """Title of a fetched document: file name without extension and hash prefix, blanks collapsed, marked."""
    name = F.regexp_replace(F.element_at(F.split(url, "/", -1), -1), r"\.pdf", "")
    name = F.when(name == "", F.lit("PDF Document")).otherwise(F.coalesce(F.try_url_decode(name), name))
    name = F.regexp_replace(F.regexp_replace(name, r"(?i)^[a-f0-9]{8}_", ""), r"(?U)\s+", " ")
    return F.concat(strip(name), F.lit(" (PDF)"))
