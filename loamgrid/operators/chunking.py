"""Text to chunks.  A document never leaves its row until the chunks are final, so nothing shuffles."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import STOP_WORDS
from ..session import cut_lineage
from .ordered import running_sum

# Sizes in characters, and the mark of carried-over text.
TARGET_CHARS = 2000
OVERLAP_CHARS = 600
MIN_CHUNK_CHARS = 80
SAME_START_CHARS = 40
CONTINUED = "[...continued]\n"

# Headings and sentences.
MARKDOWN_HEADING = r"(?md)^#{1,3} .+"
MARKDOWN_SPLIT = r"(?md)(?=^#{1,3} )"
CAPITALS_HEADING = r"(?md)^[A-Z][A-Z\s]{5,50}$"
CAPITALS_SPLIT = r"(?md)(?=^[A-Z][A-Z\s]{5,50}$)"
SENTENCE = r"[^.!?]+(?:[.!?](?!\s+[a-z])[^.!?]*+)*+[.!?]*"


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def sections(cleaned: Column) -> Column:
    """Sections of a cleaned text as ``array<struct<heading, content>>``: by markdown headings, else by lines in
    capitals, else one."""
    markdown, capitals = cleaned.rlike(MARKDOWN_HEADING), cleaned.rlike(CAPITALS_HEADING)
    parts = (F.when(markdown, F.split(cleaned, MARKDOWN_SPLIT)).when(capitals, F.split(cleaned, CAPITALS_SPLIT))
             .otherwise(F.array(cleaned)))

    def section(part: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        rest = tx.strip(F.substring(part, F.length(first) + 2, F.length(part)))
        return F.struct(tx.strip(F.regexp_replace(first, r"^#+\s*", "")).alias("heading"), rest.alias("content"))

    def fill_empty(s: Column) -> Column:
        return F.struct(s["heading"].alias("heading"),
                        F.when(s["content"] == "", s["heading"]).otherwise(s["content"]).alias("content"))
    headed = F.transform(F.transform(F.filter(parts, lambda p: tx.strip(p) != ""), section), fill_empty)
    return F.when(markdown | capitals, headed).otherwise(
        F.array(F.struct(F.lit("").alias("heading"), cleaned.alias("content"))))


def pack_sentences(text: Column, prefix: Column, target: int = TARGET_CHARS, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Fill chunks with whole sentences, each chunk led by ``prefix``."""
    found = tx.let(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)),
                   lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))
    units = F.filter(F.transform(found, tx.strip), lambda s: s != "")
    return _pack(units, prefix, " ", target, min_chars, split_long=False)


def pack_paragraphs(text: Column, prefix: Column, target: int = TARGET_CHARS,
                    min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Fill chunks with whole paragraphs; one over the target goes by sentences; boilerplate is left out."""
    units = F.filter(F.transform(F.split(text, r"\n{2,}"), tx.strip), lambda p: ~tx.is_boilerplate(p))
    return _pack(units, prefix, "\n\n", target, min_chars, split_long=True)


def _pack(units: Column, prefix: Column, joiner: str, target: int, min_chars: int, split_long: bool) -> Column:
    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def closed(acc: Column) -> Column:
        return tx.let(tx.strip(acc["open"]), lambda t: F.when(F.length(t) >= min_chars, F.array_append(acc["done"], t))
                    .otherwise(acc["done"]))

    def step(acc: Column, unit: Column) -> Column:
        gap = F.when(F.length(acc["open"]) > F.length(prefix), F.lit(joiner)).otherwise(F.lit(""))
        fits = F.length(acc["open"]) + F.length(unit) <= target
        out = F.when(fits, state(acc["done"], F.concat(acc["open"], gap, unit)))
        if split_long:
            out = out.when(F.length(unit) > target,
                           state(F.concat(closed(acc), pack_sentences(unit, prefix, target, min_chars)), prefix))
        return out.otherwise(state(closed(acc), F.concat(prefix, unit)))

    return F.aggregate(units, state(_empty_strings(), prefix), step, closed)


def section_chunks(parts: Column, target: int = TARGET_CHARS, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Raw chunks of all sections as ``array<struct<text, section>>``."""
    def prepared(section: Column) -> Column:
        prefix = F.when(section["heading"] != "", F.concat(section["heading"], F.lit("\n\n"))).otherwise(F.lit(""))
        return F.struct(section["heading"].alias("heading"), prefix.alias("prefix"),
                        tx.strip(section["content"]).alias("body"))

    def one(s: Column) -> Column:
        def texts(whole: Column) -> Column:
            return (F.when(tx.is_boilerplate(s["body"]), _empty_strings())
                    .when(F.length(whole) <= target, F.array(whole))
                    .otherwise(pack_paragraphs(s["body"], s["prefix"], target, min_chars)))
        return F.transform(tx.let(tx.strip(F.concat(s["prefix"], s["body"])), texts),
                           lambda t: F.struct(t.alias("text"), s["heading"].alias("section")))
    return F.flatten(F.transform(F.transform(parts, prepared), one))


def overlapped(raw: Column, overlap: int = OVERLAP_CHARS) -> Column:
    """Put the end of the chunk before in front of each chunk, unless it starts so already."""
    def one(chunk: Column, i: Column) -> Column:
        def joined(before: Column) -> Column:
            same = chunk["text"].startswith(F.left(before, F.lit(SAME_START_CHARS)))
            return F.when((i == 0) | same, chunk["text"]).otherwise(
                F.concat(F.lit(CONTINUED), before, F.lit("\n\n"), chunk["text"]))
        text = tx.let(F.right(F.get(raw, i - 1)["text"], F.lit(overlap)), joined)
        return F.struct(text.alias("text"), chunk["section"].alias("section"))
    return F.transform(raw, one)


def split_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: ``section_no, heading, content``."""
    staged = df.withColumn("_clean", tx.clean_text(F.col(text))).withColumn("_sections", sections(F.col("_clean")))
    kept = [c for c in df.columns if c != text]
    return (staged.select(*kept, F.posexplode_outer("_sections").alias("section_no", "_s")).where(F.col("_s").isNotNull())
            .select(*kept, "section_no", F.col("_s.heading").alias("heading"), F.col("_s.content").alias("content")))


def semantic_chunks(df: DataFrame, text: str = "text", target: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS,
                    min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Cleaned, sectioned, packed, overlapped chunks: ``chunk_index, total_chunks, section, content``.

    ``total_chunks`` counts before short chunks are dropped.  The outer explode and the filter after it stand for
    a plain explode, for which the optimizer would evaluate the whole chain twice (once as a pushed-down filter)."""
    kept = [c for c in df.columns if c != text]
    return (df.withColumn("_clean", tx.clean_text(F.col(text)))
            .withColumn("_sections", F.when(F.length("_clean") >= min_chars, sections(F.col("_clean"))))
            .withColumn("_raw", section_chunks(F.col("_sections"), target, min_chars))
            .withColumn("_all", overlapped(F.col("_raw"), overlap))
            .withColumn("_kept", F.filter(F.transform("_all", lambda c: F.struct(
                tx.strip(c["text"]).alias("text"), c["section"].alias("section"))),
                lambda c: F.length(c["text"]) >= min_chars))
            .select(*kept, F.size("_all").alias("total_chunks"), F.posexplode_outer("_kept").alias("chunk_index", "_c"))
            .where(F.col("_c").isNotNull())
            .select(*kept, "chunk_index", "total_chunks", F.col("_c.section").alias("section"),
                    F.col("_c.text").alias("content")))


def chunk_paged_documents(df: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Chunk each page of a document, keep the page number, number the chunks through the whole document.

    Pages are chunked once and written; numbers come from chunk counts per page (one narrow row per page), not from a window over all chunks."""
    paged = cut_lineage(semantic_chunks(df.select(doc, page, text), text))
    counts = paged.groupBy(doc, page).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [doc], [page], F.col("_n"), "_upto")
    sizes = counts.groupBy(doc).agg(F.sum("_n").cast("int").alias("_total"))
    offsets = placed.join(sizes, doc).select(doc, page, (F.col("_upto") - F.col("_n")).cast("int").alias("_before"), "_total")
    return (paged.join(offsets, [doc, page])
            .select(doc, F.col(page).alias("page_number"), (F.col("chunk_index") + F.col("_before")).alias("chunk_index"),
                    F.col("_total").alias("total_chunks"), "section", "content"))


LOT_WORDS = 1_000_000                # words ranked at once


def _ranked_keywords(lists: pa.ListArray, n: int) -> pa.ListArray:
    """The ``n`` best of each list of words, which are words and pairs of neighbours among those that can be keywords."""
    coded = lists.flatten().dictionary_encode()
    known, sizes = coded.dictionary, pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
    number = pc.match_substring_regex(known, "^[0-9]+$").to_numpy(zero_copy_only=False)
    good = (sizes > 3) & ~number & ~pc.is_in(known, pa.array(list(STOP_WORDS), pa.string())).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    kept = good[codes]
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[kept]
    codes = codes[kept]
    both = sizes[codes[:-1]] + 1 + sizes[codes[1:]]
    at = np.flatnonzero((rows[:-1] == rows[1:]) & (both > 8) & (both < 40))
    width = max(1, len(known))
    _, first, uses = np.unique(rows * width + codes, return_index=True, return_counts=True)
    _, opening, pair_uses = np.unique((rows[at] * width + codes[at]) * width + codes[at + 1], return_index=True, return_counts=True)
    firsts, pair = np.concatenate([first, at[opening]]), np.repeat([0, 1], [len(first), len(opening)])
    halves, count = np.concatenate([2 * uses, 3 * pair_uses]), len(codes) + 1          # weights in halves: 1 and 1.5 a use
    order = np.lexsort(((-2 * halves + pair) * count + firsts, rows[firsts]))
    row = rows[firsts][order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    chosen, row, place = order[place < n], row[place < n], place[place < n]
    words = known.take(pa.array(codes[firsts[chosen]]))
    following = known.take(pa.array(codes[np.minimum(firsts[chosen] + 1, max(0, len(codes) - 1))]))
    shown = pc.if_else(pa.array(pair[chosen] == 1), pc.binary_join_element_wise(words, following, " "), words)
    entries = pa.StructArray.from_arrays([pa.array((place + 1).astype(np.int32)), shown, pa.array(halves[chosen] / 2.0)], ["rank", "keyword", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)), entries)


def ranked_keywords(text: Column, n: int = 8) -> Column:
    """The top ``n`` keywords of a text as ``array<struct<rank, keyword, weight>>``, found inside the row.

    A word counts 1 per use, a pair of neighbouring words of 9 to 39 characters 1.5.  Ties go to words before
    pairs, then to the first use.  Words are ranked in lots of texts that have about ``LOT_WORDS`` words."""
    lot = LOT_WORDS

    @F.arrow_udf("array<struct<rank: int, keyword: string, weight: double>>")
    def ranked(lists: pa.Array) -> pa.Array:
        upto, out, start = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), [], 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + lot, "right")))
            out.append(_ranked_keywords(lists.slice(start, stop - start), n))
            start = stop
        return pa.concat_arrays(out) if out else _ranked_keywords(lists, n)
    return ranked(tx.ascii_words(text))


def keywords(df: DataFrame, key: str = "id", text: str = "content", n: int = 8) -> DataFrame:
    """Top ``n`` keywords per row: ``key, rank, keyword, weight``; nothing is shuffled."""
    return (df.select(key, ranked_keywords(F.col(text), n).alias("_k")).select(key, F.explode_outer("_k").alias("_u")).where(F.col("_u").isNotNull())
            .select(key, "_u.rank", "_u.keyword", "_u.weight"))


def with_keywords(df: DataFrame, text: str = "content", out: str = "keywords", n: int = 8) -> DataFrame:
    """Add the list of keywords in rank order, null without any."""
    return df.withColumn("_k", ranked_keywords(F.col(text), n)).withColumn(out, F.when(F.size("_k") > 0, F.col("_k.keyword"))).drop("_k")
