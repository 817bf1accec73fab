"""Pages and documents to chunk rows."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import CHUNK_RULES, NAMESPACE_RULES, PAGE_RULES, Rule
from ..operators.analytics import ingest_summary
from ..operators.chunking import chunk_paged_documents, semantic_chunks, with_keywords as add_keywords
from ..operators.dedupe import drop_near_duplicate_pages, new_content_only
from ..operators.html import extract_by_kind
from ..operators.rules import classify_chunk, classify_page, namespace_of
from ..session import with_once
from ..sources.readers import MIN_HTML, admit_pages


def page_chunks(pages: DataFrame, site_suffix: str | None = None, rules: Sequence[Rule] = PAGE_RULES,
                namespaces: Sequence[Rule] = NAMESPACE_RULES, fingerprint_prefix: int | None = None,
                snippet: int | None = None, with_keywords: bool = True, drop_repeats: bool = True, text: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Accepted, distinct, classified pages as chunk rows ready for the upsert.

    ``pages``: page_id, url, html and, where documents are fetched too, the column ``text`` with what they say (null for pages).  Personal pages are read as profiles.  The
    columns ``carried`` go with the chunks.  All steps are row-local but the fingerprint."""
    read = extract_by_kind(pages.select("page_id", "url", "html", *([text] if text else []), *carried), text=text, site_suffix=site_suffix)
    shown = F.when(F.col("kind") != "document", F.col("html")) if text else F.col("html")
    least = F.when(F.col("kind") == "document", F.lit(0)).otherwise(F.lit(MIN_HTML))
    taken = (admit_pages(read.withColumn("html", shown), min_html=least).where(F.col("status") == "accepted")
             .drop("html", "kind", "status", "reason", "problem", *([text] if text else [])))
    first = drop_near_duplicate_pages(taken, prefix=fingerprint_prefix) if drop_repeats else taken
    looked_at = F.col("content") if snippet is None else F.left("content", F.lit(snippet))
    labelled = with_once(first, "_c", classify_page(F.col("url"), F.col("title"), looked_at, rules))
    described = labelled.select(
        F.col("page_id").cast("string").alias("parent_page_id"), F.col("url").alias("source_url"), F.col("title").alias("page_title"),
        F.col("_c.page_type").alias("page_type"), F.col("_c.category").alias("category"), F.col("_c.department").alias("department"),
        tx.breadcrumb(F.col("url")).alias("breadcrumb"), namespace_of(F.col("_c.category"), namespaces).alias("namespace"), "content", *carried)
    chunks = semantic_chunks(described, "content")
    rows = chunks.withColumnsRenamed({"section": "section_heading"}).withColumns({
        "source_type": F.lit("webpage"), "content_hash": tx.sha256(F.col("content")),
        "title": F.concat("page_title", F.lit(" ["), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"), F.lit("]"))})
    return add_keywords(rows) if with_keywords else rows


def document_chunks(pages_of_documents: DataFrame, stored: DataFrame, rules: Sequence[Rule] = CHUNK_RULES) -> tuple[DataFrame, DataFrame]:
    """Paged documents (doc_id, page_no, text) to (new chunk rows, summary per document)."""
    chunks = with_once(chunk_paged_documents(pages_of_documents), "_c", classify_chunk(F.col("content"), rules)).withColumns({
        "category": F.col("_c.category"), "namespace": F.col("_c.namespace"), "page_type": F.col("_c.page_type"),
        "content_hash": tx.sha256(F.col("content"))}).drop("_c")
    return new_content_only(chunks, stored), ingest_summary(chunks, stored)
