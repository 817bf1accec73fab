"""Keyed upserts, re-indexing and deletion as plans over plain Parquet tables: the result is the new table."""
from __future__ import annotations

from datetime import datetime
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import CHUNK_RULES, NAMESPACE_RULES, Rule
from ..session import with_once
from .listing import latest_per_key
from .rules import classify_chunk, namespace_of

KEY, PAGE = ("source_url", "source_type", "chunk_index"), ("source_url", "source_type")


def stamp_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(content), 256))


def latest_version(rows: DataFrame, version: Sequence[str], page: Sequence[str] = PAGE) -> DataFrame:
    """The rows of each page's greatest ``version`` (a time, a run): a page's chunks all come from one fetch."""
    newest = rows.groupBy(*page).agg(F.max(F.struct(*version)).alias("_newest"))
    same = F.col("_newest") == F.struct(*version)
    return rows.join(newest, list(page)).where(same).drop("_newest")


def plan_upsert(new: DataFrame, old: DataFrame, force: bool | Column = False, keys: Sequence[str] = KEY, version: Sequence[str] = (), page: Sequence[str] = PAGE) -> DataFrame:
    """``keys, id, action, old_namespace``: insert, update (hash differs or forced) or touch for each new row.

    Where pages come in several versions, ``version`` names the columns that order them (time first): only the last version of a page counts, whole.  Rows that
    repeat a key within one version are one row, the one of the greatest hash.  A key stored twice counts through its oldest row.  An inserted row gets an id made
    from its key, so a repeated run gives the same id."""
    new = latest_per_key(latest_version(new, version, page) if version else new, list(keys), ["content_hash"])
    stored = (old.groupBy(*keys).agg(F.min_by(F.struct("id", "content_hash", "namespace"), F.struct("created_at", "id")).alias("_old")))
    forced = F.lit(force) if isinstance(force, bool) else force
    joined = new.join(stored, list(keys), "left")
    action = (F.when(F.col("_old").isNull(), "insert")
              .when(forced | ~F.col("content_hash").eqNullSafe(F.col("_old.content_hash")), "update").otherwise("touch"))
    made = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256)
    return (joined.withColumn("action", action).withColumn("id", F.coalesce("_old.id", made))
            .withColumn("old_namespace", F.col("_old.namespace")).drop("_old"))


def lost_chunks(new: DataFrame, old: DataFrame, keys: Sequence[str] = KEY, page: Sequence[str] = PAGE) -> DataFrame:
    """Stored rows of pages that come anew but have that chunk no longer: what an upsert of a shorter page leaves behind."""
    pages = new.select(*page).distinct()
    return old.join(pages, list(page), "left_semi").join(new.select(*keys), list(keys), "left_anti")


def upsert_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"),
                    F.count_if(F.col("action") == "touch").alias("skipped"))


def apply_upsert(plan: DataFrame, old: DataFrame, as_of: datetime) -> DataFrame:
    """The table after the plan: untouched rows as they are, touched ones with a new last-seen time, updated ones
    rewritten with their creation time kept, inserted ones added."""
    now = F.lit(as_of)
    given = [c for c in plan.columns if c in old.columns and c not in ("id", "created_at", "updated_at", "last_scraped_at")]
    changes = plan.select("id", "action", *[F.col(c).alias(f"_new_{c}") for c in given])
    merged = old.withColumn("_stored", F.lit(True)).join(changes, "id", "full_outer")
    rewritten = F.col("action").isin("insert", "update")
    columns = []
    for c in old.columns:
        if c in given:
            columns.append(F.when(rewritten, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            columns.append(F.coalesce(F.col(c), now).alias(c))
        elif c == "updated_at":
            columns.append(F.when(rewritten, now).otherwise(F.col(c)).alias(c))
        elif c == "last_scraped_at":
            columns.append(F.when(F.col("action").isNotNull(), now).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return merged.select(*columns)


def plan_single_entries(entries: DataFrame, old: DataFrame) -> DataFrame:
    """Entries added one by one: a given id is looked up, a manual entry without id is always new, anything else
    goes by key."""
    known = old.select("id", F.col("content_hash").alias("_hash"), F.col("namespace").alias("old_namespace"))
    by_id = entries.where(F.col("id").isNotNull()).join(known, "id", "left").withColumn(
        "action", F.when(F.col("_hash").isNull() & F.col("old_namespace").isNull(), "insert")
        .when(F.coalesce("force", F.lit(False)) | ~F.col("content_hash").eqNullSafe(F.col("_hash")), "update")
        .otherwise("touch")).drop("_hash")
    rest = entries.where(F.col("id").isNull())
    manual = (rest.where(F.col("source_type") == "manual").withColumn("id", F.sha2(F.concat_ws("\x1f", "title", "content", "entry_no"), 256))
              .withColumn("old_namespace", F.lit(None).cast("string")).withColumn("action", F.lit("insert")))
    keyed = plan_upsert(rest.where(F.col("source_type") != "manual").drop("id"), old, F.coalesce("force", F.lit(False)))
    return by_id.unionByName(manual).unionByName(keyed)


def page_hash(index: Column, content_hash: Column) -> Column:
    """Aggregate over the chunks of a page that changes when any chunk or its place changes.

    Two exclusive-or lanes over hashed (place, hash) pairs: unlike a hash of the joined texts it aggregates partially,
    so a source with very many chunks is never gathered."""
    def lane(salt: str) -> Column:
        digest = F.md5(F.concat(F.lit(salt), index.cast("string"), F.lit(":"), content_hash))
        return F.bit_xor(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint"))
    return F.concat(F.lower(F.lpad(F.hex(lane("a")), 15, "0")), F.lower(F.lpad(F.hex(lane("b")), 15, "0")))


def upsert_pages(chunks: DataFrame, pages: DataFrame, as_of: datetime) -> DataFrame:
    """Page registry after a crawl: a page is known by its address; its hash covers all its chunks in order; a
    deleted one that is seen again comes back."""
    seen = (chunks.groupBy("source_url").agg(page_hash(F.col("chunk_index"), F.col("content_hash")).alias("_hash"),
                                             F.count("*").cast("int").alias("_n"), F.max("page_title").alias("_title"))
            .withColumnRenamed("source_url", "url"))
    joined = pages.join(seen, "url", "full_outer")
    fresh, now = F.col("_hash").isNotNull(), F.lit(as_of)
    return joined.select(
        F.coalesce("id", F.sha2("url", 256)).alias("id"), "url", F.coalesce("_title", "title").alias("title"),
        F.coalesce("_hash", "content_hash").alias("content_hash"), F.coalesce("_n", "chunk_count").alias("chunk_count"),
        F.when(fresh, "pending").otherwise(F.col("sync_status")).alias("sync_status"),
        F.when(fresh, "success").otherwise(F.col("crawl_status")).alias("crawl_status"),
        F.when(fresh, now).otherwise(F.col("last_scraped_at")).alias("last_scraped_at"),
        F.when(fresh, F.lit(None)).otherwise(F.col("deleted_at")).alias("deleted_at"))


def moved_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """Vectors to delete because their chunk changed namespace: ``id, namespace`` (the old one)."""
    before = old.select("id", F.col("namespace").alias("_before"))
    return (new.select("id", "namespace").join(before, "id")
            .where(F.col("_before").isNotNull() & (F.col("namespace") != F.col("_before")))
            .select("id", F.col("_before").alias("namespace")))


def without(vectors: DataFrame, gone: DataFrame, on: Sequence[str] = ("id", "namespace")) -> DataFrame:
    return vectors.join(gone.select(*on).distinct(), list(on), "left_anti")


def pending_vectors(chunks: DataFrame, vectors: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Chunks that still need a vector.  What is stored is the progress, so a stopped run simply starts again."""
    if only is not None:
        return chunks.join(only.select("id"), "id", "left_semi")
    return chunks.join(vectors.select("id").distinct(), "id", "left_anti")


def reclassify(chunks: DataFrame, rules: Sequence[Rule] = CHUNK_RULES) -> DataFrame:
    """Rows whose labels change: ``id, old_category, category, namespace, page_type``."""
    labelled = with_once(chunks.select("id", F.col("category").alias("old_category"), "content"), "_c",
                         classify_chunk(F.col("content"), rules)).drop("content")
    return (labelled.where(~F.col("old_category").eqNullSafe(F.col("_c.category")))
            .select("id", "old_category", F.col("_c.category").alias("category"), F.col("_c.namespace").alias("namespace"),
                    F.col("_c.page_type").alias("page_type")))


def change_matrix(changed: DataFrame) -> DataFrame:
    return changed.groupBy("old_category", "category").agg(F.count("*").alias("n"))


def delete_document(df: DataFrame, urls: DataFrame, on: str = "source_url") -> DataFrame:
    """All rows but those of the listed documents."""
    return df.join(urls.select(on).distinct(), on, "left_anti")


def backfill(chunks: DataFrame, rules: Sequence[Rule] = NAMESPACE_RULES, model: str = "hashed-words-256") -> DataFrame:
    """Fill missing vector ids, namespaces and model names."""
    return chunks.withColumns({"vector_id": F.coalesce("vector_id", "id"),
                               "namespace": F.coalesce("namespace", namespace_of(F.col("category"), rules)),
                               "embedding_model": F.coalesce("embedding_model", F.lit(model))})


def upsert_config(current: DataFrame, changes: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Latest value per key; a default only where the key is absent."""
    latest = (current.unionByName(changes).groupBy("key")
              .agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at")))
    if defaults is None:
        return latest
    return latest.unionByName(defaults.join(latest, "key", "left_anti").select("key", "value", "updated_at"))
