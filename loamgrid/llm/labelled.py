"""Bounded samples of labelled documents, and the split into rows to learn from and rows held out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 20_000                     # bytes; longer texts are scored whole, but not learned from


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; no id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, folds: int, fold: int, longest: int = LONGEST) -> tuple[DataFrame, dict[int, int]]:
    """``text, y`` of at most ``each`` documents per class, and how many labelled rows each class has.

    Texts over ``longest`` bytes, rows held out, without label or with conflicting labels take no part.  The least-hashed ids are taken, so reruns agree; the ids are at most
    ``2 * each`` rows and are sent to the scan of the documents, which is not shuffled."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max").select("doc_id", F.col("y").cast("int").alias("y")))
    counts = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        ids = part if ids is None else ids.union(part)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).dropDuplicates(["text"]).select("text", "y"), counts
