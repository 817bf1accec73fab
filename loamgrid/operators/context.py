"""Assembly of the text handed to whoever answers a question."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Budget, least rest worth filling, mark of a cut entry.
MAX_CONTEXT_CHARS, MIN_REST = 24000, 200
CUT_MARK = "\n[truncated for context budget]"


def context_entries(ranked: DataFrame, budget: int = MAX_CONTEXT_CHARS, rank: str = "final_rank",
                    prefix: int | None = None) -> DataFrame:
    """Entries in rank order that fit: ``query_id, entry_no, id, entry``.

    Rows with equal text (blanks and case aside; with ``prefix`` only its beginning) count once.  The first entry that overflows is cut at its
    last full stop or question mark if more than 200 characters are left; what follows is dropped.  The input is a
    reranked list, at most a dozen rows per question."""
    start = F.col("content") if prefix is None else F.left("content", F.lit(prefix))
    same = F.regexp_replace(F.lower(start), r"(?U)\s", "")
    once = Window.partitionBy("query_id", "_same").orderBy(rank)
    order = Window.partitionBy("query_id").orderBy(rank)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = (ranked.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("_same", same)
                .withColumn("_n", F.row_number().over(once)).where("_n = 1")
                .withColumn("entry_no", F.row_number().over(order)))
    label = F.concat(F.lit("[Source: "), "title", F.lit(" | "), "category",
                     F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit(" | "), "source_url")).otherwise(""), F.lit("]"))
    entry = F.concat(F.lit("--- Context "), F.col("entry_no").cast("string"), F.lit(" "), label, F.lit(" ---\n"), "content")
    sized = numbered.withColumn("entry", entry).withColumn("_upto", F.sum(F.length("entry")).over(upto))
    rest = F.lit(budget) - (F.col("_upto") - F.length("entry"))
    cut = F.left("entry", rest.cast("int"))
    ended = F.regexp_extract(cut, r"(?s)^(.*[.?])", 1)
    fitted = (F.when(F.col("_upto") <= budget, F.col("entry"))
              .when(rest > MIN_REST, F.concat(F.when(ended != "", ended).otherwise(cut), F.lit(CUT_MARK))))
    return (sized.withColumn("entry", fitted).where(F.col("entry").isNotNull()).select("query_id", "entry_no", "id", "entry"))


def build_context(ranked: DataFrame, budget: int = MAX_CONTEXT_CHARS, rank: str = "final_rank", prefix: int | None = None) -> DataFrame:
    entries = context_entries(ranked, budget, rank, prefix)
    return (entries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "entry"))).alias("_e"))
            .select("query_id", F.size("_e").alias("entries"), F.array_join(F.col("_e.entry"), "\n\n").alias("context")))
