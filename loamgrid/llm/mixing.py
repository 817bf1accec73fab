"""Mixing sources to target weights.

Sizes are added up per source; a source's target is its share of the mix by weight, at most ``most`` times its size, what is above going to the others by weight.
Target over size is its repetition rate: a document is emitted floor(rate) times, and once more with the probability of the fraction, drawn from a
hash of its id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import WORD
from loamgrid.session import cut_lineage, fits_broadcast

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix"
SOURCES_BROADCAST = 100_000          # rows of source totals sent to all tasks; beyond, they are joined


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """Number from 0 up to 1 made of an id: 52 bits of its digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``sized (source, size)``.

    Sources in order of code points, null last, take the weights in turn.  The table of sources is one row per source; only two sums per round reach the
    driver, and rounds end when no further source is above its bound."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = cut_lineage(totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight")))
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, bound = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        held = table.agg(F.sum(F.when(above, F.col("source_size") * most)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("w"),
                         F.count(F.when(above, 1)).alias("n")).first()
        if held["n"] == bound or not held["w"]:
            break
        bound, level = held["n"], (whole - (held["full"] or 0.0)) / held["w"]
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(most) * F.col("source_size")))


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: how often the mix takes each row.

    Null texts have size 0; a source without words has target 0 and its documents no copy; rows that repeat an id fare alike; a null source is a source.
    Columns of ``docs`` with these names are replaced."""
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", size_of(F.col("text")))
    targets = source_targets(cut_lineage(docs.select("source", "size")), weights, share, most).select(F.col("source").alias("source_"), "source_size", "target")
    if fits_broadcast(targets, SOURCES_BROADCAST):
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return docs.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mixed(docs: DataFrame, **kinds: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as planned."""
    plan = planned(docs, **kinds)
    return plan.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy_")).select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source),
levels(round, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT round + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(CASE WHEN level * weight > 2 * source_size THEN 2 * source_size END), 0))
                            / sum(CASE WHEN level * weight <= 2 * source_size THEN weight END) FROM totals)
  FROM levels WHERE round < (SELECT count(*) + 1 FROM totals)),
rates AS (
  SELECT source, source_size, least(level * weight, 2.0 * source_size) AS target,
         CASE WHEN source_size > 0 THEN least(level * weight, 2.0 * source_size) / source_size ELSE 0 END AS rate
  FROM totals, (SELECT level FROM levels ORDER BY round DESC LIMIT 1))
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
