"""Audit of how filters interact, over every order they can be applied in.

A document is a mask: the filters it fails.  In an order of the filters it is removed at the first one it fails, so the orders in which a given filter
removes it at a given step begin alike: some filters it passes, then that one.  Orders that begin alike are neighbours in lexicographic order, that is, an interval of ranks
(Lehmer codes).  Documents are counted per mask; each count is added at the begin and taken off at the end of its intervals, and sums along the ranks give every
order's figures at once."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import arrow_map
from loamgrid.llm.words import buffers, words_of
from loamgrid.session import cut_lineage

FILTERS = "ABCDE"                    # few words, repeated words, capitals, marks, copy of an earlier text
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
_CAPITALS, _FOLLOWING = bytes(range(65, 91)), bytes(range(128, 192))
_COPY = 16                           # the bit of E
_FIGURES = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@cache
def removal_intervals(n: int) -> tuple[tuple[int, int, int, int], ...]:
    """(mask, step, begin, end): the ranks of all orders of ``n`` filters in which a document of that mask goes at that step.

    An order's rank is the sum over its places of the number of later filters that are smaller, times the factorial of the places behind; the orders
    that share a beginning of ``step + 1`` places are (n - step - 1)! ranks in a row.  Neighbouring intervals are joined."""
    found: dict[tuple[int, int], list[list[int]]] = {}
    for step in range(n):
        span = factorial(n - step - 1)
        for start in permutations(range(n), step + 1):
            passed, last = sum(1 << f for f in start[:-1]), start[-1]
            rank = sum((f - sum(g < f for g in start[:i])) * factorial(n - 1 - i) for i, f in enumerate(start))
            for mask in range(1, 1 << n):
                if mask >> last & 1 and not mask & passed:
                    spans = found.setdefault((mask, step), [])
                    if spans and spans[-1][1] == rank:
                        spans[-1][1] = rank + span
                    else:
                        spans.append([rank, rank + span])
    return tuple((mask, step, a, b) for (mask, step), spans in found.items() for a, b in spans)


def removed_by_order(counts: np.ndarray) -> np.ndarray:
    """Figures per (step, rank) from figures per mask: ``counts[mask, figure]`` to ``removed[step, rank, figure]``."""
    n = len(counts).bit_length() - 1
    ends = np.zeros((n, factorial(n) + 1, counts.shape[1]), np.int64)
    table = np.array(removal_intervals(n)).T
    np.add.at(ends, (table[1], table[2]), counts[table[0]])
    np.subtract.at(ends, (table[1], table[3]), counts[table[0]])
    return np.cumsum(ends, axis=1)[:, :-1]


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, mask, digest`` of every row: filters A to D as bits, and the text's digest, by which E is decided.

    A null text counts as empty (and so equals an empty one); a null ``part`` counts as the empty string."""
    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("text")
        data, offsets = buffers(column)
        masks, digests = np.zeros(batch.num_rows, np.int32), []
        for words in words_of(column):
            for row in range(words.first, words.last):
                text = data[offsets[row]:offsets[row + 1]].tobytes()
                a, b = words.bounds[row - words.first], words.bounds[row - words.first + 1]
                points = len(text.translate(None, _FOLLOWING))
                masks[row] = ((b - a < LEAST_WORDS) | (100 * len(np.unique(words.hashes[a:b])) < LEAST_DISTINCT * (b - a)) << 1
                              | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points) << 2
                              | (len(text.translate(None, MARKS)) < len(text)) << 3)
                digests.append(hashlib.sha256(text).digest())
        yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(masks), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return arrow_map(rows, judge, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents per set of failed filters, E included, and how many are labelled good or toxic.

    E fails where a smaller doc_id of the whole table has the same text.  Equal rows are counted before they are shuffled, and each task passes on the least
    doc_id of a text only, so a large group of copies is some rows per task.  Rows without doc_id fail E never and have no label; several labels of a
    document count as good or toxic if any is."""
    held = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good_"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic_")))
    rows = failed_filters(docs, part).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = cut_lineage(rows)
    known = (rows.where(F.col("doc_id").isNotNull()).join(held.withColumnRenamed("doc_id", "id_"), F.col("doc_id") == F.col("id_"), "left").drop("id_"))
    unknown = rows.where(F.col("doc_id").isNull()).withColumns({"good_": F.lit(0), "toxic_": F.lit(0)})
    known = cut_lineage(known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good_", "toxic_")}))
    # In each task a text's least doc_id alone goes on to the exchange.
    first = known.withColumn("place_", F.rank().over(Window.partitionBy("digest").orderBy("doc_id"))).where("place_ = 1").drop("place_")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good_")).alias("good"), F.sum(F.col("n") * F.col("toxic_")).alias("toxic")]

    def counted(some: DataFrame, bit: int, sign: int) -> DataFrame:
        out = some.groupBy("part", "mask").agg(*sums)
        return out.select("part", F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
    # All rows as failing E, but for those that are the first of their text.
    every = counted(known, _COPY, 1).union(counted(first, _COPY, -1)).union(counted(first, 0, 1)).union(counted(unknown, 0, 1))
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n > 0")


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step`` with the figures of each order and step, from ``counts (part, mask, n, good, toxic)``.

    A part's counts are one row of at most 2 ** len(filters) entries; an empty table gives no row."""
    n = len(filters)
    names = ["".join(p) for p in permutations(filters)]
    filter_at = np.array([[filters.index(f) for f in name] for name in names]).T        # step, rank
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def audit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            table = np.zeros((1 << n, 3), np.int64)
            for m in masks:
                table[m["mask"]] += (m["n"], m["good"], m["toxic"])
            removed = removed_by_order(table)
            fails = np.array([sum(table[m, 0] for m in range(1 << n) if m >> f & 1) for f in range(n)])
            shapley = np.array([removed[:, :, 0][filter_at == f].sum() for f in range(n)])
            figures = [table[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=0), removed[:, :, 0], fails[filter_at] - removed[:, :, 0], table[1 << filter_at, 0],
                       removed[:, :, 1], removed[:, :, 2], shapley[filter_at]]
            ranks = len(names)
            yield pa.record_batch([pa.array([part] * (ranks * n)), pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), ranks)),
                                   *[pa.array(f.T.ravel()) for f in figures]], names=["part", "filter_order", "step", *(c.split()[0] for c in _FIGURES.split(", "))])

    return arrow_map(per_part, audit, f"part string, filter_order string, step int, {_FIGURES}")


def interaction_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part of ``docs (doc_id, text, source, ...)``, order of the filters A to E and step; see ``mask_counts`` for what counts.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its filter but went before, ``unique_fails`` fail no other filter, ``good_lost`` and
    ``toxic_lost`` are the labelled ones among the removed, ``shapley`` adds the filter's removed up over all orders.  An empty table gives no row."""
    return orders(mask_counts(docs, labels, part))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
flags AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
                regexp_matches(text, '[#$%&*|]'), doc_id > first_id] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts USING (text) LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
judged AS (
  SELECT part, o, n, good, toxic, fails, list_position(list_transform(o, lambda f: fails[f]), true) AS gone_at FROM masks, orders),
counted AS (
  SELECT part, o, step, o[step] AS f, sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails[o[step]] AND gone_at < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step)
SELECT part, list_aggregate(list_transform(o, lambda f: substr('ABCDE', f, 1)), 'string_agg', '') AS filter_order, step::INT AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted
"""
