"""Parallel sorting by regular sampling, with exact sums of what comes before each row.

Every task sorts its rows: a run.  Regularly spaced rows of the runs are the samples; regularly spaced samples are the splitters, which cut each run into
segments.  The segments' sums, added up in order, say what lies before each segment; the parts of a segment meet in one task, whose sort merges the sorted stretches
(and spills when it has to), and a running sum does the rest.  No task sees more than its run or its segment, and equal keys are told apart by their place in
the runs, so that a key of any number of rows is cut like any other."""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loamgrid.llm.shared import arrow_map
from loamgrid.session import shared_path, shuffle_width

SAMPLES = 1 << 14                    # rows that reach the driver, or eight for each run if that is more
PLACE, SEGMENT = "place_", "segment_"
_IN_RUN = (1 << 33) - 1              # the low bits of a place: the position in its run


class Runs(NamedTuple):
    """Sorted runs (written, with the key columns and ``place_``) and the splitters that cut them: sorted tuples of keys and place."""
    table: DataFrame
    keys: list[str]
    splitters: list[tuple]


def sorted_runs(rows: DataFrame, keys: dict[str, Column], segment_rows: int, samples: int = SAMPLES) -> Runs:
    """``rows`` with the columns ``keys`` (whole numbers, none null, compared in ascending order), sorted within each task and written to the shared folder.

    There are as many segments as shuffle partitions, or more if they would exceed ``segment_rows`` on average; a segment of N rows in all has at most
    N / segments + (runs + 1) * N / samples.  At most ``samples`` rows, or eight for each run, reach the driver."""
    names = list(keys)
    placed = rows.withColumns(keys).sortWithinPartitions(*names).withColumn(PLACE, F.monotonically_increasing_id())
    path = shared_path(rows.sparkSession, "runs")
    placed.write.option("compression", "zstd").parquet(path)
    table = rows.sparkSession.read.schema(placed.schema).parquet(path)
    facts = table.agg(F.count("*").alias("n"), F.coalesce(F.max(F.shiftright(PLACE, 33)), F.lit(0)).alias("last")).first()
    n, samples = facts["n"], max(samples, 8 * (facts["last"] + 1))
    segments, stride = max(shuffle_width(table), -(-n // segment_rows)), max(1, -(-n // samples))
    chosen = table.where((F.col(PLACE).bitwiseAND(F.lit(_IN_RUN)) % stride) == stride - 1).select(*names, PLACE).toArrow()
    regular = sorted(zip(*[chosen.column(c).to_pylist() for c in [*names, PLACE]]))
    cuts = sorted({len(regular) * i // segments for i in range(1, segments)} - {0})
    return Runs(table, names, [regular[i] for i in cuts])


def _stretches(batch: pa.RecordBatch, runs: Runs, first: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(segment, begin, end) of the sorted stretches of a batch; rows of another run begin anew."""
    columns = [batch.column(c).to_numpy() for c in [*runs.keys, PLACE]]
    run = columns[-1] >> 33
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]

    def key(i: int) -> tuple:
        return tuple(c[i].item() for c in columns)

    for begin, end in zip(edges, edges[1:]):
        while begin < end:
            segment = bisect_right(first, key(begin))
            cut = bisect_left(range(end), first[segment], begin, key=key) if segment < len(first) else end
            yield segment, begin, cut
            begin = cut


def segment_sums(runs: Runs, weight: str | None = None) -> list[int]:
    """Sum of ``weight`` (rows, without one) per segment: one number per segment reaches the driver."""
    held = runs.table.sparkSession.sparkContext.broadcast(runs.splitters)
    bare = runs._replace(table=None)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column(weight).to_numpy() if weight else np.ones(batch.num_rows, np.int64)
        found = [(s, int(sizes[a:b].sum())) for s, a, b in _stretches(batch, bare, held.value)]
        yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], names=["s", "n"])

    needed = runs.table.select(*runs.keys, PLACE, *([weight] if weight else []))
    sums = [0] * (len(runs.splitters) + 1)
    for s, n in arrow_map(needed, count, "s int, n long").groupBy("s").agg(F.sum("n")).collect():
        sums[s] = n
    return sums


def merged(runs: Runs, sums: list[int], before: str, weight: str | None = None, most: int | None = None, below: str | None = None,
           last: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """The rows of the first segments, one partition per segment, in the order of the keys, with ``before``: the sum of ``weight`` (rows, without one) ahead of each.

    With ``most`` only segments that begin before that sum are exchanged; the others, whose rows all come later, are left where they are: ``below`` then names a
    column that is true for the rows returned of them, in no order and with ``before`` null.  ``last`` is a function of the finished batches, with the schema it gives."""
    held = runs.table.sparkSession.sparkContext.broadcast(runs.splitters)
    bare = runs._replace(table=None)
    offsets = [0, *np.cumsum(np.array(sums, np.int64)).tolist()]
    wanted = len(sums) if most is None else max(1, sum(1 for o in offsets[:-1] if o < most))
    fields = runs.table.schema.fields
    names = runs.table.columns
    placed = StructType([*fields, StructField(SEGMENT, IntegerType())])
    numbered = StructType([*fields, StructField(before, LongType())])

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        segment = np.zeros(batch.num_rows, np.int32)
        for s, a, b in _stretches(batch, bare, held.value):
            segment[a:b] = s
        yield pa.record_batch([*batch.columns, pa.array(segment)], names=[*names, SEGMENT])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_here: dict[int, int] = {}
        for batch in batches:
            segment = batch.column(SEGMENT).to_numpy()
            sizes = batch.column(weight).to_numpy() if weight else np.ones(batch.num_rows, np.int64)
            ahead = np.empty(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    s = int(segment[a])
                    base = sums_here.get(s, offsets[s])
                    total = base + np.cumsum(sizes[a:b])
                    ahead[a:b] = total - sizes[a:b]
                    sums_here[s] = int(total[-1])
            out = pa.record_batch([*[batch.column(c) for c in names], pa.array(ahead)], names=[*names, before])
            yield last[0](out) if last else out

    table = arrow_map(runs.table, place, placed) if runs.splitters else runs.table.withColumn(SEGMENT, F.lit(0))
    ahead = table.where(F.col(SEGMENT) < wanted) if wanted < len(sums) else table
    ordered = (ahead.repartitionById(wanted, F.col(SEGMENT)).sortWithinPartitions(SEGMENT, *runs.keys, PLACE)
               .mapInArrow(number, last[1] if last else numbered))
    if below is None:
        return ordered
    ordered = ordered.withColumn(below, F.lit(False))
    if wanted == len(sums):
        return ordered
    rest = table.where(F.col(SEGMENT) >= wanted).select(*names, F.lit(None).cast("long").alias(before), F.lit(True).alias(below))
    return ordered.union(rest)
