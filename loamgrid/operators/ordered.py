"""Order-dependent operators that do not gather a key into one task.

A window over a key puts all its rows into one task.  ``scan`` deals rows by ranges of (key, order) instead, so that a key of any size lies in many partitions
one after the other.  A partition is gone through once, batch by batch; what its last key has come to is one row, and what earlier partitions had of its first key
is added when the rows are read again.  One exchange moves the rows, whatever the number of results.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shuffle_width


def _changes(batch: pa.RecordBatch, keys: Sequence[str], before: dict[str, pa.Array] | None) -> np.ndarray:
    """Whether each row has another key than the row before it; ``before`` holds the keys of the row before the batch."""
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = before is None
    for key in keys:
        column = batch.column(key)
        if before is not None:
            column = pa.concat_arrays([before[key], column])
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        same = same | (nulls[1:] & nulls[:-1])
        changed[len(changed) - len(same):] |= ~same
    return changed


def _within_partition(keys: Sequence[str], sums: Sequence[str], earlier: Sequence[str], lasts: Sequence[str], names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map over a sorted partition: sums so far, the value before and the last value within each key, as far as the partition knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs, at = None, -1, 0
        total: dict[str, object] = {}
        value: dict[str, pa.Array] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changed = _changes(batch, keys, before)
            starts = np.flatnonzero(changed)
            first = np.maximum.accumulate(np.where(changed, np.arange(n), -1))          # where each row's key begins, -1 before the batch
            out = []
            for name in sums:
                x = batch.column(name).fill_null(0).to_numpy()
                upto = np.cumsum(x)
                base = np.where(first > 0, upto[np.maximum(first, 1) - 1], 0)
                carried = np.where(first < 0, total.get(name, 0), 0)
                out.append(pa.array((upto - base + carried).astype(x.dtype)))
                total[name] = out[-1][n - 1].as_py()
            for name in earlier:
                column = batch.column(name)
                joined = pa.concat_arrays([value.get(name, pa.nulls(1, column.type)), column])
                out.append(joined.take(pa.array(np.arange(n), mask=changed)))
                value[name] = column[n - 1:]
            for name in lasts:
                column = batch.column(name)
                spots = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                joined = pa.concat_arrays([value.get(name, pa.nulls(1, column.type)), column])
                known = np.where((spots >= first) & (spots >= 0), spots + 1, 0)
                out.append(joined.take(pa.array(known, mask=(known == 0) & (first >= 0))))
                value[name] = out[-1][n - 1:]
            run_no = runs + np.cumsum(changed)
            runs = int(run_no[-1])
            out += [pa.array(run_no == 0), pa.array(np.arange(at, at + n))]
            at += n
            before = {k: batch.column(k)[n - 1:] for k in keys}
            yield pa.record_batch([*batch.columns, *out], names=list(names))
    return run


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column] | None = None, earlier: Mapping[str, Column] | None = None,
         lasts: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with running results along ``order`` within ``keys``: ``sums`` up to and including each row, the ``earlier`` value (of the row before, null at a key's
    first), the ``lasts`` value that is not null up to and including each row.

    Null keys are a key; rows of equal order follow each other in any order; null values add nothing to a sum.  The rows are written once, sorted by key and order."""
    sums, earlier, lasts = dict(sums or {}), dict(earlier or {}), dict(lasts or {})
    given = {f"_s_{n}": c.cast("double") if isinstance(df.select(c.alias("c")).schema["c"].dataType, (T.FloatType, T.DoubleType, T.DecimalType)) else c.cast("long")
             for n, c in sums.items()} | {f"_e_{n}": c for n, c in earlier.items()} | {f"_l_{n}": c for n, c in lasts.items()}
    along = [F.col(c) if isinstance(c, str) else c for c in order]
    staged = df.withColumns(given).withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = staged.repartitionByRange(shuffle_width(df), *keys, *along, "_tie").sortWithinPartitions(*keys, *along, "_tie").drop("_tie").withColumn("_part", F.spark_partition_id())
    shape = sorted_.schema
    results = [("_r" + c, shape[c].dataType) for c in given]
    local = T.StructType([*shape.fields, *[T.StructField(n, t) for n, t in results], T.StructField("_first", T.BooleanType()), T.StructField("_at", T.LongType())])
    walk = _within_partition(list(keys), [c for c in given if c.startswith("_s_")], [c for c in given if c.startswith("_e_")], [c for c in given if c.startswith("_l_")], local.names)
    rows = cut_lineage(sorted_.mapInArrow(walk, local))

    # One row per partition: what its last key has come to, and which key it begins with.
    tail = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c) for c in given], *[F.col(n) for n, _ in results])
    edges = rows.groupBy("_part").agg(F.max_by(tail, "_at").alias("t"), F.min_by(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), "_at").alias("h"))
    keyed = [f"k{i}" for i in range(len(keys))]
    carry = {c: F.col(f"t._r{c}") if c.startswith("_s_") else F.struct(F.col(f"t.{c}").alias("v")) if c.startswith("_e_") else F.col(f"t._r{c}") for c in given}
    ends = edges.select("_part", F.lit(1).alias("kind"), *[F.col(f"t.{k}").alias(k) for k in keyed], *[v.alias("_c" + c) for c, v in carry.items()])
    asks = edges.select("_part", F.lit(0).alias("kind"), *[F.col(f"h.{k}").alias(k) for k in keyed], *[F.lit(None).cast(ends.schema["_c" + c].dataType).alias("_c" + c) for c in given])
    ahead = Window.partitionBy(*keyed).orderBy("_part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.union(asks).withColumns({"_c" + c: F.sum("_c" + c).over(ahead) if c.startswith("_s_") else F.last("_c" + c, ignorenulls=True).over(ahead) for c in given}).where("kind = 0")
    joined = rows.join(brought.select("_part", *["_c" + c for c in given]), "_part")
    out = {}
    for c in given:
        if c.startswith("_s_"):
            out[c[3:]] = F.col("_r" + c) + F.when(F.col("_first"), F.coalesce("_c" + c, F.lit(0))).otherwise(F.lit(0))
        elif c.startswith("_e_"):
            out[c[3:]] = F.when(F.col("_at") == 0, F.col(f"_c{c}.v")).otherwise(F.col("_r" + c))
        else:
            out[c[3:]] = F.when(F.col("_first"), F.coalesce("_r" + c, "_c" + c)).otherwise(F.col("_r" + c))
    return joined.select(*[c for c in df.columns if c not in out], *[v.cast(shape[c].dataType).alias(c[3:]) for c, v in zip(given, out.values())])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, along ``order`` within ``keys``."""
    return scan(df, keys, order, sums={out: value})


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """1-based position of each row along ``order`` within ``keys``."""
    return scan(df, keys, order, sums={out: F.lit(1)})


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, following: bool = False) -> DataFrame:
    """``value`` of the row before (or after) along ``order`` within ``keys``; null at the end."""
    return scan(df, keys, [F.desc(c) for c in order] if following else order, earlier={out: value})


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` up to and including each row."""
    return scan(df, keys, order, lasts={out: value})


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], start: Callable[[], object],
                 step: Callable[[object, dict], tuple], out_schema: str) -> DataFrame:
    """Left-to-right fold that streams: rows come sorted, only the state of the current key is held.

    ``step(state, row)`` returns the values of the added columns; it may change ``state``.  Use keys fine enough
    that one of them is a fair share of a task."""
    keys = list(keys)
    added = [part.strip().split()[0] for part in out_schema.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [out_schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            results = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                results.append(step(state, row))
            for position, name in enumerate(added):
                batch[name] = [r[position] for r in results]
            yield batch

    # Rows are dealt by a hash of the key: were they dealt by the key itself, the planner could keep a partitioning
    # that adaptive execution has already merged by size, and all Python work would share one task.
    dealt = df.withColumn("_slot", F.xxhash64(*keys)).repartition(shuffle_width(df), "_slot").drop("_slot")
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema=schema)
