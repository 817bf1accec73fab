"""What several operators of this subpackage need: Arrow maps, bounded sieves, connected components."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.session import cut_lineage, shared_path

WORD = r"[^\x20\x09-\x0D]+"
SIEVE_BITS = 28                      # 32 MB, whatever the input


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch.  Batches follow the session's limits of rows and bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
    return df.mapInArrow(run, schema)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of lists from one array per row."""
    bounds = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


class Sieve:
    """A bitmap of fixed size for a set of 64-bit hashes: never denies a member, affirms others the more often the fuller it is.

    It only spares work: those who use it get the same result however full it is."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __contains__(self, _: object) -> bool:
        raise TypeError("ask for arrays with holds()")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def sieve_of(values: DataFrame, column: str, bits: int = SIEVE_BITS) -> Sieve:
    """Sieve of a column of well mixed 64-bit hashes.  At most 2**(bits - 6) aggregated words reach the driver."""
    at = f"shiftrightunsigned({column}, {64 - bits})"
    rows = values.groupBy(F.expr(f"shiftright({at}, 6)").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Sieve(bits, words)


class Scratch:
    """Intermediate tables in the shared folder, which are emptied when no plan needs them any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows, written once and read from there."""
        path = shared_path(self._spark, "scratch")
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def empty(self, *tables: DataFrame) -> None:
        """Gives the files of these tables (all without arguments) back; nothing may be computed from them afterwards."""
        for key in [id(t) for t in tables] or list(self._paths):
            path, _ = self._paths.pop(key)
            self._spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links (a, b)``: the least id that can be reached.

    Alternates large-star and small-star steps; a step is two aggregations and two joins over the links, whatever the size of a component,
    and joins split hot ids."""
    spark = links.sparkSession
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
