"""Ordered scan against windows: keys that lie in many partitions, null keys, batches, several results at once."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None, "zz"]), rng.choice([1, None]) if i % 50 == 0 else 1, i, rng.randint(-5, 9), rng.random(),
             rng.choice([None, None, f"m{i}"])) for i in range(4000)]
    return spark.createDataFrame(data, "k string, k2 int, o int, v int, x double, m string").repartition(5)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_scan_against_windows(spark, rows, batch):
    w = Window.partitionBy("k", "k2").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ordered.scan(rows, ["k", "k2"], ["o"], sums={"n": F.lit(1), "total": F.when(F.col("v") > 0, F.col("v")), "weight": F.col("x")},
                           earlier={"before": F.struct("o", "m"), "m_before": F.col("m")}, lasts={"seen": F.col("m"), "at": F.when(F.col("v") == 9, F.col("o"))}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.select("*", F.row_number().over(w).alias("n"), F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v"))).over(upto), F.lit(0)).alias("total"), F.sum("x").over(upto).alias("weight"),
                       F.lag(F.struct("o", "m")).over(w).alias("before"), F.lag("m").over(w).alias("m_before"), F.last("m", ignorenulls=True).over(upto).alias("seen"),
                       F.last(F.when(F.col("v") == 9, F.col("o")), ignorenulls=True).over(upto).alias("at")).collect()

    def plain(found):
        return sorted((r.o, r.k or "", r.n, r.total, round(r.weight, 6), str(r.before), r.m_before or "", r.seen or "", r["at"] or -1, r.m or "") for r in found)
    assert plain(got) == plain(want)


def test_one_key_in_many_partitions(spark):
    one = spark.range(4000).select(F.lit("k").alias("k"), "id")
    got = ordered.number_rows(one, ["k"], ["id"], "n")
    assert got.where("n <> id + 1").count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_scan_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([("k", 1)] * 500, "k string, o int")
    assert sorted(r.n for r in ordered.number_rows(same, ["k"], ["o"], "n").collect()) == list(range(1, 501))
    assert ordered.number_rows(same.where("false"), ["k"], ["o"], "n").count() == 0
