"""Session helpers: one place for the settings the operators rely on."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Semantics every operator assumes.  Sizes (shuffle partitions, split bytes, memory) are left to the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loamgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the semantic settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SEMANTIC_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: the one the cluster names, else (local mode only) a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    The result outlives any executor, later steps read only the columns they need, and unlike a checkpoint the plan
    runs once."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_emptied(spark: SparkSession) -> Iterator[None]:
    """What a plan has shuffled is deleted when it has run, instead of when the driver's memory is next cleaned; for work that
    goes from one ``cut_lineage`` to the next."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` holds at most ``max_rows`` rows; the scan stops one row past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by key for CPU-heavy work per key; what follows by the same keys needs no further shuffle.

    The explicit number keeps adaptive execution from merging partitions that are small in bytes but not in work."""
    return df.repartition(shuffle_width(df), *keys)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated exactly once per row.

    Optimizer rules copy a column's expression into every filter and field access above it; they do not reach below
    a generator."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
