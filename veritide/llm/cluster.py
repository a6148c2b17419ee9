"""Cutting lineage in the cluster's shared folder, joins on hot keys, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.words import trim

BATCH_ROWS = "1000"
#: A key with more than one row in SHARE is hot; there are SHARE such keys at most.
SHARE = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of a thousand rows where the session has Spark's default of ten thousand: texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster has none that all machines see, so it raises."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured is None and current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veritide-"))
    elif current is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The same rows read from a compressed table in the shared folder: smaller than a checkpoint, and read by column.

    The table is the block's own and goes at its end, so what leaves the block must be a checkpoint.
    """
    path = fresh_path(df.sparkSession, name)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more.

    The cleaner acts on what the driver's garbage collector finds, which on a driver with free memory can take
    half an hour; until then the files of each finished step stay on the executors' disks, and its plans in the driver.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined to facts, which have one row a key at most; how is inner or left.

    Keys that hold more than one row in SHARE (SHARE keys at most, so their facts can be broadcast) don't go to
    one task: rows of hot keys stay where they are. rows are read twice and should be a checkpoint or a scan.
    counts, where known, has each key's rows as __n.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")) if counts is None else counts
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") > max(total // SHARE, 1)).select(*keys).dropna().collect()
    if not hot:
        return rows.join(facts, keys, how)
    known = F.broadcast(rows.sparkSession.createDataFrame(pa.Table.from_pylist([row.asDict() for row in hot]), rows.select(*keys).schema))  # as Arrow: no task has to start Python for it
    cold = rows.join(known, keys, "left_anti").join(facts, keys, how)
    own = F.broadcast(facts.join(known, keys, "left_semi"))
    warm = rows.join(known, keys, "left_semi").join(own, keys, how)
    return cold.unionByName(warm)


def _least(rows: DataFrame) -> DataFrame:
    """rows (a, b) with m, the least b of a."""
    found = cut(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")))
    return spread_join(rows, found.select("a", "m"), ["a"], counts=found)


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (node, component) for every node of edges (a, b); component is the least node reached.

    Alternates large-star and small-star steps until no edge changes. Each step is an aggregation on
    node ids and a join that leaves the rows of hot nodes (centres of large stars) in place, so no task
    needs a component or the edges of one node as a whole. Loops and nulls are ignored; an empty input
    gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    before = None
    while True:
        release(edges.sparkSession)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = cut(large.distinct())
        small = _least(large)
        star = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = cut(star.distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Shuffle partitions for so many rows, of about per rows each; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
