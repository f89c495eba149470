"""Shared helpers: tables cut from their lineage, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheregrid.sources.tables import scratch


#: Rows of a table of a few numbers each that one task writes at least.
TASK_ROWS = 50_000
#: Spark's setting that shuffle files are removed at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later readers survive lost executors.

    With ``rows``, the most it can have, a small table is written by few tasks.
    What was shuffled for it goes as soon as it is written, else all that an
    operator has shuffled lies on the disks until the driver collects garbage.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand texts to Python a few megabytes at a time.

    A text has kilobytes and some have many more, so the default of 10,000 rows
    would take much of an executor's memory on both sides.  A smaller setting stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in chunks of some ``size`` bytes of ``text``, in the same way whenever they are read."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text").cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        ends = total + np.cumsum(sizes)
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, size)) + 1
            if stop > batch.num_rows:
                held.append(batch.slice(start))
                total = int(ends[-1])
                break
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, ends, start, total = [], ends - ends[stop - 1], stop, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; a component's label is its smallest node.

    Alternating large-star and small-star rounds: every round is a group-by
    minimum (combined before the shuffle) and an equi-join.  The minima are
    written before they are joined, so both sides of the join are plain
    shuffles and adaptive execution splits the rows of a node with very many
    neighbours over several tasks.  The number of rounds grows with the
    logarithm of the longest path.  Rows with a null end are left out.
    """
    current = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # Both stars replace edges one by one, so no later table of edges is larger than twice the first.
    most, before = 2 * current.count(), None
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), most)
        # Large star: every neighbour larger than the node points to the smallest of the neighbourhood.
        large = saved(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), most)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Small star: every smaller neighbour, and the node itself, point to the smallest one.
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        current = saved(small.where("a <> b").distinct(), most)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
