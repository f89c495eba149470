"""Exact top-k search by distributed histogram selection.

Every pass scores every row against every query.  A pass sends, for each query
and group of rows, the counts of the score bins from the top down to the
group's own k-th score; their sums over all groups locate the bin that holds
the k-th score overall, and the next pass bins that bin finer, until the bins
hold one integer score each.  The last pass keeps the scores above the k-th
one, and of the rows at exactly the k-th score the k smallest ids of each
group, so ties of any number stay bounded.

Rows are dealt to groups once a pass and queries pass by them: what is sent is
the rows once and the queries once for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.blocks import Group, asked_once, matrix_of, meeting, packed
from spheregrid.llm.common import saved

#: Bits of the score that one pass resolves.
BITS = 11
#: Rows of a group, and queries that are scored at once.
GROUP, TILE = 32_768, 64


def quantized(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def _scores(rows: np.ndarray, queries: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; below 2^24 and 2^53 floats hold every partial sum exactly."""
    if bound < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32, copy=False).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, group: int = GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest integer inner products of ``floor(256 x)``.

    ``vectors`` and ``queries`` hold ``(vec_id, embedding)``; other columns are
    ignored.  A query's own id is no candidate; fewer candidates than ``k`` are
    all returned; ties go to the smaller ``vec_id``.  Vectors that are null or
    hold null or non-finite components, and rows without an id, take no part.
    Vectors meet only those of their own length.  A query id that repeats is
    asked once, with its largest vector; a repeated row is a candidate each
    time.  A score beyond a signed 64-bit integer raises an error.
    """
    spark = vectors.sparkSession
    rows, asked = saved(packed(vectors, quantized)), saved(packed(asked_once(queries), quantized))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [float((np.abs(np.frombuffer(x.as_py(), np.float64)).max(initial=0.0) ** 2) * d.as_py()) for x, d in zip(batch.column("data"), batch.column("dim"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([max(best, default=0.0)])], ["bound"])

    count = rows.count()
    bound = rows.mapInArrow(largest, "bound double").agg(F.max("bound")).first()[0] or 0.0
    if bound >= 2**62:
        raise ValueError("inner products of these vectors exceed 64-bit integers")
    # Integers that fit go in fewer bytes.
    limit = bound**0.5
    kind = np.int16 if limit < 2**15 else np.float64
    narrow = lambda df: df.mapInArrow(lambda batches: (b.set_column(2, "data", pa.array([np.frombuffer(x, np.float64).astype(kind).tobytes() for x in b.column("data").to_pylist()], pa.binary())) for b in batches), df.schema)
    if kind != np.float64:
        rows, asked = narrow(rows), narrow(asked)
    bits = max(1, int(bound).bit_length() + 1)
    lowest = -(1 << (bits - 1))

    groups = max(-(-count // group), min(spark.sparkContext.defaultParallelism, count // 4096), 1)
    dealt = rows.withColumn("cell", F.col("dim").cast("long")).withColumn("part", F.pmod(F.xxhash64("id", "data"), F.lit(groups)).cast("int")).withColumn("spot", F.col("id"))
    told = asked.withColumn("cell", F.col("dim").cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def asking(state: DataFrame | None) -> DataFrame:
        """The queries, each with the lowest score of the bin that holds its k-th one, and what lies above it."""
        if state is None:
            return told.withColumn("low", F.lit(lowest).cast("long")).withColumn("above", F.lit(0).cast("long"))
        return told.join(state.withColumnRenamed("query_id", "id"), "id")

    def tiles(own: Group, asks: pa.RecordBatch):
        """Some queries at a time: their ids, the scores of all rows, which rows are no candidates, and their state."""
        rows_ = own.matrix.astype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64, copy=False)
        for at in range(0, asks.num_rows, TILE):
            part = asks.slice(at, TILE)
            ids = part.column("id").to_numpy()
            score = _scores(rows_, matrix_of(part.column("data"), rows_.shape[1], kind).astype(np.float64), bound)
            yield ids, score, ids[:, None] == own.id[None, :], part.column("low").to_numpy(), part.column("above").to_numpy()

    state, shift = None, bits
    while shift > 0:
        step, width = max(0, shift - BITS), 1 << (shift - max(0, shift - BITS))

        def histogram(own: Group, asks: pa.RecordBatch, step: int = step, width: int = width) -> Iterator[pa.RecordBatch]:
            for ids, score, same, low, above in tiles(own, asks):
                bins = (score - low[:, None]) >> step
                out = same | (bins < 0) | (bins >= width)
                flat = (bins + np.arange(len(ids))[:, None] * width)[~out]
                counts = np.bincount(flat, minlength=len(ids) * width).reshape(len(ids), width)[:, ::-1]
                before = counts.cumsum(axis=1) - counts
                at, bin_ = np.nonzero((counts > 0) & (before < (k - above)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(low[at]), pa.array(above[at]), pa.array(width - 1 - bin_), pa.array(counts[at, bin_])], ["query_id", "low", "above", "bin", "n"])

        found = meeting(dealt, asking(state), histogram, "query_id long, low long, above long, bin long, n long", kind)
        sums = found.groupBy("query_id", "low", "above", "bin").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        ranked = sums.withColumn("upto", F.sum("n").over(order) + F.col("above"))
        # The first bin that reaches k; the lowest bin of all where there are fewer candidates.
        reached = ranked.where(F.col("upto") - F.col("n") < k).groupBy("query_id").agg(F.min_by(F.struct("low", "bin", "upto", "n"), "bin").alias("x"))
        state = saved(reached.select("query_id", (F.col("x.low") + F.col("x.bin") * (1 << step)).alias("low"), (F.col("x.upto") - F.col("x.n")).alias("above")))
        shift = step

    def chosen(own: Group, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, score, same, low, _ in tiles(own, asks):
            parts = []
            for i in range(len(ids)):
                above = np.flatnonzero((score[i] > low[i]) & ~same[i])
                ties = np.flatnonzero((score[i] == low[i]) & ~same[i])
                ties = ties[np.argsort(own.id[ties], kind="stable")[:k]]
                at = np.concatenate([above, ties])
                parts.append((np.repeat(ids[i], len(at)), own.id[at], score[i, at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])

    kept = meeting(dealt, asking(state), chosen, "query_id long, vec_id long, score long", kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
