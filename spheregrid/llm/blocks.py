"""Vectors as rows of bytes, and queries streamed past bounded groups of them.

Every group of rows is sent once; the queries that ask it follow it to the same
task, where they pass by a batch at a time.  No task holds more than one
group of rows and one batch of queries and nothing is broadcast, so queries
and rows may both outgrow a machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What rows (kind 0) and queries (kind 1) of a group have in common; rows lie in the order of ``spot``.
MEETING = {"cell": "long", "part": "int", "kind": "int", "spot": "long", "id": "long", "uid": "long", "dim": "int", "data": "binary", "low": "long", "above": "long"}


def packed(vectors: DataFrame, change: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> DataFrame:
    """``(id, dim, data)``: one row for each vector, its components after ``change`` as bytes of ``kind``.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, are left out; ``change`` may drop more by returning NaN rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[known & (lengths >= 0)]).tolist():
                at = np.flatnonzero(known & (lengths == dim))
                matrix = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
                fine = np.isfinite(matrix).all(axis=1)
                at, matrix = at[fine], change(matrix[fine])
                fine = ~np.isnan(matrix).any(axis=1)
                at, matrix = at[fine], matrix[fine].astype(kind)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(pa.int64()), pa.array(np.full(len(at), dim, np.int32)), pa.array([x.tobytes() for x in matrix], pa.binary())], ["id", "dim", "data"])

    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return columns.mapInArrow(run, "id long, dim int, data binary")


def asked_once(vectors: DataFrame) -> DataFrame:
    """One vector (the largest) for each id."""
    return vectors.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


class Group:
    """The rows of a group in memory, in the order of ``spot``."""

    def __init__(self, parts: list[pa.RecordBatch], kind: type):
        rows = pa.Table.from_batches(parts)
        self.spot, self.id, self.uid = (rows.column(c).to_numpy() for c in ("spot", "id", "uid"))
        self.matrix = matrix_of(rows.column("data").combine_chunks(), int(rows.column("dim")[0].as_py()), kind)


def matrix_of(data: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(len(data), dim)


def meeting(rows: DataFrame, queries: DataFrame, visit: Callable[[Group, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, kind: type, group_of: type[Group] = Group) -> DataFrame:
    """``visit(group, queries)`` for each batch of the queries of a group.

    Both tables have ``cell`` and ``part``, the group's name, ``id``, ``dim``
    and ``data``; rows have ``spot``, by which they are sorted.
    """

    def whole(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("kind", F.lit(k)).select(*[(F.col(c) if c in df.columns or c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in MEETING.items()])

    both = whole(rows, 0).unionByName(whole(queries, 1)).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "spot", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, group = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")])
            edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if b == a:
                    continue
                cell, part, k = keys[:, a].tolist()
                if (cell, part) != name:
                    name, parts, group = (cell, part), [], None
                if k == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    group = group or group_of(parts, kind)
                    yield from visit(group, batch.slice(a, b - a))

    return both.mapInArrow(run, schema)
