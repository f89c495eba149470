"""Approximate nearest neighbours with a hash-prefix forest.

Each tree is a table of all rows in the order of their hash strings (60 signs
of random hyperplanes), built once and cut to cells of bounded size by its
first bits.  A query goes only to the cells of its own prefix, one in each
tree.  There it descends to its longest prefix match and ascends again, one bit
at a time over all trees alike, scoring what each step adds, until ``target``
is reached: the k-th score so far bounds the angle to any better row, the
angle gives the chance that such a row shares a prefix of this length in at
least one tree, and below the target the ascent goes on.  A query that must
ascend beyond its cell goes to the cells under the shorter prefix in the next
round.

Inner products become angles by one more coordinate (rows are scaled by the
longest row's length R and lifted to length 1), so the order by angle is the
order by inner product.  Every row is indexed, only candidates are scored, and
none is cut off.  How many that are follows from the vectors: directions
without structure need a large part of a small table, clustered ones little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.blocks import Group, asked_once, matrix_of, meeting, packed
from spheregrid.llm.common import saved

#: Length of a hash string; bit 59 is the first sign.
BITS = 60
#: Rows of a cell that one task holds; larger cells (equal strings) are dealt to several.
CELL = 65_536
FOUND = "query_id long, uid long, vec_id long, score double"


def as_is(x: np.ndarray) -> np.ndarray:
    """Zero vectors have no direction and take no part."""
    return np.where((x == 0).all(axis=1)[:, None], np.nan, x)


def hash_strings(x: np.ndarray, trees: int, seed: int, longest: float) -> np.ndarray:
    """The strings ``(tree, row)`` of rows lifted to length 1 (or, without ``longest``, of queries, whose length doesn't matter)."""
    if longest:
        x = x / longest
        x = np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)
    else:
        x = np.concatenate([x / np.abs(x).max(axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
    power = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    planes = (np.random.default_rng([seed, tree]).standard_normal((x.shape[1], BITS)) for tree in range(trees))
    return np.stack([(x @ p > 0) @ power for p in planes])


def enough(cosine: float, trees: int, target: float) -> int:
    """The longest prefix at which rows of that cosine or more share one with a chance of ``target`` in some tree."""
    p = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    if p >= 1:
        return BITS
    return 0 if p <= 0 else min(BITS, int(math.log(1 - (1 - target) ** (1 / trees)) / math.log(p)))


class Cell(Group):
    """A cell's rows, also in single precision for the first look (in double where components exceed it)."""

    def __init__(self, parts: list[pa.RecordBatch], kind: type):
        super().__init__(parts, kind)
        self.rough = self.matrix.astype(np.float32) if np.abs(self.matrix).max(initial=0.0) < 1e18 else self.matrix


def ascent(own: Cell, query: np.ndarray, string: int, same: int, k: int, floor: int, trees: int, target: float, longest: float) -> tuple[np.ndarray, int, int]:
    """Candidates of one query in a cell: places of the best, how many were scored, and the prefix length that would be enough.

    ``floor`` is the shortest prefix to go to.
    """
    levels = np.arange(floor, BITS + 1)
    keep = (np.int64(1) << (BITS - levels)) - 1
    low, high = np.searchsorted(own.spot, string & ~keep).tolist(), np.searchsorted(own.spot, string | keep, side="right").tolist()
    at = next((n for n in range(len(levels) - 1, 0, -1) if high[n] - low[n] >= 2 * k), 0)
    size, rough = float(np.linalg.norm(query)), query.astype(own.rough.dtype)
    slack = 1e-5 * size * longest
    a, b = low[at], high[at]
    places, scores = np.arange(a, b), own.rough[a:b] @ rough
    while True:
        scores[own.id[places] == same] = -np.inf
        if len(places) > 4 * k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack
            places, scores = places[some], scores[some]
        fine = np.sort(scores[np.isfinite(scores)])
        need = enough((fine[-k] - slack) / (size * longest), trees, target) if len(fine) >= k else 0
        if at == 0 or levels[at] <= need:
            return places[np.isfinite(scores)], b - a, need
        at -= 1
        left, right = low[at], high[at]
        places = np.concatenate([places, np.arange(left, a), np.arange(b, right)])
        scores = np.concatenate([scores, own.rough[left:a] @ rough, own.rough[b:right] @ rough])
        a, b = left, right


def forest_search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 16, target: float = 0.92, cell: int = CELL, seed: int = 7, report: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found by inner product, nearest first.

    ``vectors`` and ``queries`` hold ``(vec_id, embedding)``; other columns are
    ignored.  Ties go to the smaller ``vec_id``; a query's own id is no
    candidate.  A neighbour is found with a chance of ``target`` at least; with
    no more than ``k`` candidates all are found.  Vectors that are null, zero
    or hold null or non-finite components, and rows without an id, take no
    part; vectors meet only those of their own length.  A repeated query id is
    asked once, with its largest vector; a repeated row is a candidate each
    time.  With ``report`` the result is ``(query_id, scored)`` instead, the
    rows that each query was scored against over all trees.
    """
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" and dict(queries.dtypes)["embedding"] == "array<float>" else np.float64
    asked = saved(packed(asked_once(queries), as_is, kind))
    # Of equal vectors only those with the k + 1 smallest ids can be among the nearest k of another one.
    equal = Window.partitionBy("dim", "data").orderBy("id")
    once = packed(vectors, as_is, kind).withColumn("_r", F.dense_rank().over(equal)).where(F.col("_r") <= k + 1).drop("_r")
    rows = saved(once.withColumn("uid", F.monotonically_increasing_id()))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = max((float(np.linalg.norm(np.frombuffer(x, kind).astype(np.float64))) for x in batch.column("data").to_pylist()), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([batch.num_rows])], ["longest", "n"])

    longest, n = rows.mapInArrow(lengths, "longest double, n long").agg(F.max("longest"), F.coalesce(F.sum("n"), F.lit(0))).first()
    longest = longest or 1.0
    depth = max(0, math.ceil(math.log2(max(1, n) / cell)))

    def strings(df: DataFrame, of_rows: bool) -> DataFrame:
        """Each vector once for each tree, with its string."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = batch.column("dim").to_numpy()
                for dim in np.unique(size).tolist():
                    part = batch.filter(pa.array(size == dim))
                    each = hash_strings(matrix_of(part.column("data"), dim, kind).astype(np.float64), trees, seed, longest if of_rows else 0.0)
                    for tree in range(trees):
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, tree, np.int32)), pa.array(each[tree])], [*part.schema.names, "tree", "spot"])

        return df.mapInArrow(run, df.withColumn("tree", F.lit(0)).withColumn("spot", F.lit(0).cast("long")).schema)

    # A cell is a prefix of ``depth`` bits in a tree; how often it is cut depends on its rows.
    prefix = F.shiftright("spot", BITS - depth) if depth else F.lit(0).cast("long")
    name = F.xxhash64("dim", "tree", "prefix")
    indexed = strings(rows, True).withColumn("prefix", prefix)
    cells = saved(strings(rows.select("dim", "data"), True).groupBy("dim", "tree", prefix.alias("prefix")).agg(F.count("*").alias("n"))).withColumn("cell", name).withColumn("parts", F.ceil(F.col("n") / (2 * cell)).cast("int"))
    dealt = indexed.join(cells.select("dim", "tree", "prefix", "cell", "parts"), ["dim", "tree", "prefix"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))

    def search(floor: int):
        def visit(own: Cell, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            want = matrix_of(asks.column("data"), own.matrix.shape[1], kind).astype(np.float64)
            out: list[tuple] = []
            for i, (query, string) in enumerate(zip(asks.column("id").to_pylist(), asks.column("spot").to_pylist(), strict=True)):
                places, scored, need = ascent(own, want[i], string, query, k, floor, trees, target, longest)
                score = np.array([float(np.dot(want[i], own.matrix[j].astype(np.float64))) for j in places.tolist()]) if len(places) else np.zeros(0)
                best = np.lexsort((own.id[places], -score))[:k]
                out.append((np.full(len(best), query), own.uid[places][best], own.id[places][best], score[best]))
                # How many were scored (uid -1), and the prefix length that would be enough (uid -2).
                out.append((np.full(2, query), np.array([-1, -2]), np.array([scored, 0]), np.array([0.0, float(need)])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "uid", "vec_id", "score"])

        return visit

    found: DataFrame | None = None
    told = strings(asked, False).withColumn("prefix", prefix)
    floor = depth
    while n:
        # All cells under the query's prefix of ``floor`` bits.
        under = cells.select("dim", "tree", "cell", "parts", F.shiftright("prefix", depth - floor).alias("_up"))
        visits = told.withColumn("_up", F.shiftright("prefix", depth - floor)).join(under, ["dim", "tree", "_up"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        more = saved(meeting(dealt, visits, search(floor), FOUND, kind, Cell))
        found = more if found is None else found.unionByName(more)
        if floor == 0:
            break
        # The highest of a query's bounds holds for all trees.
        open_ = saved(more.where("uid = -2").groupBy("query_id").agg(F.max("score").alias("need")).where(F.col("need") < floor).select(F.col("query_id").alias("id")))
        if open_.isEmpty():
            break
        told, floor = told.join(open_, "id"), max(0, floor - 3)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    if report:
        return found.where("uid = -1").groupBy("query_id").agg(F.sum("vec_id").alias("scored"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "uid")
    kept = found.where("uid >= 0").withColumn("_again", F.coalesce(F.lag("uid").over(order) == F.col("uid"), F.lit(False))).where("not _again")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
