"""Grids cut into square tiles: what needs a cell's way through the grid is settled inside each tile, between tiles only their borders are.

A tile is a group of at most ``size`` x ``size`` cells and is worked on in one
task as numpy arrays.  What leaves a tile are its border's cells, so tables of
links grow with perimeters and shrink by contraction; the number of jobs
doesn't depend on how long a path, a lake or a region is.  Missing cells are
no neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spheregrid.sources.tables import settled

#: Cells along a tile's side.
SIZE = 256
#: Links that one task settles at the end of a contraction; more are contracted in rounds over the cluster first.
LINKS = 2_000_000
#: Steps to half of the eight neighbours; the others are their opposites.
HALF = ((0, 1), (1, -1), (1, 0), (1, 1))


def tiled(cells: DataFrame, size: int) -> DataFrame:
    """``cells(i, j, ...)`` with their tile ``ti, tj``."""
    return cells.withColumn("ti", F.floor(F.col("i") / size).cast("int")).withColumn("tj", F.floor(F.col("j") / size).cast("int"))


def with_halo(cells: DataFrame, size: int, halo: int, width: int | None = None) -> DataFrame:
    """Each cell in its tile and in every other whose halo it is in (``own`` tells which); ``li, lj`` are its place from the tile's first cell.

    Rows close to rings of ``width`` where it is given; tiles are then made so
    much wider that the last one of a row isn't narrower than a halo.
    """
    while width and size < width and width % size < halo and width % size:
        size += 1
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    last = -(-width // size) - 1 if width else None
    placed = tiled(cells, size)
    i, j = F.col("i") - F.col("ti") * size, F.col("j") - F.col("tj") * size
    # A row's last tile may be narrower: its end is the width.
    end = F.least(F.lit(size), F.lit(width) - F.col("tj") * size) if width else F.lit(size)
    near = {-1: i < halo, 0: F.lit(True), 1: i >= size - halo}
    beside = {-1: j < halo, 0: F.lit(True), 1: j >= end - halo}
    moves = []
    for a, b in steps:
        to = F.col("tj") + b
        lj = j - b * size
        if width:
            lj = F.when(to < 0, j + (width - last * size)).when(to > last, j - end).otherwise(lj)
            to = F.when(to < 0, F.lit(last)).when(to > last, F.lit(0)).otherwise(to)
        moves.append(F.when(near[a] & beside[b], F.struct((F.col("ti") + a).cast("int").alias("ti"), to.cast("int").alias("tj"), (i - a * size).cast("int").alias("li"), lj.cast("int").alias("lj"), F.lit(a == 0 and b == 0).alias("own"))))
    dealt = placed.withColumn("_m", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull()))).drop("ti", "tj")
    return dealt.select("*", "_m.*").drop("_m")


def dense(rows: pa.Table, li: np.ndarray, lj: np.ndarray, shape: tuple[int, int], column: str, fill) -> np.ndarray:
    """A column as a block, ``fill`` where there is no cell."""
    values = rows.column(column).to_numpy()
    out = np.full(shape, fill, dtype=np.result_type(values.dtype, type(fill)))
    out[li, lj] = values
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number each of 0..n-1 is linked with by pairs ``a, b``."""
    parent = np.arange(n)
    while len(a):
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return parent


def border(cells: DataFrame, size: int, width: int | None, steps: tuple, columns: list[str]) -> DataFrame:
    """Pairs of neighbouring cells of different tiles, one of each by ``steps``: the columns of both, the second's with ``n_`` before."""
    placed = tiled(cells, size)
    edge = placed.where((F.col("i") % size).isin(0, size - 1) | (F.col("j") % size).isin(0, size - 1) | (F.col("j") == (width - 1 if width else -1)))
    each = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in steps])
    spread = edge.withColumn("_s", F.explode(each))
    nj = F.col("j") + F.col("_s.dj")
    seam = (nj < 0) | (nj >= width) if width else F.lit(False)
    spread = spread.select("ti", "tj", *columns, (F.col("i") + F.col("_s.di")).alias("n_i"), (F.pmod(nj, F.lit(width)) if width else nj).alias("n_j"), seam.alias("seam"))
    near = edge.select(F.col("i").alias("n_i"), F.col("j").alias("n_j"), F.col("ti").alias("n_ti"), F.col("tj").alias("n_tj"), *[F.col(c).alias(f"n_{c}") for c in columns])
    # A tile as wide as the grid meets itself at the seam.
    return spread.join(near, ["n_i", "n_j"]).where((F.col("ti") != F.col("n_ti")) | (F.col("tj") != F.col("n_tj")) | F.col("seam"))


# --- stencils ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stencil:
    """A step over blocks: what it reads and makes of a block's arrays, and how many cells around it looks at.

    ``run`` takes arrays by column name and gives new ones by name, of the
    same shape; a block's edge stands for the grid's.
    """

    radius: int
    made: dict[str, str]  # type of each new column
    run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def stencils(grid: DataFrame, steps: list[Stencil], reads: list[str], width: int | None = None, size: int = SIZE, keys: Sequence[str] = ()) -> DataFrame:
    """A full ``grid(keys, i, j, ...)`` with the columns of a chain of stencils, each of which may read what those before it made.

    Cells go to their tile with a halo as wide as the whole chain looks, so the
    chain takes one shuffle; rows close to rings of ``width`` where it is given.
    """
    halo = sum(s.radius for s in steps)
    made = {name: kind for s in steps for name, kind in s.made.items()}
    fields = [f for f in grid.schema if f.name not in made]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(kind)) for n, kind in made.items()]])
    kinds = to_arrow_schema(schema)

    def run(rows: pa.Table) -> pa.Table:
        li, lj, own = (rows.column(c).to_numpy() for c in ("li", "lj", "own"))
        x, y = li - li.min(), lj - lj.min()
        shape = (int(x.max()) + 1, int(y.max()) + 1)
        blocks = {}
        for c in reads:
            block = np.zeros(shape, rows.column(c).to_numpy().dtype)
            block[x, y] = rows.column(c).to_numpy()
            blocks[c] = block
        for step in steps:
            blocks |= step.run(blocks)
        keep = rows.filter(pa.array(own))
        x, y = x[own], y[own]
        new = {n: pa.array(blocks[n][x, y]) for n in made}
        return pa.table([new[f.name].cast(f.type) if f.name in new else keep.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    plain = grid.select(*[f.name for f in grid.schema if f.name not in made or f.name in reads])
    return with_halo(plain, max(size, halo), halo, width).groupBy(*keys, "ti", "tj").applyInArrow(run, schema)


def moved(block: np.ndarray, di: int, dj: int) -> np.ndarray:
    """Each cell's neighbour ``di, dj`` away; beyond the edge the edge's cell."""
    i, j = (np.clip(np.arange(n) + d, 0, n - 1) for n, d in zip(block.shape, (di, dj), strict=True))
    return block[i][:, j]


def sliding(block: np.ndarray, radius: int, axis: int, mode: str, fold: Callable[..., np.ndarray], **fill: float) -> np.ndarray:
    """``fold`` of the 2 radius + 1 cells around each along an axis, the block padded at its edges as numpy's ``mode`` says."""
    pad = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
    return fold(sliding_window_view(np.pad(block, pad, mode=mode, **fill), 2 * radius + 1, axis=axis), axis=-1)


# --- regions -------------------------------------------------------------------------------------------------------


def linked(pairs: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node each node of ``pairs(a, b)`` is linked with.

    Stars are contracted (every neighbour of a node to the smallest one, in
    turn of the larger and of the smaller neighbours) until no more links are
    left than a task settles.
    """
    pairs = settled(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while pairs.count() > LINKS:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settled(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        pairs = settled(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:  # nothing but stars is left
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state

    def settle(rows: pa.Table) -> pa.Table:
        a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return pa.table({"node": nodes, "label": nodes[roots(len(nodes), at[: len(a)], at[len(a) :])]})

    return pairs.groupBy().applyInArrow(settle, "node long, label long")


def regions(cells: DataFrame, width: int, size: int = SIZE, diagonal: bool = False, wrap: bool = False) -> DataFrame:
    """``(i, j, label)``: connected regions of ``cells(i, j)``, labelled by their smallest ``i * width + j``.

    Labels of a tile's own regions first, then the links between labels at
    tiles' borders are contracted; cells are passed over twice, whatever a region's shape.
    """
    steps = HALF if diagonal else ((0, 1), (1, 0))

    def label(rows: pa.Table) -> pa.Table:
        i, j = (rows.column(c).to_numpy().astype(np.int64) for c in ("i", "j"))
        li, lj = i - i.min(), j - j.min()
        shape = (int(li.max()) + 1, int(lj.max()) + 1)
        number = np.full(shape, -1)
        number[li, lj] = np.arange(len(i))
        a, b = _adjacent(number, steps)
        root = roots(len(i), a, b)
        own = np.full(len(i), np.iinfo(np.int64).max)
        np.minimum.at(own, root, i * width + j)
        return pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "local": own[root]})

    local = settled(tiled(cells.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")), size).groupBy("ti", "tj").applyInArrow(label, "i int, j int, local long"))
    # Every pair of neighbours is there once: each step and, across the seam, its closing one.
    pairs = border(local, size, width if wrap else None, steps, ["local"]).select(F.col("local").alias("a"), F.col("n_local").alias("b"))
    joined = linked(pairs)
    return local.join(joined.withColumnRenamed("node", "local"), "local", "left").select("i", "j", F.coalesce("label", "local").alias("label"))


def _adjacent(number: np.ndarray, steps: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (from 0; -1: no cell) of neighbouring cells of a block."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for di, dj in steps:
        a, b = _shifted(number, di, dj)
        there = (a >= 0) & (b >= 0)
        found.append((a[there], b[there]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _shifted(block: np.ndarray, di: int, dj: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's cells and those ``di, dj`` (``di`` not below 0) from them."""
    left, right = max(0, -dj), block.shape[1] - max(0, dj)
    return block[: block.shape[0] - di, left:right], block[di:, left + dj : right + dj]


# --- sums and maps along a forest ----------------------------------------------------------------------------------


def _forest(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's cells, the row of each one's receiver (-1: a root, or outside), and whether it drains out of the tile."""
    c, rec = rows.column("c").to_numpy(), rows.column("rec").to_numpy()
    order = np.argsort(c)
    at = np.searchsorted(c[order], rec)
    at = np.where((at < len(c)) & (c[order][np.minimum(at, len(c) - 1)] == rec), order[np.minimum(at, len(c) - 1)], -1)
    leaves = at < 0
    at[rec == c] = -1
    return c, at, leaves


def _gathered(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each cell's own value and those of all within the tile that drain through it."""
    total, at = own.copy(), at.copy()
    while True:
        going = np.flatnonzero(at >= 0)
        if not len(going):
            return total
        gain = np.zeros_like(total)
        np.add.at(gain, at[going], total[going])
        total = total + gain
        at[going] = at[at[going]]


def _ends(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last cell of each one's way through the tile, and the steps to it."""
    end, steps = np.where(at < 0, np.arange(len(at)), at), (at >= 0).astype(np.int64)
    while True:
        further = end[end]
        if (further == end).all():
            return end, steps
        steps, end = steps + steps[end], further


def of_tiles(forest: DataFrame, width: int, size: int) -> DataFrame:
    """``forest(c, ...)`` with the tile of each cell ``i * width + j``."""
    i, j = F.floor(F.col("c") / width), F.col("c") % width
    return forest.withColumn("ti", F.floor(i / size).cast("int")).withColumn("tj", F.floor(j / size).cast("int"))


def accumulate(forest: DataFrame, own: str, name: str, width: int, size: int, chained: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """``forest(c, rec, own)`` with the sum of ``own`` over each cell and all that drains through it.

    Sums inside tiles; the sums that leave tiles are added up along the links
    between the cells where ways leave (``chained``, over perimeters only); then
    tiles are summed once more with what comes in.
    """
    kind = dict(forest.dtypes)[own]
    real = "long" if kind in ("bigint", "int", "smallint", "tinyint") else "double"
    cells = settled(of_tiles(forest.select("c", "rec", F.col(own).cast(real).alias("v")), width, size))

    def leaving(rows: pa.Table) -> pa.Table:
        c, at, leaves = _forest(rows)
        total = _gathered(at, rows.column("v").to_numpy())
        end, _ = _ends(at)
        # Where a way ends for every border cell, at which others come in; sums for those where it leaves.
        x, y = c // width % size, c % width % size
        rim = np.flatnonzero((x == 0) | (x == size - 1) | (y == 0) | (y == size - 1) | (c % width == width - 1) | leaves)
        ends = pa.array(c[end[rim]], mask=~leaves[end[rim]])
        return pa.table({"c": c[rim], "end": ends, "rec": rows.column("rec").take(pa.array(rim)), "leaves": leaves[rim], "v": total[rim]})

    rim = settled(cells.groupBy("ti", "tj").applyInArrow(leaving, f"c long, end long, rec long, leaves boolean, v {real}"))
    out = rim.where("leaves").select("c", F.col("rec").alias("to"), "v")
    links = out.join(rim.select(F.col("c").alias("to"), "end"), "to", "left").select("c", F.coalesce("end", "c").alias("rec"), "to", "v")
    flows = chained(settled(links), "v", "_through")
    came = flows.groupBy(F.col("to").alias("c")).agg(F.sum("_through").cast(real).alias("in"))
    whole = cells.join(came, "c", "left").withColumn("v", (F.col("v") + F.coalesce("in", F.lit(0))).cast(real)).drop("in")

    def within(rows: pa.Table) -> pa.Table:
        c, at, _ = _forest(rows)
        return pa.table({"c": c, "total": _gathered(at, rows.column("v").to_numpy())})

    sums = whole.groupBy("ti", "tj").applyInArrow(within, f"c long, total {real}")
    return forest.join(sums.select("c", F.col("total").cast(kind).alias(name)), "c")


def flow_depth(forest: DataFrame, width: int, size: int, chained: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(c, root, depth)``: where each cell of ``forest(c, rec)`` drains to, and in how many steps; ways between tiles are settled by ``chained``."""

    def within(rows: pa.Table) -> pa.Table:
        c, at, leaves = _forest(rows)
        end, steps = _ends(at)
        to = pa.array(rows.column("rec").to_numpy()[end], mask=~leaves[end])
        return pa.table({"c": c, "end": c[end], "steps": steps, "to": to})

    cells = settled(of_tiles(forest.select("c", "rec"), width, size).groupBy("ti", "tj").applyInArrow(within, "c long, end long, steps long, to long"))
    # From a cell that others enter at, to the one that its way enters the next tile at.
    entered = cells.where("to is not null").select(F.col("to").alias("c")).distinct()
    ways = cells.join(entered, "c", "left_semi").select("c", F.coalesce("to", "end").alias("rec"), (F.col("steps") + F.col("to").isNotNull().cast("long")).alias("steps"), F.col("to").isNull().alias("arrived"))
    met = settled(chained(settled(ways)))
    out = cells.join(met.select(F.col("c").alias("to"), "root", F.col("depth").alias("further")), "to", "left")
    return out.select("c", F.coalesce("root", "end").alias("root"), (F.col("steps") + F.coalesce(F.col("further") + 1, F.lit(0))).alias("depth"))


def composed(maps: DataFrame, width: int, size: int, chained: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(c, a)``: the value of each cell of ``maps(c, r, a, b)``, ``a + b`` times the value at ``r`` (``a`` alone where ``r`` is null); ways between tiles are settled by ``chained``."""

    def within(rows: pa.Table) -> pa.Table:
        fixed = rows.column("r").is_null().to_numpy()
        rec = np.where(fixed, rows.column("c").to_numpy(), rows.column("r").fill_null(0).to_numpy())
        c, at, leaves = _forest(pa.table({"c": rows.column("c"), "rec": rec}))
        end, _ = _ends(at)
        own_a, own_b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        # The map of a way's end is taken once, at last; until then ends change nothing.
        a, b = np.where(at < 0, 0.0, own_a), np.where(at < 0, 1.0, own_b)
        at = np.where(at < 0, np.arange(len(at)), at)
        while (at != end).any():
            a, b, at = a + b * a[at], b * b[at], at[at]
        a, b = a + b * own_a[end], b * own_b[end]
        return pa.table({"c": c, "to": pa.array(rec[end], mask=~leaves[end]), "a": a, "b": b})

    cells = settled(of_tiles(maps, width, size).groupBy("ti", "tj").applyInArrow(within, "c long, to long, a double, b double"))
    entered = cells.where("to is not null").select(F.col("to").alias("c")).distinct()
    met = settled(chained(settled(cells.join(entered, "c", "left_semi").select("c", F.col("to").alias("r"), "a", "b"))))
    out = cells.join(met.select(F.col("c").alias("to"), F.col("a").alias("_at")), "to", "left")
    return out.select("c", (F.col("a") + F.when(F.col("to").isNotNull(), F.col("b") * F.col("_at")).otherwise(F.lit(0.0))).alias("a"))


# --- filling -------------------------------------------------------------------------------------------------------


#: The label of all outlets.
OCEAN = -1
_AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def flooded(h: np.ndarray, seeds: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lowest level at which each cell of a block (infinite: no cell) is reached from a seed ``(level, place, label)``, and whose label reaches it."""
    rows, columns = h.shape
    flat = h.ravel().tolist()
    level, label = [np.inf] * len(flat), [0] * len(flat)
    heap = list(seeds)
    heapq.heapify(heap)
    while heap:
        now, at, own = heapq.heappop(heap)
        if level[at] != np.inf:
            continue
        level[at], label[at] = now, own
        i, j = divmod(at, columns)
        for di, dj in _AROUND:
            if 0 <= i + di < rows and 0 <= j + dj < columns:
                near = at + di * columns + dj
                if level[near] == np.inf and flat[near] != np.inf:
                    heapq.heappush(heap, (max(now, flat[near]), near, own))
    return np.array(level).reshape(h.shape), np.array(label, np.int64).reshape(h.shape)


def spill_levels(edges: DataFrame) -> DataFrame:
    """``(label, level)``: the lowest highest edge of a way from each label of ``edges(a, b, w)`` to the ocean.

    While there are more edges than a task settles, every other component (by a
    coin of its own) joins another at its lowest edge: all ways out of it are as
    high at least, so its labels' levels rise to that; edges inside components go.
    """
    edges = settled(edges.groupBy("a", "b").agg(F.min("w").alias("w")))
    labels = None
    for number in range(200):
        if edges.count() <= LINKS:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != OCEAN)
        lowest = both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("x")).select("a", "x.*")
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(2))
        hooks = settled(lowest.where((coin("a") == 1) & ((F.col("b") == OCEAN) | (coin("b") == 0))).select("a", "b", "w"))
        if labels is None:
            labels = edges.select(F.col("a").alias("label")).unionByName(edges.select(F.col("b").alias("label"))).distinct().where(F.col("label") != OCEAN).select("label", F.col("label").alias("at"), F.lit(float("-inf")).alias("level"))
        moved = labels.join(hooks.select(F.col("a").alias("at"), "b", "w"), "at", "left")
        labels = settled(moved.select("label", F.coalesce("b", "at").alias("at"), F.greatest("level", F.coalesce("w", F.lit(float("-inf")))).alias("level")))
        for end in ("a", "b"):
            to = hooks.select(F.col("a").alias(end), F.col("b").alias("_to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))

    def settle(rows: pa.Table) -> pa.Table:
        a, b, w = (rows.column(c).to_numpy() for c in ("a", "b", "w"))
        nodes, at = np.unique(np.concatenate([a, b, [OCEAN]]), return_inverse=True)
        source, target, cost = np.concatenate([at[: len(a)], at[len(a) : -1]]), np.concatenate([at[len(a) : -1], at[: len(a)]]), np.concatenate([w, w])
        order = np.argsort(source, kind="stable")
        first = np.searchsorted(source[order], np.arange(len(nodes) + 1)).tolist()
        target, cost = target[order].tolist(), cost[order].tolist()
        level = [np.inf] * len(nodes)
        heap = [(-np.inf, int(at[-1]))]
        while heap:
            now, node = heapq.heappop(heap)
            if level[node] != np.inf:
                continue
            level[node] = now
            for k in range(first[node], first[node + 1]):
                if level[target[k]] == np.inf:
                    heapq.heappush(heap, (max(now, cost[k]), target[k]))
        return pa.table({"at": nodes, "last": pa.array(level, pa.float64())})

    last = edges.groupBy().applyInArrow(settle, "at long, last double")
    if labels is None:
        return last.where(F.col("at") != OCEAN).select(F.col("at").alias("label"), F.col("last").alias("level"))
    # A component of the ocean has its levels; one without edges that isn't reaches nothing.
    done = labels.join(last, "at", "left")
    reached = F.when(F.col("at") == OCEAN, F.col("level")).otherwise(F.greatest("level", F.coalesce("last", F.lit(float("inf")))))
    return done.select("label", reached.alias("level"))


def spill_surface(cells: DataFrame, width: int, size: int = SIZE) -> DataFrame:
    """``cells(i, j, h double, outlet)`` with ``w``: the lowest highest cell of a way from each cell to an outlet (infinite without one)."""

    def flood(rows: pa.Table) -> pa.Table:
        i, j, h, outlet = (rows.column(c).to_numpy() for c in ("i", "j", "h", "outlet"))
        li, lj = i % size, j % size
        shape = (int(li.max()) + 1, int(lj.max()) + 1)
        block = np.full(shape, np.inf)
        block[li, lj] = h
        place = li.astype(np.int64) * shape[1] + lj
        name = i.astype(np.int64) * width + j
        rim = (li == 0) | (li == size - 1) | (lj == 0) | (lj == size - 1) | (j == width - 1)
        seed = np.flatnonzero(rim | outlet)
        level, label = flooded(block, list(zip(h[seed].tolist(), place[seed].tolist(), np.where(outlet[seed], OCEAN, name[seed]).tolist(), strict=True)))
        w, own = level[li, lj], label[li, lj]
        number = np.full(shape, -1)
        number[li, lj] = np.arange(len(i))
        a, b = _adjacent(number, HALF)
        cross = own[a] != own[b]
        a, b = a[cross], b[cross]
        high, x, y = np.maximum(w[a], w[b]), np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
        good = np.isfinite(high)
        high, x, y = high[good], x[good], y[good]
        order = np.lexsort((high, y, x))
        high, x, y = high[order], x[order], y[order]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        many, edges = len(i), int(first.sum())
        none = pa.nulls(edges, pa.int32())
        return pa.table({"i": pa.chunked_array([pa.array(i, pa.int32()), none]), "j": pa.chunked_array([pa.array(j, pa.int32()), none]), "a": np.concatenate([own, x[first]]), "b": pa.chunked_array([pa.nulls(many, pa.int64()), pa.array(y[first], pa.int64())]), "w": np.concatenate([w, high[first]])})

    typed = cells.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "h", "outlet")
    found = settled(tiled(typed, size).groupBy("ti", "tj").applyInArrow(flood, "i int, j int, a long, b long, w double"))
    own = found.where("i is not null").select("i", "j", F.col("a").alias("label"), "w")
    across = border(own, size, width, HALF, ["label", "w"])
    across = across.select(F.least("label", "n_label").alias("a"), F.greatest("label", "n_label").alias("b"), F.greatest("w", "n_w").alias("w")).where("a <> b and w < double('inf')")
    levels = spill_levels(found.where("i is null").select("a", "b", "w").unionByName(across))
    wet = own.where(F.col("label") == OCEAN).select("i", "j", "w")
    inland = own.where(F.col("label") != OCEAN).join(levels, "label", "left")
    surface = wet.unionByName(inland.select("i", "j", F.greatest("w", F.coalesce("level", F.lit(float("inf")))).alias("w")))
    return cells.join(surface, ["i", "j"])


def softened(state: DataFrame, width: int, eps: float, size: int) -> DataFrame:
    """``state(i, j, h, outlet, f, soft)`` of one row a cell, with more of them ``soft``: those that ``f`` of their neighbours leaves less than ``eps`` of slope.

    ``rim`` is the lowest height among a soft cell's other neighbours, ``new``
    tells which cells have become soft.  Two rings of halo carry all that a tile needs.
    """

    def look(rows: pa.Table) -> pa.Table:
        li, lj, own = (rows.column(c).to_numpy() for c in ("li", "lj", "own"))
        x, y = li - li.min() + 1, lj - lj.min() + 1
        shape = (int(x.max()) + 2, int(y.max()) + 2)
        h, f = (dense(rows, x, y, shape, c, np.inf) for c in ("h", "f"))
        outlet, soft = dense(rows, x, y, shape, "outlet", True), dense(rows, x, y, shape, "soft", False)
        now = soft | ~outlet & np.isfinite(f) & (h < _lowest(f) + eps)
        rim = _lowest(np.where(now, np.inf, h))
        x, y = x[own], y[own]
        keep = rows.filter(pa.array(own))
        return pa.table({"i": keep.column("i"), "j": keep.column("j"), "h": keep.column("h"), "outlet": keep.column("outlet"), "f": keep.column("f"), "soft": now[x, y], "new": (now & ~soft)[x, y], "rim": rim[x, y]})

    dealt = with_halo(state.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "h", "outlet", "f", "soft"), size, 2, width)
    return dealt.groupBy("ti", "tj").applyInArrow(look, "i int, j int, h double, outlet boolean, f double, soft boolean, new boolean, rim double")


def _lowest(block: np.ndarray) -> np.ndarray:
    """The lowest of each cell's eight neighbours in a block with a ring of no cells."""
    out = np.full(block.shape, np.inf)
    inner = out[1:-1, 1:-1]
    for di, dj in _AROUND:
        np.minimum(inner, block[1 + di : block.shape[0] - 1 + di, 1 + dj : block.shape[1] - 1 + dj], out=inner)
    return out


def raised(cells: DataFrame, width: int, eps: float) -> DataFrame:
    """``(i, j, f)`` of soft ``cells(i, j, h, rim, label)``: ``max(h, lowest neighbour + eps)``, each labelled stretch from its rim inwards."""

    def raise_(rows: pa.Table) -> pa.Table:
        i, j, h, rim = (rows.column(c).to_numpy() for c in ("i", "j", "h", "rim"))
        place = i.astype(np.int64) * width + j
        at = {c: k for k, c in enumerate(place.tolist())}
        heights, f = h.tolist(), [np.inf] * len(h)
        heap = [(max(a, b + eps), k) for k, (a, b) in enumerate(zip(heights, rim.tolist(), strict=True)) if b != np.inf]
        heapq.heapify(heap)
        columns = j.tolist()
        while heap:
            level, k = heapq.heappop(heap)
            if f[k] != np.inf:
                continue
            f[k] = level
            for di, dj in _AROUND:
                near = at.get(int(place[k]) + di * width + (columns[k] + dj) % width - columns[k])
                if near is not None and f[near] == np.inf:
                    heapq.heappush(heap, (max(heights[near], level + eps), near))
        return pa.table({"i": i, "j": j, "f": pa.array(f, pa.float64())})

    return cells.select("i", "j", "h", "rim", "label").groupBy("label").applyInArrow(raise_, "i int, j int, f double")
