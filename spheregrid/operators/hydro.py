"""Drainage on a grid ``(i, j, h)``: filling, routing, accumulation, regions and incision.

What a sequential kernel does along a cell's way through the grid is settled
inside square tiles, and between tiles on graphs of their borders only
(``tiles``); what is left of a forest takes pointer jumping.  Rows wrap in
longitude unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.functions.geometry import cell_area_km2, row_cos
from spheregrid.functions.noise import hash01
from spheregrid.operators import tiles
from spheregrid.sources.tables import settled

# The eight neighbours in the order in which ties are broken.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
#: Rounds between two looks at whether anything still changes.
ROUNDS = 4


def neighbours(grid: DataFrame, width: int | None, columns: list[str]) -> DataFrame:
    """Each cell with each of its existing neighbours: ``k, di, dj`` and the neighbour's columns with ``n_`` before."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, (di, dj) in enumerate(NEIGHBOURS)])
    spread = grid.withColumn("_s", F.explode(steps)).select("*", "_s.*").drop("_s")
    nj = F.col("j") + F.col("dj")
    spread = spread.withColumn("n_i", F.col("i") + F.col("di")).withColumn("n_j", F.pmod(nj, F.lit(width)) if width else nj)
    near = grid.select(F.col("i").alias("n_i"), F.col("j").alias("n_j"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return spread.join(near, ["n_i", "n_j"])


#: Cells of one connected stretch of flats that a task raises; larger ones are settled in rounds over the grid.
STRETCH = 4_000_000


def fill_depressions(grid: DataFrame, height: int, width: int, eps: float, sea: float = 0, name: str = "f", size: int = tiles.SIZE, stretch: int | None = None) -> DataFrame:
    """The least surface above ``h`` from which everything drains: ``f = h`` on outlets (``h <= sea``, first and last row), else ``max(h, lowest neighbour + eps)``.

    Tiles are flooded from their borders, the graph of spill heights between
    their watersheds is settled, and tiles are raised once (``tiles.spill_surface``).
    That is the surface for ``eps`` 0.  Otherwise only cells on flats and slopes
    under ``eps`` differ: connected stretches of them are raised from their
    rims, each in a task, and cells that so lose their slope join them until
    none does.  Neither depends on how long a lake or a valley is; only
    stretches of more than ``stretch`` cells are settled by rounds.  Integer
    heights with an ``eps`` that isn't whole are filled in double; cells without
    a way to an outlet are infinite (2^60 for integers).
    """
    kind = dict(grid.dtypes)["h"]
    whole = kind in ("bigint", "int")
    if whole and eps != int(eps):
        grid, kind, whole = grid.withColumn("h", F.col("h").cast("double")), "double", False
    outlet = (F.col("h") <= sea) | (F.col("i") == 0) | (F.col("i") == height - 1)
    cells = settled(grid.select("i", "j", F.col("h").cast("double").alias("h"), outlet.alias("outlet")))
    surface = tiles.spill_surface(cells, width, size).select("i", "j", "h", "outlet", F.col("w").alias("f"))
    if eps > 0:
        surface = _sloped(settled(surface), width, eps, size, STRETCH if stretch is None else stretch)
        if surface is None:
            return _filled_by_rounds(grid, height, width, eps, sea, name)
    top = F.lit(1 << 60) if whole else F.lit(float("inf"))
    filled = surface.select("i", "j", F.when(F.col("f") == float("inf"), top).otherwise(F.col("f")).cast(kind).alias(name))
    return grid.drop(name).join(filled, ["i", "j"])


def _sloped(state: DataFrame, width: int, eps: float, size: int, stretch: int) -> DataFrame | None:
    """``state(i, j, h, outlet, f)`` with ``f`` raised by ``eps`` a step over flats; None if a stretch of them is too large for a task."""
    state = state.withColumn("soft", F.lit(False))
    while True:
        found = settled(tiles.softened(state, width, eps, size))
        if found.where("new").isEmpty():
            return found.select("i", "j", "f")
        soft = found.where("soft")
        named = settled(tiles.regions(soft, width, size, diagonal=True, wrap=True))
        if named.groupBy("label").count().agg(F.max("count")).first()[0] > stretch:
            return None
        raised = tiles.raised(soft.join(named, ["i", "j"]), width, eps)
        state = found.select("i", "j", "h", "outlet", "soft", "f").join(raised.withColumnRenamed("f", "_f"), ["i", "j"], "left")
        state = settled(state.withColumn("f", F.coalesce("_f", F.when(F.col("f") == float("inf"), F.col("f")).otherwise(F.col("h")))).drop("_f"))


def _filled_by_rounds(grid: DataFrame, height: int, width: int, eps: float, sea: float, name: str, max_rounds: int = 100_000) -> DataFrame:
    """The filled surface as a fixpoint over the whole grid: falls from infinity until nothing changes.

    The minimum over the neighbourhood comes from two windows, along rows (closed) and columns.
    """
    outlet = (F.col("h") <= sea) | (F.col("i") == 0) | (F.col("i") == height - 1)
    kind = dict(grid.dtypes)["h"]
    top = F.lit(1 << 60).cast(kind) if kind in ("bigint", "int") else F.lit(float("inf"))
    state = settled(grid.withColumn(name, F.when(outlet, F.col("h")).otherwise(top)))
    # Ranges by position, so missing cells are no neighbours.
    row, column = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i").rangeBetween(-1, 1)
    f = F.col(name)
    for _ in range(0, max_rounds, ROUNDS):
        new = state.withColumn("_old", f)
        for _ in range(ROUNDS):
            first = F.min(F.when(F.col("j") == 0, f)).over(Window.partitionBy("i"))
            last = F.min(F.when(F.col("j") == width - 1, f)).over(Window.partitionBy("i"))
            near = F.least(F.min(f).over(row.rangeBetween(-1, 1)), F.when(F.col("j") == width - 1, first), F.when(F.col("j") == 0, last))
            new = new.withColumn("_row", near).withColumn(name, F.when(outlet, F.col("h")).otherwise(F.least(f, F.greatest(F.col("h"), (F.min("_row").over(column) + F.lit(eps).cast(kind)).cast(kind)))))
        new = settled(new.withColumn("_moved", f < F.col("_old")).drop("_row", "_old"))
        state = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return state
    raise RuntimeError("the filled surface did not settle")


def _drops(grid: DataFrame, surface: str, width: int, cosine: Column | None) -> DataFrame:
    """Downhill neighbours of each cell with the slope to them."""
    near = neighbours(grid, width, [surface])
    dj = F.col("dj") if cosine is None else F.col("dj") * cosine
    slope = (F.col(surface) - F.col(f"n_{surface}")) / F.sqrt(F.col("di") * F.col("di") + dj * dj)
    return near.withColumn("slope", slope).where("slope > 0").withColumn("rec", F.col("n_i").cast("long") * width + F.col("n_j"))


def receivers(grid: DataFrame, surface: str, width: int, sea: float | None = 0, cosine: Column | None = None) -> DataFrame:
    """``(c, rec)``: each cell ``i * width + j`` and its steepest downhill neighbour, the first of equally steep ones; roots point to themselves."""
    land = grid if sea is None else grid.where(F.col("h") > sea)
    best = _drops_of(land, grid, surface, width, cosine).groupBy("i", "j").agg(F.max_by("rec", F.struct("slope", -F.col("k"))).alias("rec"))
    cell = F.col("i").cast("long") * width + F.col("j")
    return grid.join(best, ["i", "j"], "left").select(cell.alias("c"), F.coalesce("rec", cell).alias("rec"))


def _drops_of(land: DataFrame, grid: DataFrame, surface: str, width: int, cosine: Column | None) -> DataFrame:
    return _drops(grid, surface, width, cosine).join(land.select("i", "j"), ["i", "j"], "left_semi")


def stochastic_receivers(grid: DataFrame, surface: str, width: int, step: int, power: float = 1.0, sea: float = 0, cosine: Column | None = None) -> DataFrame:
    """As ``receivers``, but each downhill neighbour is taken with a chance in proportion to slope^power, by the hash of cell and step."""
    cell = F.col("i").cast("long") * width + F.col("j")
    drops = _drops(grid.where(F.lit(True)), surface, width, cosine).where(F.col("h") > sea).withColumn("c", cell).withColumn("w", F.pow("slope", F.lit(power)))
    order = Window.partitionBy("c").orderBy("k")
    drops = drops.withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy("c")))
    r = hash01(F.col("c"), F.lit(step)) * F.col("all")
    picked = drops.withColumn("hit", r < F.col("cum")).groupBy("c").agg(F.coalesce(F.min_by("rec", F.when(F.col("hit"), F.col("k"))), F.max_by("rec", "k")).alias("rec"))
    return grid.select(cell.alias("c")).join(picked, "c", "left").select("c", F.coalesce("rec", "c").alias("rec"))


def accumulate(forest: DataFrame, own: str, name: str = "acc", width: int | None = None, size: int = tiles.SIZE) -> DataFrame:
    """``forest(c, rec, own)`` with the sum of ``own`` over each cell and all that drains through it.

    Where the grid's ``width`` is given (and cells drain to neighbours), tiles
    are summed first and only the links between their borders take rounds.
    Pointer jumping: after round r every cell holds the sum of all within
    2^r steps upstream, so rounds grow with the logarithm of the longest path.
    """
    if width:
        return tiles.accumulate(forest, own, name, width, size, accumulate)
    kind = dict(forest.dtypes)[own]
    state = settled(forest.select("c", F.when(F.col("rec") != F.col("c"), F.col("rec")).alias("r"), F.col(own).alias("a")))
    while True:
        # Only cells that still point somewhere jump; those that have arrived just receive.
        open_ = state.where("r is not null")
        if open_.isEmpty():
            break
        gain = open_.groupBy(F.col("r").alias("c")).agg(F.sum("a").alias("g"))
        hop = state.select(F.col("c").alias("r"), F.col("r").alias("rr"))
        jumped = open_.join(hop, "r").select("c", F.col("rr").alias("r"), "a").unionByName(state.where("r is null"))
        state = settled(jumped.join(gain, "c", "left").select("c", "r", (F.col("a") + F.coalesce("g", F.lit(0))).cast(kind).alias("a")))
    return forest.join(state.select("c", F.col("a").alias(name)), "c")


def flow_depth(forest: DataFrame, width: int | None = None, size: int = tiles.SIZE) -> DataFrame:
    """``(c, root, depth)``: where each cell drains to, and in how many steps; with the grid's ``width`` by tiles, as ``accumulate``.

    A cell that points to a root has arrived and takes part in no further join,
    so no join has all cells of a basin under one key.
    """
    if width:
        return tiles.flow_depth(forest, width, size, _chained_depth)
    return _chained_depth(forest.select("c", "rec", (F.col("rec") != F.col("c")).cast("long").alias("steps"), (F.col("rec") == F.col("c")).alias("arrived")))


def _chained_depth(links: DataFrame) -> DataFrame:
    """``(c, root, depth)`` of ``links(c, rec, steps, arrived)``, by pointer jumping."""
    every = settled(links.select("c", F.col("rec").alias("r"), F.col("steps").alias("d"), F.col("arrived").alias("done")))
    while True:
        open_ = every.where("not done")
        if open_.isEmpty():
            return every.select("c", F.col("r").alias("root"), F.col("d").alias("depth"))
        # Whoever points to a cell that has arrived takes over its root.
        hop = every.select(F.col("c").alias("r"), F.col("r").alias("rr"), F.col("d").alias("dd"), F.col("done").alias("rdone"))
        moved = open_.join(hop, "r").select("c", F.col("rr").alias("r"), (F.col("d") + F.col("dd")).alias("d"), F.col("rdone").alias("done"))
        every = settled(moved.unionByName(every.where("done")))


def donors(forest: DataFrame) -> DataFrame:
    """``(c, donors)``: how many cells drain directly into each."""
    counts = forest.where("rec <> c").groupBy(F.col("rec").alias("c")).agg(F.count("*").alias("donors"))
    return forest.select("c").join(counts, "c", "left").select("c", F.coalesce("donors", F.lit(0)).cast("long").alias("donors"))


def regions(cells: DataFrame, width: int, size: int = tiles.SIZE) -> DataFrame:
    """``(i, j, label)``: 4-connected regions of the given cells (no wrap), labelled by their smallest ``i * width + j``; by tiles and the links between their borders."""
    return tiles.regions(cells, width, size)


def lake_mask(grid: DataFrame, filled: str, width: int, depth: float = 10.0, flat: float = 0.05, least: int = 40, sea: float = 0) -> DataFrame:
    """``grid`` with ``lake``: filled deeper than ``depth``, or flat (5 x 5 range under ``flat``) in a region of ``least`` cells; on land only."""
    from spheregrid.operators.windows import extrema

    ranged = extrema(grid, "h", 2).withColumn("_flat", (F.col("hi") - F.col("lo") < flat) & (F.col("h") > sea))
    marked = regions(ranged.where("_flat"), width)
    big = marked.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    flats = marked.join(big, "label").select("i", "j", F.lit(True).alias("_big"))
    return ranged.join(flats, ["i", "j"], "left").withColumn("lake", (F.col("h") > sea) & ((F.col(filled) - F.col("h") > depth) | F.coalesce("_big", F.lit(False)))).drop("lo", "hi", "_flat", "_big")


def incise(forest: DataFrame, factor: str, sea: float = 0, name: str = "h2", width: int | None = None, size: int = tiles.SIZE) -> DataFrame:
    """One implicit step of stream-power incision on ``forest(c, rec, h, factor)``: ``h' = (h + F max(sea, h'(rec))) / (1 + F)``.

    The update is affine in the receiver's new height, so a way's maps are
    composed: with the grid's ``width`` inside tiles first, then by pointer
    jumping down to the roots.  Roots and cells up to ``sea`` keep their height.
    """
    fixed = (F.col("rec") == F.col("c")) | (F.col("h") <= sea)
    maps = forest.select("c", F.when(~fixed, F.col("rec")).alias("r"), F.when(fixed, F.greatest(F.col("h").cast("double"), F.lit(float(sea)))).otherwise(F.col("h") / (1 + F.col(factor))).alias("a"), F.when(fixed, F.lit(0.0)).otherwise(F.col(factor) / (1 + F.col(factor))).alias("b"))
    new = tiles.composed(maps, width, size, _chained_maps) if width else _chained_maps(maps)
    new = new.select("c", F.col("a").alias("_a"))
    return forest.join(new, "c").withColumn(name, F.when(fixed, F.col("h").cast("double")).otherwise(F.col("_a"))).drop("_a")


def _chained_maps(maps: DataFrame) -> DataFrame:
    """``maps(c, r, a, b)`` with ``a`` the value of each cell: ``a + b`` times the value at ``r``."""
    state = settled(maps)
    while True:
        open_ = state.where("r is not null")
        if open_.isEmpty():
            return state
        hop = state.select(F.col("c").alias("r"), F.col("r").alias("rr"), F.col("a").alias("ra"), F.col("b").alias("rb"))
        jumped = open_.join(hop, "r").select("c", F.col("rr").alias("r"), (F.col("a") + F.col("b") * F.col("ra")).alias("a"), (F.col("b") * F.col("rb")).alias("b"))
        state = settled(jumped.unionByName(state.where("r is null")))


def route(grid: DataFrame, height: int, width: int, sea: float = 0.0, eps: float = 1e-3) -> DataFrame:
    """``grid`` filled, routed and accumulated: ``f``, the cell ``c``, its receiver ``rec`` and the area ``acc`` (km2) that drains through it."""
    filled = settled(fill_depressions(grid.withColumn("h", F.col("h").cast("double")), height, width, eps, sea))
    cell = F.col("i").cast("long") * width + F.col("j")
    forest = receivers(filled, "f", width, sea, row_cos(F.col("i"), height))
    area = filled.withColumn("c", cell).withColumn("_area", cell_area_km2(F.col("i"), height, width))
    return accumulate(settled(area.join(forest, "c")), "_area", width=width).drop("_area")


def water_layers(grid: DataFrame, height: int, width: int, sea: float = 0.0) -> DataFrame:
    """``(i, j, water, ocean, flowacc)``: ocean and lakes, ocean alone, and log10(1 + km2) of what drains through."""
    routed = settled(route(grid.select("i", "j", "h"), height, width, sea))
    marked = lake_mask(routed, "f", width, sea=sea)
    return marked.select("i", "j", ((F.col("h") <= sea) | F.col("lake")).alias("water"), (F.col("h") <= sea).alias("ocean"), F.log10(1 + F.col("acc")).alias("flowacc"))
