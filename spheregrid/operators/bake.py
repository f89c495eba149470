"""From equirectangular rasters to a cube of faces with context, and training patches from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.functions.geometry import face_pixel_latlon, px_km
from spheregrid.functions.noise import hash01
from spheregrid.operators.hydro import water_layers
from spheregrid.operators.predicates import mark_holdout
from spheregrid.operators.resample import block_mean, sample_equirect, sample_layers
from spheregrid.operators.windows import face_distances
from spheregrid.sources.tables import settled

CLIMATE = ("tavg", "trange", "prec")


def on_pixels(spark: SparkSession, n: int, pad: int, grid: DataFrame, height: int, width: int, layers: list[str], nearest: set[str], bytes_: set[str] = frozenset()) -> DataFrame:
    """The layers of a grid at every pixel of the six faces, ``pad`` pixels beyond the edges included."""
    points = face_pixel_latlon(spark, n, pad).withColumn("_p", F.concat_ws("/", "face", "i", "j"))
    return sample_layers(points, "_p", grid, height, width, layers, nearest, bytes_).drop("_p", "u", "v")


def bake(grid: DataFrame, height: int, width: int, n: int, layers: list[str], boxes: list[tuple[float, float, float, float]] = (), nearest: set[str] = frozenset(), bytes_: set[str] = frozenset(), factor: int = 8, pad: int = 896, distance_pad: int = 1024, cap_km: float = 2500.0, fine_pad: int = 0, coarse_height: tuple[DataFrame, int, int] | None = None, flow_downsample: int = 1) -> tuple[DataFrame, ...]:
    """Two tables from ``grid(i, j, h, layers)``: the faces' pixels and their coarse context.

    Pixels have ``face, i, j, lat, lon, height``, the layers, the derived
    ``water`` and ``flowacc``, four distances to the ocean, and ``holdout`` (in
    any of the boxes).  The context has one pixel for ``factor`` fine ones and
    reaches ``pad`` fine pixels beyond the edges: heights are block means, or
    those of ``coarse_height`` (``(i, j, h)`` and its size), and what derives
    from them is derived again.  ``flow_downsample`` routes the fine water on
    block means of so many cells; with ``fine_pad`` a third table has the fine
    layers so far beyond each face's edges too.
    """
    if pad % factor:
        raise ValueError("the context's pad must be a multiple of its factor")
    spark = grid.sparkSession

    def watered(source: DataFrame, h: int, w: int, down: int = 1) -> tuple[DataFrame, int, int]:
        """``(i, j, water, ocean, flowacc)`` of a source, on cells of ``down`` of its own."""
        relief = source.select("i", "j", "h") if down == 1 else settled(block_mean(source, down, ["h"], h, w).drop("n"))
        return settled(water_layers(relief, h // down, w // down)), h // down, w // down

    def faces(source: DataFrame, h: int, w: int, water: tuple[DataFrame, int, int], side: int, around: int, extra: list[str]) -> DataFrame:
        """The source and its water layers on faces of ``side`` pixels and ``around`` more."""
        wet, wh, ww = water
        plain = set(nearest) & set(extra)
        if (wh, ww) == (h, w):
            cells = on_pixels(spark, side, around, source.join(wet, ["i", "j"]), h, w, ["h", "water", "flowacc", *extra], plain | {"water"}, bytes_)
        else:
            flow = on_pixels(spark, side, around, wet, wh, ww, ["water", "flowacc"], {"water"}).drop("lat", "lon")
            cells = on_pixels(spark, side, around, source, h, w, ["h", *extra], plain, bytes_).join(flow, ["face", "i", "j"])
        return cells.withColumnRenamed("h", "height")

    ocean = lambda water, side, wider: on_pixels(spark, side, wider, *water, ["ocean"], {"ocean"})
    distances = lambda df: df.select("face", "i", "j", *[f"dist_{d}" for d in ("up", "down", "left", "right")])
    wet = watered(grid, height, width, flow_downsample)
    cells = faces(grid, height, width, wet, n, 0, layers)
    fine = mark_holdout(cells, list(boxes)).join(distances(face_distances(ocean(wet, n, distance_pad), "ocean", n, px_km(n), cap_km)), ["face", "i", "j"])
    padded = faces(grid, height, width, wet, n, fine_pad, layers) if fine_pad else None

    side, beyond = n // factor, pad // factor
    climate = [c for c in CLIMATE if c in layers]
    coarse, ch, cw = coarse_height or (settled(block_mean(grid, factor, ["h"], height, width).drop("n")), height // factor, width // factor)
    wet = watered(coarse, ch, cw)
    cells = faces(coarse.select("i", "j", "h"), ch, cw, wet, side, beyond, [])
    if climate:
        points = cells.withColumn("_p", F.concat_ws("/", "face", "i", "j"))
        cells = sample_equirect(points, "_p", grid, climate, height, width).drop("_p")
    # The context's own edge ends its distances; its first row and column count from 0.
    moved = lambda df: df.withColumn("i", F.col("i") + beyond).withColumn("j", F.col("j") + beyond)
    context = moved(cells).join(distances(face_distances(moved(ocean(wet, side, beyond)), "ocean", side + 2 * beyond, px_km(n) * factor, cap_km)), ["face", "i", "j"])
    return (fine, context) if padded is None else (fine, context, padded)


def holdout_boxes(cells: DataFrame) -> DataFrame:
    """``(face, i0, i1, j0, j1)``: the bounding box of what each face holds out; a face without any has no row."""
    return cells.where("holdout").groupBy("face").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def acceptable(cells: DataFrame, n: int, patch: int, factor: int, split: str, min_land: float = 0.0) -> DataFrame:
    """``(face, bi, bj)``: the origins, in units of ``factor`` pixels, of patches that a split accepts.

    Training patches hold nothing out, validation ones everything; ``min_land``
    is the least share of land.  Blocks of ``factor`` pixels are counted once
    and every window adds up blocks, along rows and then columns.
    """
    if patch > n or patch % factor:
        raise ValueError("a patch must fit a face and be a multiple of the context's factor")
    blocks = cells.groupBy("face", F.floor(F.col("i") / factor).alias("bi"), F.floor(F.col("j") / factor).alias("bj")).agg(F.count_if("holdout").alias("held"), F.count_if(F.col("height") > 0).alias("land"))
    side, last = patch // factor, (n - patch) // factor
    for key, other in (("bi", "bj"), ("bj", "bi")):
        span = Window.partitionBy("face", key).orderBy(other).rowsBetween(0, side - 1)
        blocks = blocks.withColumns({c: F.sum(c).over(span) for c in ("held", "land")})
    wanted = F.col("held") == (0 if split == "train" else patch * patch)
    return blocks.where((F.col("bi") <= last) & (F.col("bj") <= last) & wanted & (F.col("land") >= min_land * patch * patch)).select("face", "bi", "bj")


def ranked_origins(origins: DataFrame) -> DataFrame:
    """``origins(face, bi, bj)`` with ``rank``, from 0 along rows, face by face; a row of blocks is counted in one task, faces by their rows' counts."""
    rows = origins.groupBy("face", "bi").agg(F.count("*").alias("_n"))
    faces = rows.groupBy("face").agg(F.sum("_n").alias("_m"))
    faces = faces.select("face", F.coalesce(F.sum("_m").over(Window.orderBy("face").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_faces"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("face").orderBy("bi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("face", "bi", before.alias("_rows")).join(faces, "face")
    own = F.row_number().over(Window.partitionBy("face", "bi").orderBy("bj")) - 1
    return origins.withColumn("_own", own).join(rows, ["face", "bi"]).select("face", "bi", "bj", (F.col("_faces") + F.col("_rows") + F.col("_own")).alias("rank"))


def seeded_patches(cells: DataFrame, indices: DataFrame, seed: int, n: int, patch: int, factor: int, split: str = "train", min_land: float = 0.0) -> DataFrame:
    """``(idx, face, i0, j0, turns, flip)``: the patch of each ``indices(idx)``, by (seed, idx) alone.

    Drawing origins until the split accepts one gives each accepted origin the
    chance that a single draw has of it; so the accepted ones are ranked once
    and every index selects one by its rank.  Training draws are even over all
    origins; validation draws take one of the held-out boxes (one for each
    face that has any) and an origin whose window meets it, so an origin's
    chance falls with the number that its box has.  A null index draws nothing; a split that accepts nothing raises.
    """
    draw = lambda k: hash01(F.col("idx") * 1_000_003 + k, F.lit(seed))
    ranked = settled(ranked_origins(acceptable(cells, n, patch, factor, split, min_land)))
    counts = {r["face"]: r["count"] for r in ranked.groupBy("face").count().collect()}  # six at most
    last = (n - patch) // factor
    share = dict.fromkeys(counts, 1.0)
    if split == "val":
        boxes = {r["face"]: r for r in holdout_boxes(cells).collect()}  # six at most
        if not boxes:
            raise ValueError("nothing is held out: the validation split is empty")
        width = lambda low, high: min(high // factor, last) - max(low - (patch - 1), 0) // factor + 1
        share = {f: 1.0 / (width(boxes[f]["i0"], boxes[f]["i1"]) * width(boxes[f]["j0"], boxes[f]["j1"])) for f in counts}
    if not counts:
        raise ValueError(f"the {split} split accepts no patch")
    # The faces' parts of the draw, in order; within its part a draw is even over the face's accepted origins.
    total, low, first, pick = sum(counts[f] * share[f] for f in counts), 0.0, 0, None
    for f in sorted(counts):
        part = counts[f] * share[f] / total
        own = F.least(F.floor((draw(0) - low) / part * counts[f]), F.lit(counts[f] - 1)) + first
        pick = F.when(draw(0) < low + part, own) if pick is None else pick.when(draw(0) < low + part, own)
        low, first = low + part, first + counts[f]
    drawn = indices.where("idx is not null").select("idx", F.coalesce(pick, F.lit(first - 1)).cast("long").alias("rank"), F.floor(draw(3) * 4).cast("int").alias("turns"), (draw(4) < 0.5).alias("flip"))
    return drawn.join(ranked, "rank").select("idx", "face", (F.col("bi") * factor).alias("i0"), (F.col("bj") * factor).alias("j0"), "turns", "flip")


def patch_cells(patches: DataFrame, cells: DataFrame, patch: int, factor: int, around: int = 0) -> DataFrame:
    """The cells of each of ``patches(idx, face, i0, j0)`` and ``around`` cells beyond it, ``a, b`` from its first one: blocks of ``factor`` cells are joined, never all cells with all patches.

    For the context give its own ``factor`` 1, and origins and sizes in its pixels.
    """
    if around % factor:
        raise ValueError("what is read around a patch must be a multiple of the context's factor")
    side, beyond = patch // factor, around // factor
    steps = F.sequence(F.lit(-beyond), F.lit(side + beyond - 1))
    wanted = patches.select("idx", "face", "i0", "j0", F.explode(steps).alias("_y")).select("*", F.explode(steps).alias("_x"))
    wanted = wanted.select("idx", "face", "i0", "j0", (F.floor(F.col("i0") / factor) + F.col("_y")).alias("_bi"), (F.floor(F.col("j0") / factor) + F.col("_x")).alias("_bj"))
    blocks = cells.withColumn("_bi", F.floor(F.col("i") / factor)).withColumn("_bj", F.floor(F.col("j") / factor))
    read = wanted.join(blocks, ["face", "_bi", "_bj"])
    return read.select("idx", (F.col("i") - F.col("i0")).cast("int").alias("a"), (F.col("j") - F.col("j0")).cast("int").alias("b"), *[c for c in cells.columns if c not in ("face", "i", "j")])


def patch_sums(patches: DataFrame, cells: DataFrame, patch: int, factor: int, sums: dict[str, Column], around: int = 0) -> DataFrame:
    """``patches(face, i0, j0, ...)`` with aggregates of each one's window, columns over what ``patch_cells`` gives.

    Patches of the same origin have the same cells: each origin's window is read
    and added up once, and a patch looks its origin up. So what is grouped is
    bounded by the raster, and patches are neither multiplied nor grouped by index.
    """
    origins = patches.select(F.struct("face", "i0", "j0").alias("idx")).distinct().select("idx", "idx.*")
    seen = settled(patch_cells(origins, cells, patch, factor, around).groupBy("idx").agg(*[v.alias(c) for c, v in sums.items()]).select("idx.*", *sums))
    return patches.join(seen, ["face", "i0", "j0"]).select(*patches.columns, *sums)


def context_of(patches: DataFrame, context: DataFrame, patch: int, factor: int, pad: int, around: int) -> DataFrame:
    """The coarse context of each patch: its own pixels and ``around`` fine pixels beyond, from a context that reaches ``pad`` fine pixels beyond the faces."""
    coarse = patches.select("idx", "face", (F.floor(F.col("i0") / factor) + pad // factor).alias("i0"), (F.floor(F.col("j0") / factor) + pad // factor).alias("j0"))
    return patch_cells(coarse, context, patch // factor, 1, around // factor)
