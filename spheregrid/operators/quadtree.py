"""Quadtree nodes ``(face, level, x, y)``: geometry, leaf selection, and the upkeep of a set of built patches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.functions.geometry import dir_to_latlon, face_uv_to_dir, length
from spheregrid.functions.noise import detail_height, surface_height
from spheregrid.operators.resample import sample_face
from spheregrid.sources.tables import settled

NODE = ["face", "level", "x", "y"]


def node_bounds() -> tuple[Column, Column, Column, Column]:
    """(u0, u1, v0, v1); y counts down from +v."""
    side = F.lit(2.0) / F.pow(F.lit(2.0), F.col("level"))
    return F.col("x") * side - 1, (F.col("x") + 1) * side - 1, 1 - (F.col("y") + 1) * side, 1 - F.col("y") * side


def node_centre() -> tuple[Column, Column, Column]:
    u0, u1, v0, v1 = node_bounds()
    return face_uv_to_dir(F.col("face"), (u0 + u1) / 2, (v0 + v1) / 2)


def node_size(radius: float) -> Column:
    return F.lit(math.pi / 2 * radius) / F.pow(F.lit(2.0), F.col("level"))


#: Levels that are descended in one plan before what is reached is written: longer chains make plans and generated code too large.
DESCENT = 4


def select_leaves(cameras: DataFrame, radius: float, factor: float = 2.5, max_level: int = 18, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """Leaves ``(keys, face, level, x, y, dist)`` of each of ``cameras(keys, cx, cy, cz)``: a node splits while the camera is nearer to its centre than ``factor`` sizes.

    All cameras descend together: a level replaces nodes that split by their
    four children and passes the others on, row by row, so no level takes a
    shuffle or a look at how far any camera is; every ``DESCENT`` levels the
    rows of a table (not those of a stream) are written.
    """
    max_level = min(max_level, 30)
    six = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda f: F.struct(f.alias("face"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    rows = cameras.select(*keys, "cx", "cy", "cz", F.inline(six)).withColumn("leaf", F.lit(False))
    four = [(dx, dy) for dy in (0, 1) for dx in (0, 1)]
    for level in range(max_level + 1):
        rows = _distant(rows, radius)
        split = ~F.col("leaf") & (F.col("dist") < factor * node_size(radius)) & F.lit(level < max_level)
        rows = rows.withColumn("_split", split)
        nodes = [F.struct((F.col("level") + 1).alias("level"), (F.col("x") * 2 + dx).alias("x"), (F.col("y") * 2 + dy).alias("y"), F.lit(False).alias("leaf")) for dx, dy in four]
        same = F.array(F.struct("level", "x", "y", F.lit(True).alias("leaf")))
        if level < max_level:
            rows = rows.withColumn("_next", F.explode(F.when(F.col("_split"), F.array(*nodes)).otherwise(same))).select(*keys, "cx", "cy", "cz", "face", "_next.*")
        if level % DESCENT == DESCENT - 1 and level < max_level and not cameras.isStreaming:
            rows = settled(rows)
    return rows.select(*keys, *NODE, "dist")


def _distant(rows: DataFrame, radius: float) -> DataFrame:
    """``rows`` with ``dist`` from the camera to each node's centre; the centre is a column, so it is worked out once."""
    gap = [F.col("_c")[k] * radius - F.col(c) for k, c in enumerate(("cx", "cy", "cz"))]
    return rows.withColumn("_c", F.array(*node_centre())).withColumn("dist", F.sqrt(sum((g * g for g in gap), F.lit(0.0)))).drop("_c")


def patch_changes(wanted: DataFrame, built: DataFrame, budget: int = 12, keys: Sequence[str] = ()) -> DataFrame:
    """What a frame does: drops every stale patch and builds the ``budget`` nearest missing ones; for each camera that ``keys`` name."""
    drop = built.join(wanted, [*keys, *NODE], "left_anti").select(*keys, *NODE, F.lit("drop").alias("action"))
    missing = wanted.join(built, [*keys, *NODE], "left_anti")
    if keys:
        nearest = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", *NODE))
        missing = missing.withColumn("_rank", nearest).where(F.col("_rank") <= budget)
    else:
        missing = missing.orderBy("dist", *NODE).limit(budget)
    return drop.unionByName(missing.select(*keys, *NODE, F.lit("build").alias("action")))


def ground(points: DataFrame, key: str, cells: DataFrame, layer: str, n: int, radius: float, fine: Column | float, roughness: float, seed: int, name: str = "ground") -> DataFrame:
    """``points(key, x, y, z)`` (directions) with the surface's height: the cube's, with detail down to wavelength ``fine`` on land."""
    base = sample_face(points, key, cells, layer, n).withColumnRenamed(layer, "_base")
    lifted = detail_height(base, tuple(F.col(c) for c in "xyz"), radius, math.pi / 2 * radius / n, fine, roughness, seed, "_detail")
    return lifted.withColumn(name, surface_height(F.col("_base"), F.col("_detail"))).drop("_base", "_detail")


def patch_origins(nodes: DataFrame, cells: DataFrame, layer: str, n: int, radius: float, patch: int = 32, roughness: float = 0.02, seed: int = 0) -> DataFrame:
    """``nodes`` with ``ox, oy, oz``: each patch's centre, at the surface's height at the patch's own resolution."""
    x, y, z = node_centre()
    named = nodes.withColumn("_node", F.concat_ws("/", *NODE)).withColumn("x_", x).withColumn("y_", y).withColumn("z_", z).withColumn("_cell", node_size(radius) / patch)
    at = ground(named.select("_node", F.col("x_").alias("x"), F.col("y_").alias("y"), F.col("z_").alias("z"), "_cell"), "_node", cells, layer, n, radius, F.col("_cell"), roughness, seed, "_g")
    placed = at.select("_node", *[(F.col(c) * (radius + F.col("_g"))).alias(f"o{c}") for c in "xyz"])
    return named.drop("x_", "y_", "z_", "_cell").join(placed, "_node").drop("_node")


def under_cameras(cameras: DataFrame, cells: DataFrame, layer: str, n: int, radius: float, fine: float, roughness: float = 0.02, seed: int = 0) -> DataFrame:
    """``cameras(camera, x, y, z)`` in metres with ``lat``, ``lon``, the ``ground`` below and the ``altitude`` above it."""
    place = [F.col(c) for c in "xyz"]
    lat, lon = dir_to_latlon(place)
    seen = cameras.withColumn("lat", lat).withColumn("lon", lon).withColumn("_d", length(place))
    unit = seen.select("camera", "lat", "lon", "_d", *[(F.col(c) / F.col("_d")).alias(c) for c in "xyz"])
    return ground(unit, "camera", cells, layer, n, radius, fine, roughness, seed).select("camera", "lat", "lon", "ground", (F.col("_d") - radius - F.col("ground")).alias("altitude"))
