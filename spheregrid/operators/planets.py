"""Synthetic planets: continents, heights, climate, and their erosion."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spheregrid.functions.geometry import EARTH_RADIUS_KM, cell_area_km2, dir_to_latlon, equirect_grid, face_uv_to_dir, row_cos
from spheregrid.functions.noise import Perlin, Points, domain_warp, fbm, hash01, ridged, with_noise
from spheregrid.operators.hydro import accumulate, fill_depressions, incise, receivers, stochastic_receivers
from spheregrid.operators.tiles import stencils
from spheregrid.operators.windows import continentality, diffuse, gaussian, gaussian_step
from spheregrid.sources.tables import discard, remove, scratch, settled, written

XYZ = ("x", "y", "z")


# The defaults of planets and erosion, and the constants of relief and climate in the formulas below.
@dataclass(frozen=True)
class PlanetParams:
    seed: int = 0
    land: float = 0.3  # share of the sphere
    scale: float = 1.2  # frequency of continents
    mountain_height: float = 6000.0
    land_height: float = 1000.0
    shelf: float = -150.0
    deep: float = -4200.0
    equator: float = 28.0
    pole: float = -18.0
    humidity: float = 1.0
    lapse: float = 6.5  # degrees a kilometre


# The order in which a planet's noises take seeds, from its own upwards.
NOISES = ("continent", "warp", "mountain", "belt", "detail", "rain", "basin")
#: Directions from which the level of the sea is found.
SAMPLES = 200_000


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


class Planet:
    """Fields over directions ``(x, y, z)``: noise in one pass over the points, relief and climate as columns of it."""

    def __init__(self, spark: SparkSession, params: PlanetParams, samples: int = SAMPLES, threshold: float | None = None):
        self.spark, self.params = spark, params
        self.noises = {name: Perlin(params.seed + k) for k, name in enumerate(NOISES)}
        self.threshold = self._calibrate(samples) if threshold is None else threshold

    def _continents(self) -> Callable[[Points], list[np.ndarray]]:
        noises, scale = self.noises, self.params.scale
        return lambda p: [fbm(noises["continent"], domain_warp(noises["warp"], p, 0.8, 0.35), scale, 5, gain=0.55)]

    def _calibrate(self, samples: int) -> float:
        """The level above which the wanted share of a seeded sample of directions lies; the sample has a fixed size."""
        normals = np.random.default_rng(self.params.seed).normal(size=(samples, 3)).astype(np.float32)
        normals /= np.linalg.norm(normals, axis=1, keepdims=True)
        return self.sea_level(self.spark.createDataFrame(pd.DataFrame(normals.astype(float), columns=XYZ))).first()[0]

    def sea_level(self, d: DataFrame) -> DataFrame:
        """``(level)``: the level of the continents above which the wanted share of the directions ``d(x, y, z)`` lies."""
        return with_noise(d.select(*XYZ), XYZ, ["_c"], self._continents()).agg(F.percentile("_c", 1 - self.params.land).alias("level"))

    def height(self, d: DataFrame, name: str = "h") -> DataFrame:
        """``d(x, y, z, ...)`` with a height in metres: basins, lowland, ridged mountain belts, shelf and deep ocean."""
        p, n, continents = self.params, self.noises, self._continents()

        def fields(q: Points) -> list[np.ndarray]:
            basin = fbm(n["basin"], domain_warp(n["warp"], q, 0.6, 0.3), 0.9, 3)
            return [*continents(q), basin, fbm(n["belt"], q, 1.6, 3), ridged(n["mountain"], q, 5.0, 6), fbm(n["detail"], q, 6.0, 5), fbm(n["detail"], q, 3.0, 4)]

        made = ["_c", "_basin", "_belt", "_ridge", "_fine", "_sea"]
        d = with_noise(d, XYZ, made, fields).withColumn("_c", F.col("_c") - self.threshold)
        inland, t = _clip(F.col("_c") / 0.2), _clip(-F.col("_c") / 0.12)
        basin = 0.5 + 0.5 * F.col("_basin")
        land = p.land_height * (0.1 + 0.9 * inland) * (0.25 + 0.75 * basin) * (0.5 + 0.5 * F.col("_fine"))
        belt = _clip((F.col("_belt") + 0.02) / 0.3) * _clip(F.col("_c") / 0.08)
        land = land + p.mountain_height * belt * F.pow("_ridge", F.lit(1.3))
        ocean = p.shelf + (p.deep - p.shelf) * F.pow(t, F.lit(0.7)) + 300 * F.col("_sea") * t
        return d.withColumn(name, F.when(F.col("_c") > 0, land).otherwise(ocean)).drop(*made)

    def climate(self, d: DataFrame, height: str = "h", cont: str = "cont") -> DataFrame:
        """Mean temperature, its yearly range, and rain."""
        p, h, c, rain = self.params, F.col(height), F.col(cont), self.noises["rain"]
        d = d.withColumn("_a", F.abs(F.degrees(F.asin(_clip(F.col("z"), -1.0, 1.0)))) / 90)
        d = with_noise(d, XYZ, ["_rain"], lambda q: [fbm(rain, q, 3.0, 4)])
        a = F.col("_a")
        bump = lambda centre, width: F.exp(-((a - centre) / width) * ((a - centre) / width))
        zonal = bump(0.0, 0.14) + 0.6 * bump(0.55, 0.16) + 0.18 - 0.22 * bump(0.27, 0.08)
        d = d.withColumn("tavg", p.pole + (p.equator - p.pole) * F.pow(F.cos(a * (math.pi / 2)), F.lit(1.3)) - p.lapse * F.greatest(h, F.lit(0.0)) / 1000)
        d = d.withColumn("trange", 3 + 45 * c * F.pow(a, F.lit(0.8)))
        d = d.withColumn("prec", F.greatest(F.lit(0.0), 3200 * p.humidity * F.greatest(zonal, F.lit(0.02)) * (1 - 0.6 * c) * F.exp(1.1 * F.col("_rain"))))
        return d.drop("_a", "_rain")

    def equirect(self, height: int, width: int) -> DataFrame:
        return self.height(equirect_grid(self.spark, height, width))

    def face(self, pixels: DataFrame) -> DataFrame:
        """``pixels(face, i, j, u, v)`` with their directions and heights."""
        x, y, z = face_uv_to_dir(F.col("face"), F.col("u"), F.col("v"))
        return self.height(pixels.withColumn("x", x).withColumn("y", y).withColumn("z", z))

    def face_layers(self, pixels: DataFrame, n: int, radius: int | None = None) -> DataFrame:
        """``(face, i, j, lat, lon, height, tavg, trange, prec)`` of whole faces' ``pixels(face, i, j, u, v)``; the coast reaches ``radius`` pixels inland."""
        heights = settled(self.face(pixels))
        lat, lon = dir_to_latlon([F.col(c) for c in XYZ])
        inland = continentality(heights, "h", radius or max(4, n // 40), keys=["face"])
        return self.climate(inland.withColumn("lat", lat).withColumn("lon", lon)).select("face", "i", "j", "lat", "lon", F.col("h").alias("height"), "tavg", "trange", "prec")


def climate_equirect(planet: Planet, grid: DataFrame, height: int, width: int) -> DataFrame:
    return planet.climate(continentality(grid, "h", max(4, height // 20)))


def uplift(h: Column, params: PlanetParams, most: float) -> Column:
    """Uplift rate from the base height, in the unit of ``most`` (``erode`` takes mm a year): little on lowland, most in the mountains, none in the ocean."""
    rel = _clip((h - 0.6 * params.land_height) / params.mountain_height)
    return F.when(h > 0, most * (0.003 + 0.997 * F.pow(rel, F.lit(1.2)))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class ErosionParams:
    iterations: int = 150
    dt: float = 5e4
    k: float = 1e-6
    m: float = 0.5
    diffusion: float = 0.5
    sea_level: float = 0.0
    initial_scale: float = 0.35  # of its height that land starts at
    uplift_mm_yr_max: float = 1.2
    routing_power: float = 0.0  # 0: steepest descent; above: random by slope to this power
    eps: float = 1e-3
    k_variation: float = 0.0  # spread of the logarithm of the rock's resistance; 0: the same rock everywhere
    k_variation_cells: float = 6.0  # over how many cells it is smoothed


def resistance(cells: DataFrame, width: int, spread: float, over: float) -> DataFrame:
    """``cells(i, j)`` with ``rock``: a smooth log-normal factor, from normals keyed by the cell, smoothed and scaled to ``spread``."""
    cell = F.col("i").cast("long") * width + F.col("j")
    normal = F.sqrt(-2 * F.log(1 - hash01(cell, F.lit(1)))) * F.cos(2 * math.pi * hash01(cell, F.lit(2)))
    field = settled(gaussian(cells.select("i", "j", normal.alias("_n")), "_n", over, width, "_s").select("i", "j", "_s"))
    size = field.agg(F.stddev_pop("_s")).first()[0] or 0.0
    return field.select("i", "j", F.exp(F.col("_s") * (spread / max(size, 1e-9))).alias("rock"))


def erosion_step(state: DataFrame, rock: DataFrame, height: int, width: int, params: ErosionParams, step: int) -> DataFrame:
    """``state(i, j, h, uplift)`` (metres, mm a year) after one step of uplift, filling, routing, accumulation, incision and diffusion; with ``acc``, the km2 that drain through a cell."""
    sea = params.sea_level
    cosine = row_cos(F.col("i"), height)
    dx = math.pi * EARTH_RADIUS_KM * 1000 / height
    coefficient = min(params.diffusion * params.dt / dx**2, 0.2 * 0.15**2)
    cell = F.col("i").cast("long") * width + F.col("j")
    raised = state.withColumn("h", F.when(F.col("h") > sea, F.col("h") + F.col("uplift") * (1e-3 * params.dt)).otherwise(F.col("h")))
    filled = fill_depressions(raised, height, width, params.eps, sea)
    if params.routing_power > 0:
        forest = stochastic_receivers(filled, "f", width, step, params.routing_power, sea, cosine)
    else:
        forest = receivers(filled, "f", width, sea, cosine)
    cells = filled.join(rock, ["i", "j"]).select(cell.alias("c"), "i", "j", "h", "uplift", "rock", cell_area_km2(F.col("i"), height, width).alias("area"))
    routed = accumulate(settled(forest.join(cells, "c")), "area", width=width)
    ri, rj = F.floor(F.col("rec") / width), F.col("rec") % width
    gap = F.least(F.abs(F.col("j") - rj), F.lit(1))
    distance = dx * F.sqrt((F.col("i") - ri) * (F.col("i") - ri) + (gap * cosine) * (gap * cosine))
    # A root has no distance; its factor isn't used.
    routed = routed.withColumn("factor", params.dt * params.k * F.col("rock") * F.pow(F.col("acc") * 1e6, F.lit(params.m)) / F.greatest(distance, F.lit(1e-9)))
    cut = incise(settled(routed), "factor", sea, width=width).select("i", "j", F.col("h2").alias("h"), "uplift", "acc", (F.col("h") > sea).alias("_land"))
    smooth = diffuse(cut, "h", coefficient, height, width, cosine, sea)
    return smooth.select("i", "j", F.when(F.col("_land"), F.greatest(F.col("h"), F.lit(sea + 0.5))).otherwise(F.col("h")).alias("h"), "uplift", "acc")


def erode(base: DataFrame, height: int, width: int, params: ErosionParams, folder: str | None = None, keep: int = 2) -> DataFrame:
    """``base(i, j, h, uplift)`` (metres, mm a year) after ``iterations`` steps of erosion, with the drained area ``acc`` (km2) of the last.

    Land starts at ``initial_scale`` of its height and never falls below half
    a metre above the sea.  Each step's state is written to ``folder``; called
    again with a folder in which steps were finished, the run goes on after the
    last of them, so a lost driver costs one step.  The last ``keep`` states
    stay there; a step's intermediate tables are removed when its state is written.
    """
    spark, sea = base.sparkSession, params.sea_level
    folder = folder or scratch(spark)
    at = lambda step: f"{folder}/step={step:06d}"
    done = finished_steps(spark, folder)
    if not done:
        first = base.select("i", "j", F.when(F.col("h") > sea, sea + params.initial_scale * (F.col("h") - sea)).otherwise(F.col("h")).cast("double").alias("h"), F.col("uplift").cast("double").alias("uplift"), F.lit(0.0).alias("acc"))
        first.write.mode("overwrite").parquet(at(0))
        done = [0]
    if done[-1] < params.iterations:
        rock = settled(resistance(base, width, params.k_variation, params.k_variation_cells) if params.k_variation > 0 else base.select("i", "j", F.lit(1.0).alias("rock")))
    mark = written(spark)
    for step in range(done[-1], params.iterations):
        state = spark.read.parquet(at(step)).drop("acc")
        erosion_step(state, rock, height, width, params, step).write.mode("overwrite").parquet(at(step + 1))
        discard(spark, mark)
        done.append(step + 1)
        for old in done[:-keep]:
            remove(spark, at(old))
        done = done[-keep:]
    return spark.read.parquet(at(params.iterations))


def finished_steps(spark: SparkSession, folder: str) -> list[int]:
    """The steps of a folder whose states were written to their end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/step=*/_SUCCESS"))
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or [])


def smooth_relief(grid: DataFrame, width: int, low: float = 6.0, high: float = 3.0) -> DataFrame:
    """Land smoothed more in the plains than in the mountains; ocean untouched, land 0.5 at least."""
    both = stencils(grid, [gaussian_step("h", low, "_plain"), gaussian_step("h", high, "_peak")], ["h"], width=width)
    t = _clip(F.col("h") / 1500)
    return both.withColumn("h", F.when(F.col("h") > 0, F.greatest(F.lit(0.5), F.col("_plain") * (1 - t) + F.col("_peak") * t)).otherwise(F.col("h"))).drop("_plain", "_peak")
