"""Boxes, hold-outs and the acceptance of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_box(lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Inclusive box; ``lon_min > lon_max`` crosses the antimeridian."""
    inside = F.when(lon_min <= lon_max, lon.between(lon_min, lon_max)).otherwise((lon >= lon_min) | (lon <= lon_max))
    return lat.between(lat_min, lat_max) & inside


def mark_holdout(points: DataFrame, boxes: list[tuple[float, float, float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``holdout``: in any of the boxes (a short constant list, so no join is needed)."""
    held = F.lit(False)
    for box in boxes:
        held = held | in_box(F.col(lat), F.col(lon), *[F.lit(float(x)) for x in box])
    return points.withColumn("holdout", held)


def accept_patches(cells: DataFrame, size: int, split: str, min_land: float, height: str = "h", holdout: str = "holdout") -> DataFrame:
    """Aligned patches ``(pi, pj, cells, land)`` of a split: training patches hold nothing out, validation ones everything; ``min_land`` is the least share above 0."""
    patches = cells.groupBy(F.floor(F.col("i") / size).cast("int").alias("pi"), F.floor(F.col("j") / size).cast("int").alias("pj")).agg(
        F.count("*").alias("cells"), F.avg((F.col(height) > 0).cast("double")).alias("land"), F.bool_or(holdout).alias("_any"), F.bool_and(holdout).alias("_all")
    )
    wanted = ~F.col("_any") if split == "train" else F.col("_all")
    return patches.where(wanted & (F.col("land") >= min_land)).drop("_any", "_all")


def first_accepted(candidates: DataFrame, keys: list[str], attempt: str, accepted: str, max_tries: int) -> DataFrame:
    """Bounded rejection sampling: each key's first accepted attempt; a key without one raises."""
    best = candidates.where(F.col(attempt) < max_tries).groupBy(*keys).agg(F.min(F.when(F.col(accepted), F.col(attempt))).alias(attempt))
    return best.withColumn(attempt, F.when(F.col(attempt).isNotNull(), F.col(attempt)).otherwise(F.raise_error(F.lit(f"no patch accepted in {max_tries} tries")).cast("long")))
