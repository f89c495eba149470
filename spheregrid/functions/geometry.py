"""Coordinates on the cube-sphere and the equirectangular grid, as Column expressions.

Faces are px, nx, py, ny, pz, nz (0 to 5).  A face point ``(u, v)`` in
[-1, 1]^2 maps through the tangent warp, which keeps pixel areas alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six faces with their normal and tangent axes.
FACE_NAMES = ("px", "nx", "py", "ny", "pz", "nz")
FACE_AXES = (
    ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
    ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ((0, 0, 1), (1, 0, 0), (0, 1, 0)),
    ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
)
EARTH_CIRCUMFERENCE_KM, EARTH_RADIUS_KM = 40075.0, 6371.0
#: Floor of the row cosine: cells near the poles don't shrink below it.
MIN_COS = 0.15

Vector = tuple[Column, Column, Column]


def warp(u: Column) -> Column:
    return F.tan(u * (F.pi() / 4))


def unwarp(s: Column) -> Column:
    return F.atan(s) * 4 / F.pi()


def faces(spark: SparkSession) -> DataFrame:
    """The face dimension: ``face, name`` and the components of normal ``n``, ``tu`` and ``tv``."""
    rows = [(k, FACE_NAMES[k], *map(float, (*n, *tu, *tv))) for k, (n, tu, tv) in enumerate(FACE_AXES)]
    names = [f"{a}{b}" for a in ("n", "tu", "tv") for b in "xyz"]
    return spark.createDataFrame(rows, "face int, name string, " + ", ".join(f"{n} double" for n in names))


def _by_face(face: Column, axis: int, component: int) -> Column:
    """A component of an axis of ``face``: a six-way choice that stays in generated code."""
    return F.element_at(F.array(*[F.lit(float(a[axis][component])) for a in FACE_AXES]), (face + 1).cast("int"))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Sequence[Column]) -> Vector:
    """Unit vector; the zero vector stays as it is."""
    n = length(a)
    scale = F.when(n > 0, 1 / F.when(n > 0, n)).otherwise(F.lit(0.0))
    return a[0] * scale, a[1] * scale, a[2] * scale


def face_uv_to_dir(face: Column, u: Column, v: Column) -> Vector:
    """Normal plus warped tangents, of length sqrt(1 + s^2 + t^2) as the axes are orthonormal."""
    s, t = warp(u), warp(v)
    size = F.sqrt(1 + s * s + t * t)
    return tuple((_by_face(face, 0, k) + s * _by_face(face, 1, k) + t * _by_face(face, 2, k)) / size for k in range(3))


def dir_to_face(d: Sequence[Column]) -> Column:
    """The face of the dominant axis; the first axis wins ties and zero counts as positive."""
    x, y, z = (F.abs(c) for c in d)
    side = lambda k: F.when(d[k] < 0, F.lit(2 * k + 1)).otherwise(F.lit(2 * k))
    return F.when((x >= y) & (x >= z), side(0)).when(y >= z, side(1)).otherwise(side(2)).cast("int")


def dir_to_uv(d: Sequence[Column], face: Column) -> tuple[Column, Column]:
    """(u, v) on a given face, beyond [-1, 1] if the direction lies outside it."""
    n, tu, tv = (dot(d, [_by_face(face, axis, k) for k in range(3)]) for axis in range(3))
    return unwarp(tu / n), unwarp(tv / n)


def dir_to_latlon(d: Sequence[Column]) -> tuple[Column, Column]:
    """Degrees; the sine is clamped and longitude 180 reads -180."""
    n = length(d)
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d[2] / n))))
    lon = F.degrees(F.atan2(d[1], d[0]))
    return lat, F.when(lon >= 180, lon - 360).otherwise(lon)


def latlon_to_dir(lat: Column, lon: Column) -> Vector:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def face_pixels(spark: SparkSession, n: int, pad: int = 0, which: Sequence[int] = range(6)) -> DataFrame:
    """``(face, i, j, u, v)`` of every pixel centre of the faces, ``pad`` pixels beyond each edge included."""
    side = n + 2 * pad
    grid = spark.range(len(which) * side * side)
    face = F.element_at(F.array(*map(F.lit, which)), (F.floor(F.col("id") / (side * side)) + 1).cast("int"))
    i, j = F.floor(F.col("id") / side) % side - pad, F.col("id") % side - pad
    grid = grid.select(face.alias("face"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    return grid.withColumn("u", (F.col("j") + 0.5) / n * 2 - 1).withColumn("v", 1 - (F.col("i") + 0.5) / n * 2)


def uv_to_pixel(n: int, u: Column, v: Column) -> tuple[Column, Column]:
    """Nearest pixel (i, j), clamped; halves go to the even one."""
    cell = lambda x: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(x).cast("int")))
    return cell((1 - v) * 0.5 * n - 0.5), cell((u + 1) * 0.5 * n - 0.5)


def face_pixel_latlon(spark: SparkSession, n: int, pad: int = 0, which: Sequence[int] = range(6)) -> DataFrame:
    grid = face_pixels(spark, n, pad, which)
    lat, lon = dir_to_latlon(face_uv_to_dir(F.col("face"), F.col("u"), F.col("v")))
    return grid.withColumn("lat", lat).withColumn("lon", lon)


def equirect_latlon(i: Column, j: Column, height: int, width: int) -> tuple[Column, Column]:
    return 90 - (i + 0.5) * 180 / height, (j + 0.5) * 360 / width - 180


def equirect_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """``(i, j, lat, lon, x, y, z)`` of every cell centre."""
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("i"), (F.col("id") % width).cast("int").alias("j"))
    lat, lon = equirect_latlon(F.col("i"), F.col("j"), height, width)
    grid = grid.withColumn("lat", lat).withColumn("lon", lon)
    x, y, z = latlon_to_dir(F.col("lat"), F.col("lon"))
    return grid.withColumn("x", x).withColumn("y", y).withColumn("z", z)


def px_km(face_resolution: int) -> float:
    return EARTH_CIRCUMFERENCE_KM / 4 / face_resolution


def cell_area_km2(i: Column, height: int, width: int) -> Column:
    import math

    lat = 90 - (i + 0.5) * 180 / height
    return F.lit(EARTH_RADIUS_KM**2 * (math.pi / height) * (2 * math.pi / width)) * F.cos(F.radians(lat))


def row_cos(i: Column, height: int, floor: float = MIN_COS) -> Column:
    return F.greatest(F.lit(floor), F.cos(F.radians(90 - (i + 0.5) * 180 / height)))


def step_length(di: Column, dj: Column, cosine: Column) -> Column:
    return F.sqrt(di * di + (dj * cosine) * (dj * cosine))


def to_engine(d: Sequence[Column]) -> Vector:
    """Axes of y-up renderers: (x, z, -y)."""
    return d[0], d[2], -d[1]


def from_engine(d: Sequence[Column]) -> Vector:
    return d[0], -d[2], d[1]


def texture_coordinate(t: Column, n: int, pad: int = 1) -> Column:
    """Place of t in [0, 1] of a face within its padded texture."""
    return (t * n + pad) / (n + 2 * pad)


def neighbour_faces(spark: SparkSession) -> DataFrame:
    """``(face, edge, neighbour)``: what lies across each face's top, bottom, left and right edge."""
    edges = [("top", 0.0, 1.01), ("bottom", 0.0, -1.01), ("left", -1.01, 0.0), ("right", 1.01, 0.0)]
    rows = spark.createDataFrame([(f, e, u, v) for f in range(6) for e, u, v in edges], "face int, edge string, u double, v double")
    return rows.select("face", "edge", dir_to_face(face_uv_to_dir(F.col("face"), F.col("u"), F.col("v"))).alias("neighbour"))
