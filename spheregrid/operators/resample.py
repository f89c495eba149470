"""Resampling: corners explode to rows, join the raster on its cell, and sum up by weight."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spheregrid.functions.geometry import dir_to_face, dir_to_uv, face_pixels, face_uv_to_dir, uv_to_pixel
from spheregrid.operators.tiles import with_halo


def _corners(x: Column, y: Column) -> Column:
    """The four cells around a pixel position (x right, y down) with bilinear weights; zero weights left out."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    each = [(0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)]
    cells = F.array(*[F.struct((y0 + dy).cast("int").alias("i"), (x0 + dx).cast("int").alias("j"), w.alias("w")) for dy, dx, w in each])
    return F.filter(cells, lambda c: c["w"] != 0)


def equirect_position(lat: Column, lon: Column, height: int, width: int) -> tuple[Column, Column]:
    return (lon + 180) / 360 * width - 0.5, (90 - lat) / 180 * height - 0.5


def sample_equirect(points: DataFrame, key: str, grid: DataFrame, layers: list[str], height: int, width: int, nearest: bool = False) -> DataFrame:
    """``points(key, lat, lon)`` with each layer of ``grid(i, j, ...)``: bilinear or nearest; longitude wraps, latitude clamps.

    A corner without a cell counts as missing and makes the sample null.
    """
    x, y = equirect_position(F.col("lat"), F.col("lon"), height, width)
    clamp = lambda r: F.greatest(F.lit(0), F.least(F.lit(height - 1), r)).cast("int")
    cells = grid.select(F.col("i").alias("_ri"), F.col("j").alias("_rj"), *layers)
    if nearest:
        at = points.withColumn("_ri", clamp(F.rint(y))).withColumn("_rj", F.pmod(F.rint(x).cast("int"), F.lit(width)))
        return at.join(cells, ["_ri", "_rj"], "left").drop("_ri", "_rj")
    spread = points.withColumn("_c", F.explode(_corners(x, y)))
    spread = spread.select(*[F.col(c) for c in points.columns], clamp(F.col("_c.i")).alias("_ri"), F.pmod(F.col("_c.j"), F.lit(width)).alias("_rj"), F.col("_c.w").alias("_w"))
    joined = spread.join(cells, ["_ri", "_rj"], "left")
    sums = [F.when(F.bool_and(F.col(c).isNotNull()), F.sum(F.col("_w") * F.col(c))).alias(c) for c in layers]
    others = [F.first(c).alias(c) for c in points.columns if c != key]
    return joined.groupBy(key).agg(*others, *sums)


def sample_face(points: DataFrame, key: str, cells: DataFrame, layer: str, n: int) -> DataFrame:
    """``points(key, x, y, z)`` with a cube layer, bilinear; corners beyond a face are looked up on the face they lie on."""
    d = tuple(F.col(c) for c in "xyz")
    at = points.withColumn("_face", dir_to_face(d))
    u, v = dir_to_uv(d, F.col("_face"))
    at = at.withColumn("_c", F.explode(_corners((u + 1) * 0.5 * n - 0.5, (1 - v) * 0.5 * n - 0.5)))
    at = at.select(*points.columns, F.col("_face").alias("face"), F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), F.col("_c.w").alias("_w"))
    inside = F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)
    e = face_uv_to_dir(F.col("face"), (F.col("j") + 0.5) / n * 2 - 1, 1 - (F.col("i") + 0.5) / n * 2)
    at = at.withColumn("_e", F.array(*e)).withColumn("_o", F.when(inside, F.col("face")).otherwise(dir_to_face([F.col("_e")[k] for k in range(3)])))
    ou, ov = dir_to_uv([F.col("_e")[k] for k in range(3)], F.col("_o"))
    cell = lambda t: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(t).cast("int")))
    at = at.withColumn("_i", F.when(inside, F.col("i")).otherwise(cell((1 - ov) * 0.5 * n - 0.5))).withColumn("_j", F.when(inside, F.col("j")).otherwise(cell((ou + 1) * 0.5 * n - 0.5)))
    at = at.select(*points.columns, F.col("_o").alias("face"), F.col("_i").alias("i"), F.col("_j").alias("j"), "_w")
    joined = at.join(cells.select("face", "i", "j", layer), ["face", "i", "j"], "left")
    return joined.groupBy(key).agg(*[F.first(c).alias(c) for c in points.columns if c != key], F.sum(F.col("_w") * F.col(layer)).alias(layer))


def sample_on_face(points: DataFrame, key: str, cells: DataFrame, layer: str, n: int) -> DataFrame:
    """``points(key, face, u, v)`` with a layer of that face alone, bilinear; positions beyond its outer pixels' centres are clamped to them."""
    held = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), t))
    at = points.withColumn("_c", F.explode(_corners(held((F.col("u") + 1) * 0.5 * n - 0.5), held((1 - F.col("v")) * 0.5 * n - 0.5))))
    at = at.select(*points.columns, F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), F.col("_c.w").alias("_w"))
    joined = at.join(cells.select("face", "i", "j", layer), ["face", "i", "j"], "left")
    return joined.groupBy(key).agg(*[F.first(c).alias(c) for c in points.columns if c != key], F.sum(F.col("_w") * F.col(layer)).alias(layer))


def block_mean(grid: DataFrame, factor: int, layers: list[str], height: int | None = None, width: int | None = None, keys: list[str] = ()) -> DataFrame:
    """Means of ``factor`` x ``factor`` blocks; rows and columns beyond the last whole block are left out."""
    if height is not None:
        grid = grid.where(F.col("i") < height // factor * factor)
    if width is not None:
        grid = grid.where(F.col("j") < width // factor * factor)
    i, j = (F.floor(F.col(c) / factor).cast("int").alias(c) for c in "ij")
    return grid.groupBy(*keys, i, j).agg(*[F.avg(c).alias(c) for c in layers], F.count("*").alias("n"))


def upsample(coarse: DataFrame, factor: int, layer: str, height: int, width: int, keys: list[str] = ()) -> DataFrame:
    """Bilinear, clamped, cell-centred: each coarse cell's block of fine cells reads the coarse cells around it."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    fine = coarse.select(*keys, "i", "j").withColumn("_a", steps).withColumn("_b", steps)
    fine = fine.select(*keys, (F.col("i") * factor + F.col("_a")).cast("int").alias("i"), (F.col("j") * factor + F.col("_b")).cast("int").alias("j"))
    fine = fine.withColumn("_c", F.explode(_corners((F.col("j") + 0.5) / factor - 0.5, (F.col("i") + 0.5) / factor - 0.5)))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    spread = fine.select(*keys, "i", "j", clamp(F.col("_c.i"), height).alias("_ci"), clamp(F.col("_c.j"), width).alias("_cj"), F.col("_c.w").alias("_w"))
    source = coarse.select(*keys, F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col(layer).alias("_v"))
    return spread.join(source, [*keys, "_ci", "_cj"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("_w") * F.col("_v")).alias(layer))


#: Coarse cells along the side of a block that is upsampled in one task.
UPSAMPLED = 64


def _bilinear(block: np.ndarray, factor: int) -> np.ndarray:
    """A block at ``factor`` times its resolution, bilinear between cell centres; beyond the outer ones they stay."""
    for axis in (0, 1):
        n = block.shape[axis]
        at = np.clip((np.arange(n * factor) + 0.5) / factor - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low)[:, None] if axis == 0 else at - low
        block = np.take(block, low, axis) * (1 - part) + np.take(block, np.minimum(low + 1, n - 1), axis) * part
    return block


def smooth_layers(coarse: DataFrame, factor: int, layers: list[str], keep: set[str], keys: Sequence[str] = (), corrections: int = 4) -> DataFrame:
    """``(keys, i, j, layers)`` at ``factor`` times the resolution of a full grid: bilinear, and with ``keep`` so that block means are the coarse values.

    Those layers' errors of the means are upsampled and added a few times, and
    the rest is put in flat.  Blocks have a halo as wide as all of that looks,
    so the whole takes one shuffle of coarse cells.
    """
    fields = [f for f in coarse.schema if f.name in keys]
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in layers]])
    kinds = to_arrow_schema(schema)

    def run(rows: pa.Table) -> pa.Table:
        li, lj, own = (rows.column(c).to_numpy() for c in ("li", "lj", "own"))
        x, y = li - li.min(), lj - lj.min()
        shape = (int(x.max()) + 1, int(y.max()) + 1)
        cells = rows.filter(pa.array(own))
        steps = np.arange(factor)
        fx, fy = ((np.repeat(v[own], factor * factor) * factor + np.tile(s, own.sum())) for v, s in ((x, np.repeat(steps, factor)), (y, np.tile(steps, factor))))
        i, j = (np.repeat(cells.column(c).to_numpy(), factor * factor) * factor + np.tile(s, own.sum()) for c, s in (("i", np.repeat(steps, factor)), ("j", np.tile(steps, factor))))
        out = {c: cells.column(c).take(pa.array(np.repeat(np.arange(cells.num_rows), factor * factor))) for c in keys} | {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())}
        for layer in layers:
            block = np.zeros(shape)
            block[x, y] = rows.column(layer).to_numpy()
            fine = _bilinear(block, factor)
            if layer in keep:
                error = lambda f, block=block: block - f.reshape(shape[0], factor, shape[1], factor).mean(axis=(1, 3))
                for _ in range(corrections):
                    fine = fine + _bilinear(error(fine), factor)
                fine = fine + np.kron(error(fine), np.ones((factor, factor)))
            out[layer] = pa.array(fine[fx, fy])
        return pa.table([out[f.name] for f in kinds], schema=kinds)

    plain = coarse.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.col(c).cast("double").alias(c) for c in layers])
    return with_halo(plain, UPSAMPLED, corrections + 2).groupBy(*keys, "ti", "tj").applyInArrow(run, schema)


def mean_preserving_upsample(coarse: DataFrame, factor: int, layer: str, corrections: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Smooth upsampling of a full grid whose block means are the coarse values."""
    return smooth_layers(coarse, factor, [layer], {layer}, keys, corrections)


def keep_means(base: DataFrame, residual: DataFrame, factor: int, layer: str, height: int, width: int) -> DataFrame:
    """``base + residual - smooth block mean of residual``: detail that leaves the coarse values alone."""
    means = block_mean(residual, factor, [layer]).select("i", "j", layer)
    flat = mean_preserving_upsample(means, factor, layer).withColumnRenamed(layer, "_f")
    both = base.join(residual.withColumnRenamed(layer, "_r"), ["i", "j"]).join(flat, ["i", "j"])
    return both.select("i", "j", (F.col(layer) + F.col("_r") - F.col("_f")).alias(layer))


def tile_starts(n: int, tile: int, overlap: int, factor: int = 1) -> list[int]:
    """Sorted distinct starts of overlapping tiles; the last ends at the edge."""
    stride = max(1, (tile - overlap) // factor * factor)
    return sorted({min(s, n - tile) for s in range(0, n, stride)})


def tile_starts_of(extents: DataFrame, n: str, tile: int, overlap: int, factor: int = 1) -> DataFrame:
    """``extents`` with a row for each ``start`` of the overlapping tiles of an extent ``n`` (of a tile at least), as ``tile_starts``."""
    stride = max(1, (tile - overlap) // factor * factor)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(stride).cast("long")), lambda s: F.least(s, F.col(n).cast("long") - tile)))
    return extents.withColumn("start", F.explode(starts))


def hann(position: Column, tile: int) -> Column:
    """Raised-cosine weight of a position in a tile, 0.001 at least."""
    return F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(2 * F.pi() * (position + 0.5) / tile))


def overlap_add(tiles: DataFrame, value: str, tile: int, keys: list[str] = ()) -> DataFrame:
    """``tiles(si, sj, a, b, value)`` (start and position inside) blended to ``(i, j, value)`` by Hann weights."""
    w = hann(F.col("a"), tile) * hann(F.col("b"), tile)
    cells = tiles.select(*keys, (F.col("si") + F.col("a")).alias("i"), (F.col("sj") + F.col("b")).alias("j"), (w * F.col(value)).alias("_wv"), w.alias("_w"))
    return cells.groupBy(*keys, "i", "j").agg((F.sum("_wv") / F.sum("_w")).alias(value))


def blend_faces(padded: DataFrame, value: str, n: int, pad: int) -> DataFrame:
    """Cross-fade of padded faces ``(face, i, j, value)`` along their edges.

    Near an edge a pixel mixes its own value (half at the edge, all of it
    ``pad`` pixels inside) with the bilinear value of the face across, read
    from that face's padding.  Edges go top, bottom, left, right, so pixels
    near a corner mix twice.
    """
    own = padded.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)).select("face", "i", "j", value)
    raster = padded.select(F.col("face").alias("_o"), F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col(value).alias("_v"))
    edges = [("top", F.col("i"), (0.0, 1.01)), ("bottom", n - 1 - F.col("i"), (0.0, -1.01)), ("left", F.col("j"), (-1.01, 0.0)), ("right", n - 1 - F.col("j"), (1.01, 0.0))]
    clamp = lambda c: F.greatest(F.lit(-pad), F.least(F.lit(n + pad - 1), c)).cast("int")
    for _, distance, (eu, ev) in edges:
        strip = own.where(distance < pad).withColumn("_d", distance)
        strip = strip.withColumn("_o", dir_to_face(face_uv_to_dir(F.col("face"), F.lit(eu), F.lit(ev))))
        strip = strip.withColumn("_e", F.array(*face_uv_to_dir(F.col("face"), (F.col("j") + 0.5) / n * 2 - 1, 1 - (F.col("i") + 0.5) / n * 2)))
        u, v = dir_to_uv([F.col("_e")[k] for k in range(3)], F.col("_o"))
        corners = strip.withColumn("_c", F.explode(_corners((u + 1) * 0.5 * n - 0.5, (1 - v) * 0.5 * n - 0.5)))
        corners = corners.select("face", "i", "j", "_d", "_o", clamp(F.col("_c.i")).alias("_ci"), clamp(F.col("_c.j")).alias("_cj"), F.col("_c.w").alias("_w"))
        other = corners.join(raster, ["_o", "_ci", "_cj"]).groupBy("face", "i", "j").agg(F.sum(F.col("_w") * F.col("_v")).alias("_x"), F.first("_d").alias("_d"))
        weight = F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.5 + 0.5 * (F.col("_d") + 0.5) / pad))
        own = own.join(other, ["face", "i", "j"], "left").select("face", "i", "j", F.coalesce(weight * F.col(value) + (1 - weight) * F.col("_x"), F.col(value)).alias(value))
    return own


def patch_with_context(cells: DataFrame, context: DataFrame, origins: DataFrame, size: int, pad: int, factor: int, layer: str) -> DataFrame:
    """Each origin ``(patch, face, i0, j0)`` with its fine window and its padded coarse window as arrays, row by row.

    Windows meet cells by an equi-join on blocks of ``size`` (each window
    touches at most four), not by a range join.
    """

    def window(source: DataFrame, i0: Column, j0: Column, side: int, name: str) -> DataFrame:
        block = origins.select("patch", "face", i0.cast("int").alias("_i0"), j0.cast("int").alias("_j0"))
        span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + side - 1) / side)))
        block = block.withColumn("_bi", span("_i0")).withColumn("_bj", span("_j0"))
        keyed = source.select("face", "i", "j", layer, F.floor(F.col("i") / side).alias("_bi"), F.floor(F.col("j") / side).alias("_bj"))
        met = block.join(keyed, ["face", "_bi", "_bj"]).where(F.col("i").between(F.col("_i0"), F.col("_i0") + side - 1) & F.col("j").between(F.col("_j0"), F.col("_j0") + side - 1))
        return met.groupBy("patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", layer))), lambda x: x[layer]).alias(name))

    fine = window(cells, F.col("i0"), F.col("j0"), size, layer)
    coarse = window(context, (F.col("i0") - pad) / factor, (F.col("j0") - pad) / factor, (size + 2 * pad) // factor, f"ctx_{layer}")
    return origins.join(fine, "patch").join(coarse, "patch")


def sample_layers(points: DataFrame, key: str, grid: DataFrame, height: int, width: int, layers: list[str], nearest: set[str] = frozenset(), bytes_: set[str] = frozenset()) -> DataFrame:
    """All layers of a grid at ``points(key, lat, lon)``: those in ``nearest`` unchanged, the others bilinear, of which those in ``bytes_`` are rounded to 0..255."""
    smooth, plain = [c for c in layers if c not in nearest], [c for c in layers if c in nearest]
    out = points
    if smooth:
        out = sample_equirect(out, key, grid, smooth, height, width)
        out = out.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c))).cast("int") for c in smooth if c in bytes_})
    return sample_equirect(out, key, grid, plain, height, width, nearest=True) if plain else out


def nearest_on_faces(points: DataFrame, cells: DataFrame, layers: list[str], n: int) -> DataFrame:
    """``points(x, y, z, ...)`` with the layers of the cube pixel that each direction lies in."""
    d = tuple(F.col(c) for c in "xyz")
    at = points.withColumn("_face", dir_to_face(d))
    u, v = dir_to_uv(d, F.col("_face"))
    i, j = uv_to_pixel(n, u, v)
    at = at.withColumn("_i", i).withColumn("_j", j)
    own = cells.select(F.col("face").alias("_face"), F.col("i").alias("_i"), F.col("j").alias("_j"), *layers)
    return at.join(own, ["_face", "_i", "_j"], "left").drop("_face", "_i", "_j")


def padded_faces(cells: DataFrame, layers: list[str], n: int, pad: int) -> DataFrame:
    """``(face, i, j, layers)`` of each face and ``pad`` pixels beyond each edge, taken from the faces they lie on."""
    ring = face_pixels(cells.sparkSession, n, pad).where(~(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)))
    x, y, z = face_uv_to_dir(F.col("face"), F.col("u"), F.col("v"))
    around = nearest_on_faces(ring.select("face", "i", "j", x.alias("x"), y.alias("y"), z.alias("z")), cells, layers, n)
    return cells.select("face", "i", "j", *layers).unionByName(around.select("face", "i", "j", *layers))


def coarse_layers(context: DataFrame, layers: list[str], size: int, pad: int, factor: int, keys: list[str], mean_preserving: str = "height") -> DataFrame:
    """What is known of a patch at coarse scale: the middle of its context ``(keys, i, j, layers)`` at the patch's own resolution, ``size`` cells a side.

    The crop is a coarse cell wider on each side, so the border sees its real
    neighbours; one layer keeps its means, the others are bilinear.  With a
    face for a patch these are the fallback layers of the whole face.
    """
    first, side = pad // factor - 1, size // factor + 2
    crop = context.where(F.col("i").between(first, first + side - 1) & F.col("j").between(first, first + side - 1))
    crop = crop.withColumn("i", F.col("i") - first).withColumn("j", F.col("j") - first)
    fine = smooth_layers(crop, factor, layers, {mean_preserving}, keys)
    inner = fine.where(F.col("i").between(factor, factor + size - 1) & F.col("j").between(factor, factor + size - 1))
    return inner.withColumn("i", F.col("i") - factor).withColumn("j", F.col("j") - factor)
