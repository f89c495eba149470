"""More of the query catalogue: geometry, resampling, noise, planets, drainage, layers and baking, each with its SQL."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spheregrid.functions import features, geometry, noise
from spheregrid.operators import bake, hydro, planets, predicates, quadtree, resample, windows
from spheregrid.plans.queries import BOXES, DIR, FACE, STEPS, UV, E, G, H, V, W, _LAT, _S, _VEC, _W, _mul, _xor, grid, mean_preserving, on_faces, patches, points, query, r6, read, upsampled
from spheregrid.sources import registry, tables
from spheregrid.streaming.frames import resumed

M64 = "18446744073709551616::HUGEINT"


def r4(x: Column) -> Column:
    return F.round(x, 4) + 0.0


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# --- SQL pieces: directions of face points, their face and place on it, pixels of a synthetic cube -----------------

_OWNER = FACE.split("SELECT *, ")[1].split(" AS face FROM d")[0]
_ON = UV.split("SELECT *, ")[1].split(" FROM f)")[0].replace("CASE face", "CASE o").replace(" AS u,", " AS ou,").replace(" AS v", " AS ov")


def directed(source: str, out: str) -> str:
    """CTE: ``source(face, u, v)`` with the unit direction ``x, y, z``."""
    return f"{out} AS (SELECT * EXCLUDE (s, t), ({_VEC['x']}) / sqrt(1 + s * s + t * t) AS x, ({_VEC['y']}) / sqrt(1 + s * s + t * t) AS y, ({_VEC['z']}) / sqrt(1 + s * s + t * t) AS z FROM (SELECT *, tan(u * pi() / 4) AS s, tan(v * pi() / 4) AS t FROM {source}))"


def placed(source: str, out: str) -> str:
    """CTE: ``source(x, y, z)`` with the face ``o`` a direction lies on and its place ``ou, ov`` there."""
    return f"{out} AS (SELECT *, {_ON} FROM (SELECT *, {_OWNER} AS o FROM {source}))"


def pixels(n: int, pad: int = 0) -> str:
    return f"(SELECT face, i, j, (j + 0.5::DOUBLE) / {n} * 2 - 1 AS u, 1 - (i + 0.5::DOUBLE) / {n} * 2 AS v FROM (SELECT unnest(range(6))::INTEGER AS face), (SELECT unnest(range({-pad}, {n + pad}))::INTEGER AS i), (SELECT unnest(range({-pad}, {n + pad}))::INTEGER AS j))"


def cell_of(t: str, n: int) -> str:
    return f"CAST(greatest(0, least({n - 1}, round_even({t}, 0))) AS INTEGER)"


#: The order grid as a list by cell, each value from 0 to 52 (0 where the grid has no cell).
_CELLS = f"""(SELECT list(coalesce(v, 0) ORDER BY a, b) FROM (SELECT unnest(range({H})) AS a), (SELECT unnest(range({W})) AS b) LEFT JOIN
  (WITH {G} SELECT i, j, CAST((h % 53 + 53) % 53 AS INTEGER) AS v FROM g) ON i = a AND j = b)"""


def value_sql(face: str, i: str, j: str) -> str:
    """A cube's value at a pixel: the order grid's, wound around the faces."""
    return f"{_CELLS}[CAST(((({i}) + 120 + ({face}) * 5) % {H}) * {W} + (({j}) + 144 + ({face}) * 11) % {W} + 1 AS BIGINT)]"


def cube(spark, sf_dir, n: int, pad: int = 0) -> DataFrame:
    g = grid(spark, sf_dir).select(F.col("i").alias("a"), F.col("j").alias("b"), F.pmod("h", F.lit(53)).cast("int").alias("_v"))
    pixels_ = geometry.face_pixels(spark, n, pad).withColumn("a", (F.col("i") + 120 + F.col("face") * 5) % H).withColumn("b", (F.col("j") + 144 + F.col("face") * 11) % W)
    return pixels_.join(g, ["a", "b"], "left").withColumn("v_", F.coalesce("_v", F.lit(0))).drop("a", "b", "_v")


def cube_values(spark, sf_dir, n: int, pad: int = 0) -> DataFrame:
    return cube(spark, sf_dir, n, pad).select("face", "i", "j", F.col("v_").cast("double").alias("h"))


def hash_sql(source: str, out: str, a: str, b: str) -> str:
    """CTEs: ``source`` with ``u``, the hash of two integers in [0, 1)."""
    return f"""{out}1 AS (SELECT *, {_xor(_mul(f"(({a})::HUGEINT % {M64} + {M64}) % {M64}", noise.CELL_A), _mul(f"(({b})::HUGEINT % {M64} + {M64}) % {M64}", noise.CELL_B))} AS hx FROM {source}),
{out}2 AS (SELECT *, CASE WHEN hx >= 9223372036854775808::UBIGINT THEN hx::HUGEINT - {M64} ELSE hx::HUGEINT END AS hs FROM {out}1),
{out}3 AS (SELECT *, ((xor(hs::BIGINT, (hs::BIGINT) >> 13)::HUGEINT * {noise.CELL_MIX}::HUGEINT) % {M64} + {M64}) % {M64} AS hz FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN hz >= 9223372036854775808::HUGEINT THEN hz - {M64} ELSE hz END::BIGINT AS hv FROM {out}3),
{out} AS (SELECT * EXCLUDE (hx, hs, hz, hv), CAST((xor(hv, hv >> 16) & 16777215) AS DOUBLE) / 16777216 AS u FROM {out}4)"""


# --- coordinates ---------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, {DIR} SELECT event_id, round(degrees(asin(greatest(-1.0, least(1.0, z / sqrt(x * x + y * y + z * z))))), 6) + 0.0 AS lat,
  round(CASE WHEN degrees(atan2(y, x)) >= 180 THEN degrees(atan2(y, x)) - 360 ELSE degrees(atan2(y, x)) END, 6) + 0.0 AS lon FROM d""")
def q43_latlon(spark, sf_dir):
    lat, lon = geometry.dir_to_latlon([F.col(c) * 3 for c in "xyz"])
    return on_faces(spark, sf_dir).select("event_id", r6(lat).alias("lat"), r6(lon).alias("lon"))


#: Events on each face.
_BUSY = "busy AS (SELECT face, count(*) AS events FROM f GROUP BY face)"


def busy(spark, sf_dir) -> DataFrame:
    return on_faces(spark, sf_dir).groupBy("face").agg(F.count("*").alias("events"))


@query(f"""WITH {E}, {DIR}, {FACE}, {_BUSY}, {directed(pixels(8, 1), "px")} SELECT face, i, j, events, {rounded("u", "v")}, round(degrees(asin(z)), 6) + 0.0 AS lat,
  round(CASE WHEN degrees(atan2(y, x)) >= 180 THEN degrees(atan2(y, x)) - 360 ELSE degrees(atan2(y, x)) END, 6) + 0.0 AS lon FROM px JOIN busy USING (face)""")
def q44_face_pixels(spark, sf_dir):
    return geometry.face_pixel_latlon(spark, 8, 1).join(busy(spark, sf_dir), "face").select("face", "i", "j", "events", *[r6(F.col(c)).alias(c) for c in ("u", "v", "lat", "lon")])


_R = geometry.EARTH_RADIUS_KM


@query(f"""WITH {G}, c AS (SELECT i, j, n, 90 - (i + 0.5::DOUBLE) * 180 / {H} AS lat, (j + 0.5::DOUBLE) * 360 / {W} - 180 AS lon FROM g)
SELECT i, j, n, {rounded("lat", "lon")}, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(sin(radians(lat)), 6) + 0.0 AS z,
  round({_R}::DOUBLE * {_R}::DOUBLE * (pi() / {H}) * (2 * pi() / {W}) * cos(radians(lat)), 3) + 0.0 AS km2, round(sqrt(1 + pow(greatest(0.15::DOUBLE, cos(radians(lat))), 2)), 6) + 0.0 AS step, 40075.0::DOUBLE / 4 / 64 AS px FROM c""")
def q45_equirect_grid(spark, sf_dir):
    km2 = F.round(geometry.cell_area_km2(F.col("i"), H, W), 3) + 0.0
    step = geometry.step_length(F.lit(1), F.lit(-1), geometry.row_cos(F.col("i"), H))
    return geometry.equirect_grid(spark, H, W).join(grid(spark, sf_dir), ["i", "j"]).select("i", "j", "n", *[r6(F.col(c)).alias(c) for c in ("lat", "lon", "x", "y", "z")], km2.alias("km2"), r6(step).alias("step"), F.lit(geometry.px_km(64)).alias("px"))


@query(f"WITH {E}, {DIR} SELECT event_id, round(x, 6) + 0.0 AS ex, round(z, 6) + 0.0 AS ey, round(-y, 6) + 0.0 AS ez, true AS back, round((abs(x) * 64 + 2) / 68, 6) + 0.0 AS t FROM d")
def q46_engine_axes(spark, sf_dir):
    d = on_faces(spark, sf_dir)
    e = geometry.to_engine([F.col(c) for c in "xyz"])
    back = geometry.from_engine(e)
    same = (back[0] == F.col("x")) & (back[1] == F.col("y")) & (back[2] == F.col("z"))
    return d.select("event_id", *[r6(c).alias(n) for c, n in zip(e, ("ex", "ey", "ez"), strict=True)], same.alias("back"), r6(geometry.texture_coordinate(F.abs("x"), 64, 2)).alias("t"))


@query(f"""WITH {E}, {DIR}, {FACE}, {_BUSY}, side(edge, u, v) AS (VALUES ('top', 0.0::DOUBLE, 1.01::DOUBLE), ('bottom', 0, -1.01), ('left', -1.01, 0), ('right', 1.01, 0)),
a AS (SELECT face::INTEGER AS face, edge, u, v FROM (SELECT unnest(range(6)) AS face), side), {directed("a", "ad")}, {placed("ad", "p")} SELECT p.face, edge, CAST(o AS INTEGER) AS neighbour, events FROM p JOIN busy ON busy.face = o""")
def q47_neighbour_faces(spark, sf_dir):
    across = busy(spark, sf_dir).withColumnRenamed("face", "neighbour")
    return geometry.neighbour_faces(spark).join(across, "neighbour").select("face", "edge", "neighbour", "events")


# --- resampling ----------------------------------------------------------------------------------------------------

_BYTES = "abs(h) % 300"
_CORNERS = f"""p AS (SELECT *, (90 - lat) / 180 * {H} - 0.5 AS y, (lon + 180) / 360 * {W} - 0.5 AS x FROM e),
c AS (SELECT event_id, cast(floor(y) AS INTEGER) + a AS ci, cast(floor(x) AS INTEGER) + b AS cj, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
  FROM p, range(2) ta(a), range(2) tb(b))"""


@query(f"""WITH {G}, {E}, {_CORNERS}, s AS (SELECT event_id, sum(w * h) AS h, sum(w * ({_BYTES})) AS b FROM c JOIN g ON g.i = greatest(0, least({H - 1}, ci)) AND g.j = (cj + {W}) % {W} GROUP BY event_id)
SELECT e.event_id, round(s.h, 4) + 0.0 AS h, CAST(greatest(0, least(255, round_even(s.b, 0))) AS INTEGER) AS b, g.n FROM e JOIN s ON s.event_id = e.event_id
LEFT JOIN g ON g.i = greatest(0, least({H - 1}, CAST(round_even((90 - lat) / 180 * {H} - 0.5, 0) AS INTEGER))) AND g.j = (CAST(round_even((lon + 180) / 360 * {W} - 0.5, 0) AS INTEGER) + {W}) % {W}""")
def q48_sample_layers(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("b", F.abs("h") % 300)
    out = resample.sample_layers(points(spark, sf_dir).select("event_id", "lat", "lon"), "event_id", g, H, W, ["h", "b", "n"], {"n"}, {"b"})
    return out.select("event_id", r4(F.col("h")).alias("h"), "b", "n")


N = 16


@query(f"""WITH {E}, {DIR}, {placed("d", "p")}, c AS (SELECT event_id, o, {cell_of(f"(1 - ov) * 0.5 * {N} - 0.5", N)} AS i, {cell_of(f"(ou + 1) * 0.5 * {N} - 0.5", N)} AS j FROM p)
SELECT event_id, CAST({value_sql("o", "i", "j")} AS DOUBLE) AS h FROM c""")
def q49_nearest_on_faces(spark, sf_dir):
    return resample.nearest_on_faces(on_faces(spark, sf_dir).select("event_id", *"xyz"), cube_values(spark, sf_dir, N), ["h"], N).select("event_id", "h")


def cross_face(source: str, key: str, n: int) -> str:
    """CTEs: ``source(key, x, y, z)`` with the cube's bilinear value ``h`` in ``sampled``; corners beyond a face are looked up on theirs."""
    return f"""{placed(source, "s0")}, s1 AS (SELECT {key}, o AS face, (ou + 1) * 0.5 * {n} - 0.5 AS px, (1 - ov) * 0.5 * {n} - 0.5 AS py FROM s0),
s2 AS (SELECT {key}, face, CAST(floor(py) AS INTEGER) + a AS i, CAST(floor(px) AS INTEGER) + b AS j, (CASE a WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) * (CASE b WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) AS w FROM s1, range(2) ta(a), range(2) tb(b)),
s3 AS (SELECT *, (j + 0.5::DOUBLE) / {n} * 2 - 1 AS u, 1 - (i + 0.5::DOUBLE) / {n} * 2 AS v FROM s2), {directed("s3", "s4")}, {placed("s4", "s5")},
s6 AS (SELECT {key}, w, CASE WHEN i BETWEEN 0 AND {n - 1} AND j BETWEEN 0 AND {n - 1} THEN {value_sql("face", "i", "j")} ELSE {value_sql("o", cell_of(f"(1 - ov) * 0.5 * {n} - 0.5", n), cell_of(f"(ou + 1) * 0.5 * {n} - 0.5", n))} END AS v FROM s5),
sampled AS (SELECT {key}, sum(w * v) AS h FROM s6 GROUP BY {key})"""


@query(f"WITH {E}, {DIR}, {cross_face('d', 'event_id', N)} SELECT event_id, round(h, 4) + 0.0 AS h FROM sampled")
def q50_cross_face_bilinear(spark, sf_dir):
    return resample.sample_face(on_faces(spark, sf_dir).select("event_id", *"xyz"), "event_id", cube_values(spark, sf_dir, N), "h", N).select("event_id", r4(F.col("h")).alias("h"))


@query(f"""WITH {E}, {DIR}, {placed("d", "p")}, s AS (SELECT event_id, o AS face, greatest(0, least({N - 1}, (ou + 1) * 0.5 * {N} - 0.5)) AS x, greatest(0, least({N - 1}, (1 - ov) * 0.5 * {N} - 0.5)) AS y FROM p),
c AS (SELECT event_id, face, least({N - 1}, CAST(floor(y) AS INTEGER) + a) AS i, least({N - 1}, CAST(floor(x) AS INTEGER) + b) AS j, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM s, range(2) ta(a), range(2) tb(b))
SELECT event_id, round(sum(w * {value_sql("face", "i", "j")}), 4) + 0.0 AS h FROM c GROUP BY event_id""")
def q93_sample_on_face(spark, sf_dir):
    at = on_faces(spark, sf_dir).select("event_id", "face", "u", "v")
    return resample.sample_on_face(at, "event_id", cube_values(spark, sf_dir, N), "h", N).select("event_id", r4(F.col("h")).alias("h"))


BN, BP = 8, 2


def _blended() -> str:
    """CTEs of the cross-fade: edge after edge, each mixing what is there with the other face's padded value."""
    parts = [f"b0 AS (SELECT face, i, j, u, v, CAST({value_sql('face', 'i', 'j')} AS DOUBLE) AS h FROM {pixels(BN)})"]
    clamp = lambda c: f"greatest({-BP}, least({BN + BP - 1}, {c}))"
    for k, (distance, eu, ev) in enumerate((("i", 0.0, 1.01), (f"{BN - 1} - i", 0.0, -1.01), ("j", -1.01, 0.0), (f"{BN - 1} - j", 1.01, 0.0))):
        parts += [
            f"n{k} AS (SELECT unnest(range(6))::INTEGER AS face, {eu}::DOUBLE AS u, {ev}::DOUBLE AS v)", directed(f"n{k}", f"m{k}"), placed(f"m{k}", f"q{k}"),
            f"a{k} AS (SELECT b.*, CAST({distance} AS DOUBLE) AS dist, q.o AS other FROM b{k} b JOIN q{k} q ON q.face = b.face WHERE {distance} < {BP})", directed(f"a{k}", f"d{k}"),
            f"u{k} AS (SELECT face, i, j, dist, other AS o, {_ON} FROM (SELECT *, other AS o FROM d{k}))",
            f"c{k} AS (SELECT face, i, j, dist, o, CAST(floor((1 - ov) * 0.5 * {BN} - 0.5) AS INTEGER) + a AS ci, CAST(floor((ou + 1) * 0.5 * {BN} - 0.5) AS INTEGER) + b AS cj, (1 - ov) * 0.5 * {BN} - 0.5 AS py, (ou + 1) * 0.5 * {BN} - 0.5 AS px, a, b FROM u{k}, range(2) ta(a), range(2) tb(b))",
            f"o{k} AS (SELECT face, i, j, any_value(dist) AS dist, sum((CASE a WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) * (CASE b WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * {value_sql('o', clamp('ci'), clamp('cj'))}) AS x FROM c{k} GROUP BY face, i, j)",
            f"b{k + 1} AS (SELECT b.face, b.i, b.j, b.u, b.v, CASE WHEN o.x IS NULL THEN b.h ELSE least(1.0, greatest(0.5, 0.5 + 0.5 * (o.dist + 0.5) / {BP})) * b.h + (1 - least(1.0, greatest(0.5, 0.5 + 0.5 * (o.dist + 0.5) / {BP}))) * o.x END AS h FROM b{k} b LEFT JOIN o{k} o ON o.face = b.face AND o.i = b.i AND o.j = b.j)",
        ]
    return ", ".join(parts)


@query(f"WITH {_blended()} SELECT face, i, j, round(h, 4) + 0.0 AS h FROM b4")
def q51_blend_faces(spark, sf_dir):
    return resample.blend_faces(cube_values(spark, sf_dir, BN, BP), "h", BN, BP).select("face", "i", "j", r4(F.col("h")).alias("h"))


@query(f"""WITH a AS {pixels(BN, 1)}, {directed("a", "d")}, {placed("d", "p")}
SELECT face, i, j, CAST(CASE WHEN i BETWEEN 0 AND {BN - 1} AND j BETWEEN 0 AND {BN - 1} THEN {value_sql("face", "i", "j")} ELSE {value_sql("o", cell_of(f"(1 - ov) * 0.5 * {BN} - 0.5", BN), cell_of(f"(ou + 1) * 0.5 * {BN} - 0.5", BN))} END AS DOUBLE) AS h FROM p""")
def q52_padded_faces(spark, sf_dir):
    return resample.padded_faces(cube_values(spark, sf_dir, BN), ["h"], BN, 1)


@query(f"""WITH {V}, c AS (SELECT vec_id, i - 1 AS i, j - 1 AS j, x AS v FROM v WHERE i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6), {mean_preserving("c", "m", 2, 6, 6, "vec_id")}, {upsampled("c", "b", 2, 6, 6, "vec_id")}
SELECT vec_id, i - 2 AS i, j - 2 AS j, round(m.v, 6) + 0.0 AS height, round(b.v, 6) + 0.0 AS flowacc FROM m JOIN b USING (vec_id, i, j) WHERE i BETWEEN 2 AND 9 AND j BETWEEN 2 AND 9""")
def q53_coarse_layers(spark, sf_dir):
    context = patches(spark, sf_dir).select("vec_id", "i", "j", F.col("x").alias("height"), F.col("x").alias("flowacc"))
    return resample.coarse_layers(context, ["height", "flowacc"], 8, 4, 2, ["vec_id"]).select("vec_id", "i", "j", r6(F.col("height")).alias("height"), r6(F.col("flowacc")).alias("flowacc"))


@query(f"""WITH {G}, k AS (SELECT i // 4 AS i, j // 4 AS j, avg(n::DOUBLE) AS v FROM g GROUP BY ALL), {mean_preserving("k", "m", 4, H // 4, W // 4)}
SELECT i, j, round(g.h + g.n - m.v, 4) + 0.0 AS h FROM g JOIN m USING (i, j)""")
def q54_keep_means(spark, sf_dir):
    g = grid(spark, sf_dir)
    base, residual = g.select("i", "j", F.col("h").cast("double").alias("h")), g.select("i", "j", F.col("n").cast("double").alias("h"))
    return resample.keep_means(base, residual, 4, "h", H, W).select("i", "j", r4(F.col("h")).alias("h"))


TILES = ((32, 8, 1), (16, 5, 4), (40, 8, 1))


@query(" UNION ALL ".join(f"SELECT DISTINCT {t} AS tile, n, CAST(least(s, n - {t}) AS BIGINT) AS start FROM (SELECT DISTINCT p_size + {t} AS n FROM part), LATERAL (SELECT unnest(range(0, n, {max(1, (t - o) // f * f)})) AS s)" for t, o, f in TILES))
def q55_tile_starts(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").select("p_size").distinct()
    parts = [resample.tile_starts_of(sizes.select((F.col("p_size") + t).alias("n")), "n", t, o, f).select(F.lit(t).alias("tile"), "n", "start") for t, o, f in TILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- stencils ------------------------------------------------------------------------------------------------------


def gaussian_sql(source: str, out: str, sigma: float, width: int, height: int) -> str:
    """CTEs: ``source(i, j, v)`` smoothed, rows closed and columns replicated."""
    radius = int(4 * sigma + 0.5)
    each = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = ", ".join(f"({k}, {w / sum(each)!r}::DOUBLE)" for k, w in zip(range(-radius, radius + 1), each, strict=True))
    return f"""{out}_w(k, w) AS (VALUES {weights}), {out}_r AS (SELECT a.i, a.j, sum(w * b.v) AS v FROM {source} a, {out}_w, {source} b WHERE b.i = a.i AND b.j = (a.j + k + {10 * width}) % {width} GROUP BY a.i, a.j),
{out} AS (SELECT a.i, a.j, sum(w * b.v) AS v FROM {out}_r a, {out}_w, {out}_r b WHERE b.j = a.j AND b.i = greatest(0, least({height - 1}, a.i + k)) GROUP BY a.i, a.j)"""


@query(f"WITH {G}, s AS (SELECT i, j, h::DOUBLE AS v FROM g), {gaussian_sql('s', 'o', 1.5, W, H)} SELECT i, j, round(v, 4) + 0.0 AS h FROM o")
def q56_gaussian(spark, sf_dir):
    return windows.gaussian(grid(spark, sf_dir), "h", 1.5, W, "g").select("i", "j", r4(F.col("g")).alias("h"))


@query(f"""WITH {G}, s AS (SELECT i, j, h / 50.0::DOUBLE AS v FROM g), {gaussian_sql("s", "lo", 2.0, W, H)}, {gaussian_sql("s", "hi", 1.0, W, H)}
SELECT i, j, round(CASE WHEN s.v > 0 THEN greatest(0.5, lo.v * (1 - greatest(0, least(1, s.v / 1500))) + hi.v * greatest(0, least(1, s.v / 1500))) ELSE s.v END, 4) + 0.0 AS h FROM s JOIN lo USING (i, j) JOIN hi USING (i, j)""")
def q57_smooth_relief(spark, sf_dir):
    g = grid(spark, sf_dir).select("i", "j", (F.col("h") / 50.0).alias("h"))
    return planets.smooth_relief(g, W, 2.0, 1.0).select("i", "j", r4(F.col("h")).alias("h"))


@query(f"""WITH {G}, b AS (SELECT a.i, a.j, any_value(a.h) AS h, avg(CASE WHEN b.h > 0 THEN 1.0::DOUBLE ELSE 0 END) AS m FROM g a, range(-3, 4) p(di), range(-3, 4) q(dj), g b
  WHERE b.i = greatest(0, least({H - 1}, a.i + di)) AND b.j = greatest(0, least({W - 1}, a.j + dj)) GROUP BY a.i, a.j)
SELECT i, j, round(CASE WHEN h > 0 THEN greatest(0, least(1, (m - 0.5) / 0.5)) ELSE 0 END, 6) + 0.0 AS cont, round(CASE WHEN h > 0 THEN 0.5::DOUBLE * (0.003::DOUBLE + 0.997::DOUBLE * pow(greatest(0, least(1, (h / 20.0::DOUBLE - 0.6 * 1000) / 6000)), 1.2)) ELSE 0 END, 6) + 0.0 AS uplift FROM b""")
def q58_continentality_uplift(spark, sf_dir):
    g = windows.continentality(grid(spark, sf_dir), "h", 3)
    return g.select("i", "j", r6(F.col("cont")).alias("cont"), r6(planets.uplift(F.col("h") / 20.0, planets.PlanetParams(), 0.5)).alias("uplift"))


_WET = f"({value_sql('face', 'i', 'j')} % 5 = 0)"


@query(f"""WITH c AS (SELECT face, i, j, {_WET} AS w FROM {pixels(BN, BP)}), o AS (SELECT * FROM c WHERE w)
SELECT face, i, j, {", ".join(f"round(ln(1 + least(30.0::DOUBLE, coalesce((SELECT {agg} FROM o WHERE o.face = c.face AND {where}) * 2.5::DOUBLE, 30))), 6) + 0.0 AS dist_{d}" for d, agg, where in (("up", "min(c.i - o.i)", "o.j = c.j AND o.i <= c.i"), ("down", "min(o.i - c.i)", "o.j = c.j AND o.i >= c.i"), ("left", "min(c.j - o.j)", "o.i = c.i AND o.j <= c.j"), ("right", "min(o.j - c.j)", "o.i = c.i AND o.j >= c.j")))}
FROM c WHERE i BETWEEN 0 AND {BN - 1} AND j BETWEEN 0 AND {BN - 1}""")
def q59_face_distances(spark, sf_dir):
    cells = cube(spark, sf_dir, BN, BP).select("face", "i", "j", (F.col("v_") % 5 == 0).alias("w"))
    out = windows.face_distances(cells, "w", BN, 2.5, 30.0)
    return out.select("face", "i", "j", *[r6(F.col(f"dist_{d}")).alias(f"dist_{d}") for d in ("up", "down", "left", "right")])


# --- predicates, layers, catalogue ---------------------------------------------------------------------------------


@query(f"""WITH {E}, {DIR}, {placed("d", "p")}, l AS (SELECT CAST(o AS INTEGER) AS face, {cell_of(f"(1 - ov) * 0.5 * {N} - 0.5", N)} AS i, {cell_of(f"(ou + 1) * 0.5 * {N} - 0.5", N)} AS j, lat, lon FROM p)
SELECT face, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM l WHERE {" OR ".join(f"(lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d})" for a, b, c, d in BOXES)} GROUP BY face""")
def q60_holdout_boxes(spark, sf_dir):
    i, j = geometry.uv_to_pixel(N, F.col("u"), F.col("v"))
    return bake.holdout_boxes(predicates.mark_holdout(on_faces(spark, sf_dir).select("face", i.alias("i"), j.alias("j"), "lat", "lon"), BOXES))


@query(f"""WITH c AS (SELECT face, i, j, {value_sql("face", "i", "j")} AS v FROM {pixels(N)}), w AS (SELECT a.face, a.i // 2 AS bi, a.j // 2 AS bj,
  (SELECT count(*) FROM c b WHERE b.face = a.face AND b.i BETWEEN a.i AND a.i + 3 AND b.j BETWEEN a.j AND a.j + 3 AND b.v = 1) AS held,
  (SELECT count(*) FROM c b WHERE b.face = a.face AND b.i BETWEEN a.i AND a.i + 3 AND b.j BETWEEN a.j AND a.j + 3 AND b.v > 26) AS land
  FROM c a WHERE a.i % 2 = 0 AND a.j % 2 = 0 AND a.i <= {N - 4} AND a.j <= {N - 4})
SELECT face, CAST(bi AS BIGINT) AS bi, CAST(bj AS BIGINT) AS bj FROM w WHERE held = 0 AND land >= 8""")
def q61_acceptable_patches(spark, sf_dir):
    cells = cube(spark, sf_dir, N).select("face", "i", "j", (F.col("v_") - 26).alias("height"), (F.col("v_") == 1).alias("holdout"))
    return bake.acceptable(cells, N, 4, 2, "train", 0.5)


_HELD = f"(({value_sql('face', '(i // 8) * 8', '(j // 8) * 8')}) % 3 = 0)"


def split_cells(spark, sf_dir) -> DataFrame:
    """A cube's heights, with square regions held out whole."""
    region = cube(spark, sf_dir, N).where("i % 8 = 0 and j % 8 = 0").select("face", F.col("i").alias("_i"), F.col("j").alias("_j"), (F.col("v_") % 3 == 0).alias("holdout"))
    cells = cube(spark, sf_dir, N).withColumn("_i", F.floor(F.col("i") / 8) * 8).withColumn("_j", F.floor(F.col("j") / 8) * 8)
    return cells.join(region, ["face", "_i", "_j"]).select("face", "i", "j", (F.col("v_") - 26).alias("height"), "holdout")


@query(f"""WITH c AS (SELECT face, i, j, {value_sql("face", "i", "j")} - 26 AS height, {_HELD} AS held FROM {pixels(N)}), w AS (SELECT a.face, a.i // 2 AS bi, a.j // 2 AS bj,
  (SELECT count(*) FROM c b WHERE b.face = a.face AND b.i BETWEEN a.i AND a.i + 3 AND b.j BETWEEN a.j AND a.j + 3 AND b.held) AS held,
  (SELECT count(*) FROM c b WHERE b.face = a.face AND b.i BETWEEN a.i AND a.i + 3 AND b.j BETWEEN a.j AND a.j + 3 AND b.height > 0) AS land
  FROM c a WHERE a.i % 2 = 0 AND a.j % 2 = 0 AND a.i <= {N - 4} AND a.j <= {N - 4}),
bx AS (SELECT face, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM c WHERE held GROUP BY face),
sh AS (SELECT face, 1.0::DOUBLE / ((least(i1 // 2, {(N - 4) // 2}) - greatest(i0 - 3, 0) // 2 + 1) * (least(j1 // 2, {(N - 4) // 2}) - greatest(j0 - 3, 0) // 2 + 1)) AS share FROM bx),
ok AS (SELECT 'train' AS split, face, bi, bj, 1.0::DOUBLE AS share FROM w WHERE held = 0 AND land >= 4 UNION ALL SELECT 'val', face, bi, bj, share FROM w JOIN sh USING (face) WHERE held = 16 AND land >= 4),
fc AS (SELECT split, face, count(*) AS n, count(*) * any_value(share) AS part FROM ok GROUP BY split, face),
fa AS (SELECT split, face, n, part / sum(part) OVER (PARTITION BY split) AS part, coalesce(sum(part) OVER (PARTITION BY split ORDER BY face ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(part) OVER (PARTITION BY split) AS low,
  coalesce(sum(n) OVER (PARTITION BY split ORDER BY face ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM fc),
rk AS (SELECT split, face, bi, bj, row_number() OVER (PARTITION BY split ORDER BY face, bi, bj) - 1 AS rank FROM ok),
ix AS (SELECT o_orderkey AS idx FROM orders), {hash_sql("ix", "dr", "idx * 1000003", "5")}, {hash_sql("ix", "tu", "idx * 1000003 + 3", "5")}, {hash_sql("ix", "fl", "idx * 1000003 + 4", "5")},
pk AS (SELECT fa.split, dr.idx, first + least(n - 1, CAST(floor((u - low) / part * n) AS BIGINT)) AS rank FROM dr JOIN fa ON u >= low QUALIFY row_number() OVER (PARTITION BY fa.split, dr.idx ORDER BY low DESC) = 1),
ch AS (SELECT pk.split, pk.idx, rk.face, rk.bi * 2 AS i0, rk.bj * 2 AS j0, CAST(floor(tu.u * 4) AS INTEGER) AS turns, fl.u < 0.5 AS flip FROM pk JOIN rk USING (split, rank) JOIN tu ON tu.idx = pk.idx JOIN fl ON fl.idx = pk.idx)
SELECT ch.split, ch.idx, ch.face, CAST(ch.i0 AS BIGINT) AS i0, CAST(ch.j0 AS BIGINT) AS j0, turns, flip, CAST(sum(height * ((c.i - i0) * 4 + c.j - j0 + 1)) AS BIGINT) AS seen FROM ch JOIN c ON c.face = ch.face AND c.i BETWEEN i0 AND i0 + 3 AND c.j BETWEEN j0 AND j0 + 3 GROUP BY ALL""")
def q91_seeded_patches(spark, sf_dir):
    cells = tables.settled(split_cells(spark, sf_dir))
    indices = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    parts = []
    for split in ("train", "val"):
        drawn = tables.settled(bake.seeded_patches(cells, indices, 5, N, 4, 2, split, 0.25))
        seen = bake.patch_sums(drawn, cells, 4, 2, {"seen": F.sum(F.col("height") * (F.col("a") * 4 + F.col("b") + 1))})
        parts.append(seen.select(F.lit(split).alias("split"), *drawn.columns, "seen"))
    return parts[0].unionByName(parts[1])


@query("""SELECT o_custkey, min(o_orderkey % 40) AS attempt FROM orders WHERE o_totalprice > 1000 OR o_orderkey % 40 = 39 GROUP BY o_custkey""")
def q62_first_accepted(spark, sf_dir):
    tries = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("attempt"), ((F.col("o_totalprice") > 1000) | (F.col("o_orderkey") % 40 == 39)).alias("ok"))
    able = tries.where("ok").select("o_custkey").distinct()
    return predicates.first_accepted(tries.join(able, "o_custkey"), ["o_custkey"], "attempt", "ok", 40)


@query("""WITH m AS (SELECT n_nationkey AS k, m, CASE WHEN n_nationkey = 3 AND m = 5 THEN -9999.0 WHEN n_nationkey = 4 THEN 0.0 WHEN n_nationkey = 6 AND m = 7 THEN 'nan'::DOUBLE ELSE ((n_nationkey * 7 + m * 3) % 11)::DOUBLE END AS v
  FROM nation, (SELECT unnest(range(1, 13)) AS m)), x AS (SELECT k, CASE WHEN v = -9999.0 OR isnan(v) THEN NULL ELSE v END AS v FROM m)
SELECT k, round(avg(v), 6) + 0.0 AS mean, max(v) - min(v) AS range, sum(v) AS total, count(v) = 12 AND NOT bool_and(v = 0) AS valid FROM x GROUP BY k""")
def q63_validity_mask(spark, sf_dir):
    k, m = F.col("n_nationkey"), F.col("month")
    months = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    v = F.when((k == 3) & (m == 5), F.lit(-9999.0)).when(k == 4, F.lit(0.0)).when((k == 6) & (m == 7), F.lit(float("nan"))).otherwise(((k * 7 + m * 3) % 11).cast("double"))
    out = tables.monthly_summary(months.select(k.alias("k"), "month", v.alias("v")), ["k"], "v", -9999.0)
    return out.select("k", r6(F.col("mean")).alias("mean"), "range", "total", "valid")


@query(f"WITH {G} SELECT i, j, h AS height, n, CAST(CASE WHEN n >= 10 THEN h ELSE -h END AS BIGINT) AS rgb FROM g")
def q64_aligned_layers(spark, sf_dir):
    g = grid(spark, sf_dir)
    both = tables.aligned({"height": g.select("i", "j", "h"), "n": g.select("i", "j", "n"), "rgb": g.select("i", "j", "h")}, ["i", "j"])
    over = g.select("i", "j", F.when(F.col("n") >= 10, F.col("h")).otherwise(-F.col("h")).alias("rgb"))
    return tables.overlaid(both, over, ["i", "j"])


@query(f"SELECT face, i, j, CAST({value_sql('face', 'i', 'j')} AS DOUBLE) AS height, round(pi() / 2 * 6371000 / {BN}, 6) + 0.0 AS metres FROM {pixels(BN)} WHERE face = 2")
def q65_cube_round_trip(spark, sf_dir):
    path = tables.scratch(spark)
    tables.write_cells(cube_values(spark, sf_dir, BN).withColumnRenamed("h", "height"), path)
    cells, metres, stride = tables.open_cube(spark, path, BN, 6_371_000.0)
    assert stride is None and cells.columns == ["face", "i", "j", "height"]
    return tables.read_cells(spark, path, 2, ["height"]).withColumn("metres", r6(F.lit(metres)))


@query(f"""WITH {E}, {DIR}, {placed("d", "p")} SELECT face, count(*) AS n, round(sum(x), 4) + 0.0 AS x, round(sum(u), 4) + 0.0 AS u, round(sum(v), 4) + 0.0 AS v, round(sum(lat), 4) + 0.0 AS lat, round(sum(lon), 4) + 0.0 AS lon
FROM (SELECT CAST(o AS BIGINT) AS face, x, ou AS u, ov AS v, degrees(asin(z)) AS lat, degrees(atan2(y, x)) AS lon FROM p) GROUP BY face""")
def q89_vector_sink(spark, sf_dir):
    path = tables.scratch(spark)
    registry.write_vectors(on_faces(spark, sf_dir).select(*"xyz"), path)
    back = spark.read.schema("dir array<double>, face long, u double, v double, lat double, lon double").json(path)
    return back.groupBy("face").agg(F.count("*").alias("n"), r4(F.sum(F.col("dir")[0])).alias("x"), *[r4(F.sum(c)).alias(c) for c in ("u", "v", "lat", "lon")])


@query(f"""SELECT layer, CAST(CASE layer WHEN 'wet' THEN (SELECT count(*) FROM {pixels(BN)} WHERE {value_sql("face", "i", "j")} > 9) ELSE 6 * {BN * BN} END AS BIGINT) AS rows, 'py' AS third, 8 AS factor, 4 AS fine, {len(BOXES)} AS boxes, {BOXES[0][2]}::DOUBLE AS west, 'two' AS a, 'x' AS b FROM (VALUES ('height'), ('wet')) t(layer)""")
def q66_catalogue(spark, sf_dir):
    path = tables.scratch(spark)
    cells = cube_values(spark, sf_dir, BN).withColumnRenamed("h", "height").withColumn("wet", F.when(F.col("height") > 9, True))
    tables.write_meta(cells, path, BN, 8, 896, BOXES, 4)
    meta = tables.with_provenance(tables.with_provenance(tables.read_meta(spark, path), {"a": "one", "b": "x"}), {"a": "two"})
    noted = [F.col("ctx_factor").alias("factor"), F.col("fine_pad").alias("fine"), F.size("holdout").alias("boxes"), F.col("holdout")[0]["lon_min"].alias("west"), F.col("run")["a"].alias("a"), F.col("run")["b"].alias("b")]
    return meta.select(F.explode("layers").alias("layer", "x"), "faces", *noted).select("layer", "x.rows", F.col("faces")[2].alias("third"), "factor", "fine", "boxes", "west", "a", "b")


@query("""SELECT event_id AS step, event_type AS phase, (SELECT count(*) FROM events) AS logged FROM events WHERE event_id = (SELECT max(event_id) FROM events)""")
def q67_training_log(spark, sf_dir):
    path, events = tables.scratch(spark), read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("phase"))
    for part in (0, 1):
        tables.append_log(events.where(F.col("step") % 2 == part), path)
    log = spark.read.schema("step long, phase string").option("header", True).csv(path)
    return tables.last_row(log).crossJoin(log.agg(F.count("*").alias("logged")))


@query(f"WITH {G} SELECT CAST(round_even(greatest(0.0, least(1.0, (h / 40.0::DOUBLE + 8000) / 16000)) * 255, 0) AS INTEGER) AS level, count(*) AS n FROM g GROUP BY 1")
def q68_height_preview(spark, sf_dir):
    g = grid(spark, sf_dir).select((F.col("h") / 40.0).alias("height"))
    return g.select(tables.preview(g, "height").alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT event_id AS step, event_type FROM events WHERE event_id > 700")
def q69_resumed(spark, sf_dir):
    return resumed(read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "event_type"), 700)


_NODES = "SELECT CAST(o_orderkey % 6 AS INTEGER) AS face, 3 AS level, CAST(o_custkey % 8 AS BIGINT) AS x, CAST(o_orderkey // 6 % 8 AS BIGINT) AS y, min(o_totalprice) AS dist FROM orders WHERE {} GROUP BY ALL"


@query(f"""WITH w AS ({_NODES.format("o_orderkey % 5 < 3")}), b AS ({_NODES.format("o_orderkey % 5 > 3 AND o_custkey % 3 = 0")})
SELECT face, level, x, y, 'drop' AS action FROM b ANTI JOIN w USING (face, level, x, y) UNION ALL
SELECT * FROM (SELECT face, level, x, y, 'build' AS action FROM w ANTI JOIN b USING (face, level, x, y) ORDER BY dist, face, level, x, y LIMIT 12)""")
def q70_patch_changes(spark, sf_dir):
    def nodes(where):
        o = read(spark, sf_dir, "orders").where(where)
        return o.groupBy((F.col("o_orderkey") % 6).cast("int").alias("face"), F.lit(3).alias("level"), (F.col("o_custkey") % 8).alias("x"), (F.floor(F.col("o_orderkey") / 6) % 8).alias("y")).agg(F.min("o_totalprice").alias("dist"))

    return quadtree.patch_changes(nodes("o_orderkey % 5 < 3"), nodes("o_orderkey % 5 > 3 and o_custkey % 3 = 0").drop("dist"))


# --- features ------------------------------------------------------------------------------------------------------


def layered(spark, sf_dir, names) -> DataFrame:
    """Every named layer from the grid by a formula of its own, none of whose values ends at the place it is rounded at."""
    g = grid(spark, sf_dir)
    return g.select("i", "j", *[(((F.col("h") + 0.31831) / 97 + k * F.col("n")) / (k + 1.0)).alias(n) for k, n in enumerate(names)])


def _normal(name: str, x: str) -> str:
    value = f"ln(1 + greatest({x}, 0))" if name in features.LOG else f"({x})"
    return f"{value} / {features.SCALE.get(name, 1.0)}::DOUBLE"


def _layer_sql(k: int) -> str:
    return f"(((h + 0.31831::DOUBLE) / 97 + {k} * n) / ({k} + 1.0::DOUBLE))"


@query(f"WITH {G} " + " UNION ALL ".join(f"SELECT i, j, {k} AS channel, round({_normal(n, _layer_sql(k))}, 6) + 0.0 AS x FROM g" for k, n in enumerate(features.CTX)))
def q71_context_vector(spark, sf_dir):
    rows = layered(spark, sf_dir, features.CTX).select("i", "j", F.posexplode(features.vector(features.CTX)).alias("channel", "x"))
    return rows.select("i", "j", "channel", r6(F.col("x")).alias("x"))


_GIVEN = [n for n in features.COND if n not in ("height", "slope", "ocean")]


def _conditioning(height: str) -> str:
    """The channels of ``x(i, j, height above the sea, neighbours, own h and n)``."""
    gradient = "sqrt(pow((coalesce(e, height) - coalesce(w, height)) / 2, 2) + pow((coalesce(s_, height) - coalesce(n_, height)) / 2, 2)) * (4 / 2.5::DOUBLE)"
    given = {"height": "height", "slope": gradient, "ocean": "CASE WHEN height < 0 THEN 1.0 ELSE 0.0 END"}
    channels = [_normal(c, given.get(c) or _layer_sql(_GIVEN.index(c))) for c in features.COND]
    near = "lag(height) OVER r AS w, lead(height) OVER r AS e, lag(height) OVER c AS n_, lead(height) OVER c AS s_"
    return f"y AS (SELECT i, j, h, n, {height} AS height FROM g), x AS (SELECT *, {near} FROM y WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i)) " + " UNION ALL ".join(f"SELECT i, j, {k} AS channel, round({c}, 6) + 0.0 AS x FROM x" for k, c in enumerate(channels))


@query(f"WITH {G}, {_conditioning('(h + 0.31831::DOUBLE) / 61 - 100')}")
def q72_conditioning(spark, sf_dir):
    cells = layered(spark, sf_dir, _GIVEN).join(grid(spark, sf_dir).select("i", "j", ((F.col("h") + 0.31831) / 61).alias("height")), ["i", "j"])
    rows = features.conditioning(cells, 2.5, 4.0, 100.0).select("i", "j", F.posexplode("cond").alias("channel", "x"))
    return rows.select("i", "j", "channel", r6(F.col("x")).alias("x"))


@query(f"WITH {G}, {_conditioning('n * 10.0::DOUBLE - 100')}")
def q73_joint_conditioning(spark, sf_dir):
    cells = layered(spark, sf_dir, _GIVEN).join(grid(spark, sf_dir).select("i", "j", ((F.col("h") + 0.31831) / 61).alias("height")), ["i", "j"])
    coarse = grid(spark, sf_dir).select("i", "j", (F.col("n") * 10.0).alias("height"))
    rows = features.conditioning(cells, 2.5, 4.0, 100.0, coarse).select("i", "j", F.posexplode("cond").alias("channel", "x"))
    return rows.select("i", "j", "channel", r6(F.col("x")).alias("x"))


@query(f"""WITH {V}, t AS (SELECT vec_id, j AS i, 7 - i AS j, x, -x AS y FROM v), u AS (SELECT vec_id, 7 - j AS i, i AS j, x, -x AS y FROM v)
SELECT vec_id, i, j, round(x, 6) + 0.0 AS ctx_dist_left, round(y, 6) + 0.0 AS dist_up, round(floor(abs(x) * 200) / 255, 6) + 0.0 AS rgb FROM u""")
def q74_augment_context(spark, sf_dir):
    v = patches(spark, sf_dir).select("vec_id", "i", "j", F.col("x").alias("ctx_dist_up"), (-F.col("x")).alias("dist_right"), F.floor(F.abs("x") * 200).alias("rgb"))
    turned = features.augment(v, 8, 1, False)
    return turned.select("vec_id", "i", "j", r6(F.col("ctx_dist_left")).alias("ctx_dist_left"), r6(F.col("dist_up")).alias("dist_up"), r6(features.unit_rgb(F.col("rgb")).cast("double")).alias("rgb"))


@query(f"WITH {G} " + " UNION ALL ".join(f"SELECT i, j, {k} AS channel, round({x}, 6) + 0.0 AS x FROM g" for k, x in enumerate(("n / 40.0::DOUBLE", "n / 50.0::DOUBLE", "n / 60.0::DOUBLE", "h / 4000.0::DOUBLE"))))
def q75_stacked_output(spark, sf_dir):
    g = grid(spark, sf_dir)
    both = g.select("i", "j", F.posexplode(features.stacked(F.array(*[F.col("n") / k for k in (40.0, 50.0, 60.0)]), F.col("h"))).alias("channel", "x"))
    return both.select("i", "j", "channel", r6(F.col("x")).alias("x"))


# --- drainage ------------------------------------------------------------------------------------------------------

_FILL = f"""f(t, i, j, h, f) AS (
  SELECT 0, i, j, h, CASE WHEN h <= 0 OR i IN (0, {H - 1}) THEN h ELSE 1e300::DOUBLE END FROM base
  UNION ALL
  SELECT t + 1, i, j, h, CASE WHEN h <= 0 OR i IN (0, {H - 1}) THEN h ELSE least(f, greatest(h, m + 0.001::DOUBLE)) END
  FROM (SELECT a.t, a.i, a.j, a.h, a.f, (SELECT min(b.f) FROM f b, steps s WHERE b.i = a.i + s.di AND b.j = (a.j + s.dj + {W}) % {W}) AS m FROM f a WHERE a.t < 60)),
filled AS (SELECT i, j, h, f FROM f WHERE t = 60)"""
_ROUTE = f"""drops AS (SELECT a.i, a.j, s.k, b.i * {W} + b.j AS r, (a.f - b.f) / sqrt(s.di * s.di + pow(s.dj * greatest(0.15::DOUBLE, cos(radians(90 - (a.i + 0.5) * 180 / {H}))), 2)) AS slope
  FROM filled a, steps s, filled b WHERE b.i = a.i + s.di AND b.j = (a.j + s.dj + {W}) % {W} AND a.f > b.f AND a.h > 0),
best AS (SELECT i, j, r FROM drops QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY slope DESC, k) = 1),
rec AS (SELECT CAST(g.i * {W} + g.j AS BIGINT) AS c, CAST(coalesce(b.r, g.i * {W} + g.j) AS BIGINT) AS rec, {_R}::DOUBLE * {_R}::DOUBLE * (pi() / {H}) * (2 * pi() / {W}) * cos(radians(90 - (g.i + 0.5) * 180 / {H})) AS a FROM filled g LEFT JOIN best b ON g.i = b.i AND g.j = b.j),
p(src, pos, a) AS (SELECT c, c, a FROM rec UNION ALL SELECT src, r.rec, p.a FROM p JOIN rec r ON r.c = p.pos WHERE r.rec <> r.c),
acc AS (SELECT pos AS c, sum(a) AS acc FROM p GROUP BY pos)"""
_BASE = "base AS (SELECT i, j, h / 20.0::DOUBLE AS h FROM g)"


def relief(spark, sf_dir) -> DataFrame:
    return grid(spark, sf_dir).select("i", "j", (F.col("h") / 20.0).alias("h"))


@query(f"WITH RECURSIVE {G}, {STEPS}, {_BASE}, {_FILL}, {_ROUTE} SELECT i, j, round(f, 4) + 0.0 AS f, rec.rec, round(acc.acc, 1) + 0.0 AS acc FROM filled JOIN rec ON rec.c = i * {W} + j JOIN acc ON acc.c = rec.c")
def q76_route(spark, sf_dir):
    return hydro.route(relief(spark, sf_dir), H, W).select("i", "j", r4(F.col("f")).alias("f"), "rec", (F.round("acc", 1) + 0.0).alias("acc"))


@query(f"""WITH RECURSIVE {G}, {STEPS}, {_BASE}, {_FILL}, {_ROUTE}, flat AS (SELECT a.i, a.j, max(b.h) - min(b.h) < 0.05 AND any_value(a.h) > 0 AS flat FROM base a JOIN base b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j)
SELECT i, j, h <= 0 OR f - h > 10 OR (SELECT count(*) FROM flat WHERE flat) >= 40 AS water, h <= 0 AS ocean, round(log10(1 + acc), 6) + 0.0 AS flowacc FROM filled JOIN acc ON acc.c = i * {W} + j""")
def q77_water_layers(spark, sf_dir):
    return hydro.water_layers(relief(spark, sf_dir), H, W).select("i", "j", "water", "ocean", r6(F.col("flowacc")).alias("flowacc"))


_COS = f"greatest(0.15::DOUBLE, cos(radians(90 - (i + 0.5) * 180 / {H})))"
_DX = f"(pi() * {_R}::DOUBLE * 1000 / {H})"


@query(f"""WITH RECURSIVE {G}, {STEPS}, start AS (SELECT i, j, h / 20.0::DOUBLE AS h FROM g),
base AS (SELECT i, j, CASE WHEN h > 0 THEN h + 1e-3 * 5e4 * 1.2::DOUBLE * (0.003::DOUBLE + 0.997 * pow(greatest(0, least(1, (h - 0.6 * 1000) / 6000)), 1.2)) ELSE h END AS h FROM start), {_FILL}, {_ROUTE},
way AS (SELECT rec.c, rec.rec, acc.acc, b.h, b.i, b.j, 5e4 * 1e-6 * pow(acc.acc * 1e6, 0.5) / ({_DX} * sqrt(pow(b.i - rec.rec // {W}, 2) + pow(least(abs(b.j - rec.rec % {W}), 1) * {_COS.replace("i +", "b.i +")}, 2))) AS factor FROM rec JOIN acc ON acc.c = rec.c JOIN base b ON b.i * {W} + b.j = rec.c),
q(c, v) AS (SELECT c, greatest(h, 0) FROM way WHERE rec = c OR h <= 0 UNION ALL SELECT w.c, (w.h + w.factor * q.v) / (1 + w.factor) FROM q JOIN way w ON w.rec = q.c AND w.rec <> w.c AND w.h > 0),
cut AS (SELECT w.i, w.j, w.acc, CASE WHEN w.rec = w.c OR w.h <= 0 THEN w.h ELSE q.v END AS h, w.h > 0 AS land FROM way w JOIN q ON q.c = w.c),
near AS (SELECT *, lag(h) OVER v AS up, lead(h) OVER v AS down, coalesce(lag(h) OVER r, last_value(h) OVER whole) AS west, coalesce(lead(h) OVER r, first_value(h) OVER whole) AS east FROM cut
  WINDOW v AS (PARTITION BY j ORDER BY i), r AS (PARTITION BY i ORDER BY j), whole AS (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
smooth AS (SELECT i, j, acc, land, CASE WHEN i BETWEEN 1 AND {H - 2} AND h > 0 THEN h + least(0.5 * 5e4 / pow({_DX}, 2), 0.2 * 0.15 * 0.15) * (up + down - 2 * h + (east + west - 2 * h) / pow({_COS}, 2)) ELSE h END AS h FROM near)
SELECT i, j, round(CASE WHEN land THEN greatest(h, 0.5) ELSE h END, 4) + 0.0 AS h, round(acc, 1) + 0.0 AS acc FROM smooth""")
def q92_erosion_step(spark, sf_dir):
    start = relief(spark, sf_dir)
    state = start.withColumn("uplift", planets.uplift(F.col("h"), planets.PlanetParams(), 1.2))
    out = planets.erosion_step(state, start.select("i", "j", F.lit(1.0).alias("rock")), H, W, planets.ErosionParams(), 0)
    return out.select("i", "j", r4(F.col("h")).alias("h"), (F.round("acc", 1) + 0.0).alias("acc"))


_STAIRS = "greatest(-1, least(2, h // 120000))"


@query(f"""WITH RECURSIVE {G}, q AS (SELECT i, j, CAST({_STAIRS} AS BIGINT) AS h, n FROM g),
l AS (SELECT a.i, a.j, a.i * {W} + a.j AS k FROM q a JOIN q b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j, a.h HAVING max(b.h) - min(b.h) < 2 AND a.h > 0),
r(t, i, j, k) AS (SELECT 0, i, j, k FROM l UNION ALL SELECT a.t + 1, a.i, a.j, least(a.k, (SELECT min(b.k) FROM r b WHERE abs(b.i - a.i) + abs(b.j - a.j) = 1)) FROM r a WHERE a.t < 60),
big AS (SELECT i, j FROM r WHERE t = 60 AND k IN (SELECT k FROM r WHERE t = 60 GROUP BY k HAVING count(*) >= 3))
SELECT q.i, q.j, q.h > 0 AND (n % 5 > 3 OR big.i IS NOT NULL) AS lake FROM q LEFT JOIN big ON big.i = q.i AND big.j = q.j""")
def q78_lake_mask(spark, sf_dir):
    stairs = F.greatest(F.lit(-1), F.least(F.lit(2), F.floor(F.col("h") / 120000)))
    g = grid(spark, sf_dir).select("i", "j", "n", stairs.alias("h")).withColumn("f", F.col("h") + F.when(F.col("n") % 5 > 3, 11).otherwise(0))
    return hydro.lake_mask(g, "f", W, flat=2, least=3).select("i", "j", "lake")


@query(f"""WITH {G}, {STEPS}, drops AS (SELECT a.i * {W} + a.j AS c, s.k, b.i * {W} + b.j AS r, pow((a.h - b.h) / sqrt(CAST(s.di * s.di + s.dj * s.dj AS DOUBLE)), 1.5) AS w
  FROM g a, steps s, g b WHERE b.i = a.i + s.di AND b.j = (a.j + s.dj + {W}) % {W} AND a.h > b.h AND a.h > 0),
cells AS (SELECT i * {W} + j AS c FROM g), {hash_sql("cells", "hashed", "c", "9")},
cum AS (SELECT d.*, h.u, sum(w) OVER (PARTITION BY d.c ORDER BY k) AS upto, sum(w) OVER (PARTITION BY d.c) AS total FROM drops d JOIN hashed h ON h.c = d.c),
pick AS (SELECT c, coalesce(arg_min(r, k) FILTER (u * total < upto), arg_max(r, k)) AS r FROM cum GROUP BY c)
SELECT CAST(cells.c AS BIGINT) AS c, CAST(coalesce(pick.r, cells.c) AS BIGINT) AS rec FROM cells LEFT JOIN pick ON pick.c = cells.c""")
def q79_stochastic_receivers(spark, sf_dir):
    return hydro.stochastic_receivers(grid(spark, sf_dir), "h", W, 9, 1.5)


@query(f"""WITH {G}, c AS (SELECT i, j, i * {W} + j AS c FROM g), {hash_sql("c", "a", "c", "1")}, {hash_sql("c", "b", "c", "2")},
s AS (SELECT a.i, a.j, sqrt(-2 * ln(1 - a.u)) * cos(2 * pi() * b.u) AS v FROM a JOIN b ON a.c = b.c), {gaussian_sql("s", "o", 1.5, W, H)}
SELECT i, j, round(exp(v * (0.4::DOUBLE / (SELECT stddev_pop(v) FROM o))), 6) + 0.0 AS rock FROM o""")
def q80_resistance(spark, sf_dir):
    return planets.resistance(grid(spark, sf_dir).select("i", "j"), W, 0.4, 1.5).select("i", "j", r6(F.col("rock")).alias("rock"))


# --- gradient noise and planets ------------------------------------------------------------------------------------


def perlin_sql(source: str, out: str, seed: int, keys: str) -> str:
    """CTEs: ``source(keys, px, py, pz)`` with the gradient noise ``value`` of a seed."""
    order = [int(v) for v in np.random.default_rng(seed).permutation(256)]
    table = f"{[*order, *order]}::INTEGER[]"
    directions = [f"({[g[k] for g in noise.GRADIENTS]}::DOUBLE[])" for k in range(3)]
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    inside = ", ".join(f"p{n} - floor(p{n}) AS t{n}, ((floor(p{n})::BIGINT % 256) + 256) % 256 AS c{n}" for n in "xyz")
    index = "p[p[p[cx + a + 1] + cy + b + 1] + cz + c + 1] % 12 + 1"
    weight = " * ".join(f"(CASE {bit} WHEN 1 THEN {fade('t' + n)} ELSE 1 - {fade('t' + n)} END)" for bit, n in zip("abc", "xyz", strict=True))
    slope = " + ".join(f"{d}[{index}] * (t{n} - {bit})" for d, n, bit in zip(directions, "xyz", "abc", strict=True))
    return f"""{out} AS MATERIALIZED (SELECT {keys}, sum({weight} * ({slope})) AS value FROM (SELECT {keys}, {inside} FROM {source}), (SELECT {table} AS p), range(2) ta(a), range(2) tb(b), range(2) tc(c) GROUP BY {keys})"""


def fbm_sql(source: str, out: str, seed: int, frequency: float, octaves: int, gain: float = 0.5) -> str:
    """CTEs: ``source(k, x, y, z)`` with the octave sum ``value``."""
    rows = ", ".join(f"({o}, {frequency * 2.0**o!r}::DOUBLE, {gain**o!r}::DOUBLE)" for o in range(octaves))
    return f"""{out}_o(octave, freq, amp) AS (VALUES {rows}), {out}_p AS (SELECT k, octave, x * freq AS px, y * freq AS py, z * freq AS pz FROM {source}, {out}_o),
{perlin_sql(f"{out}_p", f"{out}_v", seed, "k, octave")}, {out} AS MATERIALIZED (SELECT k, sum(value * amp) / (SELECT sum(amp) FROM {out}_o) AS value FROM {out}_v JOIN {out}_o USING (octave) GROUP BY k)"""


def ridged_sql(source: str, out: str, seed: int, frequency: float, octaves: int) -> str:
    """CTEs: ``source(k, x, y, z)`` with the ridged sum ``value``: an octave's weight comes from the one before."""
    rows = ", ".join(f"({o}, {frequency * 2.0**o!r}::DOUBLE)" for o in range(octaves))
    parts = [f"{out}_o(octave, freq) AS (VALUES {rows})", f"{out}_p AS (SELECT k, octave, x * freq AS px, y * freq AS py, z * freq AS pz FROM {source}, {out}_o)", perlin_sql(f"{out}_p", f"{out}_v", seed, "k, octave")]
    parts.append(f"{out}_0 AS (SELECT k, pow(1 - abs(value), 2) AS r, pow(1 - abs(value), 2) AS total FROM {out}_v WHERE octave = 0)")
    for o in range(1, octaves):
        parts.append(f"{out}_{o} AS (SELECT k, pow(1 - abs(value), 2) * greatest(0, least(1, p.r * 2)) AS r, p.total + pow(1 - abs(value), 2) * greatest(0, least(1, p.r * 2)) * {0.5**o!r}::DOUBLE AS total FROM {out}_{o - 1} p JOIN {out}_v v USING (k) WHERE v.octave = {o})")
    parts.append(f"{out} AS MATERIALIZED (SELECT k, total / {sum(0.5**o for o in range(octaves))!r}::DOUBLE AS value FROM {out}_{octaves - 1})")
    return ", ".join(parts)


def warp_sql(source: str, out: str, seed: int, frequency: float, strength: float) -> str:
    """CTEs: ``source(k, x, y, z)`` moved by three noise samples."""
    return f"""{out}_p AS (SELECT k, m, x * {frequency!r}::DOUBLE + m * 17.3::DOUBLE AS px, y * {frequency!r}::DOUBLE + m * 17.3::DOUBLE AS py, z * {frequency!r}::DOUBLE + m * 17.3::DOUBLE AS pz FROM {source}, range(3) t(m)),
{perlin_sql(f"{out}_p", f"{out}_v", seed, "k, m")}, {out} AS MATERIALIZED (SELECT s.k, any_value(s.x) + {strength!r}::DOUBLE * sum(value) FILTER (m = 0) AS x, any_value(s.y) + {strength!r}::DOUBLE * sum(value) FILTER (m = 1) AS y, any_value(s.z) + {strength!r}::DOUBLE * sum(value) FILTER (m = 2) AS z FROM {source} s JOIN {out}_v v ON v.k = s.k GROUP BY s.k)"""


_PTS = f"WITH {E}, {DIR}, pts AS (SELECT event_id AS k, x, y, z FROM d)"


def some(spark, sf_dir) -> DataFrame:
    return on_faces(spark, sf_dir).select("event_id", *"xyz")


@query(f"{_PTS}, {fbm_sql('pts', 'a', 3, 5.0, 1)}, {fbm_sql('pts', 'b', 4, 2.0, 3, 0.55)}, {ridged_sql('pts', 'c', 5, 3.0, 3)}, {warp_sql('pts', 'w', 6, 0.8, 0.35)} SELECT k AS event_id, round(a.value, 6) + 0.0 AS one, round(b.value, 6) + 0.0 AS many, round(c.value, 6) + 0.0 AS ridge, round(w.x, 6) + 0.0 AS wx, round(w.y, 6) + 0.0 AS wy, round(w.z, 6) + 0.0 AS wz FROM a JOIN b USING (k) JOIN c USING (k) JOIN w USING (k)")
def q81_gradient_noise(spark, sf_dir):
    one, many, ridge, moves = (noise.Perlin(seed) for seed in (3, 4, 5, 6))

    def fields(p):
        return [one(noise.scaled(p, 5.0)), noise.fbm(many, p, 2.0, 3, gain=0.55), noise.ridged(ridge, p, 3.0, 3), *noise.domain_warp(moves, p, 0.8, 0.35)]

    names = ["one", "many", "ridge", "wx", "wy", "wz"]
    return noise.with_noise(some(spark, sf_dir), tuple("xyz"), names, fields).select("event_id", *[r6(F.col(n)).alias(n) for n in names])


PLANET = planets.PlanetParams(seed=2)
LEVEL = 0.04


def _seed(name: str) -> int:
    """The planet's seed and so many more: continents, warp, mountains, belts, detail, rain, basins."""
    return PLANET.seed + ("continent", "warp", "mountain", "belt", "detail", "rain", "basin").index(name)


def _clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def height_sql(source: str) -> str:
    """CTEs of a planet's ``heights(k, h)`` at ``source(k, x, y, z)``: lowland of 1000 m, mountains of 6000 m, shelves at -150 m, the deep at -4200 m."""
    return f"""{warp_sql(source, "pw", _seed("warp"), 0.8, 0.35)}, {fbm_sql("pw", "pc", _seed("continent"), 1.2, 5, 0.55)}, {warp_sql(source, "pb", _seed("warp"), 0.6, 0.3)}, {fbm_sql("pb", "basin", _seed("basin"), 0.9, 3)},
{fbm_sql(source, "belt", _seed("belt"), 1.6, 3)}, {ridged_sql(source, "ridge", _seed("mountain"), 5.0, 6)}, {fbm_sql(source, "fine", _seed("detail"), 6.0, 5)}, {fbm_sql(source, "floor_", _seed("detail"), 3.0, 4)},
relief_ AS (SELECT k, pc.value - {LEVEL}::DOUBLE AS c, 0.5 + 0.5 * basin.value AS basin, {_clip("(belt.value + 0.02) / 0.3")} * {_clip(f"(pc.value - {LEVEL}::DOUBLE) / 0.08")} AS belt, ridge.value AS ridge, fine.value AS fine, floor_.value AS sea FROM pc JOIN basin USING (k) JOIN belt USING (k) JOIN ridge USING (k) JOIN fine USING (k) JOIN floor_ USING (k)),
heights AS MATERIALIZED (SELECT k, CASE WHEN c > 0 THEN 1000::DOUBLE * (0.1 + 0.9 * {_clip("c / 0.2")}) * (0.25 + 0.75 * basin) * (0.5 + 0.5 * fine) + 6000 * belt * pow(ridge, 1.3)
  ELSE -150 + (-4200 + 150) * pow({_clip("-c / 0.12")}, 0.7) + 300 * sea * {_clip("-c / 0.12")} END AS h FROM relief_)"""


def climate_sql(source: str, height: str, cont: str) -> str:
    """CTEs of ``climates(k, tavg, trange, prec)`` from ``source(k, z, height, cont)``: 28 degrees at the equator, -18 at the poles, 6.5 less a kilometre."""
    bump = lambda centre, width: f"exp(-pow((a - {centre}) / {width}, 2))"
    return f"""{fbm_sql(source, "rain", _seed("rain"), 3.0, 4)}, zones AS (SELECT s.k, abs(degrees(asin(greatest(-1.0, least(1.0, s.z))))) / 90 AS a, {height} AS h, {cont} AS c, rain.value AS r FROM {source} s JOIN rain ON rain.k = s.k),
climates AS (SELECT k, -18 + (28 + 18) * pow(cos(a * pi() / 2), 1.3) - 6.5::DOUBLE * greatest(h, 0) / 1000 AS tavg, 3 + 45 * c * pow(a, 0.8) AS trange,
  greatest(0, 3200 * greatest({bump(0.0, 0.14)} + 0.6 * {bump(0.55, 0.16)} + 0.18 - 0.22 * {bump(0.27, 0.08)}, 0.02) * (1 - 0.6 * c) * exp(1.1 * r)) AS prec FROM zones)"""


def planet(spark) -> planets.Planet:
    return planets.Planet(spark, PLANET, threshold=LEVEL)


@query(f"{_PTS}, {height_sql('pts')}, src AS (SELECT pts.*, h, 0.25::DOUBLE AS cont FROM pts JOIN heights USING (k)), {climate_sql('src', 'h', 'cont')} SELECT k AS event_id, round(h, 3) + 0.0 AS h, round(tavg, 4) + 0.0 AS tavg, round(trange, 4) + 0.0 AS trange, round(prec, 3) + 0.0 AS prec FROM heights JOIN climates USING (k)")
def q82_planet_points(spark, sf_dir):
    made = planet(spark)
    d = tables.settled(made.height(some(spark, sf_dir))).withColumn("cont", F.lit(0.25))
    return made.climate(d).select("event_id", (F.round("h", 3) + 0.0).alias("h"), r4(F.col("tavg")).alias("tavg"), r4(F.col("trange")).alias("trange"), (F.round("prec", 3) + 0.0).alias("prec"))


@query(f"""{_PTS}, {warp_sql("pts", "pw", _seed("warp"), 0.8, 0.35)}, {fbm_sql("pw", "pc", _seed("continent"), 1.2, 5, 0.55)}
SELECT round(quantile_cont(value, 0.7), 6) + 0.0 AS level FROM pc""")
def q94_sea_level(spark, sf_dir):
    return planet(spark).sea_level(some(spark, sf_dir)).select(r6(F.col("level")).alias("level"))


_EQ = f"{G}, eq AS (SELECT i * {W} + j AS k, i, j, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM (SELECT i, j, 90 - (i + 0.5::DOUBLE) * 180 / {H} AS lat, (j + 0.5::DOUBLE) * 360 / {W} - 180 AS lon FROM g))"


def _inland(source: str, radius: int, height: int, width: int, keys: str = "") -> str:
    """CTE ``inland(k, cont)`` of ``source(k, i, j, h)``."""
    same = f"b.{keys} = a.{keys} AND " if keys else ""
    return f"""inland AS (SELECT a.k, CASE WHEN any_value(a.h) > 0 THEN {_clip("(avg(CASE WHEN b.h > 0 THEN 1.0::DOUBLE ELSE 0 END) - 0.5) / 0.5")} ELSE 0 END AS cont FROM {source} a, range({-radius}, {radius + 1}) p(di), range({-radius}, {radius + 1}) q(dj), {source} b
  WHERE {same}b.i = greatest(0, least({height - 1}, a.i + di)) AND b.j = greatest(0, least({width - 1}, a.j + dj)) GROUP BY a.k)"""


@query(f"WITH {_EQ}, {height_sql('eq')}, lifted AS (SELECT eq.*, h FROM eq JOIN heights USING (k)), {_inland('lifted', 4, H, W)}, src AS (SELECT lifted.*, cont FROM lifted JOIN inland USING (k)), {climate_sql('src', 'h', 'cont')} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(h, 3) + 0.0 AS h, round(tavg, 4) + 0.0 AS tavg, round(trange, 4) + 0.0 AS trange, round(prec, 3) + 0.0 AS prec FROM src JOIN climates USING (k)")
def q83_planet_equirect(spark, sf_dir):
    made = planet(spark)
    cells = geometry.equirect_grid(spark, H, W).join(grid(spark, sf_dir).select("i", "j"), ["i", "j"])
    out = planets.climate_equirect(made, tables.settled(made.height(cells)), H, W)
    return out.select("i", "j", (F.round("h", 3) + 0.0).alias("h"), r4(F.col("tavg")).alias("tavg"), r4(F.col("trange")).alias("trange"), (F.round("prec", 3) + 0.0).alias("prec"))


@query(f"WITH {E}, {DIR}, {FACE}, {_BUSY}, a AS (SELECT *, (face * 12 + i) * 12 + j AS k FROM {pixels(12)} WHERE face IN (SELECT face FROM busy)), {directed('a', 'fd')}, {height_sql('fd')}, lifted AS (SELECT fd.*, h FROM fd JOIN heights USING (k)), {_inland('lifted', 4, 12, 12, 'face')}, src AS (SELECT lifted.*, cont FROM lifted JOIN inland USING (k)), {climate_sql('src', 'h', 'cont')} SELECT face, i, j, round(degrees(asin(z)), 6) + 0.0 AS lat, round(h, 3) + 0.0 AS height, round(tavg, 4) + 0.0 AS tavg, round(trange, 4) + 0.0 AS trange, round(prec, 3) + 0.0 AS prec FROM src JOIN climates USING (k)")
def q84_planet_face(spark, sf_dir):
    pixels_ = geometry.face_pixels(spark, 12).join(busy(spark, sf_dir).select("face"), "face")
    return planet(spark).face_layers(pixels_, 12).select("face", "i", "j", r6(F.col("lat")).alias("lat"), (F.round("height", 3) + 0.0).alias("height"), r4(F.col("tavg")).alias("tavg"), r4(F.col("trange")).alias("trange"), (F.round("prec", 3) + 0.0).alias("prec"))


# --- detail and points under the camera ----------------------------------------------------------------------------


def detail_sql(source: str, out: str, key: str, radius: float, coarse: float, fine: str, roughness: float, seed: int, octaves: int) -> str:
    """CTEs: ``source(key, x, y, z, ...)`` with the octaves' sum ``detail``."""
    parts, sums = [], []
    for o in range(octaves):
        wave = coarse / 2**o
        lattice = _LAT.replace(str((5 * noise.KEY_SEED) % 2**64), str(((seed + o) * noise.KEY_SEED) % 2**64))
        parts.append(f"""{out}_p{o} AS (SELECT {key}, x * {radius / wave!r}::DOUBLE AS px, y * {radius / wave!r}::DOUBLE AS py, z * {radius / wave!r}::DOUBLE AS pz FROM {source}),
{out}_k{o} AS (SELECT {key}, {" * ".join(_W.format(k=k, s=_S.format(ax)) for k, ax in zip("abc", "xyz", strict=True))} AS w, {lattice} AS h FROM {out}_p{o}, range(2) ta(a), range(2) tb(b), range(2) tc(c)),
{out}_l{o} AS (SELECT {key}, w, ({_mul("xor(h, h >> 31)", noise.LAST)})::UBIGINT AS h FROM {out}_k{o}),
{out}_{o} AS (SELECT {key}, sum(w * (CAST(xor(h, h >> 27) >> 11 AS DOUBLE) / 9007199254740992 * 2 - 1)) * {wave * roughness!r}::DOUBLE AS v FROM {out}_l{o} GROUP BY {key})""")
        sums.append(f"(CASE WHEN {fine} < {wave!r}::DOUBLE THEN (SELECT v FROM {out}_{o} q WHERE q.{key} = s.{key}) ELSE 0 END)")
    parts.append(f"{out} AS (SELECT s.*, {' + '.join(sums)} AS detail FROM {source} s)")
    return ", ".join(parts)


@query(f"{_PTS}, {detail_sql('pts', 'det', 'k', 6_371_000.0, 400_000.0, '100000', 0.02, 7, 2)} SELECT k AS event_id, round(detail, 4) + 0.0 AS detail, round(CASE WHEN z * 30 > 0 THEN greatest(0.5, z * 30 + detail * greatest(0, least(1, z * 30 / 20))) ELSE 0 END, 4) + 0.0 AS h FROM det")
def q85_detail_height(spark, sf_dir):
    d = noise.detail_height(some(spark, sf_dir), tuple(F.col(c) for c in "xyz"), 6_371_000.0, 400_000.0, 100_000.0, 0.02, 7)
    return d.select("event_id", r4(F.col("detail")).alias("detail"), r4(noise.surface_height(F.col("z") * 30, F.col("detail"))).alias("h"))


_DATA = math.pi / 2 * 6_371_000.0 / N


@query(f"""{_PTS}, far AS (SELECT k, x AS x, y, z, 6371000 + 5000.0::DOUBLE + k AS dist FROM pts), {cross_face("far", "k", N)}, src AS (SELECT far.*, h FROM far JOIN sampled USING (k)), {detail_sql("src", "det", "k", 6_371_000.0, _DATA, "300000", 1e-5, 3, 2)},
g AS (SELECT *, CASE WHEN h > 0 THEN greatest(0.5, h + detail * greatest(0, least(1, h / 20))) ELSE 0 END AS ground FROM det)
SELECT k AS camera, round(degrees(asin(greatest(-1.0, least(1.0, z)))), 6) + 0.0 AS lat, round(CASE WHEN degrees(atan2(y, x)) >= 180 THEN degrees(atan2(y, x)) - 360 ELSE degrees(atan2(y, x)) END, 6) + 0.0 AS lon, round(ground, 4) + 0.0 AS ground, round(dist - 6371000 - ground, 3) + 0.0 AS altitude FROM g""")
def q86_under_cameras(spark, sf_dir):
    far = 6_371_000 + 5000.0 + F.col("event_id")
    cameras = some(spark, sf_dir).select(F.col("event_id").alias("camera"), *[(F.col(c) * far).alias(c) for c in "xyz"])
    out = quadtree.under_cameras(cameras, cube_values(spark, sf_dir, N), "h", N, 6_371_000.0, 300_000.0, 1e-5, 3)
    return out.select("camera", *[r6(F.col(c)).alias(c) for c in ("lat", "lon")], r4(F.col("ground")).alias("ground"), (F.round("altitude", 3) + 0.0).alias("altitude"))


_ORIGINS = f"""{E}, {DIR}, {placed("d", "on_")}, spots AS (SELECT DISTINCT CAST(o AS INTEGER) AS face, level, CAST(least(pow(2, level) - 1, floor((ou + 1) / 2 * pow(2, level))) AS BIGINT) AS x, CAST(least(pow(2, level) - 1, floor((1 - ov) / 2 * pow(2, level))) AS BIGINT) AS y FROM on_, (SELECT unnest([1, 2])::INTEGER AS level)),
nodes AS (SELECT face, level, x AS nx, y AS ny, (nx + 0.5::DOUBLE) * 2 / pow(2, level) - 1 AS u, 1 - (ny + 0.5::DOUBLE) * 2 / pow(2, level) AS v, pi() / 2 * 6371000 / pow(2, level) / 4 AS cell, (face * 3 + level) * 100 + x * 8 + y AS k FROM spots)"""


def event_nodes(spark, sf_dir) -> DataFrame:
    """The quadtree nodes of two levels that events lie in."""
    side = F.pow(F.lit(2.0), F.col("level"))
    at = lambda t: F.least(side - 1, F.floor(t / 2 * side)).cast("long")
    events = on_faces(spark, sf_dir).select("face", "u", "v", F.explode(F.array(F.lit(1), F.lit(2))).alias("level"))
    return events.select("face", "level", at(F.col("u") + 1).alias("x"), at(1 - F.col("v")).alias("y")).distinct()


@query(f"""WITH {_ORIGINS}, {directed("nodes", "nd")}, {cross_face("nd", "k", N)}, src AS (SELECT nd.*, h FROM nd JOIN sampled USING (k)), {detail_sql("src", "det", "k", 6_371_000.0, _DATA, "s.cell", 1e-5, 0, 2)},
g AS (SELECT *, CASE WHEN h > 0 THEN greatest(0.5, h + detail * greatest(0, least(1, h / 20))) ELSE 0 END AS ground FROM det)
SELECT face, level, nx AS x, ny AS y, {", ".join(f"round({c} * (6371000 + ground), 2) + 0.0 AS o{c}" for c in "xyz")} FROM g""")
def q87_patch_origins(spark, sf_dir):
    out = quadtree.patch_origins(event_nodes(spark, sf_dir), cube_values(spark, sf_dir, N), "h", N, 6_371_000.0, 4, 1e-5)
    return out.select("face", "level", "x", "y", *[(F.round(f"o{c}", 2) + 0.0).alias(f"o{c}") for c in "xyz"])


# --- baking --------------------------------------------------------------------------------------------------------


def water_sql(base: str, out: str, h: int, w: int) -> str:
    """CTEs (recursive): ``base(i, j, h)`` filled, routed and summed, as ``out(i, j, h, water, ocean, flowacc)``."""
    text = f"""{_FILL}, {_ROUTE}, flat AS (SELECT a.i, a.j, max(b.h) - min(b.h) < 0.05 AND any_value(a.h) > 0 AS flat FROM base a JOIN base b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j),
OUT_ AS MATERIALIZED (SELECT i, j, h, h <= 0 OR f - h > 10 OR (SELECT count(*) FROM flat WHERE flat) >= 40 AS water, h <= 0 AS ocean, log10(1 + acc) AS flowacc FROM filled JOIN acc ON acc.c = i * {W} + j)"""
    text = text.replace(f"(0, {H - 1})", f"(0, {h - 1})").replace(f"/ {H})", f"/ {h})").replace(f"/ {W})", f"/ {w})").replace(f"% {W}", f"% {w}").replace(f"+ {W})", f"+ {w})").replace(f"* {W} +", f"* {w} +")
    for name in ("filled", "drops", "best"):
        text = re.sub(rf"\b{name}\b", f"{out}_{name}", text)
    text = text.replace("rec AS (", f"{out}_rec AS (").replace("FROM rec ", f"FROM {out}_rec ").replace("JOIN rec ", f"JOIN {out}_rec ").replace("acc AS (", f"{out}_acc AS (").replace("JOIN acc ON", f"JOIN {out}_acc acc ON")
    text = text.replace("flat AS (SELECT", f"{out}_flat AS (SELECT").replace("FROM flat WHERE", f"FROM {out}_flat WHERE").replace("p(src, pos, a) AS", f"{out}_p(src, pos, a) AS").replace("FROM p JOIN", f"FROM {out}_p p JOIN").replace("FROM p GROUP", f"FROM {out}_p GROUP")
    text = text.replace("f(t, i, j, h, f) AS", f"{out}_f(t, i, j, h, f) AS").replace("FROM f b,", f"FROM {out}_f b,").replace("FROM f a WHERE", f"FROM {out}_f a WHERE").replace("FROM f WHERE t", f"FROM {out}_f WHERE t")
    return text.replace("FROM base", f"FROM {base}").replace("JOIN base", f"JOIN {base}").replace("OUT_", out)


def sampled_sql(source: str, out: str, n: int, pad: int, h: int, w: int, smooth: str, plain: str) -> str:
    """CTEs: ``out(face, i, j, lat, lon, ...)``: pixels of faces with the bilinear ``smooth`` and the nearest ``plain`` columns of ``source(i, j, ...)``."""
    names = smooth.split(", ")
    mix = ", ".join(f"sum(w * {c}) AS {c}" for c in names)
    kept = ", ".join(f"g.{c}" for c in plain.split(", "))
    y, x = f"((90 - lat) / 180 * {h} - 0.5)", f"((lon + 180) / 360 * {w} - 0.5)"
    return f"""{directed(pixels(n, pad), f"{out}_d")}, {out}_l AS (SELECT face, i, j, degrees(asin(z)) AS lat, CASE WHEN degrees(atan2(y, x)) >= 180 THEN degrees(atan2(y, x)) - 360 ELSE degrees(atan2(y, x)) END AS lon FROM {out}_d),
{out}_c AS (SELECT face, i AS pi_, j AS pj, CAST(floor({y}) AS INTEGER) + a AS ci, CAST(floor({x}) AS INTEGER) + b AS cj, (CASE a WHEN 0 THEN 1 - ({y} - floor({y})) ELSE {y} - floor({y}) END) * (CASE b WHEN 0 THEN 1 - ({x} - floor({x})) ELSE {x} - floor({x}) END) AS w FROM {out}_l, range(2) ta(a), range(2) tb(b)),
{out}_s AS (SELECT face, pi_, pj, {mix} FROM {out}_c JOIN {source} g ON g.i = greatest(0, least({h - 1}, ci)) AND g.j = (cj + {w}) % {w} GROUP BY face, pi_, pj),
{out} AS MATERIALIZED (SELECT l.face, l.i, l.j, lat, lon, {", ".join(f"s.{c}" for c in names)}, {kept} FROM {out}_l l JOIN {out}_s s ON s.face = l.face AND s.pi_ = l.i AND s.pj = l.j
  JOIN {source} g ON g.i = greatest(0, least({h - 1}, CAST(round_even({y}, 0) AS INTEGER))) AND g.j = (CAST(round_even({x}, 0) AS INTEGER) + {w}) % {w})"""


def shores_sql(source: str, out: str, n: int, km: float) -> str:
    """CTE: ``out(face, i, j, dist_...)``: log1p of the kilometres to ``source(face, i, j, ocean)`` along the axes, of the ``n`` x ``n`` pixels from 0."""
    sides = (("up", "min(c.i - o.i)", "o.j = c.j AND o.i <= c.i"), ("down", "min(o.i - c.i)", "o.j = c.j AND o.i >= c.i"), ("left", "min(c.j - o.j)", "o.i = c.i AND o.j <= c.j"), ("right", "min(o.j - c.j)", "o.i = c.i AND o.j >= c.j"))
    each = ", ".join(f"ln(1 + least(2500.0::DOUBLE, coalesce((SELECT {agg} FROM {source} o WHERE o.ocean AND o.face = c.face AND {where}) * {km!r}::DOUBLE, 2500))) AS dist_{d}" for d, agg, where in sides)
    return f"{out} AS (SELECT face, i, j, {each} FROM {source} c WHERE i BETWEEN 0 AND {n - 1} AND j BETWEEN 0 AND {n - 1})"


_KM = geometry.px_km(BN)
_SEEN = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("lat", "height", "flowacc", "dist_up", "dist_down", "dist_left", "dist_right"))


@query(f"""WITH RECURSIVE {G}, {STEPS}, {_BASE}, {water_sql("base", "wet", H, W)}, fine_g AS (SELECT wet.*, wet.h AS height, CAST({_BYTES.replace("h", "g.h")} AS DOUBLE) AS b FROM wet JOIN g USING (i, j)),
{sampled_sql("fine_g", "fine", BN, 0, H, W, "height, flowacc, b", "water")}, {sampled_sql("fine_g", "sea", BN, 3, H, W, "height", "ocean")}, {shores_sql("sea", "shore", BN, _KM)},
half AS (SELECT i // 2 AS i, j // 2 AS j, avg(h) AS h FROM base GROUP BY ALL), {water_sql("half", "dim", H // 2, W // 2)}, ctx_g AS (SELECT *, h AS height FROM dim),
{sampled_sql("ctx_g", "ctx_", BN // 2, 2, H // 2, W // 2, "height, flowacc", "water, ocean")}, ctx AS (SELECT * REPLACE (i + 2 AS i, j + 2 AS j) FROM ctx_), {shores_sql("ctx", "rim", BN // 2 + 4, _KM * 2)}
SELECT 'fine' AS part, face, i, j, {_SEEN}, water, CAST(greatest(0, least(255, round_even(b, 0))) AS INTEGER) AS rgb, {" OR ".join(f"(lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d})" for a, b, c, d in BOXES)} AS holdout FROM fine JOIN shore USING (face, i, j)
UNION ALL SELECT 'context', face, i, j, {_SEEN}, water, NULL, NULL FROM ctx JOIN rim USING (face, i, j)""")
def q88_bake(spark, sf_dir):
    g = grid(spark, sf_dir).select("i", "j", (F.col("h") / 20.0).alias("h"), (F.abs("h") % 300).alias("rgb"))
    fine, context = bake.bake(g, H, W, BN, ["rgb"], BOXES, bytes_={"rgb"}, factor=2, pad=4, distance_pad=3)
    seen = ["lat", "height", "flowacc", *[f"dist_{d}" for d in ("up", "down", "left", "right")]]
    context = context.withColumns({"rgb": F.lit(None).cast("int"), "holdout": F.lit(None).cast("boolean")})
    parts = [df.select(F.lit(part).alias("part"), "face", "i", "j", *[r4(F.col(c)).alias(c) for c in seen], "water", F.col("rgb").cast("int").alias("rgb"), "holdout") for part, df in (("fine", fine), ("context", context))]
    return parts[0].unionByName(parts[1])
