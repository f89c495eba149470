from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spheregrid.functions import features, geometry, noise
from spheregrid.operators import bake, hydro, planets, predicates, quadtree, resample, windows
from spheregrid.plans import globe
from spheregrid.sources import registry, tables
from spheregrid.streaming.frames import maintain_patches, resumed

# Published directions (x, y, z) with face, u, v, lat, lon, and pixels of 8 x 8 faces (face, i, j) with u, v, lat, lon.
DIRECTIONS = [
    (0.23116513807972336, -0.7889550192379909, 0.5693089289267855, 3, 0.3629038358699472, 0.7958703996848917, 34.702049314465405, -73.66932738585238),
    (-0.5878191837142573, 0.6059793441285014, 0.5359642168532294, 2, 0.9806328701750762, 0.9220324213696873, 32.409325879059416, 134.12847915787842),
    (-0.9763871298872112, -0.19429752603854575, 0.09442798296011085, 1, 0.25010292253701916, 0.12275529565008951, 5.41839764900553, -168.74536848583415),
    (0.48205100996247563, 0.5848420859477323, 0.6523699550856574, 4, 0.8102564166483929, 0.9305746112572856, 40.720525569012686, 50.50324341442012),
    (0.6897564427203866, 0.7201462358200774, -0.07500299167294275, 2, -0.9725601658286395, -0.1321311017493428, -4.3013941990577464, 46.23479253771123),
]
PIXELS = [(0, 3, 5, 0.375, 0.125, 5.384244539546475, 16.875), (5, 7, 0, -0.875, -0.875, -40.7485853505117, -135.0), (5, 3, 5, 0.375, 0.125, -72.31067846129892, 72.01228596100012)]


def table(spark, array, name="h"):
    array = np.asarray(array)
    kind = "long" if array.dtype.kind == "i" else "boolean" if array.dtype.kind == "b" else "double"
    rows = [(i, j, array[i, j].item()) for i in range(array.shape[0]) for j in range(array.shape[1])]
    return spark.createDataFrame(rows, f"i int, j int, {name} {kind}")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("i", "j", name).collect():
        out[r["i"], r["j"]] = r[name]
    return out


def test_directions_round_trip(spark):
    rng = np.random.default_rng(0)
    d = rng.standard_normal((500, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    df = spark.createDataFrame([tuple(map(float, r)) for r in d], "x double, y double, z double")
    v = [F.col(c) for c in "xyz"]
    df = df.withColumn("face", geometry.dir_to_face(v))
    u, w = geometry.dir_to_uv(v, F.col("face"))
    df = df.withColumn("u", u).withColumn("v", w)
    back = geometry.face_uv_to_dir(F.col("face"), F.col("u"), F.col("v"))
    lat, lon = geometry.dir_to_latlon(v)
    again = geometry.latlon_to_dir(lat, lon)
    for r in df.select("x", "y", "z", "u", "v", F.array(*back).alias("b"), F.array(*again).alias("a")).collect():
        assert max(abs(r["u"]), abs(r["v"])) <= 1 + 1e-12
        assert np.allclose([r["x"], r["y"], r["z"]], r["b"], atol=1e-12) and np.allclose(r["b"], r["a"], atol=1e-12)


def test_published_vectors(spark):
    df = spark.createDataFrame([(k, *p[:3]) for k, p in enumerate(DIRECTIONS)], "k int, x double, y double, z double")
    v = [F.col(c) for c in "xyz"]
    face = geometry.dir_to_face(v)
    u, w = geometry.dir_to_uv(v, face)
    lat, lon = geometry.dir_to_latlon(v)
    for r in df.select("k", face.alias("face"), u.alias("u"), w.alias("v"), lat.alias("lat"), lon.alias("lon")).collect():
        want = DIRECTIONS[r["k"]][3:]
        assert r["face"] == want[0] and np.allclose([r["u"], r["v"], r["lat"], r["lon"]], want[1:], atol=1e-9)
    grid = {(r["face"], r["i"], r["j"]): [r[c] for c in ("u", "v", "lat", "lon")] for r in geometry.face_pixel_latlon(spark, 8).collect()}
    assert all(np.allclose(grid[p[:3]], p[3:], atol=1e-9) for p in PIXELS)


def test_faces_and_pixels(spark):
    f = geometry.faces(spark).collect()
    for r in f:  # right-handed axes
        n, tu, tv = ([r[f"{a}{b}"] for b in "xyz"] for a in ("n", "tu", "tv"))
        assert np.allclose(np.cross(tu, tv), n)
    grid = geometry.face_pixel_latlon(spark, 8)
    assert grid.count() == 384 and grid.agg(F.max(F.abs("lat"))).first()[0] < 90
    i, j = geometry.uv_to_pixel(8, F.col("u"), F.col("v"))
    assert geometry.face_pixels(spark, 8).where((i != F.col("i")) | (j != F.col("j"))).count() == 0
    across = {(r["face"], r["edge"]): r["neighbour"] for r in geometry.neighbour_faces(spark).collect()}
    assert len(across) == 24 and across[0, "top"] == 4 and across[0, "bottom"] == 5
    area = geometry.equirect_grid(spark, 90, 180).agg(F.sum(geometry.cell_area_km2(F.col("i"), 90, 180))).first()[0]
    assert abs(area / (4 * math.pi * 6371**2) - 1) < 1e-3


def test_position_hash_golden(spark):
    df = spark.createDataFrame([(i, j) for i in (100, 101) for j in (200, 201)], "i int, j int")
    got = [r[0] for r in df.orderBy("i", "j").select(noise.position_bits(F.lit(2), F.col("i"), F.col("j"))).collect()]
    assert got == [6941732166149073, 4355959355498899, 6414315851518464, 8543569339327428]


def test_wrapping_products(spark):
    xs = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in (noise.KEY_X, noise.LAST, 3, 0):
        got = {r["x"]: r["y"] for r in df.select("x", noise.times(F.col("x"), k).alias("y")).collect()}
        assert all(got[x] == noise._signed((x % 2**64) * k) for x in xs)


def scalar_noise(seed, p):
    """Gradient noise of one point, corner by corner."""
    order = [int(v) for v in np.random.default_rng(seed).permutation(256)]
    low = [math.floor(v) for v in p]
    total = 0.0
    for corner in itertools.product((0, 1), repeat=3):
        k = 0
        for f, bit in zip(low, corner):
            k = order[(k + f % 256 + bit) % 256]
        offset = [v - f - bit for v, f, bit in zip(p, low, corner)]
        weight = math.prod(1 - abs(t) ** 3 * (abs(t) * (abs(t) * 6 - 15) + 10) for t in offset)
        total += weight * sum(g * t for g, t in zip(noise.GRADIENTS[k % 12], offset))
    return total


def test_gradient_noise(spark):
    df = spark.range(400).select(F.when(F.col("id") != 7, F.col("id") * 0.173).alias("x"), (F.col("id") * 0.071).alias("y"), (F.col("id") * -0.05).alias("z"))
    one = noise.Perlin(3)
    got = noise.with_noise(df, ("x", "y", "z"), ["n"], lambda p: [one(p)]).collect()
    assert all(abs(r["n"] - scalar_noise(3, (r["x"], r["y"], r["z"]))) < 1e-12 for r in got if r["x"] is not None)
    assert [r["n"] for r in got if r["x"] is None] == [None]
    points = tuple(np.random.default_rng(1).normal(size=(3, 500)) * 3)
    assert np.allclose(noise.fbm(one, points, 1.2, 3, gain=0.55), sum(0.55**o * one(tuple(v * 1.2 * 2**o for v in points)) for o in range(3)) / (1 + 0.55 + 0.55**2))
    assert np.all(one(tuple(np.round(v) for v in points)) == 0)
    detail = noise.detail_height(df, tuple(F.col(c) for c in "xyz"), 10.0, 4.0, 1.0, 0.1, 1)
    a, b = (tables.settled(noise.value_noise(df.where("x is not null"), tuple(F.col(c) * by for c in "xyz"), seed, name)) for seed, by, name in ((1, 2.5, "a"), (2, 5.0, "b")))
    plain = a.join(b, ["x", "y", "z"]).withColumn("want", F.col("a") * 0.4 + F.col("b") * 0.2)
    both = detail.join(plain, ["x", "y", "z"])
    assert both.count() == 399 and both.where("abs(detail - want) > 1e-12").isEmpty()
    assert detail.where("x is not null").select(noise.surface_height(F.lit(5.0), F.col("detail")).alias("h")).where("h < 0.5").isEmpty()


def test_bilinear_wraps(spark):
    h, w = 30, 60
    lat = 90 - (np.arange(h) + 0.5) * 180 / h
    lon = (np.arange(w) + 0.5) * 360 / w - 180
    field = 3 * np.sin(np.radians(lat))[:, None] + 2 * np.cos(np.radians(lon))[None, :]
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate([(0, -179.99), (0, 179.99), (33.3, 12.1), (-70.2, 100.7), (89.9, 5.0)])], "k int, lat double, lon double")
    got = {r["k"]: r for r in resample.sample_equirect(points, "k", table(spark, field), ["h"], h, w).collect()}
    assert abs(got[0]["h"] - got[1]["h"]) < 1e-2
    for r in got.values():
        if abs(r["lat"]) < 85:
            assert abs(r["h"] - (3 * math.sin(math.radians(r["lat"])) + 2 * math.cos(math.radians(r["lon"])))) < 0.02


def test_mean_preserving(spark):
    coarse = np.random.default_rng(1).standard_normal((6, 7)) * 100
    fine = array(resample.mean_preserving_upsample(table(spark, coarse), 3, "h"), "h", (18, 21))
    assert np.allclose(fine.reshape(6, 3, 7, 3).mean(axis=(1, 3)), coarse, atol=1e-9)


def test_overlap_add_keeps_constants(spark):
    starts = resample.tile_starts(20, 8, 3)
    assert starts[-1] == 12
    rows = [(si, sj, a, b, 4.5) for si in starts for sj in starts for a in range(8) for b in range(8)]
    out = resample.overlap_add(spark.createDataFrame(rows, "si int, sj int, a int, b int, v double"), "v", 8)
    assert out.count() == 400 and all(abs(r["v"] - 4.5) < 1e-12 for r in out.collect())


def test_cross_face_sampling_and_blend(spark):
    n, pad = 16, 4
    cells = geometry.face_pixels(spark, n, pad)
    cells = cells.withColumn("d", F.array(*geometry.face_uv_to_dir(F.col("face"), F.col("u"), F.col("v"))))
    smooth = 1000 * F.sin(2 * F.col("d")[0]) * F.cos(3 * F.col("d")[1]) + 500 * F.col("d")[2]
    cells = cells.withColumn("h", smooth + 100 * F.col("face")).withColumn("s", smooth)
    inner = cells.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1))
    points = spark.createDataFrame([(k, *p) for k, p in enumerate([(0.7, 0.7, 0.1), (0.7, 0.71, 0.1), (0.1, 0.2, 0.97), (0.58, 0.58, 0.57)])], "k int, x double, y double, z double")
    for r in resample.sample_face(points, "k", inner, "s", n).collect():
        q = np.array([r["x"], r["y"], r["z"]]) / math.hypot(r["x"], r["y"], r["z"])
        assert abs(r["s"] - (1000 * math.sin(2 * q[0]) * math.cos(3 * q[1]) + 500 * q[2])) < 30
    blended = resample.blend_faces(cells.select("face", "i", "j", "h"), "h", n, pad).join(inner.select("face", "i", "j", F.col("h").alias("raw"), "s"), ["face", "i", "j"]).collect()
    assert len(blended) == 6 * n * n
    deep = [r for r in blended if pad <= r["i"] < n - pad and pad <= r["j"] < n - pad]
    assert all(r["h"] == r["raw"] for r in deep)
    top = [r for r in blended if r["face"] == 0 and r["i"] == 0 and pad <= r["j"] < n - pad]
    assert all(abs((r["h"] - r["s"]) - 200) < 110 for r in top)  # between its own 0 and its neighbour's 400


def test_valley_drains(spark):
    i, j = np.indices((24, 30))
    h = 100.0 - 2 * i + 0.1 * np.abs(j - 15)
    h[8:12, 10:14] = -30 + 40  # a pit
    h[21:] = -5
    grid = table(spark, h)
    filled = hydro.fill_depressions(grid, 24, 30, 1e-3)
    f = array(filled, "f", h.shape)
    assert (f >= h).all() and (f[9:11, 11:13] > h[9:11, 11:13]).all()
    forest = hydro.receivers(filled, "f", 30)
    rec = {r["c"]: r["rec"] for r in forest.collect()}
    assert all(rec[a * 30 + b] != a * 30 + b for a in range(1, 21) for b in range(30))
    acc = hydro.accumulate(forest.withColumn("one", F.lit(1).cast("long")), "one").collect()
    assert sum(r["acc"] for r in acc if r["rec"] == r["c"]) == h.size
    lakes = hydro.lake_mask(filled, "f", 30, depth=5.0)
    assert {(r["i"], r["j"]) for r in lakes.where("lake").collect()} >= {(9, 11), (10, 12)}
    picked = hydro.stochastic_receivers(filled, "f", 30, 3)
    down = picked.join(filled.select((F.col("i") * 30 + F.col("j")).cast("long").alias("c"), "f"), "c").join(filled.select((F.col("i") * 30 + F.col("j")).cast("long").alias("rec"), F.col("f").alias("g")), "rec")
    assert down.where("g > f or (g = f and rec <> c)").isEmpty()


def test_incision_matches_sequential(spark):
    rng = np.random.default_rng(2)
    n = 60
    h = np.sort(rng.uniform(0, 100, n))
    rec = [0] + [int(rng.integers(k)) for k in range(1, n)]
    factor = rng.uniform(0, 3, n)
    want = h.copy()
    for k in range(1, n):
        want[k] = (h[k] + factor[k] * max(0, want[rec[k]])) / (1 + factor[k])
    df = spark.createDataFrame([(k, rec[k], float(h[k]), float(factor[k])) for k in range(n)], "c long, rec long, h double, factor double")
    got = {r["c"]: r["h2"] for r in hydro.incise(df, "factor").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in range(n))


def test_gaussian_and_blur(spark):
    a = np.random.default_rng(3).standard_normal((9, 12))
    got = array(windows.gaussian(table(spark, a), "h", 1.2, 12, "g"), "g", a.shape)
    r = int(4 * 1.2 + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.2) ** 2)
    w /= w.sum()
    row = sum(w[k + r] * np.roll(a, -k, axis=1) for k in range(-r, r + 1))
    want = sum(w[k + r] * row[np.clip(np.arange(9) + k, 0, 8)] for k in range(-r, r + 1))
    assert np.allclose(got, want)
    land = windows.continentality(table(spark, np.pad(np.full((8, 8), 500.0), 4, constant_values=-1000.0)), "h", 2)
    cont = array(land, "cont", (16, 16))
    assert cont[8, 8] == 1 and cont[0, 0] == 0 and 0 < cont[5, 5] < 1


def test_augmentation_commutes(spark):
    water = np.random.default_rng(0).random((10, 10)) < 0.15
    names = {"dist_up": (0, -1), "dist_down": (0, 1), "dist_left": (1, -1), "dist_right": (1, 1)}

    def measured(df):
        for name, (axis, sign) in names.items():
            df = windows.directional_distance(df, "w", axis, sign, 1.0, 99, None, name)
        return df

    base = measured(table(spark, water, "w"))
    for k, flip in ((1, False), (3, True)):
        moved = features.augment(base, 10, k, flip)
        again = measured(moved.select("i", "j", "w"))
        assert moved.select("i", "j", *names).exceptAll(again.select("i", "j", *names)).isEmpty()


def scalar_planet(p, level, d):
    """Height, temperature and its range, rain of one direction at 0.25 of the way inland, by the formulas with their numbers."""
    at = lambda k, q, f: scalar_noise(p.seed + k, tuple(v * f for v in q))
    many = lambda k, q, f, n, gain=0.5: sum(gain**o * at(k, q, f * 2**o) for o in range(n)) / sum(gain**o for o in range(n))
    moved = lambda q, f, s: tuple(q[k] + s * scalar_noise(p.seed + 1, tuple(v * f + k * 17.3 for v in q)) for k in range(3))
    clip = lambda x: max(0.0, min(1.0, x))
    c = many(0, moved(d, 0.8, 0.35), 1.2, 5, 0.55) - level
    if c > 0:
        basin = 0.5 + 0.5 * many(6, moved(d, 0.6, 0.3), 0.9, 3)
        h = 1000 * (0.1 + 0.9 * clip(c / 0.2)) * (0.25 + 0.75 * basin) * (0.5 + 0.5 * many(4, d, 6.0, 5))
        total, weight = 0.0, 1.0
        for o in range(6):
            r = (1 - abs(at(2, d, 5.0 * 2**o))) ** 2 * weight
            total, weight = total + 0.5**o * r, clip(2 * r)
        h += 6000 * clip((many(3, d, 1.6, 3) + 0.02) / 0.3) * clip(c / 0.08) * (total / sum(0.5**o for o in range(6))) ** 1.3
    else:
        t = clip(-c / 0.12)
        h = -150 + (-4200 + 150) * t**0.7 + 300 * many(4, d, 3.0, 4) * t
    a = abs(math.degrees(math.asin(d[2]))) / 90
    zonal = math.exp(-((a / 0.14) ** 2)) + 0.6 * math.exp(-(((a - 0.55) / 0.16) ** 2)) + 0.18 - 0.22 * math.exp(-(((a - 0.27) / 0.08) ** 2))
    tavg = -18 + 46 * math.cos(a * math.pi / 2) ** 1.3 - 6.5 * max(h, 0) / 1000
    return h, tavg, 3 + 45 * 0.25 * a**0.8, 3200 * max(zonal, 0.02) * (1 - 0.6 * 0.25) * math.exp(1.1 * many(5, d, 3.0, 4))


def test_planet_by_the_formulas(spark):
    params = planets.PlanetParams(seed=4)
    planet = planets.Planet(spark, params, samples=3000)
    normals = np.random.default_rng(4).normal(size=(3000, 3)).astype(np.float32)
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    levels = noise.fbm(noise.Perlin(4), noise.domain_warp(noise.Perlin(5), tuple(normals.astype(float).T), 0.8, 0.35), 1.2, 5, gain=0.55)
    assert abs(planet.threshold - np.quantile(levels, 0.7)) < 1e-9
    grid = planet.equirect(8, 16).withColumn("cont", F.lit(0.25))
    rows = planet.climate(tables.settled(grid)).collect()
    assert len(rows) == 128 and {r["h"] > 0 for r in rows} == {True, False}
    for r in rows:
        want = scalar_planet(params, planet.threshold, (r["x"], r["y"], r["z"]))
        assert np.allclose((r["h"], r["tavg"], r["trange"], r["prec"]), want, rtol=1e-9, atol=1e-7)


def test_erosion_goes_on_where_it_stopped(spark, tmp_path):
    planet = planets.Planet(spark, planets.PlanetParams(seed=1), samples=4000)
    grid = tables.settled(planet.equirect(16, 32).select("i", "j", "h"))
    climate = planets.climate_equirect(planet, tables.settled(planet.equirect(16, 32)), 16, 32).agg(F.min("prec"), F.max("tavg"), F.min("trange")).first()
    assert climate[0] > 0 and climate[1] <= 28.001 and climate[2] >= 3
    base = tables.settled(grid.select("i", "j", "h", planets.uplift(F.col("h"), planet.params, 1.2).alias("uplift")))
    params = replace(planets.ErosionParams(), iterations=3, k_variation=0.3)
    whole = planets.erode(base, 16, 32, params, str(tmp_path / "whole"))
    assert whole.count() == 512 and whole.where("h > 0").count() == base.where("h > 0").count()
    assert whole.join(base.select("i", "j", F.col("h").alias("b")), ["i", "j"]).where("b <= 0 and h <> b").isEmpty()
    # A run that stopped after its second step, in the middle of writing the third.
    folder = str(tmp_path / "broken")
    planets.erode(base, 16, 32, replace(params, iterations=2), folder)
    (tmp_path / "broken" / "step=000003").mkdir()
    assert planets.finished_steps(spark, folder) == [1, 2]
    kept = tables.written(spark)
    again = planets.erode(base, 16, 32, params, folder)
    assert tables.written(spark) <= kept + 3  # the rock's; tables of steps are removed
    rows = lambda df: {(r["i"], r["j"]): (r["h"], r["acc"]) for r in df.collect()}
    a, b = rows(whole), rows(again)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-12) for k in a)
    assert planets.smooth_relief(grid, 32).where("h > 0 and h < 0.5").isEmpty()


def camera_table(spark, *rows):
    return spark.createDataFrame(rows, "camera long, cx double, cy double, cz double")


def test_quadtree_of_many_cameras(spark):
    r = 6_371_000.0
    both = quadtree.select_leaves(camera_table(spark, (1, 1e9, 0.0, 0.0), (2, r + 1000.0, 0.0, 0.0)), r, max_level=9)
    rows = both.collect()
    far, near = ([x for x in rows if x["camera"] == k] for k in (1, 2))
    assert len(far) == 6 and {x["level"] for x in far} == {0}
    assert max(x["level"] for x in near) == 9 and sum(0.25 ** x["level"] for x in near) == 6  # the leaves tile the sphere
    assert all(x["level"] <= 2 for x in near if x["face"] == 1)
    # One camera alone has the same leaves, and what isn't wanted any more goes for each camera by itself.
    alone = quadtree.select_leaves(camera_table(spark, (2, r + 1000.0, 0.0, 0.0)), r, max_level=9)
    assert sorted(alone.collect()) == sorted(near)
    changes = quadtree.patch_changes(both, both.where("camera = 2 and level > 7"), 4, ["camera"]).groupBy("camera", "action").count().collect()
    assert {(x["camera"], x["action"]): x["count"] for x in changes} == {(1, "build"): 4, (2, "build"): 4}


def test_patches_as_keyed_state(spark, tmp_path):
    """Two batches with a restart between them do what the difference of tables does; a late frame changes nothing."""
    r, budget = 6_371_000.0, 7
    places = [[(1, 1, r + 2e6, 0.0, 0.0), (2, 1, 0.0, 0.0, r + 3e6)], [(1, 3, 0.0, r + 1e6, 0.0), (1, 2, 0.0, 0.0, 1e9), (3, 1, r + 4e6, 0.0, 0.0)], [(1, 2, r + 2e6, 0.0, 0.0)]]
    source, kind = tmp_path / "cameras", "camera long, frame long, cx double, cy double, cz double"
    built = spark.createDataFrame([], "camera long, face int, level int, x long, y long")
    for number, rows in enumerate(places):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = maintain_patches(spark.readStream.schema(kind).parquet(str(source)), r, 3, budget)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "actions")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        newest = [x for x in rows if x[1] == max(y[1] for y in rows if y[0] == x[0])] if number < 2 else []
        done = spark.read.parquet(str(tmp_path / "actions"))
        if newest:
            wanted = tables.settled(quadtree.select_leaves(camera_table(spark, *[(x[0], *x[2:]) for x in newest]), r, max_level=3))
            seen = built.join(wanted.select("camera").distinct(), "camera", "left_semi")
            changes = tables.settled(quadtree.patch_changes(wanted, seen, budget, ["camera"]))
            frames = {x[0]: x[1] for x in newest}
            got = sorted(tuple(x)[:1] + tuple(x)[2:] for x in done.collect() if frames.get(x["camera"]) == x["frame"])
            assert got == sorted(map(tuple, changes.collect()))
            node = ["camera", "face", "level", "x", "y"]
            built = tables.settled(built.join(changes.where("action = 'drop'"), node, "left_anti").unionByName(changes.where("action = 'build'").select(node)))
        total = done.count()
    assert total == sum(done.groupBy("camera", "frame").count().toPandas()["count"]) and done.where("camera = 1 and frame = 2").isEmpty()
    assert resumed(spark.range(10).withColumnRenamed("id", "step"), 6).count() == 3


def test_sources(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12, dtype="<f4").reshape(3, 4))
    np.save(tmp_path / "b.npy", np.ones((2, 3), bool))
    got = registry.read_npy(spark, str(tmp_path / "*.npy"))
    assert got.count() == 18 and got.where("path like '%a.npy' and row = 2 and col = 1").first()["value"] == 9
    np.save(tmp_path / "c.npy", np.arange(6, dtype="<i8").reshape(2, 3))
    with pytest.raises(Exception, match="unsupported array"):
        registry.read_npy(spark, str(tmp_path / "c.npy")).collect()
    assert spark.range(1).select(registry.month_of_2004(F.lit("200406"))).first()[0] == "June"
    with pytest.raises(Exception, match="not a month of 2004"):
        spark.range(1).select(registry.month_of_2004(F.lit("200413"))).collect()
    cells = geometry.face_pixels(spark, 4).withColumn("height", F.col("u")).select("face", "i", "j", "height")
    tables.write_cells(cells, str(tmp_path / "cube"))
    one = tables.read_cells(spark, str(tmp_path / "cube"), face=2, layers=["height"])
    assert one.count() == 16 and "face" in one.columns
    tables.write_meta(cells, str(tmp_path / "meta"), 4, 8, 896)
    meta = tables.read_meta(spark, str(tmp_path / "meta")).first()
    assert meta["layers"]["height"]["rows"] == 96 and meta["faces"][2] == "py"
    log = spark.createDataFrame([(1, 0.5), (9, 0.1), (3, 0.2)], "step int, loss double")
    assert tables.last_row(log).first()["loss"] == 0.1


def test_discard(spark):
    kept = tables.settled(spark.range(5))
    path, other = tables._of_session(spark)[-1], tables.settled(spark.newSession().range(3))
    assert kept.count() == 5 and spark.read.parquet(path).count() == 5
    tables.discard(spark, tables.written(spark) - 1)
    assert path not in tables._of_session(spark)
    tables.discard(spark)
    # Another session's tables stay.
    assert tables.written(spark) == 0 and other.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_months(spark):
    rows = [(c, m, 0.0 if c == 1 else -3.4e38 if c == 2 and m == 5 else float(m)) for c in range(4) for m in range(1, 13)]
    out = {r["c"]: r for r in tables.monthly_summary(spark.createDataFrame(rows, "c int, month int, v double"), ["c"], "v", -3.4e38).collect()}
    assert out[0]["mean"] == 6.5 and out[0]["range"] == 11 and out[0]["total"] == 78
    assert [out[c]["valid"] for c in range(4)] == [True, False, False, True]
    with pytest.raises(Exception, match="hasn't 12 months"):
        tables.monthly_summary(spark.createDataFrame(rows[:5], "c int, month int, v double"), ["c"], "v").collect()


def test_rejection_sampling(spark):
    rows = [(s, t, t == s % 3) for s in range(6) for t in range(5)]
    out = predicates.first_accepted(spark.createDataFrame(rows, "s int, t long, ok boolean"), ["s"], "t", "ok", 5).collect()
    assert {r["s"]: r["t"] for r in out} == {s: s % 3 for s in range(6)}
    with pytest.raises(Exception, match="no patch accepted"):
        predicates.first_accepted(spark.createDataFrame(rows, "s int, t long, ok boolean"), ["s"], "t", "ok", 1).collect()


def land_and_climate(spark, height=24, width=48):
    lat, lon = np.linspace(85, -85, height)[:, None], np.linspace(-176, 176, width)[None, :]
    h = 800 * np.cos(np.radians(lat * 2)) * np.cos(np.radians(lon)) - 100
    return table(spark, h).withColumn("tavg", F.col("h") / 50).withColumn("rgb", F.abs("j") * 5)


def test_bake_and_patches(spark):
    boxes = [(-30.0, 30.0, -60.0, 0.0)]
    with pytest.raises(ValueError, match="multiple"):
        bake.bake(land_and_climate(spark), 24, 48, 16, [], pad=3, factor=2)
    fine, context = bake.bake(land_and_climate(spark), 24, 48, 16, ["tavg", "rgb"], boxes, bytes_={"rgb"}, factor=2, pad=8, distance_pad=4)
    fine, context = tables.settled(fine), tables.settled(context)
    assert fine.count() == 6 * 16 * 16 and context.count() == 6 * 16 * 16  # 8 coarse pixels and 4 beyond each edge
    assert {"water", "flowacc", "dist_up", "dist_down", "dist_left", "dist_right", "holdout", "tavg", "rgb"} <= set(fine.columns)
    assert {"height", "water", "flowacc", "tavg", "dist_left", "lat"} <= set(context.columns)
    assert fine.where("height > 1 and not water and dist_up = 0").isEmpty() and context.agg(F.max("i")).first()[0] == 15
    # Water routed on block means, a context of heights of its own, and the fine layers beyond the edges.
    own = land_and_climate(spark, 12, 24).select("i", "j", (F.col("h") + 1000).alias("h"))
    other, high, padded = bake.bake(land_and_climate(spark), 24, 48, 8, ["tavg"], factor=2, pad=4, distance_pad=2, fine_pad=2, coarse_height=(own, 12, 24), flow_downsample=2)
    assert padded.count() == 6 * 12 * 12 and {"height", "tavg", "water", "flowacc", "lat"} <= set(padded.columns) and high.agg(F.min("height")).first()[0] > 90
    inner = padded.join(other.select("face", "i", "j", F.col("height").alias("_h"), F.col("flowacc").alias("_f"), F.col("water").alias("_w")), ["face", "i", "j"])
    assert inner.count() == 6 * 64 and inner.where("height <> _h or flowacc <> _f or water <> _w").isEmpty()
    # The middle of the context is the coarse form of the face.
    coarse = resample.coarse_layers(context, ["height"], 16, 8, 2, ["face"])
    far = fine.select("face", "i", "j", F.col("height").alias("own")).join(coarse, ["face", "i", "j"]).agg(F.avg(F.abs(F.col("own") - F.col("height"))), F.count("*")).first()
    assert far[1] == 6 * 256 and far[0] < 60

    wanted = spark.range(30).withColumnRenamed("id", "idx")
    one, two = (sorted(map(tuple, bake.seeded_patches(fine, df, 5, 16, 4, 2, "train", 0.25).collect())) for df in (wanted, wanted.repartition(5)))
    assert one == two and len(one) == 30 and len({r[1:4] for r in one}) > 10
    assert one[:10] == sorted(map(tuple, bake.seeded_patches(fine, wanted.limit(10), 5, 16, 4, 2, "train", 0.25).collect()))
    pixel = {(r["face"], r["i"], r["j"]): (r["holdout"], r["height"] > 0) for r in fine.collect()}
    for split, rows in (("train", one), ("val", [tuple(r) for r in bake.seeded_patches(fine, wanted, 5, 16, 4, 2, "val").collect()])):
        for _, face, i0, j0, turns, _ in rows:
            own = [pixel[face, i0 + a, j0 + b] for a in range(4) for b in range(4)]
            assert i0 % 2 == j0 % 2 == 0 and 0 <= turns <= 3 and all(held == (split == "val") for held, _ in own)
            assert split == "val" or sum(land for _, land in own) >= 4
    with pytest.raises(ValueError, match="nothing is held out"):
        bake.seeded_patches(fine.withColumn("holdout", F.lit(False)), wanted, 5, 16, 4, 2, "val")
    with pytest.raises(ValueError, match="fit a face"):
        bake.acceptable(fine, 16, 5, 2, "train")


def test_rock_changes_erosion(spark):
    grid = land_and_climate(spark, 12, 24).withColumn("uplift", F.lit(1.0))
    plain, rough = (planets.erode(grid, 12, 24, replace(planets.ErosionParams(), iterations=1, k_variation=v, k_variation_cells=1.0)) for v in (0.0, 0.8))
    moved = plain.join(rough.select("i", "j", F.col("h").alias("g")), ["i", "j"]).where(F.abs(F.col("h") - F.col("g")) > 1e-9)
    assert 0 < moved.count() < 12 * 24 and moved.where("h <= 0").isEmpty()


def test_integer_heights_drain(spark):
    h = np.full((6, 8), 5)
    h[[0, -1]] = -1
    filled = hydro.fill_depressions(table(spark, h), 6, 8, 1e-3)
    forest = hydro.receivers(filled, "f", 8).where("c >= 8 and c < 40")
    assert forest.where("rec = c").isEmpty() and forest.count() == 32


def test_layers_and_names(spark, tmp_path):
    with pytest.raises(KeyError):
        features.norm("heigth", F.lit(1.0))
    one = table(spark, np.arange(4.0).reshape(2, 2))
    with pytest.raises(Exception, match="b lacks a cell"):
        tables.aligned({"a": one, "b": one.where("i = 0")}, ["i", "j"]).collect()
    cells = geometry.face_pixels(spark, 2).select("face", "i", "j", F.col("u").alias("depth"))
    tables.write_cells(cells, str(tmp_path / "cube"))
    with pytest.raises(ValueError, match="no layer height"):
        tables.open_cube(spark, str(tmp_path / "cube"), 2, 1.0)
    values = np.random.default_rng(0).standard_normal(3001).round(2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.013, 0.5, 0.77, 1.0]
    assert np.allclose(tables.percentiles(df, "v", shares, bins=8), np.quantile(values, shares), atol=1e-12)
    assert all(map(math.isnan, tables.percentiles(df.where("false"), "v", [0.5])))
    assert spark.createDataFrame([(1, float("nan"))], "c int, v double").transform(lambda d: tables.monthly_summary(d.withColumn("month", F.lit(1)), ["c"], "v", expected=0)).first()["valid"] is False


def test_drawn_patches_and_their_windows(spark):
    """Rank and select has the chances of drawing until a patch is accepted; windows have every cell once, the context what lies around."""
    n, patch, factor = 12, 4, 2
    cells = spark.createDataFrame([(f, i, j, float(i * n + j + f * 1000), i >= 6 and (f == 0 or j < 7)) for f in (0, 3) for i in range(n) for j in range(n)], "face int, i int, j int, height double, holdout boolean")
    held = {(r["face"], r["i"], r["j"]) for r in cells.where("holdout").collect()}
    drawn = tables.settled(bake.seeded_patches(cells, spark.range(3000).withColumnRenamed("id", "idx"), 7, n, patch, factor, "val"))
    got = Counter((r["face"], r["i0"], r["j0"]) for r in drawn.collect())
    # Chances by trying all draws: a box, then an origin whose window meets it.
    chance = {}
    for f in (0, 3):
        own = [(i, j) for g, i, j in held if g == f]
        ranges = [range(max(min(x[k] for x in own) - patch + 1, 0) // factor, min(max(x[k] for x in own), n - patch) // factor + 1) for k in (0, 1)]
        for a, b in itertools.product(*ranges):
            if all((f, a * factor + x, b * factor + y) in held for x in range(patch) for y in range(patch)):
                chance[f, a * factor, b * factor] = 1 / (len(ranges[0]) * len(ranges[1]))
    total = sum(chance.values())
    assert got.keys() == chance.keys() and all(abs(got[k] - 3000 * c / total) < 5 * math.sqrt(3000 * c / total) for k, c in chance.items())
    read = bake.patch_cells(drawn, cells, patch, factor).join(drawn, "idx")
    assert read.count() == 3000 * patch * patch and read.where("height <> (i0 + a) * 12 + j0 + b + face * 1000").isEmpty() and read.groupBy("idx", "a", "b").count().where("count > 1").isEmpty()
    context = spark.createDataFrame([(f, i, j, float(i * 100 + j)) for f in (0, 3) for i in range(10) for j in range(10)], "face int, i int, j int, height double")
    around = bake.context_of(drawn.limit(20), context, patch, factor, 4, 4).join(drawn, "idx")
    # Two coarse pixels beyond the faces, and as many around a patch: 6 x 6 of them.
    assert around.count() == 20 * 36 and around.where("height <> (i0 / 2 + 2 + a) * 100 + j0 / 2 + 2 + b").isEmpty() and around.agg(F.min("a"), F.max("b")).first() == (-2, 3)
    with pytest.raises(ValueError, match="accepts no patch"):
        bake.seeded_patches(cells.withColumn("holdout", F.lit(True)), spark.range(1).withColumnRenamed("id", "idx"), 7, n, patch, factor)


def test_windows_are_added_up_by_origin(spark, tmp_path):
    """However many patches there are, only their origins are grouped and shuffled; repeated indices have their own sums, null ones none."""
    n, patch, factor = 12, 4, 2
    cells = spark.createDataFrame([(f, i, j, float(i * n + j + f * 1000), False) for f in (0, 3) for i in range(n) for j in range(n)], "face int, i int, j int, height double, holdout boolean")
    indices = spark.createDataFrame([(k,) for k in (*range(200), 7, 7, None)], "idx long")
    drawn = tables.settled(bake.seeded_patches(cells, indices, 7, n, patch, factor))
    assert drawn.count() == 202
    got = bake.patch_sums(drawn, cells, patch, factor, {"seen": F.sum("height"), "m": F.max(F.col("a") * 10 + F.col("b"))})
    assert got.columns == [*drawn.columns, "seen", "m"] and got.count() == 202 and got.where("m <> 33 or seen <> 16 * ((i0 + 1.5) * 12 + j0 + 1.5 + face * 1000)").isEmpty()
    orders = spark.range(20_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 997).alias("o_custkey"), (F.col("id") * 37 % 400_000 / 1.0).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    drawn = globe.q91_seeded_patches(spark, str(tmp_path))
    assert drawn.count() == 40_000
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Aggregate" not in plan


def test_joint_conditioning_takes_the_context(spark):
    """Heights, water, flow and distances of joint mode are the context's middle at the patch's resolution; the rest stays the patch's own."""
    context = spark.createDataFrame([(k, i, j, *(float(k * 50 + i * 7 + j * (n + 1)) for n in range(7))) for k in (0, 1) for i in range(8) for j in range(8)], "patch int, i int, j int, " + ", ".join(f"{c} double" for c in features.JOINT))
    own = spark.createDataFrame([(k, i, j, *(float(900 + n) for n in range(12))) for k in (0, 1) for i in range(8) for j in range(8)], "patch int, i int, j int, " + ", ".join(f"{c} double" for c in features.COND if c not in ("slope", "ocean")))
    out = features.joint_conditioning(own, context, 8, 4, 2, 2.5, 4.0, 10.0, ("patch",))
    coarse = resample.coarse_layers(context, list(features.JOINT), 8, 4, 2, ["patch"])
    rows = {(r["patch"], r["i"], r["j"]): r for r in coarse.collect()}
    got = out.collect()
    assert len(got) == 128
    for r in got:
        want = rows[r["patch"], r["i"], r["j"]]
        cond = dict(zip(features.COND, r["cond"], strict=True))
        assert np.isclose(cond["height"], (want["height"] - 10) / 4000) and np.isclose(cond["water"], want["water"]) and np.isclose(cond["dist_left"], want["dist_left"] / 8) and np.isclose(cond["flowacc"], want["flowacc"] / 6)
        assert cond["noise"] == r["noise"] >= 900 and np.isclose(cond["lat"], r["lat"] / 90)
