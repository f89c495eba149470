"""The query catalogue over the driver tables, and the SQL each query is held against.

Inputs that stand in for rasters and points:

* ``G``: orders bucketed to a 24 x 48 grid, heights from exact integer cents;
* ``E``: events as points, from modular arithmetic on their keys;
* ``V``: embeddings as 8 x 8 patches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.functions import features, geometry, noise
from spheregrid.operators import hydro, predicates, quadtree, resample, windows
from spheregrid.sources import registry, tables
from spheregrid.streaming.frames import tumbling_counts

H, W = 24, 48
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: str) -> Column:
    return F.rint(F.col(x) * 100).cast("long")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % H).cast("int").alias("i"), (F.col("o_orderkey") % W).cast("int").alias("j"), cents("o_totalprice").alias("c"))
    cells = orders.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
    return cells.select("i", "j", "n", (F.expr("(2 * s + n) div (2 * n) div 100") - 245000).alias("h"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("user_id") * 37 % 3600) / 10.0 - 180 + 0.03
    lat = ((F.col("event_id") * 53 % 1801) / 10.0 - 90) * 0.999 + 0.013
    return read(spark, sf_dir, "events").select("event_id", "user_id", lon.alias("lon"), lat.alias("lat"), cents("value").alias("cents"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return each.select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).cast("int").alias("j"), F.col("x").cast("double").alias("x"))


G = f"""g AS (
  SELECT i, j, count(*) AS n, CAST((2 * sum(c) + count(*)) // (2 * count(*)) // 100 - 245000 AS BIGINT) AS h
  FROM (SELECT CAST(o_custkey % {H} AS INTEGER) AS i, CAST(o_orderkey % {W} AS INTEGER) AS j, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS c FROM orders)
  GROUP BY i, j)"""
E = """e AS (
  SELECT event_id, user_id, (user_id * 37 % 3600) / 10.0::DOUBLE - 180 + 0.03::DOUBLE AS lon,
         ((event_id * 53 % 1801) / 10.0::DOUBLE - 90) * 0.999::DOUBLE + 0.013::DOUBLE AS lat, CAST(round_even(value * 100, 0) AS BIGINT) AS cents
  FROM events)"""
V = """v AS (
  SELECT vec_id, label, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS j, CAST(embedding[p] AS DOUBLE) AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"""
DIR = """d AS (
  SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM e)"""
FACE = """f AS (
  SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 1 ELSE 0 END
                 WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 3 ELSE 2 END
                 ELSE CASE WHEN z < 0 THEN 5 ELSE 4 END END AS face FROM d)"""
UV = """uv AS (
  SELECT *, atan(CASE face WHEN 0 THEN y / x WHEN 1 THEN -y / -x WHEN 2 THEN -x / y WHEN 3 THEN x / -y WHEN 4 THEN x / z ELSE y / -z END) * 4 / pi() AS u,
            atan(CASE face WHEN 0 THEN z / x WHEN 1 THEN z / -x WHEN 2 THEN z / y WHEN 3 THEN z / -y WHEN 4 THEN y / z ELSE x / -z END) * 4 / pi() AS v FROM f)"""
STEPS = "steps(k, di, dj) AS (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1))"
REC = f"""{G}, {STEPS}, drops AS (
  SELECT a.i, a.j, s.k, b.i * {W} + b.j AS r, (a.h - b.h) / sqrt(CAST(s.di * s.di + s.dj * s.dj AS DOUBLE)) AS slope
  FROM g a, steps s, g b WHERE b.i = a.i + s.di AND b.j = (a.j + s.dj + {W}) % {W} AND a.h > b.h AND a.h > 0),
best AS (SELECT i, j, r FROM drops QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY slope DESC, k) = 1),
rec AS (SELECT CAST(g.i * {W} + g.j AS BIGINT) AS c, CAST(coalesce(b.r, g.i * {W} + g.j) AS BIGINT) AS rec, g.h, g.n FROM g LEFT JOIN best b ON g.i = b.i AND g.j = b.j)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    cells = g.select((F.col("i").cast("long") * W + F.col("j")).alias("c"), "h", "n")
    return hydro.receivers(g, "h", W).join(cells, "c")


@query(f"WITH {G} SELECT CAST(i // 4 AS INTEGER) AS bi, CAST(j // 4 AS INTEGER) AS bj, round(avg(h), 6) + 0.0 AS mean_h, count(*) AS n FROM g GROUP BY 1, 2")
def q01_block_mean(spark, sf_dir):
    return resample.block_mean(grid(spark, sf_dir), 4, ["h"], H, W).select(F.col("i").alias("bi"), F.col("j").alias("bj"), r6(F.col("h")).alias("mean_h"), "n")


def on_faces(spark, sf_dir):
    e = points(spark, sf_dir)
    x, y, z = geometry.latlon_to_dir(F.col("lat"), F.col("lon"))
    e = e.withColumn("x", x).withColumn("y", y).withColumn("z", z)
    e = e.withColumn("face", geometry.dir_to_face([F.col(c) for c in "xyz"]))
    u, v = geometry.dir_to_uv([F.col(c) for c in "xyz"], F.col("face"))
    return e.withColumn("u", u).withColumn("v", v)


@query(f"WITH {E}, {DIR}, {FACE}, {UV} SELECT event_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, face, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM uv")
def q02_face_coordinates(spark, sf_dir):
    return on_faces(spark, sf_dir).select("event_id", *[r6(F.col(c)).alias(c) for c in "xyz"], "face", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query(f"WITH {E}, {DIR}, {FACE} SELECT face, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM f GROUP BY face")
def q03_face_histogram(spark, sf_dir):
    return on_faces(spark, sf_dir).groupBy("face").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""WITH {E}, {DIR}, {FACE}, {UV} SELECT face, CAST(greatest(0, least(63, round_even((1 - v) * 0.5 * 64 - 0.5, 0))) AS INTEGER) AS i,
  CAST(greatest(0, least(63, round_even((u + 1) * 0.5 * 64 - 0.5, 0))) AS INTEGER) AS j, count(*) AS n FROM uv GROUP BY 1, 2, 3""")
def q04_pixel_bin(spark, sf_dir):
    i, j = geometry.uv_to_pixel(64, F.col("u"), F.col("v"))
    return on_faces(spark, sf_dir).groupBy("face", i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT event_id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM e WHERE lat BETWEEN -40 AND 35 AND (lon >= 150 OR lon <= -120)")
def q05_bbox_wrap(spark, sf_dir):
    box = [F.lit(float(x)) for x in (-40, 35, 150, -120)]
    return points(spark, sf_dir).where(predicates.in_box(F.col("lat"), F.col("lon"), *box)).select("event_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


BOXES = [(-56.0, 13.0, -82.0, -34.0), (-48.0, -10.0, 112.0, 180.0)]


@query(f"""WITH {E}, b(a, z, w, o) AS (VALUES (-56.0, 13.0, -82.0, -34.0), (-48.0, -10.0, 112.0, 180.0)),
m AS (SELECT event_id, bool_or(lat BETWEEN a AND z AND lon BETWEEN w AND o) AS holdout, any_value(cents) AS cents FROM e, b GROUP BY event_id)
SELECT holdout, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM m GROUP BY holdout""")
def q06_holdout_split(spark, sf_dir):
    return predicates.mark_holdout(points(spark, sf_dir), BOXES).groupBy("holdout").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""WITH {G} SELECT CAST(i // 8 AS INTEGER) AS pi, CAST(j // 8 AS INTEGER) AS pj, count(*) AS cells, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS land
FROM g GROUP BY 1, 2 HAVING NOT bool_or(i BETWEEN 3 AND 5 AND j < 20) AND avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END) >= 0.5""")
def q07_patch_accept(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("holdout", F.col("i").between(3, 5) & (F.col("j") < 20))
    return predicates.accept_patches(g, 8, "train", 0.5).select("pi", "pj", "cells", r6(F.col("land")).alias("land"))


@query(f"""WITH {G}, r AS (SELECT k AS i, coalesce(sum(h) FILTER (n >= 10 AND g.i NOT IN (0, 1, 9, 10, 11, 23)), 0)::DOUBLE AS s, count(*) FILTER (n >= 10 AND g.i NOT IN (0, 1, 9, 10, 11, 23)) AS c
  FROM range({H}) t(k) LEFT JOIN g ON g.i = t.k GROUP BY k),
m AS (SELECT *, CASE WHEN sum(c) OVER w > 0 THEN sum(s) OVER w / sum(c) OVER w END AS m FROM r WINDOW w AS (ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN m IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
  min(CASE WHEN c > 0 THEN i END) OVER () AS f, max(CASE WHEN c > 0 THEN i END) OVER () AS l FROM m),
y AS (SELECT x.i, CASE WHEN x.i < x.f THEN (SELECT sum(s) / sum(c) FROM r WHERE r.i BETWEEN x.f AND x.f + 9)
  WHEN x.i > x.l THEN (SELECT sum(s) / sum(c) FROM r WHERE r.i BETWEEN x.l - 9 AND x.l)
  WHEN x.a IS NULL THEN mb.m WHEN x.b IS NULL OR x.a = x.b THEN ma.m ELSE ma.m + (mb.m - ma.m) * (x.i - x.a) / (x.b - x.a) END AS fill
  FROM x LEFT JOIN m ma ON ma.i = x.a LEFT JOIN m mb ON mb.i = x.b)
SELECT g.i, g.j, round(CASE WHEN n >= 10 AND g.i NOT IN (0, 1, 9, 10, 11, 23) THEN h ELSE fill END, 6) + 0.0 AS h FROM g JOIN y ON g.i = y.i""")
def q08_zonal_mean_fill(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("valid", (F.col("n") >= 10) & ~F.col("i").isin(0, 1, 9, 10, 11, 23))
    return windows.zonal_fill(g, "h", "valid", 2, H).select("i", "j", r6(F.col("filled")).alias("h"))


WATER = "(h < -60000)"


def distances(spark, sf_dir, wrap):
    g = grid(spark, sf_dir).withColumn("water", F.col("h") < -60000)
    g = windows.directional_distance(g, "water", 1, 1, 2.5, 60, wrap, "right")
    g = windows.directional_distance(g, "water", 1, -1, 2.5, 60, wrap, "left")
    if wrap:
        return g.select("i", "j", "right", "left")
    g = windows.directional_distance(g, "water", 0, 1, 2.5, 60, None, "down")
    return windows.directional_distance(g, "water", 0, -1, 2.5, 60, None, "up").select("i", "j", "right", "left", "down", "up")


@query(f"""WITH {G}, w AS (SELECT * FROM g WHERE {WATER}) SELECT g.i, g.j,
  least(60.0::DOUBLE, coalesce((SELECT min(w.j) - g.j FROM w WHERE w.i = g.i AND w.j >= g.j) * 2.5::DOUBLE, 60)) AS "right",
  least(60.0::DOUBLE, coalesce((SELECT g.j - max(w.j) FROM w WHERE w.i = g.i AND w.j <= g.j) * 2.5::DOUBLE, 60)) AS "left",
  least(60.0::DOUBLE, coalesce((SELECT min(w.i) - g.i FROM w WHERE w.j = g.j AND w.i >= g.i) * 2.5::DOUBLE, 60)) AS down,
  least(60.0::DOUBLE, coalesce((SELECT g.i - max(w.i) FROM w WHERE w.j = g.j AND w.i <= g.i) * 2.5::DOUBLE, 60)) AS up FROM g""")
def q09_directional_distance(spark, sf_dir):
    return distances(spark, sf_dir, None)


@query(f"""WITH {G}, w AS (SELECT * FROM g WHERE {WATER}) SELECT g.i, g.j,
  least(60.0::DOUBLE, coalesce((SELECT min((w.j - g.j + {W}) % {W}) FROM w WHERE w.i = g.i) * 2.5::DOUBLE, 60)) AS "right",
  least(60.0::DOUBLE, coalesce((SELECT min((g.j - w.j + {W}) % {W}) FROM w WHERE w.i = g.i) * 2.5::DOUBLE, 60)) AS "left" FROM g""")
def q10_directional_distance_wrap(spark, sf_dir):
    return distances(spark, sf_dir, W)


NEAR = """x AS (SELECT *, lag(h) OVER r AS w, lead(h) OVER r AS e, lag(h) OVER c AS n_, lead(h) OVER c AS s_ FROM g WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i))"""


@query(f"WITH {G}, {NEAR} SELECT i, j, round(sqrt(pow((coalesce(e, h) - coalesce(w, h)) / 2.0, 2) + pow((coalesce(s_, h) - coalesce(n_, h)) / 2.0, 2)) * 0.001, 6) + 0.0 AS slope FROM x")
def q11_slope(spark, sf_dir):
    return windows.slope(grid(spark, sf_dir), "h", 0.001).select("i", "j", r6(F.col("slope")).alias("slope"))


@query(f"""WITH {G}, {NEAR} SELECT i, j, round(greatest(0.0, least(1.0, 0.5 + 0.00001 * (
  coalesce(CASE WHEN n_ IS NULL THEN s_ - h WHEN s_ IS NULL THEN h - n_ ELSE (s_ - n_) / 2.0 END, 0) +
  coalesce(CASE WHEN w IS NULL THEN e - h WHEN e IS NULL THEN h - w ELSE (e - w) / 2.0 END, 0)))), 6) + 0.0 AS shade FROM x""")
def q12_hillshade(spark, sf_dir):
    return windows.hillshade(grid(spark, sf_dir), "h", 0.00001).select("i", "j", r6(F.col("shade")).alias("shade"))


@query(f"""WITH {G} SELECT a.i, a.j, round(avg(b.h::DOUBLE), 6) + 0.0 AS blur FROM g a, range(-2, 3) p(di), range(-2, 3) q(dj), g b
WHERE b.i = greatest(0, least({H - 1}, a.i + di)) AND b.j = greatest(0, least({W - 1}, a.j + dj)) GROUP BY a.i, a.j""")
def q13_box_blur(spark, sf_dir):
    return windows.box_blur(grid(spark, sf_dir), "h", 2).select("i", "j", r6(F.col("blur")).alias("blur"))


@query(f"WITH {G} SELECT a.i, a.j, min(b.h) AS lo, max(b.h) AS hi, max(b.h) - min(b.h) < 150000 AS flat FROM g a JOIN g b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j")
def q14_extrema(spark, sf_dir):
    return windows.extrema(grid(spark, sf_dir), "h", 2).select("i", "j", "lo", "hi", (F.col("hi") - F.col("lo") < 150000).alias("flat"))


COS = f"greatest(0.15::DOUBLE, cos(radians(90 - (i + 0.5) * 180 / {H})))"


@query(f"""WITH {G}, y AS (SELECT g.*, {COS} AS c, n.h AS nh, s.h AS sh, e.h AS eh, w.h AS wh FROM g
  LEFT JOIN g n ON n.i = g.i - 1 AND n.j = g.j LEFT JOIN g s ON s.i = g.i + 1 AND s.j = g.j
  LEFT JOIN g e ON e.i = g.i AND e.j = (g.j + 1) % {W} LEFT JOIN g w ON w.i = g.i AND w.j = (g.j + {W - 1}) % {W})
SELECT i, j, round(CASE WHEN i > 0 AND i < {H - 1} THEN h + 0.004::DOUBLE * ((nh + sh - 2 * h) + (eh + wh - 2 * h) / (c * c)) ELSE h END, 6) + 0.0 AS h FROM y""".replace("cos(radians(90 - (i", "cos(radians(90 - (g.i"))
def q15_diffuse(spark, sf_dir):
    return windows.diffuse(grid(spark, sf_dir).withColumn("h", F.col("h").cast("double")), "h", 0.004, H, W, geometry.row_cos(F.col("i"), H)).select("i", "j", r6(F.col("h")).alias("h"))


@query(f"""WITH {G}, {E}, p AS (SELECT *, (90 - lat) / 180 * {H} - 0.5 AS y, (lon + 180) / 360 * {W} - 0.5 AS x FROM e),
c AS (SELECT event_id, cast(floor(y) AS INTEGER) + a AS ci, cast(floor(x) AS INTEGER) + b AS cj, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
  FROM p, range(2) ta(a), range(2) tb(b))
SELECT event_id, round(sum(w * h), 4) + 0.0 AS h FROM c JOIN g ON g.i = greatest(0, least({H - 1}, ci)) AND g.j = (cj + {W}) % {W} GROUP BY event_id""")
def q16_bilinear(spark, sf_dir):
    return resample.sample_equirect(points(spark, sf_dir), "event_id", grid(spark, sf_dir), ["h"], H, W).select("event_id", (F.round("h", 4) + 0.0).alias("h"))


@query(f"""WITH {G}, {E} SELECT event_id, g.h FROM e LEFT JOIN g ON g.i = greatest(0, least({H - 1}, CAST(round_even((90 - lat) / 180 * {H} - 0.5, 0) AS INTEGER)))
 AND g.j = (CAST(round_even((lon + 180) / 360 * {W} - 0.5, 0) AS INTEGER) + {W}) % {W}""")
def q17_nearest(spark, sf_dir):
    return resample.sample_equirect(points(spark, sf_dir), "event_id", grid(spark, sf_dir), ["h"], H, W, nearest=True).select("event_id", "h")


HANN = "greatest(0.001::DOUBLE, 0.5 - 0.5 * cos(2 * pi() * ({} + 0.5) / 8))"


@query(f"""WITH {V}, t AS (SELECT vec_id // 9 AS face, (vec_id % 9) // 3 * 4 + i AS i, vec_id % 3 * 4 + j AS j, {HANN.format("i")} * {HANN.format("j")} AS w, x FROM v)
SELECT face, i, j, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM t GROUP BY face, i, j""")
def q18_overlap_add(spark, sf_dir):
    v = patches(spark, sf_dir)
    tiles = v.select(F.floor(F.col("vec_id") / 9).alias("face"), (F.floor(F.col("vec_id") % 9 / 3) * 4).alias("si"), (F.col("vec_id") % 3 * 4).alias("sj"), F.col("i").alias("a"), F.col("j").alias("b"), "x")
    return resample.overlap_add(tiles, "x", 8, ["face"]).select("face", "i", "j", r6(F.col("x")).alias("x"))


def upsampled(source: str, out: str, factor: int, height: int, width: int, keys: str = "") -> str:
    """CTE of the clamped, cell-centred bilinear upsampling of ``source(keys, i, j, v)``."""
    at = lambda c: f"(({c} + 0.5::DOUBLE) / {factor} - 0.5)"
    part = lambda c, d: f"(CASE {d} WHEN 0 THEN 1 - ({at(c)} - floor({at(c)})) ELSE {at(c)} - floor({at(c)}) END)"
    cell = lambda c, d, n: f"greatest(0, least({n - 1}, CAST(floor({at(c)}) AS INTEGER) + {d}))"
    same = "".join(f" AND s.{k} = f.{k}" for k in keys.split(", ") if k)
    own = "".join(f"f.{k}, " for k in keys.split(", ") if k)
    fine = f"SELECT DISTINCT {keys + ', ' if keys else ''}a.i AS i, b.j AS j FROM {source} t, (SELECT unnest(range({height * factor})) AS i) a, (SELECT unnest(range({width * factor})) AS j) b" if keys else f"SELECT a.i AS i, b.j AS j FROM (SELECT unnest(range({height * factor})) AS i) a, (SELECT unnest(range({width * factor})) AS j) b"
    return f"""{out} AS MATERIALIZED (SELECT {own}f.i, f.j, sum({part('f.i', 'p.p')} * {part('f.j', 'q.q')} * s.v) AS v
  FROM ({fine}) f, (SELECT unnest([0, 1]) AS p) p, (SELECT unnest([0, 1]) AS q) q, {source} s
  WHERE s.i = {cell('f.i', 'p.p', height)} AND s.j = {cell('f.j', 'q.q', width)}{same} GROUP BY {own}f.i, f.j)"""


def mean_preserving(source: str, out: str, factor: int, height: int, width: int, keys: str = "", corrections: int = 4) -> str:
    """CTEs of the upsampling that keeps block means: a fixed number of corrections, then the rest put in flat."""
    k = keys + ", " if keys else ""
    using = f"USING ({k}i, j)"
    parts = [upsampled(source, f"{out}_0", factor, height, width, keys)]
    for n in range(corrections + 1):
        parts.append(f"{out}_m{n} AS MATERIALIZED (SELECT {k}i, j, s.v - m.v AS v FROM {source} s JOIN (SELECT {k}i // {factor} AS i, j // {factor} AS j, avg(v) AS v FROM {out}_{n} GROUP BY ALL) m {using})")
        if n < corrections:
            parts.append(upsampled(f"{out}_m{n}", f"{out}_e{n}", factor, height, width, keys))
            parts.append(f"{out}_{n + 1} AS MATERIALIZED (SELECT {k}i, j, u.v + e.v AS v FROM {out}_{n} u JOIN {out}_e{n} e {using})")
    same = "".join(f" AND e.{c} = u.{c}" for c in keys.split(", ") if c)
    own = "".join(f"u.{c}, " for c in keys.split(", ") if c)
    parts.append(f"{out} AS MATERIALIZED (SELECT {own}u.i, u.j, u.v + e.v AS v FROM {out}_{corrections} u JOIN {out}_m{corrections} e ON e.i = u.i // {factor} AND e.j = u.j // {factor}{same})")
    return ", ".join(parts)


@query(f"WITH {V}, c AS (SELECT vec_id, i, j, x AS v FROM v), {mean_preserving('c', 'm', 2, 8, 8, 'vec_id')} SELECT vec_id, i, j, round(v, 6) + 0.0 AS x FROM m")
def q19_mean_preserving(spark, sf_dir):
    few = patches(spark, sf_dir).select("vec_id", "i", "j", "x")
    return resample.mean_preserving_upsample(few, 2, "x", keys=["vec_id"]).select("vec_id", "i", "j", r6(F.col("x")).alias("x"))


@query(f"WITH {REC} SELECT c, rec FROM rec")
def q20_receivers(spark, sf_dir):
    return hydro.receivers(grid(spark, sf_dir), "h", W)


@query(f"""WITH RECURSIVE {G}, {STEPS}, f(t, i, j, h, f) AS (
  SELECT 0, i, j, h, CASE WHEN h <= 0 OR i IN (0, {H - 1}) THEN h ELSE 1152921504606846976 END FROM g
  UNION ALL
  SELECT t + 1, i, j, h, CASE WHEN h <= 0 OR i IN (0, {H - 1}) THEN h ELSE least(f, greatest(h, m + 1)) END
  FROM (SELECT a.t, a.i, a.j, a.h, a.f, (SELECT min(b.f) FROM f b, steps s WHERE b.i = a.i + s.di AND b.j = (a.j + s.dj + {W}) % {W}) AS m FROM f a WHERE a.t < 60))
SELECT i, j, CAST(f AS BIGINT) AS f FROM f WHERE t = 60""")
def q21_fill(spark, sf_dir):
    return hydro.fill_depressions(grid(spark, sf_dir), H, W, 1).select("i", "j", "f")


@query(f"""WITH RECURSIVE {REC}, p(src, pos, n) AS (SELECT c, c, n FROM rec UNION ALL SELECT src, r.rec, p.n FROM p JOIN rec r ON r.c = p.pos WHERE r.rec <> r.c)
SELECT pos AS c, CAST(sum(n) AS BIGINT) AS acc FROM p GROUP BY pos""")
def q22_accumulate(spark, sf_dir):
    return hydro.accumulate(forest(spark, sf_dir), "n", width=W).select("c", "acc")


@query(f"""WITH RECURSIVE {REC}, p(src, pos, d) AS (SELECT c, c, 0 FROM rec UNION ALL SELECT src, r.rec, p.d + 1 FROM p JOIN rec r ON r.c = p.pos WHERE r.rec <> r.c),
q AS (SELECT src AS c, arg_max(pos, d) AS root, CAST(max(d) AS BIGINT) AS depth FROM p GROUP BY src),
k AS (SELECT rec AS c, count(*) AS donors FROM rec WHERE rec <> c GROUP BY rec)
SELECT q.c, root, depth, coalesce(donors, 0) AS donors FROM q LEFT JOIN k ON k.c = q.c""")
def q23_flow_depth(spark, sf_dir):
    f = forest(spark, sf_dir)
    return hydro.flow_depth(f, W).join(hydro.donors(f), "c")


@query(f"""WITH RECURSIVE {G}, l AS (SELECT i, j, i * {W} + j AS k FROM g WHERE h > 0), r(t, i, j, k) AS (
  SELECT 0, i, j, k FROM l UNION ALL
  SELECT a.t + 1, a.i, a.j, least(a.k, (SELECT min(b.k) FROM r b WHERE abs(b.i - a.i) + abs(b.j - a.j) = 1)) FROM r a WHERE a.t < 150)
SELECT CAST(k AS BIGINT) AS label, count(*) AS cells FROM r WHERE t = 150 GROUP BY k""")
def q24_regions(spark, sf_dir):
    return hydro.regions(grid(spark, sf_dir).where("h > 0"), W).groupBy("label").agg(F.count("*").alias("cells"))


@query(f"""WITH RECURSIVE {REC}, q(c, v, d) AS (SELECT c, greatest(h::DOUBLE, 0), 0 FROM rec WHERE rec = c OR h <= 0 UNION ALL
  SELECT r.c, (r.h + (0.01::DOUBLE * r.n) * q.v) / (1 + 0.01::DOUBLE * r.n), d + 1 FROM q JOIN rec r ON r.rec = q.c AND r.rec <> r.c AND r.h > 0)
SELECT rec.c, round(CASE WHEN rec.rec = rec.c OR rec.h <= 0 THEN rec.h::DOUBLE ELSE q.v END, 4) + 0.0 AS h2 FROM rec JOIN q ON q.c = rec.c""")
def q25_incision(spark, sf_dir):
    f = forest(spark, sf_dir).withColumn("factor", F.lit(0.01) * F.col("n"))
    return hydro.incise(f, "factor", width=W).select("c", (F.round("h2", 4) + 0.0).alias("h2"))


M64 = "18446744073709551616::HUGEINT"


def _mul(x: str, k: int) -> str:
    """x * k modulo 2^64 in HUGEINT: the product of 64-bit numbers would not fit, so by halves of k."""
    return f"((({x})::HUGEINT * {k & 0xFFFFFFFF}::HUGEINT + ((({x})::HUGEINT * {k >> 32}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT) % {M64})"


def _xor(*parts: str) -> str:
    out = f"({parts[0]})::UBIGINT"
    for p in parts[1:]:
        out = f"xor({out}, ({p})::UBIGINT)"
    return out


_POS = _xor(_mul("CAST(p_size AS BIGINT) + 1048576", noise.KEY_X), _mul("p_partkey % 1000 + 1048576", noise.KEY_Y), str((3 * noise.KEY_Z) % 2**64), "0")


@query(f"""WITH a AS (SELECT p_partkey, {_POS} AS x FROM part), b AS (SELECT p_partkey, xor(x, x >> 31) AS x FROM a),
c AS (SELECT p_partkey, ({_mul("x", noise.LAST)})::UBIGINT AS x FROM b) SELECT p_partkey, CAST(xor(x, x >> 27) >> 11 AS BIGINT) AS bits FROM c""")
def q26_position_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", noise.position_bits(F.lit(2), F.col("p_size"), F.col("p_partkey") % 1000).alias("bits"))


@query(f"""WITH a AS (SELECT o_orderkey, {_xor(_mul("o_orderkey", noise.CELL_A), _mul("o_custkey", noise.CELL_B))} AS x FROM orders),
s AS (SELECT o_orderkey, CASE WHEN x >= 9223372036854775808::UBIGINT THEN x::HUGEINT - {M64} ELSE x::HUGEINT END AS x FROM a),
b AS (SELECT o_orderkey, xor(x::BIGINT, (x::BIGINT) >> 13) AS y FROM s),
m AS (SELECT o_orderkey, ((y::HUGEINT * {noise.CELL_MIX}::HUGEINT) % {M64} + {M64}) % {M64} AS z FROM b),
n AS (SELECT o_orderkey, CASE WHEN z >= 9223372036854775808::HUGEINT THEN z - {M64} ELSE z END::BIGINT AS z FROM m)
SELECT o_orderkey, CAST((xor(z, z >> 16) & 16777215) AS DOUBLE) / 16777216 AS u FROM n""")
def q27_hash01(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", noise.hash01(F.col("o_orderkey"), F.col("o_custkey")).alias("u"))


def _wrap(x: str) -> str:
    return f"((({x}) % {M64} + {M64}) % {M64})"


_LAT = _xor(_mul(_wrap("floor(px)::HUGEINT + a"), noise.KEY_X), _mul(_wrap("floor(py)::HUGEINT + b"), noise.KEY_Y), _mul(_wrap("floor(pz)::HUGEINT + c"), noise.KEY_Z), str((5 * noise.KEY_SEED) % 2**64))
_W = "(CASE {k} WHEN 1 THEN {s} ELSE 1 - {s} END)"
_S = "((p{0} - floor(p{0})) * (p{0} - floor(p{0})) * (3 - 2 * (p{0} - floor(p{0}))))"


@query(f"""WITH {E}, {DIR}, p AS (SELECT event_id, x * 7 AS px, y * 7 AS py, z * 7 AS pz FROM d),
k AS (SELECT event_id, {" * ".join(_W.format(k=k, s=_S.format(ax)) for k, ax in zip("abc", "xyz"))} AS w, {_LAT} AS h FROM p, range(2) ta(a), range(2) tb(b), range(2) tc(c)),
l AS (SELECT event_id, w, ({_mul("xor(h, h >> 31)", noise.LAST)})::UBIGINT AS h FROM k)
SELECT event_id, round(sum(w * (CAST(xor(h, h >> 27) >> 11 AS DOUBLE) / 9007199254740992 * 2 - 1)), 6) + 0.0 AS noise FROM l GROUP BY event_id""")
def q28_value_noise(spark, sf_dir):
    return noise.value_noise(on_faces(spark, sf_dir).select("event_id", *"xyz"), tuple(F.col(c) * 7 for c in "xyz"), 5, "noise").select("event_id", r6(F.col("noise")).alias("noise"))


@query(f"WITH {G} SELECT i, j, round(h / 4000.0::DOUBLE, 6) + 0.0 AS height, round(ln(1 + greatest(h, 0)::DOUBLE) / 9, 6) + 0.0 AS prec, round((90 - (i + 0.5) * 180 / {H}) / 90, 6) + 0.0 AS lat FROM g")
def q29_normalise(spark, sf_dir):
    lat, _ = geometry.equirect_latlon(F.col("i"), F.col("j"), H, W)
    return grid(spark, sf_dir).select("i", "j", *[r6(features.norm(n, x)).alias(n) for n, x in (("height", F.col("h")), ("prec", F.col("h")), ("lat", lat))])


@query(f"WITH {V} SELECT vec_id, 7 - j AS i, 7 - i AS j, round(x, 6) + 0.0 AS dist_up, round(-x, 6) + 0.0 AS dist_left FROM v")
def q30_augment(spark, sf_dir):
    v = patches(spark, sf_dir).select("vec_id", "i", "j", F.col("x").alias("dist_right"), (-F.col("x")).alias("dist_down"))
    return features.augment(v, 8, 1, True).select("vec_id", "i", "j", r6(F.col("dist_up")).alias("dist_up"), r6(F.col("dist_left")).alias("dist_left"))


@query(f"""WITH {V}, y AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id, i ORDER BY j) AS gx, x - lag(x) OVER (PARTITION BY vec_id, j ORDER BY i) AS gy FROM v)
SELECT a.label, round(avg(abs(a.x - b.x)), 6) + 0.0 AS l1, round(avg(abs(a.gx - b.gx)) + avg(abs(a.gy - b.gy)), 6) + 0.0 AS grad
FROM y a JOIN y b ON b.vec_id = a.vec_id + 1 AND a.i = b.i AND a.j = b.j GROUP BY a.label""")
def q31_losses(spark, sf_dir):
    v = patches(spark, sf_dir)
    v = v.withColumn("gx", F.col("x") - F.lag("x").over(Window.partitionBy("vec_id", "i").orderBy("j"))).withColumn("gy", F.col("x") - F.lag("x").over(Window.partitionBy("vec_id", "j").orderBy("i")))
    t = v.select((F.col("vec_id") - 1).alias("vec_id"), "i", "j", F.col("x").alias("t"), F.col("gx").alias("tx"), F.col("gy").alias("ty"))
    both = v.join(t, ["vec_id", "i", "j"])
    return both.groupBy("label").agg(r6(features.l1(F.col("x"), F.col("t"))).alias("l1"), r6(features.l1(F.col("gx"), F.col("tx")) + features.l1(F.col("gy"), F.col("ty"))).alias("grad"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0.0 AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q32_weighted_mean(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(features.weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("discount"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders)
SELECT CAST(round_even(greatest(0.0, least(1.0, (o_totalprice - a) / (b - a))) * 255, 0) AS INTEGER) AS level, count(*) AS n FROM orders, p GROUP BY 1""")
def q33_percentile_stretch(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    low, high = tables.percentiles(orders, "o_totalprice", [0.01, 0.99])
    return orders.select(tables.stretch(F.col("o_totalprice"), low, high).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


RADIUS, LEVELS = 6_371_000.0, 5
_TAN = "tan(({}) * pi() / 4)"
_NODE = f"""SELECT *, {_TAN.format("(x + 0.5) * 2 / pow(2, level) - 1")} AS s, {_TAN.format("1 - (y + 0.5) * 2 / pow(2, level)")} AS t"""
_VEC = {"x": "CASE face WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -s WHEN 3 THEN s WHEN 4 THEN s ELSE t END", "y": "CASE face WHEN 0 THEN s WHEN 1 THEN -s WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN t ELSE s END", "z": "CASE face WHEN 4 THEN 1 WHEN 5 THEN -1 ELSE t END"}
_DIST = " + ".join(f"pow(({_VEC[a]}) / sqrt(1 + s * s + t * t) * {RADIUS} - c{a}, 2)" for a in "xyz")


def leaves_sql(cameras: str, out: str) -> str:
    """CTE (recursive): the quadtree's leaves of ``cameras(camera, cx, cy, cz)``."""
    near = f"sqrt({_DIST}) < 2.5 * pi() / 2 * {RADIUS} / pow(2, level)"
    return f"""{out}_q(camera, cx, cy, cz, face, level, x, y, dist, split) AS (
  SELECT camera, cx, cy, cz, face, level, x, y, sqrt({_DIST}), {near} FROM ({_NODE} FROM (SELECT camera, cx, cy, cz, CAST(f AS INTEGER) AS face, 0 AS level, 0::BIGINT AS x, 0::BIGINT AS y FROM {cameras}, range(6) t(f)))
  UNION ALL
  SELECT camera, cx, cy, cz, face, level, x, y, sqrt({_DIST}), level < {LEVELS} AND {near} FROM ({_NODE} FROM (SELECT camera, cx, cy, cz, face, level + 1 AS level, x * 2 + a AS x, y * 2 + b AS y FROM {out}_q, range(2) ta(a), range(2) tb(b) WHERE split))),
{out} AS (SELECT camera, face, level, x, y, dist FROM {out}_q WHERE NOT split)"""


def cameras_sql(pick: str, out: str) -> str:
    """CTE: a camera for each user, over the place of one of their events and as high as that tells."""
    return f"{out} AS (SELECT user_id AS camera, x * r AS cx, y * r AS cy, z * r AS cz FROM (SELECT *, {RADIUS} + 300000 + cents * 7 AS r FROM d) WHERE event_id IN (SELECT {pick}(event_id) FROM d GROUP BY user_id))"


def cameras(spark, sf_dir, pick) -> DataFrame:
    d = on_faces(spark, sf_dir)
    r = RADIUS + 300000 + F.col("cents") * 7
    each = d.groupBy("user_id").agg(pick(F.struct("x", "y", "z", "cents"), "event_id").alias("e")).select(F.col("user_id").alias("camera"), "e.*")
    return each.select("camera", *[(F.col(c) * r).alias(f"c{c}") for c in "xyz"])


@query(f"WITH RECURSIVE {E}, {DIR}, {cameras_sql('min', 'c')}, {leaves_sql('c', 'l')} SELECT camera, face, level, x, y FROM l")
def q34_quadtree(spark, sf_dir):
    return quadtree.select_leaves(cameras(spark, sf_dir, F.min_by), RADIUS, max_level=LEVELS).drop("dist")


@query(f"""WITH RECURSIVE {E}, {DIR}, {cameras_sql('min', 'c')}, {leaves_sql('c', 'was')}, {cameras_sql('max', 'c2')}, {leaves_sql('c2', 'want')}
SELECT camera, face, level, x, y, 'drop' AS action FROM was ANTI JOIN want USING (camera, face, level, x, y)
UNION ALL SELECT camera, face, level, x, y, 'build' FROM (SELECT * FROM want ANTI JOIN was USING (camera, face, level, x, y)) QUALIFY row_number() OVER (PARTITION BY camera ORDER BY dist, face, level, x, y) <= 5""")
def q90_camera_budgets(spark, sf_dir):
    was, wanted = (tables.settled(quadtree.select_leaves(cameras(spark, sf_dir, pick), RADIUS, max_level=LEVELS)) for pick in (F.min_by, F.max_by))
    return quadtree.patch_changes(wanted, was.drop("dist"), 5, keys=["camera"])


@query(f"WITH {E}, {DIR} SELECT event_id, round(sqrt(pow(x - 0.6, 2) + pow(y - 0.0, 2) + pow(z - 0.8, 2)), 6) + 0.0 AS dist FROM d ORDER BY round(sqrt(pow(x - 0.6, 2) + pow(y - 0.0, 2) + pow(z - 0.8, 2)), 6), event_id LIMIT 12")
def q35_nearest_topk(spark, sf_dir):
    x, y, z = (F.col(c) for c in "xyz")
    d = F.sqrt((x - 0.6) * (x - 0.6) + y * y + (z - 0.8) * (z - 0.8))
    return on_faces(spark, sf_dir).select("event_id", r6(d).alias("dist")).orderBy("dist", "event_id").limit(12)


@query("""SELECT 'idle' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'unknown', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'active', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def q36_set_difference(spark, sf_dir):
    have, want = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    parts = [("idle", have.join(want, "k", "left_anti")), ("unknown", want.join(have, "k", "left_anti").distinct()), ("active", have.join(want, "k", "left_semi"))]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT o_orderpriority, m AS month, round(avg(c) / 100, 4) + 0.0 AS mean, CAST(max(c) - min(c) AS BIGINT) AS range, CAST(sum(c) AS BIGINT) AS total
FROM (SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS c FROM orders) GROUP BY 1, 2""")
def q37_monthly_summary(spark, sf_dir):
    months = read(spark, sf_dir, "orders").select("o_orderpriority", F.month("o_orderdate").alias("month"), cents("o_totalprice").alias("c"))
    out = tables.monthly_summary(months.withColumn("m", F.col("month")), ["o_orderpriority", "m"], "c", expected=0)
    return out.select("o_orderpriority", F.col("m").alias("month"), (F.round(F.col("mean") / 100, 4) + 0.0).alias("mean"), "range", "total")


@query(f"""WITH {V}, c AS (SELECT vec_id, i // 2 AS ci, j // 2 AS cj, avg(x) AS x FROM v GROUP BY 1, 2, 3), o AS (SELECT vec_id AS patch, vec_id % 3 * 2 AS i0, vec_id % 2 * 2 AS j0 FROM embeddings)
SELECT o.patch, round((SELECT sum(x) FROM v WHERE v.vec_id = o.patch AND v.i BETWEEN i0 AND i0 + 3 AND v.j BETWEEN j0 AND j0 + 3), 6) + 0.0 AS fine,
 round((SELECT sum(x) FROM c WHERE c.vec_id = o.patch AND ci BETWEEN i0 // 2 AND i0 // 2 + 1 AND cj BETWEEN j0 // 2 AND j0 // 2 + 1), 6) + 0.0 AS coarse FROM o""")
def q38_band_join(spark, sf_dir):
    v = patches(spark, sf_dir).select(F.col("vec_id").alias("face"), "i", "j", "x")
    context = resample.block_mean(v, 2, ["x"], keys=["face"])
    origins = v.select(F.col("face").alias("patch"), "face").distinct().withColumn("i0", F.col("patch") % 3 * 2).withColumn("j0", F.col("patch") % 2 * 2)
    both = resample.patch_with_context(v, context, origins, 4, 0, 2, "x")
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return both.select("patch", total("x").alias("fine"), total("ctx_x").alias("coarse"))


@query("""SELECT lower(split_part(r_name, ' ', 1)) || '/' || lower(n_name) AS name, lower(split_part(r_name, ' ', 1)) AS subdir,
 'data/' || lower(split_part(r_name, ' ', 1)) || '/' || n_name || '.zip' AS path, strftime(make_date(2004, 1 + n_nationkey % 12, 1), '%B') AS month
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q39_source_registry(spark, sf_dir):
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat_ws("/", F.lower(F.split_part("r_name", F.lit(" "), F.lit(1))), F.lower("n_name"))
    rows = both.select(name.alias("name"), F.concat("n_name", F.lit(".zip")).alias("filename"), F.format_string("2004%02d", (F.col("n_nationkey") % 12 + 1).cast("int")).alias("code"))
    subdir = F.split_part("name", F.lit("/"), F.lit(1))
    return rows.select("name", subdir.alias("subdir"), registry.raw_path(F.lit("data"), subdir, F.col("filename")).alias("path"), registry.month_of_2004(F.col("code")).alias("month"))


INVENTORY = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6, "labels": 3, "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, {n}::BIGINT AS columns, count(*) AS rows FROM {t}" for t, n in INVENTORY.items()))
def q40_layer_inventory(spark, sf_dir):
    return tables.layer_inventory({t: read(spark, sf_dir, t) for t in INVENTORY})


@query("SELECT o_orderkey % 24 AS i, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 4 = 0 GROUP BY 1")
def q41_strided_scan(spark, sf_dir):
    return tables.strided(read(spark, sf_dir, "orders"), 4, "o_orderkey", "o_custkey").groupBy((F.col("o_orderkey") % 24).alias("i")).agg(F.count("*").alias("n"))


@query(f"""WITH {G}, x AS (SELECT a.i, a.j, any_value(a.h) AS h, max(b.h) - min(b.h) AS spread FROM g a JOIN g b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j)
SELECT i, j, h FROM x WHERE spread < 150000 AND h > 0""")
def q42_flat_land(spark, sf_dir):
    return windows.extrema(grid(spark, sf_dir), "h", 2).where("hi - lo < 150000 and h > 0").select("i", "j", "h")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def x01_tumbling_windows(spark, sf_dir):
    return tumbling_counts(read(spark, sf_dir, "events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from spheregrid.plans import globe  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
