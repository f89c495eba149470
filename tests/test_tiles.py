"""Tile-parallel drainage against plain loops over the whole grid, and how its jobs grow."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spheregrid.operators import hydro, tiles

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def table(spark, h, keep=None):
    return spark.createDataFrame([(i, j, float(h[i, j])) for i in range(h.shape[0]) for j in range(h.shape[1]) if keep is None or keep[i, j]], "i int, j int, h double")


def plain_fill(h, eps, sea=0.0, keep=None):
    """From all outlets outwards, the lowest first."""
    rows, width = h.shape
    f, heap = {}, [(h[i, j], i, j) for i in range(rows) for j in range(width) if (keep is None or keep[i, j]) and (h[i, j] <= sea or i in (0, rows - 1))]
    heapq.heapify(heap)
    while heap:
        level, i, j = heapq.heappop(heap)
        if (i, j) in f:
            continue
        f[i, j] = level
        for a, b in AROUND:
            x, y = i + a, (j + b) % width
            if 0 <= x < rows and (x, y) not in f and (keep is None or keep[x, y]) and not (h[x, y] <= sea or x in (0, rows - 1)):
                heapq.heappush(heap, (max(h[x, y], level + eps), x, y))
    return f


def got(df, *names):
    return {(r["i"], r["j"]): tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def jobs(spark, run):
    """How many jobs a call takes."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize(("size", "width", "eps", "links"), [(5, 23, 0.5, 2_000_000), (4, 9, 0.0, 2_000_000), (3, 13, 1e-3, 10), (64, 12, 2.0, 2_000_000)])
def test_fill_is_the_plain_one(spark, monkeypatch, size, width, eps, links):
    """Lakes over tiles and the seam, flats, missing cells, slopes that a rising lake takes away, and contraction over the cluster."""
    monkeypatch.setattr(tiles, "LINKS", links)
    rng = np.random.default_rng(width)
    h = np.round(rng.random((17, width)) * 12)
    h[4:12, 2:8] = np.minimum(h[4:12, 2:8], 3)
    h[9:15, [0, 1, -1]] = 1
    keep = rng.random(h.shape) > 0.04
    keep[[0, -1]] = True
    want = plain_fill(h, eps, 0.0, keep)
    found = got(hydro.fill_depressions(table(spark, h, keep), 17, width, eps, size=size), "f")
    assert found.keys() == {(i, j) for i in range(17) for j in range(width) if keep[i, j]}
    assert all(abs(v - want[k]) < 1e-9 if k in want else v == float("inf") for k, v in found.items())


def test_large_stretch_goes_by_rounds(spark):
    h = np.full((9, 8), 5.0)
    h[2:7] = 1
    found = got(hydro.fill_depressions(table(spark, h), 9, 8, 0.25, size=4, stretch=3), "f")
    assert found == plain_fill(h, 0.25)


def serpentine(rows, width):
    """One channel a cell wide through walls, back and forth, that falls to a pit at its far end."""
    h = np.full((rows, width), 1000.0)
    path = []
    for k, i in enumerate(range(1, rows - 1, 2)):
        line = list(range(1, width - 1)) if k % 2 == 0 else list(range(width - 2, 0, -1))
        path += [(i, j) for j in line]
        if i + 2 < rows - 1:
            path.append((i + 1, line[-1]))
    for k, (i, j) in enumerate(path):
        h[i, j] = 500.0 - k * 1e-3
    h[0, 1] = 400.0
    return h, path


def test_a_serpentine_takes_as_many_jobs_however_long(spark):
    """One valley, a cell wide, through all tiles again and again: filled, routed, summed and labelled in a fixed number of jobs."""
    counts = []
    for rows, width in ((13, 14), (41, 30)):
        h, path = serpentine(rows, width)
        grid = table(spark, h)
        filled = tiles.settled(hydro.fill_depressions(grid, rows, width, 1e-3, size=7))
        took = jobs(spark, lambda grid=grid, rows=rows, width=width: hydro.fill_depressions(grid, rows, width, 1e-3, size=7).collect())
        assert all(abs(v - plain_fill(h, 1e-3)[k]) < 1e-9 for k, v in got(filled, "f").items())
        valley = grid.where("h < 1000 and i > 0")
        assert [r["count"] for r in hydro.regions(valley, width, size=7).groupBy("label").count().collect()] == [len(path)]
        took_regions = jobs(spark, lambda valley=valley, width=width: hydro.regions(valley, width, size=7).collect())
        counts.append((took, took_regions))
    # Adaptive execution may cut a plan into a job or two more; six times the length doesn't.
    assert all(abs(a - b) <= 3 for a, b in zip(*counts, strict=True)), counts


@pytest.mark.parametrize("links", [2_000_000, 4])
def test_regions_of_a_spiral(spark, monkeypatch, links):
    monkeypatch.setattr(tiles, "LINKS", links)
    n = 25
    wall = np.zeros((n, n), bool)
    i = j = 0
    di, dj = 0, 1
    seen = {(0, 0)}
    while True:
        a, b = i + di, j + dj
        ahead = (i + 2 * di, j + 2 * dj)
        if not (0 <= a < n and 0 <= b < n) or ahead in seen:
            di, dj = dj, -di
            a, b = i + di, j + dj
            if (a, b) in seen or (i + 2 * di, j + 2 * dj) in seen:
                break
        i, j = a, b
        seen.add((i, j))
    for i, j in seen:
        wall[i, j] = True
    cells = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if wall[i, j]], "i int, j int")
    assert {r["label"] for r in tiles.regions(cells, n, 4).collect()} == {0}
    # What the spiral leaves free isn't linked with it; diagonal neighbours and the seam are links only where asked for.
    few = spark.createDataFrame([(0, 0), (1, 1), (5, 0), (5, 9), (4, 4), (4, 5)], "i int, j int")
    assert got(tiles.regions(few, 10, 5), "label") == {(0, 0): 0, (1, 1): 11, (5, 0): 50, (5, 9): 59, (4, 4): 44, (4, 5): 44}
    assert got(tiles.regions(few, 10, 5, diagonal=True, wrap=True), "label") == {(0, 0): 0, (1, 1): 0, (5, 0): 50, (5, 9): 50, (4, 4): 44, (4, 5): 44}
    assert got(tiles.regions(few, 10, 64, wrap=True), "label")[5, 9] == 50


@pytest.mark.parametrize("size", [3, 100])
def test_forest_by_tiles(spark, size):
    """Sums, depths and incision by tiles are those by pointer jumping over all cells."""
    rng = np.random.default_rng(4)
    h = np.round(rng.random((14, 17)) * 40) - 6
    grid = tiles.settled(hydro.fill_depressions(table(spark, h), 14, 17, 1e-3, size=size))
    forest = tiles.settled(hydro.receivers(grid, "f", 17).join(grid.select((F.col("i") * 17 + F.col("j")).cast("long").alias("c"), "h"), "c").withColumn("n", F.col("c") % 5 + 1).withColumn("factor", F.col("n") / 10))
    for kind in ("long", "double"):
        one = forest.withColumn("n", F.col("n").cast(kind))
        assert hydro.accumulate(one, "n", width=17, size=size).exceptAll(hydro.accumulate(one, "n")).isEmpty()
        assert hydro.accumulate(one, "n", width=17, size=size).count() == 14 * 17
    assert sorted(hydro.flow_depth(forest, 17, size).collect()) == sorted(hydro.flow_depth(forest).collect())
    a, b = ({r["c"]: r["h2"] for r in df.collect()} for df in (hydro.incise(forest, "factor", width=17, size=size), hydro.incise(forest, "factor")))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_accumulation_sends_perimeters(spark, monkeypatch):
    """What takes rounds are the cells where ways leave tiles, not all cells."""
    sent = []
    plain = hydro.accumulate
    monkeypatch.setattr(hydro, "accumulate", lambda forest, *a, **k: (sent.append(forest.count()), plain(forest, *a, **k))[1])
    forest = spark.range(64 * 64).select(F.col("id").alias("c"), F.when(F.col("id") % 64 > 0, F.col("id") - 1).otherwise(F.col("id")).alias("rec"), F.lit(1).cast("long").alias("n"))
    out = tiles.accumulate(forest, "n", "acc", 64, 16, hydro.accumulate)
    assert out.where("c % 64 = 0").agg(F.min("acc"), F.max("acc")).first() == (64, 64)
    assert sent == [64 * 3]
