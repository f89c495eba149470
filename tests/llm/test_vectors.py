from __future__ import annotations

import math

import numpy as np

from spheregrid.llm.forest import forest_search
from spheregrid.llm.topk import exact_topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def vectors(n=400, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    x = (centres[rng.integers(20, size=n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:110] = x[50]  # a common vector: many ties
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, None), (1001, [nan] * dim, None), (1002, [inf] + [0.0] * (dim - 1), None), (1003, [None] + [1.0] * (dim - 1), None), (1004, [0.0] * dim, None), (None, rows[3][1], None)]
    return rows


def usable(rows, zero):
    return [(i, e) for i, e, _ in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e) and (zero or any(e))]


def test_exact_topk(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, exact_topk(table, table.where("vec_id % 50 = 0"), k=5, group=64).collect()))
    ints = [(i, [math.floor(256 * v) for v in e]) for i, e in usable(rows, True)]
    want = []
    for q, a in ints:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_exact_topk_small(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0], None), (50, [1.0, 0.5], None), (50, [1.0, 0.5], None), (3, [1.0], None)], SCHEMA)
    got = sorted(map(tuple, exact_topk(table, table.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 50, 131072), (0, 2, 50, 131072), (50, 1, 0, 131072)]
    assert exact_topk(table.where("false"), table.where("false")).collect() == []


def test_forest_scores_candidates_only(spark):
    """Clustered vectors: a query is scored against little of the table, summed over all trees."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(60, size=3000)] + 0.05 * rng.standard_normal((3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 50 = 0")
    scored = [r["scored"] for r in forest_search(table, asked, k=5, cell=400, report=True).collect()]
    assert len(scored) == 60 and sum(scored) / len(scored) < 3000 * 16 / 10
    found = forest_search(table, asked, k=5, cell=400).collect()
    best = np.argsort(-(x @ x.T), axis=1)
    want = {q: [int(v) for v in best[q] if v != q][:5] for q in range(0, 3000, 50)}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.9 * 5 * 60


def test_forest_recall(spark):
    rows = vectors(1500, 32)
    table = spark.createDataFrame(rows, SCHEMA)
    found = forest_search(table, table.where("vec_id % 20 = 0"), k=10, cell=300).collect()
    own = usable(rows, False)
    x, ids = np.array([e for _, e in own]), np.array([i for i, _ in own])
    hit = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [i for i in ids if i % 20 == 0]
    for q, mine in by.items():
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        scores = x @ x[ids == q][0]
        assert all(abs(scores[ids == v][0] - s) < 1e-9 for _, v, s in mine)
        least = np.sort(scores[ids != q])[-10]
        hit += sum(s >= least - 1e-9 for _, _, s in mine)
        total += 10
    assert hit / total >= 0.9


def test_forest_small(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], None), (1, [1.0, 0.0], None), (2, [0.0, 1.0], None), (20, [0.5, 0.5], None)], SCHEMA)
    got = sorted(map(tuple, forest_search(table, table.where("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (0, 3, 2, 0.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert forest_search(table.where("false"), table.where("false")).collect() == []
