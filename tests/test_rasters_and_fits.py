"""Operators on rasters and robust fits in the cases that given tables don't hold."""

import numpy as np
import pytest

from groundweave.operators import adjust, raster


def test_bilinear_keeps_repeated_points_and_whole_grids(spark):
    cells = [(g, r, c, float(10 * r + c)) for g, rows in ((0, 9), (1, 3)) for r in range(rows) for c in range(5) if (g, r, c) != (0, 4, 2)]
    dem = spark.createDataFrame(cells, "grid_id long, r long, c long, v double")
    rows = [(1, 0, 5.5, 1.25), (1, 0, 5.5, 1.25), (1, 0, 5.5, 1.25), (2, 0, -3.0, 9.0), (3, 1, 7.5, 2.0), (4, 0, 3.5, 2.0), (5, 0, 4.0, 2.5), (6, None, 1.0, 1.0), (7, 9, 1.0, 1.0), (8, 0, None, 1.0), (9, 0, 3.0, 2.0)]
    points = spark.createDataFrame(rows, "id long, grid_id long, line double, samp double").selectExpr("*", "1 AS r", "2 AS k", "3 AS v")
    got = sorted((r["id"], r["height"]) for r in raster.dem_bilinear(points, dem).select("id", "height").collect())
    assert got == [(1, 56.25)] * 3 + [(2, 4.0), (3, 22.0), (4, None), (5, None), (6, None), (7, None), (8, None), (9, 32.0)]


def test_confident_matches_know_each_image_by_its_cells(spark):
    conf = spark.createDataFrame([(i, r, c, 0.9 if r == n - 1 else 0.1) for i, n in ((0, 3), (1, 6)) for r in range(n) for c in range(4)], "img long, r long, c long, conf double")
    rows = [(7, 0, 1, 1.0, 2.5, 1.0, 5.5), (7, 0, 1, 3.0, 99.0, 0.0, 99.0), (7, 0, 1, 3.0, 99.0, 0.0, 99.0), (7, 0, 1, 9.0, 2.0, -4.0, 5.0), (7, 0, 1, 1.0, 1.9, 1.0, 5.5), (8, 0, 1, 1.0, 2.5, 1.0, 5.5), (7, 0, 5, 1.0, 2.5, 1.0, 5.5)]
    matches = spark.createDataFrame(rows, "group_id long, img_a long, img_b long, xa double, ya double, xb double, yb double")
    got = raster.confident_matches(matches, conf, scale=1.0).collect()
    assert sorted((r["group_id"], r["xa"], r["yb"]) for r in got) == [(7, 1.0, 5.5), (7, 3.0, 99.0), (7, 3.0, 99.0), (7, 9.0, 5.0)]


@pytest.mark.parametrize("kind", ["A", "H", "R"])
def test_ransac_takes_null_pairs_and_finds_the_plant(spark, kind):
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 100, (60, 2))
    m = {"A": [[0.9, 0.2, 5], [-0.1, 1.1, -3], [0, 0, 1]], "R": [[0.6, -0.8, 4], [0.8, 0.6, 1], [0, 0, 1]], "H": [[1, 0.1, 2], [0.05, 0.9, 1], [1e-3, 5e-4, 1]]}[kind]
    q = np.column_stack([src, np.ones(60)]) @ np.array(m).T
    dst = q[:, :2] / q[:, 2:]
    dst[::3] += 50
    rows = [(k, *a, *b) for k in (3, None) for a, b in zip(src.tolist(), dst.tolist(), strict=True)] + [(None, None, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0, 1.0)]
    got = {r["pair_id"]: r for r in adjust.ransac_transform(spark.createDataFrame(rows, "pair_id long, ya double, xa double, yb double, xb double"), kind).collect()}
    assert {k: (r["n"], r["n_inliers"]) for k, r in got.items()} == {3: (60, 40), None: (60, 40), 4: (1, 0)} and got[4]["m"] is None
    assert all(np.allclose(got[k]["m"], np.array(m)[: 3 if kind == "H" else 2].ravel(), atol=1e-5) for k in (3, None))


def test_window_affines_of_null_pairs(spark):
    h = [1.0, 0.0, -50.0, 0.0, 1.0, -20.0, 0.0, 0.0, 1.0]
    rows = [(k, w, h, [1.0, 0.0, 3.0 + 1000 * (w == 5), 0.0, 1.0, -2.0], 1.0) for k in (1, None) for w in range(9)]
    got = adjust.merge_window_affines(spark.createDataFrame(rows, "pair_id long, window_id long, h array<double>, m array<double>, score double")).collect()
    assert {r["pair_id"] for r in got} == {1, None} and all(np.allclose(r["m"], [1, 0, 3, 0, 1, -2], atol=1e-6) for r in got)


def test_samples_hold_different_points():
    draws = adjust._draws(5, 4, 3000, 0)
    assert all(len(set(d)) == 4 for d in draws.tolist()) and np.abs(np.bincount(draws.ravel()) / 2400 - 1).max() < 0.1
