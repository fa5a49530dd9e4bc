"""Projections and warped crops."""

import numpy as np
import pandas as pd

from groundweave.functions import projections as P
from groundweave.operators import crops

UTM = {c.epsg: c for c in P.known_systems()}


def test_transverse_mercator_of_known_places():
    x, y = P.from_lonlat(UTM[32617], -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)
    assert abs(x - 630084) < 1 and abs(y - 4833438) < 1
    assert np.allclose(P.from_lonlat(UTM[32631], [3.0, 3.0], [0.0, 45.0])[0], 500_000)
    assert np.allclose(P.from_lonlat(UTM[32731], 3.0, 0.0), (500_000, 10_000_000)) and abs(P.from_lonlat(UTM[32631], 3.0, 0.0)[1]) < 1e-6


def test_projections_go_back():
    rng = np.random.default_rng(0)
    for crs in (UTM[4326], UTM[3857], UTM[32633], UTM[32760], P.Crs(9, "transverse", "foot", 0.3048, 14.0, 0.9999, 1e5, 2e5)):
        lon, lat = crs.lon0 + rng.uniform(-3, 3, 100), rng.uniform(-80, 80, 100)
        back = P.to_lonlat(crs, *P.from_lonlat(crs, lon, lat))
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9


def test_warp_equals_point_by_point(spark):
    """A raster of degrees in high latitude on a UTM window: bent footprint, missing values, mask, tiles of which most stay away."""
    rng = np.random.default_rng(2)
    rows, cols, tile, out, step = 200, 300, 16, 40, 0.0005
    band = rng.normal(100, 10, (rows, cols)).astype("float32")
    band[rng.uniform(size=band.shape) < 0.05] = np.nan
    marks = (rng.uniform(size=band.shape) > 0.1).astype(int)
    cells = [(5, r // tile, c // tile) for r in range(0, rows, tile) for c in range(0, cols, tile)]
    data = []
    for s, a, b in cells:
        part, own = band[a * tile : (a + 1) * tile, b * tile : (b + 1) * tile], marks[a * tile : (a + 1) * tile, b * tile : (b + 1) * tile]
        data.append((s, a, b, part.shape[0], part.shape[1], [float(x) for x in part.ravel()], [int(x) for x in own.ravel()]))
    tiles = spark.createDataFrame(data, "scene_id long, tile_r int, tile_c int, h int, w int, v array<float>, mask array<int>")
    rasters = spark.createDataFrame([(5, 4326, 12.0, 65.0, step, step, rows, cols), (6, 1, 0.0, 0.0, 1.0, 1.0, 9, 9)], "scene_id long, epsg int, x0 double, y0 double, dx double, dy double, rows int, cols int")
    x, y = P.from_lonlat(UTM[32633], 12.05, 64.97)
    windows = spark.createDataFrame([(5, 1, 32633, float(x), float(y), 2000.0), (5, 2, 32633, 0.0, 0.0, 10.0), (6, 3, 32633, float(x), float(y), 10.0), (5, 4, 7, 0.0, 0.0, 1.0)], "scene_id long, window_id long, epsg int, left double, top double, size double")
    got = crops.warped_crops(tiles, rasters, windows, crops.crs_table(spark), tile, out, 0.1).collect()
    assert [(r["scene_id"], r["window_id"]) for r in got] == [(5, 1)]
    v, mask = np.full((out, out), np.nan), np.zeros((out, out), bool)
    for i in range(out):
        for j in range(out):
            lon, lat = P.to_lonlat(UTM[32633], x + (j + 0.5) * 50, y - (i + 0.5) * 50)
            r, c = (65.0 - lat) / step - 0.5, (lon - 12.0) / step - 0.5
            near = [(a, b, abs(1 - abs(r - a)) * abs(1 - abs(c - b))) for a in (int(np.floor(r)), int(np.floor(r)) + 1) for b in (int(np.floor(c)), int(np.floor(c)) + 1)]
            ok = [(band[a, b], w) for a, b, w in near if np.isfinite(band[a, b])]
            if ok:
                v[i, j] = sum(x * w for x, w in ok) / sum(w for _, w in ok)
            mask[i, j] = marks[int(np.floor(r + 0.5)), int(np.floor(c + 0.5))] > 0
    row = got[0]
    assert np.allclose(np.reshape(row["v"], (out, out)), v, atol=1e-3, equal_nan=True) and np.array_equal(np.reshape(row["mask"], (out, out)), mask)
    valid = mask & np.isfinite(v)
    assert abs(row["ratio"] - valid.mean()) < 1e-9 and np.all(np.reshape(row["level"], (out, out))[~valid] == 0) and max(row["level"]) == 255
    assert len(crops._footprint_tiles(crops._Warp(pd.Series({"_own": UTM[4326]._asdict(), "_to": UTM[32633]._asdict(), "x0": 12.0, "y0": 65.0, "dx": step, "dy": step, "left": x, "top": y, "size": 2000.0}), out), out, tile, rows, cols)) < len(cells) // 3
    assert crops.warped_crops(tiles, rasters, windows, crops.crs_table(spark), tile, out, 0.95).count() == 0
