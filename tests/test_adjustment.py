"""The block adjustment and the residuals of ties: ranges that fetch their own models, components, and the solve on tables."""

import numpy as np
import pytest

from groundweave.functions import cameras as C
from groundweave.operators import cameras as O

N = 10


def _model(k: int) -> dict:
    one, z = [1.0] + [0.0] * 19, [0.0] * 20
    put = lambda **at: [at.get(f"t{i}", 0.0) for i in range(20)]
    scalars = dict(zip(C.SCALARS, (500.0, 500.0, 30.0, 100.0 + 0.0002 * k, 500.0, 500.0, 500.0, 0.01, 0.01, 500.0), strict=True))
    own = dict(lnum=put(t2=-1.0, t1=0.02 * k), lden=one, snum=put(t1=1.0, t3=0.05), sden=one, latnum=z, latden=one, lonnum=z, londen=one)
    return C.fit_inverse({**scalars, **own, "adj": list(C.IDENTITY)}, 12, 6)


MODELS = {k: _model(k) for k in range(1, N + 1)}
PLANTED = {k: np.array([1 + 0.001 * (k - 1), 0.0005 * (k - 1), 2.0 * (k - 1), -0.0004 * (k - 1), 1 - 0.0007 * (k - 1), -1.5 * (k - 1)]) for k in MODELS}


def _seen(k, lat, lon, h):
    """Where scene k sees ground points if its planted affine takes what it sees to what its model says."""
    return np.stack(C.to_photo({**MODELS[k], "adj": PLANTED[k].tolist()}, lat, lon, h), axis=1)


@pytest.fixture(scope="module")
def block(spark):
    """Scenes 1..7 in a chain with the anchor 1 at its end, 8 and 9 apart from it, 10 without ties."""
    rng = np.random.default_rng(4)
    rows = []
    for i, j in [(k, k + 1) for k in range(1, 7)] + [(1, 3), (4, 6), (8, 9)]:
        lat, lon, h = 30 + rng.uniform(-0.008, 0.008, 60), 100 + rng.uniform(-0.008, 0.008, 60), rng.uniform(300, 700, 60)
        rows += [(i, j, *a, *b, z) for a, b, z in zip(_seen(i, lat, lon, h).tolist(), _seen(j, lat, lon, h).tolist(), h.tolist(), strict=True)]
    rows += [(1, 77, 1.0, 1.0, 1.0, 1.0, 500.0), (None, 2, 1.0, 1.0, 1.0, 1.0, 500.0)]
    ties = spark.createDataFrame(rows, "i long, j long, line_i double, samp_i double, line_j double, samp_j double, h double")
    return ties, spark.createDataFrame([(k, m) for k, m in MODELS.items()], f"scene_id long, rpc {O.RPC}")


def test_adjustment_finds_planted_affines(block):
    ties, scenes = block
    got = {r["scene_id"]: r for r in O.block_adjustment(ties, scenes, 1, observed=100).collect()}
    assert set(got) == set(MODELS) and max(r["rms"] for r in got.values()) < 1e-3
    assert all(np.allclose(got[k]["m"], C.IDENTITY) for k in (1, 10))
    corners = np.array([[0, 0, 1], [999, 0, 1], [0, 999, 1], [999, 999, 1]], float)
    for k in range(2, 8):
        assert np.abs(corners @ np.reshape(got[k]["m"], (2, 3)).T - corners @ PLANTED[k].reshape(2, 3).T).max() < 0.3, k


def test_solve_on_tables_goes_the_same_way(block):
    ties, scenes = block
    free = ties.where("i < 5 and j < 5")
    want = {r["scene_id"]: r for r in O.block_adjustment(free, scenes, 1, max_iters=1).collect()}
    got = {r["scene_id"]: r for r in O.block_adjustment(free, scenes, 1, max_iters=1, task_blocks=0).collect()}
    for k in want:
        assert np.allclose(got[k]["m"], want[k]["m"], atol=1e-4) and abs(got[k]["rms"] - want[k]["rms"]) < 1e-5


def test_rms_with_and_without_affines(block):
    ties, scenes = block
    before, after = (O.adjustment_rms(ties, scenes, a, observed=90).first()["rms"] for a in (None, {k: m.tolist() for k, m in PLANTED.items()}))
    assert before > 1 and after < 1e-3
    assert O.adjustment_rms(ties.limit(0), scenes).first()["rms"] is None


def test_residuals_in_ranges_equal_those_in_one(block, spark):
    _, scenes = block
    rng = np.random.default_rng(9)
    lat, lon, h = 30 + rng.uniform(-0.008, 0.008, 50), 100 + rng.uniform(-0.008, 0.008, 50), rng.uniform(300, 700, 50)
    rows = []
    for k in (1, 3, 5):
        at = np.stack(C.to_photo(MODELS[k], lat, lon, h), axis=1) + rng.normal(0, 1, (50, 2))
        rows += [(t, k, *p, z) for t, (p, z) in enumerate(zip(at.tolist(), h.tolist(), strict=True)) if (t + k) % 4]
    ties = spark.createDataFrame(rows + [(3, 99, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)], "tie_id long, scene_id long, line double, samp double, h double")
    one, many = ({(r["tie_id"], r["scene_id"]): r["residual"] for r in O.multiview_residuals(ties, scenes, observed=n).collect()} for n in (10_000, 13))
    assert one.keys() == many.keys() == {(t, k) for t, k, *_ in rows}
    assert all(abs(one[x] - many[x]) < 1e-6 for x in one) and 0.3 < np.mean(list(one.values())) < 1.5
    sized = scenes.selectExpr("*", "1000 AS h", "500 AS w")
    pairs = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (None, 3)], "i long, j long")
    got = {(r["i"], r["j"]): r for r in O.pair_tie_errors(pairs, ties, sized, observed=20).collect()}
    assert set(got) == {(1, 3), (1, 2)} and got[1, 2]["n"] == 0 and got[1, 2]["mean"] is None
    places = {(t, k): (line, samp) for t, k, line, samp, _ in rows}
    inside = [t for t in range(50) if all((t, k) in places and 0 <= places[t, k][0] < 1000 and 0 <= places[t, k][1] < 500 for k in (1, 3))]
    assert got[1, 3]["n"] == len(inside) < 40 and got[1, 3]["median"] <= got[1, 3]["max"]


def test_ground_that_never_settles_ends(block, spark):
    """A cliff, over which a point goes to and fro: it keeps its last place."""
    _, scenes = block
    dem = spark.createDataFrame([(1, r, c, 300.0 if c < 2 else 0.0 if c < 3 else 700.0) for r in range(4) for c in range(4)], "grid_id long, r long, c long, v double")
    own = scenes.where("scene_id = 1").selectExpr("scene_id", "rpc", "1000 AS h", "1000 AS w").crossJoin(spark.createDataFrame([([(11130000.0, 3505000.0), (0.0, 0.0), (11134000.0, 3501000.0), (0.0, 0.0)],)], "ring array<struct<x:double,y:double>>"))
    points = spark.createDataFrame([(1, 11131950.0, 3503550.0), (1, 11131950.0, 3503550.0), (2, 1.0, 1.0), (None, 1.0, 1.0)], "scene_id long, x double, y double")
    got = O.xy_to_sampline_on_dem(points, own, dem, max_iter=3, tol=1e-9).collect()
    assert len(got) == 4 and sum(r["line"] is not None for r in got) == 2
