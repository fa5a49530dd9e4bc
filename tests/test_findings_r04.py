"""Round 4: pairs without a shuffle of pairs, and what larger tables take."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from groundweave.functions import cameras as C
from groundweave.functions import kernels as K
from groundweave.operators import cameras, spatial
from groundweave.plans import camera_queries
from groundweave.plans.fixtures import fixture
from groundweave.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rings(*corners):
    return [[{"x": float(x), "y": float(y)} for x, y in c] for c in corners]


def test_sums_of_points_shuffle_no_pairs(spark, tmp_path):
    """what is shuffled are scenes, not pairs; numbers of pairs that coincide (scenes beyond 100,000) are added up as in SQL."""
    keys = [k + far for k in range(500) for far in (0, 5_200_000)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["overlap_points"](spark, str(tmp_path))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT pair_id, n, x, y FROM ({ORACLE_SQL['overlap_points']})").fetchall()}
    got = {r["pair_id"]: (r["n"], r["x"], r["y"]) for r in found.collect()}
    assert set(got) == set(want) and max(n for n, *_ in got.values()) > 20
    assert all(g[0] == want[k][0] and np.abs(np.subtract(g[1:], want[k][1:])).max() < 2e-3 for k, g in got.items())


def test_sums_of_points_are_those_of_the_points(spark, monkeypatch):
    """boxes, other rings, a ring twice, one without a number and one without a place, in many small blocks and with numbers that coincide."""
    rng = np.random.default_rng(3)
    made = []
    for i in range(50):
        (x, y), (w, h) = rng.uniform(0, 20, 2), rng.uniform(2, 9, 2)
        box = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        made.append((i - 4, box if i % 3 else K.hull(box + rng.uniform(-1, 1, (4, 2)))))
    made += [(5, made[9][1]), (None, made[3][1]), (60, [(float("nan"), 1), (2, 1), (2, 3)])]
    scenes = spark.createDataFrame([(i, rings(ring)[0]) for i, ring in made], f"scene_id long, ring {spatial.RING}")
    pairs = spatial.overlap_rings(scenes, 1.0).where("i < 60 and j < 60").select((F.col("i") * 7 + F.col("j")).alias("pair_id"), F.lit(9).alias("k"), F.col("shared").alias("ring"))
    drawn = spatial.overlap_points(pairs).groupBy("pair_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    want = {r["pair_id"]: (r["n"], r["x"], r["y"]) for r in drawn.collect()}
    for most in (spatial.BLOCK_ROWS, 6):
        monkeypatch.setattr(spatial, "BLOCK_ROWS", most)
        got = {r["pair_id"]: (r["n"], r["x"], r["y"]) for r in spatial.overlap_point_sums(scenes, 1.0, 9, base=7).collect()}
        assert set(got) == set(want) and max(n for n, *_ in want.values()) > 9
        assert all(np.abs(np.subtract(got[k], want[k])).max() < 1e-6 for k in want)


def test_models_are_not_broadcast(spark, monkeypatch):
    """models that are small as a file may be large in memory; a range fetches its own by a shuffle."""
    scenes = camera_queries.scenes(lambda name: fixture(spark, SF, name))
    monkeypatch.setattr(cameras, "written", lambda df, tag: df)
    ranged = spark.range(40).select((F.col("id") % 10).alias("scene_id"), (F.col("id") % 3).alias("_b"))
    models = cameras._models_of(ranged, scenes, "scene_id")
    assert "Broadcast" not in models._jdf.queryExecution().executedPlan().toString()
    assert models.select("_b", "scene_id").distinct().count() == models.count() == 30


def test_equal_models_are_refitted_once(spark, monkeypatch):
    """what differs in one bit is fitted by itself, what is equal is not fitted again, and older refits go."""
    model = camera_queries.scenes(lambda name: fixture(spark, SF, name)).where("scene_id = 4").first()["rpc"].asDict()
    made = []

    def fit(m, xy, z):
        made.append(m)
        return C.bake(m, xy, z)

    once = C.Refits(fit, 8, 6)
    other = {**model, "lat_off": float(np.nextafter(model["lat_off"], 99))}
    assert once(dict(model)) == once(dict(model)) == C.bake(model, 8, 6) and len(made) == 1
    assert once(other) == C.bake(other, 8, 6) and once({**model, "adj": None})["adj"] is None and len(made) == 3
    monkeypatch.setattr(C, "KEPT", 3)
    once({**model, "samp_off": 1.0})
    once(model)
    assert len(once.kept) == 3 and len(made) == 5


def test_rings_that_bend_inwards_lose_no_pair(spark):
    """the areas of L-shaped rings, boxes and diamonds by the boxes that they consist of; whichever of a pair bends inwards."""
    rng = np.random.default_rng(5)
    box = lambda x0, y0, x1, y1: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    made = []
    for i in range(36):
        x, y, w, h = *rng.uniform(0, 8, 2), *rng.uniform(4, 9, 2)
        if i % 3 == 0:
            made.append((box(x, y, x + w, y + h), [box(x, y, x + w, y + h)]))
        elif i % 3 == 1:
            bend = np.array([(x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h)])
            made.append((bend[:: 1 if i % 2 else -1], [box(x, y, x + w, y + 1), box(x, y + 1, x + 1, y + h)]))
        else:
            diamond = np.array([(x, y - h / 2), (x + w / 2, y), (x, y + h / 2), (x - w / 2, y)])
            made.append((diamond, [diamond]))
    cut = lambda p, q: abs(K.areas(*K.clip(*K.as_batch([p.ravel()]), *K.as_batch([q.ravel()])))[0])
    want = {(i, j): area for i in range(36) for j in range(i + 1, 36) if (area := sum(cut(p, q) for p in made[i][1] for q in made[j][1])) >= 0.5}
    scenes = spark.createDataFrame(list(enumerate(rings(*(ring for ring, _ in made)))), f"scene_id long, ring {spatial.RING}")
    got = {(r["i"], r["j"]): r for r in spatial.overlap_rings(scenes, 0.5).collect()}
    assert set(got) == set(want) and all(abs(got[k]["area"] - want[k]) < 1e-9 for k in want)
    for (i, j), r in got.items():
        shared = np.array([(p["x"], p["y"]) for p in r["shared"]]).ravel()
        assert len(shared) == 0 if i % 3 == j % 3 == 1 else abs(abs(K.areas(*K.as_batch([shared]))[0]) - want[i, j]) < 1e-9
    sums = spatial.overlap_point_sums(scenes, 0.5, 3).collect()
    assert {r["pair_id"]: r["x"] is None for r in sums} == {i * 100_000 + j: i % 3 == j % 3 == 1 for i, j in want}


def test_pairs_at_the_least_area_stay(spark):
    """the area of a clip may be a rounding over the product of its box's sides."""
    rng = np.random.default_rng(0)
    for _ in range(1000):
        x0, y0, x1, y1 = (*rng.uniform(0, 3, 2), *rng.uniform(5, 9, 2))
        closed = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
        around = [(-1, -1), (20, -1), (20, 20), (-1, 20)]
        area = abs(K.areas(*K.clip(*K.as_batch([closed.ravel()]), *K.as_batch([np.ravel(around)])))[0])
        if (x1 - x0) * (y1 - y0) < area:
            scenes = spark.createDataFrame(list(enumerate(rings(closed, around))), f"scene_id long, ring {spatial.RING}")
            assert [(r["i"], r["j"]) for r in spatial.overlap_pairs(scenes, float(area)).collect()] == [(0, 1)]
            return
    raise AssertionError("no such ring")
