"""Ways that larger tables take, on small ones."""

import numpy as np
from pyspark.sql import functions as F

from groundweave.functions import cameras as C
from groundweave.functions import kernels as K
from groundweave.operators import cameras, crops, raster, spatial
from groundweave.plans import camera_queries
from groundweave.plans.fixtures import fixture
from groundweave.sources import files
from groundweave.sources.shared import spread

SF = "/root/testdata/sf0.001"


def tables(spark):
    return lambda name: fixture(spark, SF, name)


def test_ranges_of_points_fetch_their_models(spark, monkeypatch):
    """Many scenes, one of them hot, one unknown and one null, without a group for each scene."""
    t = tables(spark)
    scenes = camera_queries.scenes(t)
    k = F.col("id")
    scene = F.when(k < 300, 5).when(k == 300, 10**6).when(k == 301, F.lit(None)).otherwise(k % 10)
    points = spark.range(600).select(scene.cast("long").alias("scene_a"), (k % 7).alias("scene_b"), (k * 10.0).alias("line"), (k * 7.0).alias("samp"), (k % 5 * 100.0).alias("h"))
    one = sorted(map(str, cameras.project_between_scenes(points, scenes).collect()))
    back = sorted(map(str, cameras.rpc_roundtrip_check(scenes, 5, 3, 1e-12).collect()))
    monkeypatch.setattr(cameras, "BROADCAST_SCENES", 3)
    monkeypatch.setattr(cameras, "PROJECTED", 100)
    assert sorted(map(str, cameras.project_between_scenes(points, scenes).collect())) == one and len(one) == 600
    assert sorted(map(str, cameras.rpc_roundtrip_check(scenes, 5, 3, 1e-12).collect())) == back


def test_two_fits_at_once_are_those_of_the_whole_system():
    """the normal matrix from sums of products of terms, with points left out, against the columns side by side."""
    rng = np.random.default_rng(0)
    p, l, h = rng.uniform(-1, 1, (3, 900))
    t, ok = C.terms(p, l, h), rng.uniform(size=900) > 0.2
    values = [(p + 0.1 * l * h) / (1 + 0.05 * p), l - 0.2 * h]
    for (num, den), v in zip(C.fit_ratios(t, C._products(p, l, h), ok, *values), values, strict=True):
        assert np.abs(t @ num / (t @ den) - v).max() < 1e-6
        a = np.concatenate([t, -v[:, None] * t[:, 1:]], axis=1)[ok]
        assert np.abs(a.T @ (v[ok] - a @ np.concatenate([num, den[1:]]))).max() < 1e-6


def rings(*corners):
    return [[{"x": float(x), "y": float(y)} for x, y in c] for c in corners]


def test_overlaps_of_boxes_and_other_rings(spark, monkeypatch):
    """boxes by their bounds, other rings by clipping, in full cells too; against all pairs."""
    rng = np.random.default_rng(1)
    made = []
    for i in range(60):
        (x, y), (w, h) = rng.uniform(0, 30, 2), rng.uniform(2, 12, 2)
        box = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        made.append(box if i % 3 else K.hull(box + rng.uniform(-1, 1, (4, 2))))
    scenes = spark.createDataFrame(list(enumerate(rings(*made))), f"scene_id long, ring {spatial.RING}")
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            area = abs(K.areas(*K.clip(*K.as_batch([made[i].ravel()]), *K.as_batch([made[j].ravel()])))[0])
            if area >= 2:
                want[i, j] = area
    for full in (spatial.CELL_ROWS, 5):
        monkeypatch.setattr(spatial, "CELL_ROWS", full)
        got = spatial.overlap_rings(scenes, 2.0).collect()
        assert len(got) == len(want) and all(abs(want[r["i"], r["j"]] - r["area"]) < 1e-9 for r in got)
        for r in got:
            shared = np.array([(p["x"], p["y"]) for p in r["shared"]]).ravel()
            assert abs(abs(K.areas(*K.as_batch([shared]))[0]) - r["area"]) < 1e-9
    kinds = [r[0] for r in scenes.orderBy("scene_id").select(spatial.is_box(F.col("ring"))).collect()]
    assert kinds == [i % 3 != 0 for i in range(60)]


def test_pairs_of_boxes_are_dealt_to_tasks(spark):
    """a small file is one partition, but its pairs are not one task, nor sent to each."""
    scenes = spark.createDataFrame([(i, rings([(i, 0), (i + 3, 0), (i + 3, 2), (i, 2)])[0]) for i in range(40)], f"scene_id long, ring {spatial.RING}").coalesce(1)
    plan = spatial.overlap_pairs(scenes, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "ArrowEvalPython" not in plan


def test_windows_that_two_footprints_meet(spark):
    """diamonds that touch a window apart from each other do not count, two that meet in it do, in whatever part they lie."""
    diamond = lambda x, y, r: [(x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    cells = spark.createDataFrame(list(zip((1, 2, 3), rings(*([(x, 0), (x + 4, 0), (x + 4, 4), (x, 4)] for x in (0, 10, 20))), strict=True)), f"window_id long, ring {spatial.RING}")
    prints = [diamond(0, 0, 1.9), diamond(4, 4, 1.9), diamond(0, 4, 1.9), diamond(4, 0, 1.9), diamond(10, 0, 2), diamond(12, 0, 2), diamond(14, 4, 1), diamond(20, 2, 1)]
    footprints = spark.createDataFrame(list(enumerate(rings(*prints))), f"img long, ring {spatial.RING}")
    assert [r["window_id"] for r in spatial.overlap_region_semi(cells, footprints).collect()] == [2]


def test_squares_of_turned_rings(spark):
    """against every square of every offset."""
    rng = np.random.default_rng(2)
    made = [K.hull(rng.uniform(0, 10, (6, 2))) for _ in range(12)]
    polys = spark.createDataFrame(list(enumerate(rings(*made))), f"id long, ring {spatial.RING}")
    got = {r["id"]: r["n"] for r in spatial.best_offset_grid(polys, 1.5, 4).groupBy("id").agg(F.count("*").alias("n")).collect()}
    for i, p in enumerate(made):
        low, best = p.min(axis=0), 0
        edge = np.roll(p, -1, axis=0) - p
        for a in range(4):
            for b in range(4):
                x, y = (v.ravel() for v in np.meshgrid(low[0] + a * 1.5 / 4 + np.arange(8) * 1.5, low[1] + b * 1.5 / 4 + np.arange(8) * 1.5))
                corners = np.stack([x, y], axis=1)[:, None] + np.array([(0, 0), (1.5, 0), (1.5, 1.5), (0, 1.5)])
                d = edge[:, 0] * (corners[:, :, None, 1] - p[:, 1]) - edge[:, 1] * (corners[:, :, None, 0] - p[:, 0])
                best = max(best, int((d >= -1e-9).all(axis=(1, 2)).sum()))
        assert got.get(i, 0) == best


def test_draws_of_many_points_and_late_windows(spark, monkeypatch):
    """Points in runs are those drawn at once; windows that only late draws find."""
    ring = rings([(0, 0), (9, 1), (8, 7), (1, 6)])[0]
    pairs = spark.createDataFrame([(7, 50, ring), (8, 0, ring), (9, 3, ring[:2])], f"pair_id long, k long, ring {spatial.RING}")
    one = sorted(map(str, spatial.overlap_points(pairs).collect()))
    monkeypatch.setattr(spatial, "POINTS", 7)
    assert sorted(map(str, spatial.overlap_points(pairs).collect())) == one and len(one) == 53
    narrow = rings([(0, 0), (10.3, 0), (10.3, 10.3), (0, 10.3)])[0]
    ties = spark.createDataFrame([(i, 1, 5.0, 5.0) for i in range(40)] + [(99, 2, 5.0, 5.0), (100, 1, None, 5.0)], "tie_id long, pair_id long, x double, y double")
    found = spatial.windows_around_tie_points(ties, spark.createDataFrame([(1, narrow), (2, None)], f"pair_id long, ring {spatial.RING}"), 9.0, 3).toPandas()
    key = lambda tie, trial: (tie * 1000003 + trial) % 2147483647
    draw = lambda tie, trial, seed: (key(tie, trial) * 2654435761 + seed * 40503) % 4294967296 / 4294967296
    for tie in range(40):
        places = [(t, 5 - draw(tie, t, 42) * 9, 5 - draw(tie, t, 43) * 9) for t in range(200)]
        want = [t for t, x, y in places if 0 <= x <= 1.3 and 0 <= y <= 1.3][:3]
        assert sorted(found[found["tie_id"] == tie]["trial"]) == want
    assert found["tie_id"].max() < 40


def test_grid_crops_far_down_the_raster(spark):
    """a cell's own value stays its own at row 24,000 too."""
    cells = spark.range(64 * 32).select(F.lit(1).cast("long").alias("scene_id"), (24000 + F.floor(F.col("id") / 32)).alias("r"), (F.col("id") % 32).alias("c"), ((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    window = spark.createDataFrame([(1, 1, 24010.0, 4.0, 20.0)], "scene_id long, window_id long, r0 double, c0 double, size double")
    v = np.reshape(crops.grid_crops(crops.tiles_of(cells, 16), window, 16, 20).first()["v"], (20, 20))
    r, c = np.mgrid[10:30, 4:24]
    assert (v == ((r * 32 + c) * 7919 % 1009).astype("float32")).all()


def test_quads_alone_need_no_python(spark):
    """the homographies are left out where only the quads are asked for."""
    groups = spark.range(3).select(F.col("id").alias("group_id"), F.lit(3000).alias("height"), F.lit(2000).alias("width"))
    drawn = crops.training_crops(groups, 2)
    assert "Python" not in drawn.select("quad_a", "quad_b")._jdf.queryExecution().executedPlan().toString()
    row = drawn.first()
    z = np.reshape(row["h_a"], (3, 3)) @ np.concatenate([np.reshape(row["quad_a"], (4, 2)), np.ones((4, 1))], axis=1).T
    assert np.abs(z[:2] / z[2] - np.array([[0, 0, 511, 511], [0, 511, 511, 0]])).max() < 1e-6


def test_heights_are_not_broadcast(spark):
    """a small file may hold many cells."""
    t = tables(spark)
    points = spark.createDataFrame([(0, 1.5, 2.5)], "grid_id long, line double, samp double")
    plan = raster.dem_bilinear(points, t("cells_fx"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_files_of_scenes_are_dealt_to_all_tasks(spark, tmp_path):
    """small tables keep their tasks; names are numbered without a list of all."""
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == 4
    for name in ("b", "a", "c"):
        (tmp_path / "adjust_images" / name).mkdir(parents=True)
        (tmp_path / "adjust_images" / name / "x.txt").write_text("x")
    catalog = files.scene_catalog(spark, f"file://{tmp_path}", select="0,2")
    assert sorted(map(tuple, catalog.collect())) == [(0, "a"), (1, "c")]
    assert "collect_list" not in catalog._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_are_held_against_few_others(spark):
    """of a dense field the rows that meet in a cell are few more than the pairs; borders, equal corners and equal ids count as before."""
    rng = np.random.default_rng(9)
    made = [(int(i), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 20, (2, 200)) * 50, *rng.integers(2, 5, (2, 200)) * 50, strict=True))]
    boxes = spark.createDataFrame([*made, made[0], made[7]], "id long, bx0 double, by0 double, bx1 double, by1 double")
    size = spatial.cell_size(boxes)
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    rows = [*made, made[0], made[7]]
    for less in (True, False):
        want = sorted((a[0], b[0]) for a in rows for b in rows if meet(a, b) and (a[0] < b[0] or not less))
        assert sorted((r["id"], r["id_r"]) for r in spatial.box_pairs(boxes, boxes, size, less).collect()) == want
        sides = [(x, y, 2 * x + y) for x in ((True,) if less else (True, False)) for y in (True, False)]
        one, other = spatial.in_cells(boxes, size, sides), spatial.in_cells(boxes, size, [(not x, not y, n) for x, y, n in sides])
        assert one.join(other, ["side", "gx", "gy"]).count() < 3.5 * len(want)


def test_points_of_overlaps_are_expressions(spark):
    """F8: no Python stands between an overlap and its points, and a quad's draws are those of its fan."""
    ring = rings([(0, 0), (4, 0), (4, 2), (0, 2)])[0]
    points = spatial.overlap_points(spark.createDataFrame([(3, 30, ring)], f"pair_id long, k long, ring {spatial.RING}"))
    assert "Python" not in points._jdf.queryExecution().executedPlan().toString()
    x0, x1, y0, y1 = 0.2, 3.8, 0.1, 1.9
    for r in points.collect():
        u, v, w = (((3 * 1000003 + r["n"]) % 2147483647 * 2654435761 + seed * 40503) % 4294967296 / 4294967296 for seed in (42, 43, 44))
        root = v**0.5
        assert abs(r["x"] - ((1 - root) * x0 + root * (1 - w) * x1 + root * w * (x1 if u < 0.5 else x0))) < 1e-9
        assert abs(r["y"] - ((1 - root) * y0 + root * (1 - w) * (y0 if u < 0.5 else y1) + root * w * y1)) < 1e-9


def test_what_groups_share_is_folded_by_batches(spark):
    """groups, one of them far larger than a batch, one of null keys, without a call of Python for each."""
    ring = lambda *p: rings(p)[0]
    made = [("big", ring((0, 0), (10 - i % 7, 0), (10 - i % 7, 9), (0, 9))) for i in range(23)]
    made += [(f"k{i}", ring((j, 0), (j + 3, 0), (j + 3, 2), (j, 2))) for i in range(9) for j in range(1 + i % 4)]
    made += [(None, ring((0, 0), (2, 0), (0, 2))), (None, ring((0, 0), (1, 0), (1, 1), (0, 1))), ("off", ring((0, 0), (1, 0), (0, 1))), ("off", ring((5, 5), (6, 5), (5, 6)))]
    quads = spark.createDataFrame(made, f"g string, ring {spatial.RING}")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (rows, 5):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = spatial.common_intersection(quads, "g")
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
            got = {r["g"]: (round(r["area"], 9), len(r["ring"])) for r in found.collect()}
            assert got.pop("big") == (36.0, 4) and got.pop(None)[0] == 1.0 and got.pop("off") == (0.0, 0)
            assert {k: v[0] for k, v in got.items()} == {f"k{i}": 6.0 - 2 * (i % 4) for i in range(9)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
