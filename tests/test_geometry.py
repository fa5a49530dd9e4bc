"""Properties and hand cases of what SQL can't express."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.functions import cameras as C
from groundweave.functions import geometry as G
from groundweave.functions import kernels as K
from groundweave.operators import adjust, cameras, embed, metrics, raster, sampling, spatial
from groundweave.plans import camera_queries
from groundweave.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"


def tables(spark):
    return lambda name: fixture(spark, SF, name)


def ring(*points):
    return np.array(points, float).ravel()


def test_clip_of_rotated_and_concave_rings():
    square, diamond = ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((1, -1), (3, 1), (1, 3), (-1, 1))
    points, n = K.clip(*K.as_batch([square, square[::-1].reshape(-1, 2)[:, ::-1].ravel(), square]), *K.as_batch([diamond, diamond, square + 5]))
    assert np.allclose(np.abs(K.areas(points, n)), [4, 4, 0])
    hook = ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))
    points, n = K.clip(*K.as_batch([hook]), *K.as_batch([ring((0, 0), (2, 0), (2, 2), (0, 2))]))
    assert np.isclose(K.areas(points, n)[0], 3)


def test_clip_area_is_symmetric_and_no_larger_than_either():
    rng = np.random.default_rng(0)
    quads = [K.hull(rng.uniform(0, 10, (8, 2))).ravel() for _ in range(60)]
    a, b = K.as_batch(quads[:30]), K.as_batch(quads[30:])
    one, two = np.abs(K.areas(*K.clip(*a, *b))), np.abs(K.areas(*K.clip(*b, *a)))
    assert np.allclose(one, two) and (one <= np.abs(K.areas(*a)) + 1e-9).all() and (one <= np.abs(K.areas(*b)) + 1e-9).all()


def test_affine_columns(spark):
    m = F.array(*(F.lit(x) for x in (2.0, 0.5, -7.0, 0.25, 3.0, 11.0)))
    row = spark.range(1).select(G.affine_compose(G.affine_inv(m), m).alias("one"), G.affine_inv(F.array(*(F.lit(x) for x in (1.0, 2.0, 0.0, 2.0, 4.0, 0.0)))).alias("none")).first()
    assert np.allclose(row["one"], C.IDENTITY) and row["none"] is None


def test_error_report_of_nothing_and_nan(spark):
    none = metrics.error_report(spark.createDataFrame([], "d double")).first()
    assert none["count"] == 0 and none["mean"] != none["mean"]
    some = metrics.error_report(spark.createDataFrame([(1.0,), (float("nan"),), (0.5,), (None,)], "d double")).first()
    assert some["count"] == 4 and some["median"] != some["median"] and some["lt1_percent"] == 25.0 and some["lt3_percent"] == 50.0


def test_block_median_fills(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 2, 2, float("nan")), (0, 3, 3, None)], "grid_id long, r long, c long, v double")
    assert {(r["br"], r["v"]) for r in raster.block_nanmedian(cells, 2).collect()} == {(0, 2.0), (1, -1.0)}
    assert {(r["br"], r["v"]) for r in raster.block_nanmedian(cells, 2, "max").collect()} == {(0, 2.0), (1, 2.0)}


def test_tie_points_aligned_strict(spark):
    ties = spark.createDataFrame([(0, 1), (1, 1), (0, 2)], "tie_id long, img long")
    with pytest.raises(ValueError):
        raster.tie_points_aligned(ties)
    assert raster.tie_points_aligned(ties.limit(0)).count() == 0


def test_numbering_is_whole(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    rows = sampling.numbered(df, [F.col("x")]).orderBy("x").collect()
    assert [r["rn"] for r in rows] == list(range(1000))
    assert sampling.numbered(df.limit(0), [F.col("x")]).count() == 0


def test_camera_round_trip_after_fits(spark):
    row = camera_queries.scenes(tables(spark)).first()
    model = {k: v for k, v in row["rpc"].asDict().items()}
    model["lnum"] = [0.01, 0.02, -1.0, 0.003, 0.001] + [0.0] * 15
    fitted = C.fit_inverse({**model, "adj": list(C.IDENTITY)}, 15, 8)
    g = C.virtual_grid(fitted, 6, 3)
    lat, lon = C.to_ground(fitted, g[:, 0], g[:, 1], g[:, 4])
    line, samp = C.to_photo(fitted, lat, lon, g[:, 4])
    assert np.abs(line - g[:, 0]).max() < 1e-2 and np.abs(samp - g[:, 1]).max() < 1e-2
    moved = {**fitted, "adj": [1.0, 1e-4, 2.0, -1e-4, 1.0, -3.0]}
    baked = C.bake(moved, 15, 8)
    a, b = C.to_photo(moved, g[:, 2], g[:, 3], g[:, 4]), C.to_photo(baked, g[:, 2], g[:, 3], g[:, 4])
    assert baked["adj"] == list(C.IDENTITY) and np.abs(np.subtract(a, b)).max() < 1e-2


def test_broadcast_and_shuffled_models_agree(spark, monkeypatch):
    t = tables(spark)
    points = t("lineitem").select(F.col("l_suppkey").alias("scene_id"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 100).alias("line"), (F.col("l_quantity") * 50).alias("samp"), F.col("l_tax").alias("h")).limit(500).cache()
    one = sorted(map(str, cameras.rpc_photo2obj(points, camera_queries.scenes(t)).collect()))
    monkeypatch.setattr(cameras, "BROADCAST_SCENES", 3)
    assert sorted(map(str, cameras.rpc_photo2obj(points, camera_queries.scenes(t)).collect())) == one


def test_block_adjustment_finds_planted_shifts(spark):
    t = tables(spark)
    scenes = camera_queries.scenes(t).where("scene_id in (10, 1, 2, 3)")
    plain = {r["scene_id"]: {**r["rpc"].asDict(), "lat_off": 30.0, "lon_off": 100.0, "adj": list(C.IDENTITY)} for r in scenes.collect()}
    ids, rng, rows = sorted(plain), np.random.default_rng(0), []
    truth = {s: [1.0, 0.0, 5.0 * n, 0.0, 1.0, -3.0 * n] for n, s in enumerate(ids)}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            lat, lon, h = rng.uniform(29.95, 30.05, 60), rng.uniform(99.95, 100.05, 60), rng.uniform(0, 900, 60)
            a, b = C.to_photo({**plain[i], "adj": truth[i]}, lat, lon, h), C.to_photo({**plain[j], "adj": truth[j]}, lat, lon, h)
            rows += [(int(i), int(j), *map(float, x)) for x in zip(a[0], a[1], b[0], b[1], h)]
    ties = spark.createDataFrame(rows, "i long, j long, line_i double, samp_i double, line_j double, samp_j double, h double")
    models = spark.createDataFrame([(int(s), tuple(m[k] for k in (*C.SCALARS, *C.DIRECT, *C.INVERSE, "adj"))) for s, m in plain.items()], f"scene_id long, rpc {cameras.RPC}")
    before = cameras.adjustment_rms(ties, models).first()["rms"]
    out = {r["scene_id"]: r for r in cameras.block_adjustment(ties, models, ids[0], damping=1e-9).collect()}
    assert before > 1 and out[ids[0]]["rms"] < 1e-3
    for s in ids:
        at = np.array([[1000.0, 2000.0], [8000.0, 500.0]])
        m, w = np.reshape(out[s]["m"], (2, 3)), np.reshape(truth[s], (2, 3))
        assert np.abs(adjust.moved(m, at) - adjust.moved(w, at)).max() < 0.5


def test_ransac_ignores_outliers():
    rng = np.random.default_rng(0)
    src = rng.uniform(0, 100, (80, 2))
    m = np.array([[1.1, 0.1, 5], [-0.1, 0.9, 2]])
    dst = adjust.moved(m, src)
    dst[:20] += rng.uniform(20, 50, (20, 2))
    found, ok = adjust.ransac(src, dst, "A", 1.0, 300)
    assert ok.sum() == 60 and np.allclose(found, m)
    assert adjust.ransac(src[:2], dst[:2], "A")[0] is None


def test_balanced_assignment_sums(spark):
    scores = fixture(spark, SF, "preds_fx").select(F.col("idx").alias("sample"), F.col("cls").alias("prototype"), "score")
    rows = embed.balanced_assignment(scores, 0.5, 20).groupBy("sample").agg(F.sum("q").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in rows)


def test_knn_blocks_do_not_matter(spark):
    v = fixture(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), G.l2_normalize(F.col("embedding")).alias("v"))
    one = sorted((r["q"], r["rank"], r["id"]) for r in embed.knn_join(v, v, 5).collect())
    assert sorted((r["q"], r["rank"], r["id"]) for r in embed.knn_join(v, v, 5, block=17).collect()) == one


def test_overlap_pairs_need_an_area(spark):
    with pytest.raises(ValueError):
        spatial.overlap_pairs(spark.createDataFrame([], f"scene_id long, ring {spatial.RING}"), 0)
    assert spatial.overlap_pairs(spark.createDataFrame([], f"scene_id long, ring {spatial.RING}"), 1).count() == 0


def test_homography_inverse(spark):
    h = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 3], [1e-4, -2e-4, 1.0]])
    got = spark.range(1).select(G.homography_inv(F.array(*(F.lit(float(x)) for x in h.ravel()))).alias("g")).first()["g"]
    assert np.allclose(np.reshape(got, (3, 3)), np.linalg.inv(h))
