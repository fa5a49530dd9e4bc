"""Operators that SQL cannot express, against plain NumPy on the given tables."""

import numpy as np

from groundweave.functions import geometry as G
from groundweave.operators import crops, embed

SF = "/root/testdata/sf0.001"


def vectors(spark):
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", G.l2_normalize(F.col("embedding")).alias("v"))


def test_three_components_equal_an_svd(spark):
    rows = sorted(vectors(spark).select("id", "v").collect())
    x = np.array([r["v"] for r in rows])
    centred = x - x.mean(0)
    loadings = np.linalg.svd(centred, full_matrices=False)[2][:3]
    loadings *= np.sign([c[np.abs(c).argmax()] for c in loadings])[:, None]
    p = centred @ loadings.T
    want = (p - p.min()) * 255 / (p.max() - p.min())
    got = np.array([r["c"] for r in sorted(embed.feature_pca3(vectors(spark).select("id", "v")).collect())])
    assert got.shape == want.shape and got.min() >= 0 and got.max() == 255
    assert np.all((got <= want + 1e-6) & (got > want - 1 - 1e-6))


def accuracy(train, test, c):
    """Share of test rows that a softmax regression, fitted by Newton steps to its optimum, gets right. The optimum has
    standardised features under the penalty, as Spark's has, and intercepts without one."""
    x, y = (np.array([r[k] for r in train]) for k in ("v", "label"))
    mean, std = x.mean(0), x.std(0, ddof=1)
    a = np.c_[(x - mean) / std, np.ones(len(x))]
    classes = int(y.max()) + 1
    w = np.zeros((a.shape[1], classes))
    ridge = np.kron(np.diag([1 / (c * len(x))] * x.shape[1] + [0.0]), np.eye(classes))
    for _ in range(30):
        s = a @ w
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        slope = (a.T @ (q - np.eye(classes)[y]) / len(x)).ravel() + ridge @ w.ravel()
        bend = sum(np.kron(np.outer(r, r), np.diag(k) - np.outer(k, k)) for r, k in zip(a, q, strict=True)) / len(x)
        step = np.linalg.lstsq(bend + ridge, slope, rcond=None)[0]
        w -= step.reshape(w.shape)
        if np.abs(step).max() < 1e-10:
            break
    x, y = (np.array([r[k] for r in test]) for k in ("v", "label"))
    return float((np.argmax(np.c_[(x - mean) / std, np.ones(len(x))] @ w, axis=1) == y).mean())


def test_strengths_equal_newton_fits(spark):
    from pyspark.sql import functions as F

    v = vectors(spark).where("label < 3").select("id", "label", F.slice("v", 1, 4).alias("v"))
    train, val, test = v.where("id % 5 > 1"), v.where("id % 5 = 1"), v.where("id % 5 = 0")
    cs = [0.01, 1.0, 100.0]
    got = {r["c"]: r for r in embed.logreg_sweep(train, val, test, cs).collect()}
    want = {c: accuracy(train.collect(), val.collect(), c) for c in cs}
    assert {c: round(r["val_accuracy"], 9) for c, r in got.items()} == {c: round(a, 9) for c, a in want.items()}
    best = max(cs, key=lambda c: (want[c], -c))
    assert [c for c, r in got.items() if r["is_best"]] == [best]
    assert abs(got[best]["test_accuracy"] - accuracy(train.unionByName(val).collect(), test.collect(), best)) < 1e-9


def test_homographies_of_crops_meet_the_corners(spark):
    groups = spark.createDataFrame([(i, 3000, 2000 + i) for i in range(40)], "group_id long, height int, width int")
    target = np.array([[0, 0], [0, 511], [511, 511], [511, 0]], float)
    for r in crops.training_crops(groups, 2).collect():
        for quad, h in ((r["quad_a"], r["h_a"]), (r["quad_b"], r["h_b"])):
            there = np.c_[np.reshape(quad, (4, 2)), np.ones(4)] @ np.reshape(h, (3, 3)).T
            assert np.abs(there[:, :2] / there[:, 2:] - target).max() < 1e-5


def test_mutual_matches_of_all_pairs_equal_those_of_candidates(spark):
    """Blocks of 16, so that rows and columns add up over many; equal vectors, null ids and vectors."""
    from pyspark.sql import functions as F

    v = vectors(spark).limit(300).select("id", "v")
    a = v.where("id % 3 = 0").unionByName(v.where("id = 1").withColumn("id", F.lit(9000).cast("long")))
    b = v.where("id % 3 <> 0").unionByName(spark.createDataFrame([(None, [1.0] * 3), (99999, None)], "id long, v array<double>"))
    every = a.select(F.col("id").alias("i")).crossJoin(b.where("id is not null and v is not null").select(F.col("id").alias("j")))
    want = {(r["i"], r["j"]): r["score"] for r in embed.mutual_nn_match(a, b, every, threshold=1e-6).collect()}
    got = {(r["i"], r["j"]): r["score"] for r in embed.mutual_nn_match(a, b, threshold=1e-6, block=16).collect()}
    assert got.keys() == want.keys() and len(got) > 20 and (9000, 1) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert embed.mutual_nn_match(a.limit(0), b).count() == 0


def test_spread_of_groups_in_blocks(spark):
    from pyspark.sql import functions as F

    v = vectors(spark).select("id", "v", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"))
    more = v.unionByName(v.limit(1).withColumn("g", F.lit(77).cast("long")))
    rows = more.collect()
    for block in (8192, 32):
        found = {(r["_group"], r["q"]): r["sim"] for r in embed.knn_in_groups(more, 1, "g", block).collect()}
        for g in (0, 1, 2, None):
            x = {r["id"]: np.array(r["v"]) for r in rows if r["g"] == g}
            assert {q for k, q in found if k == g} == set(x)
            for q in list(x)[:20]:
                assert abs(found[g, q] - max(x[q] @ u for i, u in x.items() if i != q)) < 1e-9
    got = {r["g"]: r for r in embed.embedding_spread(more, group="g").collect()}
    assert set(got) == {0, 1, 2, None, 77} and got[77]["spread"] is None and got[77]["n"] == 1
