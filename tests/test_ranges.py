"""Running sums, percentiles and windows by ranges, and the best of a block, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundweave.operators.embed import best_of
from groundweave.operators.metrics import error_report
from groundweave.operators.sampling import percentiles, running, smoothed_metric


def rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    return pd.DataFrame({"g": g, "x": rng.permutation(n).astype(float), "n": rng.integers(0, 5, n)})


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges a group
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_cross_ranges(spark, uncoalesced):
    data = rows()
    data.loc[:20, "g"] = None
    got = running(spark.createDataFrame(data), ["g"], [F.desc("x")], {"s": F.col("n")}).toPandas()
    want = data.sort_values("x", ascending=False)
    want["s"] = want.groupby("g", dropna=False)["n"].cumsum()
    key = ["x", "n", "s"]
    assert got[key].sort_values("x").to_numpy().tolist() == want[key].sort_values("x").to_numpy().tolist()


def test_percentiles(spark, uncoalesced):
    data = rows()
    data["x"] = (data["x"] // 3).where(data["n"] > 0)
    got = {r["g"]: r["p"] for r in percentiles(spark.createDataFrame(data).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), ["g"], "x", [0.02, 0.5, 1.0]).collect()}
    for g, part in data.dropna().groupby("g"):
        assert np.allclose(got[g], np.percentile(part["x"], [2, 50, 100]))
    whole = percentiles(spark.createDataFrame(data).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), [], "x", [0.5]).collect()
    assert np.allclose(whole[0]["p"], np.percentile(data["x"].dropna(), 50))
    assert percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).collect() == []


def test_smoothed_metric_crosses_chunks(spark, uncoalesced):
    data = rows(300).rename(columns={"g": "metric", "x": "step", "n": "value"}).astype({"value": float})
    got = smoothed_metric(spark.createDataFrame(data), 20, chunk=23).toPandas().sort_values(["metric", "step"]).reset_index(drop=True)
    want = data.sort_values(["metric", "step"]).reset_index(drop=True)
    by = want.groupby("metric")["value"]
    assert np.allclose(got["avg"], by.rolling(20, 1).mean().to_numpy())
    assert np.allclose(got["global_avg"], by.expanding().mean().to_numpy())
    assert np.allclose(got["median"], by.rolling(20, 1).apply(lambda v: np.sort(v)[(len(v) - 1) // 2]).to_numpy())


def test_error_report_with_nan_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 4.0), (2, float("nan")), (2, 2.0), (None, None)], "i long, d double")
    got = {r["i"]: r for r in error_report(df.where("i is not null"), by=("i",)).collect()}
    assert (got[1]["count"], got[1]["mean"], got[1]["median"], got[1]["lt3_percent"]) == (2, 2.5, 2.5, 50.0)
    assert got[2]["count"] == 2 and np.isnan(got[2]["median"]) and np.isnan(got[2]["mean"]) and got[2]["lt3_percent"] == 50.0
    assert got[None]["count"] == 4 and np.isnan(got[None]["median"])
    empty = error_report(df.limit(0)).first()
    assert empty["count"] == 0 and np.isnan(empty["median"])


@pytest.mark.parametrize("want", [1, 3, 50])
def test_best_of_with_ties(want):
    sims = np.random.default_rng(1).integers(0, 4, (17, 40)).astype(float)
    r, c, v = best_of(sims, want)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
    assert c.tolist() == order.ravel().tolist() and r.tolist() == np.repeat(np.arange(17), order.shape[1]).tolist()
    assert v.tolist() == np.take_along_axis(sims, order, axis=1).ravel().tolist()


def test_error_report_knows_null_keys_from_overall_and_takes_both_ways(spark):
    rows = [(None, 1.0), (None, 2.0), (None, None), (1, 4.0), (1, 1.0), (1, 2.5), (2, float("nan"))]
    df = spark.createDataFrame(rows, "i long, d double")
    one, many = (sorted(map(str, error_report(df, by=("i",), few=few).collect())) for few in (10, 0))
    assert one == many and len(one) == 4
    got = {(r["i"], r["is_overall"]): r for r in error_report(df.where("d is not null and not isnan(d)"), by=("i",)).collect()}
    assert got[None, True]["median"] == 2.0 and got[None, False]["median"] == 1.5 and got[1, False]["median"] == 2.5
    assert not any(r["is_overall"] for r in error_report(df, by=("i",), overall=False).collect())


def test_few_shot_of_many_labels(spark):
    """60 samples of two labels each: twelve labels are wanted of 120, and each sample comes once."""
    from groundweave.operators.sampling import few_shot_multilabel

    labels = spark.createDataFrame([(i, k) for i in range(60) for k in (i % 6, 6 + i % 4)] + [(0, 0), (None, 1), (3, None)], "idx long, label long")
    got = [tuple(r) for r in few_shot_multilabel(labels, 0.1, 2).collect()]
    assert len(got) == len(set(got)) and {t for t, _ in got} == {0, 1}
    assert all(10 <= 2 * sum(t == k for t, _ in got) <= 20 for k in (0, 1))  # ten classes pick at least one each, some the same
    assert len([r for r in few_shot_multilabel(labels, 1, 1).collect()]) <= 10 and few_shot_multilabel(labels, 100, 1).count() == 60
    assert few_shot_multilabel(labels.limit(0), 0.5).count() == 0
