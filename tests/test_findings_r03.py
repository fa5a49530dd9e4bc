"""Queries on tables that the smallest scale lacks: cells far down a raster, with gaps."""

import duckdb

from groundweave.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_warped_crops_of_far_cells_with_gaps_equal_sql(spark, tmp_path):
    """Windows with values on the border of two levels, and one that lacks a cell at its edge."""
    keys = [k for w in (1661, 2032, 7691) for k in range(80 * w, 80 * w + 200)] + [k for k in range(80 * 749, 80 * 749 + 200) if k != 60002]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["warped_crops"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    names = found.columns
    want = con.execute(ORACLE_SQL["warped_crops"])
    order = [[d[0] for d in want.description].index(c) for c in names]
    rows = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    assert len(rows) >= 4 and {r[0] for r in rows} >= {749, 1661, 2032, 7691}
    assert sorted(tuple(r) for r in found.collect()) == rows


def test_few_models_go_to_the_ties_and_give_what_ranges_give(spark, monkeypatch):
    """The ties of a planted block are read where they lie, round by round; with more models than are sent, ranges fetch theirs."""
    from groundweave.operators import cameras as O

    plan = []
    add = O._added
    monkeypatch.setattr(O, "_added", lambda each: (plan.append("FlatMapCoGroups" in each._jdf.queryExecution().toString()), add(each))[1])
    few = sorted(map(tuple, QUERIES["block_adjustment"](spark, SF).collect()))
    assert plan and not any(plan)
    plan.clear()
    monkeypatch.setattr(O, "BROADCAST_SCENES", 0)
    many = sorted(map(tuple, QUERIES["block_adjustment"](spark, SF).collect()))
    assert plan and all(plan) and few == many and len(few) == 7


def test_strengths_are_fitted_at_once_and_score_the_same(spark, monkeypatch):
    """Two fits wait for each other; one after the other they would never meet. Scores are those of fits alone."""
    from threading import Barrier

    from pyspark.sql import functions as F

    from groundweave.operators import embed
    from groundweave.plans.base import Tables
    from groundweave.plans.embed_queries import _vectors

    v = _vectors(Tables(spark, SF)).where("id < 300")
    train, val, test = v.where("id % 5 > 1"), v.where("id % 5 = 1"), v.where("id % 5 = 0")
    cs = [0.01, 10.0]
    alone = {c: embed.logreg_sweep(train, val, test, [c], max_iter=20).first()["val_accuracy"] for c in cs}
    gate, real = Barrier(2), embed.LogisticRegression

    class Waiting(real):
        def fit(self, d, *more):
            if not met:
                gate.wait(30)
                met.append(1)
            return super().fit(d, *more)

    met: list[int] = []
    monkeypatch.setattr(embed, "LogisticRegression", Waiting)
    got = embed.logreg_sweep(train, val, test, cs, max_iter=20)
    assert {r["c"]: r["val_accuracy"] for r in got.collect()} == alone
    assert met and got.where(F.col("is_best")).count() == 1
