import json

import numpy as np
from pyspark.sql import functions as F

from groundweave.functions import cameras as C
from groundweave.plans import camera_queries
from groundweave.plans.fixtures import fixture
from groundweave.sources import files
from groundweave.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_scene_folders(spark, tmp_path):
    for name in ("b", "a", "c"):
        d = tmp_path / "adjust_images" / name
        d.mkdir(parents=True)
        (d / "tie_points.txt").write_text("1 2\n3 4\n" if name != "c" else "1 2 3\n")
        np.save(d / "dem.npy", np.arange(20.0).reshape(4, 5))
    np.save(tmp_path / "adjust_images" / "a" / "dem_usgs.npy", np.ones((2, 2)))
    assert [tuple(r) for r in files.scene_catalog(spark, str(tmp_path)).orderBy("scene_id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [tuple(r) for r in files.scene_catalog(spark, str(tmp_path), select="0,2").orderBy("scene_id").collect()] == [(0, "a"), (1, "c")]
    ties = files.read_tie_points(spark, f"{tmp_path}/adjust_images/*/tie_points.txt")
    assert sorted(tuple(r) for r in ties.collect()) == [("a", 0, 1, 2), ("a", 1, 3, 4), ("b", 0, 1, 2), ("b", 1, 3, 4)]
    tiles = files.read_dem_tiles(spark, str(tmp_path), 3)
    assert tiles.where("name = 'b'").agg(F.sum("h"), F.count("*")).first()[1] == 4
    assert files.read_dem_tiles(spark, str(tmp_path), 3, usgs=True).where("name = 'a'").first()["v"] == [1.0] * 4


def test_model_files_round_trip(spark, tmp_path):
    scenes = camera_queries.scenes(lambda n: fixture(spark, SF, n)).select(F.concat(F.lit("x/"), F.col("scene_id").cast("string")).alias("name"), "rpc")
    files.write_rpc_text(scenes, str(tmp_path / "out"))
    for i, row in enumerate(sorted(tmp_path.glob("out/scene_key=*/*.txt"))):
        d = tmp_path / "in" / str(i)
        d.mkdir(parents=True)
        text = row.read_text()
        assert len(text.split()) > 340 and text.startswith("LINE_OFF: 5000.0 pixels")
        (d / "rpc.txt").write_text(text if i else "\n".join(text.splitlines()[:90]) + "\nSKIPPED: 0\nRFM_CORRECTION_PARAMETERS\n" + "\n".join(f"P{k}: {v}" for k, v in enumerate((1, 0, 0, 2, 0, 0))) + "\n")
    read = {r["name"]: r["rpc"] for r in files.read_rpc_text(spark, f"{tmp_path}/in/*/rpc.txt").collect()}
    assert len(read) == scenes.count() and read["0"]["latnum"] is None and read["0"]["adj"] == [1.0, 0.0, -1.0, 0.0, 1.0, -2.0]
    assert read["1"]["lonnum"][2] == 1.0 and read["1"]["adj"] == list(C.IDENTITY)


def test_bracketed_model(spark, tmp_path):
    (tmp_path / "s").mkdir()
    lines = [f"{v} = {i}.5;" for i, v in enumerate(list(files.RPB.values())[:10])] + [f"{v} = (\n" + ",\n".join(f"{k}e-1" for k in range(20)) + ");" for v in list(files.RPB.values())[10:]]
    (tmp_path / "s" / "a.rpb").write_text("\n".join(lines))
    rpc = files.read_rpb(spark, f"{tmp_path}/s/a.rpb").first()["rpc"]
    assert rpc["samp_off"] == 1.5 and rpc["sden"][19] == 1.9 and rpc["latnum"] is None


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def statuses(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    shape = lambda d: d.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 8).alias("rank"), F.col("event_type").alias("current_task"), F.concat((F.col("event_id") % 3).cast("string"), F.lit("/3")).alias("progress"), F.when(F.col("event_type") == "error", "high").otherwise("-").alias("level"), F.concat(F.lit("step "), (F.col("user_id") % 5).cast("string")).alias("current_step"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error"))
    return shape(stream), shape(spark.read.parquet(f"{SF}/events.parquet"))


def test_streams_equal_batch_twins(spark):
    stream, batch = statuses(spark)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(run(monitor.latest_status(stream), "complete", "latest")) == rows(monitor.latest_status(batch))
    assert rows(run(monitor.crash_alerts(stream), "append", "crashes")) == rows(monitor.crash_alerts(batch))
    changed = run(monitor.status_changes(stream, min_gap_s=-1), "append", "changes")
    assert rows(changed) == rows(monitor.status_changes_batch(batch))


def test_status_gap():
    import pandas as pd

    times = pd.to_datetime([1.0, 1.05, 1.08, 1.2, 1.31, 1.32, 1.33], unit="s")
    fields = {"current_task": list("aabbbbb"), "progress": ["0/2"] * 6 + ["1/2"], "level": ["-"] * 7, "error": [None] * 7, "current_step": list("xyyzwvv")}
    emit, last, at = monitor._changes(pd.DataFrame({"ts": times, **fields}), None, 0.0, 0.1)
    assert emit == [True, False, True, True, True, False, True] and last == ("b", "1/2", "-", None, "v") and at == 1.33


def test_log_tail(spark, tmp_path):
    lines = [json.dumps({"timestamp": 1.5, "msg": "one"}), "not json", json.dumps({"timestamp": 2.0, "msg": " "}), json.dumps({"timestamp": 3.0, "msg": "two"})]
    (tmp_path / "rank0.json").write_text("\n".join(lines))
    assert [r["msg"] for r in run(monitor.log_tail(spark, str(tmp_path)), "append", "log").orderBy("at").collect()] == ["one", "two"]
    assert monitor.log_tail(spark, str(tmp_path), stream=False).count() == 2


def test_sample_groups_that_are_there_stay(spark, tmp_path):
    from groundweave.sources.files import append_sample_groups

    for ids, value in (([1, 2], 1.0), ([2, 3], 2.0)):
        groups = spark.createDataFrame([(i, True) for i in ids], "group_id long, complete boolean")
        rows = spark.createDataFrame([(i, value) for i in ids], "group_id long, v double")
        append_sample_groups(groups, rows, rows, f"file://{tmp_path}/g")
    for name in ("group_images", "parallax"):
        read = spark.read.schema("v double, group_id long").parquet(f"file://{tmp_path}/g/{name}")
        assert sorted((r["group_id"], r["v"]) for r in read.collect()) == [(1, 1.0), (2, 1.0), (3, 2.0)]


def test_changes_by_ranges_equal_one_walk(spark):
    """Ranges of 7 rows, ties in time, a rank with most rows, rows without a rank; the state carries over into the next batch."""
    import random

    import pandas as pd

    rng = random.Random(1)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.0, 0.02, 0.05, 0.3])
        rows.append((i, pd.Timestamp(at, unit="s").to_pydatetime(), rng.choice([0, 0, 0, 0, 1, 2]), f"t{i // 90}", "1/1", "-", f"s{rng.randrange(3)}", None))
    rows.append((999, None, 1, "x", "x", "x", "x", None)), rows.append((998, pd.Timestamp(0).to_pydatetime(), None, "x", "x", "x", "x", None))
    df = spark.createDataFrame(rows, monitor.STATUS)
    want = []
    for rank in range(3):
        own = pd.DataFrame([r for r in rows if r[2] == rank and r[1] is not None], columns=["event_id", "ts", "rank", "current_task", "progress", "level", "current_step", "error"]).sort_values(["ts", "event_id"])
        flags, _, _ = monitor._changes(own, None, 0.0, 0.1)
        want += own["event_id"][flags].tolist()
    ids = lambda d: sorted(r["event_id"] for r in d.collect())
    assert ids(monitor.changes_by_ranges(df, per_task=7)[0]) == sorted(want) and 50 < len(want) < 300
    one, state = monitor.changes_by_ranges(df.where("event_id < 170"), per_task=7)
    two, end = monitor.changes_by_ranges(df.where("event_id >= 170"), state=state, per_task=7)
    assert sorted(ids(one) + ids(two)) == sorted(want) and {r["rank"] for r in end.collect()} == {0, 1, 2}
    assert monitor.changes_by_ranges(df.limit(0))[0].count() == 0


def test_follow_changes_over_many_batches(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(4, "event_id").write.parquet(f"{tmp_path}/in")
    from groundweave.plans.embed_queries import _run

    stream = _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    monitor.follow_changes(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out/changes/batch=*")
    state = spark.read.parquet(f"{tmp_path}/out/state")
    assert state.select("batch").distinct().count() == 4 and got.count() > 100
    assert got.count() == got.select("event_id").distinct().count()


def test_a_crash_stops_the_stream(spark, tmp_path):
    import pandas as pd

    def batch(name, rows):
        spark.createDataFrame([(i, pd.Timestamp(i, unit="s").to_pydatetime(), 0, "t", "1/1", "-", "s", e) for i, e in rows], monitor.STATUS).coalesce(1).write.parquet(f"{tmp_path}/{name}")

    for k, rows in enumerate(([(1, None), (2, "")], [(3, None), (5, "later"), (4, "first")], [(6, None), (7, "third")])):
        batch(f"in/{k}", rows)
    source = lambda: spark.readStream.schema(monitor.STATUS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    crash = monitor.stop_on_crash(source(), f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
    assert [(r["event_id"], r["error"]) for r in crash] == [(4, "first")]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out/statuses/batch=*").collect()) == [1, 2, 3, 4]
    assert not spark.streams.active
    again = monitor.stop_on_crash(source(), f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()  # started anew, it writes nothing more
    assert [r["event_id"] for r in again] == [4] and spark.read.parquet(f"{tmp_path}/out/statuses/batch=*").count() == 4
    calm = spark.readStream.schema(monitor.STATUS).parquet(f"{tmp_path}/in/0")
    assert monitor.stop_on_crash(calm, f"{tmp_path}/calm", f"{tmp_path}/calm-checkpoint").count() == 0


def test_groups_that_fail_leave_nothing_to_be_seen(spark, tmp_path):
    from groundweave.sources.files import append_checked_groups, read_checked_groups

    def given(ids, value, **other):
        attributes = {"processing_crs": "x", "window_bounds": [0.0] * 4, "window_size_m": 10.0, "output_size_px": 5, "resolution_m_per_px": 2.0, "global_indices": [1, 2], "source_paths": ["a", "b"], "complete": True} | other
        kinds = "group_id long, processing_crs string, window_bounds array<double>, window_size_m double, output_size_px int, resolution_m_per_px double, global_indices array<bigint>, source_paths array<string>, complete boolean"
        groups = spark.createDataFrame([(i, *attributes.values()) for i in ids], kinds)
        rows = spark.createDataFrame([(i, k, 1, 2, [value, value]) for i in ids for k in (0, 1)], "group_id long, img long, h int, w int, v array<double>")
        return groups, rows, rows

    path = f"file://{tmp_path}/groups"
    read = lambda: read_checked_groups(spark, path, "array<double>", "array<double>")
    assert all(d.count() == 0 for d in read())
    verdict = lambda *of: {r["group_id"]: r["violation"] for r in append_checked_groups(*of, path).collect()}
    assert verdict(*given([1, 2], 1.0)) == {1: None, 2: None}
    assert verdict(*given([2, 3], 2.0)) == {2: "exists", 3: None}
    assert verdict(*given([4], 1.0, complete=False)) == {4: "attributes"} and verdict(*given([5, 5], 1.0))[5] == "given twice"
    groups, images, parallax = given([6, 7, 8], 1.0)
    assert verdict(groups, images.where("group_id <> 6"), parallax) == {6: "keys differ", 7: None, 8: None}
    assert verdict(*given([4], 4.0)) == {4: None}  # a group that failed may come again
    groups, images, parallax = read()
    assert sorted(r["group_id"] for r in groups.collect()) == [1, 2, 3, 4, 7, 8]
    assert sorted({(r["group_id"], r["v"][0]) for r in images.collect()}) == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 4.0), (7, 1.0), (8, 1.0)]
    assert images.count() == parallax.count() == 12
