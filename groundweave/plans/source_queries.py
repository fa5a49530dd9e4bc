"""Registered queries that write derived tables in the formats of result files and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundweave.functions.cameras import DIRECT, INVERSE, SCALARS
from groundweave.operators import metrics as M
from groundweave.plans.base import Registry, rounded
from groundweave.sources import files as S
from groundweave.sources.shared import shared_dir, spread
from groundweave.streaming.monitor import log_tail as tail

R = Registry()


def _place(df, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/groundweave/{name}-{uuid.uuid4().hex}"


@R.query("SELECT CAST(i AS VARCHAR) AS i, CAST(tie_id AS VARCHAR) AS tie_id, NULL AS infer_time FROM pair_err_fx")
def results_csv_append(t):
    rows = t("pair_err_fx")
    S.results_csv_append(rows, path := _place(rows, "results"), ["i", "tie_id", "infer_time"])
    return rows.sparkSession.read.schema("i string, tie_id string, infer_time string").option("header", True).csv(path)


@R.query("SELECT i, j, COUNT(*) AS count, ROUND(MAX(d), 6) AS max, 'a' AS run, (SELECT COUNT(*) FROM pair_err_fx) AS total FROM pair_err_fx GROUP BY i, j")
def report_json(t):
    report = M.error_report(t("pair_err_fx"), by=("i", "j"))
    text = S.report_json(report.where("is_overall").drop("i", "j", "is_overall"), report.where("not is_overall").drop("is_overall"), {"run": "a"})
    kind = "parameters struct<run:string>, global_report struct<count:long>, pair_reports array<struct<i:long,j:long,count:long,max:double>>"
    read = text.select(F.from_json("value", kind).alias("r")).select("r.parameters.run", F.col("r.global_report.count").alias("total"), F.explode("r.pair_reports").alias("p"))
    return rounded(read.select("p.i", "p.j", "p.count", "p.max", "run", "total"))


@R.query("SELECT c_custkey AS idx, c_acctbal AS bal, CASE WHEN c_nationkey > 12 THEN 'true' ELSE 'false' END AS far FROM customer")
def results_table_io(t):
    rows = t("customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("bal"), (F.col("c_nationkey") > 12).alias("far"))
    S.write_results(rows, path := _place(rows, "table"), "csv")
    S.write_results(S.read_results(rows.sparkSession, path, "idx long, bal double, far string", "csv"), path := _place(rows, "table"))
    return S.read_results(rows.sparkSession, path, "idx long, bal double, far string")


@R.query("SELECT metric, step AS iteration, value FROM metric_fx")
def metric_jsonl(t):
    rows = t("metric_fx").select("metric", F.col("step").alias("iteration"), "value")
    S.metric_jsonl(rows, path := _place(rows, "metrics"))
    return rows.sparkSession.read.schema("metric string, iteration long, value double").json(path)


@R.query("SELECT group_id, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(xa), 4) AS total FROM matches_fx GROUP BY group_id")
def append_sample_groups(t):
    rows = t("matches_fx")
    images = rows.select("group_id", F.col("img_a").alias("img"), "xa", "ya")
    S.append_sample_groups(rows.select("group_id").distinct().withColumn("complete", F.lit(True)), images, images, path := _place(rows, "groups"))
    read = rows.sparkSession.read.schema("img long, xa double, ya double, group_id long").parquet(f"{path}/group_images")
    return rounded(read.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("xa").alias("total")), 4)


@R.query("""WITH g AS (SELECT group_id, COUNT(*) AS n, SUM(l) AS total FROM (SELECT group_id, img_a AS l FROM matches_fx) GROUP BY group_id),
  v AS (SELECT *, CASE group_id % 8 WHEN 4 THEN 'keys not consecutive' WHEN 5 THEN 'keys differ' WHEN 6 THEN 'attributes' WHEN 7 THEN 'shapes differ' END AS violation FROM g)
  SELECT group_id, violation, CASE WHEN violation IS NULL THEN 4 END AS n_images, CASE WHEN violation IS NULL THEN 4*6*(n % 200) END AS pixels, CASE WHEN violation IS NULL THEN 4*6*total END AS disparity,
    CASE WHEN violation IS NULL THEN 'EPSG:32633' END AS crs, CASE WHEN violation IS NULL THEN 0.5::DOUBLE END AS resolution FROM v""")
def append_checked_groups(t):
    """Groups of four images, some of which break a rule: what the reader sees of all three tables, and why others were turned away."""
    of = t("matches_fx").groupBy("group_id").agg(F.count("*").alias("n"), F.sum("img_a").alias("total"))
    kind = F.col("group_id") % 8
    each = of.withColumn("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    shown = F.when(kind == 4, F.col("img") + 1).otherwise(F.col("img"))
    images = each.select("group_id", shown.alias("img"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.array_repeat((F.col("n") % 200).cast("int"), 6).alias("v"))
    flat = F.when((kind == 7) & (F.col("img") == 2), 3).otherwise(2)
    parallax = each.where((kind != 5) | (F.col("img") < 3)).select("group_id", shown.alias("img"), flat.alias("h"), (6 / flat).cast("int").alias("w"), F.array_repeat(F.col("total").cast("double"), 6).alias("v"))
    size = F.when(kind != 6, 1500.0)
    groups = of.select("group_id", F.lit("EPSG:32633").alias("processing_crs"), F.array(*(F.lit(float(x)) for x in range(4))).alias("window_bounds"), size.alias("window_size_m"), F.lit(3000).alias("output_size_px"), F.lit(0.5).alias("resolution_m_per_px"),
        F.array(*(F.lit(i).cast("long") for i in range(4))).alias("global_indices"), F.array(*(F.lit(f"{i}.tif") for i in range(4))).alias("source_paths"), F.lit(True).alias("complete"))
    judged = S.append_checked_groups(groups, images, parallax, path := _place(of, "checked-groups"))
    seen, pictures, shifts = S.read_checked_groups(of.sparkSession, path, "array<int>", "array<double>")
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    a = pictures.groupBy("group_id").agg(F.count("*").alias("n_images"), F.sum(total("v", F.lit(0))).alias("pixels"))
    b = shifts.groupBy("group_id").agg(F.sum(total("v", F.lit(0.0))).cast("long").alias("disparity"))
    whole = seen.select("group_id", F.col("processing_crs").alias("crs"), F.col("resolution_m_per_px").alias("resolution")).join(a, "group_id").join(b, "group_id")
    return judged.join(whole, "group_id", "left")


def _texts(df, name: str) -> str:
    """Writes value as one file for each scene under its own folder scene=.., and returns the folder above."""
    spread(df, "scene").write.partitionBy("scene").text(path := _place(df, name))
    return path


@R.query("SELECT row_number() OVER (ORDER BY name) - 1 AS scene_id, name FROM (SELECT 'scene=' || s_suppkey AS name FROM supplier)")
def scene_catalog(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("scene"), F.lit("x").alias("value"))
    root = _place(rows, "scenes")
    spread(rows, "scene").write.partitionBy("scene").text(f"{root}/adjust_images")
    return S.scene_catalog(rows.sparkSession, root)


def _models(t):
    """A model for each supplier: every one of its 170 numbers is another one."""
    k = F.col("s_suppkey")
    number = lambda i: (k * (i + 3) % 1009).cast("double") / 64 - 5
    block = lambda b: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: number(i + 10 + 20 * b))
    blocks = [block(b).alias(n) for b, n in enumerate((*DIRECT, *INVERSE))]
    return t("supplier").select(k.cast("string").alias("name"), F.struct(*(number(i).alias(n) for i, n in enumerate(SCALARS)), *blocks).alias("rpc"))


def _numbers(models, blocks: tuple[str, ...]):
    """name, place, value: the numbers of a model in the order of its file."""
    every = F.concat(F.array(*(f"rpc.{n}" for n in SCALARS)), *(f"rpc.{n}" for n in blocks))
    return models.select("name", F.posexplode(every).alias("place", "value"))


def _model_sql(folder: str, n: int) -> str:
    return f"SELECT '{folder}=' || s_suppkey AS name, CAST(i AS INTEGER) AS place, CAST(s_suppkey*(i + 3) % 1009 AS DOUBLE)/64 - 5 AS value FROM supplier, range({n}) r(i)"


@R.query(_model_sql("scene_key", 170))
def rpc_text_files(t):
    """Models written as labelled lines, one file a scene, and read back by position."""
    models = _models(t)
    S.write_rpc_text(models, path := _place(models, "models"))
    return _numbers(S.read_rpc_text(models.sparkSession, path), (*DIRECT, *INVERSE))


@R.query(_model_sql("scene", 90))
def read_rpb(t):
    models = _models(t)
    scalars = [F.concat(F.lit(f"\t{S.RPB[n]} = "), F.col(f"rpc.{n}").cast("string"), F.lit(";")) for n in SCALARS]
    lists = [F.concat(F.lit(f"\t{S.RPB[n]} = (\n\t\t\t"), F.array_join(F.transform(f"rpc.{n}", lambda x: x.cast("string")), ",\n\t\t\t"), F.lit(");")) for n in DIRECT]
    path = _texts(models.select(F.col("name").alias("scene"), F.concat_ws("\n", F.lit("BEGIN_GROUP = IMAGE"), *scalars, *lists, F.lit("END_GROUP = IMAGE")).alias("value")), "bracketed")
    return _numbers(S.read_rpb(models.sparkSession, path), DIRECT)


@R.query("""SELECT 'scene=' || l_suppkey AS name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS tie_id,
  l_partkey AS line, CAST(l_quantity AS BIGINT) AS samp FROM lineitem""")
def read_tie_points(t):
    rows = t("lineitem").groupBy(F.col("l_suppkey").alias("scene")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))).alias("r"))  # a file holds a scene
    path = _texts(rows.select("scene", F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["l_partkey"], x["l_quantity"])), "\n").alias("value")), "ties")
    return S.read_tie_points(rows.sparkSession, path)


@R.query("""WITH g AS (SELECT p_partkey//1500 AS g, p_partkey % 1500//50 AS r, p_partkey % 50 AS c, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS v FROM part)
  SELECT 'scene=' || g AS name, CAST(r//16 AS INTEGER) AS tile_r, CAST(c//16 AS INTEGER) AS tile_c, CAST(COUNT(DISTINCT r) AS INTEGER) AS h, CAST(COUNT(DISTINCT c) AS INTEGER) AS w, ROUND(SUM(v), 2) AS total, ROUND(MIN_BY(v, r*50 + c), 2) AS first
  FROM g GROUP BY 1, 2, 3""")
def read_dem_tiles(t):
    """Height grids of 30 x 50 (the last may have fewer rows) written as array files and read back in tiles of 16."""
    cells = t("part").groupBy(F.concat(F.lit("scene="), F.floor(F.col("p_partkey") / 1500).cast("string")).alias("name")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_retailprice"))).alias("g"))  # 1,500 cells
    grids = cells.select("name", (F.size("g") / 50).cast("int").alias("h"), F.lit(50).alias("w"), F.transform("g", lambda x: x["p_retailprice"].cast("float")).alias("v"))
    S.write_dem(grids, path := _place(grids, "dem"))
    tiles = S.read_dem_tiles(grids.sparkSession, path, 16)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(tiles.select("name", "tile_r", "tile_c", "h", "w", total.alias("total"), F.col("v")[0].cast("double").alias("first")), 2)


@R.query("SELECT event_id*1000000 + 500000 AS micros, 'event ' || event_type AS msg FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def log_tail(t):
    """Log lines, among them blank messages (ids divisible by 5) and lines cut short (by 7), followed by a stream."""
    line = F.to_json(F.struct((F.col("event_id") + 0.5).alias("timestamp"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit("event "), "event_type")).alias("msg")))
    rows = t("events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    rows.write.text(path := _place(rows, "log"))
    out = _place(rows, "tail")
    tail(rows.sparkSession, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-place").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema("at timestamp, msg string").parquet(out).select(F.unix_micros("at").alias("micros"), "msg")
