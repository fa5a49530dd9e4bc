"""Registered queries by name, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.operators.metrics import error_report
from groundweave.operators.spatial import overlap_pairs
from groundweave.plans import adjust_queries, camera_queries, crop_queries, embed_queries, metric_queries, raster_queries, sampling_queries, source_queries, spatial_queries
from groundweave.plans.base import Registry, Tables, rounded
from groundweave.plans.spatial_queries import MIN_AREA, scenes

R = Registry()


@R.query(f"""WITH p AS (SELECT a.scene_id AS s, b.scene_id AS r, (LEAST(a.x0+a.w, b.x0+b.w)-GREATEST(a.x0, b.x0))*(LEAST(a.y0+a.h, b.y0+b.h)-GREATEST(a.y0, b.y0)) AS area
    FROM scenes_fx a JOIN scenes_fx b ON a.scene_id < b.scene_id AND LEAST(a.x0+a.w, b.x0+b.w) >= GREATEST(a.x0, b.x0) AND LEAST(a.y0+a.h, b.y0+b.h) >= GREATEST(a.y0, b.y0)),
  k AS (SELECT s % 7 AS i, r % 7 AS j, COUNT(*) AS n_pairs, ROUND(SUM(area), 4) AS area FROM p WHERE area >= {MIN_AREA} GROUP BY 1, 2),
  e AS (SELECT i, j, COUNT(*) AS count, ROUND(AVG(d), 6) AS mean, ROUND(quantile_cont(d, 0.5), 6) AS median, ROUND(MAX(d), 6) AS max FROM pair_err_fx GROUP BY i, j)
  SELECT k.i, k.j, k.n_pairs, k.area, e.count, e.mean, e.median, e.max FROM k JOIN e ON k.i = e.i AND k.j = e.j""")
def overlap_error_report(t):
    """For each pair of image numbers: overlapping scene pairs, their shared area, and the error of their tie points."""
    k = overlap_pairs(scenes(t), MIN_AREA).groupBy((F.col("i") % 7).alias("i"), (F.col("j") % 7).alias("j")).agg(F.count("*").alias("n_pairs"), F.round(F.sum("area"), 4).alias("area"))
    e = error_report(t("pair_err_fx"), by=("i", "j"), overall=False).select("i", "j", "count", "mean", "median", "max")
    return rounded(k.join(e, ["i", "j"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_error_report(Tables(spark, sf_dir))


_PARTS = (R, metric_queries.R, raster_queries.R, sampling_queries.R, adjust_queries.R, spatial_queries.R, embed_queries.R, camera_queries.R, crop_queries.R, source_queries.R)
QUERIES = {k: v for r in _PARTS for k, v in r.queries.items()}
ORACLE_SQL = {k: v for r in _PARTS for k, v in r.sql.items()}
