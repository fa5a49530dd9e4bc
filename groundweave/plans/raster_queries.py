"""Registered queries of rasters and match points, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundweave.operators import raster as O
from groundweave.plans.base import Registry, rounded

R = Registry()


def _points(t):
    return t("tie_obs_fx").select("tie_id", "img", F.lit(0).cast("long").alias("grid_id"), (F.col("line") / 4).alias("line"), (F.col("samp") / 2 - 1).alias("samp"))


_POINTS = "(SELECT tie_id, img, line/4 AS line, samp/2 - 1 AS samp FROM tie_obs_fx)"


@R.query(f"SELECT p.tie_id, p.img, CAST(0 AS BIGINT) AS grid_id, ROUND(p.line, 6) AS line, ROUND(p.samp, 6) AS samp, ROUND(d.v, 6) AS height FROM {_POINTS} p LEFT JOIN cells_fx d ON p.line >= 0 AND p.samp >= 0 AND d.r = CAST(trunc(p.line) AS BIGINT) AND d.c = CAST(trunc(p.samp) AS BIGINT)")
def dem_nearest(t):
    return rounded(O.dem_nearest(_points(t), t("cells_fx")))


# Heights are rounded as decimals, half up, as heights at quarters of a cell lie on halves of the last digit.
@R.query(f"""WITH k AS (SELECT tie_id, img, LEAST(GREATEST(line, 0), last_r) AS y, LEAST(GREATEST(samp, 0), last_c) AS x FROM {_POINTS} CROSS JOIN (SELECT MAX(r) AS last_r, MAX(c) AS last_c FROM cells_fx) e),
  w AS (SELECT tie_id, img, CAST(floor(y) AS BIGINT) AS r0, CAST(floor(x) AS BIGINT) AS c0, y - floor(y) AS fy, x - floor(x) AS fx FROM k),
  p AS (SELECT *, (1 - fy)*(1 - fx) AS w0, (1 - fy)*fx AS w1, fy*(1 - fx) AS w2, fy*fx AS w3 FROM w)
  SELECT p.tie_id, p.img, CAST(ROUND(CAST(CAST({" + ".join(f"CASE WHEN w{i} = 0 THEN 0 ELSE w{i}*d{i}.v END" for i in range(4))} AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) AS height
  FROM p {" ".join(f"LEFT JOIN cells_fx d{i} ON d{i}.r = r0 + {i // 2} AND d{i}.c = c0 + {i % 2}" for i in range(4))}""")
def dem_bilinear(t):
    return rounded(O.dem_bilinear(_points(t), t("cells_fx")).select("tie_id", "img", "height"), 3)


@R.query("SELECT grid_id, CAST(floor(r/4) AS BIGINT) AS br, CAST(floor(c/4) AS BIGINT) AS bc, ROUND(COALESCE(quantile_cont(v, 0.5), -1), 6) AS v FROM cells_fx GROUP BY 1, 2, 3")
def block_nanmedian(t):
    return rounded(O.block_nanmedian(t("cells_fx"), 4))


@R.query("SELECT grid_id, CAST(floor(r/2) AS BIGINT) AS br, CAST(floor(c/2) AS BIGINT) AS bc, ROUND(AVG(v), 6) AS v FROM cells_fx GROUP BY 1, 2, 3 HAVING COUNT(*) = 4")
def block_mean(t):
    return rounded(O.block_mean(t("cells_fx"), 2))


@R.query("SELECT grid_id, CAST(floor(r/4) AS BIGINT) AS br, CAST(floor(c/4) AS BIGINT) AS bc, ROUND(AVG(v), 6) AS v FROM cells_fx WHERE r%4 IN (1,2) AND c%4 IN (1,2) GROUP BY 1, 2, 3 HAVING COUNT(v) = 4")
def block_center_sample(t):
    return rounded(O.block_center_sample(t("cells_fx"), 4))


@R.query("""WITH g AS (SELECT r % 3 AS grid_id, r, c, v FROM cells_fx), s AS (SELECT grid_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM g GROUP BY grid_id)
  SELECT grid_id, r, c, ROUND(v, 6) AS v, COALESCE(CAST(trunc(LEAST(GREATEST((v-a)/(b-a)*255, 0), 255)) AS INTEGER), 0) AS level FROM g JOIN s USING (grid_id)""")
def percentile_stretch(t):
    return rounded(O.percentile_stretch(t("cells_fx").select((F.col("r") % 3).alias("grid_id"), "r", "c", "v")))


@R.query("""WITH g AS (SELECT r % 3 AS grid_id, r, c, v - 30 AS v FROM cells_fx), s AS (SELECT grid_id, quantile_cont(v, 0.02) FILTER (v > 0) AS a, quantile_cont(v, 0.98) FILTER (v > 0) AS b FROM g GROUP BY grid_id)
  SELECT grid_id, r, c, ROUND(v, 6) AS v, COALESCE(CAST(trunc((LEAST(GREATEST(v, a), b)-a)/(b-a)*255) AS INTEGER), 0) AS level FROM g JOIN s USING (grid_id)""")
def percentile_stretch_positive(t):
    """The stretch whose percentiles leave the background out."""
    return rounded(O.percentile_stretch(t("cells_fx").select((F.col("r") % 3).alias("grid_id"), "r", "c", (F.col("v") - 30).alias("v")), positive=True))


@R.query("SELECT r % 7 AS grid_id, ROUND(AVG(CASE WHEN conf > 0.1 AND v IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM cells_fx GROUP BY 1 HAVING AVG(CASE WHEN conf > 0.1 AND v IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8")
def valid_pixel_ratio(t):
    return rounded(O.valid_pixel_ratio(t("cells_fx").select((F.col("r") % 7).alias("grid_id"), "v", (F.col("conf") > 0.1).cast("int").alias("mask")), 0.8))


_ROUND = "CAST(round_even({0}, 0) AS BIGINT)"


@R.query(f"SELECT group_id, img_b, xb, yb, {_ROUND.format('xb')} AS px, {_ROUND.format('yb')} AS py FROM matches_fx WHERE {_ROUND.format('xb')} BETWEEN 0 AND 19 AND {_ROUND.format('yb')} BETWEEN 0 AND 19")
def in_bounds_points(t):
    return O.in_bounds_points(t("matches_fx").select("group_id", "img_b", "xb", "yb"), 20, 20, "xb", "yb")


@R.query(f"""WITH p AS (SELECT group_id, img_a AS img, xa AS x, ya AS y, sqrt((xa-xb)*(xa-xb)+(ya-yb)*(ya-yb)) AS d FROM matches_fx UNION ALL SELECT group_id, img_b, xb, yb, sqrt((xa-xb)*(xa-xb)+(ya-yb)*(ya-yb)) FROM matches_fx)
  SELECT group_id, img, {_ROUND.format('y')} AS py, {_ROUND.format('x')} AS px, ROUND(CAST(CAST(quantile_cont(d, 0.5) AS FLOAT) AS DOUBLE), 5) AS v FROM p
  WHERE {_ROUND.format('x')} BETWEEN 0 AND 24 AND {_ROUND.format('y')} BETWEEN 0 AND 24 GROUP BY 1, 2, 3, 4""")
def point_parallax(t):
    return O.point_parallax(t("matches_fx"), 25, 25).withColumn("v", F.round(F.col("v").cast("double"), 5))


@R.query("""WITH k AS (SELECT c % 4 AS img, r, c, conf FROM cells_fx), e AS (SELECT img, MAX(r) AS r, MAX(c) AS c FROM k GROUP BY img),
  m AS (SELECT f.*, CAST(trunc(LEAST(GREATEST(ya, 0), a.r)) AS BIGINT) AS ra, CAST(trunc(LEAST(GREATEST(xa, 0), a.c)) AS BIGINT) AS ca, CAST(trunc(LEAST(GREATEST(yb, 0), b.r)) AS BIGINT) AS rb, CAST(trunc(LEAST(GREATEST(xb, 0), b.c)) AS BIGINT) AS cb
    FROM matches_fx f JOIN e a ON a.img = img_a JOIN e b ON b.img = img_b),
  s AS (SELECT m.*, COUNT(*) OVER (PARTITION BY group_id, img_a, img_b) AS n FROM m JOIN k a ON a.img = img_a AND a.r = ra AND a.c = ca AND a.conf > 0.5 JOIN k b ON b.img = img_b AND b.r = rb AND b.c = cb AND b.conf > 0.5)
  SELECT group_id, img_a, img_b, ROUND(xa*2, 6) AS xa, ROUND(ya*2, 6) AS ya, ROUND(xb*2, 6) AS xb, ROUND(yb*2, 6) AS yb FROM s WHERE n >= 4""")
def confident_matches(t):
    return rounded(O.confident_matches(t("matches_fx"), t("cells_fx").select((F.col("c") % 4).alias("img"), "r", "c", "conf"), scale=2.0))


@R.query("""WITH s AS (SELECT r % 5 AS id, c % 5 AS rank, AVG(CASE WHEN COALESCE(v, -1)/60 < 3 THEN 1.0 ELSE 0.0 END) AS g, AVG(CASE WHEN COALESCE(v, -1)/60 > 5 THEN 1.0 ELSE 0.0 END) AS b FROM cells_fx GROUP BY 1, 2)
  SELECT id, COALESCE(MIN(CASE WHEN g > 0.2 AND b < 0.7 THEN rank END), MAX(rank)) AS rank, BOOL_OR(g > 0.2 AND b < 0.7) AS accepted FROM s GROUP BY id""")
def crop_acceptance(t):
    return O.crop_acceptance(t("cells_fx").select((F.col("r") % 5).alias("id"), (F.col("c") % 5).alias("rank"), (F.coalesce("v", F.lit(-1.0)) / 60).alias("residual")))


@R.query("""SELECT a.r % 3 AS window_id, ROUND(sqrt(AVG(a.conf)*AVG(1-a.conf/2)), 6) AS score, ROUND(AVG(sqrt(a.conf*(1-a.conf/2))), 6) AS sub_score FROM cells_fx a GROUP BY 1""")
def window_scores(t):
    cells = t("cells_fx").select((F.col("r") % 3).alias("window_id"), "r", "c", "conf")
    return rounded(O.window_scores(cells, cells.withColumn("conf", 1 - F.col("conf") / 2)))


@R.query("""WITH s AS (SELECT unnest([0, 20, 30]) AS tc), p AS (SELECT d.r, d.c, v + tc AS v FROM cells_fx d JOIN s ON d.c >= tc AND d.c < tc + 20 WHERE v IS NOT NULL)
  SELECT CAST(0 AS BIGINT) AS image_id, r, c, ROUND(AVG(v), 6) AS v FROM p GROUP BY r, c""")
def tile_blend(t):
    tiles = t("cells_fx").where("v is not null").withColumn("tc", F.explode(O.tile_starts(F.lit(50), 20, 20)))
    preds = tiles.where("c >= tc and c < tc + 20").select(F.col("grid_id").alias("image_id"), F.lit(0).cast("long").alias("tr"), F.col("tc").cast("long"), F.col("r").alias("dr"), (F.col("c") - F.col("tc")).alias("dc"), (F.col("v") + F.col("tc")).alias("v"))
    return rounded(O.tile_blend(preds))


@R.query("""WITH b AS (SELECT r % 4 AS batch, r, c, CASE WHEN v IS NULL THEN -1.0 ELSE v/60 END AS residual FROM cells_fx), m AS (SELECT batch, MAX(residual) AS most FROM b GROUP BY batch)
  SELECT batch, r, c, ROUND(residual, 6) AS residual, ROUND(1/(1+exp(ln(9.0)/4*(LEAST(GREATEST(CASE WHEN residual < 0 THEN most ELSE residual END, 0), 16)-6))), 6) AS conf FROM b JOIN m USING (batch)""")
def residual_to_conf(t):
    return rounded(O.residual_to_conf(t("cells_fx").select((F.col("r") % 4).alias("batch"), "r", "c", F.coalesce(F.col("v") / 60, F.lit(-1.0)).alias("residual"))))


@R.query("""WITH l AS (SELECT r % 3 AS grp, 'v' AS name, CASE WHEN v IS NULL THEN CAST('nan' AS DOUBLE) ELSE v END AS x FROM cells_fx UNION ALL SELECT r % 3, 'conf', CASE WHEN conf = 1 THEN CAST('inf' AS DOUBLE) ELSE conf END FROM cells_fx)
  SELECT grp, name, BOOL_OR(isnan(x)) AS has_nan, BOOL_OR(isinf(x)) AS has_inf, CAST(SUM(CASE WHEN isnan(x) OR isinf(x) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM l GROUP BY 1, 2""")
def nonfinite_audit(t):
    cells = t("cells_fx").select((F.col("r") % 3).alias("grp"), F.coalesce("v", F.lit(float("nan"))).alias("v"), F.when(F.col("conf") == 1, float("inf")).otherwise(F.col("conf")).alias("conf"))
    return O.nonfinite_audit(cells, ("v", "conf"), "grp")


@R.query("SELECT window_id FROM (SELECT r*10 + c // 5 AS window_id, BOOL_OR(v IS NULL) AS bad FROM cells_fx GROUP BY 1) WHERE NOT bad")
def valid_windows(t):
    arrays = t("cells_fx").groupBy((F.col("r") * 10 + F.floor(F.col("c") / 5)).alias("window_id")).agg(F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("image"))
    return O.valid_windows(arrays, arrays, ("image",))[0].select("window_id")


@R.query("SELECT tie_id, ROUND(quantile_cont(height, 0.5), 6) AS height FROM tie_obs_fx GROUP BY tie_id")
def height_fusion(t):
    return rounded(O.height_fusion(t("tie_obs_fx")))


@R.query("""WITH l AS (SELECT MIN(last) AS last, COUNT(*) AS n FROM (SELECT img, MAX(tie_id) AS last FROM tie_obs_fx GROUP BY img))
  SELECT tie_id, img, line FROM tie_obs_fx WHERE tie_id IN (SELECT tie_id FROM tie_obs_fx, l WHERE tie_id <= l.last GROUP BY tie_id, l.n HAVING COUNT(DISTINCT img) = l.n)""")
def tie_points_aligned(t):
    return O.tie_points_aligned(t("tie_obs_fx"), "truncate").select("tie_id", "img", "line")


@R.query("""WITH i AS (SELECT c_nationkey * 2 AS group_id, CAST(c_custkey % 4 AS INTEGER) AS img, MIN(CASE WHEN c_custkey % 31 = 0 THEN 7 ELSE 8 END) AS h FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1, 2),
  p AS (SELECT * FROM i WHERE group_id % 8 <> img), g AS (SELECT DISTINCT group_id FROM i),
  per AS (SELECT group_id, COUNT(*) AS n, MIN(img) AS a, MAX(img) AS b, COUNT(DISTINCT h) AS s FROM i GROUP BY group_id)
  SELECT DISTINCT i.group_id, 'keys differ' AS violation FROM i LEFT JOIN p ON i.group_id = p.group_id AND i.img = p.img WHERE p.img IS NULL
  UNION SELECT group_id, 'shapes differ' FROM per WHERE s > 1 UNION SELECT group_id, 'too few images' FROM per WHERE n < 2
  UNION SELECT group_id, 'keys not consecutive' FROM per WHERE a <> 0 OR b <> n - 1
  UNION SELECT x, 'missing group' FROM (SELECT CAST(unnest(range((SELECT MIN(group_id) FROM g), (SELECT MAX(group_id) FROM g) + 1)) AS INTEGER) AS x) WHERE x NOT IN (SELECT group_id FROM g)""")
def group_integrity(t):
    images = t("customer").where("c_custkey % 3 > 0").groupBy((F.col("c_nationkey") * 2).alias("group_id"), (F.col("c_custkey") % 4).cast("int").alias("img")).agg(F.min(F.when(F.col("c_custkey") % 31 == 0, 7).otherwise(8)).alias("h")).withColumn("w", F.lit(8))
    return O.group_integrity(images.select("group_id").distinct(), images, images.where("group_id % 8 <> img"))
