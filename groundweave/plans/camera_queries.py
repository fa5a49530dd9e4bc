"""Registered queries of camera models. Scenes get simple models whose projection has a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundweave.functions import geometry as G
from groundweave.operators import cameras as O
from groundweave.plans.base import Registry, rounded
from groundweave.sources.shared import written

R = Registry()


def _block(**terms: float):
    """Twenty coefficients by place."""
    return F.array(*(F.lit(float(terms.get(f"t{i}", 0.0))) for i in range(20)))


def scenes(t):
    """One model for each supplier: line falls with latitude, samp grows with longitude and height."""
    k = F.col("s_suppkey")
    one = _block(t0=1)
    rpc = F.struct(
        *(F.lit(v).alias(n) for n, v in (("line_off", 5000.0), ("samp_off", 5000.0))), (k % 10 + 30.0).alias("lat_off"), (k % 7 + 100.0).alias("lon_off"),
        *(F.lit(v).alias(n) for n, v in (("height_off", 500.0), ("line_scale", 5000.0), ("samp_scale", 5000.0), ("lat_scale", 0.1), ("lon_scale", 0.1), ("height_scale", 500.0))),
        _block(t2=-1).alias("lnum"), one.alias("lden"), _block(t1=1, t3=0.01).alias("snum"), one.alias("sden"),
        _block(t1=-1).alias("latnum"), one.alias("latden"), _block(t2=1, t3=-0.01).alias("lonnum"), one.alias("londen"),
        F.array(F.lit(1.0), F.lit(0.0), (k % 3).cast("double"), F.lit(0.0), F.lit(1.0), (k % 5).cast("double")).alias("adj"),
    )
    return t("supplier").select(k.alias("scene_id"), rpc.alias("rpc"))


def _points(t):
    k = F.col("l_suppkey")
    return t("lineitem").select(k.alias("scene_id"), "l_orderkey", "l_linenumber", (k % 10 + 30.0 + F.col("l_tax")).alias("lat"), (k % 7 + 100.0 + F.col("l_discount") / 2).alias("lon"), (F.col("l_quantity") * 10).alias("h"))


_P = "SELECT l_suppkey AS scene_id, l_orderkey, l_linenumber, l_tax/0.1 AS p, l_discount/2/0.1 AS l, (l_quantity*10-500)/500 AS z, l_suppkey % 3 AS dl, l_suppkey % 5 AS ds FROM lineitem"


@R.query(f"SELECT scene_id, l_orderkey, l_linenumber, ROUND(5000 - 5000*p - dl, 3) AS line, ROUND(5000 + 5000*(l + 0.01*z) - ds, 3) AS samp FROM ({_P})")
def rpc_obj2photo(t):
    return rounded(O.rpc_obj2photo(_points(t), scenes(t)).select("scene_id", "l_orderkey", "l_linenumber", "line", "samp"), 3)


@R.query("SELECT l_suppkey AS scene_id, l_orderkey, l_linenumber, ROUND(l_suppkey % 10 + 30 - 0.1*((l_extendedprice/20 + l_suppkey % 3 - 5000)/5000) + 1e-10, 6) AS lat, ROUND(l_suppkey % 7 + 100 + 0.1*((l_quantity*100 + l_suppkey % 5 - 5000)/5000 - 0.01*((l_tax*1000-500)/500)) + 1e-10, 6) AS lon FROM lineitem")
def rpc_photo2obj(t):
    points = t("lineitem").select(F.col("l_suppkey").alias("scene_id"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20).alias("line"), (F.col("l_quantity") * 100).alias("samp"), (F.col("l_tax") * 1000).alias("h"))
    return rounded(O.rpc_photo2obj(points, scenes(t)).select("scene_id", "l_orderkey", "l_linenumber", (F.col("lat") + 1e-10).alias("lat"), (F.col("lon") + 1e-10).alias("lon")))


@R.query("""WITH g AS (SELECT l_suppkey AS a, l_suppkey % 9 + 1 AS b, l_orderkey, l_linenumber, l_suppkey % 10 + 30 - 0.1*((l_quantity*100 + l_suppkey % 3 - 5000)/5000) AS lat, l_suppkey % 7 + 100 + 0.1*((l_quantity*50 + l_suppkey % 5 - 5000)/5000 - 0.01*((l_tax*1000-500)/500)) AS lon, (l_tax*1000-500)/500 AS z FROM lineitem)
  SELECT a AS scene_a, b AS scene_b, l_orderkey, l_linenumber, ROUND(5000 - 50000*(lat - b % 10 - 30) - b % 3, 2) AS line_b, ROUND(5000 + 5000*((lon - b % 7 - 100)/0.1 + 0.01*z) - b % 5, 2) AS samp_b FROM g""")
def project_between_scenes(t):
    k = F.col("l_suppkey")
    points = t("lineitem").select(k.alias("scene_a"), (k % 9 + 1).alias("scene_b"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 100).alias("line"), (F.col("l_quantity") * 50).alias("samp"), (F.col("l_tax") * 1000).alias("h"))
    return rounded(O.project_between_scenes(points, scenes(t)).select("scene_a", "scene_b", "l_orderkey", "l_linenumber", "line_b", "samp_b"), 2)


@R.query("""SELECT s_suppkey AS scene_id, ROUND(6378137.0*radians(lon), 2) AS x0, ROUND(6378137.0*ln(tan(pi()/4 + radians(lat)/2)), 2) AS y0 FROM
  (SELECT s_suppkey, s_suppkey % 10 + 30 - 0.1*((s_suppkey % 3 - 5000)/5000.0) AS lat, s_suppkey % 7 + 100 + 0.1*((s_suppkey % 5 - 5000)/5000.0 + 0.01) AS lon FROM supplier)""")
def scene_corners(t):
    sized = scenes(t).withColumns({"h": F.lit(10000), "w": F.lit(10000), "heights": F.array(*(F.lit(float("nan")) for _ in range(4)))})
    return rounded(O.scene_corners(sized).select("scene_id", F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0")), 2)


@R.query(f"SELECT scene_id, l_orderkey, l_linenumber, ROUND(5000 - 5000*p - dl, 2) AS line, ROUND(5000 + 5000*(l + 0.01*z) - ds, 2) AS samp FROM ({_P})")
def xy_to_sampline(t):
    y, x = G.mercator(F.col("lat"), F.col("lon"))
    points = _points(t).select("scene_id", "l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), "h")
    return rounded(O.xy_to_sampline(points, scenes(t)).select("scene_id", "l_orderkey", "l_linenumber", "line", "samp"), 2)


@R.query("""SELECT l_suppkey % 3 + 1 AS scene_id, l_orderkey, l_linenumber, ROUND(1 + l_linenumber/4.0::DOUBLE, 2) AS line, ROUND((4 + l_quantity/2)/0.8, 2) AS samp, ROUND(400 + 2*(4 + l_quantity/2)/0.8, 2) AS height FROM lineitem""")
def xy_to_sampline_on_dem(t):
    """Points on a slope of two metres a sample, which a model moves by a tenth of a sample for each metre."""
    k, line, flat = F.col("scene_id"), 1 + F.col("l_linenumber") / 4, 14 + F.col("l_quantity") / 2
    lat, lon = k % 10 + 30 + (5000 - line - k % 3) / 50000, k % 7 + 100 + (flat + k % 5 - 5000) / 50000
    y, x = G.mercator(lat, lon)
    points = t("lineitem").withColumn("scene_id", F.col("l_suppkey") % 3 + 1).select("scene_id", "l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))
    own = scenes(t).where("scene_id <= 3").withColumns({"h": F.lit(10000), "w": F.lit(10000), "heights": F.array(*(F.lit(500.0) for _ in range(4)))})
    dem = t("cells_fx").select(F.explode(F.array(*(F.lit(s).cast("long") for s in (1, 2, 3)))).alias("grid_id"), "r", "c", (400 + F.col("c") * 2.0).alias("v"))
    found = O.xy_to_sampline_on_dem(points, own.join(O.scene_corners(own), "scene_id"), dem, tol=1e-6)
    return rounded(found.select("scene_id", "l_orderkey", "l_linenumber", "line", "samp", "height"), 2)


@R.query("SELECT s_suppkey AS scene_id, CAST(2500*i AS DOUBLE) AS line, CAST(2500*j AS DOUBLE) AS samp, CAST(500*k AS DOUBLE) AS h, CAST(5 AS DOUBLE) AS error FROM supplier, range(5) a(i), range(5) b(j), range(3) c(k) WHERE s_suppkey % 3 = 0")
def rpc_roundtrip_check(t):
    """Every third model's way to the ground is off by five lines."""
    off = F.when(F.col("scene_id") % 3 == 0, _block(t0=0.001, t1=-1)).otherwise(_block(t1=-1))
    return rounded(O.rpc_roundtrip_check(scenes(t).withColumn("rpc", F.col("rpc").withField("latnum", off)), 5, 3), 3)


@R.query("SELECT l_suppkey AS scene_id, l_orderkey, l_linenumber, ROUND(l_suppkey % 10 + 30 - 0.1*((l_quantity*100 + l_suppkey % 3 - 5000)/5000) + 1e-7, 6) AS lat, ROUND(l_suppkey % 7 + 100 + 0.1*((l_quantity*50 + l_suppkey % 5 - 5000)/5000 - 0.01*((l_tax*1000-500)/500)) + 1e-7, 6) AS lon FROM lineitem")
def inverse_rpc_fit(t):
    """Points taken to the ground by the fitted inverse of models whose own inverse is void."""
    void = F.array_repeat(F.lit(0.0), 20)
    fitted = written(O.inverse_rpc_fit(scenes(t).withColumn("rpc", F.col("rpc").withField("latnum", void).withField("lonnum", void))), "fitted")
    points = t("lineitem").select(F.col("l_suppkey").alias("scene_id"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 100).alias("line"), (F.col("l_quantity") * 50).alias("samp"), (F.col("l_tax") * 1000).alias("h"))
    return rounded(O.rpc_photo2obj(points, fitted).select("scene_id", "l_orderkey", "l_linenumber", (F.col("lat") + 1e-7).alias("lat"), (F.col("lon") + 1e-7).alias("lon")))


@R.query(f"SELECT scene_id, l_orderkey, l_linenumber, ROUND(5000 - 5000*p - dl, 1) AS line, ROUND(5000 + 5000*(l + 0.01*z) - ds, 1) AS samp, CAST(0 AS DOUBLE) AS a2 FROM ({_P})")
def bake_affine_into_rpc(t):
    """Points projected by models with their affine worked in, and what is left of the affine's shift."""
    baked = written(O.bake_affine_into_rpc(scenes(t)), "baked")
    left = baked.select(F.col("scene_id").alias("_s"), F.col("rpc.adj")[2].alias("a2"))
    projected = O.rpc_obj2photo(_points(t), baked)
    return rounded(projected.join(left, projected["scene_id"] == left["_s"]).select("scene_id", "l_orderkey", "l_linenumber", "line", "samp", "a2"), 1)


def _ties(t):
    """Observations of planted ground points: exact for every scene up to the err of the tie."""
    k = F.col("img") + 1
    return t("tie_obs_fx").select("tie_id", k.alias("scene_id"), F.lit(0.0).alias("e"), (F.lit(5000.0) - F.col("line") * 10 + F.col("err")).alias("line"), (F.lit(5000.0) + F.col("samp")).alias("samp"), F.col("height").alias("h"))


_GROUND = """o AS (SELECT tie_id, img + 1 AS s, 5000 - line*10 + err AS line, 5000 + samp AS samp, height AS h FROM tie_obs_fx),
  g AS (SELECT *, s % 10 + 30 - 0.1*((line + s % 3 - 5000)/5000) AS lat, s % 7 + 100 + 0.1*((samp + s % 5 - 5000)/5000 - 0.01*((h - 500)/500)) AS lon FROM o)"""


@R.query(f"""WITH {_GROUND}, p AS (SELECT DISTINCT img + 1 AS i, img % 7 + 2 AS j FROM tie_obs_fx WHERE img + 1 <> img % 7 + 2),
  e AS (SELECT p.i, p.j, a.h - b.h AS dh, SQRT(POW(5000 - 50000*(b.lat - a.s % 10 - 30) - a.s % 3 - a.line, 2) + POW(5000 + 5000*((b.lon - a.s % 7 - 100)/0.1 + 0.01*((b.h - 500)/500)) - a.s % 5 - a.samp, 2)) AS e
    FROM p JOIN g a ON a.s = p.i JOIN g b ON b.s = p.j AND b.tie_id = a.tie_id)
  SELECT i, j, ROUND(AVG(e), 3) AS mean, ROUND(quantile_cont(e, 0.5), 3) AS median, ROUND(MAX(e), 3) AS max, COUNT(*) AS n, ROUND(AVG(dh), 3) AS dh FROM e GROUP BY i, j""")
def pair_point_error(t):
    pairs = t("tie_obs_fx").select((F.col("img") + 1).alias("i"), (F.col("img") % 7 + 2).alias("j")).distinct().where("i <> j")
    return rounded(O.pair_point_error(pairs, _ties(t), scenes(t)), 3)


@R.query("""WITH o AS (SELECT tie_id, img + 1 AS s, 5000 + err AS line, 5000 + samp/10 AS samp, height FROM tie_obs_fx),
  h AS (SELECT tie_id, quantile_cont(height, 0.5) AS h FROM o GROUP BY tie_id),
  g AS (SELECT s, tie_id, line + s % 3 AS y, samp + s % 5 AS x FROM o JOIN h USING (tie_id)),
  e AS (SELECT s, SQRT(POW(y - AVG(y) OVER (PARTITION BY tie_id), 2) + POW(x - AVG(x) OVER (PARTITION BY tie_id), 2)) AS e FROM g)
  SELECT s AS scene_id, COUNT(*) AS n, ROUND(AVG(e), 4) AS mean, ROUND(MAX(e), 4) AS max FROM e GROUP BY s""")
def multiview_residuals(t):
    """By scene. Scenes over one place, whose models differ in their shifts alone: the best fit is the mean of what they see."""
    over = scenes(t).withColumn("rpc", F.col("rpc").withField("lat_off", F.lit(30.0)).withField("lon_off", F.lit(100.0)))
    ties = t("tie_obs_fx").select("tie_id", (F.col("img") + 1).alias("scene_id"), (F.col("err") + 5000).alias("line"), (F.col("samp") / 10 + 5000).alias("samp"), F.col("height").alias("h"))
    found = O.multiview_residuals(ties, over)
    return rounded(found.groupBy("scene_id").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.max("residual").alias("max")), 4)


@R.query("""WITH o AS (SELECT tie_id, img + 1 AS s, 5000 + err AS line, 5000 + samp/10 AS samp FROM tie_obs_fx WHERE 5000 + err < 5005 AND 5000 + samp/10 < 5006),
  p AS (SELECT DISTINCT img + 1 AS i, img % 7 + 2 AS j FROM tie_obs_fx WHERE img + 1 <> img % 7 + 2),
  e AS (SELECT p.i, p.j, SQRT(POW(a.line + a.s % 3 - b.line - b.s % 3, 2) + POW(a.samp + a.s % 5 - b.samp - b.s % 5, 2))/2 AS e FROM p JOIN o a ON a.s = p.i JOIN o b ON b.s = p.j AND b.tie_id = a.tie_id)
  SELECT p.i, p.j, COUNT(e) AS n, ROUND(AVG(e), 3) AS mean, ROUND(quantile_cont(e, 0.5), 3) AS median, ROUND(MAX(e), 3) AS max FROM p LEFT JOIN e ON p.i = e.i AND p.j = e.j GROUP BY p.i, p.j""")
def pair_tie_errors(t):
    """Two scenes over one place see a tie from where their shifts put it: each misses the middle by half of what parts them."""
    over = scenes(t).withColumn("rpc", F.col("rpc").withField("lat_off", F.lit(30.0)).withField("lon_off", F.lit(100.0))).withColumns({"h": F.lit(5005), "w": F.lit(5006)})
    ties = t("tie_obs_fx").select("tie_id", (F.col("img") + 1).alias("scene_id"), (F.col("err") + 5000).alias("line"), (F.col("samp") / 10 + 5000).alias("samp"), F.col("height").alias("h"))
    pairs = t("tie_obs_fx").select((F.col("img") + 1).alias("i"), (F.col("img") % 7 + 2).alias("j")).distinct().where("i <> j")
    return rounded(O.pair_tie_errors(pairs, ties, over), 3)


def _edges(t):
    o = t("tie_obs_fx")
    side = lambda s: o.select("tie_id", (F.col("img") + 1).alias(s), (F.lit(5000.0) - F.col("line") * 10 + F.col("err")).alias(f"line_{s}"), (F.lit(5000.0) + F.col("samp")).alias(f"samp_{s}"), F.col("height").alias(f"h_{s}"))
    return side("i").join(side("j"), "tie_id").where("i < j").select("i", "j", "line_i", "samp_i", "line_j", "samp_j", F.col("h_i").alias("h"))


def _tied(t):
    """The scenes that have tie points."""
    return scenes(t).join(t("tie_obs_fx").select((F.col("img") + 1).alias("scene_id")).distinct(), "scene_id", "left_semi")


def _over(t):
    """The scenes that have tie points, all over one place."""
    return _tied(t).withColumn("rpc", F.col("rpc").withField("lat_off", F.lit(30.0)).withField("lon_off", F.lit(100.0)))


def _planted(t):
    """Ties of ground points spread over the scenes, which image k sees k % 4 lines down and k % 3 samples to the left."""
    o = t("tie_obs_fx").select("tie_id", (F.col("img") + 1).alias("k"), F.lit(500.0).alias("h"))
    line, samp = 3000 + F.col("tie_id") % 97 * 40 + F.col("k") % 4, 3300 + F.col("tie_id") % 89 * 40 - F.col("k") % 3
    side = lambda s: o.select("tie_id", F.col("k").alias(s), line.cast("double").alias(f"line_{s}"), samp.cast("double").alias(f"samp_{s}"), F.col("h").alias(f"h_{s}"))
    return side("i").join(side("j"), "tie_id").where("i < j").select("i", "j", "line_i", "samp_i", "line_j", "samp_j", F.col("h_i").alias("h"))


@R.query("SELECT DISTINCT img + 1 AS scene_id, 1::DOUBLE AS m0, 0::DOUBLE AS m1, CAST(2 - (img + 1) % 4 AS DOUBLE) AS m2, 0::DOUBLE AS m3, 1::DOUBLE AS m4, CAST((img + 1) % 3 - 2 AS DOUBLE) AS m5, 0::DOUBLE AS rms FROM tie_obs_fx")
def block_adjustment(t):
    """Affines against the anchor 2 that undo the planted shifts."""
    found = O.block_adjustment(_planted(t), _over(t), 2)
    return found.select("scene_id", *((F.round(F.col("m")[i], 3) + 0.0).alias(f"m{i}") for i in range(6)), F.round("rms", 3).alias("rms"))


@R.query("""WITH o AS (SELECT tie_id, img + 1 AS s, 5000 - line*10 + err - 50000*((img + 1) % 10) AS y, 5000 + samp + 50000*((img + 1) % 7) AS x FROM tie_obs_fx)
  SELECT ROUND(SQRT(SUM(POW(a.y - b.y, 2) + POW(a.x - b.x, 2))/2/(4*COUNT(*))), 3) AS rms FROM o a JOIN o b ON a.tie_id = b.tie_id AND a.s < b.s""")
def adjustment_rms(t):
    """Two scenes of equal slopes share what separates them in halves."""
    return rounded(O.adjustment_rms(_edges(t), _tied(t)), 3)
