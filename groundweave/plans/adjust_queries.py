"""Registered queries of the adjustment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundweave.functions import geometry as G
from groundweave.operators import adjust as O
from groundweave.plans.base import Registry, rounded

R = Registry()

_EDGES = "(SELECT s_suppkey % 40 AS i, 40 + s_suppkey % 37 AS j, 1000.0 + (s_suppkey * 7919) % 5000 AS area FROM supplier)"


def _edges(t):
    k = F.col("s_suppkey")
    return t("supplier").select((k % 40).alias("i"), (40 + k % 37).alias("j"), (1000.0 + (k * 7919) % 5000).alias("area"))


@R.query(f"SELECT scene_id, CAST(SUM(area) AS DOUBLE) AS area FROM (SELECT i AS scene_id, area FROM {_EDGES} UNION ALL SELECT j, area FROM {_EDGES}) GROUP BY scene_id ORDER BY area DESC, scene_id LIMIT 1")
def anchor_scene(t):
    return rounded(O.anchor_scene(_edges(t)))


@R.query(f"SELECT i, j, CAST(area AS DOUBLE) AS area, CAST(floor(CAST(area AS DOUBLE)/(SELECT CAST(MIN(area) AS DOUBLE) FROM {_EDGES})*256) AS BIGINT) AS k FROM {_EDGES}")
def tie_sample_counts(t):
    return O.tie_sample_counts(_edges(t))


@R.query("SELECT pair_id AS scene_id, ROUND(AVG(sx), 6) AS m0, ROUND(AVG(sy), 6) AS m1, ROUND(AVG(dx), 6) AS m2, ROUND(AVG(dy), 6) AS m3, ROUND(AVG(wgt), 6) AS m4, ROUND(AVG(sx*2), 6) AS m5, COUNT(*) AS n_refs FROM fit_fx GROUP BY pair_id")
def merge_reference_affines(t):
    edges = t("fit_fx").select(F.col("pair_id").alias("scene_id"), F.array("sx", "sy", "dx", "dy", "wgt", F.col("sx") * 2).alias("m"))
    return rounded(O.merge_reference_affines(edges).select("scene_id", *(F.col("m")[i].alias(f"m{i}") for i in range(6)), "n_refs"))


_FIT = """WITH w AS (SELECT *, GREATEST(wgt, 0) + 1e-10 AS g FROM fit_fx), a AS (SELECT pair_id, SUM(g*sx)/SUM(g) AS ax, SUM(g*sy)/SUM(g) AS ay, SUM(g*dx)/SUM(g) AS bx, SUM(g*dy)/SUM(g) AS b_y FROM w GROUP BY pair_id),
  s AS (SELECT w.pair_id, ax, ay, bx, b_y, SUM(g*(sx-ax)*(sx-ax)) AS xx, SUM(g*(sx-ax)*(sy-ay)) AS xy, SUM(g*(sy-ay)*(sy-ay)) AS yy, SUM(g*(sx-ax)*(dx-bx)) AS xu, SUM(g*(sy-ay)*(dx-bx)) AS yu, SUM(g*(sx-ax)*(dy-b_y)) AS xv, SUM(g*(sy-ay)*(dy-b_y)) AS yv FROM w JOIN a ON w.pair_id = a.pair_id GROUP BY w.pair_id, ax, ay, bx, b_y),
  m AS (SELECT *, (yy*xu-xy*yu)/(xx*yy-xy*xy) AS p, (xx*yu-xy*xu)/(xx*yy-xy*xy) AS q, (yy*xv-xy*yv)/(xx*yy-xy*xy) AS r, (xx*yv-xy*xv)/(xx*yy-xy*xy) AS t FROM s)
  SELECT pair_id, ROUND(p, 4) AS m0, ROUND(q, 4) AS m1, ROUND(bx-p*ax-q*ay, 4) AS m2, ROUND(r, 4) AS m3, ROUND(t, 4) AS m4, ROUND(b_y-r*ax-t*ay, 4) AS m5 FROM m"""


@R.query(_FIT)
def weighted_affine_fit(t):
    fit = O.weighted_affine_fit(t("fit_fx").withColumnRenamed("wgt", "score"), "pair_id")
    return rounded(fit.select("pair_id", *(F.col("m")[i].alias(f"m{i}") for i in range(6))), 4)


@R.query(_FIT.replace(" AS xx", " + 1000 AS xx").replace(" AS yy", " + 1000 AS yy"))
def weighted_affine_fit_damped(t):
    """The same with a thousand on the diagonal of the centred sums."""
    fit = O.weighted_affine_fit(t("fit_fx").withColumnRenamed("wgt", "score"), "pair_id", damping=1000.0)
    return rounded(fit.select("pair_id", *(F.col("m")[i].alias(f"m{i}") for i in range(6))), 4)


@R.query(f"SELECT i, j, ROUND(CAST(a AS DOUBLE), 6) AS m2, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT i, j, area AS a FROM {_EDGES} UNION ALL SELECT j, i, -area FROM {_EDGES})")
def directed_edges(t):
    m = lambda s: F.array(F.lit(1.0), F.lit(0.0), F.col("area") * s, F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return O.directed_edges(_edges(t).select("i", "j", m(1).alias("m_ij"), m(-1).alias("m_ji"))).select("i", "j", F.col("m")[2].alias("m2"), "weight")


@R.query("SELECT l_suppkey AS k, l_tax AS a, CAST(NULL AS DOUBLE) AS b FROM lineitem UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def stack_results(t):
    return O.stack_results(t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_tax").alias("a")), t("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("b")))


@R.query("""WITH w AS (SELECT c_custkey // 3 AS window_id, c_custkey % 3 AS step, 1 + (c_custkey % 7)/100.0 AS s, c_custkey % 11 + 0.0 AS t FROM customer),
  o AS (SELECT window_id, MAX(CASE WHEN step = 0 THEN s END) AS s0, MAX(CASE WHEN step = 1 THEN s END) AS s1, MAX(CASE WHEN step = 2 THEN s END) AS s2, MAX(CASE WHEN step = 0 THEN t END) AS t0, MAX(CASE WHEN step = 1 THEN t END) AS t1, MAX(CASE WHEN step = 2 THEN t END) AS t2 FROM w GROUP BY window_id)
  SELECT window_id, ROUND(CAST(COALESCE(s2,1) AS DOUBLE)*COALESCE(s1,1)*COALESCE(s0,1), 6) AS m0, ROUND(CAST(COALESCE(s2,1) AS DOUBLE)*(COALESCE(s1,1)*COALESCE(t0,0)+COALESCE(t1,0))+COALESCE(t2,0), 6) AS m2 FROM o""")
def compose_affines(t):
    k = F.col("c_custkey")
    s, d = 1 + (k % 7) / 100, (k % 11).cast("double")
    deltas = t("customer").select(F.floor(k / 3).cast("long").alias("window_id"), (k % 3).alias("step"), F.array(s, F.lit(0.0), d, F.lit(0.0), s, d).alias("m"))
    return rounded(O.compose_affines(deltas).select("window_id", F.col("m")[0].alias("m0"), F.col("m")[2].alias("m2")))


@R.query("""WITH p AS (SELECT c_custkey // 3 AS id, c_custkey % 3 AS step, 1 + 0.1*(c_custkey % 7) AS s, CAST(c_custkey % 11 AS DOUBLE) AS t, 0.05*(c_custkey % 13 - 6) AS a, 0.03*(c_custkey // 3 % 5) AS b FROM customer), g AS (SELECT * FROM (VALUES (0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0)) v(r, c)),
  e AS (SELECT id, step, AVG(sqrt(pow(s*(cos(a)*r - sin(a)*c) + t - cos(b)*r + sin(b)*c, 2) + pow(s*(sin(a)*r + cos(a)*c) + t - sin(b)*r - cos(b)*c, 2))) AS epe, MAX(sqrt(2*t*t)) AS translation, MAX(abs(degrees(a) - degrees(b))) AS rotation FROM p, g GROUP BY id, step), l AS (SELECT *, MAX(step) OVER (PARTITION BY id) AS last FROM e)
  SELECT id, ROUND(MAX(CASE WHEN step = last THEN epe END), 6) AS epe_last, ROUND(SUM(epe*pow(0.8, last-step))/SUM(pow(0.8, last-step)), 6) AS epe_decayed, ROUND(MAX(CASE WHEN step = last THEN rotation END), 6) AS rotation, ROUND(MAX(CASE WHEN step = last THEN translation END), 6) AS translation FROM l GROUP BY id""")
def affine_endpoint_error(t):
    """Turned, scaled and shifted affines against turned ones."""
    k = F.col("c_custkey")
    s, d, a = (k % 7) * 0.1 + 1, (k % 11).cast("double"), (k % 13 - 6) * 0.05
    pred = t("customer").select(F.floor(k / 3).cast("long").alias("id"), (k % 3).alias("step"), F.array(s * F.cos(a), -s * F.sin(a), d, s * F.sin(a), s * F.cos(a), d).alias("m"))
    b, zero = F.col("id") % 5 * 0.03, F.lit(0.0)
    truth = pred.select("id").distinct().withColumn("m", F.array(F.cos(b), -F.sin(b), zero, F.sin(b), F.cos(b), zero))
    return rounded(O.affine_endpoint_error(pred, truth, _grid(t)))


def _grid(t):
    return t("nation").select((F.col("n_nationkey") % 2 * 10.0).alias("r"), (F.floor(F.col("n_nationkey") / 2) % 2 * 10.0).alias("c")).distinct()


@R.query("""WITH e AS (SELECT c_custkey AS i, c_custkey + 1000000 AS j, CAST(c_custkey % 13 AS DOUBLE) AS t, CAST(c_custkey % 5 AS DOUBLE) AS u FROM customer)
  SELECT i, j, ROUND(sqrt(2*(t-u)*(t-u)), 6) AS cycle FROM e""")
def cycle_consistency(t):
    k = F.col("c_custkey")
    shift = lambda d: F.array(F.lit(1.0), F.lit(0.0), d, F.lit(0.0), F.lit(1.0), d)
    pairs = t("customer").select(k.alias("i"), (k + 1000000).alias("j"), shift((k % 13).cast("double")).alias("m_ij"), shift(-(k % 5).cast("double")).alias("m_ji"))
    return rounded(O.cycle_consistency(O.directed_edges(pairs), _grid(t)))


@R.query("""WITH k AS (SELECT scene_id % 9 AS pair_id, scene_id AS parent_id, c AS child, x0 + (c % 2)*w/2 AS x0, y0 + (c // 2)*h/2 AS y0, x0 + (c % 2 + 1)*w/2 AS x1, y0 + (c // 2 + 1)*h/2 AS y1, CAST((scene_id * (c + 3)) % 101 AS DOUBLE) AS score FROM scenes_fx, (VALUES (0), (1), (2), (3)) v(c))
  SELECT pair_id, parent_id, child, x0, y0, x1, y1, ROUND(score*pow(0.5, row_number() OVER (PARTITION BY pair_id, parent_id ORDER BY score DESC, child) - 1), 6) AS score FROM k""")
def quad_split(t):
    own = F.array(*(((F.col("scene_id") * (c + 3)) % 101).cast("double") for c in range(4)))
    windows = t("scenes_fx").select((F.col("scene_id") % 9).alias("pair_id"), F.col("scene_id").alias("window_id"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.lit(0.0).alias("score"), own.alias("child_score"))
    return rounded(O.quad_split(windows))


@R.query("""WITH e AS (SELECT DISTINCT c_custkey AS i, CASE WHEN c_custkey % 10 < 9 THEN c_custkey + 1 ELSE c_custkey - 9 END AS j FROM customer),
  r AS (SELECT i, j, row_number() OVER (ORDER BY (i // 10) * 10, i, j) - 1 AS rn, COUNT(*) OVER () AS n FROM e)
  SELECT i, j, CAST(CASE WHEN rn < (n % 7)*(n // 7 + 1) THEN rn // (n // 7 + 1) ELSE n % 7 + (rn - (n % 7)*(n // 7 + 1)) // (n // 7) END AS INTEGER) AS batch FROM r""")
def edge_batches(t):
    k = F.col("c_custkey")
    edges = t("customer").select(k.alias("i"), F.when(k % 10 < 9, k + 1).otherwise(k - 9).alias("j")).distinct()
    return O.edge_batches(edges, 7)


def _numbers(fitted, *columns: str):
    """The six numbers of m as columns, without negative zeros."""
    return fitted.select("pair_id", *((F.round(F.col("m")[i], 4) + 0.0).alias(f"m{i}") for i in range(6)), *columns)


@R.query("""SELECT l_suppkey AS pair_id, 0.99::DOUBLE AS m0, (-0.02)::DOUBLE AS m1, (-5)::DOUBLE AS m2, 2::DOUBLE AS m3, 1.01::DOUBLE AS m4, 3::DOUBLE AS m5,
  COUNT(*) AS n, CAST(SUM(CASE WHEN l_linenumber % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_inliers FROM lineitem GROUP BY l_suppkey""")
def ransac_transform(t):
    """Matches of one affine for each supplier, but every fourth line's row is 100 off."""
    y, x = F.col("l_discount") * 1000, F.col("l_extendedprice") / 100
    off = F.when(F.col("l_linenumber") % 4 == 0, 100.0).otherwise(0.0)
    points = t("lineitem").select(F.col("l_suppkey").alias("pair_id"), y.alias("ya"), x.alias("xa"), (y * 0.99 - x * 0.02 - 5 + off).alias("yb"), (y * 2 + x * 1.01 + 3).alias("xb"))
    return _numbers(O.ransac_transform(points, "A", 0.5), "n", "n_inliers")


@R.query("SELECT DISTINCT c_custkey//30 AS pair_id, 1::DOUBLE AS m0, 0::DOUBLE AS m1, CAST(c_custkey//30 % 3 AS DOUBLE) AS m2, 0::DOUBLE AS m3, 1::DOUBLE AS m4, CAST(c_custkey//30 % 2 AS DOUBLE) AS m5 FROM customer")
def merge_window_affines(t):
    """Pairs of thirty windows that all moved alike, but every seventh is 1,000 off."""
    k, pair = F.col("scene_id"), F.floor(F.col("scene_id") / 30)
    h = F.array(F.lit(1.0), F.lit(0.0), -F.col("y0"), F.lit(0.0), F.lit(1.0), -F.col("x0"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    off = F.when(k % 7 == 0, 1000.0).otherwise(0.0)
    m = F.array(F.lit(1.0), F.lit(0.0), pair % 3 + off, F.lit(0.0), F.lit(1.0), pair % 2 - off)
    windows = t("scenes_fx").select(pair.alias("pair_id"), k.alias("window_id"), h.alias("h"), m.alias("m"), (F.col("w") / 900).alias("score"))
    return _numbers(O.merge_window_affines(windows))
