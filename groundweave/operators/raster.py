"""Rasters as cell rows (grid_id, r, c, v) and match points: nearest and bilinear heights, block statistics, stretches.

Null and NaN cells are missing. Cells of one grid never need to meet in one task except where a whole-grid percentile is asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundweave.operators.sampling import percentiles


def _clean(v: str = "v") -> Column:
    return F.when(~F.isnan(v), F.col(v))


def dem_nearest(points: DataFrame, dem: DataFrame) -> DataFrame:
    """points (id, grid_id, line, samp) with the height of the cell they are truncated to; null outside the grid."""
    at = points.withColumns({"r": F.col("line").cast("long"), "c": F.col("samp").cast("long")}).where("true")
    at = at.withColumns({"r": F.when(F.col("line") >= 0, F.col("r")), "c": F.when(F.col("samp") >= 0, F.col("c"))})
    return at.join(dem.select("grid_id", "r", "c", F.col("v").alias("height")), ["grid_id", "r", "c"], "left").select(*points.columns, "height")


def grid_sizes(cells: DataFrame, key: str = "grid_id") -> DataFrame:
    """key, rows, cols of each grid, from its cells with the greatest row and column."""
    return cells.groupBy(key).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))


def dem_bilinear(points: DataFrame, dem: DataFrame) -> DataFrame:
    """points with the height between their four neighbours; outside a grid, whose size is that of its cells, the edge value is repeated.

    A missing neighbour of any weight makes the height null, as does a grid without cells, a null id or a null place. Each row of points
    stays, repeated ones too: the four cells are fetched once for each distinct corner, and points meet them by the corner.
    """
    sizes = grid_sizes(dem.where("grid_id is not null")).select(F.col("grid_id").alias("_g"), F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    inside = lambda v, n: F.least(F.greatest(F.col(v).cast("double"), F.lit(0.0)), (F.col(n) - 1).cast("double"))
    at = points.join(sizes, F.col("grid_id") == F.col("_g"), "left").withColumns({"_y": inside("line", "_rows"), "_x": inside("samp", "_cols")})
    at = at.withColumns({"_r": F.when(F.col("line").isNotNull(), F.floor("_y")), "_c": F.when(F.col("samp").isNotNull(), F.floor("_x"))})
    near = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("_r") + k // 2).alias("r"), (F.col("_c") + k % 2).alias("c")) for k in range(4))))
    corners = at.where("_g is not null and _r is not null and _c is not null").select("_g", "_r", "_c").distinct()
    four = corners.withColumn("_n", near).select("_g", "_r", "_c", "_n.k", F.col("_n.r").alias("r"), F.col("_n.c").alias("c"))
    cells = dem.select(F.col("grid_id").alias("_g"), "r", "c", _clean().cast("double").alias("v"))
    met = four.join(cells.hint("merge"), ["_g", "r", "c"])  # a small file may hold many cells: none is sent to the driver
    values = met.groupBy("_g", "_r", "_c").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_v{k}") for k in range(4)))
    values = values.select(*(F.col(f"{c}").alias(f"{c}at") for c in ("_g", "_r", "_c")), *(f"_v{k}" for k in range(4)))
    back = at.join(values, (F.col("_g") == F.col("_gat")) & (F.col("_r") == F.col("_rat")) & (F.col("_c") == F.col("_cat")), "left")
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    weights = ((1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx)
    part = lambda k, w: F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"_v{k}"))
    return back.select(*(F.col(f"`{c}`") for c in points.columns), reduce(lambda x, y: x + y, (part(k, w) for k, w in enumerate(weights))).alias("height"))


def block_nanmedian(cells: DataFrame, a: int, fill: float | str = -1) -> DataFrame:
    """br, bc, v: median of each a x a block over present cells; empty blocks take fill, or with 'max' the greatest median
    of the grid (0 if there is none)."""
    blocks = cells.groupBy("grid_id", F.floor(F.col("r") / a).cast("long").alias("br"), F.floor(F.col("c") / a).cast("long").alias("bc")).agg(F.percentile(_clean(), 0.5).alias("v"))
    if fill == "max":
        most = blocks.groupBy("grid_id").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("_m"))
        return blocks.join(most, "grid_id").select("grid_id", "br", "bc", F.coalesce("v", "_m").alias("v"))
    return blocks.withColumn("v", F.coalesce("v", F.lit(float(fill))))


def block_mean(cells: DataFrame, k: int) -> DataFrame:
    """br, bc, v: mean of each complete k x k block; blocks with fewer cells are dropped."""
    blocks = cells.groupBy("grid_id", F.floor(F.col("r") / k).cast("long").alias("br"), F.floor(F.col("c") / k).cast("long").alias("bc"))
    return blocks.agg(F.avg(_clean()).alias("v"), F.count("*").alias("_n")).where(F.col("_n") == k * k).drop("_n")


def block_center_sample(cells: DataFrame, k: int) -> DataFrame:
    """br, bc, v: the centre of each k x k block, for even k the mean of its four centre cells, all of them present."""
    middle = (k // 2 - 1, k // 2) if k % 2 == 0 else (k // 2,)
    held = cells.where((F.col("r") % k).isin(*middle) & (F.col("c") % k).isin(*middle))
    blocks = held.groupBy("grid_id", F.floor(F.col("r") / k).cast("long").alias("br"), F.floor(F.col("c") / k).cast("long").alias("bc"))
    return blocks.agg(F.avg(_clean()).alias("v"), F.count(_clean()).alias("_n")).where(F.col("_n") == len(middle) ** 2).drop("_n")


def percentile_stretch(cells: DataFrame, lo: float = 2.0, hi: float = 98.0, positive: bool = False) -> DataFrame:
    """cells with level 0..255: between the percentiles of valid cells (or least and greatest, if those are equal),
    truncated; missing cells 0. Grids of one value alone are dropped, as are those without a value.

    With positive the percentiles are of values over 0 alone, as 0 is the background, and no grid is dropped: where they are equal or
    there is no such value, all levels are 0.
    """
    v = _clean()
    counted = F.when(v > 0, v) if positive else v
    at = percentiles(cells.select("grid_id", counted.alias("_v")), ["grid_id"], "_v", [lo / 100, hi / 100])
    stats = cells.groupBy("grid_id").agg(F.min(v).alias("a"), F.max(v).alias("b")).join(at, "grid_id", "left" if positive else "inner")
    wide = F.lit(True) if positive else F.col("p")[1] > F.col("p")[0]
    ends = stats.select("grid_id", F.when(wide, F.col("p")[0]).otherwise(F.col("a")).alias("a"), F.when(wide, F.col("p")[1]).otherwise(F.col("b")).alias("b"))
    scaled = F.try_divide((F.least(F.greatest(v, F.col("a")), F.col("b")) - F.col("a")), F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a"))) * 255 if positive else (v - F.col("a")) / (F.col("b") - F.col("a")) * 255
    met = cells.join(ends if positive else ends.where("b > a"), "grid_id")
    return met.select(*cells.columns, F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int"), F.lit(0)).alias("level"))


def valid_pixel_ratio(cells: DataFrame, min_valid_ratio: float = 0.98) -> DataFrame:
    """grid_id, ratio of the crops whose share of valid pixels (mask over 0 and a finite value) reaches the least ratio."""
    ok = (F.col("mask") > 0) & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    return cells.groupBy("grid_id").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("ratio")).where(F.col("ratio") >= min_valid_ratio)


def in_bounds_points(points: DataFrame, w: int, h: int, x: str = "x", y: str = "y") -> DataFrame:
    """Points whose half-even rounded place lies in 0 <= x < w, 0 <= y < h, with it as px, py."""
    at = points.withColumns({"px": F.rint(x).cast("long"), "py": F.rint(y).cast("long")})
    return at.where((F.col("px") >= 0) & (F.col("px") < w) & (F.col("py") >= 0) & (F.col("py") < h))


def point_parallax(matches: DataFrame, w: int, h: int) -> DataFrame:
    """group_id, img, py, px, v (float): the median distance of the matches at each rounded pixel of both images."""
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    both = F.explode(F.array(F.struct(F.col("img_a").alias("img"), F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("img_b").alias("img"), F.col("xb").alias("x"), F.col("yb").alias("y"))))
    points = matches.select("group_id", d.alias("d"), both.alias("p")).select("group_id", "d", "p.img", "p.x", "p.y")
    return in_bounds_points(points, w, h).groupBy("group_id", "img", "py", "px").agg(F.percentile("d", 0.5).cast("float").alias("v"))


def confident_matches(matches: DataFrame, conf: DataFrame, thr: float = 0.5, min_matches: int = 4, scale: float = 3000 / 3456) -> DataFrame:
    """Matches confident on both sides (conf over thr at the truncated cell, places outside taken to the edge), scaled; groups under min_matches go.

    conf: img, r, c, conf; an image is as large as its cells say. Matches of images without cells go.
    """
    sizes = grid_sizes(conf, "img")
    cell = lambda v, n: F.least(F.greatest(F.col(v), F.lit(0.0)), (F.col(n) - 1).cast("double")).cast("long")
    side = lambda s: conf.where(F.col("conf") > thr).select(F.col("img").alias(f"img_{s}"), F.col("r").alias(f"r{s}"), F.col("c").alias(f"c{s}"))
    at = matches
    for s in "ab":
        own = sizes.select(F.col("img").alias(f"img_{s}"), F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
        at = at.join(own, f"img_{s}").withColumns({f"r{s}": cell(f"y{s}", "_rows"), f"c{s}": cell(f"x{s}", "_cols")}).drop("_rows", "_cols")
    kept = at.join(side("a"), ["img_a", "ra", "ca"], "left_semi").join(side("b"), ["img_b", "rb", "cb"], "left_semi")
    enough = kept.groupBy("group_id", "img_a", "img_b").count().where(F.col("count") >= min_matches).drop("count")
    return kept.join(enough, ["group_id", "img_a", "img_b"], "left_semi").select("group_id", "img_a", "img_b", *((F.col(x) * scale).alias(x) for x in ("xa", "ya", "xb", "yb")))


def crop_acceptance(candidates: DataFrame, good: float = 3.0, bad: float = 5.0, p_good: float = 0.2, p_bad: float = 0.7) -> DataFrame:
    """The first candidate crop (id, rank) with over p_good of its cells under good and under p_bad over bad; else the last.

    candidates: id, rank, residual by cell. Cells of empty blocks hold -1 and so count as good.
    """
    share = candidates.groupBy("id", "rank").agg(F.avg((F.col("residual") < good).cast("double")).alias("g"), F.avg((F.col("residual") > bad).cast("double")).alias("b"))
    judged = share.withColumn("ok", (F.col("g") > p_good) & (F.col("b") < p_bad))
    first = F.min(F.when(F.col("ok"), F.col("rank")))
    return judged.groupBy("id").agg(F.coalesce(first, F.max("rank")).alias("rank"), F.max("ok").alias("accepted"))


def window_scores(conf_a: DataFrame, conf_b: DataFrame) -> DataFrame:
    """window_id, score = sqrt(mean conf of a * mean conf of b), sub_score = mean sqrt(conf a * conf b) by cell."""
    both = conf_a.select("window_id", "r", "c", F.col("conf").alias("a")).join(conf_b.select("window_id", "r", "c", F.col("conf").alias("b")), ["window_id", "r", "c"], "full_outer")
    return both.groupBy("window_id").agg(F.sqrt(F.avg("a") * F.avg("b")).alias("score"), F.avg(F.sqrt(F.col("a") * F.col("b"))).alias("sub_score"))


def tile_starts(length: Column, crop: int, stride: int) -> Column:
    """Starts of sliding tiles of a length: each stride, the last shifted back inside."""
    n = F.greatest(F.ceil((length - crop) / F.lit(float(stride))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.least(i * stride, length.cast("int") - crop), F.lit(0)))


def tile_blend(tile_preds: DataFrame) -> DataFrame:
    """image_id, r, c, v: the mean over tiles of rows (image_id, tr, tc, dr, dc, v), tile origins and places in the tile."""
    return tile_preds.groupBy("image_id", (F.col("tr") + F.col("dr")).alias("r"), (F.col("tc") + F.col("dc")).alias("c")).agg(F.avg("v").alias("v"))


def residual_to_conf(df: DataFrame, left: float = 2.0, right: float = 10.0, by: str = "batch", col: str = "residual") -> DataFrame:
    """df with conf = 1 / (1 + exp(a (r - mid))), a = ln 9 / ((right - left) / 2); negative residuals take the greatest of
    their batch, all are clamped to [0, right + mid]."""
    from math import log

    mid, a = (left + right) / 2, log(9.0) / ((right - left) / 2)
    most = df.groupBy(by).agg(F.max(col).alias("_most"))
    r = F.least(F.greatest(F.when(F.col(col) < 0, F.col("_most")).otherwise(F.col(col)), F.lit(0.0)), F.lit(right + mid))
    return df.join(most, by).withColumn("conf", 1 / (1 + F.exp((r - mid) * a))).drop("_most")


def nonfinite_audit(df: DataFrame, cols: tuple[str, ...], by: str | None = None) -> DataFrame:
    """name, has_nan, has_inf, n_bad (rows) of each column, by group if asked."""
    names = [by] if by else []
    long = df.select(*names, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select(*names, "x.name", "x.v")
    nan, inf = F.coalesce(F.isnan("v"), F.lit(False)), F.coalesce(F.abs("v") == float("inf"), F.lit(False))
    return long.groupBy(*names, "name").agg(F.max(nan).alias("has_nan"), F.max(inf).alias("has_inf"), F.sum((nan | inf).cast("long")).alias("n_bad"))


def valid_windows(win_a: DataFrame, win_b: DataFrame, arrays: tuple[str, ...] = ("image", "dem", "h")) -> tuple[DataFrame, DataFrame]:
    """Both sides of the windows that have no NaN in any array of either side."""
    clean = lambda w: w.where(~F.coalesce(reduce(lambda a, b: a | b, (F.exists(c, F.isnan) for c in arrays)), F.lit(True))).select("window_id")
    ok = clean(win_a).join(clean(win_b), "window_id")
    return win_a.join(ok, "window_id", "left_semi"), win_b.join(ok, "window_id", "left_semi")


def height_fusion(ties: DataFrame, mode: str = "median") -> DataFrame:
    """tie_id, height: median or mean of the heights of a tie point in all scenes."""
    return ties.groupBy("tie_id").agg((F.percentile("height", 0.5) if mode == "median" else F.avg("height")).alias("height"))


def tie_points_aligned(ties: DataFrame, mode: str = "strict") -> DataFrame:
    """Tie points that all scenes have. `strict` fails when the scenes' counts differ; `truncate` keeps ids under the
    smallest count's highest id."""
    counts = ties.groupBy("img").agg(F.count("*").alias("n"), F.max("tie_id").alias("last"))
    ends = counts.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("scenes"), F.min("last").alias("last")).first()
    if ends["scenes"] == 0:
        return ties.limit(0)
    if mode == "strict" and ends["a"] != ends["b"]:
        raise ValueError("scenes have different numbers of tie points")
    held = ties.where(F.col("tie_id") <= ends["last"])
    whole = held.groupBy("tie_id").agg(F.countDistinct("img").alias("n")).where(F.col("n") == ends["scenes"]).select("tie_id")
    return held.join(whole, "tie_id", "left_semi")


def group_integrity(groups: DataFrame, images: DataFrame, parallax: DataFrame, min_cover: int = 2) -> DataFrame:
    """group_id, violation: keys of images and parallax differ, too few images, keys not 0..n-1, shapes differ, a gap in ids.

    images: group_id, img, h, w; parallax: group_id, img, h, w; groups: group_id.
    """
    a = images.select("group_id", "img", F.struct("h", "w").alias("ia"))
    b = parallax.select("group_id", "img", F.struct("h", "w").alias("ib"))
    both = a.join(b, ["group_id", "img"], "full_outer")
    keys = both.where(F.col("ia").isNull() | F.col("ib").isNull()).select("group_id", F.lit("keys differ").alias("violation"))
    per = images.groupBy("group_id").agg(F.count("*").alias("n"), F.min("img").alias("first"), F.max("img").alias("last"), F.countDistinct("h", "w").alias("shapes"))
    found = [keys, both.where("ia <> ib").select("group_id", F.lit("shapes differ").alias("violation")), per.where("shapes > 1").select("group_id", F.lit("shapes differ").alias("violation"))]
    found += [per.where(F.col("n") < min_cover).select("group_id", F.lit("too few images").alias("violation")), per.where("first <> 0 OR last <> n - 1").select("group_id", F.lit("keys not consecutive").alias("violation"))]
    span = groups.agg(F.min("group_id").alias("a"), F.max("group_id").alias("b")).first()
    ids = groups.sparkSession.range(span["a"], span["b"] + 1) if span["a"] is not None else groups.sparkSession.range(0)
    gaps = ids.select(F.col("id").cast(groups.schema["group_id"].dataType).alias("group_id")).join(groups, "group_id", "left_anti").select("group_id", F.lit("missing group").alias("violation"))
    out = gaps
    for f in found:
        out = out.unionByName(f)
    return out.distinct()
