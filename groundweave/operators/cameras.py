"""Projection between scenes, model fits, tie residuals and the global block adjustment.

A scene's camera model is the struct column `rpc` (RPC). Points meet the model of their scene by scene_id; the maths
runs once for each batch of points, with a model for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundweave.functions import cameras as C
from groundweave.functions import geometry as G
from groundweave.operators.adjust import graph_components
from groundweave.operators.raster import dem_bilinear
from groundweave.operators.sampling import dealt_by_range, numbered, percentiles
from groundweave.sources.shared import discard, spread, written

RPC = "struct<" + ",".join([f"{k}:double" for k in C.SCALARS] + [f"{k}:array<double>" for k in (*C.DIRECT, *C.INVERSE, "adj")]) + ">"


def _model(row) -> dict:
    return row if isinstance(row, dict) else row.asDict()


#: Scenes whose models (1.4 kB each) are sent to every executor; beyond, ranges of points fetch their own models.
BROADCAST_SCENES = 20_000
#: Points of such a range.
PROJECTED = 50_000


class Step(NamedTuple):
    """One projection: Models.to_photo or to_ground of the columns args by the model of the scene in key, into names."""

    run: Callable
    args: tuple[str, ...]
    names: tuple[str, str]
    key: str = "scene_id"


def _projected(points: pd.DataFrame, models: C.Models, steps: tuple[Step, ...]) -> pd.DataFrame:
    out = points.reset_index(drop=True)
    for run, args, names, key in steps:
        at, known = models.rows(out[key])
        both = np.full((2, len(out)), np.nan)
        both[:, known] = run(models, at[known], *(out[c].to_numpy(float)[known] for c in args))
        out = out.assign(**dict(zip(names, both, strict=True)))
    return out


def _of_one_range(steps: tuple[Step, ...]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(points: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        return _projected(points.drop(columns="_b"), _stacked(models), steps)

    return run


def _by_scene(points: DataFrame, scenes: DataFrame, *steps: Step) -> DataFrame:
    """points with two more columns for each step, NaN for scenes without a model. A batch of points is evaluated at once,
    whatever scenes it holds."""
    models = scenes.select(F.col("scene_id").alias("_s"), "rpc").where("_s is not null and rpc is not null")
    few = models.limit(BROADCAST_SCENES + 1).collect()
    kinds = lambda df, *some: ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for s in some for n in s.names])
    if len(few) <= BROADCAST_SCENES:
        sent = scenes.sparkSession.sparkContext.broadcast(C.Models({r["_s"]: r["rpc"].asDict() for r in few}))

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in parts:
                yield _projected(b, sent.value, steps)

        return points.mapInPandas(batches, kinds(points, *steps))
    held: tuple[DataFrame, ...] = ()
    for key, own in groupby(steps, key=lambda s: s.key):
        own = tuple(own)
        dealt = dealt_by_range(points, PROJECTED, F.col(key), F.xxhash64(*points.columns))  # a hot scene lies in many ranges
        discard(*held)
        held = (dealt, _models_of(dealt, scenes, key))
        points = dealt.groupBy("_b").cogroup(held[1].groupBy("_b")).applyInPandas(_of_one_range(own), kinds(points, *own))
    return points


def rpc_obj2photo(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """points (scene_id, lat, lon, h) with line, samp; NaN where the scene has no model."""
    return _by_scene(points, scenes, Step(C.Models.to_photo, ("lat", "lon", "h"), ("line", "samp")))


def rpc_photo2obj(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """points (scene_id, line, samp, h) with lat, lon."""
    return _by_scene(points, scenes, Step(C.Models.to_ground, ("line", "samp", "h"), ("lat", "lon")))


def project_between_scenes(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """points (scene_a, scene_b, line, samp, h) with line_b, samp_b: through the ground at height h."""
    ground = Step(C.Models.to_ground, ("line", "samp", "h"), ("lat", "lon"), "scene_a")
    return _by_scene(points, scenes, ground, Step(C.Models.to_photo, ("lat", "lon", "h"), ("line_b", "samp_b"), "scene_b")).drop("lat", "lon")


def xy_to_sampline(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """points (scene_id, x, y, h: height of a first guess) in Mercator metres with line, samp."""
    lat, lon = G.mercator_inv(F.col("y"), F.col("x"))
    return rpc_obj2photo(points.withColumns({"lat": lat, "lon": lon}), scenes).drop("lat", "lon")


def xy_to_sampline_on_dem(points: DataFrame, scenes: DataFrame, dem: DataFrame, max_iter: int = 20, tol: float = 1.0) -> DataFrame:
    """points (scene_id, x, y) in Mercator metres with line, samp and height: where the ground of the scene's own grid of heights meets the image.

    scenes: scene_id, rpc, h, w, ring (corners tl, tr, br, bl); dem: grid_id (the scene), r, c, v. The first guess lies between two
    opposite corners as the point does; then the height there is looked up, the point projected at it, and so on until
    it moves by no more than tol pixels. Only points that still move go into the next round; those that do so after max_iter rounds keep
    their last place. Null where the scene has no model or the place no height.
    """
    place = numbered(points.select("scene_id", "x", "y").distinct(), [F.col("scene_id").asc_nulls_first(), F.col("x"), F.col("y")], "_n")
    first, opposite = F.col("ring")[0], F.col("ring")[2]
    share = lambda k: (F.col(k) - first[k]) / (opposite[k] - first[k])
    known = scenes.where("rpc is not null").select(F.col("scene_id").alias("_s"), F.col("h").alias("_rows"), F.col("w").alias("_cols"), "ring")
    start = place.join(known, F.col("scene_id") == F.col("_s")).select("_n", "scene_id", "x", "y", (share("y") * F.col("_rows")).alias("line"), (share("x") * F.col("_cols")).alias("samp"))
    moving, settled = written(start, "guesses"), []
    discard(place)
    models = scenes.select("scene_id", "rpc")
    lat, lon = G.mercator_inv(F.col("y"), F.col("x"))
    for turn in range(max_iter):
        high = dem_bilinear(moving.withColumn("grid_id", F.col("scene_id")), dem).where("height is not null")
        asked = high.select("_n", "scene_id", "x", "y", F.col("line").alias("_line"), F.col("samp").alias("_samp"), F.col("height").alias("h"), lat.alias("lat"), lon.alias("lon"))
        moved = F.sqrt(F.pow(F.col("line") - F.col("_line"), 2) + F.pow(F.col("samp") - F.col("_samp"), 2))
        found = written(rpc_obj2photo(asked, models).where(~F.isnan("line")).select("_n", "scene_id", "x", "y", "line", "samp", F.col("h").alias("height"), (moved > tol).alias("moves")), "guesses")
        discard(moving)
        settled.append(found if turn == max_iter - 1 else found.where("not moves"))
        moving = found.where("moves").select("_n", "scene_id", "x", "y", "line", "samp")
        if moving.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    got = out.select(F.col("scene_id").alias("_s"), F.col("x").alias("_x"), F.col("y").alias("_y"), "line", "samp", "height")
    return points.join(got, (F.col("scene_id") == F.col("_s")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_s", "_x", "_y")


def scene_corners(scenes: DataFrame) -> DataFrame:
    """scene_id, ring of Mercator x, y: the corners tl, tr, br, bl of scenes (h, w, heights: array of 4, NaN is 0)."""
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), line.cast("double").alias("line"), samp.cast("double").alias("samp"), F.get("heights", F.lit(i)).alias("z")) for i, (line, samp) in enumerate(((F.lit(0), F.lit(0)), (F.lit(0), F.col("w") - 1), (F.col("h") - 1, F.col("w") - 1), (F.col("h") - 1, F.lit(0)))))))
    corners = scenes.select("scene_id", at.alias("c")).select("scene_id", "c.i", "c.line", "c.samp", F.coalesce(F.when(~F.isnan("c.z"), F.col("c.z")), F.lit(0.0)).alias("h"))
    y, x = G.mercator(F.col("lat"), F.col("lon"))
    placed = rpc_photo2obj(corners, scenes).select("scene_id", "i", x.alias("x"), y.alias("y"))
    return placed.groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"))


def _refit(scenes: DataFrame, kind: Callable[..., dict], *grid: int) -> DataFrame:
    """scenes with their models refitted, each distinct model once in a Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = C.refits(kind, *grid)
        for b in batches:
            yield pd.DataFrame({"scene_id": b["scene_id"], "rpc": [fit(_model(r)) for r in b["rpc"]]})

    return spread(scenes.select("scene_id", "rpc")).mapInPandas(run, f"scene_id long, rpc {RPC}")


def inverse_rpc_fit(scenes: DataFrame, xy: int = 30, z: int = 20) -> DataFrame:
    """scene_id, rpc with inverse coefficients fitted on a virtual xy x xy x z grid."""
    return _refit(scenes, C.fit_inverse, xy, z)


def bake_affine_into_rpc(scenes: DataFrame, xy: int = 50, z: int = 30) -> DataFrame:
    """scene_id, rpc with its affine worked into the coefficients; unchanged where it is identity."""
    return _refit(scenes, C.bake, xy, z)


def rpc_roundtrip_check(scenes: DataFrame, nxy: int = 10, nh: int = 5, tol: float = 1.0) -> DataFrame:
    """scene_id, line, samp, h, error in pixels of grid points that miss their place by over tol on the way to the ground and back."""
    along = lambda k, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col(f"rpc.{k}_off") + F.col(f"rpc.{k}_scale") * (i * (2.0 / max(n - 1, 1)) - 1)))
    grid = scenes.withColumn("line", along("line", nxy)).withColumn("samp", along("samp", nxy)).withColumn("h", along("height", nh)).select("scene_id", "line", "samp", "h")
    grid = grid.withColumnsRenamed({"line": "line0", "samp": "samp0"})
    error = F.sqrt(F.pow(F.col("line") - F.col("line0"), 2) + F.pow(F.col("samp") - F.col("samp0"), 2))
    there = Step(C.Models.to_ground, ("line0", "samp0", "h"), ("lat", "lon"))
    return _by_scene(grid, scenes, there, Step(C.Models.to_photo, ("lat", "lon", "h"), ("line", "samp"))).withColumn("error", error).where(F.col("error") > tol).select("scene_id", F.col("line0").alias("line"), F.col("samp0").alias("samp"), "h", "error")


def pair_point_error(pairs: DataFrame, ties: DataFrame, scenes: DataFrame, unit: str = "px") -> DataFrame:
    """i, j, mean, median, max error and n of each pair's tie points (tie_id, scene_id, line, samp, h), in pixels of i or
    metres on the ground; mean height difference dh."""
    side = lambda s: ties.select("tie_id", F.col("scene_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("line", "samp", "h")))
    met = pairs.select("i", "j").join(side("i"), "i").join(side("j"), ["j", "tie_id"])
    dh = (F.col("h_i") - F.col("h_j")).alias("dh")
    if unit == "px":
        points = met.select("i", "j", "tie_id", "line_i", "samp_i", dh, F.col("j").alias("scene_a"), F.col("i").alias("scene_b"), F.col("line_j").alias("line"), F.col("samp_j").alias("samp"), F.col("h_j").alias("h"))
        e = F.sqrt(F.pow(F.col("line_b") - F.col("line_i"), 2) + F.pow(F.col("samp_b") - F.col("samp_i"), 2))
        out = project_between_scenes(points, scenes).withColumn("e", e)
    else:
        ground = [Step(C.Models.to_ground, (f"line_{s}", f"samp_{s}", f"h_{s}"), (f"lat{o}", f"lon{o}"), s) for o, s in enumerate("ij")]
        out = _by_scene(met.withColumn("dh", dh), scenes, *ground).withColumn("e", G.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))
    errors = written(out.select("i", "j", "e", "dh"), "pair-errors")
    medians = percentiles(errors, ["i", "j"], "e", [0.5]).select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("p")[0].alias("median"))
    sums = errors.groupBy("i", "j").agg(F.avg("e").alias("mean"), F.max("e").alias("max"), F.count("*").alias("n"), F.avg("dh").alias("dh"))
    return sums.join(medians, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left").select("i", "j", "mean", "median", "max", "n", "dh")


def _models_of(ranged: DataFrame, scenes: DataFrame, *keys: str) -> DataFrame:
    """_b, scene_id, rpc: each range with the models of the scenes that it names. A model travels once to a range, a range
    holds no more of them than it has rows, and no task or driver has all."""
    named = ranged.select("_b", F.explode(F.array_distinct(F.array(*keys))).alias("scene_id")).distinct()
    known = scenes.select(F.col("scene_id").alias("_s"), "rpc").where("_s is not null and rpc is not null")
    # merged: a table of alike models is small as a file, and Spark would send all of them to the driver and to each executor
    return written(named.hint("merge").join(known, F.col("scene_id") == F.col("_s")).select("_b", "scene_id", "rpc"), "models")


def _stacked(models: pd.DataFrame) -> C.Models:
    return C.Models({s: _model(r) for s, r in zip(models["scene_id"], models["rpc"], strict=True)})


#: Observations or ties of a task.
OBSERVED = 20_000


def multiview_residuals(ties: DataFrame, scenes: DataFrame, fusion: str = "median", rounds: int = 50, observed: int = OBSERVED) -> DataFrame:
    """tie_id, scene_id, residual in pixels: of each tie point the ground place (at the fused height) that fits all its
    observations (tie_id, scene_id, line, samp, h) best, by Gauss-Newton from the median of the back-projections.
    Observations without a tie or a model are left out. For any number of scenes: ties go by range of their least scene, and a range fetches its own models."""
    height = F.percentile("h", 0.5) if fusion == "median" else F.avg("h")
    ties = ties.where("tie_id is not null")
    fused = ties.groupBy("tie_id").agg(height.alias("h"), F.min("scene_id").alias("_first"))
    seen = ties.drop("h").join(fused, "tie_id").select("tie_id", "scene_id", "line", "samp", "h", "_first")
    dealt = dealt_by_range(seen, observed, F.col("_first"), F.col("tie_id"))

    def solve(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or models.empty:
            return pd.DataFrame([], columns=["tie_id", "scene_id", "residual"])
        stacked = _stacked(models)
        rows = rows[stacked.rows(rows["scene_id"])[1]].sort_values(["tie_id", "scene_id"]).reset_index(drop=True)
        if rows.empty:
            return pd.DataFrame([], columns=["tie_id", "scene_id", "residual"])
        _, own = np.unique(rows["tie_id"], return_inverse=True)
        h, seen = rows["h"].to_numpy(float), rows[["line", "samp"]].to_numpy(float)
        scene = stacked.rows(rows["scene_id"])[0]
        back = pd.DataFrame(np.stack(stacked.to_ground(scene, *seen.T, h), axis=1))
        at = back.groupby(own).median().to_numpy()
        place = lambda p: np.stack(stacked.to_photo(scene, p[own, 0], p[own, 1], h), axis=1)
        eps = 1e-7
        for _ in range(rounds):
            r = place(at) - seen
            j = np.stack([(place(at + eps * e) - place(at - eps * e)) / (2 * eps) for e in np.eye(2)], axis=2)
            n, g = np.zeros((len(at), 2, 2)), np.zeros((len(at), 2))
            np.add.at(n, own, np.einsum("nra,nrb->nab", j, j))
            np.add.at(g, own, np.einsum("nra,nr->na", j, r))
            step = -np.einsum("nab,nb->na", np.linalg.pinv(n, hermitian=True), g)
            at = at + step
            if np.abs(step).max() < 1e-12:
                break
        return pd.DataFrame({"tie_id": rows["tie_id"], "scene_id": rows["scene_id"], "residual": np.linalg.norm(place(at) - seen, axis=1)})

    models = _models_of(dealt, scenes, "scene_id")
    return dealt.groupBy("_b").cogroup(models.groupBy("_b")).applyInPandas(solve, "tie_id long, scene_id long, residual double")


def pair_tie_errors(pairs: DataFrame, ties: DataFrame, scenes: DataFrame, fusion: str = "median", observed: int = OBSERVED) -> DataFrame:
    """i, j, n, mean, median, max: of each pair the residuals of its tie points when each is adjusted from these two scenes alone.

    A tie counts if both scenes see it inside their image (scenes: scene_id, rpc, h, w); a pair without one has n 0 and nulls. Pairs with a
    null scene go; a pair that is given twice counts once.
    """
    both = pairs.select("i", "j").where("i is not null and j is not null and i <> j").distinct()
    size = scenes.select(F.col("scene_id").alias("_s"), F.col("h").alias("_rows"), F.col("w").alias("_cols"))
    inside = (F.col("line") >= 0) & (F.col("line") < F.col("_rows")) & (F.col("samp") >= 0) & (F.col("samp") < F.col("_cols"))
    held = ties.join(size, F.col("scene_id") == F.col("_s")).where(inside).select("tie_id", "scene_id", "line", "samp", "h")
    side = lambda s: held.select("tie_id", F.col("scene_id").alias(s), F.struct(F.col("scene_id").alias("scene_id"), "line", "samp", "h").alias(f"_{s}"))
    met = written(both.join(side("i"), "i").join(side("j"), ["j", "tie_id"]), "pair-ties")
    views = numbered(met.select("i", "j", F.col("tie_id").alias("of"), "_i", "_j"), [F.col("i"), F.col("j"), F.col("of")], "tie_id")
    held_views = written(views, "pair-views")
    discard(views, met)
    apart = held_views.select("tie_id", F.explode(F.array("_i", "_j")).alias("o")).select("tie_id", "o.scene_id", "o.line", "o.samp", "o.h")
    found = multiview_residuals(apart, scenes, fusion, observed=observed).join(held_views.select("tie_id", "i", "j"), "tie_id")
    errors = written(found.select("i", "j", "residual"), "pair-residuals")
    medians = percentiles(errors, ["i", "j"], "residual", [0.5]).select("i", "j", F.col("p")[0].alias("median"))
    sums = errors.groupBy("i", "j").agg((F.count("residual") / 2).cast("long").alias("n"), F.avg("residual").alias("mean"), F.max("residual").alias("max"))
    return both.join(sums.join(medians, ["i", "j"]), ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "median", "max")


# ---- block adjustment

_R = G.MERCATOR_R


def _lonlat(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(2 * np.arctan(np.exp(xy[:, 1] / _R)) - np.pi / 2), np.degrees(xy[:, 0] / _R)


def _mercator(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.stack([np.radians(lon) * _R, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * _R], axis=1)


def _edge_sums(rows: pd.DataFrame, models: C.RunModels) -> pd.DataFrame:
    """Rows a, b, v of the ties of many edges at once: the 36 numbers of block (a, b) with each tie's ground point eliminated, a's
    gradient where b is -1, and the squares of the residuals and their count where both are -1."""
    (i, known_i), (j, known_j) = models.rows(rows["i"]), models.rows(rows["j"])
    ok = known_i & known_j
    if not ok.any():
        return pd.DataFrame([], columns=["a", "b", "v"])
    order = np.lexsort((j, i))  # by edge: models evaluate runs, and sums go from edge to edge
    order = order[ok[order]]
    parts = [order[at : at + SUMMED] for at in range(0, len(order), SUMMED)]
    return pd.concat([_sums_of_edges(rows.iloc[some], i[some], j[some], models) for some in parts], ignore_index=True)


#: Ties that are evaluated at once, so that their arrays stay in a core's cache.
SUMMED = 4_000


def _sums_of_edges(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, models: C.RunModels) -> pd.DataFrame:
    """_edge_sums of ties in the order of their edges; i, j: the rows of their models."""
    h, seen = rows["h"].to_numpy(float), rows[["line_i", "samp_i", "line_j", "samp_j"]].to_numpy(float).T
    lat, lon = _lonlat(sum(_mercator(*models.to_ground(s, *seen[k : k + 2], h)) for s, k in ((i, 0), (j, 2))) / 2)
    predicted, y, x = (np.concatenate(both) for both in zip(models.photo_slopes(i, lat, lon, h), models.photo_slopes(j, lat, lon, h), strict=True))
    r = predicted - seen
    x, y = x * np.degrees(1 / _R), y * np.degrees(np.cos(np.radians(lat)) / _R)  # by metres of Mercator
    xx, xy, yy = (x * x).sum(axis=0) + 1e-12, (x * y).sum(axis=0), (y * y).sum(axis=0) + 1e-12
    det = xx * yy - xy * xy
    xx, xy, yy = xx / det, xy / det, yy / det
    rx, ry = (x * r).sum(axis=0), (y * r).sum(axis=0)
    rest = r - x * (yy * rx - xy * ry) - y * (xx * ry - xy * rx)
    first = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
    of_edges = lambda v: np.add.reduceat(v, first)
    # An affine moves a predicted place by its matrix' inverse times (line, samp, 1), so that what a tie adds is a weight of its four residuals times
    # products of places. These are summed over an edge, and the inverses, which an edge's ties share, come in at its end.
    base = [predicted[0], predicted[1], None, predicted[2], predicted[3], None]
    by = lambda v, k: v if base[k] is None else v * base[k]
    sums, slope = np.zeros((len(first), 4, 3, 4, 3)), np.zeros((len(first), 4, 3))
    for p in range(4):
        left = p // 2 * 3
        for k in range(3):
            slope[:, p, k] = of_edges(by(rest[p], left + k))
        for q in range(p, 4):
            weight = float(p == q) - yy * x[p] * x[q] + xy * (x[p] * y[q] + y[p] * x[q]) - xx * y[p] * y[q]
            right = q // 2 * 3
            for k in range(3):
                half = by(weight, left + k)
                for l in range(3):
                    sums[:, p, k, q, l] = sums[:, q, l, p, k] = of_edges(by(half, right + l))
    turn = np.zeros((len(first), 4, 3, 4, 3))
    for side, of in enumerate((i[first], j[first])):
        inverse = -np.linalg.inv(models.adj[of].reshape(-1, 2, 3)[:, :, :2])
        for k in range(3):
            turn[:, 2 * side : 2 * side + 2, k, 2 * side : 2 * side + 2, k] = inverse
    turn = turn.reshape(-1, 12, 12)
    big = turn.transpose(0, 2, 1) @ sums.reshape(-1, 12, 12) @ turn
    g = (turn.transpose(0, 2, 1) @ slope.reshape(-1, 12, 1))[:, :, 0]
    ends = (models.ids[i[first]], models.ids[j[first]])
    wide = lambda x: np.concatenate([x, np.zeros((len(x), 36 - x.shape[1]))], axis=1)
    parts = [(ends[p], ends[q], big[:, 6 * p : 6 * p + 6, 6 * q : 6 * q + 6].reshape(-1, 36)) for p in (0, 1) for q in (0, 1)]
    parts += [(ends[p], np.full(len(first), -1), wide(g[:, 6 * p : 6 * p + 6])) for p in (0, 1)]
    parts.append((np.array([-1]), np.array([-1]), wide(np.array([[(rest**2).sum(), float(r.size)]]))))
    a, b, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"a": a, "b": b, "v": list(v)})


_TIE = ("i", "j", "line_i", "samp_i", "line_j", "samp_j", "h")


def _dealt_ties(ties: DataFrame, per_task: int) -> DataFrame:
    """Ties by ranges of their edge; an edge of many ties lies in many ranges."""
    return dealt_by_range(ties.select(*_TIE).where("i is not null and j is not null"), per_task, F.col("i"), F.col("j"), F.xxhash64(*_TIE))


def _added(each: DataFrame) -> DataFrame:
    return each.groupBy("a", "b").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(36))).alias("v"))


def _systems(ties: DataFrame, scenes: DataFrame, observed: int) -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]:
    """The ties, written, and the sums a, b, v of _edge_sums over all of them for given affines (scene_id, m; identity for scenes without one, and for
    all if None). Up to BROADCAST_SCENES models are sent to the executors, and their affines each time, so that the ties are read where they lie;
    beyond, ranges of ties fetch their own."""
    known = scenes.select("scene_id", "rpc").where("scene_id is not null and rpc is not null")
    few = known.limit(BROADCAST_SCENES + 1).collect()
    if len(few) > BROADCAST_SCENES:
        dealt = _dealt_ties(ties, observed)
        models = _models_of(dealt, scenes, "i", "j")
        return dealt, lambda affines: _systems_of_ranges(dealt, models, affines)
    held = written(ties.select(*_TIE).where("i is not null and j is not null"), "ties")
    context = held.sparkSession.sparkContext
    stacked = C.RunModels({r["scene_id"]: r["rpc"].asDict() for r in few})
    sent = context.broadcast(stacked)

    def sums(affines: DataFrame | None) -> DataFrame:
        adj = np.tile(np.array(C.IDENTITY, float), (len(stacked.ids), 1))
        for r in [] if affines is None else affines.where("m is not null").select("scene_id", "m").collect():
            (at,), (there,) = stacked.rows([r["scene_id"]])
            if there:
                adj[at] = r["m"]
        moved = context.broadcast(adj)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models, waiting = copy(sent.value), []
            models.adj = moved.value
            for b in batches:
                waiting.append(b)
                if sum(map(len, waiting)) >= observed:
                    yield _edge_sums(pd.concat(waiting, ignore_index=True), models)
                    waiting = []
            if waiting:
                yield _edge_sums(pd.concat(waiting, ignore_index=True), models)

        return _added(held.mapInPandas(run, "a long, b long, v array<double>"))

    return held, sums


def _systems_of_ranges(dealt: DataFrame, models: DataFrame, affines: DataFrame | None) -> DataFrame:
    own = models.withColumn("m", F.lit(None).cast("array<double>")) if affines is None else models.join(affines.select("scene_id", "m"), "scene_id", "left")

    def run(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or models.empty:
            return pd.DataFrame([], columns=["a", "b", "v"])
        stacked, to = C.RunModels({s: _model(r) for s, r in zip(models["scene_id"], models["rpc"], strict=True)}), dict(zip(models["scene_id"], models["m"], strict=True))
        stacked.adj = np.array([C.IDENTITY if to[s] is None else to[s] for s in stacked.ids.tolist()], float).reshape(-1, 6)
        return _edge_sums(rows, stacked)

    return _added(dealt.groupBy("_b").cogroup(own.groupBy("_b")).applyInPandas(run, "a long, b long, v array<double>"))


def _rms(sums: DataFrame) -> Column:
    return F.sqrt(F.try_divide(F.max(F.when(F.col("a") == -1, F.col("v")[0])), F.max(F.when(F.col("a") == -1, F.col("v")[1])))).alias("rms")


def adjustment_rms(ties: DataFrame, scenes: DataFrame, affines: dict[int, list[float]] | DataFrame | None = None, observed: int = OBSERVED) -> DataFrame:
    """rms over the four residuals of all ties (i, j, line_i, samp_i, line_j, samp_j, h) for the given affines (scene_id, m; identity for scenes
    without one), for any number of scenes. Ties of a scene without a model don't count; without any the rms is null."""
    if isinstance(affines, dict):
        affines = scenes.sparkSession.createDataFrame([(k, list(m)) for k, m in affines.items()], "scene_id long, m array<double>")
    sums = _systems(ties, scenes, observed)[1](affines)
    return sums.where("a = -1 and b = -1").agg(_rms(sums))


#: Unknowns up to which a task solves by elimination, and by conjugate gradients beyond.
DENSE = 3_000
#: Blocks (of 288 bytes) of a component that one task solves; larger components are solved on tables.
TASK_BLOCKS = 500_000


def solve_blocks(a: np.ndarray, b: np.ndarray, blocks: np.ndarray, right: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """x (n, 6) with H x = right, H given as 6 x 6 blocks at (a, b), each place once: by elimination up to DENSE unknowns,
    else by conjugate gradients with the diagonal blocks' inverses, which hold no more than the blocks."""
    n = len(right)
    if 6 * n <= DENSE:
        big = np.zeros((n, 6, n, 6))
        big[a, :, b, :] = blocks
        return np.linalg.solve(big.reshape(6 * n, 6 * n), right.ravel()).reshape(n, 6)
    order = np.argsort(a, kind="stable")
    a, b, blocks = a[order], b[order], blocks[order]
    start = np.searchsorted(a, np.arange(n))
    own = np.zeros((n, 6, 6))
    own[a[a == b]] = blocks[a == b]
    inverse = np.linalg.inv(own)
    times = lambda x: np.add.reduceat(np.einsum("mij,mj->mi", blocks, x[b]), start, axis=0)
    x, r = np.zeros((n, 6)), right.copy()
    z = np.einsum("nij,nj->ni", inverse, r)
    p, rz = z.copy(), float((r * z).sum())
    first = rz
    for _ in range(60 * n):
        if rz <= tol * tol * first:
            break
        hp = times(p)
        step = rz / float((p * hp).sum())
        x, r = x + step * p, r - step * hp
        z = np.einsum("nij,nj->ni", inverse, r)
        rz, was = float((r * z).sum()), rz
        p = z + rz / was * p
    return x


_STEP = "scene_id long, step array<double>"


def _solve_component(rows: pd.DataFrame) -> pd.DataFrame:
    """Steps of one component's scenes from its rows a, b, v (gradients at b = -1)."""
    ids = np.unique(rows["a"])
    v, b = np.stack(rows["v"].to_numpy()), rows["b"].to_numpy()
    at = np.searchsorted(ids, rows["a"].to_numpy())
    right = np.zeros((len(ids), 6))
    right[at[b == -1]] = -v[b == -1][:, :6]
    block = b != -1
    x = solve_blocks(at[block], np.searchsorted(ids, b[block]), v[block].reshape(-1, 6, 6), right)
    return pd.DataFrame({"scene_id": ids, "step": list(x)})


def _vector(parts: list[Column], name: str) -> Column:
    return F.array(*parts).alias(name)


def solve_on_tables(sums: DataFrame, tol: float = 1e-9, most: int = 500) -> DataFrame:
    """scene_id, step: conjugate gradients on the table of blocks (a, b, v; gradients at b = -1) with the diagonal blocks' inverses.

    The form with one pair of sums a round: each round is one written table of the vectors by scene, made by a join with the
    blocks and a sum, and two numbers on the driver. It ends when the residual has fallen by tol, or after `most` rounds with what is
    reached by then, from which the next linearisation goes on.
    """
    blocks = sums.where("b <> -1").select("a", "b", "v")

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                yield pd.DataFrame({"a": d["a"], "inv": list(np.linalg.inv(np.stack(d["v"].to_numpy()).reshape(-1, 6, 6)).reshape(-1, 36))})

    inverses = blocks.where("a = b").select("a", "v").mapInPandas(invert, "a long, inv array<double>")
    right = sums.where("b = -1").select("a", F.transform(F.slice("v", 1, 6), lambda x: -x).alias("r"))
    six = range(6)
    times = lambda m, x: [sum((F.col(m)[6 * k + l] * F.col(x)[l] for l in six[1:]), F.col(m)[6 * k] * F.col(x)[0]) for k in six]
    dot = lambda x, y: sum((F.col(x)[k] * F.col(y)[k] for k in six[1:]), F.col(x)[0] * F.col(y)[0])

    def with_products(state: DataFrame) -> DataFrame:
        """state with w, the blocks times u."""
        met = blocks.join(state.select(F.col("a").alias("b"), "u"), "b")
        rows = met.groupBy("a").agg(*(F.sum(x).alias(f"_w{k}") for k, x in enumerate(times("v", "u"))))
        out = state.join(rows, "a").select(*state.columns, F.array(*(f"_w{k}" for k in six)).alias("w"))
        return written(out, "gradients")

    def numbers(state: DataFrame) -> tuple[float, float]:
        found = state.agg(F.sum(dot("r", "u")).alias("g"), F.sum(dot("w", "u")).alias("d")).first()
        return found["g"] or 0.0, found["d"] or 0.0

    none = F.array(*(F.lit(0.0) for _ in six))
    state = with_products(right.join(inverses, "a").select("a", "inv", none.alias("x"), "r", _vector(times("inv", "r"), "u"), none.alias("p"), none.alias("s")))
    gamma, delta = numbers(state)
    first, alpha, beta = gamma, gamma / delta if delta else 0.0, 0.0
    for _ in range(most):
        if not gamma or gamma <= tol * tol * first:
            break
        moved = state.select("a", "inv", "x", "r", _vector([F.col("u")[k] + beta * F.col("p")[k] for k in six], "p"), _vector([F.col("w")[k] + beta * F.col("s")[k] for k in six], "s"))
        moved = moved.select("a", "inv", _vector([F.col("x")[k] + alpha * F.col("p")[k] for k in six], "x"), _vector([F.col("r")[k] - alpha * F.col("s")[k] for k in six], "r"), "p", "s")
        new = with_products(moved.select("a", "inv", "x", "r", _vector(times("inv", "r"), "u"), "p", "s"))
        discard(state)
        state, was = new, gamma
        gamma, delta = numbers(state)
        beta = gamma / was
        alpha = gamma / (delta - beta * gamma / alpha) if gamma else 0.0
    return state.select(F.col("a").alias("scene_id"), F.col("x").alias("step"))


def block_adjustment(ties: DataFrame, scenes: DataFrame, anchor: int, max_iters: int = 15, tol: float = 1e-6, damping: float = 1e-6, observed: int = OBSERVED, task_blocks: int = TASK_BLOCKS) -> DataFrame:
    """scene_id, m, rms: the affines of all scenes that bring the ties' residuals down together in at most max_iters steps,
    the anchor's fixed to identity, and the rms of these affines. damping is added to the diagonal as it is.

    For any number of scenes: each round sums 6 x 6 blocks over the ties (_systems). Scenes that ties link without
    the anchor form a component; one of up to task_blocks blocks is solved by a task, larger ones by conjugate gradients on
    tables. The driver gets sums of squares and counts alone. Scenes without ties, and ties without models, stay out.
    """
    scenes = written(scenes.select("scene_id", "rpc"), "scenes")
    dealt, sums_for = _systems(ties, scenes, observed)
    free = dealt.where((F.col("i") != anchor) & (F.col("j") != anchor)).select("i", "j").distinct()
    parts = written(graph_components(free).withColumnRenamed("id", "_id"), "components")
    affines, large, rms = None, None, float("nan")
    for turn in range(max_iters + 1):
        sums = written(sums_for(affines), "blocks")
        last, rms = rms, sums.agg(_rms(sums)).first()["rms"]
        rms = float("nan") if rms is None else rms
        if rms != rms or turn == max_iters or abs(last - rms) < tol:
            break
        diagonal = [F.col("v")[k] + (damping if k % 7 == 0 else 0.0) for k in range(36)]
        own = sums.where((F.col("a") != -1) & (F.col("a") != anchor) & (F.col("b") != anchor)).withColumn("v", F.when(F.col("a") == F.col("b"), F.array(*diagonal)).otherwise(F.col("v")))
        placed = own.join(parts, F.col("a") == F.col("_id"), "left").withColumn("component", F.coalesce("component", "a")).drop("_id")
        if large is None:
            large = written(placed.groupBy("component").count().where(F.col("count") > task_blocks).select(F.col("component").alias("_large")), "large")
            split = not large.isEmpty()
        small = placed.join(large, F.col("component") == F.col("_large"), "left_anti") if split else placed
        steps = small.select("component", "a", "b", "v").groupBy("component").applyInPandas(_solve_component, _STEP)
        if split:
            steps = steps.unionByName(solve_on_tables(written(placed.join(large, F.col("component") == F.col("_large"), "left_semi"), "large-blocks")))
        held = (F.lit(None).cast("array<double>").alias("m"), F.col("scene_id"), F.col("step")) if affines is None else (F.col("m"), F.coalesce("scene_id", "_id").alias("scene_id"), F.coalesce("step", F.array(*(F.lit(0.0) for _ in range(6)))).alias("step"))
        joined = steps if affines is None else steps.join(affines.withColumnRenamed("scene_id", "_id"), F.col("scene_id") == F.col("_id"), "full_outer")
        identity = F.array(*(F.lit(x) for x in C.IDENTITY))
        moved = joined.select(*held).select("scene_id", F.zip_with(F.coalesce("m", identity), "step", lambda x, y: x + y).alias("m"))
        new = written(moved, "affines")
        discard(sums, *([] if affines is None else [affines]))
        affines = new
    identity = F.array(*(F.lit(x) for x in C.IDENTITY))
    known = scenes.where("scene_id is not null and rpc is not null").select("scene_id")
    if affines is None:
        return known.select("scene_id", identity.alias("m"), F.lit(rms).alias("rms"))
    return known.join(affines, "scene_id", "left").select("scene_id", F.coalesce("m", identity).alias("m"), F.lit(rms).alias("rms"))
