"""Block adjustment on tables: anchors, affine fits and merges, edges, cycles, and the global Gauss-Newton solve.

Affines are row-major arrays of six doubles on (row, col).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundweave.functions import geometry as G
from groundweave.sources.shared import discard, written


def anchor_scene(edges: DataFrame) -> DataFrame:
    """scene_id, area of the scene whose edges (i, j, area) have the greatest summed overlap; ties to the lowest id."""
    sums = edges.select(F.explode(F.array("i", "j")).alias("scene_id"), "area").groupBy("scene_id").agg(F.sum("area").alias("area"))
    return sums.agg(F.max_by(F.struct("scene_id", "area"), F.struct("area", -F.col("scene_id"))).alias("a")).select("a.*")


def tie_sample_counts(edges: DataFrame, n: int = 256, cap: float = 1e11) -> DataFrame:
    """edges with k = int(n * area / min area), the least area being at most cap."""
    least = edges.agg(F.least(F.min("area"), F.lit(cap)).alias("_least"))
    return edges.crossJoin(F.broadcast(least)).withColumn("k", F.floor(F.col("area") / F.col("_least") * n).cast("long")).drop("_least")  # one row


def merge_reference_affines(edges: DataFrame) -> DataFrame:
    """scene_id, m, n_refs: the mean of each scene's affines, their least-squares merge on one grid; identity without any."""
    per = edges.groupBy("scene_id").agg(*(F.avg(F.col("m")[i]).alias(f"m{i}") for i in range(6)), F.count("m").alias("n_refs"))
    mean = F.array(*(F.coalesce(f"m{i}", F.lit(float(i in (0, 4)))) for i in range(6)))
    return per.select("scene_id", mean.alias("m"), "n_refs")


def weighted_affine_fit(points: DataFrame, by: str, damping: float | None = None) -> DataFrame:
    """by, m: the weighted least-squares affine from (sx, sy) to (dx, dy), weight max(score, 0) + 1e-10.

    Sums are taken about the weighted means. With damping the 2 x 2 system of the centred sums gets it on the diagonal.
    Where the points lie on a line, m is null.
    """
    w = points.withColumn("_w", F.greatest(F.col("score"), F.lit(0.0)) + F.lit(1e-10))
    means = w.groupBy(by).agg(*((F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"_{c}") for c in ("sx", "sy", "dx", "dy")))
    centred = w.join(means, by).select(by, "_w", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("sx", "sy", "dx", "dy")), *(f"_{c}" for c in ("sx", "sy", "dx", "dy")))
    s = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
    sums = centred.groupBy(by, "_sx", "_sy", "_dx", "_dy").agg(*(s(a, b).alias(f"{a}{b}") for a, b in (("sx", "sx"), ("sx", "sy"), ("sy", "sy"), ("sx", "dx"), ("sy", "dx"), ("sx", "dy"), ("sy", "dy"))))
    extra = F.lit(damping or 0.0)
    a, b, c = F.col("sxsx") + extra, F.col("sxsy"), F.col("sysy") + extra
    det = a * c - b * b
    row = lambda t: (F.try_divide(c * F.col(f"sx{t}") - b * F.col(f"sy{t}"), det), F.try_divide(a * F.col(f"sy{t}") - b * F.col(f"sx{t}"), det))
    (p, q), (r, t) = row("dx"), row("dy")
    m = F.array(p, q, F.col("_dx") - p * F.col("_sx") - q * F.col("_sy"), r, t, F.col("_dy") - r * F.col("_sx") - t * F.col("_sy"))
    return sums.select(by, F.when(p.isNotNull(), m).alias("m"))


def directed_edges(pairs: DataFrame, mutual: bool = True) -> DataFrame:
    """i, j, m, weight 1: both directions of rows (i, j, m_ij, m_ji), or the first alone."""
    one = F.struct(F.col("i"), F.col("j"), F.col("m_ij").alias("m"), F.lit(1.0).alias("weight"))
    two = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("m_ji").alias("m"), F.lit(1.0).alias("weight"))
    return pairs.select(F.inline(F.array(one, two) if mutual else F.array(one)))


def stack_results(*tables: DataFrame) -> DataFrame:
    """Rows of all tables one after another; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compose_affines(deltas: DataFrame) -> DataFrame:
    """window_id, m: the last step's affine after all before it (window_id, step, m)."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct("step", "m"))), lambda s: s["m"])
    one = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    return deltas.groupBy("window_id").agg(steps.alias("s")).select("window_id", F.aggregate("s", one, lambda a, b: G.affine_compose(b, a)).alias("m"))


def _moved(m: Column, r: Column, c: Column) -> Column:
    y, x = G.affine_apply(m, r, c)
    return F.struct(y.alias("r"), x.alias("c"))


def affine_endpoint_error(pred: DataFrame, truth: DataFrame, grid: DataFrame, decay: float = 0.8) -> DataFrame:
    """id, epe_last, epe_decayed: mean distance on a grid (r, c) of affines by step (id, step, m) from the true one (id,
    m); the decayed mean weighs step t with decay ** (last - t). Also rotation (degrees) and translation error of the last step."""
    both = pred.join(truth.select("id", F.col("m").alias("t")), "id")
    points = both.crossJoin(F.broadcast(grid))  # a fixed grid of a few points
    a, b = _moved(F.col("m"), F.col("r"), F.col("c")), _moved(F.col("t"), F.col("r"), F.col("c"))
    d = F.sqrt(F.pow(a["r"] - b["r"], 2) + F.pow(a["c"] - b["c"], 2))
    angle = lambda m: F.degrees(F.atan2(m[3], m[0]))
    steps = points.groupBy("id", "step").agg(F.avg(d).alias("epe"), F.max(F.abs(angle(F.col("m")) - angle(F.col("t")))).alias("rotation"), F.max(F.sqrt(F.pow(F.col("m")[2] - F.col("t")[2], 2) + F.pow(F.col("m")[5] - F.col("t")[5], 2))).alias("translation"))
    last = F.max("step").over(Window.partitionBy("id"))
    weighed = steps.withColumn("_w", F.pow(F.lit(decay), last - F.col("step")))
    return weighed.groupBy("id").agg(F.max_by("epe", "step").alias("epe_last"), (F.sum(F.col("epe") * F.col("_w")) / F.sum("_w")).alias("epe_decayed"), F.max_by("rotation", "step").alias("rotation"), F.max_by("translation", "step").alias("translation"))


def cycle_consistency(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """i, j (i < j), cycle: of mutual edges the mean distance from the grid's points of both ways there and back."""
    back = edges.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("m").alias("b"))
    both = edges.where("i < j").select("i", "j", F.col("m").alias("a")).join(back, ["i", "j"]).crossJoin(F.broadcast(grid))  # a fixed grid
    off = lambda m: F.sqrt(F.pow(_moved(m, F.col("r"), F.col("c"))["r"] - F.col("r"), 2) + F.pow(_moved(m, F.col("r"), F.col("c"))["c"] - F.col("c"), 2))
    return both.groupBy("i", "j").agg(((F.avg(off(G.affine_compose(F.col("b"), F.col("a")))) + F.avg(off(G.affine_compose(F.col("a"), F.col("b"))))) / 2).alias("cycle"))


def quad_split(windows: DataFrame, times: int = 1, even_score: bool = True) -> DataFrame:
    """Each window (pair_id, window_id, x0, y0, x1, y1, score) in 4 ** times children, x before y: parent_id, child,
    corners, score. With even_score the r-th best child of a parent counts 0.5 ** (r - 1) of its score.

    The child's score is `score`, or `child_score` (an array by child) where the windows have one.
    """
    side = 2**times
    given = F.col("child_score")[F.col("child")] if "child_score" in windows.columns else F.col("score")
    cells = windows.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    col, row = F.pmod(F.col("child"), F.lit(side)), F.floor(F.col("child") / side)
    w, h = (F.col("x1") - F.col("x0")) / side, (F.col("y1") - F.col("y0")) / side
    out = cells.select("pair_id", F.col("window_id").alias("parent_id"), "child", (F.col("x0") + col * w).alias("x0"), (F.col("y0") + row * h).alias("y0"), (F.col("x0") + (col + 1) * w).alias("x1"), (F.col("y0") + (row + 1) * h).alias("y1"), given.cast("double").alias("score"))
    if not even_score:
        return out
    rank = F.row_number().over(Window.partitionBy("pair_id", "parent_id").orderBy(F.desc("score"), "child"))
    return out.withColumn("score", F.col("score") * F.pow(F.lit(0.5), rank - 1))


def graph_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) over edges (i, j): least labels of neighbours and of labels, to the end."""
    both = written(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "both")
    labels = written(both.groupBy("i").agg(F.least(F.col("i"), F.min("j")).alias("component")).withColumnRenamed("i", "id"), "labels")
    while True:
        least = both.join(labels.select(F.col("id").alias("j"), "component"), "j").groupBy(F.col("i").alias("id")).agg(F.min("component").alias("m"))
        near = labels.select("id", "component").join(least, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        new = written(near.join(labels.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", F.least("component", "next").alias("component"), "was"), "labels")
        discard(labels)
        labels = new
        if not new.where("component <> was").limit(1).count():
            discard(both)
            return new.select("id", "component")


def edge_batches(edges: DataFrame, k: int) -> DataFrame:
    """i, j, batch: k parts whose sizes differ by one at most (the first n mod k are larger), connected edges together."""
    from groundweave.operators.sampling import numbered

    places = numbered(edges.select("i", "j").join(graph_components(edges).withColumnRenamed("id", "i"), "i"), [F.col("component"), F.col("i"), F.col("j")], "rn")
    placed = written(places, "edges")
    discard(places)
    n = placed.count()
    small, larger = n // k, n % k
    head = larger * (small + 1)
    late = F.lit(larger) + F.floor((F.col("rn") - head) / max(small, 1))
    return placed.select("i", "j", F.when(F.col("rn") < head, F.floor(F.col("rn") / (small + 1))).otherwise(late).cast("int").alias("batch"))


# ---- robust fits and the global solve: small dense algebra on many groups


def fit_affine(src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """2 x 3 least-squares affine of points (N, 2)."""
    w = np.ones(len(src)) if weight is None else weight
    a = np.column_stack([src, np.ones(len(src))]) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(a, dst * np.sqrt(w)[:, None], rcond=None)[0].T


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3 x 3 direct linear transform of points (N, 2), N >= 4."""
    x, y = src.T
    u, v = dst.T
    o, z = np.ones(len(src)), np.zeros(len(src))
    a = np.concatenate([np.column_stack([x, y, o, z, z, z, -u * x, -u * y, -u]), np.column_stack([z, z, z, x, y, o, -v * x, -v * y, -v])])
    h = np.linalg.svd(a)[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def fit_rigid(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2 x 3 rotation and shift by SVD."""
    a, b = src.mean(0), dst.mean(0)
    u, _, vt = np.linalg.svd((src - a).T @ (dst - b))
    r = vt.T @ np.diag([1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return np.column_stack([r, b - r @ a])


def moved(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points (N, 2) under a 2 x 3 affine or a 3 x 3 homography."""
    q = np.column_stack([p, np.ones(len(p))]) @ m.T
    return q if m.shape == (2, 3) else q[:, :2] / (q[:, 2:] + 1e-7)


def _draws(n: int, need: int, rounds: int, seed: int) -> np.ndarray:
    """(rounds, need) different numbers under n in each row, all such choices alike."""
    rng = np.random.default_rng(seed)
    picks = np.zeros((rounds, 0), "int64")
    for k in range(need):
        at = rng.integers(0, n - k, rounds)
        for p in np.sort(picks, axis=1).T:  # skip those that are taken, the least first
            at += at >= p
        picks = np.column_stack([picks, at])
    return picks


def _models_of(src: np.ndarray, dst: np.ndarray, kind: str) -> np.ndarray:
    """(rounds, 3, 3) models of minimal samples (rounds, need, 2); NaN where a sample fixes none."""
    ones = np.ones((*src.shape[:2], 1))
    out = np.full((len(src), 3, 3), np.nan)
    if kind == "A":
        a = np.concatenate([src, ones], axis=2)
        ok = np.abs(np.linalg.det(a)) > 1e-9
        out[ok, :2] = np.swapaxes(np.linalg.solve(a[ok], dst[ok]), 1, 2)
    elif kind == "R":
        a, b = src.mean(1, keepdims=True), dst.mean(1, keepdims=True)
        u, _, vt = np.linalg.svd(np.swapaxes(src - a, 1, 2) @ (dst - b))
        turn = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
        flip = np.ones((len(src), 2))
        flip[:, 1] = np.sign(np.linalg.det(turn))
        r = np.swapaxes(vt, 1, 2) * flip[:, None, :] @ np.swapaxes(u, 1, 2)
        out[:, :2, :2], out[:, :2, 2] = r, b[:, 0] - np.einsum("nij,nj->ni", r, a[:, 0])
    else:
        p, none = np.concatenate([src, ones], axis=2), np.zeros((*src.shape[:2], 3))
        rows = [np.concatenate([p, none, -dst[..., :1] * p], axis=2), np.concatenate([none, p, -dst[..., 1:] * p], axis=2)]
        h = np.linalg.svd(np.concatenate(rows, axis=1))[2][:, -1].reshape(-1, 3, 3)
        size = h[:, 2:, 2:]
        return h / np.where(np.abs(size) > 1e-12, size, 1)
    out[:, 2] = 0, 0, 1
    return out


#: Hypothesis by point distances that are held at once.
HELD = 4_000_000


def ransac(src: np.ndarray, dst: np.ndarray, kind: str = "H", thr: float = 1.0, rounds: int = 1000, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The model with most points within thr, refitted on them, and which they are. None if there are too few points.
    All hypotheses are drawn and fitted at once and scored in strips."""
    fit, need = {"H": (fit_homography, 4), "A": (fit_affine, 3), "R": (fit_rigid, 3)}[kind]
    best = np.zeros(len(src), bool)
    if len(src) < need:
        return None, best
    draws = _draws(len(src), need, rounds, seed)
    models = _models_of(src[draws], dst[draws], kind)
    points = np.column_stack([src, np.ones(len(src))]).T
    strip = max(1, HELD // len(src))
    for at in range(0, rounds, strip):
        q = models[at : at + strip] @ points
        with np.errstate(all="ignore"):
            ok = np.hypot(*(q[:, k] / (q[:, 2] + (1e-7 if kind == "H" else 0)) - dst[:, k] for k in (0, 1))) <= thr
        most = int(ok.sum(axis=1).argmax())
        if ok[most].sum() > best.sum():
            best = ok[most]
        if best.all():
            break
    if best.sum() < need:
        return None, best
    return fit(src[best], dst[best]), best


def _seed(key: tuple) -> int:
    return 0 if pd.isna(key[0]) else abs(int(key[0]))


def _key(key: tuple) -> pd.Series:
    return pd.Series([None if pd.isna(key[0]) else int(key[0])], dtype="Int64")


def ransac_transform(matches: DataFrame, kind: str = "H", thr: float = 1.0, rounds: int = 200) -> DataFrame:
    """pair_id, m (6 or 9 numbers; null with too few points), n, n_inliers of rows (pair_id, ya, xa, yb, xb), (row, col).

    A pair's matches come together in one task: they are the points of two images, bounded by their tiles. The draws
    are seeded by the pair. Rows without a pair_id are a pair of their own, with a null pair_id; those without a place don't count.
    """

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["ya", "xa", "yb", "xb"]).sort_values(["ya", "xa", "yb", "xb"])
        model, ok = ransac(rows[["ya", "xa"]].to_numpy(float), rows[["yb", "xb"]].to_numpy(float), kind, thr, rounds, _seed(key))
        return pd.DataFrame({"pair_id": _key(key), "m": [None if model is None else model.ravel().tolist()], "n": [len(rows)], "n_inliers": [int(ok.sum())]})

    return matches.groupBy("pair_id").applyInPandas(fit, "pair_id long, m array<double>, n long, n_inliers long")


def merge_window_affines(windows: DataFrame, thr: float = 20.0, grid: int = 4, step: int = 16, rounds: int = 200) -> DataFrame:
    """pair_id, m: one affine of each pair from its windows (pair_id, window_id, h, m, score).

    A grid x grid of cell centres of each window goes back by the inverse homography, and forward again after the
    window's affine; the inliers of a robust fit at thr are fitted with weights score / mean score. Windows without a
    pair_id are a pair of their own.
    """

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_id")
        at = step // 2 + step * np.arange(grid)
        points = np.array([(r, c) for r in at for c in at], float)
        src, dst, weight = [], [], []
        mean = rows["score"].mean() or 1.0
        for h, m, score in zip(rows["h"], rows["m"], rows["score"], strict=True):
            back = np.linalg.inv(np.reshape(h, (3, 3)))
            src.append(moved(back, points))
            dst.append(moved(back, moved(np.reshape(m, (2, 3)), points)))
            weight.append(np.full(len(points), score / mean))
        src, dst, weight = np.concatenate(src), np.concatenate(dst), np.concatenate(weight)
        _, ok = ransac(src, dst, "A", thr, rounds, _seed(key))
        m = fit_affine(src[ok], dst[ok], np.maximum(weight[ok], 0) + 1e-10) if ok.sum() >= 3 else np.array([[1.0, 0, 0], [0, 1, 0]])
        return pd.DataFrame({"pair_id": _key(key), "m": [m.ravel().tolist()]})

    return windows.groupBy("pair_id").applyInPandas(merge, "pair_id long, m array<double>")
