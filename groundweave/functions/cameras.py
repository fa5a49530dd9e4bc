"""Rational camera models in NumPy, batched: projection, inverse, refits.

A model is a dict of the ten offsets and scales by name, the coefficient blocks lnum .. londen (20 each) and adj, a
row-major 2 x 3 affine on (line, samp) that takes observed to original places.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Order of values in a model file: fixed by the format.
SCALARS = ("line_off", "samp_off", "lat_off", "lon_off", "height_off", "line_scale", "samp_scale", "lat_scale", "lon_scale", "height_scale")
DIRECT = ("lnum", "lden", "snum", "sden")
INVERSE = ("latnum", "latden", "lonnum", "londen")
#: Exponents of (P, L, H) in the twenty terms of the format, in order.
TERMS = np.array([(0, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0, 2, 0), (2, 0, 0), (0, 0, 2), (1, 1, 1), (0, 3, 0), (2, 1, 0), (0, 1, 2), (1, 2, 0), (3, 0, 0), (1, 0, 2), (0, 2, 1), (2, 0, 1), (0, 0, 3)])
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def terms(p: np.ndarray, l: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(N, 20) terms of normalised coordinates."""
    power = [np.stack([x**0, x, x * x, x * x * x]) for x in (p, l, h)]
    return np.stack([power[0][a] * power[1][b] * power[2][c] for a, b, c in TERMS]).T


def _ratio(t: np.ndarray, model: dict, num: str, den: str) -> np.ndarray:
    return t @ np.asarray(model[num]) / (t @ np.asarray(model[den]))


def inverse_affine(m) -> np.ndarray:
    m = np.asarray(m, float).reshape(2, 3)
    r = np.linalg.inv(m[:, :2])
    return np.column_stack([r, -r @ m[:, 2]])


def to_photo(model: dict, lat, lon, h) -> tuple[np.ndarray, np.ndarray]:
    """(line, samp) of ground points, after the inverse of the model's affine."""
    return _photo(model, terms((lat - model["lat_off"]) / model["lat_scale"], (lon - model["lon_off"]) / model["lon_scale"], (h - model["height_off"]) / model["height_scale"]))


def _photo(model: dict, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    line = _ratio(t, model, "lnum", "lden") * model["line_scale"] + model["line_off"]
    samp = _ratio(t, model, "snum", "sden") * model["samp_scale"] + model["samp_off"]
    a = inverse_affine(model.get("adj") if model.get("adj") is not None else IDENTITY)
    return a[0, 0] * line + a[0, 1] * samp + a[0, 2], a[1, 0] * line + a[1, 1] * samp + a[1, 2]


def to_ground(model: dict, line, samp, h) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) of image points: the affine first, then the inverse ratio, whose P is samp and L is line."""
    a = np.asarray(model.get("adj") if model.get("adj") is not None else IDENTITY, float)
    l, s = a[0] * line + a[1] * samp + a[2], a[3] * line + a[4] * samp + a[5]
    t = terms((s - model["samp_off"]) / model["samp_scale"], (l - model["line_off"]) / model["line_scale"], (h - model["height_off"]) / model["height_scale"])
    return _ratio(t, model, "latnum", "latden") * model["lat_scale"] + model["lat_off"], _ratio(t, model, "lonnum", "londen") * model["lon_scale"] + model["lon_off"]


class Models:
    """Many models as arrays, a row for each scene, so that points of different scenes are evaluated together."""

    def __init__(self, models: dict[int, dict]):
        self.ids = np.array(sorted(models), "int64")
        own = [models[s] for s in self.ids.tolist()]
        self.scalars = {k: np.array([m[k] for m in own], float) for k in SCALARS}
        self.blocks = {k: np.array([m[k] for m in own], float).reshape(len(own), 20) for k in (*DIRECT, *INVERSE)}
        self.adj = np.array([IDENTITY if m.get("adj") is None else m["adj"] for m in own], float).reshape(len(own), 6)

    def rows(self, scenes) -> tuple[np.ndarray, np.ndarray]:
        """The row of each scene's model, and whether it has one."""
        wanted = np.asarray(scenes, float)
        if not len(self.ids):
            return np.zeros(len(wanted), "int64"), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        return at, self.ids[at] == wanted

    def _ratio(self, t: np.ndarray, at: np.ndarray, num: str, den: str) -> np.ndarray:
        return np.einsum("nk,nk->n", t, self.blocks[num][at]) / np.einsum("nk,nk->n", t, self.blocks[den][at])

    def _norm(self, x, at: np.ndarray, k: str) -> np.ndarray:
        return (x - self.scalars[f"{k}_off"][at]) / self.scalars[f"{k}_scale"][at]

    def _plain(self, x, at: np.ndarray, k: str) -> np.ndarray:
        return x * self.scalars[f"{k}_scale"][at] + self.scalars[f"{k}_off"][at]

    def to_photo(self, at: np.ndarray, lat, lon, h) -> tuple[np.ndarray, np.ndarray]:
        """(line, samp) of ground points, each in its own model's image."""
        t = terms(self._norm(lat, at, "lat"), self._norm(lon, at, "lon"), self._norm(h, at, "height"))
        a = self.adj[at].T
        line, samp = self._plain(self._ratio(t, at, "lnum", "lden"), at, "line") - a[2], self._plain(self._ratio(t, at, "snum", "sden"), at, "samp") - a[5]
        size = a[0] * a[4] - a[1] * a[3]
        return (a[4] * line - a[1] * samp) / size, (a[0] * samp - a[3] * line) / size

    def to_ground(self, at: np.ndarray, line, samp, h) -> tuple[np.ndarray, np.ndarray]:
        """(lat, lon) of image points, each of its own model's image."""
        a = self.adj[at].T
        l, s = a[0] * line + a[1] * samp + a[2], a[3] * line + a[4] * samp + a[5]
        t = terms(self._norm(s, at, "samp"), self._norm(l, at, "line"), self._norm(h, at, "height"))
        return self._plain(self._ratio(t, at, "latnum", "latden"), at, "lat"), self._plain(self._ratio(t, at, "lonnum", "londen"), at, "lon")


def _slope(axis: int) -> np.ndarray:
    """(20, 20): what takes the coefficients of a polynomial in the terms to those of its slope along an axis."""
    out = np.zeros((20, 20))
    for k, powers in enumerate(TERMS):
        if powers[axis]:
            less = powers - np.eye(3, dtype=int)[axis]
            out[np.flatnonzero((TERMS == less).all(axis=1))[0], k] = powers[axis]
    return out


_SLOPES = (_slope(0), _slope(1))


class RunModels(Models):
    """Models for points in the order of their scenes: all polynomials of a run of points of one scene are one product. With slopes."""

    def __init__(self, models: dict[int, dict]):
        super().__init__(models)
        direct, self.inverse = (np.stack([self.blocks[k] for k in names], axis=2) for names in (DIRECT, INVERSE))
        self.direct = np.concatenate([direct, *(s @ direct for s in _SLOPES)], axis=2)

    @staticmethod
    def _values(t: np.ndarray, at: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        if len(first) * 16 > len(at):  # runs too short to be worth it
            return np.einsum("nk,nkm->mn", t, coefficients[at])
        out = np.empty((coefficients.shape[2], len(at)))
        for a, b in zip(first, [*first[1:], len(at)], strict=True):
            out[:, a:b] = coefficients[at[a]].T @ t[a:b].T
        return out

    def to_ground(self, at: np.ndarray, line, samp, h) -> tuple[np.ndarray, np.ndarray]:
        a = self.adj[at].T
        l, s = a[0] * line + a[1] * samp + a[2], a[3] * line + a[4] * samp + a[5]
        v = self._values(terms(self._norm(s, at, "samp"), self._norm(l, at, "line"), self._norm(h, at, "height")), at, self.inverse)
        return self._plain(v[0] / v[1], at, "lat"), self._plain(v[2] / v[3], at, "lon")

    def photo_slopes(self, at: np.ndarray, lat, lon, h) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, samp) of ground points, each in its own model's image, and how both change with a degree of lat and of lon; (2, N) each."""
        v = self._values(terms(self._norm(lat, at, "lat"), self._norm(lon, at, "lon"), self._norm(h, at, "height")), at, self.direct)
        scale = {k: self.scalars[f"{k}_scale"][at] for k in ("lat", "lon", "line", "samp")}
        value = (v[0] / v[1], v[2] / v[3])
        slope = lambda k, i, axis: (v[i] - value[i % 4 // 2] * v[i + 1]) / v[i % 4 + 1] * scale[k] / scale[axis]
        a = self.adj[at].T
        size = a[0] * a[4] - a[1] * a[3]
        back = lambda line, samp: np.stack([(a[4] * line - a[1] * samp) / size, (a[0] * samp - a[3] * line) / size])
        seen = back(self._plain(value[0], at, "line") - a[2], self._plain(value[1], at, "samp") - a[5])
        return seen, back(slope("line", 4, "lat"), slope("samp", 6, "lat")), back(slope("line", 8, "lon"), slope("samp", 10, "lon"))


#: The 84 distinct products of two terms, and where each pair of terms finds its own.
_PRODUCTS, _PAIR = np.unique((TERMS[:, None] + TERMS[None]).reshape(-1, 3), axis=0, return_inverse=True)
_PAIR = _PAIR.reshape(20, 20)


#: Points whose powers are multiplied together, so that they stay in a core's cache.
TOGETHER = 4_000


def _products(p: np.ndarray, l: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(84, N) products of two terms."""
    out = np.empty((len(_PRODUCTS), len(p)))
    for at in range(0, len(p), TOGETHER):
        some = slice(at, at + TOGETHER)
        power = [[x[some] ** k for k in range(7)] for x in (p, l, h)]
        for k, (a, b, c) in enumerate(_PRODUCTS.tolist()):
            np.multiply(power[0][a] * power[1][b], power[2][c], out=out[k, some])
    return out


@lru_cache(maxsize=2)
def _grid(xy: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their products on the virtual grid in normalised coordinates, which are the same for every model."""
    at = [x.ravel() for x in np.meshgrid(*(np.linspace(-1, 1, n) for n in (xy, xy, z)), indexing="ij")]
    return terms(*at), _products(*at)


def _virtual(model: dict, xy: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """(N, 5) line, samp, lat, lon, h of a grid over the model's range, and which of its points lie in the image."""
    axis = lambda k, n: np.linspace(model[f"{k}_off"] - model[f"{k}_scale"], model[f"{k}_off"] + model[f"{k}_scale"], n)
    lat, lon, h = (x.ravel() for x in np.meshgrid(axis("lat", xy), axis("lon", xy), axis("height", z), indexing="ij"))
    line, samp = _photo(model, _grid(xy, z)[0])
    ok = (np.abs(samp - model["samp_off"]) <= model["samp_scale"]) & (np.abs(line - model["line_off"]) <= model["line_scale"])
    return np.stack([line, samp, lat, lon, h]).T, ok


def virtual_grid(model: dict, xy: int, z: int) -> np.ndarray:
    """(N, 5) line, samp, lat, lon, h of a grid over the model's range, without points outside the image."""
    g, ok = _virtual(model, xy, z)
    return g[ok]


def fit_ratios(t: np.ndarray, products: np.ndarray, ok: np.ndarray, *values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each value numerator and denominator (constant 1) with value = ratio where ok, by least squares with a slight ridge. The columns t
    and -value t of the system are never put side by side: its normal matrix consists of sums of products of terms, by themselves, times the
    value and times its square."""
    v, k, w = np.where(ok, np.stack(values), 0), len(values), ok.astype(float)
    sums = products @ np.concatenate([w[None], v, v * v]).T
    plain, normal = sums[_PAIR, 0], []
    for i in range(k):
        cross, square = sums[_PAIR, 1 + i], sums[_PAIR, 1 + k + i]
        n = np.block([[plain, -cross[:, 1:]], [-cross[1:], square[1:, 1:]]])
        normal.append(n + 1e-9 * np.trace(n) / len(n) * np.eye(39))
    slope = sums[_PAIR[0], 1:]
    x, going = np.zeros((39, k)), list(range(k))
    for _ in range(50):  # iterated ridge: the bias of the ridge goes, the stability stays
        right = np.concatenate([slope[:, :k], -slope[1:, k:]])
        steps = {i: np.linalg.solve(normal[i], right[:, i]) for i in going}
        for i, step in steps.items():
            x[:, i] += step
        going = [i for i in going if np.abs(steps[i]).max() >= 1e-12]
        if not going:
            break
        got = np.concatenate([x[:20], np.zeros((1, k)), x[20:]], axis=0).reshape(2, 20, k).transpose(0, 2, 1).reshape(2 * k, 20) @ t.T
        rest = w * (v - got[:k]) + v * got[k:]
        slope = t.T @ np.concatenate([rest, v * rest]).T
    return [(x[:20, i], np.concatenate([[1.0], x[20:, i]])) for i in range(k)]


def fit_inverse(model: dict, xy: int = 30, z: int = 20) -> dict:
    """model with inverse coefficients fitted on a virtual grid (its affine apart)."""
    plain = {**model, "adj": list(IDENTITY)}
    g, ok = _virtual(plain, xy, z)
    if ok.sum() < 78:
        return model
    g = g[ok]
    norm = lambda v, k: (v - model[f"{k}_off"]) / model[f"{k}_scale"]
    at = norm(g[:, 1], "samp"), norm(g[:, 0], "line"), norm(g[:, 4], "height")
    lat, lon = fit_ratios(terms(*at), _products(*at), np.ones(len(g), bool), norm(g[:, 2], "lat"), norm(g[:, 3], "lon"))
    return {**model, **{n: x.tolist() for n, x in zip(INVERSE, (*lat, *lon), strict=True)}}


#: Distinct models whose refits a Python worker keeps, some 6 kB each.
KEPT = 4_096


class Refits:
    """Refits of models; one that is equal to the last bit to one of the last KEPT models is not made again."""

    def __init__(self, fit, *grid: int):
        self.fit, self.grid, self.kept = fit, grid, {}

    def __call__(self, model: dict) -> dict:
        key = tuple(None if model.get(k) is None else np.asarray(model[k], float).tobytes() for k in (*SCALARS, *DIRECT, *INVERSE, "adj"))
        if key not in self.kept:
            if len(self.kept) >= KEPT:
                del self.kept[next(iter(self.kept))]
            self.kept[key] = self.fit(model, *self.grid)
        return self.kept[key]


@lru_cache(maxsize=8)
def refits(fit, *grid: int) -> Refits:
    """The refits of this Python worker."""
    return Refits(fit, *grid)


def bake(model: dict, xy: int = 50, z: int = 30) -> dict:
    """model with its affine worked into refitted coefficients, and an identity affine; as it is if that is identity."""
    if model.get("adj") is None or np.allclose(model["adj"], IDENTITY, atol=1e-8):
        return model
    g, ok = _virtual(model, xy, z)
    if ok.sum() < 39:
        return model
    norm = lambda v, k: (v - model[f"{k}_off"]) / model[f"{k}_scale"]
    line, samp = fit_ratios(*_grid(xy, z), ok, norm(g[:, 0], "line"), norm(g[:, 1], "samp"))
    return fit_inverse({**model, "adj": list(IDENTITY), **{n: x.tolist() for n, x in zip(DIRECT, (*line, *samp), strict=True)}})
