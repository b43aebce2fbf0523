"""Intermittent demand: Croston's method, its bias corrections, and the version by refitted averages."""

from __future__ import annotations

import numpy as np

from panelwright.kernels.common import Fit, Forecast, clean
from panelwright.kernels.optimize import brent, nelder_mead, nelder_mead_many

KINDS = {"classic": lambda a: 1.0, "sba": lambda a: 1 - a / 2, "sbj": lambda a: 1 - a / (2 - a)}


def _split(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(y)
    return y[at], np.diff(np.r_[-1, at]).astype(float), at


def _rate(z, x, at, n, a_size, a_gap, z0, x0, coefficient):
    """In-sample rate, held from the row after a demand to the next one, and the last rate."""
    zz, xx, rate = z0, x0, np.zeros(n)
    values = []
    for k in range(len(z)):
        zz += a_size * (z[k] - zz)
        xx += a_gap * (x[k] - xx)
        values.append(coefficient * zz / xx)
    for k, v in enumerate(values):
        rate[at[k] + 1 : (at[k + 1] + 1 if k + 1 < len(at) else n)] = v
    return rate, values[-1], zz, xx


def _cost(y: np.ndarray, rate: np.ndarray, metric: str) -> float:
    if metric in ("mae", "mse"):
        e = y - rate
        return float(np.abs(e).mean() if metric == "mae" else (e * e).mean())
    running = np.cumsum(y) / np.arange(1, len(y) + 1)
    k = max(1, int(np.ceil(0.3 * len(y))))
    running[:k] = running[k - 1]
    e = running - rate
    return float(np.abs(e).sum() if metric == "mar" else (e * e).sum())


def croston(y, m: int = 1, *, kind: str = "sba", init_strategy: str = "mean", number_of_params: int = 2, cost_metric: str = "mar", optimize_init: bool = True, rm_missing: bool = False) -> Fit:
    """Optimised smoothing of sizes and intervals; no intervals are offered."""
    y = clean(y)
    if rm_missing:
        y = y[np.isfinite(y)]
    if not np.isfinite(y).all():
        raise ValueError("missing values")
    if kind not in KINDS or cost_metric not in ("mar", "msr", "mae", "mse") or number_of_params not in (1, 2):
        raise ValueError("unknown kind, cost metric or number of parameters")
    z, x, at = _split(y)
    if len(z) < 2:
        raise ValueError("two demands are needed")
    if init_strategy not in ("mean", "naive"):
        raise ValueError("init_strategy is mean or naive")
    z0, x0 = (float(z.mean()), float(x.mean())) if init_strategy == "mean" else (float(z[0]), float(x[0]))
    n, bias = len(y), KINDS[kind]

    def run(p):
        a = p[:number_of_params]
        s, g = (a[0], a[-1])
        zi, xi = (p[number_of_params], p[number_of_params + 1]) if optimize_init else (z0, x0)
        return _rate(z, x, at, n, s, g, zi, xi, bias(g))

    def objective(p):
        if any(v < 0 or v > 1 for v in p[:number_of_params]):
            return 9e99
        if optimize_init and (p[-2] < 0 or p[-2] > z.max() or p[-1] < 1 or p[-1] > max(x.max(), 1)):
            return 9e99
        return _cost(y, run(p)[0], cost_metric)

    start = [0.05] * number_of_params + ([z0, x0] if optimize_init else [])
    if number_of_params == 1 and not optimize_init:
        best = brent(lambda v: objective([v]), 0.0, 1.0).x.tolist()
    else:
        best = nelder_mead(objective, start, maxit=2000).x.tolist()
    rate, last, zz, xx = run(best)
    params = {"alpha_size": best[0], "alpha_interval": best[number_of_params - 1], "size": zz, "interval": xx}
    fit = Fit(f"croston_{kind}", params, rate, y - rate)
    fit.forecaster = lambda h, levels: Forecast(np.full(h, last))
    return fit


def croston_hyndman(y, m: int = 1, *, alpha: float = 0.1) -> Fit:
    """Simple smoothing of sizes and of intervals, ratio of both.  A series without demand forecasts 0."""
    y = clean(y)
    y = np.where(np.isfinite(y), y, 0.0)
    if y.min() < 0:
        raise ValueError("demand can't be negative")

    def smooth(v):
        level = v[0]
        for w in v[1:]:
            level += alpha * (w - level)
        return level

    def ratio(part):
        z, x, _ = _split(part)
        if len(z) == 0:
            return 0.0
        if len(z) == 1:
            return float(z[0] / x[0])
        return float(smooth(z) / smooth(x))

    # the running ratio changes at demands only, so the refits of every prefix take one pass
    fitted, value, zl, xl, gap = np.full(len(y), np.nan), 0.0, None, None, 0
    for i, v in enumerate(y):
        if i:
            fitted[i] = value
        gap += 1
        if v:
            zl, xl = (v, float(gap)) if zl is None else (zl + alpha * (v - zl), xl + alpha * (gap - xl))
            gap, value = 0, zl / xl
    last = ratio(y)
    fit = Fit("croston", {"alpha": alpha}, fitted, y - fitted)
    fit.forecaster = lambda h, levels: Forecast(np.full(h, last))
    return fit


class Demands:
    """Sizes and intervals of the demands of several equally long series, one row each, padded to the most demands."""

    def __init__(self, y: np.ndarray):
        some = y != 0
        self.y, self.count = y, some.sum(axis=1)
        self.most = int(self.count.max(initial=0))
        row, at = np.nonzero(some)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.z, self.x = np.zeros((len(y), self.most)), np.ones((len(y), self.most))
        self.z[row, slot] = y[row, at]
        self.x[row, slot] = at - np.where(slot > 0, np.r_[-1, at[:-1]], -1) if len(at) else at
        self.before = np.cumsum(some, axis=1) - some  # demands before each step


def last_rates(y: np.ndarray, kinds: list[str], *, init_strategy: str = "mean", number_of_params: int = 2, cost_metric: str = "mar", optimize_init: bool = True) -> np.ndarray:
    """The forecasts of ``croston`` for every row of ``y`` (a series of finite values with two demands or more) and every kind.

    All searches run side by side and each takes the steps that it takes alone, so the results are the same numbers.
    """
    d = Demands(y)
    n = y.shape[1]
    real = np.arange(d.most) < d.count[:, None]
    if init_strategy == "mean":
        z0 = np.array([z[:c].mean() for z, c in zip(d.z, d.count, strict=True)])
        x0 = np.where(real, d.x, 0.0).sum(axis=1) / d.count
    else:
        z0, x0 = d.z[:, 0], d.x[:, 0]
    z_most, x_most = np.where(real, d.z, -np.inf).max(axis=1), np.maximum(d.x.max(axis=1), 1)
    if cost_metric in ("mae", "mse"):
        aim = y
    else:
        aim = np.cumsum(y, axis=1) / np.arange(1, n + 1)
        k = max(1, int(np.ceil(0.3 * n)))
        aim[:, :k] = aim[:, k - 1 : k]
    zt, xt = np.ascontiguousarray(d.z.T), np.ascontiguousarray(d.x.T)
    series, kind = np.repeat(np.arange(len(y)), len(kinds)), np.tile(np.arange(len(kinds)), len(y))

    def values(p, rows):
        """The rate behind each demand, 0 before the first."""
        at = series[rows]
        s, g = p[:, 0], p[:, number_of_params - 1]
        zz, xx = (p[:, -2].copy(), p[:, -1].copy()) if optimize_init else (z0[at], x0[at])
        bias = np.choose(kind[rows], [np.broadcast_to(KINDS[k](g), g.shape) for k in kinds])
        out = np.zeros((len(rows), d.most + 1))
        for k in range(int(d.count[at].max())):
            zz += s * (zt[k].take(at) - zz)
            xx += g * (xt[k].take(at) - xx)
            out[:, k + 1] = bias * zz / xx
        return out

    def objective(p, rows):
        at = series[rows]
        weights = p[:, :number_of_params]
        out = ((weights < 0) | (weights > 1)).any(axis=1)
        if optimize_init:
            out |= (p[:, -2] < 0) | (p[:, -2] > z_most[at]) | (p[:, -1] < 1) | (p[:, -1] > x_most[at])
        cost = np.full(len(rows), 9e99)
        rows, at, p = rows[~out], at[~out], p[~out]
        if len(rows):
            rates = values(p, rows)
            e = aim[at] - rates.ravel().take(d.before[at] + (np.arange(len(rows)) * rates.shape[1])[:, None])
            e = np.abs(e) if cost_metric in ("mar", "mae") else e * e
            cost[~out] = e.mean(axis=1) if cost_metric in ("mae", "mse") else e.sum(axis=1)
        return cost

    start = np.full((len(series), number_of_params), 0.05)
    if optimize_init:
        start = np.column_stack([start, z0[series], x0[series]])
    every = np.arange(len(series))
    best = nelder_mead_many(objective, start, maxit=2000)
    return values(best, every)[every, d.count[series]].reshape(len(y), len(kinds))


def last_ratios(y: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """The forecasts of ``croston_hyndman`` for every row of ``y``, whose values are finite and not negative."""
    d = Demands(y)
    if not d.most:
        return np.zeros(len(y))
    z, x = d.z[:, 0].copy(), d.x[:, 0].copy()
    for k in range(1, d.most):
        on = d.count > k
        z = np.where(on, z + alpha * (d.z[:, k] - z), z)
        x = np.where(on, x + alpha * (d.x[:, k] - x), x)
    return np.where(d.count > 0, z / x, 0.0)
