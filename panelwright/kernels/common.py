"""What every model kernel shares."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np


@dataclass
class Forecast:
    mean: np.ndarray
    lower: dict[float, np.ndarray] = field(default_factory=dict)
    upper: dict[float, np.ndarray] = field(default_factory=dict)


@dataclass
class Fit:
    """A fitted model: what it is called, its parameters and criteria, fitted values, and how to forecast."""

    method: str
    params: dict[str, float]
    fitted: np.ndarray
    residuals: np.ndarray
    sigma2: float = float("nan")
    aic: float = float("nan")
    aicc: float = float("nan")
    bic: float = float("nan")
    state: dict = field(default_factory=dict)
    forecaster: object = None

    def forecast(self, h: int, levels=()) -> Forecast:
        return self.forecaster(h, list(levels))


def z_of(level: float) -> float:
    """Normal quantile of a central interval in percent."""
    return NormalDist().inv_cdf(0.5 + level / 200)


def normal_bands(mean: np.ndarray, se: np.ndarray, levels) -> Forecast:
    return Forecast(mean, {lv: mean - z_of(lv) * se for lv in levels}, {lv: mean + z_of(lv) * se for lv in levels})


def clean(y) -> np.ndarray:
    y = np.asarray(y, dtype=float)
    if y.ndim != 1 or len(y) == 0:
        raise ValueError("an empty series")
    return y


def longest_run(y: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the longest run of present values, the first of equally long ones."""
    ok = np.concatenate(([False], np.isfinite(y), [False]))
    begins, ends = np.flatnonzero(~ok[:-1] & ok[1:]), np.flatnonzero(ok[:-1] & ~ok[1:])
    if not len(begins):
        raise ValueError("all values are missing")
    best = int(np.argmax(ends - begins))
    return int(begins[best]), int(ends[best])


def on_longest_run(y: np.ndarray, fitter) -> Fit:
    """Fit the longest run of present values; forecasts still begin behind the whole series, so seasons keep their place."""
    begin, end = longest_run(y)
    fit = fitter(y[begin:end])
    behind, inner = len(y) - end, fit.forecaster

    def padded(part):
        out = np.full(len(y), np.nan)
        out[begin:end] = part
        return out

    def forecaster(h: int, levels):
        fc = inner(h + behind, levels)
        return Forecast(fc.mean[behind:], {k: v[behind:] for k, v in fc.lower.items()}, {k: v[behind:] for k, v in fc.upper.items()})

    fit.fitted, fit.residuals, fit.forecaster = padded(fit.fitted), padded(fit.residuals), forecaster
    return fit


def box_cox(y: np.ndarray, lam: float) -> np.ndarray:
    if lam == 0:
        return np.log(y)
    y = np.where(y < 0, np.nan, y) if lam < 0 else y
    return (np.sign(y) * np.abs(y) ** lam - 1) / lam


def inv_box_cox(x: np.ndarray, lam: float, variance=None) -> np.ndarray:
    if lam == 0:
        out = np.exp(x)
    else:
        x = np.where(x > -1 / lam, np.nan, x) if lam < 0 else x
        xx = x * lam + 1
        out = np.sign(xx) * np.abs(xx) ** (1 / lam)
    return out if variance is None else out * (1 + 0.5 * variance * (1 - lam) / out ** (2 * lam))


def guerrero(y: np.ndarray, m: int, lower: float = -1.0, upper: float = 2.0) -> float:
    """Box-Cox parameter with the least variation of the periods' scaled spread."""
    from panelwright.kernels.optimize import brent

    y = y[np.isfinite(y)]
    period = max(2, m)
    n = len(y)
    if n <= 2 * period:
        return 1.0
    if y.min() <= 0:
        lower = max(lower, 0.0)
    blocks = y[n % period :].reshape(-1, period)
    mean, sd = blocks.mean(axis=1), blocks.std(axis=1, ddof=1)

    def cv(lam):
        with np.errstate(all="ignore"):
            r = sd / mean ** (1 - lam)
        s = r.std(ddof=1) / r.mean() if r.mean() else np.inf
        return float(s) if np.isfinite(s) else 1e35

    return float(brent(cv, lower, upper).x[0])


def loglik_lambda(y: np.ndarray, m: int, lower: float = -1.0, upper: float = 2.0) -> float:
    """Box-Cox parameter of the largest profile likelihood around trend and season, on a grid of 0.05."""
    y = y[np.isfinite(y)]
    n = len(y)
    if n <= 2 * m:
        return 1.0
    if y.min() <= 0:
        lower = max(lower, 0.0)
    t = np.arange(n, dtype=float)
    x = np.column_stack([np.ones(n), t] + ([(np.arange(n) % m == k).astype(float) for k in range(1, m)] if m > 1 else []))
    logs = np.log(np.where(y > 0, y, np.nan))
    geometric = float(np.exp(np.nanmean(logs)))
    best, at = -np.inf, 1.0
    for lam in np.arange(round(lower / 0.05), round(upper / 0.05) + 1) * 0.05:
        with np.errstate(all="ignore"):
            z = (y**lam - 1) / (lam * geometric ** (lam - 1)) if abs(lam) > 0.02 else geometric * logs
        if not np.isfinite(z).all():
            continue
        res = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        value = -n / 2 * np.log(max(float(res @ res) / n, 1e-300))
        if value > best:
            best, at = value, float(lam)
    return at


def box_cox_lambda(y, m: int = 1, method: str = "guerrero", lower: float = -1.0, upper: float = 2.0) -> float:
    return {"guerrero": guerrero, "loglik": loglik_lambda}[method](np.asarray(y, dtype=float), m, lower, upper)


def decompose(y: np.ndarray, m: int, kind: str = "additive") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal figure (m values) and remainder of the classical decomposition."""
    n = len(y)
    if n < 2 * m:
        raise ValueError("fewer than two periods")
    w = np.full(m, 1 / m) if m % 2 else np.r_[0.5 / m, np.full(m - 1, 1 / m), 0.5 / m]
    trend = np.full(n, np.nan)
    h = len(w) // 2
    trend[h : n - h] = np.convolve(y, w, mode="valid")
    add = kind == "additive"
    with np.errstate(all="ignore"):
        d = y - trend if add else y / trend
        figure = np.array([np.nanmean(d[k::m]) for k in range(m)])
        figure = figure - figure.mean() if add else figure / figure.mean()
        season = figure[np.arange(n) % m]
        rest = y - season - trend if add else y / (season * trend)
    return trend, figure, rest
