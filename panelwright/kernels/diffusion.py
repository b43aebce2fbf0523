"""Adoption curves fitted to adoption per period: Bass, Gompertz, Gamma/shifted Gompertz, Weibull."""

from __future__ import annotations

import math

import numpy as np

from panelwright.kernels.common import Fit, clean, normal_bands
from panelwright.kernels.optimize import lbfgsb, nelder_mead


def bass(t, m, p, q):
    e = np.exp(-(p + q) * t)
    return m * (1 - e) / (1 + (q / p) * e)


def gompertz(t, m, a, b):
    return m * np.exp(-a * np.exp(-b * t))


def gsgompertz(t, m, a, b, c):
    e = np.exp(-b * t)
    return m * (1 - e) * (1 + a * e) ** (-c)


def weibull(t, m, a, b):
    return m * (1 - np.exp(-((t / a) ** b)))


CURVES = {"bass": (bass, ("m", "p", "q")), "gompertz": (gompertz, ("m", "a", "b")), "gsgompertz": (gsgompertz, ("m", "a", "b", "c")), "weibull": (weibull, ("m", "a", "b"))}


def adoption(kind: str, n: int, params) -> np.ndarray:
    """Adoption per period 1..n: first differences of the cumulative curve, whose first value stands for itself."""
    t = np.arange(1, n + 1, dtype=float)
    c = CURVES[kind][0](t, *params)
    return np.diff(np.r_[0.0, c])


def _starts(kind: str, y: np.ndarray) -> list[list[float]]:
    total = float(y.sum())
    cum = np.cumsum(y)
    n = len(y)
    peak = int(np.argmax(y)) + 1
    sizes = [total * 1.05, total * 1.5, total * 3]
    out = []
    if kind == "bass":
        # y = a + b C + c C^2: m from the roots, then p and q
        lag = np.r_[0.0, cum[:-1]]
        x = np.column_stack([np.ones(n), lag, lag**2])
        a, b, c = np.linalg.lstsq(x, y, rcond=None)[0]
        disc = b * b - 4 * a * c
        if c < 0 and disc > 0:
            m = (-b - math.sqrt(disc)) / (2 * c)
            if m > 0 and a > 0:
                out.append([m, max(a / m, 1e-4), max(-m * c, 1e-4)])
        out += [[m, p, q] for m in sizes for p, q in ((0.03, 0.38), (0.005, 0.6), (0.1, 0.1))]
    elif kind == "gompertz":
        for m in sizes:
            z = np.log(-np.log(np.clip(cum / m, 1e-6, 1 - 1e-6)))
            slope, start = np.polyfit(np.arange(1, n + 1), z, 1)
            out.append([m, float(np.exp(start)), max(-float(slope), 1e-3)])
        out.append([total * 1.2, 5.0, 1 / max(peak, 1)])
    elif kind == "gsgompertz":
        out = [[m, a, b, 1.0] for m in sizes for a, b in ((1.0, 1 / max(peak, 1)), (10.0, 2 / max(peak, 1)))]
    else:
        for m in sizes:
            z = np.log(-np.log(np.clip(1 - cum / m, 1e-6, 1 - 1e-6)))
            slope, start = np.polyfit(np.log(np.arange(1, n + 1)), z, 1)
            b = max(float(slope), 0.1)
            out.append([m, float(np.exp(-start / b)), b])
        out.append([total * 1.2, float(max(peak, 1)), 2.0])
    return out


def diffusion(y, m: int = 1, *, model_type: str = "bass", cumulative: bool = False, loss: int = 2, **fixed) -> Fit:
    """Least squares (``loss`` 2, on adoption) from several starts.  Leading zeros are cut off; parameters stay above 0."""
    y = clean(y)
    kind = model_type.lower()
    if kind not in CURVES:
        raise ValueError(f"unknown curve {model_type!r}")
    if not np.isfinite(y).all() or y.min() < 0:
        raise ValueError("adoption must be known and not negative")
    if cumulative:
        y = np.diff(np.r_[0.0, y])
    lead = int(np.argmax(y > 0)) if (y > 0).any() else len(y)
    x = y[lead:]
    names = CURVES[kind][1]
    if len(x) < len(names) + 1:
        raise ValueError("too few periods with adoption")
    scale = float(x.sum())
    z = x / scale
    n = len(z)
    given = {k: (v / scale if k == "m" else v) for k, v in fixed.items() if k in names and v is not None}
    free = [k for k in names if k not in given]

    def full(p):
        it = iter(p)
        return [given[k] if k in given else next(it) for k in names]

    def objective(p):
        if min(p, default=1) <= 0:
            return 1e30
        with np.errstate(all="ignore"):
            e = z - adoption(kind, n, full(p))
        return float((np.abs(e) ** loss).sum()) if np.isfinite(e).all() else 1e30

    best = None
    for s in _starts(kind, z):
        s = [v for k, v in zip(names, s, strict=True) if k in free]
        a = lbfgsb(objective, s, [1e-9] * len(s), [np.inf] * len(s), maxit=100) if s else None
        b = nelder_mead(objective, a.x, maxit=1000) if s else None
        v = (objective(b.x.tolist()), b.x.tolist()) if s else (objective([]), [])
        if best is None or v[0] < best[0]:
            best = v
    params = full(best[1])
    params[0] *= scale
    fitted = adoption(kind, n, params)
    res = x - fitted
    sigma2 = float((res**2).sum()) / max(n - len(free), 1)
    fit = Fit(f"diffusion_{kind}", dict(zip(names, map(float, params), strict=True)), np.r_[np.zeros(lead), fitted], np.r_[np.zeros(lead), res], sigma2)
    fit.state["lead"] = lead

    def forecaster(h, levels):
        mean = adoption(kind, n + h, params)[n:]
        return normal_bands(mean, np.full(h, math.sqrt(sigma2)), levels)

    fit.forecaster = forecaster
    return fit
