"""ARARMA: memory shortening, then an ARMA model of what is left."""

from __future__ import annotations

import numpy as np

from panelwright.kernels.arar import shorten
from panelwright.kernels.arima import css_residuals
from panelwright.kernels.common import Fit, clean, normal_bands
from panelwright.kernels.optimize import nelder_mead


def _outside(coef: np.ndarray, sign: int) -> bool:
    """All roots of 1 + sign * sum c_i z^i outside the unit circle."""
    c = np.trim_zeros(np.r_[1.0, sign * coef], "b")
    return len(c) < 2 or bool(np.abs(np.roots(c[::-1])).min() > 1.001)


def ararma(y, m: int = 1, *, p: int = 4, q: int = 1) -> Fit:
    """Fixed orders, fitted by penalised conditional sums of squares."""
    y = clean(y)
    if not np.isfinite(y).all():
        raise ValueError("missing values")
    s, psi = shorten(y, 0.9)
    mean = float(s.mean())
    x = s - mean
    n = len(x)
    if n <= p + q + 2:
        raise ValueError("the series is too short")
    scale = float((x**2).sum()) or 1.0

    def objective(v):
        v = np.asarray(v)
        if not _outside(v[:p], -1) or not _outside(v[p:], 1):
            return 1e10
        e = css_residuals(x, np.r_[1.0, -v[:p]], np.r_[1.0, v[p:]])[p:]
        value = float((e**2).sum()) / scale
        return value if np.isfinite(value) else 1e10

    if p:
        lags = np.column_stack([x[p - k : n - k] for k in range(1, p + 1)])
        start = np.linalg.lstsq(lags, x[p:], rcond=None)[0]
        start = start if _outside(start, -1) else np.zeros(p)
    else:
        start = np.zeros(0)
    best = nelder_mead(objective, np.r_[start, np.zeros(q)], maxit=1500).x if p + q else np.zeros(0)
    phi, th = best[:p], best[p:]
    e = css_residuals(x, np.r_[1.0, -phi], np.r_[1.0, th])
    sigma2 = float((e[p:] ** 2).sum()) / max(n - p, 1)
    k = p + q + 1
    aic = n * np.log(max(sigma2, 1e-300)) + 2 * k
    bic = n * np.log(max(sigma2, 1e-300)) + k * np.log(n)
    xi = np.convolve(psi, np.r_[1.0, -phi])
    constant = mean * (1 - float(phi.sum()))
    lost = len(y) - n

    def forecaster(h, levels):
        past, err, out = y.tolist(), e.tolist(), []
        for _ in range(h):
            v = constant - sum(xi[j] * past[-j] for j in range(1, min(len(xi) - 1, len(past)) + 1))
            v += sum(th[j - 1] * err[-j] for j in range(1, min(q, len(err)) + 1))
            past.append(v)
            err.append(0.0)
            out.append(v)
        tau = np.zeros(h)
        tau[0] = 1
        for j in range(1, h):
            tau[j] = (th[j - 1] if j <= q else 0.0) - sum(xi[i] * tau[j - i] for i in range(1, min(j, len(xi) - 1) + 1))
        return normal_bands(np.array(out), np.sqrt(sigma2 * np.cumsum(tau**2)), levels)

    fitted = np.r_[np.full(lost, np.nan), s - e]
    fit = Fit(f"ARARMA({p},{q})", {f"phi{i + 1}": float(v) for i, v in enumerate(phi)} | {f"theta{i + 1}": float(v) for i, v in enumerate(th)}, fitted, np.r_[np.full(lost, np.nan), e], sigma2, float(aic), float("nan"), float(bic))
    fit.forecaster = forecaster
    return fit


def auto_ararma(y, m: int = 1, *, max_p: int = 4, max_q: int = 2, ic: str = "aic", p: int | None = None, q: int | None = None) -> Fit:
    """The orders of the least criterion; given both, just that model."""
    if p is not None and q is not None:
        return ararma(y, m, p=p, q=q)
    best = None
    for i in range(max_p + 1) if p is None else (p,):
        for j in range(max_q + 1) if q is None else (q,):
            try:
                f = ararma(y, m, p=i, q=j)
            except (ValueError, np.linalg.LinAlgError):
                continue
            if best is None or getattr(f, ic) < getattr(best, ic):
                best = f
    if best is None:
        raise ValueError("no model could be fitted")
    return best
