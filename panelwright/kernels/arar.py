"""ARAR: memory shortening, then an autoregression on the best four lags."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from panelwright.kernels.common import Fit, clean, normal_bands


def defaults(n: int) -> tuple[int, int]:
    """(depth, lag) by the length of the series."""
    if n > 40:
        return 26, 40
    if n >= 13:
        return 13, 13
    depth = max(4, n - 1) if n > 4 else 0
    return depth, depth


def shorten(y: np.ndarray, strong: float = 0.93, max_tau: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Up to three passes; the shortened series and the filter that makes it."""
    psi = np.array([1.0])
    for _ in range(3):
        n = len(y)
        taus = range(1, min(max_tau, n - 1) + 1)
        best = None
        for tau in taus:
            a, b = y[tau:], y[:-tau]
            den = float(b @ b)
            if den == 0:
                continue
            phi = float(a @ b) / den
            top = float(a @ a)
            err = float(((a - phi * b) ** 2).sum()) / top if top else 0.0
            if best is None or err < best[0]:
                best = (err, tau, phi)
        if best is None:
            break
        err, tau, phi = best
        if err <= 8 / n or (phi >= strong and tau > 2):
            step = np.zeros(tau + 1)
            step[0], step[tau] = 1, -phi
        elif phi >= strong:
            # two lags by least squares
            x = np.column_stack([y[1:-1], y[:-2]])
            coef = np.linalg.lstsq(x, y[2:], rcond=None)[0]
            step = np.r_[1.0, -coef]
        else:
            break
        y = np.convolve(y, step)[len(step) - 1 : n]
        psi = np.convolve(psi, step)
    return y, psi


def arar(y, m: int = 1, *, max_ar_depth: int | None = None, max_lag: int | None = None, strong: float = 0.93) -> Fit:
    """Deterministic: all (1, i, j, k) with k up to the depth are solved in one batch and the least variance wins."""
    y = clean(y)
    if not np.isfinite(y).all():
        raise ValueError("missing values")
    n0 = len(y)
    depth, lag = defaults(n0)
    depth, lag = max_ar_depth or depth, max_lag or lag
    if depth < 4 or n0 <= 4:
        raise ValueError("the series is too short")
    s, psi = shorten(y, strong)
    mean = float(s.mean())
    x = s - mean
    n = len(x)
    top = min(lag, n - 1)
    gamma = np.array([float(x[: n - k] @ x[k:]) / n for k in range(top + 1)])
    lags = np.array([(1, i, j, k) for i, j, k in combinations(range(2, min(depth, top) + 1), 3)])
    if len(lags) == 0:
        raise ValueError("the series is too short")
    matrix = gamma[np.abs(lags[:, :, None] - lags[:, None, :])]
    right = gamma[lags]
    with np.errstate(all="ignore"):
        ridge = matrix + 1e-12 * max(gamma[0], 1e-300) * np.eye(4)
        phi = np.linalg.solve(ridge, right[:, :, None])[:, :, 0]
    variance = gamma[0] - (phi * right).sum(axis=1)
    ok = np.isfinite(variance) & (variance >= 0)
    if not ok.any():
        raise ValueError("no stable lags")
    k = int(np.argmin(np.where(ok, variance, np.inf)))
    best, phi, sigma2 = lags[k], phi[k], float(variance[k])
    ar = np.zeros(best[-1] + 1)
    ar[0] = 1
    ar[best] = -phi
    xi = np.convolve(psi, ar)
    constant = (1 - float(phi.sum())) * mean
    order = len(xi) - 1
    fitted = np.full(n0, np.nan)
    if n0 > order:
        conv = np.convolve(y, np.r_[0.0, -xi[1:]])[order:n0]
        fitted[order:] = conv + constant

    def forecaster(h, levels):
        past = y.tolist()
        mean_ = []
        for _ in range(h):
            v = constant - sum(xi[j] * past[-j] for j in range(1, min(order, len(past)) + 1))
            past.append(v)
            mean_.append(v)
        tau = np.zeros(h)
        tau[0] = 1
        for j in range(1, h):
            upto = min(j, order)
            tau[j] = -sum(tau[j - i] * xi[i] for i in range(1, upto + 1))
        return normal_bands(np.array(mean_), np.sqrt(sigma2 * np.cumsum(tau**2)), levels)

    params = {f"lag{i}": float(v) for i, v in enumerate(best)} | {f"phi{i}": float(v) for i, v in enumerate(phi)}
    fit = Fit("ARAR", params, fitted, y - fitted, sigma2, state={"psi": psi, "lags": best})
    fit.forecaster = forecaster
    return fit
