"""Seasonal ARIMA with regressors, and the automatic choice of orders.

The series (less its regression part) is differenced and modelled as an ARMA process: conditional sums of squares give
the start, the exact Gaussian likelihood by a Kalman filter the final estimate.  Stationarity is kept by mapping the
autoregressive parameters through partial autocorrelations; moving-average roots are reflected outside the circle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from panelwright.kernels.common import Fit, Forecast, box_cox, box_cox_lambda, clean, inv_box_cox, normal_bands
from panelwright.kernels.optimize import bfgs
from panelwright.kernels.stats import is_constant, ndiffs, nsdiffs

MAX_MODELS = 94
#: The search uses conditional sums of squares when the length exceeds the bitwise or of 150 and the period.
APPROXIMATE_ABOVE = 150


@dataclass(frozen=True)
class Order:
    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0


def _poly(coef, seasonal, m: int, sign: int) -> np.ndarray:
    """Coefficients of (1 + sign sum a_i B^i)(1 + sign sum A_j B^mj)."""
    a = np.r_[1.0, sign * np.asarray(coef, dtype=float)]
    s = np.zeros(len(seasonal) * m + 1)
    s[0] = 1
    for j, v in enumerate(seasonal, 1):
        s[j * m] = sign * v
    return np.convolve(a, s)


def _difference_poly(d: int, D: int, m: int) -> np.ndarray:
    out = np.array([1.0])
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(D):
        out = np.convolve(out, np.r_[1.0, np.zeros(m - 1), -1.0])
    return out


def difference(x: np.ndarray, d: int, D: int, m: int) -> np.ndarray:
    for _ in range(D):
        x = x[m:] - x[:-m]
    for _ in range(d):
        x = np.diff(x, axis=0)
    return x


def _to_ar(raw: np.ndarray) -> np.ndarray:
    """Stationary autoregressive parameters from unbounded ones."""
    r = np.tanh(raw)
    phi = np.zeros(0)
    for v in r:
        phi = np.r_[phi - v * phi[::-1], v]
    return phi


def _from_ar(phi: np.ndarray) -> np.ndarray:
    """Inverse of ``_to_ar``."""
    phi = np.asarray(phi, dtype=float).copy()
    out = np.zeros(len(phi))
    for k in range(len(phi) - 1, -1, -1):
        v = float(np.clip(phi[k], -0.99, 0.99))
        out[k] = v
        if k:
            head = phi[:k]
            phi = (head + v * head[::-1]) / (1 - v * v)
    return np.arctanh(out)


def _stationary(phi: np.ndarray) -> bool:
    return len(phi) == 0 or bool(np.abs(np.roots(np.r_[1.0, -phi])).max(initial=0) < 1)


def reflect(theta: np.ndarray) -> np.ndarray:
    """The invertible moving average of the same autocovariances up to scale."""
    t = np.trim_zeros(np.asarray(theta, dtype=float), "b")
    if len(t) == 0:
        return np.asarray(theta, dtype=float)
    roots = np.roots(np.r_[t[::-1], 1.0])
    if (np.abs(roots) >= 1).all():
        return np.asarray(theta, dtype=float)
    roots = np.where(np.abs(roots) < 1, 1 / np.conj(roots), roots)
    poly = np.array([1.0 + 0j])
    for r in roots:
        poly = np.convolve(poly, [1.0, -1 / r])
    out = np.zeros(len(theta))
    out[: len(t)] = poly.real[1:]
    return out


def css_residuals(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Residuals of the filter ar(B) w = ma(B) e, zero before the first ``len(ar) - 1`` values."""
    k = len(ar) - 1
    u = np.zeros(len(w))
    u[k:] = np.convolve(w, ar)[k : len(w)]
    lags = [(j, float(ma[j])) for j in range(1, len(ma)) if ma[j]]
    if not lags:
        return u
    e, us = [0.0] * len(w), u.tolist()
    for t in range(k, len(w)):
        v = us[t]
        for j, c in lags:
            if t >= j:
                v -= c * e[t - j]
        if v > 1e150 or v < -1e150:
            return np.full(len(w), 1e150)
        e[t] = v
    return np.array(e)


def _stationary_covariance(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P = T P T' + V by doubling."""
    p, a = v.copy(), t.copy()
    for _ in range(60):
        new = p + a @ p @ a.T
        a = a @ a
        if np.abs(new - p).max() <= 1e-12 * max(1.0, np.abs(new).max()):
            return new
        p = new
    return p


def kalman(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(sum of e^2 / F, sum of log F, standardised innovations) of an ARMA process; missing values are skipped."""
    p, q = len(ar) - 1, len(ma) - 1
    r = max(p, q + 1, 1)
    phi = np.zeros(r)
    phi[:p] = -ar[1:]
    R = np.zeros(r)
    R[: q + 1] = ma
    T = np.zeros((r, r))
    T[:, 0] = phi
    T[np.arange(r - 1), np.arange(1, r)] = 1
    V = np.outer(R, R)
    P = _stationary_covariance(T, V) if p else _ma_covariance(R)
    a = np.zeros(r)
    ss = logs = 0.0
    out = np.full(len(w), np.nan)
    steady = False
    for t, x in enumerate(w.tolist()):
        if x == x:
            F = P[0, 0]
            e = x - a[0]
            if not steady:
                if F < 1e-300:
                    return 1e30, 0.0, out
                K = P[:, 0] / F
            ss += e * e / F
            logs += math.log(F)
            out[t] = e / math.sqrt(F)
            a = a + K * e
            if not steady:
                P = P - np.outer(K, P[0])
        elif steady:
            steady = False
        shifted = np.r_[a[1:], 0.0] + phi * a[0]
        a = shifted
        if not steady:
            TP = np.empty_like(P)
            TP[:-1] = P[1:]
            TP[-1] = 0
            TP += np.outer(phi, P[0])
            N = np.empty_like(P)
            N[:, :-1] = TP[:, 1:]
            N[:, -1] = 0
            N += np.outer(TP[:, 0], phi)
            N += V
            if x == x and abs(N[0, 0] - 1) < 1e-9:
                steady = True
                K = N[:, 0] / N[0, 0]
            P = N
    return ss, logs, out


def _ma_covariance(R: np.ndarray) -> np.ndarray:
    r = len(R)
    P = np.zeros((r, r))
    for k in range(r):
        tail = R[k:]
        P[: len(tail), : len(tail)] += np.outer(tail, tail)
    return P


def project(z, ar, ma, poly, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the next ``h`` values of a series with gaps, and their variances in units of the innovations' variance.

    ``poly`` is the polynomial of the differences.  The state is that of the ARMA part and the last values of the series; the
    first run of values that is long enough to difference starts it, and without one a vague prior does.
    """
    r, k = max(len(ar) - 1, len(ma), 1), len(poly) - 1
    phi, R = np.zeros(r), np.zeros(r + k)
    phi[: len(ar) - 1] = -ar[1:]
    R[: len(ma)] = ma
    T = np.zeros((r + k, r + k))
    T[:r, 0] = phi
    T[np.arange(r - 1), np.arange(1, r)] = 1
    seen = np.r_[1.0, np.zeros(r - 1), -np.asarray(poly[1:], dtype=float)]
    if k:
        T[r] = seen
        T[np.arange(r + 1, r + k), np.arange(r, r + k - 1)] = 1
    V = np.outer(R, R)
    P = np.zeros_like(T)
    P[:r, :r] = _stationary_covariance(T[:r, :r], V[:r, :r])
    state = np.zeros(r + k)
    known = np.r_[0, np.cumsum(np.isfinite(z))]
    starts = np.flatnonzero(known[k:] - known[: len(known) - k] == k)
    if len(starts):
        begin = int(starts[0]) + k
        state[r:] = z[begin - k : begin][::-1]
    else:
        begin, values = 0, z[np.isfinite(z)]
        state[r:] = values[0]
        P[range(r, r + k), range(r, r + k)] = 1e6 * max(1.0, float(np.var(values)))
    for x in z[begin:].tolist():
        if x == x:
            gain = P @ seen / (seen @ P @ seen)
            state = state + gain * (x - seen @ state)
            P = P - np.outer(gain, seen @ P)
        state, P = T @ state, T @ P @ T.T + V
    mean, variance = np.empty(h), np.empty(h)
    for i in range(h):
        mean[i], variance[i] = seen @ state, seen @ P @ seen
        state, P = T @ state, T @ P @ T.T + V
    return mean, variance


def arima(y, m: int = 1, order=(0, 0, 0), seasonal=(0, 0, 0), *, xreg=None, include_mean: bool = True, include_drift: bool = False, method: str = "css-ml", lam=None, biasadj: bool = False, names=None) -> Fit:
    """Fit given orders.  ``xreg`` is a matrix of regressors; a drift is a regressor 1..n."""
    y = clean(y)
    if lam is not None:
        lam = box_cox_lambda(y, m, lower=-0.9) if lam == "auto" else float(lam)
        y = box_cox(y, lam)
    (p, d, q), (P, D, Q) = order, seasonal
    m = max(int(m), 1)
    if m == 1 and (P or D or Q):
        raise ValueError("seasonal orders need a period")
    n = len(y)
    if method not in ("css-ml", "ml", "css"):
        raise ValueError(f"unknown method {method!r}")
    columns, labels = [], []
    if include_mean and d + D == 0:
        columns.append(np.ones(n))
        labels.append("intercept")
    if include_drift and d + D <= 1:
        columns.append(np.arange(1, n + 1, dtype=float))
        labels.append("drift")
    if xreg is not None:
        x0 = np.asarray(xreg, dtype=float).reshape(n, -1)
        columns += list(x0.T)
        labels += list(names) if names is not None else [f"xreg{i + 1}" for i in range(x0.shape[1])]
    X = np.column_stack(columns) if columns else np.zeros((n, 0))
    wy = difference(y, d, D, m)
    wX = difference(X, d, D, m) if X.shape[1] else np.zeros((len(wy), 0))
    ok = np.isfinite(wy) & np.isfinite(wX).all(axis=1)
    used = int(ok.sum())
    k = X.shape[1]
    if used <= p + q + P + Q + k:
        raise ValueError("the series is too short for these orders")
    if k:
        scale = np.linalg.norm(wX[ok], axis=0)
        if (scale == 0).any() or np.linalg.matrix_rank(wX[ok]) < k:
            raise ValueError("collinear or vanishing regressors")
        beta0 = np.linalg.lstsq(wX[ok], wy[ok], rcond=None)[0]
        # the regression parameters are searched in units of their standard errors
        rest = wy[ok] - wX[ok] @ beta0
        unit = np.sqrt(np.diag(np.linalg.pinv(wX[ok].T @ wX[ok])) * max(float(rest @ rest) / max(used - k, 1), 1e-12))
        unit = np.where(unit > 0, unit, 1.0)
    else:
        beta0, unit = np.zeros(0), np.zeros(0)
    missing = not ok.all()

    def split(v):
        return v[:p], v[p : p + q], v[p + q : p + q + P], v[p + q + P : p + q + P + Q], beta0 + v[p + q + P + Q :] * unit

    def polys(v, raw):
        a, t, A, S, b = split(v)
        if raw:
            a, A = (_to_ar(a) if p else a), (_to_ar(A) if P else A)
        return _poly(a, A, m, -1), _poly(t, S, m, 1), b

    def css(v):
        ar, ma, b = polys(v, False)
        a, _, A, _, _ = split(v)
        w = wy - wX @ b if k else wy
        e = css_residuals(np.where(np.isfinite(w), w, 0.0), ar, ma)
        cond = len(ar) - 1
        s2 = float((e[cond:] ** 2).sum()) / max(used - cond, 1)
        return 0.5 * math.log(s2) if 0 < s2 < 1e290 else 1e10

    def ml(v):
        ar, ma, b = polys(v, True)
        ss, logs, _ = kalman(wy - wX @ b if k else wy, ar, ma)
        s2 = ss / used
        return 0.5 * (math.log(s2) + logs / used) if 0 < s2 < 1e290 else 1e10

    count = p + q + P + Q + k
    v = np.zeros(count)
    if method != "ml" and not missing and count:
        v = bfgs(css, v, reltol=1e-8).x
        a, t, A, S, _ = split(v)
        if not _stationary(a) or not _stationary(A):
            if method == "css":
                raise ValueError("non-stationary autoregressive part")
            v[:p] = 0
            v[p + q : p + q + P] = 0
    if method == "css":
        value = css(v)
        ar, ma, b = polys(v, False)
    else:
        a, t, A, S, _ = split(v)
        raw = v.copy()
        raw[:p], raw[p + q : p + q + P] = _from_ar(a), _from_ar(A)
        raw[p : p + q], raw[p + q + P : p + q + P + Q] = reflect(t), reflect(S)
        raw = bfgs(ml, raw, reltol=1e-8).x if count else raw
        _, t, _, S, _ = split(raw)
        raw[p : p + q], raw[p + q + P : p + q + P + Q] = reflect(t), reflect(S)
        value = ml(raw)
        ar, ma, b = polys(raw, True)
        v = raw.copy()
        v[:p], v[p + q : p + q + P] = _to_ar(raw[:p]), _to_ar(raw[p + q : p + q + P])
    if not math.isfinite(value) or value >= 1e9:
        raise ValueError("no likelihood for these orders")
    a, t, A, S, _ = split(v)
    w = wy - wX @ b if k else wy
    if method == "css":
        e = css_residuals(np.where(np.isfinite(w), w, 0.0), ar, ma)
    else:
        e = kalman(w, ar, ma)[2]
    deviance = 2 * used * value + used + used * math.log(2 * math.pi)
    free = count + 1
    aic, bic = deviance + 2 * free, deviance + free * math.log(used)
    aicc = aic + 2 * free * (free + 1) / (used - free - 1) if used > free + 1 else math.inf
    good = np.isfinite(e)
    sigma2 = float((e[good] ** 2).sum()) / max(int(good.sum()) - count, 1)
    lost = n - len(wy)
    full = np.r_[np.full(lost, 0.0), np.where(good, e, 0.0)]
    regression = X @ b if k else np.zeros(n)
    z = y - regression
    whole = np.convolve(ar, _difference_poly(d, D, m))
    params = {f"ar{i + 1}": float(x) for i, x in enumerate(a)} | {f"ma{i + 1}": float(x) for i, x in enumerate(t)}
    params |= {f"sar{i + 1}": float(x) for i, x in enumerate(A)} | {f"sma{i + 1}": float(x) for i, x in enumerate(S)}
    params |= {labels[i]: float(x) for i, x in enumerate(b)}
    label = f"ARIMA({p},{d},{q})" + (f"({P},{D},{Q})[{m}]" if P or D or Q else "") + (" with drift" if "drift" in labels else " with non-zero mean" if "intercept" in labels else "")
    fitted = y - np.r_[np.full(lost, np.nan), e]
    fit = Fit(label, params, fitted if lam is None else inv_box_cox(fitted, lam), np.r_[np.full(lost, np.nan), e], sigma2, aic, aicc, bic)
    fit.state = {"order": (p, d, q), "seasonal": (P, D, Q), "m": m, "ar": ar, "ma": ma, "labels": labels, "loglik": -deviance / 2, "b": b, "used": used}

    def forecaster(h, levels, newx=None):
        future = []
        for name in labels:
            if name == "intercept":
                future.append(np.ones(h))
            elif name == "drift":
                future.append(np.arange(n + 1, n + h + 1, dtype=float))
        if xreg is not None:
            if newx is None:
                raise ValueError("future regressors are needed")
            newx = np.asarray(newx, dtype=float).reshape(h, -1)
            future += list(newx.T)
        shift = np.column_stack(future) @ b if future else np.zeros(h)
        if np.isfinite(z).all():
            past, err = z.tolist(), full.tolist()
            for _ in range(h):
                v = -sum(whole[j] * past[-j] for j in range(1, min(len(whole) - 1, len(past)) + 1))
                v += sum(ma[j] * err[-j] for j in range(1, min(len(ma) - 1, len(err)) + 1))
                past.append(v)
                err.append(0.0)
            ahead = np.array(past[n:])
            psi = np.zeros(h)
            psi[0] = 1
            for j in range(1, h):
                psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(whole[i] * psi[j - i] for i in range(1, min(j, len(whole) - 1) + 1))
            spread = np.cumsum(psi**2)
        else:
            ahead, spread = project(np.where(np.isfinite(z), z, np.nan), ar, ma, _difference_poly(d, D, m), h)
        mean = ahead + shift
        se = np.sqrt(sigma2 * spread)
        fc = normal_bands(mean, se, levels)
        if lam is None:
            return fc
        return Forecast(inv_box_cox(mean, lam, se**2 if biasadj else None), {u: inv_box_cox(x, lam) for u, x in fc.lower.items()}, {u: inv_box_cox(x, lam) for u, x in fc.upper.items()})

    fit.forecaster = forecaster
    return fit


def _roots_far(fit: Fit) -> bool:
    """All roots at least 1.01 away from the origin."""
    for poly in (fit.state["ar"], fit.state["ma"]):
        c = np.trim_zeros(poly, "b")
        if len(c) > 1 and np.abs(np.roots(c[::-1])).min() < 1.01:
            return False
    return True


def auto_arima(y, m: int = 1, *, d: int | None = None, D: int | None = None, max_p: int = 5, max_q: int = 5, max_P: int = 2, max_Q: int = 2, max_order: int = 5, start=(2, 2, 1, 1), ic: str = "aicc", stepwise: bool = True, seasonal: bool = True, approximation: bool | None = None, xreg=None, names=None, lam=None, biasadj: bool = False, allow_drift: bool = True, allow_mean: bool = True, test: str = "kpss", seasonal_test: str = "seas", min_orders=(0, 0, 0, 0)) -> Fit:
    """Orders of the least criterion: differences by tests, then a stepwise walk or the whole grid."""
    y = clean(y)
    ok = np.flatnonzero(np.isfinite(y))
    if len(ok) == 0:
        raise ValueError("no values")
    if xreg is not None:
        xreg = np.asarray(xreg, dtype=float).reshape(len(y), -1)[ok[0] : ok[-1] + 1]
    y = y[ok[0] : ok[-1] + 1]
    x = y[np.isfinite(y)]
    n = len(x)
    m = max(int(m), 1) if seasonal else 1
    m = 1 if n <= m else m
    if lam is not None:
        lam = box_cox_lambda(x, m, lower=-0.9) if lam == "auto" else float(lam)
        work = box_cox(y, lam)
    else:
        work = y
    extra = {"xreg": xreg, "names": names}
    if is_constant(x):
        return arima(work, 1, (0, 0, 0), **extra) if xreg is not None else _constant(x)
    base = work
    if xreg is not None:
        good = np.isfinite(work)
        design = np.column_stack([np.ones(len(work)), xreg])
        base = work - design @ np.linalg.lstsq(design[good], work[good], rcond=None)[0]
    if m == 1:
        D, max_P, max_Q = 0, 0, 0
    elif D is None:
        D = nsdiffs(base, m, test=seasonal_test)
        if D and len(x) <= 2 * m + 2:
            D = 0
    z = base[m:] - base[:-m] if D else base
    if d is None:
        d = ndiffs(z, test=test)
    max_p, max_q = min(max_p, n // 3), min(max_q, n // 3)
    if m > 1:
        max_P, max_Q = min(max_P, (n // 3) // m), min(max_Q, (n // 3) // m)
        if max_P or max_Q:
            max_p, max_q = min(max_p, m - 1), min(max_q, m - 1)
    if approximation is None:
        approximation = n > (APPROXIMATE_ABOVE | m)
    can_constant = d + D <= 1 and ((allow_mean and d + D == 0) or (allow_drift and d + D == 1))
    seen: dict[tuple, Fit | None] = {}
    lo = min_orders

    def attempt(p, q, P, Q, constant, method):
        if p < lo[0] or q < lo[1] or P < lo[2] or Q < lo[3] or p > max_p or q > max_q or P > max_P or Q > max_Q:
            return None
        key = (p, q, P, Q, constant)
        if key in seen or len(seen) >= MAX_MODELS:
            return seen.get(key)
        try:
            f = arima(work, m, (p, d, q), (P, D, Q), include_mean=constant and d + D == 0, include_drift=constant and d + D == 1, method=method, **extra)
            f = f if math.isfinite(getattr(f, ic)) and _roots_far(f) else None
        except (ValueError, np.linalg.LinAlgError, FloatingPointError):
            f = None
        seen[key] = f
        return f

    method = "css" if approximation else "css-ml"
    better = lambda a, b: b is not None and (a is None or getattr(b, ic) < getattr(a, ic))
    best, at = None, None

    def consider(p, q, P, Q, c):
        nonlocal best, at
        f = attempt(p, q, P, Q, c, method)
        if better(best, f):
            best, at = f, (p, q, P, Q, c)
            return True
        return False

    c0 = can_constant
    if stepwise:
        p, q, P, Q = min(start[0], max_p), min(start[1], max_q), min(start[2], max_P), min(start[3], max_Q)
        consider(p, q, P, Q, c0)
        consider(lo[0], lo[1], lo[2], lo[3], c0)
        if max_p or max_P:
            consider(max(1, lo[0]) if max_p else 0, lo[1], 1 if m > 1 and max_P else 0, lo[3], c0)
        if max_q or max_Q:
            consider(lo[0], max(1, lo[1]) if max_q else 0, lo[2], 1 if m > 1 and max_Q else 0, c0)
        if c0:
            consider(lo[0], lo[1], lo[2], lo[3], False)
        if best is None:
            at = (lo[0], lo[1], lo[2], lo[3], c0)
        moves = [(0, 0, -1, 0), (0, 0, 0, -1), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, -1, -1), (0, 0, -1, 1), (0, 0, 1, -1), (0, 0, 1, 1)]
        moves += [(-1, 0, 0, 0), (0, -1, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (-1, -1, 0, 0), (-1, 1, 0, 0), (1, -1, 0, 0), (1, 1, 0, 0)]
        improved = True
        while improved and len(seen) < MAX_MODELS:
            improved = False
            p, q, P, Q, c = at
            for dp, dq, dP, dQ in moves:
                if p + dp < 0 or q + dq < 0 or P + dP < 0 or Q + dQ < 0:
                    continue
                if consider(p + dp, q + dq, P + dP, Q + dQ, c):
                    improved = True
                    break
            if not improved and can_constant:
                improved = consider(p, q, P, Q, not c)
    else:
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                for P in range(max_P + 1):
                    for Q in range(max_Q + 1):
                        if p + q + P + Q <= max_order:
                            for c in (True, False) if can_constant else (False,):
                                consider(p, q, P, Q, c)
    if best is None:
        best = arima(work, m, (0, d, 0), (0, D, 0), include_mean=c0 and d + D == 0, include_drift=c0 and d + D == 1, **extra)
        at = (0, 0, 0, 0, c0)
    if approximation or lam is not None:
        p, q, P, Q, c = at
        ranked = sorted((k for k, f in seen.items() if f is not None), key=lambda k: getattr(seen[k], ic))[:10] or [at]
        for p, q, P, Q, c in ranked:
            try:
                f = arima(y, m, (p, d, q), (P, D, Q), include_mean=c and d + D == 0, include_drift=c and d + D == 1, lam=lam, biasadj=biasadj, **extra)
            except (ValueError, np.linalg.LinAlgError):
                continue
            if _roots_far(f):
                return f
    return best


def _constant(x: np.ndarray) -> Fit:
    v = float(x[0])
    fit = Fit("ARIMA(0,0,0) with non-zero mean", {"intercept": v}, np.full(len(x), v), np.zeros(len(x)), 0.0)
    fit.forecaster = lambda h, levels, newx=None: normal_bands(np.full(h, v), np.zeros(h), levels)
    return fit
