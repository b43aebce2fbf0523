"""Decomposition by LOESS, and tests for unit roots."""

from __future__ import annotations

import math

import numpy as np

from panelwright.kernels.common import box_cox, box_cox_lambda, inv_box_cox


def pacf(y, max_lag: int | None = None) -> np.ndarray:
    """Partial autocorrelations from lag 1, by Durbin and Levinson."""
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]
    n = len(y)
    top = min(max_lag or int(10 * math.log10(n)), n - 1)
    d = y - y.mean()
    g0 = float(d @ d)
    if g0 == 0:
        return np.ones(top)
    r = np.array([float(d[: n - k] @ d[k:]) / g0 for k in range(top + 1)])
    out, phi = np.empty(top), np.zeros(0)
    for k in range(1, top + 1):
        num = r[k] - (phi @ r[k - 1 : 0 : -1] if k > 1 else 0.0)
        den = 1 - (phi @ r[1:k] if k > 1 else 0.0)
        a = num / den if den else 0.0
        phi = np.r_[phi - a * phi[::-1], a]
        out[k - 1] = a
    return out


def loess(y: np.ndarray, span: int, degree: int, weights: np.ndarray | None = None, at: np.ndarray | None = None, jump: int = 1) -> np.ndarray:
    """Local regression of y over 1..n at the points ``at``: tricube weights over the ``span`` nearest points."""
    n = len(y)
    x = np.arange(1, n + 1, dtype=float)
    at = x if at is None else np.asarray(at, dtype=float)
    w0 = np.ones(n) if weights is None else weights
    spots = at if jump <= 1 else np.unique(np.r_[at[::jump], at[-1]])
    q = min(span, n)
    left = np.clip(np.round(spots).astype(int) - 1 - (q - 1) // 2, 0, n - q)
    if span >= n:
        left[:] = 0
    idx = left[:, None] + np.arange(q)[None, :]
    xs = x[idx]
    dist = np.abs(xs - spots[:, None])
    width = np.maximum(spots - xs[:, 0], xs[:, -1] - spots)
    width = width + (span - n) // 2 if span > n else width
    width = np.where(width <= 0, 1, width)
    u = dist / width[:, None]
    w = np.where(u <= 0.999, np.where(u <= 0.001, 1.0, (1 - u**3) ** 3), 0.0) * w0[idx]
    total = w.sum(axis=1)
    safe = np.where(total > 0, total, 1)
    w = w / safe[:, None]
    ys = y[idx]
    fit = (w * ys).sum(axis=1)
    if degree > 0:
        mx = (w * xs).sum(axis=1)
        var = (w * (xs - mx[:, None]) ** 2).sum(axis=1)
        ok = np.sqrt(var) > 0.001 * (n - 1)
        slope = np.where(ok, (w * (xs - mx[:, None]) * ys).sum(axis=1) / np.where(ok, var, 1), 0)
        fit = fit + slope * (spots - mx)
    fit = np.where(total > 0, fit, np.interp(spots, x, y))
    return fit if jump <= 1 else np.interp(at, spots, fit)


def _odd(v: float) -> int:
    k = int(math.ceil(v))
    return k if k % 2 else k + 1


def stl(y, m: int, *, seasonal_window="periodic", seasonal_degree: int = 0, trend_window: int | None = None, trend_degree: int = 1, lowpass_window: int | None = None, lowpass_degree: int | None = None, robust: bool = False, inner: int | None = None, outer: int | None = None) -> dict[str, np.ndarray]:
    """seasonal, trend, remainder and robustness weights."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if m < 2 or n <= 2 * m or not np.isfinite(y).all():
        raise ValueError("stl needs a period above 1, more than two periods and no missing values")
    if seasonal_degree not in (0, 1) or trend_degree not in (0, 1):
        raise ValueError("degrees are 0 or 1")
    periodic = seasonal_window == "periodic"
    sw = 10 * n + 1 if periodic else int(seasonal_window)
    sdeg = 0 if periodic else seasonal_degree
    tw = trend_window or _odd(1.5 * m / (1 - 1.5 / sw))
    lw = lowpass_window or _odd(m)
    ld = trend_degree if lowpass_degree is None else lowpass_degree
    sj, tj, lj = (max(1, math.ceil(v / 10)) for v in (sw, tw, lw))
    inner = inner if inner is not None else (1 if robust else 2)
    outer = outer if outer is not None else (15 if robust else 0)
    trend, seasonal, rw = np.zeros(n), np.zeros(n), np.ones(n)

    def ma(v, k):
        c = np.cumsum(np.r_[0.0, v])
        return (c[k:] - c[:-k]) / k

    for loop in range(outer + 1):
        for _ in range(inner):
            d = y - trend
            cycle = np.empty(n + 2 * m)
            for k in range(m):
                part, w = d[k::m], rw[k::m]
                at = np.arange(0, len(part) + 2, dtype=float)
                if periodic and not robust:
                    cycle[k::m] = part.mean()
                else:
                    cycle[k::m] = loess(part, sw, sdeg, w if robust else None, at, sj)
            low = loess(ma(ma(ma(cycle, m), m), 3), lw, ld, None, None, lj)
            seasonal = cycle[m : m + n] - low
            trend = loess(y - seasonal, tw, trend_degree, rw if robust else None, None, tj)
        if loop < outer:
            r = np.abs(y - seasonal - trend)
            cut = 6 * np.median(r)
            u = r / cut if cut > 0 else np.zeros(n)
            rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    if periodic:
        figure = np.array([seasonal[k::m].mean() for k in range(m)])
        seasonal = figure[np.arange(n) % m]
    return {"seasonal": seasonal, "trend": trend, "remainder": y - seasonal - trend, "weights": rw}


def smooth_trend(x: np.ndarray) -> np.ndarray:
    n = len(x)
    width = max(3, min(n, int(min(max(n // 10, 5), 101))))
    h = (width - 1) // 2
    c = np.r_[0.0, np.cumsum(x)]
    i = np.arange(n)
    lo, hi = np.maximum(i - h, 0), np.minimum(i + h, n - 1)
    return (c[hi + 1] - c[lo]) / (hi - lo + 1)


def fill_linear(y: np.ndarray) -> np.ndarray:
    ok = np.isfinite(y)
    if not ok.any():
        raise ValueError("no values")
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])


def mstl(y, periods, *, iterate: int = 2, lam=None, robust: bool = False, windows=None) -> dict:
    """trend, remainder and one seasonal component per period, by repeated stl."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    periods = sorted({int(p) for p in np.atleast_1d(periods)})
    x = y if np.isfinite(y).all() else interpolate_missing(y, periods[0])
    if lam is not None:
        lam = box_cox_lambda(x, periods[0]) if lam == "auto" else lam
        x = box_cox(x, lam)
    used = [p for p in periods if 1 < p and 2 * p < n]
    windows = windows or [11 + 4 * k for k in range(6)]
    if not used:
        trend = smooth_trend(x)
        return {"trend": trend, "seasonals": {}, "remainder": x - trend, "data": x}
    seas = {p: np.zeros(n) for p in used}
    rest = x.copy()
    for _ in range(iterate if len(used) > 1 else 1):
        for k, p in enumerate(used):
            rest = rest + seas[p]
            fit = stl(rest, p, seasonal_window=windows[min(k, len(windows) - 1)], robust=robust)
            seas[p] = fit["seasonal"]
            trend = fit["trend"]
            rest = rest - seas[p]
    return {"trend": trend, "seasonals": seas, "remainder": rest - trend, "data": x}


def interpolate_missing(y, m: int = 1, *, lam=None, linear: bool | None = None) -> np.ndarray:
    """Fill gaps: straight lines, or lines through the seasonally adjusted series of a first seasonal guess."""
    y = np.asarray(y, dtype=float)
    ok = np.isfinite(y)
    n = len(y)
    if ok.all():
        return y.copy()
    if linear is None:
        linear = m <= 1 or ok.sum() <= 2 * m
    z = y if lam is None else box_cox(y, lam)
    if linear:
        out = fill_linear(z)
        return out if lam is None else inv_box_cox(out, lam)
    t = np.arange(n, dtype=float)
    u = t / n
    k = min(m // 2, 5)
    cols_ = [np.ones(n), u, u**2, u**3] + [f(2 * np.pi * j * t / m) for j in range(1, k + 1) for f in (np.sin, np.cos) if not (f is np.sin and 2 * j == m)]
    x = np.column_stack(cols_)
    beta = np.linalg.lstsq(x[ok], z[ok], rcond=None)[0]
    guess = np.where(ok, z, x @ beta)
    try:
        parts = stl(guess, m, seasonal_window=11, robust=False)["seasonal"]
    except ValueError:
        parts = np.zeros(n)
    adjusted = np.where(ok, z - parts, np.nan)
    out = np.where(ok, z, fill_linear(adjusted) + parts)
    lo, hi = z[ok].min(), z[ok].max()
    spread = hi - lo
    if (out < lo - 0.5 * spread).any() or (out > hi + 0.5 * spread).any():
        out = fill_linear(z)
    return out if lam is None else inv_box_cox(out, lam)


def seasonal_strength(y, m: int) -> float:
    """1 - var(remainder) / var(remainder + seasonal), within 0 and 1."""
    r = mstl(y, [m])
    if m not in r["seasonals"]:
        return 0.0
    both = np.var(r["remainder"] + r["seasonals"][m], ddof=1)
    return float(np.clip(1 - np.var(r["remainder"], ddof=1) / both, 0, 1)) if both > 0 else 0.0


def _pvalue(stat: float, values, probabilities) -> float:
    order = np.argsort(values)
    return float(np.interp(stat, np.asarray(values)[order], np.asarray(probabilities)[order]))


#: Critical values of the KPSS statistic at 10, 5, 2.5 and 1 %.
KPSS = {"level": (0.347, 0.463, 0.574, 0.739), "trend": (0.119, 0.146, 0.176, 0.216)}


def kpss(y, kind: str = "level", lags: int | str = "short") -> dict[str, float]:
    """Stationarity around a level or a trend."""
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]
    n = len(y)
    lag = int(4 * (n / 100) ** 0.25) if lags == "short" else int(12 * (n / 100) ** 0.25) if lags == "long" else int(lags)
    x = np.ones((n, 1)) if kind == "level" else np.column_stack([np.ones(n), np.arange(1, n + 1)])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    s = np.cumsum(e)
    lrv = float(e @ e) / n + 2 / n * sum((1 - k / (lag + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lag + 1))
    stat = float(s @ s) / n**2 / lrv if lrv > 0 else 0.0
    return {"statistic": stat, "lag": lag, "pvalue": _pvalue(stat, KPSS[kind], (0.10, 0.05, 0.025, 0.01))}


#: Dickey-Fuller critical values of tau at 1, 5 and 10 % by number of observations.
ADF_N = (25, 50, 100, 250, 500, 1e5)
ADF = {
    "none": ((-2.66, -1.95, -1.6), (-2.62, -1.95, -1.61), (-2.6, -1.95, -1.61), (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62)),
    "drift": ((-3.75, -3.0, -2.63), (-3.58, -2.93, -2.6), (-3.51, -2.89, -2.58), (-3.46, -2.88, -2.57), (-3.44, -2.87, -2.57), (-3.43, -2.86, -2.57)),
    "trend": ((-4.38, -3.6, -3.24), (-4.15, -3.5, -3.18), (-4.04, -3.45, -3.15), (-3.99, -3.43, -3.13), (-3.98, -3.42, -3.13), (-3.96, -3.41, -3.12)),
}


def _critical(kind: str, n: int) -> list[float]:
    return [float(np.interp(n, ADF_N, [row[k] for row in ADF[kind]])) for k in range(3)]


def adf(y, kind: str = "drift", lags: int = 1, criterion: str | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller tau; with a criterion (aic or bic) the number of lags up to ``lags`` is chosen by it.

    The joint statistics come along: ``phi1`` (root and constant) with a drift, ``phi2`` (root, constant, trend) and ``phi3``
    (root, trend) with a trend.
    """
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]

    def fit(k):
        d = np.diff(y)
        top = lags if criterion else k
        rows = len(d) - top
        if rows < 5:
            raise ValueError("the series is too short")
        x = [y[top:-1]]
        if kind != "none":
            x.append(np.ones(rows))
        if kind == "trend":
            x.append(np.arange(1, rows + 1))
        x += [d[top - j : len(d) - j] for j in range(1, k + 1)]
        x, z = np.column_stack(x), d[top:]
        beta = np.linalg.lstsq(x, z, rcond=None)[0]
        e = z - x @ beta
        s2 = float(e @ e) / max(rows - x.shape[1], 1)
        se = math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[0, 0], 1e-300))
        ic = rows * math.log(max(float(e @ e) / rows, 1e-300)) + x.shape[1] * (2 if criterion == "aic" else math.log(rows))
        joint = {"drift": {"phi1": (0, 1)}, "trend": {"phi2": (0, 1, 2), "phi3": (0, 2)}}.get(kind, {})
        phi = {}
        for name, without in joint.items():
            rest = np.delete(x, without, axis=1)
            left = z - rest @ np.linalg.lstsq(rest, z, rcond=None)[0] if rest.shape[1] else z
            phi[name] = float(left @ left - e @ e) / len(without) / max(s2, 1e-300)
        return beta[0] / se, ic, rows, phi

    if criterion:
        k = min(range(0, lags + 1), key=lambda j: fit(j)[1])
    else:
        k = lags
    tau, _, rows, phi = fit(k)
    c = _critical(kind, rows)
    return {"statistic": float(tau), "lag": k, "pvalue": _pvalue(float(tau), c, (0.01, 0.05, 0.10)), "critical_5": c[1], **phi}


#: MacKinnon's (2010) response surfaces of tau at 1, 5 and 10 %, in powers of 1/n, with a constant and with a trend.
MACKINNON = {
    "constant": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "trend": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}


def phillips_perron(y, kind: str = "constant", lags: str | int = "short", statistic: str = "tau") -> dict[str, float]:
    """Z-tau or, with ``statistic="alpha"``, Z-alpha of Phillips and Perron; Z-alpha has no critical values here."""
    if statistic not in ("tau", "alpha"):
        raise ValueError("statistic is tau or alpha")
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]
    n = len(y) - 1
    if n < 4:
        raise ValueError("the series is too short")
    t = np.arange(1, n + 1)
    x = np.column_stack([y[:-1], np.ones(n)] + ([t - n / 2] if kind == "trend" else []))
    z = y[1:]
    beta = np.linalg.lstsq(x, z, rcond=None)[0]
    e = z - x @ beta
    lag = int(4 * (n / 100) ** 0.25) if lags == "short" else int(12 * (n / 100) ** 0.25) if lags == "long" else int(lags)
    short = float(e @ e) / n
    long = short + 2 / n * sum((1 - k / (lag + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lag + 1))
    if kind == "trend":
        squares, ramp, level = float(z @ z) / n**2, float(t @ z) / n**2.5, float(z.sum()) / n**1.5
        spread = (1 - 1 / n**2) * squares - 12 * ramp**2 + 12 * (1 + 1 / n) * ramp * level - (4 + 6 / n + 2 / n**2) * level**2
    else:
        spread = float(((z - z.mean()) ** 2).sum()) / n**2
    if statistic == "alpha":
        return {"statistic": n * (beta[0] - 1) - (long - short) / (2 * spread), "lag": lag, "pvalue": float("nan"), "critical_5": float("nan")}
    se = math.sqrt(float(e @ e) / (n - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0])
    stat = math.sqrt(short / long) * (beta[0] - 1) / se - (long - short) / (2 * math.sqrt(long) * math.sqrt(spread))
    c = [sum(v / n**k for k, v in enumerate(row)) for row in MACKINNON[kind]]
    return {"statistic": float(stat), "lag": lag, "pvalue": _pvalue(float(stat), c, (0.01, 0.05, 0.10)), "critical_5": c[1]}


def _ocsb_regression(y: np.ndarray, m: int, lags: int, first: int) -> tuple[float, int, float, int]:
    """(t of the seasonal root, rows, residual sum of squares, parameters) of the test regression from row ``first`` on."""
    d, s = np.diff(y), y[m:] - y[:-m]
    both = d[m:] - d[:-m]
    n = len(both)
    back = lambda v, j: v[first - j : n - j]
    ar = [back(both, j) for j in range(1, lags + 1)]
    v = both[first:]
    filtered = [back(s, 0), back(d, 0)]
    if lags:
        phi = np.linalg.lstsq(np.column_stack(ar), v, rcond=None)[0]
        filtered = [w - sum(c * back(u, j) for j, c in enumerate(phi, 1)) for w, u in zip(filtered, (s, d), strict=True)]
    x = np.column_stack([*filtered, *ar])
    if len(v) <= x.shape[1]:
        raise ValueError("the series is too short")
    beta = np.linalg.lstsq(x, v, rcond=None)[0]
    rss = float(((v - x @ beta) ** 2).sum())
    se = math.sqrt(rss / (len(v) - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1])
    return float(beta[1] / se), len(v), rss, x.shape[1]


def ocsb(y, m: int, lags: int = 0, criterion: str | None = None) -> dict[str, float]:
    """Seasonal unit root of Osborn, Chui, Smith and Birchenhall, with the smoothed critical value at 5 %.

    With a criterion (aic, bic or aicc) the regressions of 1 to ``lags`` lags are compared on the same rows; the test then has one
    lag less than the best of them and all the rows that this allows.
    """
    y = np.asarray(y, dtype=float)
    if m < 2 or len(y) < 2 * m + 6 + lags:
        raise ValueError("the series is too short")
    chosen = lags
    if criterion and lags:
        if criterion.lower() not in ("aic", "bic", "aicc"):
            raise ValueError(f"unknown criterion {criterion!r}")

        def value(k):
            _, n, rss, size = _ocsb_regression(y, m, k, lags)
            size += 1
            base = n * (math.log(2 * math.pi) + 1 + math.log(max(rss / n, 1e-300)))
            if criterion.lower() == "bic":
                return base + math.log(n) * size
            small = 2 * size * (size + 1) / (n - size - 1) if criterion.lower() == "aicc" and n > size + 1 else 0.0
            return base + 2 * size + small

        chosen = min(range(1, lags + 1), key=value) - 1
    stat = _ocsb_regression(y, m, chosen, chosen)[0]
    log = math.log(m)
    # The published response curve of the critical value.
    critical = -0.2937411 * math.exp(-0.2850853 * (log - 0.7656451) - 0.05983644 * (log - 0.7656451) ** 2) - 1.652202
    return {"statistic": stat, "critical": critical, "lag": chosen}


def is_constant(y: np.ndarray) -> bool:
    return len(y) == 0 or bool(np.all(y == y[0]))


def ndiffs(y, *, alpha: float = 0.05, test: str = "kpss", max_d: int = 2) -> int:
    """Differences until the test takes the series for stationary."""
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]
    alpha = min(max(alpha, 0.01), 0.1)

    def differ(x):
        try:
            if test == "kpss":
                return kpss(x, lags=int(3 * math.sqrt(len(x)) / 13))["pvalue"] < alpha
            if test == "adf":
                return adf(x, "drift", int(max((len(x) - 1) ** (1 / 3), 0)))["pvalue"] > alpha
            return phillips_perron(x)["pvalue"] > alpha
        except ValueError:
            return False

    d = 0
    while d < max_d and not is_constant(y) and differ(y):
        y, d = np.diff(y), d + 1
        if len(y) < 4:
            break
    return d


def nsdiffs(y, m: int, *, test: str = "seas", max_D: int = 1) -> int:
    """Seasonal differences: by seasonal strength above 0.64, or by the OCSB test."""
    y = np.asarray(y, dtype=float)
    y = y[np.isfinite(y)]
    if m <= 1 or is_constant(y) or len(y) < 2 * m + 1:
        return 0
    D = 0
    while D < max_D and len(y) > 2 * m and not is_constant(y):
        if test == "seas":
            need = seasonal_strength(y, m) > 0.64
        else:
            try:
                r = ocsb(y, m, 3, "aic")
                need = r["statistic"] > r["critical"]
            except ValueError:
                need = False
        if not need:
            break
        y, D = y[m:] - y[:-m], D + 1
    return D
