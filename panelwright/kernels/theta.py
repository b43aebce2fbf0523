"""Theta models: static and dynamic, standard and optimised."""

from __future__ import annotations

import numpy as np

from panelwright.kernels.common import Fit, Forecast, clean, decompose
from panelwright.kernels.optimize import lbfgsb

TYPES = ("STM", "OTM", "DSTM", "DOTM")
PATHS = 200


def seasonal_test(y: np.ndarray, m: int) -> bool:
    """Whether the autocorrelation at the period is significant at 90 %."""
    n = len(y)
    if m < 4 or n < 2 * m:
        return False
    d = y - y.mean()
    g0 = float(d @ d)
    if g0 == 0:
        return False
    r = np.array([float(d[: n - k] @ d[k:]) / g0 for k in range(1, m + 1)])
    return abs(r[-1]) / np.sqrt((1 + 2 * float((r[:-1] ** 2).sum())) / n) > 1.645


def _states(y: list, dynamic: bool, l0: float, alpha: float, theta: float, line):
    """One-step forecasts and the state (level, mean, A, B) before each step and after the last."""
    w = 1 - 1 / theta
    a, b = line
    level, mean, power, geo = l0, 0.0, 1.0, 1.0
    fits, states = [], []
    if dynamic:
        a, b = y[0], 0.0
        mean = 0.0
    for t, v in enumerate(y, 1):
        states.append((level, a, b, power, geo))
        f = level + w * (power * a + geo * b)
        fits.append(f)
        level = alpha * v + (1 - alpha) * level
        if dynamic:
            old = mean
            mean = ((t - 1) * mean + v) / t
            b = ((t - 2) * b + 6 * (v - old) / t) / (t + 1) if t > 1 else 0.0
            a = mean - (t + 1) * b / 2
        power *= 1 - alpha
        geo = geo + power
    states.append((level, a, b, power, geo))
    return fits, states


def _ahead(state, alpha, theta, h):
    """Forecasts of the next h steps with the line held."""
    w = 1 - 1 / theta
    level, a, b, power, geo = state
    out = []
    for _ in range(h):
        f = level + w * (power * a + geo * b)
        out.append(f)
        level = alpha * f + (1 - alpha) * level
        power *= 1 - alpha
        geo += power
    return out


def theta(y, m: int = 1, *, model_type: str = "OTM", alpha=None, theta_=None, nmse: int = 3, seasonal: str = "auto", seed: int = 0) -> Fit:
    """Deseasonalised, fitted by the mean squared error over horizons 1 to ``nmse``."""
    y = clean(y)
    if not np.isfinite(y).all():
        raise ValueError("missing values")
    if model_type not in TYPES or not 1 <= nmse <= 30:
        raise ValueError("unknown type, or nmse outside 1 to 30")
    n = len(y)
    if y.min() == y.max():
        fit = Fit(model_type, {"alpha": 0.0, "theta": 2.0}, y.copy(), np.zeros(n), 0.0)
        fit.forecaster = lambda h, levels: Forecast(np.full(h, y[0]), {k: np.full(h, y[0]) for k in levels}, {k: np.full(h, y[0]) for k in levels})
        fit.state["loss"] = 0.0
        return fit
    figure, kind = None, None
    if seasonal != "none" and m > 1 and (seasonal != "auto" or seasonal_test(y, m)):
        kind = "multiplicative" if seasonal in ("auto", "multiplicative") and y.min() > 0 else "additive"
        figure = decompose(y, m, kind)[1]
        if kind == "multiplicative" and figure.min() < 1e-2:
            kind = "additive"
            figure = decompose(y, m, kind)[1]
    season = figure[np.arange(n) % m] if figure is not None else None
    x = y if season is None else y / season if kind == "multiplicative" else y - season
    dynamic = model_type.startswith("D")
    t = np.arange(1, n + 1)
    slope, start = np.polyfit(t, x, 1)
    line = (float(start), float(slope))
    series = x.tolist()
    fixed_theta = 2.0 if model_type in ("STM", "DSTM") else theta_

    def unpack(p):
        p = list(p)
        l0 = p.pop(0)
        a = alpha if alpha is not None else p.pop(0)
        th = fixed_theta if fixed_theta is not None else p.pop(0)
        return l0, a, th

    first = 3 if dynamic else 1

    def loss(p):
        l0, a, th = unpack(p)
        fits, states = _states(series, dynamic, l0, a, th, line)
        if nmse == 1:
            e = np.array(series[first - 1 :]) - np.array(fits[first - 1 :])
            return float((e * e).mean())
        total = [0.0] * nmse
        count = [0] * nmse
        for i in range(n):
            ahead = [fits[i]] if i + 1 >= n else _ahead(states[i], a, th, min(nmse, n - i))
            for k, f in enumerate(ahead):
                if i + k + 1 >= first:
                    e = series[i + k] - f
                    total[k] += e * e
                    count[k] += 1
        return sum(s / c for s, c in zip(total, count, strict=True) if c) / nmse

    x0, lo, hi = [series[0] / 2], [-1e10], [1e10]
    if alpha is None:
        x0, lo, hi = [*x0, 0.5], [*lo, 0.1], [*hi, 0.99]
    if fixed_theta is None:
        x0, lo, hi = [*x0, 2.0], [*lo, 1.0], [*hi, 1e10]
    best = lbfgsb(loss, x0, lo, hi, maxit=60)
    l0, a, th = unpack(best.x.tolist())
    fits, states = _states(series, dynamic, l0, a, th, line)
    fitted = np.array(fits)
    res = x - fitted
    back = fitted if season is None else fitted * season if kind == "multiplicative" else fitted + season
    sigma2 = float((res[first - 1 :] ** 2).mean())
    fit = Fit(model_type, {"alpha": a, "theta": th, "l0": l0}, back, res, sigma2, state={"loss": best.value})

    def reseason(v, h):
        if figure is None:
            return v
        s = figure[(n + np.arange(h)) % m]
        return v * s if kind == "multiplicative" else v + s

    def forecaster(h, levels):
        mean = reseason(np.array(_ahead(states[-1], a, th, h)), h)
        if not levels:
            return Forecast(mean)
        rng = np.random.default_rng(seed)
        w = 1 - 1 / th
        level = np.full(PATHS, states[-1][0])
        _, la, lb, power, geo = states[-1]
        sims = np.empty((PATHS, h))
        for i in range(h):
            f = level + w * (power * la + geo * lb)
            v = f + rng.normal(0, np.sqrt(sigma2), PATHS)
            sims[:, i] = v
            level = a * v + (1 - a) * level
            power *= 1 - a
            geo += power
        sims = reseason(sims, h)
        return Forecast(mean, {k: np.quantile(sims, 0.5 - k / 200, axis=0) for k in levels}, {k: np.quantile(sims, 0.5 + k / 200, axis=0) for k in levels})

    fit.forecaster = forecaster
    return fit


def auto_theta(y, m: int = 1, *, model_type: str | None = None, **kw) -> Fit:
    """The type with the least loss."""
    if model_type is not None:
        return theta(y, m, model_type=model_type, **kw)
    fits = [theta(y, m, model_type=k, **kw) for k in TYPES]
    return min(fits, key=lambda f: f.state["loss"])
