"""Exponential smoothing: state-space ETS with its search, and SES, Holt and Holt-Winters as members of the family.

The recursion is specialised per model: its source is put together from the error, trend and season codes and
compiled once, so the inner loop of the optimiser has no branches.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from panelwright.kernels.common import Fit, Forecast, box_cox, box_cox_lambda, clean, decompose, inv_box_cox, normal_bands, on_longest_run
from panelwright.kernels.optimize import nelder_mead

LOWER = {"alpha": 1e-4, "beta": 1e-4, "gamma": 1e-4, "phi": 0.8}
UPPER = {"alpha": 0.9999, "beta": 0.9999, "gamma": 0.9999, "phi": 0.98}
MAX_PERIOD = 24
PATHS = 5000


@lru_cache(maxsize=64)
def _recursion(e: str, t: str, s: str, damped: bool):
    """``run(y, l, b, seasons, alpha, beta, gamma, phi, keep)`` -> (sum of squared errors, sum of log|fit|, states)."""
    q = "l" if t == "N" else {"A": "l + phi * b", "M": "l * b ** phi"}[t] if damped else {"A": "l + b", "M": "l * b"}[t]
    f = {"N": "q", "A": "q + sm", "M": "q * sm"}[s]
    p = {"N": "v", "A": "v - sm", "M": "v / sm if abs(sm) > 1e-10 else 1e10"}[s]
    lines = ["def run(y, l, b, seasons, alpha, beta, gamma, phi, keep):", " m = len(seasons); k = 0; sse = 0.0; logs = 0.0; out = []", " ratio = beta / alpha"]
    lines += [" for v in y:"]
    if t == "M":
        lines += ["  if b <= 0 or l <= 0: return (1e30, 0.0, None)"]
    if s != "N":
        lines += ["  sm = seasons[k]"]
    lines += [f"  q = {q}", f"  f = {f}"]
    if e == "M":
        lines += ["  a = abs(f)", "  if a < 1e-10: return (1e30, 0.0, None)", "  r = (v - f) / f", "  logs += log(a)"]
    else:
        lines += ["  r = v - f"]
    lines += ["  sse += r * r", "  if sse > 1e30: return (1e30, 0.0, None)", f"  p = {p}", "  n = q + alpha * (p - q)"]
    if t == "A":
        pb = "phi * b" if damped else "b"
        lines += [f"  b = {pb} + ratio * (n - l - {pb})"]
    if t == "M":
        pb = "b ** phi" if damped else "b"
        lines += [f"  pb = {pb}", "  b = pb + ratio * ((n / l if abs(l) > 1e-10 else 1e10) - pb)"]
    if s == "A":
        lines += ["  seasons[k] = sm + gamma * (v - q - sm)"]
    if s == "M":
        lines += ["  seasons[k] = sm + gamma * ((v / q if abs(q) > 1e-10 else 1e10) - sm)"]
    if s != "N":
        lines += ["  k = k + 1 if k + 1 < m else 0"]
    lines += ["  l = n", "  if keep: out.append((f, r))", " return (sse, logs, (l, b, seasons[k:] + seasons[:k], out))"]
    space = {"log": math.log, "abs": abs, "len": len}
    exec("\n".join(lines), space)  # noqa: S102  the text is made of the four codes above only
    return space["run"]


def _initial(y: np.ndarray, m: int, t: str, s: str) -> tuple[float, float, list[float]]:
    """Level, growth and the first period's seasonal effects in order of time."""
    n = len(y)
    seasons: list[float] = []
    adjusted = y
    if s != "N":
        if n >= 3 * m:
            figure = decompose(y, m, "additive" if s == "A" else "multiplicative")[1]
            seasons = figure.tolist()
        else:
            x = np.arange(1, n + 1)
            design = np.column_stack([np.ones(n), x, np.sin(2 * np.pi * x / m), np.cos(2 * np.pi * x / m)])
            beta = np.linalg.lstsq(design, y, rcond=None)[0]
            trend = beta[0] + beta[1] * x
            d = y - trend if s == "A" else y / np.where(trend == 0, 1e-10, trend)
            figure = np.array([d[k::m].mean() for k in range(m)])
            seasons = (figure - figure.mean() if s == "A" else figure / figure.mean()).tolist()
        if s == "M":
            seasons = [max(v, 0.01) for v in seasons]
            total = sum(seasons) / m
            seasons = [v / total for v in seasons]
        long = np.array(seasons)[np.arange(n) % m]
        adjusted = y - long if s == "A" else y / long
    k = min(max(10, 2 * m), n)
    part = adjusted[:k]
    if t == "N":
        return float(part.mean()), 0.0, seasons
    x = np.arange(1, k + 1)
    slope, level = np.polyfit(x, part, 1) if k > 1 else (0.0, float(part[0]))
    if t == "A":
        if abs(level + slope) < 1e-8:
            level, slope = level * (1 + 1e-3), slope * (1 - 1e-3)
        return float(level), float(slope), seasons
    l0 = level + slope
    l0 = 1e-7 if abs(l0) < 1e-8 else l0
    b0 = (level + 2 * slope) / l0
    l0 /= b0 if abs(b0) > 1e-8 else 1e-8
    if l0 < 1e-8 or b0 < 1e-8:
        l0, b0 = max(abs(float(y[0])), 1e-3), max(float(y[1] / y[0]) if n > 1 and y[0] else 1.0, 1e-3)
    return float(l0), float(b0), seasons


def _admissible(alpha, beta, gamma, phi, m, s) -> bool:
    """Forecastability of the additive form: no root of the characteristic polynomial outside the unit circle."""
    if phi < 0 or phi > 1 + 1e-8:
        return False
    if s == "N":
        if alpha < 1 - 1 / phi or alpha > 1 + 1 / phi:
            return False
        return not (beta < alpha * (phi - 1) or beta > (1 + phi) * (2 - alpha))
    if m < 2:
        return True
    if gamma < max(1 - 1 / phi - alpha, 0) or gamma > 1 + 1 / phi - alpha:
        return False
    if alpha < 1 - 1 / phi - gamma * (1 - m + phi + phi * m) / (2 * phi * m):
        return False
    if beta < -(1 - phi) * (gamma / m + alpha):
        return False
    a = phi * (1 - alpha - gamma)
    b = alpha + beta - alpha * phi + gamma - 1
    c = alpha + beta - alpha * phi
    d = alpha + beta - phi
    poly = np.r_[1.0, d, np.full(max(m - 2, 0), c), b, a] if m > 1 else np.r_[1.0, d, b, a]
    return bool(np.abs(np.roots(poly)).max() <= 1 + 1e-10)


def fit_ets(y, m: int, e: str, t: str, s: str, damped: bool, *, fixed: dict | None = None, criterion: str = "lik", bounds: str = "both", nmse: int = 3, maxit: int = 2000) -> Fit:
    """One member of the family by Nelder-Mead over the smoothing weights and initial states."""
    y = clean(y)
    n = len(y)
    fixed = {k: v for k, v in (fixed or {}).items() if v is not None}
    run = _recursion(e, t, s, damped)
    if (e == "M" or s == "M" or t == "M") and y.min() <= 0:
        raise ValueError("multiplicative models need positive data")
    names = ["alpha"] + (["beta"] if t != "N" else []) + (["gamma"] if s != "N" else []) + (["phi"] if damped else [])
    free = [k for k in names if k not in fixed]
    lo, up = dict(LOWER), dict(UPPER)
    start = {}
    start["alpha"] = fixed.get("alpha", lo["alpha"] + 0.2 * (up["alpha"] - lo["alpha"]) / max(m, 1))
    if t != "N":
        top = min(up["beta"], start["alpha"])
        start["beta"] = fixed.get("beta", lo["beta"] + 0.1 * (top - lo["beta"]))
    if s != "N":
        top = min(up["gamma"], 1 - start["alpha"])
        start["gamma"] = fixed.get("gamma", lo["gamma"] + 0.05 * (top - lo["gamma"]))
    if damped:
        start["phi"] = fixed.get("phi", lo["phi"] + 0.99 * (up["phi"] - lo["phi"]))
    l0, b0, seasons0 = _initial(y, m, t, s)
    series = y.tolist()
    base = 0.0 if s == "A" else float(m)

    def unpack(x):
        it = iter(x)
        p = {k: (fixed[k] if k in fixed else next(it)) for k in names}
        level = next(it)
        growth = next(it) if t != "N" else 0.0
        if s == "N":
            return p, level, growth, []
        given = [next(it) for _ in range(m - 1)]
        # the first effect is free from the others' sum; effects are in order of time, the last one completes them
        return p, level, growth, [*given, base - sum(given)]

    def objective(x):
        p, level, growth, seasons = unpack(x)
        alpha, beta, gamma, phi = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0), p.get("phi", 1.0)
        for k in free:
            if p[k] < lo[k] or p[k] > up[k]:
                return 1e30
        if bounds in ("usual", "both") and ((t != "N" and beta > alpha) or (s != "N" and gamma > 1 - alpha)):
            return 1e30
        if s == "M" and min(seasons) < 0:
            return 1e30
        if bounds in ("admissible", "both") and not _usual_inside(alpha, beta, gamma, phi) and not _admissible(alpha, beta, gamma, phi, m, s):
            return 1e30
        sse, logs, _ = run(series, level, growth, seasons, alpha, beta, gamma, phi, False)
        if sse >= 1e30:
            return 1e30
        if criterion == "mse":
            return sse / n
        value = n * math.log(max(sse, 1e-300))
        return value + 2 * logs if e == "M" else value

    x0 = [start[k] for k in free] + [l0] + ([b0] if t != "N" else []) + (seasons0[: m - 1] if s != "N" else [])
    best = nelder_mead(objective, x0, maxit=maxit)
    if best.value >= 1e30:
        raise ValueError("no admissible parameters")
    p, level, growth, seasons = unpack(best.x.tolist())
    sse, logs, state = run(series, level, growth, list(seasons), p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0), p.get("phi", 1.0), True)
    l, b, last, out = state
    fitted = np.array([f for f, _ in out])
    res = np.array([r for _, r in out])
    lik = n * math.log(max(sse, 1e-300)) + (2 * logs if e == "M" else 0.0)
    np_ = len(best.x) + 1
    aic, bic = lik + 2 * np_, lik + np_ * math.log(n)
    aicc = aic + 2 * np_ * (np_ + 1) / (n - np_ - 1) if n - np_ - 1 > 0 else math.inf
    sigma2 = sse / max(n - (len(free) + 1), 1)
    label = f"ETS({e},{t}{'d' if damped else ''},{s})"
    info = dict(p) | {"l0": level} | ({"b0": growth} if t != "N" else {})
    fit = Fit(label, info, fitted, res, sigma2, aic, aicc, bic, {"l": l, "b": b, "s": last, "e": e, "t": t, "d": damped, "season": s, "m": m, "p": p})
    fit.state["lik"] = lik
    fit.forecaster = lambda h, levels: _forecast(fit, h, levels)
    return fit


def _usual_inside(alpha, beta, gamma, phi) -> bool:
    """The usual region lies inside the admissible one."""
    return 0 < alpha < 1 and 0 <= beta <= alpha and 0 <= gamma <= 1 - alpha and 0 < phi <= 1


def _means(st: dict, h: int) -> np.ndarray:
    phi = st["p"].get("phi", 1.0)
    l, b, s, m = st["l"], st["b"], st["s"], max(st["m"], 1)
    out, total = np.empty(h), 0.0
    for i in range(h):
        total += phi ** (i + 1) if st["d"] else 1.0
        v = l if st["t"] == "N" else l + total * b if st["t"] == "A" else l * b**total
        out[i] = v + s[i % m] if st["season"] == "A" else v * s[i % m] if st["season"] == "M" else v
    return out


def _forecast(fit: Fit, h: int, levels) -> Forecast:
    st, p = fit.state, fit.state["p"]
    mean = _means(st, h)
    alpha, beta, gamma, phi = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0), p.get("phi", 1.0)
    e, t, s, m = st["e"], st["t"], st["season"], max(st["m"], 1)
    if not levels:
        return Forecast(mean)
    if t == "M" or (s == "M" and e == "A"):
        return _simulated(fit, mean, h, levels)
    j = np.arange(1, h)
    growth = np.cumsum(phi ** np.arange(0, h))[: h - 1] if t == "A" else np.zeros(h - 1)
    c = alpha + (beta * (growth if st["d"] else j) if t == "A" else 0.0) + (gamma * (j % m == 0) if s != "N" else 0.0)
    c = np.broadcast_to(np.asarray(c, dtype=float), (h - 1,))
    if e == "A":
        variance = fit.sigma2 * np.r_[1.0, 1.0 + np.cumsum(c**2)]
        return normal_bands(mean, np.sqrt(variance), levels)
    if s != "M":
        theta = np.empty(h)
        for i in range(h):
            theta[i] = mean[i] ** 2 + fit.sigma2 * sum(c[k - 1] ** 2 * theta[i - k] for k in range(1, i + 1))
        variance = (1 + fit.sigma2) * theta - mean**2
        return normal_bands(mean, np.sqrt(np.maximum(variance, 0)), levels)
    # multiplicative season and errors: level and trend form (class 2) times seasonal products
    plain = mean / np.array([st["s"][i % m] for i in range(h)])
    cl = alpha + (beta * (growth if st["d"] else j) if t == "A" else 0.0)
    cl = np.broadcast_to(np.asarray(cl, dtype=float), (h - 1,))
    theta = np.empty(h)
    for i in range(h):
        theta[i] = plain[i] ** 2 + fit.sigma2 * sum(cl[k - 1] ** 2 * theta[i - k] for k in range(1, i + 1))
    season2 = np.array([st["s"][i % m] ** 2 * (1 + gamma**2 * fit.sigma2) ** (i // m) for i in range(h)])
    variance = season2 * theta * (1 + fit.sigma2) - mean**2
    return normal_bands(mean, np.sqrt(np.maximum(variance, 0)), levels)


def simulate(fit: Fit, h: int, paths: int = PATHS, seed: int = 0) -> np.ndarray:
    """Future paths (paths x h) with normal errors."""
    st, p = fit.state, fit.state["p"]
    rng = np.random.default_rng(seed)
    err = rng.normal(0, math.sqrt(fit.sigma2), (paths, h))
    l, b = np.full(paths, st["l"]), np.full(paths, st["b"])
    s = np.tile(np.array(st["s"]), (paths, 1)) if st["season"] != "N" else None
    alpha, beta, gamma, phi = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0), p.get("phi", 1.0)
    out = np.empty((paths, h))
    for i in range(h):
        pb = b * phi if st["t"] == "A" else np.abs(b) ** phi
        q = l if st["t"] == "N" else l + pb if st["t"] == "A" else l * pb
        sm = s[:, i % st["m"]] if s is not None else None
        f = q if s is None else q + sm if st["season"] == "A" else q * sm
        v = f + err[:, i] if st["e"] == "A" else f * (1 + err[:, i])
        out[:, i] = v
        pp = v if s is None else v - sm if st["season"] == "A" else v / sm
        new = q + alpha * (pp - q)
        if st["t"] == "A":
            b = pb + beta / alpha * (new - l - pb)
        elif st["t"] == "M":
            b = pb + beta / alpha * (new / l - pb)
        if s is not None:
            s[:, i % st["m"]] = sm + gamma * ((v - q if st["season"] == "A" else v / q) - sm)
        l = new
    return out


def _simulated(fit: Fit, mean: np.ndarray, h: int, levels) -> Forecast:
    sims = simulate(fit, h)
    return Forecast(
        mean, {lv: np.quantile(sims, 0.5 - lv / 200, axis=0) for lv in levels}, {lv: np.quantile(sims, 0.5 + lv / 200, axis=0) for lv in levels}
    )


def _transformed(y, m, lam, biasadj, make) -> Fit:
    """Fit on the Box-Cox scale and forecast on the original one."""
    y = clean(y)
    if lam is None:
        return make(y)
    lam = box_cox_lambda(y, m, lower=-0.9) if lam == "auto" else float(lam)
    fit = make(box_cox(y, lam))
    inner = fit.forecaster

    def forecaster(h, levels):
        fc = inner(h, levels or ([80.0] if biasadj else []))
        variance = None
        if biasadj:
            lv = max(fc.lower)
            from panelwright.kernels.common import z_of

            variance = ((fc.upper[lv] - fc.lower[lv]) / (2 * z_of(lv))) ** 2
        keep = list(levels)
        return Forecast(inv_box_cox(fc.mean, lam, variance), {k: inv_box_cox(fc.lower[k], lam) for k in keep}, {k: inv_box_cox(fc.upper[k], lam) for k in keep})

    fit.forecaster = forecaster
    fit.params["lambda"] = lam
    fit.fitted = inv_box_cox(fit.fitted, lam)
    return fit


def ses(y, m: int = 1, *, alpha=None, initial: str = "optimal", lam=None, biasadj: bool = False) -> Fit:
    """Simple exponential smoothing."""
    if initial == "simple":
        return _renamed(_transformed(y, m, lam, biasadj, lambda z: conventional(z, 1, alpha=alpha, trend=False, seasonal=None)), "Simple exponential smoothing")
    return _renamed(_transformed(y, m, lam, biasadj, lambda z: fit_ets(z, 1, "A", "N", "N", False, fixed={"alpha": alpha}, criterion="mse")), "Simple exponential smoothing")


def holt(y, m: int = 1, *, damped: bool = False, exponential: bool = False, alpha=None, beta=None, phi=None, initial: str = "optimal", lam=None, biasadj: bool = False) -> Fit:
    """Linear or exponential trend."""
    name = ("Damped " if damped else "") + "Holt's method" + (" with exponential trend" if exponential else "")
    if initial == "simple" and not damped:
        return _renamed(_transformed(y, m, lam, biasadj, lambda z: conventional(z, 1, alpha=alpha, beta=beta, trend=True, exponential=exponential, seasonal=None)), name)
    e, t = ("M", "M") if exponential else ("A", "A")
    return _renamed(_transformed(y, m, lam, biasadj, lambda z: fit_ets(z, 1, e, t, "N", damped, fixed={"alpha": alpha, "beta": beta, "phi": phi}, criterion="mse")), name)


def holt_winters(y, m: int, *, seasonal: str = "additive", damped: bool = False, exponential: bool = False, alpha=None, beta=None, gamma=None, phi=None, initial: str = "optimal", lam=None, biasadj: bool = False) -> Fit:
    """Trend and season."""
    y = clean(y)
    if m <= 1 or len(y) <= m + 3:
        raise ValueError("a period above 1 and more than m + 3 values are needed")
    if exponential and seasonal == "additive":
        raise ValueError("an exponential trend goes with a multiplicative season")
    name = ("Damped " if damped else "") + f"Holt-Winters' {seasonal} method" + (" with exponential trend" if exponential else "")
    if initial == "simple":
        return _renamed(_transformed(y, m, lam, biasadj, lambda z: conventional(z, m, alpha=alpha, beta=beta, gamma=gamma, trend=True, exponential=exponential, seasonal=seasonal)), name)
    e, t, s = ("A", "A", "A") if seasonal == "additive" else ("M", "M" if exponential else "A", "M")
    return _renamed(_transformed(y, m, lam, biasadj, lambda z: fit_ets(z, m, e, t, s, damped, fixed={"alpha": alpha, "beta": beta, "gamma": gamma, "phi": phi}, criterion="mse")), name)


def _renamed(fit: Fit, name: str) -> Fit:
    fit.method = name
    return fit


def conventional(y, m: int, *, alpha=None, beta=None, gamma=None, trend: bool = True, exponential: bool = False, seasonal: str | None = "additive") -> Fit:
    """Classic smoothing with simple start values; only the weights are optimised.  The seasonal update uses the level
    and trend of the step before."""
    y = clean(y)
    n = len(y)
    mult = seasonal == "multiplicative"
    if seasonal:
        l0 = y[:m].mean()
        b0 = (y[m : 2 * m].mean() - l0) / m if n >= 2 * m else 0.0
        b0 = 1 + b0 / l0 if exponential else b0
        s0 = (y[:m] / l0 if mult else y[:m] - l0).tolist()
        start = m
    else:
        l0, start = y[0], 2 if trend else 1
        b0 = (y[1] / y[0] if exponential else y[1] - y[0]) if trend and n > 1 else 0.0
        l0 = y[1] if trend and n > 1 else l0
        s0 = []
    weights = [("alpha", alpha), *([("beta", beta)] if trend else []), *([("gamma", gamma)] if seasonal else [])]
    free = [k for k, v in weights if v is None]
    given = {k: v for k, v in weights if v is not None}
    series = y.tolist()

    def run(p, keep=False):
        a, b_, g = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0)
        l, b, s, sse, out = l0, b0, list(s0), 0.0, []
        for i in range(start, n):
            q = (l * b if exponential else l + b) if trend else l
            sm = s[i % m] if seasonal else None
            f = q if not seasonal else q * sm if mult else q + sm
            r = series[i] - f
            sse += r * r
            p_ = series[i] if not seasonal else series[i] / sm if mult else series[i] - sm
            new = a * p_ + (1 - a) * q
            if trend:
                b = b_ * (new / l if exponential else new - l) + (1 - b_) * b
            if seasonal:
                s[i % m] = g * (series[i] / q if mult else series[i] - q) + (1 - g) * sm
            l = new
            if keep:
                out.append((f, r))
        return (sse, l, b, s, out)

    def objective(x):
        if any(v < 0 or v > 1 for v in x):
            return 1e30
        return run(given | dict(zip(free, x, strict=True)))[0]

    begin = {"alpha": 0.3, "beta": 0.1, "gamma": 0.1}
    best = nelder_mead(objective, [begin[k] for k in free], maxit=1000).x if free else []
    p = given | dict(zip(free, np.asarray(best).tolist(), strict=True))
    sse, l, b, s, out = run(p, True)
    fitted = np.r_[np.full(start, np.nan), [f for f, _ in out]]
    res = np.r_[np.full(start, np.nan), [r for _, r in out]]
    sigma2 = sse / max(len(out) - len(free), 1)
    last = [s[(n + i) % m] for i in range(m)] if seasonal else []
    st = {"l": l, "b": b, "s": last, "e": "A", "t": ("M" if exponential else "A") if trend else "N", "d": False, "season": "N" if not seasonal else "M" if mult else "A", "m": m, "p": p}
    # the weights of the state-space form
    st["p"] = {"alpha": p["alpha"], "beta": p["alpha"] * p.get("beta", 0.0), "gamma": p.get("gamma", 0.0) * (1 - p["alpha"])}
    fit = Fit("conventional", dict(p), fitted, res, sigma2, state=st)
    fit.forecaster = lambda h, levels: _forecast(fit, h, levels)
    return fit


def ets(y, m: int = 1, model: str = "ZZZ", *, damped: bool | None = None, ic: str = "aicc", allow_multiplicative_trend: bool = False, restrict: bool = True, additive_only: bool = False, lam=None, biasadj: bool = False, **fixed) -> Fit:
    """The member of the family with the least criterion; Z leaves a component to the search.

    Of a series with gaps the longest run of present values is used; forecasts begin behind the whole series.
    """
    if not np.isfinite(clean(y)).all():
        rest = dict(damped=damped, ic=ic, allow_multiplicative_trend=allow_multiplicative_trend, restrict=restrict, additive_only=additive_only, lam=lam, biasadj=biasadj)
        return on_longest_run(clean(y), lambda run: ets(run, m, model, **rest, **fixed))
    if len(model) != 3 or any(c not in "ANMZ" for c in model) or model[0] == "N":
        raise ValueError(f"unknown model {model!r}")
    if lam is not None:
        additive_only = True
        return _transformed(y, m, lam, biasadj, lambda z: ets(z, m, model, damped=damped, ic=ic, restrict=restrict, additive_only=True, **fixed))
    y = clean(y)
    n = len(y)
    m = m if isinstance(m, int) else int(m[0])
    if y.min() == y.max() and model == "ZZZ":
        return fit_ets(y, 1, "A", "N", "N", False, fixed={"alpha": 0.99999})
    positive = y.min() > 0
    errors = [model[0]] if model[0] != "Z" else ["A"] + (["M"] if positive and not additive_only else [])
    trends = [model[1]] if model[1] != "Z" else ["N", "A"] + (["M"] if allow_multiplicative_trend and positive and not additive_only else [])
    if m <= 1 or m > MAX_PERIOD or n <= m:
        if model[2] in "AM" and m > MAX_PERIOD:
            raise ValueError(f"the period is above {MAX_PERIOD}")
        seasons = ["N"]
    else:
        seasons = [model[2]] if model[2] != "Z" else ["N", "A"] + (["M"] if positive and not additive_only else [])
    best = None
    for e in errors:
        for t in trends:
            for s in seasons:
                for d in ([damped] if damped is not None else [False, True]):
                    if d and t == "N":
                        continue
                    if restrict and ((e == "A" and (t == "M" or s == "M")) or (e == "M" and t == "M" and s == "A") or (additive_only and "M" in e + t + s)):
                        continue
                    count = 2 + (2 if t != "N" else 0) + (m if s != "N" else 0) + d
                    if n <= count + 4:
                        continue
                    try:
                        f = fit_ets(y, m, e, t, s, bool(d), fixed=fixed)
                    except ValueError:
                        continue
                    if best is None or getattr(f, ic) < getattr(best, ic):
                        best = f
    if best is None:
        if n > m + 3 and m > 1 and "N" not in model[2]:
            return holt_winters(y, m, initial="simple")
        return holt(y, initial="simple") if n > 3 and model[1] != "N" else ses(y, initial="simple") if n > 1 else _constant(y)
    return best


def _constant(y: np.ndarray) -> Fit:
    fit = Fit("constant", {"level": float(y[-1])}, y.copy(), np.zeros(len(y)), 0.0)
    fit.forecaster = lambda h, levels: normal_bands(np.full(h, float(y[-1])), np.zeros(h), levels)
    return fit
