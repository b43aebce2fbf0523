"""BATS and TBATS: Box-Cox, (damped) trend, several seasons and ARMA errors in one innovations model.

x_t = F x_{t-1} + g e_t and y_t = w' x_{t-1} + e_t.  For given weights the errors are linear in the first state, so that
state is found by least squares; the weights are found by Nelder-Mead within the admissible region.
"""

from __future__ import annotations

import math

import numpy as np

from panelwright.kernels.arima import auto_arima
from panelwright.kernels.common import Fit, Forecast, box_cox, box_cox_lambda, clean, inv_box_cox, normal_bands
from panelwright.kernels.optimize import nelder_mead
from panelwright.kernels.stats import fill_linear


def _periods(m) -> list[float]:
    return sorted({float(v) for v in np.atleast_1d(m) if float(v) > 1})


class _Shape:
    """Matrices of one structure; ``blocks`` holds (kind, period, harmonics)."""

    def __init__(self, blocks, trend: bool, damped: bool, p: int, q: int):
        self.blocks, self.trend, self.damped, self.p, self.q = blocks, trend, damped, p, q
        self.sizes = [int(b[1]) if b[0] == "season" else 2 * b[2] for b in blocks]
        self.n_state = 1 + trend + sum(self.sizes) + p + q
        self.n_seed = self.n_state - p - q
        weights = ["alpha"] + (["beta"] if trend else []) + (["phi"] if damped else [])
        for i, b in enumerate(blocks):
            weights += [f"gamma{i}"] if b[0] == "season" else [f"gamma{i}_1", f"gamma{i}_2"]
        self.names = weights + [f"ar{i}" for i in range(p)] + [f"ma{i}" for i in range(q)]

    def matrices(self, v):
        par = dict(zip(self.names, v, strict=True))
        n = self.n_state
        F, g, w = np.zeros((n, n)), np.zeros(n), np.zeros(n)
        phi = par.get("phi", 1.0)
        F[0, 0] = w[0] = 1
        g[0] = par["alpha"]
        at = 1
        if self.trend:
            F[0, 1] = F[1, 1] = w[1] = phi
            g[1] = par["beta"]
            at = 2
        for i, (b, size) in enumerate(zip(self.blocks, self.sizes, strict=True)):
            if b[0] == "season":
                F[at, at + size - 1] = 1
                F[np.arange(at + 1, at + size), np.arange(at, at + size - 1)] = 1
                w[at + size - 1] = 1
                g[at] = par[f"gamma{i}"]
            else:
                k = b[2]
                lam = 2 * np.pi * np.arange(1, k + 1) / b[1]
                c, s = np.cos(lam), np.sin(lam)
                j = np.arange(k)
                F[at + j, at + j] = c
                F[at + j, at + k + j] = s
                F[at + k + j, at + j] = -s
                F[at + k + j, at + k + j] = c
                w[at : at + k] = 1
                g[at : at + k], g[at + k : at + 2 * k] = par[f"gamma{i}_1"], par[f"gamma{i}_2"]
            at += size
        if self.p or self.q:
            arma = np.zeros(n)
            arma[at : at + self.p] = [par[f"ar{i}"] for i in range(self.p)]
            arma[at + self.p : at + self.p + self.q] = [par[f"ma{i}"] for i in range(self.q)]
            # the error of the structural part is the ARMA process: its forecast enters every equation through g
            F = F + np.outer(g, arma)
            w = w + arma
            if self.p:
                F[at] = arma
                F[np.arange(at + 1, at + self.p), np.arange(at, at + self.p - 1)] = 1
                g[at] = 1
            if self.q:
                k = at + self.p
                F[k] = 0
                F[np.arange(k + 1, k + self.q), np.arange(k, k + self.q - 1)] = 1
                g[k] = 1
        return F, g, w

    def start(self):
        many = sum(b[1] for b in self.blocks) > 16
        first = {"alpha": 1e-6 if many else 0.09, "beta": 5e-7 if many else 0.05, "phi": 0.999}
        return [first.get(k, 0.001 if k.startswith("gamma") and self.blocks[int(k[5:].split("_")[0])][0] == "season" else 0.0) for k in self.names]


def _run(z: np.ndarray, F, g, w, x0):
    x, e, f = x0.copy(), np.empty(len(z)), np.empty(len(z))
    for t in range(len(z)):
        f[t] = w @ x
        e[t] = z[t] - f[t]
        x = F @ x + g * e[t]
        if not abs(e[t]) < 1e150:
            return None
    return e, f, x


def _seed(z: np.ndarray, F, g, w, n_seed: int):
    """First state by least squares of the errors that a zero state leaves."""
    n = len(z)
    D = F - np.outer(g, w)
    row, rows = w.copy(), np.empty((n, len(w)))
    x, e = np.zeros(len(w)), np.empty(n)
    for t in range(n):
        rows[t] = row
        row = row @ D
        e[t] = z[t] - w @ x
        x = F @ x + g * e[t]
    if not np.isfinite(e).all() or not np.isfinite(rows).all() or max(np.abs(e).max(), np.abs(rows).max()) > 1e100:
        return None
    x0 = np.zeros(len(w))
    x0[:n_seed] = np.linalg.lstsq(rows[:, :n_seed], e, rcond=None)[0]
    return x0, e - rows @ x0, D


def _fit(y: np.ndarray, shape: _Shape, lam: float | None) -> dict:
    n = len(y)
    scale_log = float(np.log(y).sum()) if lam is not None else 0.0
    z = y if lam is None else box_cox(y, lam)

    def evaluate(v):
        par = dict(zip(shape.names, v, strict=True))
        if not 0 <= par["alpha"] <= 2 or not 0 <= par.get("beta", 0.0) <= 2 or not 0.8 <= par.get("phi", 1.0) <= 1:
            return 1e20, None
        for k, sign in (("ar", -1), ("ma", 1)):
            c = [par[f"{k}{i}"] for i in range(getattr(shape, "p" if k == "ar" else "q"))]
            c = np.trim_zeros(np.r_[1.0, sign * np.asarray(c)], "b")
            if len(c) > 1 and np.abs(np.roots(c[::-1])).min() < 1.01:
                return 1e20, None
        F, g, w = shape.matrices(v)
        got = _seed(z, F, g, w, shape.n_seed)
        if got is None:
            return 1e20, None
        x0, e, D = got
        if np.abs(np.linalg.eigvals(D)).max() >= 1.01:
            return 1e20, None
        value = n * math.log(max(float(e @ e), 1e-300))
        if lam is not None:
            value -= 2 * (lam - 1) * scale_log
        return value, (F, g, w, x0)

    start = shape.start()
    units = [0.01 if k == "alpha" or k.startswith("phi") else 0.01 if k == "beta" else 0.001 if k.startswith("gamma") else 0.1 for k in shape.names]
    k = len(start)
    best = nelder_mead(lambda u: evaluate([a * b for a, b in zip(u, units, strict=True)])[0], [a / b for a, b in zip(start, units, strict=True)], maxit=min(100 * k * k, 600))
    v = (best.x * np.array(units)).tolist()
    value, got = evaluate(v)
    if got is None:
        v = start
        value, got = evaluate(v)
        if got is None:
            raise ValueError("no admissible parameters")
    F, g, w, x0 = got
    run = _run(z, F, g, w, x0)
    if run is None:
        raise ValueError("the recursion diverges")
    e, f, x = run
    return {"value": value, "aic": value + 2 * (k + (lam is not None) + shape.n_seed), "v": v, "shape": shape, "lam": lam, "F": F, "g": g, "w": w, "x": x, "e": e, "f": f, "sigma2": float(e @ e) / n}


def _search(y, blocks, *, use_box_cox, use_trend, use_damped, use_arma, lower, upper, periods) -> dict:
    lams = [None]
    positive = y.min() > 0
    if use_box_cox is not False and positive:
        lam = box_cox_lambda(y, int(periods[0]) if periods else 1, lower=lower, upper=upper)
        lams = [lam] if use_box_cox else [None, lam]
    trends = [use_trend] if use_trend is not None else [False, True]
    best = None
    for lam in lams:
        for trend in trends:
            for damped in ([False] if not trend else [use_damped] if use_damped is not None else [False, True]):
                try:
                    got = _fit(y, _Shape(blocks, trend, damped, 0, 0), lam)
                except (ValueError, np.linalg.LinAlgError):
                    continue
                if best is None or got["aic"] < best["aic"]:
                    best = got
    if best is None:
        raise ValueError("no model could be fitted")
    if use_arma:
        order = auto_arima(best["e"], 1, d=0, allow_mean=False).state.get("order", (0, 0, 0))
        if order[0] or order[2]:
            s = best["shape"]
            try:
                got = _fit(y, _Shape(blocks, s.trend, s.damped, order[0], order[2]), best["lam"])
                best = got if got["aic"] < best["aic"] else best
            except (ValueError, np.linalg.LinAlgError):
                pass
    return best


def _finish(y, got, label: str, biasadj: bool) -> Fit:
    lam, shape = got["lam"], got["shape"]
    back = (lambda v, s2=None: v) if lam is None else (lambda v, s2=None: inv_box_cox(v, lam, s2 if biasadj else None))
    fit = Fit(label, dict(zip(shape.names, map(float, got["v"]), strict=True)) | ({"lambda": lam} if lam is not None else {}), back(got["f"]), got["e"], got["sigma2"], got["aic"])

    def forecaster(h, levels):
        x, mean, c = got["x"], np.empty(h), np.empty(h)
        F, g, w = got["F"], got["g"], got["w"]
        c[0], power = 1.0, g.copy()
        for i in range(h):
            mean[i] = w @ x
            x = F @ x
            if i + 1 < h:
                c[i + 1] = w @ power
                power = F @ power
        variance = got["sigma2"] * np.cumsum(c**2)
        fc = normal_bands(mean, np.sqrt(variance), levels)
        return Forecast(back(mean, variance), {k: back(v) for k, v in fc.lower.items()}, {k: back(v) for k, v in fc.upper.items()})

    fit.forecaster = forecaster
    return fit


def _prepare(y, m):
    y = clean(y)
    y = y if np.isfinite(y).all() else fill_linear(y)
    return y, [p for p in _periods(m) if 2 * p <= len(y)]


def _flat(y) -> Fit | None:
    if y.min() < y.max():
        return None
    v = float(y[0])
    fit = Fit("constant", {"level": v}, y.copy(), np.zeros(len(y)), 0.0)
    fit.forecaster = lambda h, levels: normal_bands(np.full(h, v), np.zeros(h), levels)
    return fit


def bats(y, m=1, *, use_box_cox: bool | None = None, use_trend: bool | None = None, use_damped: bool | None = None, use_arma: bool = True, lower: float = 0.0, upper: float = 1.0, biasadj: bool = False) -> Fit:
    """Seasons of whole periods."""
    y, periods = _prepare(y, m)
    if (flat := _flat(y)) is not None:
        return flat
    blocks = [("season", int(round(p)), 0) for p in periods]
    common = dict(use_box_cox=use_box_cox, use_trend=use_trend, use_damped=use_damped, use_arma=use_arma, lower=lower, upper=upper, periods=periods)
    got = _search(y, blocks, **common)
    return _finish(y, got, _label("BATS", got, periods), biasadj)


def _label(name: str, got: dict, periods) -> str:
    s = got["shape"]
    lam = 1 if got["lam"] is None else round(got["lam"], 3)
    damp = round(dict(zip(s.names, got["v"], strict=True)).get("phi", 1.0), 3) if s.trend else "-"
    seasons = ", ".join(f"<{b[1]:g},{b[2]}>" if b[0] == "trig" else f"{b[1]:g}" for b in s.blocks) or "-"
    return f"{name}({lam}, {{{s.p},{s.q}}}, {damp}, {{{seasons}}})"


def tbats(y, m=1, *, k=None, use_box_cox: bool | None = None, use_trend: bool | None = None, use_damped: bool | None = None, use_arma: bool = True, lower: float = 0.0, upper: float = 1.0, biasadj: bool = False) -> Fit:
    """Trigonometric seasons, whose periods needn't be whole.  Harmonics are stepped per period while the criterion falls;
    the model without a season competes."""
    y, periods = _prepare(y, m)
    if (flat := _flat(y)) is not None:
        return flat
    common = dict(use_box_cox=use_box_cox, use_trend=use_trend, use_damped=use_damped, use_arma=use_arma, lower=lower, upper=upper, periods=periods)
    plain = _search(y, [], **common)
    if not periods:
        return _finish(y, plain, _label("TBATS", plain, periods), biasadj)
    top = [max(1, int((p - 1) // 2)) for p in periods]
    if k is not None:
        ks = [min(int(v), t) for v, t in zip(np.broadcast_to(np.atleast_1d(k), (len(periods),)), top, strict=True)]
    else:
        ks = [1] * len(periods)
        shape = plain["shape"]

        def score(counts):
            try:
                return _fit(y, _Shape([("trig", p, c) for p, c in zip(periods, counts, strict=True)], shape.trend, shape.damped, 0, 0), plain["lam"])["aic"]
            except (ValueError, np.linalg.LinAlgError):
                return math.inf

        for i, t in enumerate(top):
            at = t if t <= 6 else 6
            trial = lambda c: score([*ks[:i], c, *ks[i + 1 :]])  # noqa: B023, E731
            here = trial(at)
            step = -1
            if t > 6 and trial(7) < here:
                step = 1
            while 1 <= at + step <= t:
                new = trial(at + step)
                if new >= here:
                    break
                at, here = at + step, new
            ks[i] = at
    got = _search(y, [("trig", p, c) for p, c in zip(periods, ks, strict=True)], **common)
    got = plain if plain["aic"] < got["aic"] else got
    return _finish(y, got, _label("TBATS", got, periods), biasadj)
