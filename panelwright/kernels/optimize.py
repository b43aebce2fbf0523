"""Minimisers for the models, in NumPy and plain Python."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

PENALTY = 1e35


@dataclass
class Minimum:
    """``fail`` is 0 on convergence, 1 when the iterations ran out."""

    x: np.ndarray
    value: float
    evaluations: int
    fail: int


def _safe(f: Callable) -> Callable:
    def g(x):
        v = f(x)
        return v if math.isfinite(v) else PENALTY

    return g


def nelder_mead(f: Callable, x0, *, maxit: int = 500, reltol: float = 1.4901161193847656e-08) -> Minimum:
    """Simplex search with reflection 1, contraction 1/2 and expansion 2."""
    f = _safe(f)
    x0 = np.asarray(x0, dtype=float)
    n = len(x0)
    step = 0.1 * (np.abs(x0).max() if n else 0.0) or 0.1
    points = [x0.tolist()] + [[v + (step if i == j else 0.0) for j, v in enumerate(x0.tolist())] for i in range(n)]
    simplex = [(f(p), k, p) for k, p in enumerate(points)]
    used, count = n + 1, n + 1
    tol = reltol * (abs(simplex[0][0]) + reltol)
    fail = 1
    while used < maxit:
        simplex.sort(key=lambda s: (s[0], s[1]))
        low, high = simplex[0][0], simplex[-1][0]
        if high <= low + tol:
            fail = 0
            break
        worst = simplex[-1][2]
        centre = [sum(s[2][j] for s in simplex[:-1]) / n for j in range(n)]
        point = [2 * c - w for c, w in zip(centre, worst, strict=True)]
        v = f(point)
        used += 1
        if v < low:
            far = [2 * p - c for p, c in zip(point, centre, strict=True)]
            vf = f(far)
            used += 1
            if vf < v:
                point, v = far, vf
            simplex[-1] = (v, count, point)
        elif v < simplex[-2][0]:
            simplex[-1] = (v, count, point)
        else:
            if v < high:
                simplex[-1] = (v, count, point)
                worst, high = point, v
            near = [(w + c) / 2 for w, c in zip(worst, centre, strict=True)]
            vn = f(near)
            used += 1
            if vn < high:
                simplex[-1] = (vn, count, near)
            else:
                best = simplex[0][2]
                for k in range(1, n + 1):
                    p = [(a + b) / 2 for a, b in zip(simplex[k][2], best, strict=True)]
                    count += 1
                    simplex[k] = (f(p), count, p)
                used += n
        count += 1
    simplex.sort(key=lambda s: (s[0], s[1]))
    return Minimum(np.array(simplex[0][2]), simplex[0][0], used, fail)


def nelder_mead_many(f: Callable, x0: np.ndarray, *, maxit: int = 500, reltol: float = 1.4901161193847656e-08) -> np.ndarray:
    """``nelder_mead`` from every row of ``x0`` at once, the best points: each row takes the very steps of a search of its own.

    ``f(points, rows)`` gives the values of points that belong to these rows of ``x0``.
    """
    x0 = np.asarray(x0, dtype=float)
    b, n = x0.shape
    safe = lambda p, at: np.where(np.isfinite(v := f(p, at)), v, PENALTY)
    rows, out = np.arange(b), x0.copy()
    step = 0.1 * np.abs(x0).max(axis=1)
    stepped = step != 0
    step[~stepped] = 0.1
    points = np.repeat(x0[:, None, :], n + 1, axis=1)
    # the single search's steps are numbers of NumPy, which Python's sum adds plainly; ``plain`` marks them and what came of them
    plain = np.zeros(points.shape, dtype=bool)
    for j in range(n):
        points[:, j + 1, j] += step
        plain[:, j + 1, j] = stepped
    values = np.column_stack([safe(points[:, j], rows) for j in range(n + 1)])
    used = np.full(b, n + 1)
    tol = reltol * (np.abs(values[:, 0]) + reltol)
    while True:
        # new points stand last, so a stable order puts them behind older ones of the same value
        order = np.argsort(values, axis=1, kind="stable")
        at = np.arange(len(rows))[:, None]
        values, points, plain = values[at, order], points[at, order], plain[at, order]
        going = (values[:, -1] > values[:, 0] + tol) & (used < maxit)
        if not going.all():
            out[rows[~going]] = points[~going, 0]
            rows, values, points, plain, used, tol = (v[going] for v in (rows, values, points, plain, used, tol))
        if not len(rows):
            return out
        low, second, high, worst = values[:, 0], values[:, -2], values[:, -1].copy(), points[:, -1].copy()
        centre = _sums(points[:, :-1], plain[:, :-1]) / n
        point = 2 * centre - worst
        v = safe(point, rows)
        used += 1
        grow = np.flatnonzero(v < low)
        if len(grow):
            far = 2 * point[grow] - centre[grow]
            vf = safe(far, rows[grow])
            used[grow] += 1
            further = vf < v[grow]
            point[grow[further]], v[grow[further]] = far[further], vf[further]
        better = v < high
        values[better, -1], points[better, -1] = v[better], point[better]
        mixed = plain.any(axis=1)
        plain[better, -1] = mixed[better]
        near_at = np.flatnonzero(~(v < second))
        if len(near_at):
            near = (points[near_at, -1] + centre[near_at]) / 2
            vn = safe(near, rows[near_at])
            used[near_at] += 1
            closer = vn < values[near_at, -1]
            at = near_at[closer]
            values[at, -1], points[at, -1], plain[at, -1] = vn[closer], near[closer], mixed[at]
            at = near_at[~closer]
            if len(at):
                for k in range(1, n + 1):
                    p = (points[at, k] + points[at, 0]) / 2
                    values[at, k], points[at, k] = safe(p, rows[at]), p
                    plain[at, k] |= plain[at, 0]
                used[at] += n


def _sums(x: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Sums over the second axis as Python's ``sum`` adds floats: rounding errors are carried along up to the first plain number."""
    total, lost, carried = x[:, 0].copy(), np.zeros_like(x[:, 0]), ~plain[:, 0]
    for k in range(1, x.shape[1]):
        v = x[:, k]
        ends = carried & plain[:, k]
        total = np.where(ends & np.isfinite(lost), total + lost, total)
        carried = carried & ~ends
        t = total + v
        lost = np.where(carried, lost + np.where(np.abs(total) >= np.abs(v), (total - t) + v, (v - t) + total), lost)
        total = t
    return np.where(carried & np.isfinite(lost), total + lost, total)


def brent(f: Callable, a: float, b: float, *, tol: float = 1.5e-8, maxit: int = 500) -> Minimum:
    """Golden sections and parabolas on an interval."""
    golden = (3 - math.sqrt(5)) / 2
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    d = e = 0.0
    used = 1
    for _ in range(maxit):
        mid = (a + b) / 2
        t1 = 1.4901161193847656e-08 * abs(x) + tol / 3
        if abs(x - mid) <= 2 * t1 - (b - a) / 2:
            return Minimum(np.array([x]), fx, used, 0)
        p = q = r = 0.0
        if abs(e) > t1:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p = -p if q > 0 else p
            q = abs(q)
            r, e = e, d
        if abs(p) >= abs(0.5 * q * r) or p <= q * (a - x) or p >= q * (b - x):
            e = (b if x < mid else a) - x
            d = golden * e
        else:
            d = p / q
            u = x + d
            if u - a < 2 * t1 or b - u < 2 * t1:
                d = t1 if x < mid else -t1
        u = x + (d if abs(d) >= t1 else math.copysign(t1, d))
        fu = f(u)
        used += 1
        if fu <= fx:
            a, b = (a, x) if u < x else (x, b)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return Minimum(np.array([x]), fx, used, 1)


def itp(f: Callable, a: float, b: float, *, tol: float = 1e-8, maxit: int = 200) -> Minimum:
    """Minimise a unimodal function by interpolate-truncate-project steps on its numerical slope."""
    h = 1e-6 * max(1.0, abs(a), abs(b))
    slope = lambda x: (f(min(x + h, b)) - f(max(x - h, a)))
    sa, sb = slope(a), slope(b)
    used = 4
    if sa >= 0 or sb <= 0:
        x = a if sa >= 0 else b
        return Minimum(np.array([x]), f(x), used + 1, 0)
    lo, hi = a, b
    k1 = 0.2 / (b - a)
    half = math.ceil(math.log2((b - a) / (2 * tol)))
    for j in range(maxit):
        if hi - lo <= 2 * tol:
            break
        mid = (lo + hi) / 2
        r = tol * 2.0 ** (half + 1 - j) - (hi - lo) / 2
        delta = k1 * (hi - lo) ** 2
        falsi = (sb * lo - sa * hi) / (sb - sa)
        side = math.copysign(1, mid - falsi)
        xt = falsi + side * delta if delta <= abs(mid - falsi) else mid
        x = xt if abs(xt - mid) <= r else mid - side * r
        x = min(max(x, lo), hi)
        s = slope(x)
        used += 2
        if s > 0:
            hi, sb = x, s
        elif s < 0:
            lo, sa = x, s
        else:
            lo = hi = x
    x = (lo + hi) / 2
    return Minimum(np.array([x]), f(x), used + 1, 0)


def gradient(f: Callable, x: np.ndarray, step: float = 1e-3) -> np.ndarray:
    """Central differences."""
    out = np.empty(len(x))
    for i in range(len(x)):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out


def bfgs(f: Callable, x0, *, maxit: int = 100, reltol: float = 1e-8, step: float = 1e-3) -> Minimum:
    """Quasi-Newton with a backtracking line search and numerical gradients."""
    f = _safe(f)
    x = np.asarray(x0, dtype=float).copy()
    n = len(x)
    value, used = f(x), 1
    if n == 0:
        return Minimum(x, value, used, 0)
    g = gradient(f, x, step)
    used += 2 * n
    inverse = np.eye(n)
    for _ in range(maxit):
        direction = -inverse @ g
        slope = float(g @ direction)
        if slope >= 0:
            inverse, direction = np.eye(n), -g
            slope = float(g @ direction)
            if slope >= 0:
                return Minimum(x, value, used, 0)
        length, found = 1.0, False
        for _ in range(40):
            new = x + length * direction
            fresh = f(new)
            used += 1
            if fresh <= value + 1e-4 * length * slope and fresh < PENALTY:
                found = True
                break
            length *= 0.2
        if not found or abs(value - fresh) <= reltol * (abs(value) + reltol):
            if found and fresh < value:
                x, value = new, fresh
            return Minimum(x, value, used, 0)
        ng = gradient(f, new, step)
        used += 2 * n
        s, y = new - x, ng - g
        sy = float(s @ y)
        if sy > 1e-12:
            rho = 1 / sy
            left = np.eye(n) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        x, g, value = new, ng, fresh
    return Minimum(x, value, used, 1)


def lbfgsb(f: Callable, x0, lower, upper, *, maxit: int = 200, reltol: float = 1e-8, step: float = 1e-5, memory: int = 6) -> Minimum:
    """Projected quasi-Newton within bounds: two-loop recursion on the free variables, projected backtracking."""
    f = _safe(f)
    lo, hi = np.asarray(lower, dtype=float), np.asarray(upper, dtype=float)
    x = np.clip(np.asarray(x0, dtype=float), lo, hi)
    n = len(x)

    def grad(x):
        out = np.empty(n)
        for i in range(n):
            h = step * max(1.0, abs(x[i]))
            up, down = x.copy(), x.copy()
            up[i], down[i] = min(x[i] + h, hi[i]), max(x[i] - h, lo[i])
            width = up[i] - down[i]
            out[i] = (f(up) - f(down)) / width if width > 0 else 0.0
        return out

    value, used = f(x), 1
    g = grad(x)
    used += 2 * n
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(maxit):
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if not free.any() or np.abs(np.where(free, g, 0)).max() < 1e-8:
            return Minimum(x, value, used, 0)
        q = np.where(free, g, 0.0)
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        direction = np.where(free, -q, 0.0)
        if direction @ g >= 0:
            direction, pairs = np.where(free, -g, 0.0), []
        length, found = 1.0 if pairs else min(1.0, 1 / np.abs(g[free]).sum()), False
        for _ in range(40):
            new = np.clip(x + length * direction, lo, hi)
            fresh = f(new)
            used += 1
            if fresh <= value + 1e-4 * float(g @ (new - x)) and fresh < value:
                found = True
                break
            length *= 0.3
        if not found:
            return Minimum(x, value, used, 0)
        ng = grad(new)
        used += 2 * n
        s, y = new - x, ng - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - fresh) <= reltol * (abs(value) + reltol)
        x, g, value = new, ng, fresh
        if done:
            return Minimum(x, value, used, 0)
    return Minimum(x, value, used, 1)


def hessian(f: Callable, x, step: float = 1e-3) -> np.ndarray:
    """Numerical second derivatives, symmetric."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    out = np.empty((n, n))
    for i in range(n):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (gradient(f, up, step) - gradient(f, down, step)) / (2 * step)
    return (out + out.T) / 2


def optimize(f: Callable, x0, method: str = "nelder_mead", lower=None, upper=None, scale=None, want_hessian: bool = False, **options):
    """One door to all methods.  Finite bounds ask for ``lbfgsb``; ``scale`` divides the parameters."""
    x0 = np.asarray(x0, dtype=float)
    s = np.ones(len(x0)) if scale is None else np.asarray(scale, dtype=float)
    g = lambda z: f(z * s)
    bounded = any(b is not None and np.isfinite(np.asarray(b, dtype=float)).any() for b in (lower, upper))
    if method in ("brent", "itp"):
        out = {"brent": brent, "itp": itp}[method](lambda v: g(np.array([v])), float(lower) / s[0], float(upper) / s[0], **options)
    elif method == "lbfgsb" or bounded:
        lo = np.full(len(x0), -np.inf) if lower is None else np.broadcast_to(np.asarray(lower, dtype=float), x0.shape)
        hi = np.full(len(x0), np.inf) if upper is None else np.broadcast_to(np.asarray(upper, dtype=float), x0.shape)
        out = lbfgsb(g, x0 / s, lo / s, hi / s, **options)
    elif method == "bfgs":
        out = bfgs(g, x0 / s, **options)
    elif method == "nelder_mead":
        out = nelder_mead(g, x0 / s, **options)
    else:
        raise ValueError(f"unknown method {method!r}")
    out.x = out.x * s
    return (out, hessian(f, out.x)) if want_hessian else out
