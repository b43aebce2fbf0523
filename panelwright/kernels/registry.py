"""Kernels by name, and the grouped function that fits one series with one spec."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _arima(y, m, x, o):
    from panelwright.kernels import arima as k

    o = dict(o)
    fixed = o.pop("fixed", None)
    if fixed is None:
        return k.auto_arima(y, m, xreg=x, **o)
    p, q, P, Q = fixed
    d, D = o.pop("d", None), o.pop("D", None)
    from panelwright.kernels.stats import ndiffs, nsdiffs

    clean = np.asarray(y, dtype=float)
    if D is None:
        D = nsdiffs(clean, m) if m > 1 else 0
    if d is None:
        z = clean[m:] - clean[:-m] if D else clean
        d = ndiffs(z)
    if m <= 1:
        P = D = Q = 0
    keep = {k_: v for k_, v in o.items() if k_ in ("lam", "biasadj", "method", "include_mean", "include_drift")}
    return k.arima(y, m, (p, d, q), (P, D, Q), xreg=x, **keep)


def _call(module: str, name: str):
    def run(y, m, x, o):
        import importlib

        return getattr(importlib.import_module(f"panelwright.kernels.{module}"), name)(y, m, **o)

    return run


def _several(module: str, name: str):
    """A kernel that takes all periods; its spec carries them as ``periods``."""

    def run(y, m, x, o):
        import importlib

        o = dict(o)
        return getattr(importlib.import_module(f"panelwright.kernels.{module}"), name)(y, o.pop("periods", m), **o)

    return run


def _croston(y, m, x, o):
    from panelwright.kernels import croston as k

    o = dict(o)
    kind = o.pop("kind", "hyndman")
    return k.croston_hyndman(y, m, **o) if kind == "hyndman" else k.croston(y, m, kind=kind, **o)


KERNELS = {
    "arima": _arima,
    "ets": _call("ets", "ets"),
    "ses": _call("ets", "ses"),
    "holt": _call("ets", "holt"),
    "holt_winters": _call("ets", "holt_winters"),
    "arar": _call("arar", "arar"),
    "theta": _call("theta", "auto_theta"),
    "croston": _croston,
    "ararma": _call("ararma", "auto_ararma"),
    "diffusion": _call("diffusion", "diffusion"),
    "bats": _several("tbats", "bats"),
    "tbats": _several("tbats", "tbats"),
    "kw_filter": _call("kw", "kw_forecast"),
}
#: Kernels that cope with missing values themselves: ARIMA filters over them, ETS takes the longest run of present values, and
#: for Croston a missing value is a period without demand.  The others fail unless the option ``missing`` says otherwise:
#: "contiguous" (the longest run, forecasts begin behind the whole series), "interpolate", or "fail".
TOLERANT = {"arima", "ets", "croston"}


def _with_gaps(how: str, y: np.ndarray, m: int, x, run):
    """Fit a series with missing values by one of the strategies; ``run`` fits a whole one."""
    from panelwright.kernels.common import on_longest_run
    from panelwright.kernels.stats import interpolate_missing

    if how == "interpolate":
        return run(interpolate_missing(y, m))
    if how == "contiguous":
        if x is not None:
            raise ValueError("a run of the target can't be fitted with regressors")
        return on_longest_run(y, run)
    if how == "fail":
        raise ValueError("missing values in the target")
    raise ValueError(f"unknown strategy {how!r} for missing values")


def period(m) -> int:
    if isinstance(m, (list, tuple)):
        m = m[0] if m else 1
    return int(m or 1)


def fit_one(spec: dict, y: np.ndarray, m: int, x=None):
    if len(y) == 0:
        raise ValueError("an empty series")
    options = dict(spec["options"])
    how = options.pop("missing", None if spec["kernel"] in TOLERANT else "fail")
    if how is not None and not np.isfinite(y).all():
        return _with_gaps(how, y, m, x, lambda whole: fit_one(spec | {"options": options}, whole, m, x))
    if spec["kernel"] in ("bats", "tbats") and "periods" not in options:
        options["periods"] = spec["m"] if isinstance(spec["m"], (list, tuple)) else [m]
    return KERNELS[spec["kernel"]](y, m, x, options)


def _series(frame: pd.DataFrame, spec: dict):
    frame = frame.sort_values("_ord", kind="stable")
    y = frame["_y"].to_numpy(dtype=float)
    x = np.column_stack([frame[f"_x{i}"].to_numpy(dtype=float) for i in spec["columns"]]) if spec["columns"] else None
    if x is not None and not np.isfinite(x).all():
        raise ValueError("missing values in a regressor")
    return y, x


def _keys(frame: pd.DataFrame, keys: list[str], n: int) -> dict:
    return {k: [frame[k].iloc[0]] * n for k in keys}


def forecast_group(frame: pd.DataFrame, specs: list[dict], keys: list[str], h: int, levels: list, labels: list, fail_fast: bool, future: pd.DataFrame | None = None) -> pd.DataFrame:
    """Forecast rows of one (series, spec); a failure is one row with its message."""
    spec = specs[int(frame["_spec"].iloc[0])]
    columns = [*keys, "model_name", "step", "mean", *[f"{side}_{b}" for b in labels for side in ("lower", "upper")], "method", "status", "error"]
    try:
        y, x = _series(frame, spec)
        with np.errstate(all="ignore"):
            fit = fit_one(spec, y, period(spec["m"]), x)
            if spec["columns"]:
                new = _future(frame, future, spec, h)
                fc = fit.forecaster(h, levels, new)
            else:
                fc = fit.forecast(h, levels)
        out = _keys(frame, keys, h) | {"model_name": [spec["name"]] * h, "step": list(range(1, h + 1)), "mean": fc.mean}
        for lv, b in zip(levels, labels, strict=True):
            out[f"lower_{b}"] = fc.lower[lv] if lv in fc.lower else [None] * h
            out[f"upper_{b}"] = fc.upper[lv] if lv in fc.upper else [None] * h
        out |= {"method": [fit.method] * h, "status": ["ok"] * h, "error": [None] * h}
        return pd.DataFrame(out, columns=columns)
    except Exception as e:
        if fail_fast:
            raise
        row = _keys(frame, keys, 1) | {"model_name": [spec["name"]], "status": ["error"], "error": [f"{type(e).__name__}: {e}"]}
        return pd.DataFrame({c: row.get(c, [None]) for c in columns})


def _future(frame: pd.DataFrame, future, spec: dict, h: int) -> np.ndarray:
    """Regressors of the next h steps; automatic regressors without new data repeat their last row."""
    if future is None or not len(future):
        if not spec["auto"]:
            raise ValueError("future regressors are needed")
        last = frame.sort_values("_ord", kind="stable").iloc[-1]
        return np.tile([float(last[f"_x{i}"]) for i in spec["columns"]], (h, 1))
    future = future.sort_values("_ord", kind="stable")
    if len(future) != h:
        raise ValueError(f"{len(future)} rows of new data for {h} steps")
    return np.column_stack([future[f"_x{i}"].to_numpy(dtype=float) for i in spec["columns"]])


def forecast_cogroup(frame: pd.DataFrame, future: pd.DataFrame, specs, keys, h, levels, labels, fail_fast) -> pd.DataFrame:
    if not len(frame):
        columns = [*keys, "model_name", "step", "mean", *[f"{side}_{b}" for b in labels for side in ("lower", "upper")], "method", "status", "error"]
        return pd.DataFrame(columns=columns)
    return forecast_group(frame, specs, keys, h, levels, labels, fail_fast, future)


#: Rows (series times kinds) below which a search of each is faster than one side by side, and values that a side-by-side search takes.
FEW, CELLS = 16, 1 << 18
#: Rows of a batch of forecasts, about.
ROWS = 1 << 16
_SEARCHED = {"init_strategy": ("mean", "naive"), "number_of_params": (1, 2), "cost_metric": ("mar", "msr", "mae", "mse"), "optimize_init": (True, False)}


def _croston_many(specs: list[dict], y: np.ndarray) -> np.ndarray:
    """Forecasts (series x specs) of equally long series, NaN where a series or a spec is to be fitted alone."""
    from panelwright.kernels import croston as k

    out = np.full((len(y), len(specs)), np.nan)
    gaps = ~np.isfinite(y).all(axis=1)
    two = np.flatnonzero(~gaps & ((y != 0).sum(axis=1) >= 2))
    alike: dict[str, tuple[dict, list[int]]] = {}
    for j, spec in enumerate(specs):
        o = {name: v for name, v in spec["options"].items() if name not in ("kind", "rm_missing", "missing")}
        kind = spec["options"].get("kind", "hyndman")
        if kind == "hyndman" and set(o) <= {"alpha"} and isinstance(o.get("alpha", 0.1), (int, float)) and "rm_missing" not in spec["options"]:
            whole = np.where(np.isfinite(y), y, 0.0)
            at = np.flatnonzero((whole.min(axis=1) >= 0) & (~gaps | ("missing" not in spec["options"])))
            if len(at):
                out[at, j] = k.last_ratios(whole[at], **o)
        elif isinstance(kind, str) and kind in k.KINDS and all(v in _SEARCHED.get(name, ()) for name, v in o.items()) and (o.get("number_of_params", 2) == 2 or o.get("optimize_init", True)):
            alike.setdefault(repr(sorted(o.items())), (o, []))[1].append(j)
    for o, ids in alike.values():
        size = max(1, CELLS // (y.shape[1] * len(ids)))
        for begin in range(0, len(two), size):
            at = two[begin : begin + size]
            if len(at) * len(ids) >= FEW:
                out[np.ix_(at, ids)] = k.last_rates(y[at], [specs[j]["options"]["kind"] for j in ids], **o)
    return out


def croston_batches(source, specs: list[dict], keys: list[str], h: int, labels: list, fail_fast: bool):
    """``forecast_group`` for batches of whole series (keys, _y): searches of many series run side by side, with the results of single ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in source:
        lists = batch.column("_y")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        values, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        mean = np.full((len(size), len(specs)), np.nan)
        method = ["croston" if (kind := s["options"].get("kind", "hyndman")) == "hyndman" else f"croston_{kind}" for s in specs]
        said: dict[tuple[int, int], str] = {}
        with np.errstate(all="ignore"):
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                mean[at] = _croston_many(specs, values[begin[at][:, None] + np.arange(n)])
            for i, j in np.argwhere(np.isnan(mean)).tolist():
                try:
                    mean[i, j] = fit_one(specs[j], values[begin[i] : begin[i] + size[i]], period(specs[j]["m"])).forecast(h).mean[0]
                except Exception as e:
                    if fail_fast:
                        raise
                    said[i, j] = f"{type(e).__name__}: {e}"
        for j, spec in enumerate(specs):
            good = np.array([(i, j) not in said for i in range(len(size))], dtype=bool) if said else np.ones(len(size), dtype=bool)
            chosen, failed = np.flatnonzero(good), np.flatnonzero(~good)
            many = max(1, ROWS // h)
            parts = [(np.repeat(chosen[b : b + many], h), True) for b in range(0, len(chosen), many)] + [(failed, False)] * bool(len(failed))
            for at, ok in parts:
                n = len(at)
                step = pa.array(np.tile(np.arange(1, h + 1), n // h), pa.int32()) if ok else pa.nulls(n, pa.int32())
                columns = [batch.column(c).take(pa.array(at)) for c in keys]
                columns += [pa.array([spec["name"]] * n, pa.string()), step]
                columns += [pa.array(mean[at, j], pa.float64(), from_pandas=True) if ok else pa.nulls(n, pa.float64())]
                columns += [pa.nulls(n, pa.float64())] * (2 * len(labels))
                columns += [pa.array([method[j] if ok else None] * n, pa.string()), pa.array(["ok" if ok else "error"] * n, pa.string())]
                columns += [pa.array([None if ok else said[i, j] for i in at.tolist()], pa.string())]
                names = [*keys, "model_name", "step", "mean", *[f"{side}_{b}" for b in labels for side in ("lower", "upper")], "method", "status", "error"]
                yield pa.RecordBatch.from_arrays(columns, names)


def fit_group(frame: pd.DataFrame, specs: list[dict], keys: list[str], fail_fast: bool) -> pd.DataFrame:
    """One row per (series, spec): method, parameters, criteria."""
    spec = specs[int(frame["_spec"].iloc[0])]
    columns = [*keys, "model_name", "method", "params", "sigma2", "aic", "aicc", "bic", "n_obs", "status", "error"]
    try:
        y, x = _series(frame, spec)
        with np.errstate(all="ignore"):
            f = fit_one(spec, y, period(spec["m"]), x)
        row = _keys(frame, keys, 1) | {
            "model_name": [spec["name"]], "method": [f.method], "params": [{k: float(v) for k, v in f.params.items() if v is not None}],
            "sigma2": [float(f.sigma2)], "aic": [float(f.aic)], "aicc": [float(f.aicc)], "bic": [float(f.bic)], "n_obs": [len(y)], "status": ["ok"],
        }
    except Exception as e:
        if fail_fast:
            raise
        row = _keys(frame, keys, 1) | {"model_name": [spec["name"]], "status": ["error"], "error": [f"{type(e).__name__}: {e}"]}
    return pd.DataFrame({c: row.get(c, [None]) for c in columns})


def fitted_group(frame: pd.DataFrame, specs: list[dict], keys: list[str], fail_fast: bool) -> pd.DataFrame:
    """Fitted values and residuals of one (series, spec)."""
    spec = specs[int(frame["_spec"].iloc[0])]
    columns = [*keys, "model_name", "_i", "fitted", "residual", "status", "error"]
    try:
        y, x = _series(frame, spec)
        with np.errstate(all="ignore"):
            f = fit_one(spec, y, period(spec["m"]), x)
        n = len(y)
        parts = {}
        for name, part in (("fitted", f.fitted), ("residual", f.residuals)):
            part = np.asarray(part, dtype=float)[-n:]
            parts[name] = np.r_[np.full(n - len(part), np.nan), part]  # what a model leaves out lies at the start
        out = _keys(frame, keys, n) | {"model_name": [spec["name"]] * n, "_i": np.arange(1, n + 1)} | parts
        out = pd.DataFrame(out | {"status": ["ok"] * n, "error": [None] * n}, columns=columns)
        return out.astype({"fitted": "Float64", "residual": "Float64"})
    except Exception as e:
        if fail_fast:
            raise
        row = _keys(frame, keys, 1) | {"model_name": [spec["name"]], "status": ["error"], "error": [f"{type(e).__name__}: {e}"]}
        return pd.DataFrame({c: row.get(c, [None]) for c in columns})


def ols_solve(n: int, mean: np.ndarray, cov: np.ndarray, intercept: bool):
    """Kept columns, estimates, standard errors and sigma2 from a group's count, means and covariances (the target is last)."""
    moments = n * (cov if intercept else cov + np.outer(mean, mean))
    sxx, sxy, syy = moments[:-1, :-1], moments[:-1, -1], float(moments[-1, -1])
    scale = np.sqrt(np.diag(sxx))
    kept: list[int] = []
    for i in range(len(scale)):
        if not scale[i] > 1e-12 * np.sqrt(n) * abs(mean[i]):  # a constant beside the intercept, or zeros
            continue
        left = 1.0
        if kept:
            r = sxx[kept, i] / scale[kept] / scale[i]
            left -= float(r @ np.linalg.solve(sxx[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept]), r))
        if left > 1e-12:
            kept.append(i)
    count = len(kept) + intercept
    if not count or n <= count:
        return None
    inverse = np.linalg.inv(sxx[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])) / np.outer(scale[kept], scale[kept])
    beta = inverse @ sxy[kept]
    s2 = max(syy - float(beta @ sxy[kept]), 0.0) / (n - count)
    variance = np.diag(inverse)
    if intercept:
        at = mean[kept]
        beta = np.r_[mean[-1] - at @ beta, beta]
        variance = np.r_[1 / n + at @ inverse @ at, variance]
    return [0, *[i + 1 for i in kept]] if intercept else kept, beta, np.sqrt(s2 * variance), s2


def ols_batches(source, keys: list[str], names: list[str]):
    """(keys, term, estimate, std_error, sigma2, n_obs) of one least-squares fit per row of moments; collinear columns are left out."""
    import pyarrow as pa

    intercept = "(Intercept)" in names
    k = len(names) - intercept + 1
    upper = np.triu_indices(k)
    for batch in source:
        at, term, estimate, error, sigma2, n_obs = [], [], [], [], [], []
        for row, (n, mean, cov) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_n", "_mean", "_cov")), strict=True)):
            if not n:
                continue
            full = np.zeros((k, k))
            full[upper] = cov
            full = np.triu(full) + np.triu(full, 1).T
            got = ols_solve(n, np.array(mean), full, intercept)
            if got is None:
                continue
            kept, beta, se, s2 = got
            at += [row] * len(kept)
            term += [names[i] for i in kept]
            estimate += beta.tolist()
            error += se.tolist()
            sigma2 += [s2] * len(kept)
            n_obs += [n] * len(kept)
        columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in keys]
        columns += [pa.array(term, pa.string()), *[pa.array(v, pa.float64()) for v in (estimate, error, sigma2)], pa.array(n_obs, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "term", "estimate", "std_error", "sigma2", "n_obs"])


def kw_group(frame: pd.DataFrame, keys: list[str], m: int, options: dict) -> pd.DataFrame:
    from panelwright.kernels import kw

    frame = frame.sort_values("_ord", kind="stable")
    r = kw.kw_decomposition(frame["_y"].to_numpy(dtype=float), m, **options)
    return pd.DataFrame({k: frame[k].to_numpy() for k in keys} | {"_i": np.arange(1, len(frame) + 1), "trend": r["trend"], "cycle": r["cycle"]})
