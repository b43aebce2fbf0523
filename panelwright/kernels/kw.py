"""Kolmogorov-Wiener filters: the best finite-sample approximation to an ideal filter, given an ARIMA model.

The filtered value at t is the projection of the ideal, infinite filter on the observed sample.  For a stationary
series one Toeplitz system serves all t; an integrated series is extended on both sides by its own forecasts and
backcasts, which is the same projection, and the ideal weights are applied.
"""

from __future__ import annotations

import numpy as np

from panelwright.kernels.arima import arima as fixed_arima
from panelwright.kernels.arima import auto_arima
from panelwright.kernels.common import Fit, Forecast, clean, normal_bands

KINDS = ("hp", "bandpass", "butterworth", "custom")
POINTS = 4096


def transfer(kind: str, omega: np.ndarray, *, lam: float = 1600.0, low: float = 6.0, high: float = 32.0, order: int = 2, cutoff: float = np.pi / 16, fn=None) -> np.ndarray:
    """Gain of the cycle filter at each frequency."""
    if kind == "hp":
        d = 4 * (1 - np.cos(omega)) ** 2
        return lam * d / (1 + lam * d)
    if kind == "bandpass":
        return ((omega >= 2 * np.pi / high) & (omega <= 2 * np.pi / low)).astype(float)
    if kind == "butterworth":
        with np.errstate(divide="ignore"):
            r = (np.tan(cutoff / 2) / np.tan(np.maximum(omega, 1e-12) / 2)) ** (2 * order)
        return 1 / (1 + r)
    if kind == "custom" and fn is not None:
        return np.asarray([float(fn(o)) for o in omega])
    raise ValueError(f"unknown filter {kind!r}")


def ideal_weights(kind: str, n: int, **options) -> np.ndarray:
    """B_0 .. B_n of the symmetric filter; the band-pass weights have a closed form."""
    if kind == "bandpass":
        a, b = 2 * np.pi / options.get("high", 32.0), 2 * np.pi / options.get("low", 6.0)
        j = np.arange(1, n + 1)
        return np.r_[(b - a) / np.pi, (np.sin(b * j) - np.sin(a * j)) / (np.pi * j)]
    omega = (np.arange(POINTS) + 0.5) * np.pi / POINTS
    gain = transfer(kind, omega, **options)
    return np.array([float((gain * np.cos(j * omega)).mean()) for j in range(n + 1)])


def _reversed(y: np.ndarray, model: Fit) -> Fit:
    """The orders of ``model``, fitted to the series from its end to its start."""
    if len(model.fitted) != len(y) or "order" not in (model.state or {}):
        raise ValueError("model is no ARIMA of this series")
    s = model.state
    if set(s["labels"]) - {"intercept", "drift"}:
        raise ValueError("a model with regressors can't be extended")
    return fixed_arima(y[::-1], s["m"], s["order"], s["seasonal"], include_mean="intercept" in s["labels"], include_drift="drift" in s["labels"])


def kw_filter(y, m: int = 1, *, kind: str = "hp", output: str = "cycle", reach: int | None = None, model: Fit | None = None, arima: dict | None = None, **options) -> Fit:
    """Cycle or trend of a series.

    ``arima`` goes to ``auto_arima``, whose own bounds hold otherwise; ``model`` is a fitted ARIMA of the series instead,
    and its orders are fitted to the reversed series for the backcasts.
    """
    y = clean(y)
    if not np.isfinite(y).all() or len(y) < 8:
        raise ValueError("eight values without a gap are needed")
    if output not in ("cycle", "trend"):
        raise ValueError("output is cycle or trend")
    n = len(y)
    reach = reach or max(200, n)
    weights = ideal_weights(kind, reach, **options)
    if model is None:
        model, back = auto_arima(y, m, **(arima or {})), auto_arima(y[::-1], m, **(arima or {}))
    else:
        back = _reversed(y, model)
    longer = np.r_[back.forecast(reach).mean[::-1], y, model.forecast(reach).mean]
    full = np.r_[weights[:0:-1], weights]
    total = full.sum()
    if kind != "custom":
        full[reach] -= total  # a cycle filter takes a constant to zero
    cycle = np.convolve(longer, full, mode="valid")[:n]
    out = cycle if output == "cycle" else y - cycle
    fit = Fit(f"KW {kind} ({model.method})", {"sigma2": model.sigma2}, out, y - out, model.sigma2, model.aic, model.aicc, model.bic)
    fit.state = {"cycle": cycle, "trend": y - cycle, "model": model, "weights": weights}

    def forecaster(h, levels):
        future = auto = model.forecast(h + reach, levels)
        ext = np.r_[longer[: reach + n], future.mean]
        values = np.convolve(ext, full, mode="valid")[n : n + h]
        mean = values if output == "cycle" else future.mean[:h] - values
        if not levels:
            return Forecast(mean)
        lv = levels[0]
        from panelwright.kernels.common import z_of

        se = (auto.upper[lv][:h] - auto.mean[:h]) / z_of(lv)
        gain = float(np.sqrt((weights[0] ** 2 + 2 * (weights[1:] ** 2).sum()))) if output == "cycle" else 1.0
        return normal_bands(mean, se * min(gain, 1.0), levels)

    fit.forecaster = forecaster
    return fit


def kw_forecast(y, m: int = 1, **options) -> Fit:
    return kw_filter(y, m, **options)


def kw_decomposition(y, m: int = 1, **options) -> dict[str, np.ndarray]:
    """trend + cycle = data."""
    fit = kw_filter(y, m, **options)
    return {"trend": fit.state["trend"], "cycle": fit.state["cycle"]}
