import numpy as np
import pytest

from panelwright.kernels import arima


def conditional(z, ar, ma, poly, h):
    """Mean and variance of what follows z, given its present values, from the joint normal law of the differenced series.

    The first values that the differences need are present, and are given."""
    n, k = len(z), len(poly) - 1
    total = n + h - k
    psi = np.zeros(4000)
    for j in range(len(psi)):
        psi[j] = (1.0 if j == 0 else 0.0) if j >= len(ma) else ma[j]
        psi[j] -= sum(ar[i] * psi[j - i] for i in range(1, min(j, len(ar) - 1) + 1))
    gamma = np.array([psi[: len(psi) - lag] @ psi[lag:] for lag in range(total)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(total), np.arange(total)))]
    # the series as a linear map of the differenced one behind its first values
    back = np.zeros((n + h, total))
    base = np.zeros(n + h)
    base[:k] = z[:k]
    for t in range(k, n + h):
        back[t, t - k] = 1
        for i in range(1, k + 1):
            back[t] -= poly[i] * back[t - i]
            base[t] -= poly[i] * base[t - i]
    law = back @ cov @ back.T
    here = [t for t in range(k, n) if np.isfinite(z[t])]
    ahead = list(range(n, n + h))
    weight = np.linalg.solve(law[np.ix_(here, here)], law[np.ix_(here, ahead)]).T
    mean = base[ahead] + weight @ (z[here] - base[here])
    return mean, np.diag(law[np.ix_(ahead, ahead)] - weight @ law[np.ix_(here, ahead)])


@pytest.mark.parametrize(
    "ar, ma, poly",
    [([1, -0.6, 0.3], [1], [1]), ([1, -0.5], [1, 0.4], [1]), ([1], [1, -0.6], [1, -1]), ([1, -0.3], [1, 0.2, 0.1], [1, -2, 1]), ([1], [1, -0.4, 0, 0, -0.3, 0.12], [1, -1, 0, 0, -1, 1])],
)
def test_forecasts_after_gaps_are_conditional_means(ar, ma, poly):
    rng = np.random.default_rng(11)
    z = np.cumsum(rng.normal(size=40)) + 3.0
    for gaps in ([38], [39], [20, 21, 22, 37, 39]):
        y = z.copy()
        y[gaps] = np.nan
        mean, variance = arima.project(y, np.array(ar, float), np.array(ma, float), np.array(poly, float), 5)
        want, spread = conditional(y, np.array(ar, float), np.array(ma, float), np.array(poly, float), 5)
        assert mean == pytest.approx(want, rel=1e-6, abs=1e-6) and variance == pytest.approx(spread, rel=1e-6)


def test_without_gaps_the_filter_gives_the_recursion():
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=120))
    fit = arima.arima(y, 1, (1, 1, 1))
    fc = fit.forecast(6, (80,))
    mean, _ = arima.project(y, fit.state["ar"], fit.state["ma"], np.array([1.0, -1.0]), 6)
    assert mean == pytest.approx(fc.mean, abs=1e-6)


def test_a_missing_last_but_one_value_is_projected_not_interpolated():
    rng = np.random.default_rng(2)
    y = np.zeros(320)
    for t in range(2, 320):
        y[t] = 0.5 * y[t - 1] + 0.3 * y[t - 2] + rng.normal()
    y = y[20:]
    y[-2] = np.nan
    fit = arima.arima(y, 1, (2, 0, 0))
    mean = fit.forecast(3, (80,)).mean
    level = fit.state["b"][0]
    want, spread = conditional(y - level, fit.state["ar"], fit.state["ma"], np.array([1.0]), 3)
    assert mean == pytest.approx(want + level, abs=1e-5)
    width = fit.forecast(3, (80,))
    assert (width.upper["80"] - width.mean if "80" in width.upper else next(iter(width.upper.values())) - width.mean) == pytest.approx(1.2815515655 * np.sqrt(fit.sigma2 * spread), rel=1e-4)


def test_no_run_of_values_long_enough_to_difference():
    y = np.arange(60.0)
    y[1::2] = np.nan
    mean, variance = arima.project(y, np.array([1.0]), np.array([1.0]), np.array([1.0, -2.0, 1.0]), 2)
    assert mean == pytest.approx([60.0, 61.0], abs=1e-2) and (variance > 1).all()
