"""The plans of the series statistics against the array functions, which work on one series at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import local, unitroot
from panelwright.functions.gaps import interpolate_seasonal
from panelwright.functions import series as ts
from panelwright.kernels import common, stats
from panelwright.operators.frame import ArgumentError
from panelwright.operators.panel import panel
from panelwright.plans import fit as fits

BY = {"order": "i", "keys": ("g",)}


def make():
    rng, out = np.random.default_rng(2), {}
    for k, n in enumerate((84, 61, 30, 27, 150, 3)):
        t = np.arange(n)
        y = np.cumsum(rng.normal(0, 2, n)) + 1000 if k % 2 else 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + 4 * np.cos(2 * np.pi * t / 5) + rng.normal(0, 2, n)
        out[None if k == 2 else k] = y
    out[4] = np.cumsum(np.cumsum(rng.normal(0, 1, 150)))
    return out


SERIES = make()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, i, float(v), -1.0) for g, y in SERIES.items() for i, v in enumerate(y)]
    # extra columns are named like inner ones; rows without a value are left out of the tests
    return spark.createDataFrame(rows, "g int, i int, y double, _n double").repartition(3)


def same(a, b):
    if b is None or not math.isfinite(b):
        return a is None
    return a is not None and a == pytest.approx(b, rel=1e-6, abs=1e-8)


def hold(rows, kernel, fields):
    rows = rows.collect()
    assert {r.g for r in rows} == set(SERIES)
    for r in rows:
        try:
            want = kernel(SERIES[r.g])
        except (ValueError, ZeroDivisionError):
            assert r[fields[0]] is None
            continue
        want = want if isinstance(want, dict) else {fields[0]: want}
        assert all(same(r[f], want[f]) for f in fields), (r, want)


@pytest.mark.parametrize("options", [{}, {"seasonal_window": 7, "seasonal_degree": 1, "trend_degree": 0}, {"robust": True, "outer": 1}])
def test_stl(table, options):
    got = {}
    for r in local.stl(table, "y", 12, **options, **BY).orderBy("i").collect():
        assert r._n == -1.0
        got.setdefault(r.g, []).append((r.seasonal, r.trend, r.remainder))
    for g, y in SERIES.items():
        if len(y) <= 24:
            assert set(got[g]) == {(None, None, None)}
            continue
        want = stats.stl(y, 12, **options)
        for k, name in enumerate(("seasonal", "trend", "remainder")):
            assert np.allclose([v[k] for v in got[g]], want[name], atol=1e-6)


def test_mstl_and_seasonal_strength(spark, table):
    got = {}
    for r in local.mstl(table, "y", [12, 5], **BY).orderBy("i").collect():
        got.setdefault(r.g, []).append((r.seasonal_5, r.seasonal_12, r.trend, r.remainder))
    for g, y in SERIES.items():
        want, none = stats.mstl(y, [12, 5]), np.zeros(len(y))
        for k, w in enumerate((want["seasonals"].get(5, none), want["seasonals"].get(12, none), want["trend"], want["remainder"])):
            assert np.allclose([v[k] for v in got[g]], w, atol=1e-6)
    hold(local.seasonal_strength(table, "y", 12, **BY), lambda y: stats.seasonal_strength(y, 12), ["value"])
    gap = table.where("g = 0").withColumn("y", F.when(F.col("i") != 9, F.col("y")))
    assert {(r.trend, r.seasonal_12) for r in local.mstl(gap, "y", 12, order="i").collect()} == {(None, None)}


def test_no_python_runs_in_the_plans(table):
    for t in (local.stl(table, "y", 12, seasonal_window=7, **BY), unitroot.ndiffs(table, "y", **BY), ts.pacf(table, "y", **BY), ts.guerrero(table, "y", 12, **BY)):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_unit_roots(table):
    fields = ["statistic", "lag", "pvalue"]
    hold(unitroot.kpss(table, "y", **BY), stats.kpss, fields)
    hold(unitroot.kpss(table, "y", kind="trend", lags="long", **BY), lambda y: stats.kpss(y, "trend", "long"), fields)
    hold(unitroot.adf(table, "y", **BY), stats.adf, [*fields, "critical_5", "phi1"])
    hold(unitroot.adf(table, "y", kind="trend", lags=3, **BY), lambda y: stats.adf(y, "trend", 3), [*fields, "phi2", "phi3"])
    hold(unitroot.adf(table, "y", lags=4, criterion="bic", **BY), lambda y: stats.adf(y, "drift", 4, "bic"), fields)
    hold(unitroot.phillips_perron(table, "y", **BY), stats.phillips_perron, fields)
    hold(unitroot.phillips_perron(table, "y", kind="trend", lags="long", **BY), lambda y: stats.phillips_perron(y, "trend", "long"), fields)
    with pytest.raises(ArgumentError):
        unitroot.adf(table, "y", kind="level", **BY)


def test_seasonal_unit_roots(table):
    for lags, criterion in ((0, None), (3, "aic"), (2, "bic"), (1, "aicc")):
        hold(unitroot.ocsb(table, "y", 12, lags=lags, criterion=criterion, **BY), lambda y: stats.ocsb(y, 12, lags, criterion), ["statistic", "lag"])  # noqa: B023


def test_numbers_of_differences(table):
    for test in ("kpss", "adf", "pp"):
        hold(unitroot.ndiffs(table, "y", test=test, **BY), lambda y: stats.ndiffs(y, test=test), ["value"])  # noqa: B023
    for test in ("seas", "ocsb"):
        hold(unitroot.nsdiffs(table, "y", 12, test=test, **BY), lambda y: stats.nsdiffs(y, 12, test=test), ["value"])  # noqa: B023


def test_constant_and_empty_series(spark, table):
    flat = spark.createDataFrame([(1, i, 7.5) for i in range(40)], "g int, i int, y double")
    assert unitroot.kpss(flat, "y", **BY).first().statistic == 0
    assert unitroot.ndiffs(flat, "y", **BY).first().value == 0 and unitroot.nsdiffs(flat, "y", 12, **BY).first().value == 0
    assert [r.value for r in ts.pacf(flat, "y", max_lag=3, **BY).collect()] == [1.0] * 3
    none = table.limit(0)
    for t in (unitroot.kpss(none, "y", **BY), unitroot.ndiffs(none, "y", test="adf", **BY), ts.acf(none, "y", **BY), ts.pacf(none, "y", **BY), local.mstl(none, "y", 12, **BY), ts.box_cox_lambda(none, "y", 12, **BY)):
        assert t.count() == 0


def test_autocorrelations(table):
    got = {}
    for r in ts.pacf(table, "y", **BY).collect():
        got.setdefault(r.g, {})[r.lag] = r.value
    for g, y in SERIES.items():
        want = stats.pacf(y)
        assert np.allclose([got[g][k] for k in range(1, len(want) + 1)], want) and len(got[g]) == len(want)
    for r in ts.acf(table, "y", max_lag=5, **BY).collect():
        d = SERIES[r.g] - SERIES[r.g].mean()
        assert r.value == pytest.approx(float(d[: len(d) - r.lag] @ d[r.lag :]) / float(d @ d))
    plan = ts.acf(table, "y", max_lag=5, **BY)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_box_cox_parameters(table):
    positive = table.withColumn("y", F.abs("y") + 1)
    for m in (12, 1):
        for method in ("guerrero", "loglik"):
            for r in ts.box_cox_lambda(positive, "y", m, method=method, **BY).collect():
                assert r.value == pytest.approx(common.box_cox_lambda(np.abs(SERIES[r.g]) + 1, m, method), abs=2e-4)
    signed = table.where("g = 0").withColumn("y", F.col("y") - 100)
    assert ts.box_cox_lambda(signed, "y", 12, **BY).first().value >= 0


def test_statistics_of_a_panel(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(SERIES[0])] + [("b", i, float(v)) for i, v in enumerate(SERIES[1])]
    df = spark.createDataFrame(rows, "g string, i int, y double").select("g", F.expr("add_months(date'2015-01-01', i)").alias("month"), "y")
    p = panel(df, groups="g", date="month", frequency="month", target="y")
    got = {(r.g, r.name): r.value for r in fits.statistics(p, "y", ("ndiffs", "nsdiffs", "adf", "box_cox_lambda")).collect()}
    assert len(got) == 8 and got["a", "nsdiffs"] == 1 and got["b", "ndiffs"] == stats.ndiffs(SERIES[1])
    assert got["a", "adf"] == pytest.approx(stats.adf(SERIES[0])["statistic"])
    with pytest.raises(ArgumentError):
        fits.statistics(p, "y", ("unknown",))
    gap = p.with_df(p.df.withColumn("y", F.when(F.month("month") != 5, F.col("y"))))
    parts = fits.mstl(gap, "y")
    assert parts.columns == ["g", "_i", "trend", "seasonal_12", "remainder"] and parts.where("trend IS NULL").count() == 0


def test_gaps_filled_through_the_seasons(spark):
    rng = np.random.default_rng(8)
    series = {}
    for g, n in enumerate((84, 61, 30, 24, 20)):
        t = np.arange(n)
        y = 50 + 0.3 * t + 12 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, n)
        y[rng.choice(n, n // 6, replace=False)] = np.nan
        y[0] = y[-1] = np.nan
        series[g] = y
    series[9] = 5 + np.arange(40.0)
    df = spark.createDataFrame([(g, i, None if np.isnan(v) else float(v), "x") for g, y in series.items() for i, v in enumerate(y)] + [(7, 0, None, "x")], "g int, i int, y double, seasonal string").repartition(3)
    for m in (12, 1):
        got = {}
        for r in interpolate_seasonal(df, "y", m, **BY).orderBy("i").collect():
            got.setdefault(r.g, []).append(r.y)
            assert r.seasonal == "x"
        assert got.pop(7) == [None]
        for g, y in series.items():
            assert np.allclose(np.array(got[g], dtype=float), stats.interpolate_missing(y, m), atol=1e-5), (g, m)
