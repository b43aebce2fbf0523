import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import smoothing as sm
from panelwright.kernels import croston, ets
from panelwright.operators.frame import ArgumentError
from panelwright.operators.panel import panel
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp

BY = {"order": "i", "keys": ("g",)}
RNG = np.random.default_rng(3)
SERIES = {1: 50 + np.cumsum(RNG.normal(0, 2, 40)), 2: 100 + 0.7 * np.arange(70) + RNG.normal(0, 3, 70), None: RNG.normal(10, 1, 33)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, i, float(v)) for g, y in SERIES.items() for i, v in enumerate(y)]
    return spark.createDataFrame([*rows, (9, 0, None), (8, 0, 4.0)], "g int, i int, y double").repartition(3)


def recursion(y, alpha, beta, phi, level, trend):
    sse = 0.0
    for v in y:
        f = level + phi * trend
        e = v - f
        sse += e * e
        level, trend = f + alpha * e, phi * trend + beta * e
    return sse, level, trend


@pytest.mark.parametrize("kind", ["ses", "holt", "damped"])
def test_fits_are_the_recursion_at_its_optimum(table, kind, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 16)
    rows = {r.g: r for r in sm.smooth(table, "y", kind=kind, **BY).collect()}
    assert set(rows) == {*SERIES, 8, 9} and rows[9].sse is None and rows[8].sse is None
    for g, y in SERIES.items():
        r = rows[g]
        sse, level, trend = recursion(y, r.alpha, r.beta, r.phi, r.level0, r.trend0)
        assert r.sse == pytest.approx(sse, rel=1e-6) and r.level == pytest.approx(level) and r.trend == pytest.approx(trend, abs=1e-9)
        # within a thousandth of the optimum of the search by a simplex, or below it
        fit = ets.ses(y) if kind == "ses" else ets.holt(y, damped=kind == "damped")
        assert r.sse <= 1.001 * float(np.nansum((y - fit.fitted) ** 2))
        # no other state near by is better
        for d in (-0.1, 0.1):
            assert recursion(y, r.alpha, r.beta, r.phi, r.level0 + d, r.trend0)[0] >= r.sse * (1 - 1e-9)
            if kind != "ses":
                assert recursion(y, r.alpha, r.beta, r.phi, r.level0, r.trend0 + d)[0] >= r.sse * (1 - 1e-9)


@pytest.fixture
def short_search(monkeypatch):
    monkeypatch.setattr(sm, "ROUNDS", 1)
    monkeypatch.setattr(sm, "FIRST", {"alpha": (0.1, 0.5, 0.9), "beta": (0.1, 0.5), "phi": (0.9,)})


def dated(spark, rows):
    df = spark.createDataFrame(rows, "g int, i int, y double").select("g", F.expr("date_add(date'2024-01-01', i)").alias("day"), "y")
    return panel(df, groups="g", date="day", frequency="day", target="y")


def test_forecasts_and_their_bounds(spark, short_search):
    p = dated(spark, [(1, i, float(v)) for i, v in enumerate(SERIES[2])])
    for kind, given in (("holt", {"alpha": 0.4, "beta": 0.1}), ("damped", {"alpha": 0.4, "beta": 0.1, "phi": 0.9})):
        got = sm.holt(p, "y", 4, [80], damped=kind == "damped", **given).orderBy("step").collect()
        r = sm.smooth(p.df, "y", order="day", keys=("g",), kind=kind, **given).first()
        phi, mean, spread, growth = r.phi, r.level, 1.0, 0.0
        for step, g in enumerate(got, 1):
            mean += phi**step * r.trend
            assert g["mean"] == pytest.approx(mean)
            se = np.sqrt(r.sse / (r.n - 1) * spread)
            assert g["upper_80"] == pytest.approx(mean + 1.2815515655446004 * se)
            growth += phi ** (step - 1)
            spread += (0.4 + 0.1 * growth) ** 2
    with pytest.raises(ArgumentError):
        sm.holt(p, "y", 1, beta=0.1)


def test_specs_run_as_plans_and_failures_are_rows(spark, short_search):
    p = dated(spark, [(1, i, float(v)) for i, v in enumerate(SERIES[1])] + [(2, 0, None)])
    table = fits.forecast(sp.model(sp.ses_spec("y"), sp.holt_spec("y = holt(damped=True)")), p, 2)
    assert "Pandas" not in table._jdf.queryExecution().executedPlan().toString()
    rows = table.collect()
    assert {(r.g, r.model_name, r.status) for r in rows} == {(1, "ses", "ok"), (1, "holt", "ok"), (2, "ses", "error"), (2, "holt", "error")}
    assert {r.method for r in rows} == {"Simple exponential smoothing", "Damped Holt's method"}


def test_gaps_leave_the_longest_run(spark, short_search):
    y = [1.0, None, 5.0, 6.0, 7.0, 8.0, None, 3.0, None]
    r = sm.smooth(dated(spark, [(1, i, v) for i, v in enumerate(y)]).df, "y", order="day", keys=("g",), kind="holt").first()
    assert (r.n, r.ahead) == (4, 3) and r.sse == pytest.approx(0, abs=1e-12)
    assert sm.project(sm.smooth(dated(spark, [(1, i, v) for i, v in enumerate(y)]).df, "y", order="day", keys=("g",), kind="holt"), 1, [], keys=("g",)).first()["mean"] == pytest.approx(12.0)


def test_stored_fits_go_on_with_new_rows(spark, table, monkeypatch, short_search):
    monkeypatch.setattr(sm, "BLOCK", 7)
    for kind in ("ses", "damped"):
        old = sm.smooth(table.where("i < 25 or g = 8"), "y", kind=kind, **BY)
        stored = spark.createDataFrame(old.collect(), old.schema)
        new = table.where("i >= 25 and (g is null or g <> 1)")
        rows = {r.g: r for r in sm.update(stored, new, "y", **BY).collect()}
        before = {r.g: r for r in stored.collect()}
        assert rows[1] == before[1]
        for g in (2, None):
            b = before[g]
            sse, level, trend = recursion(SERIES[g][25:], b.alpha, b.beta, b.phi, b.level, b.trend)
            assert rows[g].level == pytest.approx(level) and rows[g].trend == pytest.approx(trend, abs=1e-9)
            assert rows[g].sse == pytest.approx(b.sse + sse) and rows[g].n == len(SERIES[g]) and rows[g].alpha == b.alpha


def test_croston(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 2)
    demand = [0, 0, 3, 0, 5, 1, 0, 0, 0, 4, 2, 0]
    rows = [(1, i, float(v)) for i, v in enumerate(demand)] + [(2, i, 0.0) for i in range(4)] + [(3, 0, 0.0), (3, 1, 7.0), (3, 2, None)]
    p = dated(spark, rows)
    got = {r.g: r["mean"] for r in sm.croston(p, "y", 1).collect()}
    assert got[1] == pytest.approx(croston.croston_hyndman(np.array(demand, dtype=float)).forecast(1).mean[0])
    assert got[2] == 0 and got[3] == pytest.approx(7 / 2)
    z, x = np.array([3.0, 5, 1, 4, 2]), np.array([3.0, 2, 1, 4, 1])
    a, b = z.mean(), x.mean()
    for u, v in zip(z, x, strict=True):
        a, b = a + 0.2 * (u - a), b + 0.3 * (v - b)
    for kind, factor in (("classic", 1), ("sba", 1 - 0.15), ("sbj", 1 - 0.3 / 1.7)):
        r = {r.g: r["mean"] for r in sm.croston(p, "y", 1, alpha=0.2, alpha_gap=0.3, kind=kind, initial="mean").collect()}
        assert r[1] == pytest.approx(factor * a / b)
