import datetime as dt
import math

import numpy as np
import pytest

from panelwright.functions import accuracy as A
from panelwright.functions import levels as L
from panelwright.functions import naive as N
from panelwright.functions import series as S
from panelwright.kernels import arar, arima, common, croston, ets, optimize, stats, theta
from panelwright.operators import verbs as V
from panelwright.operators.frame import ArgumentError, ingest
from panelwright.operators.panel import frequency_to_m, panel
from panelwright.plans import fit as fits
from panelwright.plans import formula as FM
from panelwright.plans import specs as SP
from panelwright.sources.datasets import AIR_PASSENGERS, LYNX, air_passengers, simulate_seasonal

AP = np.array(AIR_PASSENGERS, dtype=float)
D = lambda k: dt.date(2024, 1, k)


@pytest.fixture(scope="module")
def store(spark):
    return ingest({"store": ["a", "a", "a", "b"], "date": [D(1), D(3), D(5), D(2)], "sales": [10, None, 30, 7]}, spark)


def test_panel_grid_and_gaps(spark, store):
    p = panel(store, groups="store", date="date", frequency="day", target="sales", fill_time=True, target_na="linear")
    got = {(r.store, r.date.day): (r.sales, r.sales_is_imputed) for r in p.df.collect()}
    assert got == {("a", 1): (10.0, False), ("a", 2): (15.0, True), ("a", 3): (20.0, True), ("a", 4): (25.0, True), ("a", 5): (30.0, False), ("b", 2): (7.0, False)}
    assert p.m == 7 and p.imputation_counts().first().sales == 3
    gap = lambda s, k=None: [r.sales for r in sorted(panel(store, groups="store", date="date", frequency="day", target="sales", fill_time=True, target_na=s, max_gap=k).df.where("store = 'a'").collect(), key=lambda r: r.date)]
    assert gap("locf", 1) == [10, 10, None, None, 30] and gap("nocb", 2) == [10, None, 30, 30, 30]
    assert gap("linear", 2) == [10, None, None, None, 30] and gap("zero", 1) == [10, 0, 0, 0, 30]
    balanced = panel(store, groups="store", date="date", frequency="day", fill_time=True, balanced=True)
    assert balanced.df.count() == 10
    twice = ingest({"g": ["a", "a"], "date": [D(1), D(1)], "v": [1, None]}, spark)
    assert panel(twice, groups="g", date="date", frequency="day", fill_time=True).df.first().v is None


def test_panel_errors_and_verbs(store):
    for bad in (
        dict(frequency="fortnight"), dict(date="q"), dict(target="q"), dict(xreg=("q",)), dict(fill_time=True), dict(balanced=True), dict(target_na="zero"),
        dict(target="sales", target_na="guess"), dict(groups="q"),
    ):
        with pytest.raises(ArgumentError):
            panel(store, **({"groups": "store"} | bad))
    p = panel(store, groups="store", date="date", m=7, target="sales")
    assert V.select(p, "sales").df.columns[:2] == ["store", "sales"] and V.select(p, "sales").date is None
    assert V.rename(p, shop="store").groups == ("shop",)
    with pytest.raises(ArgumentError):
        V.select(p, ("shop", "store"))
    with pytest.raises(ArgumentError):
        V.summarise(panel(store), n=("sales", "length"))
    assert V.summarise(p, n=("sales", "length")).count() == 2
    assert frequency_to_m("month") == 12


def test_naive_family(spark):
    p = panel(air_passengers(spark).withColumn("g", __import__("pyspark").sql.functions.lit("x")), groups="g", date="date", m=12, target="value")
    s = {r.step: r for r in N.snaive(p, "value", 14).collect()}
    assert [s[i].mean for i in (1, 12, 13)] == [AP[-12], AP[-1], AP[-12]]
    sigma = math.sqrt(np.mean((AP[12:] - AP[:-12]) ** 2))
    assert s[13].upper_95 - s[13].mean == pytest.approx(1.959964 * math.sqrt(2) * sigma, rel=1e-5)
    n = {r.step: r for r in N.naive(p, "value", 2).collect()}
    assert n[2].upper_80 - n[2].mean == pytest.approx(1.2815516 * math.sqrt(2) * math.sqrt(np.mean(np.diff(AP) ** 2)), rel=1e-5)
    r = {x.step: x for x in N.rw(p, "value", 3).collect()}
    assert r[3].mean == pytest.approx(432 + 3 * np.diff(AP).mean())
    m = N.meanf(p, "value", 1).first()
    assert m.mean == pytest.approx(AP.mean()) and m.upper_95 - m.mean == pytest.approx(1.97669 * AP.std(ddof=1) * math.sqrt(1 + 1 / 144), rel=1e-4)
    assert L.t_inverse(0.975, 5) == pytest.approx(2.570582, abs=1e-6) and L.normalize_levels([0.8, 0.95]) == [80, 95] and L.label(97.5) == "97_5"
    with pytest.raises(ArgumentError):
        L.normalize_levels(100)


def test_accuracy_kernel_and_table(spark):
    a = A.accuracy_vectors([11.5, 11, 14], [11, 12, 13], list(range(1, 11)))
    assert a["MASE"] == pytest.approx(2.5 / 3)
    v = A.accuracy_vectors([12, 18, 33, 38, 52], [10, 20, 30, 40, 50])
    assert (v["ME"], v["MAE"], v["RMSE"]) == pytest.approx((0.6, 2.2, math.sqrt(5)))
    with pytest.raises(ArgumentError):
        A.accuracy_vectors([1], [1, 2])
    fc = spark.createDataFrame([("a", k, float(m), "m") for k, m in enumerate((10, 20, 30, 40, 50), 1)], "series string, step int, mean double, model string")
    act = spark.createDataFrame([("a", D(k), float(m)) for k, m in enumerate((12, 18, 33, 38, 52, 99), 1)], "series string, date date, value double")
    got = A.accuracy(fc, act).first()
    for k in ("ME", "RMSE", "MAE", "MPE", "MAPE", "ACF1"):
        assert got[k] == pytest.approx(v[k])
    with pytest.raises(ArgumentError):
        A.accuracy(fc, act.drop("date"))


def test_series_functions_match_numpy(spark):
    df = air_passengers(spark)
    acf = [r.value for r in S.acf(df, "value", order="date", max_lag=5).orderBy("lag").collect()]
    d = AP - AP.mean()
    assert acf == pytest.approx([float(d[: 144 - k] @ d[k:]) / float(d @ d) for k in range(6)])
    got = S.decompose(df, "value", 12, order="date").orderBy("date").collect()
    trend, figure, _ = common.decompose(AP, 12)
    assert [r.trend for r in got[6:138]] == pytest.approx(trend[6:138].tolist()) and got[0].trend is None
    assert [r.seasonal for r in got[:12]] == pytest.approx(figure.tolist())
    smooth = [r.trend for r in S.smooth_trend(df, "value", order="date").orderBy("date").collect()]
    assert smooth == pytest.approx(stats.smooth_trend(AP).tolist())
    assert simulate_seasonal(spark, 10, 4, seed=1).count() == 10


def test_golden_smoothing():
    assert ets.ses(AP, 12).forecast(12).mean == pytest.approx(np.full(12, 431.9958), abs=1)
    assert ets.holt(AP, 12, damped=True).forecast(5).mean == pytest.approx([432.1066, 432.2151, 432.3215, 432.4258, 432.528], abs=5)
    mam = ets.fit_ets(AP, 12, "M", "A", "M", False).forecast(12).mean
    golden = [441.8018, 434.1186, 496.63, 483.2375, 483.9914, 551.0244, 613.1797, 609.3648, 530.5408, 463.0332, 402.7478, 451.9694]
    assert mam == pytest.approx(golden, abs=5)
    f = ets.ets(AP, 12, "AAA").forecast(12, [80.0, 95.0])
    assert (f.upper[95.0] > f.upper[80.0]).all() and (f.lower[80.0] > f.lower[95.0]).all()
    assert ets.ets(np.full(20, 3.0)).forecast(2).mean == pytest.approx([3, 3])


def test_golden_arima():
    fit = arima.arima(np.log(AP), 12, (0, 1, 1), (0, 1, 1))
    assert fit.params["ma1"] == pytest.approx(-0.4018, abs=2e-3) and fit.params["sma1"] == pytest.approx(-0.5569, abs=2e-3) and fit.aic == pytest.approx(-483.4, abs=0.1)
    ar = arima.arima(np.array(LYNX, dtype=float), 1, (2, 0, 0))
    assert ar.params["ar1"] == pytest.approx(1.1354, abs=0.02) and ar.params["ar2"] == pytest.approx(-0.5918, abs=0.02)
    auto = arima.auto_arima(AP, 12, max_p=2, max_q=2, max_P=1, max_Q=1)
    golden = [445.6349, 420.395, 449.1983, 491.8399, 503.3945, 566.8625, 654.2602, 638.5975, 540.8837, 494.1266, 423.3327, 465.5076]
    assert auto.forecast(12).mean == pytest.approx(golden, abs=5)
    t = np.arange(1, 145)
    x = np.column_stack([np.sin(t / 5), np.cos(t / 7)])
    r = arima.arima(5 + x @ [2.0, -3.0] + 0.01 * np.cos(t * 1.7), 1, (1, 0, 0), xreg=x)
    assert r.params["xreg1"] == pytest.approx(2, abs=0.05) and r.params["xreg2"] == pytest.approx(-3, abs=0.05)
    with pytest.raises(ValueError):
        arima.arima(AP, 1, (0, 0, 0), (1, 0, 0))
    gaps = AP.copy()
    gaps[[20, 50]] = np.nan
    assert np.isfinite(arima.arima(np.log(gaps), 12, (0, 1, 1), (0, 1, 1)).forecast(3).mean).all()


def test_other_kernels():
    f = arar.arar(AP).forecast(12, [95.0])
    assert np.isfinite(f.mean).all() and (f.upper[95.0] > f.mean).all()
    demand = np.array([0, 0, 3, 0, 0, 0, 2, 0, 5, 0, 0, 1, 0, 0, 0, 4, 0, 2], dtype=float)
    flat = [croston.croston(demand, kind=k).forecast(3).mean for k in ("classic", "sba", "sbj")]
    assert all(v[0] > 0 and v[0] == v[2] for v in flat)
    assert croston.croston_hyndman(np.zeros(5)).forecast(2).mean.tolist() == [0, 0]
    with pytest.raises(ValueError):
        croston.croston(np.array([0, 0, 1.0, 0]))
    assert theta.auto_theta(AP, 12).forecast(3, [80.0]).mean[0] == pytest.approx(444, abs=10)
    with pytest.raises(ValueError):
        theta.theta(AP, 12, model_type="XXX")


def test_statistics():
    s = stats.stl(AP, 12)
    assert s["seasonal"] + s["trend"] + s["remainder"] == pytest.approx(AP)
    assert s["seasonal"][:12].sum() == pytest.approx(0, abs=1) and 60 < s["seasonal"][6] < 75
    m = stats.mstl(AP, [12])
    assert m["seasonals"][12] + m["trend"] + m["remainder"] == pytest.approx(AP)
    assert stats.seasonal_strength(AP, 12) > 0.64 and stats.ndiffs(AP) == 1 and stats.nsdiffs(AP, 12) == 1
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    assert stats.kpss(noise)["pvalue"] == pytest.approx(0.1) and stats.kpss(walk)["pvalue"] < 0.05
    assert stats.adf(noise)["pvalue"] < 0.05 < stats.adf(walk)["pvalue"] + 0.06 and stats.phillips_perron(noise)["pvalue"] < 0.05
    assert stats.pacf(AP, 2)[0] == pytest.approx(0.948, abs=1e-3)
    gaps = AP.copy()
    gaps[[30, 31, 77]] = np.nan
    assert stats.interpolate_missing(gaps, 12)[[30, 31, 77]] == pytest.approx(AP[[30, 31, 77]], abs=25)
    assert common.box_cox_lambda(AP, 12) == pytest.approx(-0.29, abs=0.05)


@pytest.mark.parametrize("method", ["nelder_mead", "bfgs", "lbfgsb"])
def test_optimizers(method):
    rosen = lambda x: 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2
    extra = {"maxit": 2000} if method == "nelder_mead" else {"maxit": 500, "reltol": 1e-12, "step": 1e-6}
    assert optimize.optimize(rosen, [-1.2, 1.0], method, **extra).x == pytest.approx([1, 1], abs=0.05)
    bound = optimize.optimize(rosen, [0.0, 0.0], "lbfgsb", lower=[-2, -2], upper=[0.5, 2])
    assert bound.x[0] == pytest.approx(0.5, abs=1e-3)
    for k in ("brent", "itp"):
        assert optimize.optimize(lambda x: (x[0] - 0.3) ** 2, [0.5], k, lower=0.0, upper=1.0).x[0] == pytest.approx(0.3, abs=1e-4)
    assert optimize.hessian(lambda x: x[0] ** 2 + 3 * x[0] * x[1], np.array([1.0, 1.0])) == pytest.approx(np.array([[2, 3], [3, 0]]), abs=1e-4)


def test_formulas(spark):
    f = FM.formula("sales = p(1,2) + q() + d(1) + price + .")
    assert f.target == "sales" and f.regressors == ["price"] and FM.order_range(f, "p") == (1, 2) and FM.order_range(f, "q") == (2, 5) and f.of("auto")
    for bad in ("sales", "a b = p()", "y = foo()", "y = p(1) - q(1)", "y = __import__('os')", "y = p(2,1) + q("):
        with pytest.raises(ArgumentError):
            FM.order_range(FM.formula(bad), "p")
    s = SP.arima_spec("y = p(1) + q(1)", m=12)
    assert s.options["fixed"] == (1, 1, 1, 1)
    assert SP.ets_spec("y = e('M') + s('N')").options["model"] == "MZN"
    with pytest.raises(ArgumentError):
        SP.ses_spec("y = holt()")
    d = FM.design("y ~ a*b + c:d - 1")
    assert d.names == ["a", "b", "a:b", "c:d"] and not d.intercept
    df = spark.createDataFrame([(1.0, 2.0, "z", None)], "a double, b double, s string, n double")
    assert FM.model_matrix(df, "a*b").first().asDict() == {"(Intercept)": 1.0, "a": 1.0, "b": 2.0, "a:b": 2.0}
    with pytest.raises(ArgumentError):
        FM.model_matrix(df, "s")
    assert FM.auto_regressors(df, {"a"}) == ["b"]


def test_fit_and_forecast_runner(spark):
    rows = [("good", dt.date(2020 + i // 12, i % 12 + 1, 1), float(v), float(i)) for i, v in enumerate(AIR_PASSENGERS[:48])]
    rows += [("bad", dt.date(2020, 1, 1), None, 1.0)]
    df = spark.createDataFrame(rows, "g string, date date, y double, x double").repartition(3)
    p = panel(df, groups="g", date="date", m=12, target="y")
    specs = SP.model(SP.ses_spec("y"), SP.arar_spec("y"), SP.naive_spec("y"), SP.arima_spec("y = p(1) + d(0) + q(0) + P(0) + Q(0) + D(0) + x", name="ax"))
    new = spark.createDataFrame([(g, dt.date(2024, k, 1), 48.0 + k) for g in ("good", "bad") for k in (1, 2)], "g string, date date, x double")
    t = fits.forecast(specs, p, 2, newdata=new)
    ok, bad = fits.successful(t).collect(), fits.failures(t).collect()
    assert {(r.g, r.model_name) for r in ok} == {("good", m) for m in ("ses", "arar", "naive", "ax")} and len(ok) == 8
    assert {(r.g, r.model_name) for r in bad} == {("bad", m) for m in ("ses", "arar", "ax")} and all(r.error and r.step is None for r in bad)
    table = fits.fit(specs, p)
    assert {r.status for r in table.where("g = 'good'").collect()} == {"ok"}
    with pytest.raises(Exception, match="missing values|empty"):
        fits.forecast(SP.ses_spec("y"), p, 2, fail_fast=True).collect()
    with pytest.raises(ArgumentError):
        fits.forecast(SP.ses_spec("q"), p, 2)
    s = {r.name: r.value for r in fits.statistics(p, "y", ("ndiffs", "nsdiffs")).where("g = 'good'").collect()}
    assert s["nsdiffs"] == 1
    assert fits.mstl(p.with_df(p.df.where("g = 'good'")), "y").count() == 48


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert E.entry(spark).count() == 5


def test_diffusion_ararma_kernels():
    from panelwright.kernels import ararma, diffusion

    y = diffusion.adoption("bass", 15, [1000, 0.03, 0.4])
    f = diffusion.diffusion(np.r_[0, 0, y])
    assert f.params["m"] == pytest.approx(1000, rel=1e-3) and f.params["p"] == pytest.approx(0.03, rel=1e-2)
    assert f.forecast(2, [80.0]).mean == pytest.approx(diffusion.adoption("bass", 17, [1000, 0.03, 0.4])[15:], rel=1e-2)
    with pytest.raises(ValueError):
        diffusion.diffusion(y, model_type="square")
    a = ararma.ararma(AP, p=4, q=1).forecast(12, [95.0])
    assert np.isfinite(a.mean).all() and (np.diff(a.upper[95.0] - a.mean) > -1e-9).all()


def test_bats_tbats_kw_kernels():
    from panelwright.kernels import kw, tbats

    t = np.arange(96)
    y = 50 + 0.3 * t + 8 * np.sin(2 * np.pi * t / 12) + 0.5 * np.cos(t * 2.1)
    want = 50 + 0.3 * np.arange(96, 102) + 8 * np.sin(2 * np.pi * np.arange(96, 102) / 12)
    kw_ = dict(use_box_cox=False, use_trend=True, use_damped=False, use_arma=False)
    assert tbats.tbats(y, [12], k=1, **kw_).forecast(6, [80.0]).mean == pytest.approx(want, abs=1.5)
    assert tbats.bats(y, 12, **kw_).forecast(6).mean == pytest.approx(want, abs=1.5)
    assert tbats.bats(np.full(30, 4.0), 12).forecast(2).mean.tolist() == [4, 4]
    parts = kw.kw_decomposition(y[:60], 1, lam=1600.0)
    assert parts["trend"] + parts["cycle"] == pytest.approx(y[:60])
    w = kw.ideal_weights("bandpass", 50, low=6, high=32)
    omega = 2 * np.pi / 12
    assert w[0] + 2 * sum(w[j] * np.cos(j * omega) for j in range(1, 51)) == pytest.approx(1, abs=0.1)
    with pytest.raises(ValueError):
        kw.kw_filter(y, kind="square")


@pytest.mark.parametrize("gap", [(20, 23), (100, 103), (138, 141)])
def test_ets_keeps_its_seasons_over_gaps(gap):
    from panelwright.kernels import ets as E
    from panelwright.sources.datasets import AIR_PASSENGERS

    y = np.array(AIR_PASSENGERS, dtype=float)
    whole = E.ets(y, 12, "MAM", damped=False).forecast(12).mean
    y[slice(*gap)] = np.nan
    fit = E.ets(y, 12, "MAM", damped=False)
    got = fit.forecast(12).mean
    assert len(fit.fitted) == len(y) and np.isnan(fit.fitted[slice(*gap)]).all()
    assert (np.abs(got / whole - 1) < 0.13).all() and got.argmax() in (6, 7)


def test_strategies_for_missing_values(spark):
    from pyspark.sql import functions as F

    from panelwright.sources.datasets import air_passengers

    gappy = F.when(F.col("date").between("1956-02-01", "1956-04-01"), None).otherwise(F.col("value"))
    df = air_passengers(spark).withColumn("series", F.lit(1)).withColumn("y", gappy)
    p = panel(df.select("series", "date", "y"), groups="series", date="date", m=12, target="y")
    models = SP.model(
        SP.theta_spec("y", missing="contiguous", name="run"), SP.theta_spec("y", missing="interpolate", name="filled"), SP.theta_spec("y", name="plain"),
        SP.arar_spec("y", missing="interpolate", name="arar"), SP.bats_spec("y", missing="contiguous", use_box_cox=False, use_trend=True, use_damped=False, use_arma=False, name="bats"),
    )
    out = fits.forecast(models, p, 12, level=[])
    assert {r.model_name for r in fits.failures(out).collect()} == {"plain"}
    means = {}
    for r in fits.successful(out).collect():
        means.setdefault(r.model_name, {})[r.step] = r["mean"]
    assert set(means) == {"run", "filled", "arar", "bats"}
    assert all(len(v) == 12 and 400 < v[1] < 500 and max(v, key=v.get) in (7, 8) for v in means.values()), means


def test_small_panels_are_fitted_by_several_tasks(spark):
    df = spark.range(8 * 30).selectExpr("id % 8 AS series", "date_add(DATE'2024-01-01', CAST(id DIV 8 AS INT)) AS date", "CAST(id % 7 + id % 8 AS DOUBLE) AS y")
    p = panel(df, groups="series", date="date", frequency="day", target="y")
    models = SP.model(SP.ses_spec("y"), SP.croston_spec("y"))
    for table in (fits.forecast(models, p, 2, level=[]), fits.fit(models, p)):
        parts = table.select(__import__("pyspark").sql.functions.spark_partition_id().alias("k")).distinct().count()
        assert parts > 1
