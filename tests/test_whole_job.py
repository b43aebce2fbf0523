import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.kernels import arima, kw
from panelwright.operators.panel import panel
from panelwright.plans import catalog
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp

SF = "/root/testdata/sf0.001"


def test_ols_fits_all_rows_without_gathering(spark):
    got = {(r.l_linestatus, r.term): r for r in catalog.queries()["regression_ols"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    for status, part in rows.groupby("l_linestatus"):
        slope, intercept = np.polyfit(part["l_quantity"], part["l_tax"], 1)
        assert got[status, "(Intercept)"].estimate == pytest.approx(intercept, abs=2e-7)
        assert got[status, "l_quantity"].estimate == pytest.approx(slope, abs=2e-7)
        assert got[status, "l_quantity"].n_obs == len(part)
    plan = fits.ols(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_tax ~ l_quantity")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(1e3, 1.0, 60), rng.normal(0.0, 2.0, 60)
    y = 3 + 0.5 * a - 2 * b + rng.normal(0.0, 0.1, 60)
    rows = [(None if i < 30 else 7, float(u), float(v), 4.0, float(w)) for i, (u, v, w) in enumerate(zip(a, b, y, strict=True))]
    rows += [(7, None, 1.0, 4.0, 1.0), (7, 1.0, float("nan"), 4.0, 1.0), (7, 1.0, 1.0, 4.0, float("inf")), (9, 1.0, 1.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double, c double, y double").withColumn("twin", F.col("a") * 2 + F.col("b"))
    for text, build in (("y ~ a + c + b + twin", lambda u, v: np.column_stack([np.ones(30), u, v])), ("y ~ a + b - 1", lambda u, v: np.column_stack([u, v]))):
        got = fits.ols(df, text, ("g",)).collect()
        for g, at in ((None, slice(0, 30)), (7, slice(30, 60))):
            x = build(a[at], b[at])
            beta = np.linalg.lstsq(x, y[at], rcond=None)[0]
            e = y[at] - x @ beta
            s2 = e @ e / (30 - x.shape[1])
            mine = [r for r in got if r.g == g]
            assert [r.term for r in mine] == (["(Intercept)", "a", "b"] if x.shape[1] == 3 else ["a", "b"])
            assert [r.estimate for r in mine] == pytest.approx(beta.tolist(), rel=1e-6)
            assert [r.std_error for r in mine] == pytest.approx(np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x))).tolist(), rel=1e-4)
            assert {r.n_obs for r in mine} == {30} and mine[0].sigma2 == pytest.approx(s2, rel=1e-6)
        assert not [r for r in got if r.g == 9]


def test_croston_covers_every_user(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fits, "forecast", lambda specs, p, h, **options: seen.append(p) or p.df)
    catalog.queries()["model_croston"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'")
    assert {r.user_id for r in seen[0].df.select("user_id").distinct().collect()} == {r.user_id for r in events.select("user_id").distinct().collect()}


def test_fits_are_spread_over_tasks(spark):
    days = spark.range(60).selectExpr("id % 6 AS g", "date_add(date'2024-01-01', cast(id DIV 6 AS int)) AS day", "cast(id % 7 AS double) AS y")
    out = fits.forecast(sp.ses_spec("y"), panel(days, groups="g", date="day", frequency="day", target="y"), 1)
    assert out.count() == 6 and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_kolmogorov_wiener_covers_every_flag(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fits, "kw_decomposition", lambda p, target, **options: seen.append(p) or p.df)
    catalog.queries()["model_kolmogorov_wiener"](spark, SF)
    assert {r.flag for r in seen[0].df.select("flag").distinct().collect()} == {"A", "N", "R"}


def test_kolmogorov_wiener_takes_the_whole_search_or_a_model(monkeypatch):
    rng = np.random.default_rng(3)
    y = np.zeros(140)
    for i in range(4, 140):
        y[i] = 0.8 * y[i - 4] + rng.normal()
    y = y[20:]
    searched = []
    search = kw.auto_arima
    monkeypatch.setattr(kw, "auto_arima", lambda v, m=1, **options: searched.append(options) or search(v, m, **options))
    wide = kw.kw_filter(y, lam=1600.0)
    assert searched == [{}, {}] and max(wide.state["model"].state["order"][::2]) > 2
    narrow = kw.kw_filter(y, lam=1600.0, arima={"max_p": 1, "max_q": 1})
    assert searched[2:] == [{"max_p": 1, "max_q": 1}] * 2 and max(narrow.state["model"].state["order"][::2]) <= 1
    given = kw.kw_filter(y, lam=1600.0, model=arima.arima(y, 1, (4, 0, 0), include_mean=False))
    assert len(searched) == 4 and given.state["model"].state["order"] == (4, 0, 0)
    with pytest.raises(ValueError):
        kw.kw_filter(y[1:], model=given.state["model"])
