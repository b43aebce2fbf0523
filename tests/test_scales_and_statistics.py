import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import naive as nv
from panelwright.kernels import stats
from panelwright.operators.panel import panel
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp


def series(spark, values):
    rows = [(1, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, i int, y double").select("g", F.expr("date_add(date'2024-01-01', i)").alias("day"), "y")
    return panel(df, groups="g", date="day", frequency="day", target="y")


@pytest.mark.parametrize("lam", [0.0, 0.5, -0.5])
def test_naive_family_on_a_box_cox_scale(spark, lam):
    y = np.array([4.0, 5.0, 7.0, 6.0, 9.0, 8.0, 11.0, 10.0])
    x = np.log(y) if lam == 0 else (y**lam - 1) / lam
    back = (lambda v: np.exp(v)) if lam == 0 else (lambda v: (lam * v + 1) ** (1 / lam))
    s = math.sqrt(np.mean(np.diff(x) ** 2))
    rows = nv.naive(series(spark, y.tolist()), "y", 2, [80], lam=lam, biasadj=True).orderBy("step").collect()
    for step, r in enumerate(rows, 1):
        se = math.sqrt(step) * s
        assert r["mean"] == pytest.approx(y[-1] * (1 + 0.5 * se**2 * (1 - lam) / y[-1] ** (2 * lam)))
        assert r["lower_80"] == pytest.approx(back(x[-1] - 1.2815515655446004 * se))
    plain = nv.rw(series(spark, y.tolist()), "y", 1, [], lam=lam).first()
    assert plain["mean"] == pytest.approx(back(x[-1] + np.diff(x).mean()))
    mean = nv.meanf(series(spark, y.tolist()), "y", 1, [], lam=lam).first()
    assert mean["mean"] == pytest.approx(back(x.mean()))
    season = nv.snaive(series(spark, y.tolist()), "y", 2, [], m=2, lam=lam).orderBy("step").collect()
    assert [r["mean"] for r in season] == pytest.approx([11.0, 10.0])


def test_values_outside_the_scale_are_missing_and_specs_pass_it_on(spark):
    p = series(spark, [1.0, 0.0, None, 2.0, 4.0])
    assert fits.forecast(sp.naive_spec("y", lam=0), p, 1, level=[]).first()["mean"] == pytest.approx(4.0)


def test_fitted_tables(spark):
    p = series(spark, [3.0, 5.0, 4.0, 6.0, 5.0, 7.0, 6.0, 8.0, 7.0, 9.0, 8.0, 10.0])
    rows = fits.fitted(sp.model(sp.ses_spec("y"), sp.ets_spec("y = e('A') + t('A') + s('N')")), p).collect()
    values = {r["_i"]: r["y"] for r in p.df.withColumn("_i", F.row_number().over(p.window)).collect()}
    assert len(rows) == 24 and {r.status for r in rows} == {"ok"}
    for r in rows:
        assert r.fitted + r.residual == pytest.approx(values[r["_i"]])
    short = fits.fitted(sp.holt_winters_spec("y", m=12), series(spark, [1.0, 2.0])).collect()
    assert len(short) == 1 and short[0].status == "error" and short[0].fitted is None


def test_joint_dickey_fuller_statistics():
    y = np.cumsum(np.random.default_rng(4).normal(size=80))
    d, x = np.diff(y)[1:], np.column_stack([y[1:-1], np.ones(78), np.arange(1, 79), np.diff(y)[:-1]])

    def rss(columns):
        return float(((d - x[:, columns] @ np.linalg.lstsq(x[:, columns], d, rcond=None)[0]) ** 2).sum())

    got = stats.adf(y, "trend", 1)
    full = rss([0, 1, 2, 3])
    assert got["phi2"] == pytest.approx((rss([3]) - full) / 3 / (full / 74))
    assert got["phi3"] == pytest.approx((rss([1, 3]) - full) / 2 / (full / 74))
    assert set(stats.adf(y, "none", 1)) & {"phi1", "phi2", "phi3"} == set()


def test_phillips_perron_without_lags_is_dickey_fuller():
    y = np.cumsum(np.random.default_rng(5).normal(size=120))
    assert stats.phillips_perron(y, lags=0)["statistic"] == pytest.approx(stats.adf(y, "drift", 0)["statistic"])
    x = np.column_stack([y[:-1], np.ones(119)])
    rho = np.linalg.lstsq(x, y[1:], rcond=None)[0][0]
    assert stats.phillips_perron(y, lags=0, statistic="alpha")["statistic"] == pytest.approx(119 * (rho - 1))
    assert stats.phillips_perron(y, "trend", lags=0)["statistic"] == pytest.approx(stats.adf(y, "trend", 0)["statistic"])


def test_ocsb_chooses_its_lags():
    rng = np.random.default_rng(6)
    e = rng.normal(size=200)
    walk = np.cumsum(np.concatenate([e[:4], e[4:]]))
    seasonal = walk.copy()
    for i in range(4, 200):
        seasonal[i] = seasonal[i - 4] + e[i]
    for criterion in ("aic", "bic", "aicc"):
        got = stats.ocsb(seasonal, 4, 3, criterion)
        assert 0 <= got["lag"] <= 2 and got["statistic"] == pytest.approx(stats._ocsb_regression(seasonal, 4, got["lag"], got["lag"])[0])
    assert stats.nsdiffs(seasonal, 4, test="ocsb") == 1
    assert stats.nsdiffs(rng.normal(size=200), 4, test="ocsb") == 0
