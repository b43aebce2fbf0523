import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import naive as nv
from panelwright.functions import series as ts
from panelwright.kernels import common
from panelwright.operators.frame import ArgumentError
from panelwright.operators.panel import panel

RNG = np.random.default_rng(11)
Y = {1: np.exp(np.cumsum(RNG.normal(0.02, 0.1, 60)) + 3), None: 20 + RNG.normal(0, 2, 40)}


def made(spark, parts=1, extra=()):
    rows = [(g, i, float(v)) for g, y in Y.items() for i, v in enumerate(y)] + list(extra)
    df = spark.createDataFrame(rows, "g int, i int, y double").repartition(parts)
    df = df.select("g", F.expr("add_months(date'2010-01-01', i)").alias("month"), "y")
    return panel(df, groups="g", date="month", frequency="month", target="y")


def test_searched_lambda(spark):
    p = made(spark)
    rows = {(r.g, r.step): r for r in nv.naive(p, "y", 2, [80], lam="auto", biasadj=True).collect()}
    for g, y in Y.items():
        lam = common.guerrero(y, 12, -0.9)
        x = (y**lam - 1) / lam
        back = lambda v: (lam * v + 1) ** (1 / lam)  # noqa: B023, E731
        sigma = np.sqrt(np.mean(np.diff(x) ** 2))
        r = rows[g, 2]
        assert r["mean"] == pytest.approx(y[-1] * (1 + 0.5 * 2 * sigma**2 * (1 - lam) / y[-1] ** (2 * lam)), rel=1e-3)
        assert r["lower_80"] == pytest.approx(back(x[-1] - 1.2815515655446004 * np.sqrt(2) * sigma), rel=1e-3)
    with pytest.raises(ArgumentError):
        nv.naive(p, "y", 1, lam="guess")


def test_scales_by_row_are_those_by_number(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 0.5), (4.0, -0.5), (4.0, 1.0)], "y double, lam double").withColumn("x", ts.box_cox_by(F.col("y"), F.col("lam")))
    rows = df.withColumn("back", ts.inv_box_cox_by(F.col("x"), F.col("lam"))).collect()
    assert [r.x for r in rows] == pytest.approx([np.log(4), 2.0, 1.0, 3.0]) and [r.back for r in rows] == pytest.approx([4.0] * 4)


def told(table):
    """Rows as text, but for the last digits, which depend on the order of sums."""
    return sorted(str(tuple(round(v, 8) if isinstance(v, float) else v for v in r)) for r in table.collect())


def test_bootstrap_depends_on_nothing_but_the_seed(spark):
    for run in (nv.naive, nv.snaive, nv.rw, nv.meanf):
        once, again = (told(run(made(spark, parts), "y", 3, [80], bootstrap=True, npaths=200)) for parts in (1, 5))
        assert once == again

        assert told(run(made(spark), "y", 3, [80], bootstrap=True, npaths=200, seed=2)) != once


def test_bootstrap_bounds(spark):
    p = made(spark, extra=[(7, 0, 5.0)])
    y = Y[None]
    e = y - y.mean()
    got = {(r.g, r.step): r for r in nv.meanf(p, "y", 2, [80], bootstrap=True, npaths=5000).collect()}
    for step in (1, 2):
        assert got[None, step]["lower_80"] == pytest.approx(y.mean() + np.quantile(e, 0.1), abs=0.4)
        assert got[None, step]["upper_80"] == pytest.approx(y.mean() + np.quantile(e, 0.9), abs=0.4)
    assert got[7, 1]["lower_80"] == pytest.approx(5.0)  # the only residual is 0
    walk = {(r.g, r.step): r for r in nv.naive(p, "y", 4, [95], bootstrap=True, npaths=5000).collect()}
    d = np.diff(Y[1])
    wide = lambda s: walk[1, s]["upper_95"] - walk[1, s]["lower_95"]
    draws = RNG.choice(d, (5000, 4)).sum(axis=1)
    assert wide(4) == pytest.approx(np.quantile(draws, 0.975) - np.quantile(draws, 0.025), rel=0.1) and wide(4) > 1.6 * wide(1)
    season = {(r.g, r.step): r for r in nv.snaive(p, "y", 13, [80], m=12, bootstrap=True, npaths=3000).collect()}
    assert season[1, 13]["upper_80"] - season[1, 13]["lower_80"] > season[1, 1]["upper_80"] - season[1, 1]["lower_80"]
    logs = {(r.g, r.step): r for r in nv.rw(p, "y", 1, [80], lam=0, bootstrap=True, npaths=500).collect()}
    assert 0 < logs[1, 1]["lower_80"] < logs[1, 1]["mean"] < logs[1, 1]["upper_80"]


def test_metrics_and_bounds(spark):
    from panelwright.functions import accuracy as acc

    a, p = RNG.normal(5, 1, 11), RNG.normal(5, 1, 11)
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, p, strict=True))] + [(2, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, a double, p double")
    got = {r.g: r for r in acc.evaluation_metrics(df, "a", "p", order="i", keys=("g",)).collect()}
    mean = np.cumsum(a) / np.arange(1, 12)
    mean[:4] = mean[3]
    assert tuple(got[1])[1:] == pytest.approx((np.mean((a - p) ** 2), np.mean(np.abs(a - p)), np.abs(p - mean).sum(), ((p - mean) ** 2).sum()))
    assert got[2].mse is None
    v = df.select(ts.variance_of_bounds(95, F.lit(1.0), F.lit(1 + 2 * 1.959963984540054 * 3)).alias("v")).first().v
    assert v == pytest.approx(9.0)
    assert ts.col_sums(df, "a", "p").first().p == pytest.approx(p.sum() + 1)
    d = ts.diff_columns(df.where("g = 1"), ["a", "p"], order="i", lag=2, times=2).orderBy("i").collect()
    assert [r.p_diff for r in d][4:] == pytest.approx([p[i] - 2 * p[i - 2] + p[i - 4] for i in range(4, 11)]) and d[3].a_diff is None
