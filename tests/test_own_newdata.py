import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators.panel import panel
from panelwright.plans import catalog
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp

SF = "/root/testdata/sf0.001"


def test_new_data_cut_from_the_panels_own_table(spark):
    """Both sides of the forecast come from one table; the result is that of new data read back from plain rows."""
    rows = spark.range(120).selectExpr("nullif(id % 3, 2) AS g", "date_add(date'2024-01-01', cast(id DIV 3 AS int)) AS day", "cast(id DIV 3 AS double) AS a", "cos(id) AS b")
    df = rows.withColumn("y", 5 + F.coalesce("g", F.lit(2)) + 2 * F.col("a") * F.col("b"))
    whole = panel(df, groups="g", date="day", frequency="day", m=1, target="y", fill_time=True)
    p, new = whole.with_df(whole.df.where("a < 37")), whole.df.where("a >= 37")
    apart = spark.createDataFrame([tuple(r) for r in new.collect()], new.schema)
    spec = sp.arima_spec("y = p(0) + d(0) + q(0)", xreg_formula="~ a * b")
    own, other = ([tuple(r) for r in fits.forecast(spec, p, 3, newdata=n, fail_fast=True).orderBy("g", "step").collect()] for n in (new, apart))
    assert own == other and len(own) == 9
    truth = [r.y for r in df.where("a >= 37").orderBy("g", "a").collect()]
    assert [r[3] for r in own] == pytest.approx(truth, abs=1e-4)


def test_arima_design_query_forecasts_every_priority(spark):
    got = catalog.queries()["model_arima_design"](spark, SF).collect()
    assert {(r.priority, r.step) for r in got} == {(p, k) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for k in range(1, 7)}
    assert {r.status for r in got} == {"ok"} and all(r.lower_95 < r.lower_80 < r["mean"] < r.upper_80 < r.upper_95 for r in got)


def test_arima_design_query_is_the_exact_regression_with_ar1_errors(spark):
    """Means and bounds against generalised least squares at the likeliest autoregression, found on a grid."""
    got = {(r.priority, r.step): r for r in catalog.queries()["model_arima_design"](spark, SF).collect()}
    months = catalog.revenue_panel(spark, SF).df.orderBy("priority", "month").collect()
    for p in {k for k, _ in got}:
        rows = [r for r in months if r.priority == p]
        y = np.array([r.revenue for r in rows])[:-6]
        a, b = np.array([[r.month.month, r.month.year - 1990] for r in rows], dtype=float).T
        x = np.column_stack([np.ones(len(a)), a, b, a * b])
        old, n = x[:-6], len(y)

        def gls(phi, old=old, y=y):
            first = np.sqrt(1 - phi**2)
            wx, wy = (np.r_[first * v[:1], v[1:] - phi * v[:-1]] for v in (old, y))
            beta = np.linalg.lstsq(wx, wy, rcond=None)[0]
            return float(((wy - wx @ beta) ** 2).sum()), beta

        phi = min(np.linspace(-0.99, 0.99, 3961), key=lambda f: n * np.log(gls(f)[0]) - np.log(1 - f**2))
        rest, beta = gls(phi)
        steps = np.arange(1, 7)
        mean = x[-6:] @ beta + phi**steps * (y - old @ beta)[-1]
        sd = np.sqrt(rest / (n - 5) * (1 - phi ** (2 * steps)) / (1 - phi**2))
        found = np.array([[got[p, k]["mean"], got[p, k].lower_80, got[p, k].upper_80, got[p, k].lower_95, got[p, k].upper_95] for k in steps])
        exact = np.column_stack([mean + z * sd for z in (0, -1.281552, 1.281552, -1.959964, 1.959964)])
        assert (np.abs(found - exact) / sd[:, None]).max() < 0.02
