"""Queries of the fitted models.  Optimisers have no SQL form; tests/ holds them against known values instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import accuracy as acc
from panelwright.operators.panel import panel
from panelwright.operators.verbs import groupby, summarise
from panelwright.plans import fit as fits
from panelwright.plans import designs
from panelwright.plans import specs as sp
from panelwright.functions import series as ts
from panelwright.plans.catalog import _MONTHS, monthly_flow, query, read, revenue_panel, rounded, split_panel
from panelwright.plans.formula import model_matrix as design_matrix


def flow_panel(spark, d):
    p = panel(monthly_flow(spark, d), groups="flag", date="month", frequency="month", target="q", fill_time=True, target_na="zero")
    return p


@query()
def model_smoothing(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    specs = sp.model(sp.ses_spec("revenue = ses()"), sp.holt_spec("revenue = holt(damped=True)"), sp.holt_winters_spec("revenue"))
    return rounded(fits.forecast(specs, train, 6), 2)


@query()
def model_ets(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(fits.forecast(sp.ets_spec("revenue = e('A') + t('Z') + s('A')"), train, 6), 2)


@query()
def model_arima(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(fits.forecast(sp.arima_spec("revenue = p(0,2) + q(0,2) + P(0,1) + Q(0,1)"), train, 6), 2)


@query()
def model_arima_fixed(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return fits.fit(sp.arima_spec("revenue = p(1) + d(1) + q(1) + P(0) + Q(0) + D(0)"), train).select("priority", "model_name", "method", F.round("aic", 2).alias("aic"), "status")


@query()
def model_arar_theta(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(fits.forecast(sp.model(sp.arar_spec("revenue"), sp.theta_spec("revenue", model_type="OTM")), train, 6), 2)


@query()
def model_croston(spark, d):
    e = read(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    t = summarise(groupby(e, "user_id", "day"), demand=("value", "length"))
    p = panel(t, groups="user_id", date="day", frequency="day", target="demand", fill_time=True, balanced=True, target_na="zero")
    specs = sp.model(sp.croston_spec("demand"), sp.croston_spec("demand", kind="sba", name="sba"), sp.croston_spec("demand", kind="sbj", name="sbj"))
    return rounded(fits.forecast(specs, p, 3, level=[]))


@query()
def model_collection_accuracy(spark, d):
    train, test = split_panel(revenue_panel(spark, d), 6)
    specs = sp.model(sp.naive_spec("revenue"), sp.snaive_spec("revenue"), sp.ses_spec("revenue"), sp.arar_spec("revenue"))
    table = fits.as_table(fits.forecast(specs, train, 6))
    return rounded(acc.accuracy(table, test, keys=["priority"], value="revenue", time="month", training=train.df), 3)


@query()
def model_bats_tbats(spark, d):
    p = flow_panel(spark, d)
    few = dict(use_box_cox=False, use_trend=True, use_damped=False, use_arma=False)
    return rounded(fits.forecast(sp.model(sp.bats_spec("q", **few), sp.tbats_spec("q", k=2, **few)), p, 6), 2)


@query()
def model_ararma(spark, d):
    return rounded(fits.forecast(sp.ararma_spec("q = ararma(p=2, q=1)"), flow_panel(spark, d), 6), 2)


@query()
def model_diffusion(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("year"))
    t = summarise(groupby(t, "priority", "year"), n=("year", "length"))
    p = panel(t, groups="priority", date="year", frequency="year", target="n", fill_time=True, target_na="zero")
    return rounded(fits.forecast(sp.model(sp.diffusion_spec("n = diffusion(model_type='bass')"), sp.diffusion_spec("n", model_type="gompertz", name="gompertz")), p, 3), 2)


@query()
def model_kolmogorov_wiener(spark, d):
    return rounded(fits.kw_decomposition(flow_panel(spark, d), "q", lam=14400.0), 2)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_line(spark, d):
    out = fits.trend_line(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ("l_returnflag",))
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""SELECT l_linestatus, unnest(['(Intercept)', 'l_quantity']) AS term, round(unnest([regr_intercept(l_tax, l_quantity), regr_slope(l_tax, l_quantity)]), 7) AS estimate,
count(*)::INT AS n_obs FROM lineitem GROUP BY 1""")
def regression_ols(spark, d):
    out = fits.ols(read(spark, d, "lineitem"), "l_tax ~ l_quantity", ("l_linestatus",))
    return out.select("l_linestatus", "term", F.round("estimate", 7).alias("estimate"), "n_obs")


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount,
round(l_quantity * l_discount, 5) AS "l_quantity:l_discount" FROM lineitem""")
def model_matrix(spark, d):
    return rounded(design_matrix(read(spark, d, "lineitem"), "l_quantity * l_discount", ("l_orderkey", "l_linenumber")), 5)


@query(_MONTHS + """, t AS (SELECT flag, month, q, row_number() OVER (PARTITION BY flag ORDER BY month) AS i, count(*) OVER (PARTITION BY flag) AS n FROM flow),
u AS (SELECT *, (greatest(3, least(n, greatest(5, least(101, n // 10)))) - 1) // 2 AS h FROM t)
SELECT a.flag, a.month, round(avg(b.q), 3) AS smooth FROM u a JOIN u b ON a.flag = b.flag AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY 1, 2""")
def series_smooth_trend(spark, d):
    return rounded(ts.smooth_trend(monthly_flow(spark, d), "q", order="month", keys=("flag",), name="smooth").select("flag", "month", "smooth"), 3)


@query(_MONTHS + """SELECT flag, month, lag0, lag1, lag2 FROM (SELECT flag, month, q AS lag0, lag(q) OVER w AS lag1, lag(q, 2) OVER w AS lag2, row_number() OVER w AS i
FROM flow WINDOW w AS (PARTITION BY flag ORDER BY month)) WHERE i >= 3""")
def series_embed(spark, d):
    return rounded(ts.embed(monthly_flow(spark, d), "q", 3, order="month", keys=("flag",)).drop("q"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS duplicated FROM orders")
def series_duplicated(spark, d):
    return ts.duplicated(read(spark, d, "orders"), "o_custkey", order="o_orderkey").select("o_orderkey", "duplicated")


@query(_MONTHS + """SELECT flag, month, round(lag(q) OVER w * 0.25 + q * 0.5 + lead(q) OVER w * 0.25, 4) AS f FROM flow WINDOW w AS (PARTITION BY flag ORDER BY month)""")
def series_filter(spark, d):
    t = monthly_flow(spark, d)
    return rounded(t.select("flag", "month", ts.symmetric_filter("q", [0.25, 0.5, 0.25], ts.over("month", ("flag",))).alias("f")))


@query("""SELECT l_orderkey, l_linenumber, l_tax::DOUBLE AS l_tax, 1.0::DOUBLE AS "(Intercept)", l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount,
round(l_quantity * l_discount, 5) AS "l_quantity:l_discount" FROM lineitem WHERE l_tax IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL""")
def model_frame(spark, d):
    return rounded(designs.model_frame(read(spark, d, "lineitem"), "l_tax ~ l_quantity * l_discount", ("l_orderkey", "l_linenumber")), 5)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 3.0 + l_discount, 5) AS mix, l_discount::DOUBLE AS l_discount, round(l_extendedprice, 3) AS l_extendedprice FROM lineitem""")
def model_matrix_independent(spark, d):
    """One of three columns of which any two explain the third is left out: the one that adds least to those before it."""
    t = read(spark, d, "lineitem").withColumn("mix", F.col("l_quantity") * 3.0 + F.col("l_discount"))
    return rounded(designs.matrix(t, "mix + l_quantity + l_discount + l_extendedprice - 1", ("l_orderkey", "l_linenumber"), dropcollinear=True), 5).withColumn("l_extendedprice", F.round("l_extendedprice", 3))


@query()
def model_arima_design(spark, d):
    """ARIMA with an interaction as regressor, forecast with the same design over new data."""
    train, test = split_panel(revenue_panel(spark, d), 6)
    add = lambda t: t.withColumn("a", F.month("month").cast("double")).withColumn("b", F.year("month") - 1990.0)
    spec = sp.arima_spec("revenue = p(1) + d(0) + q(0) + P(0) + Q(0) + D(0)", xreg_formula="~ a * b")
    return rounded(fits.forecast(spec, train.with_df(add(train.df)), 6, newdata=add(test)), 1)
