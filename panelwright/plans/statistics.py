"""Queries of the series statistics: decompositions by local regression, unit roots, autocorrelations, Box-Cox parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import local, unitroot
from panelwright.functions.gaps import interpolate_seasonal
from panelwright.functions import naive as nv
from panelwright.functions import series as ts
from panelwright.operators.grouped import table_function
from panelwright.plans import fit as fits
from panelwright.plans import series_sql as sql
from panelwright.plans.catalog import _MONTHS, _REVENUE, _Z, monthly_flow, query, read, revenue_panel, rounded, split_panel
from panelwright.plans.models import flow_panel

#: Period of the monthly series, and the windows that go with it.
M, SEASON, TREND, LOW = 12, 11, 21, 13
KEY = ("flag",)
BY = {"order": "month", "keys": KEY}

_SERIES = _MONTHS + """, t AS (SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY month) AS i, count(*) OVER (PARTITION BY flag) AS n,
CAST(q AS DOUBLE) AS y, month FROM flow)"""
#: Series of more than two periods; the others have no seasonal part.
_STL = _SERIES + ", long AS (SELECT * FROM t WHERE n > 24), " + sql.stl("long", M, SEASON, TREND, LOW)
_SMOOTH = """u AS (SELECT *, (greatest(3, least(n, greatest(5, least(101, n // 10)))) - 1) // 2 AS h FROM t),
smooth AS (SELECT a.flag, a.i, avg(b.y) AS trend FROM u a JOIN u b ON a.flag = b.flag AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY 1, 2)"""
_PARTS = _STL + ", " + _SMOOTH + """, parts AS (SELECT t.flag, t.i, t.n, t.y, coalesce(s.trend, m.trend) AS trend, coalesce(s.seasonal, 0) AS seasonal
FROM t JOIN smooth m ON m.flag = t.flag AND m.i = t.i LEFT JOIN stl s ON s.flag = t.flag AND s.i = t.i)"""
_STRENGTH = "SELECT flag, CASE WHEN max(n) > 24 THEN greatest(0, least(1, 1 - var_samp(y - trend - seasonal) / var_samp(y - trend))) ELSE 0 END AS value FROM parts GROUP BY 1"


@query(_PARTS + " SELECT flag, CAST(i AS INT) AS _i, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal_12, round(y - seasonal - trend, 3) AS remainder FROM parts")
def series_mstl(spark, d):
    return rounded(fits.mstl(flow_panel(spark, d), "q"), 3)


@query(_STL + " SELECT t.flag, t.month, round(s.seasonal, 3) AS seasonal, round(s.trend, 3) AS trend, round(t.y - s.seasonal - s.trend, 3) AS remainder FROM t LEFT JOIN stl s ON s.flag = t.flag AND s.i = t.i")
def series_stl(spark, d):
    out = local.stl(monthly_flow(spark, d), "q", M, seasonal_window=SEASON, **BY)
    return rounded(out.select("flag", "month", "seasonal", "trend", "remainder"), 3)


@query(_PARTS + f" SELECT flag, round(value, 6) AS value FROM ({_STRENGTH})")
def series_seasonal_strength(spark, d):
    return rounded(local.seasonal_strength(monthly_flow(spark, d), "q", M, **BY), 6)


_LEVELS = _SERIES + """, d1 AS (SELECT flag, i, y - lag(y) OVER (PARTITION BY flag ORDER BY i) AS y FROM t),
d2 AS (SELECT flag, i, y - lag(y) OVER (PARTITION BY flag ORDER BY i) AS y FROM d1),
levels AS (SELECT flag, level, y, row_number() OVER (PARTITION BY flag, level ORDER BY i) AS i, count(*) OVER (PARTITION BY flag, level) AS n
FROM (SELECT flag, 0 AS level, i, y FROM t UNION ALL SELECT flag, 1, i, y FROM d1 UNION ALL SELECT flag, 2, i, y FROM d2) WHERE y IS NOT NULL)"""
_SHORT = "4 * (n / 100) ** 0.25"
_KPSS = sql.kpss("t", "flag", _SHORT)
_KPSS_P = sql.interpolated("statistic", list(unitroot.KPSS["level"]), list(unitroot.KPSS_LEVELS))


@query(_SERIES + ", " + _KPSS + f" SELECT flag, round(statistic, 6) AS statistic, lag, round({_KPSS_P}, 6) AS pvalue FROM kpss")
def series_kpss(spark, d):
    return rounded(unitroot.kpss(monthly_flow(spark, d), "q", **BY), 6)


_ADF = """, x AS (SELECT flag, y - lag(y) OVER w AS z, lag(y) OVER w AS x, lag(y) OVER w - lag(y, 2) OVER w AS d FROM t WINDOW w AS (PARTITION BY flag ORDER BY i)),
f AS (SELECT flag, regr_slope(z, d) AS bz, regr_intercept(z, d) AS az, regr_slope(x, d) AS bx, regr_intercept(x, d) AS ax, count(*) AS rows,
sum(z * z) - sum(z * d) ** 2 / sum(d * d) AS without FROM x WHERE d IS NOT NULL GROUP BY 1),
e AS (SELECT flag, rows, without, z - az - bz * d AS z, x - ax - bx * d AS x FROM x JOIN f USING (flag) WHERE d IS NOT NULL),
g AS (SELECT flag, rows, without, sum(x * z) / sum(x * x) AS b, sum(x * x) AS xx, sum(z * z) - sum(x * z) ** 2 / sum(x * x) AS rss FROM e GROUP BY 1, 2, 3),
adf AS (SELECT flag, b / sqrt(rss / (rows - 3) / xx) AS statistic, (without - rss) / 2 / (rss / (rows - 3)) AS phi1, rows FROM g)"""


@query(_SERIES + _ADF + " SELECT flag, round(statistic, 5) AS statistic, 1 AS lag, round(phi1, 5) AS phi1 FROM adf")
def series_adf(spark, d):
    return rounded(unitroot.adf(monthly_flow(spark, d), "q", **BY).select("flag", "statistic", "lag", "phi1"), 5)


_PP = """, pp_x AS (SELECT flag, i - 1 AS i, n - 1 AS n, y, lag(y) OVER (PARTITION BY flag ORDER BY i) AS x FROM t),
pp_f AS (SELECT flag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, var_pop(y) AS v FROM pp_x WHERE i > 0 GROUP BY 1),
pp_e AS MATERIALIZED (SELECT flag, i, n, y - a - b * x AS e, CAST(floor(4 * (n / 100) ** 0.25) AS BIGINT) AS lag FROM pp_x JOIN pp_f USING (flag) WHERE i > 0),
pp_s AS (SELECT flag, n, lag, sum(e * e) AS rss FROM pp_e GROUP BY 1, 2, 3),
pp_l AS (SELECT a.flag, sum((1 - (b.i - a.i) / (a.lag + 1.0)) * a.e * b.e) AS l FROM pp_e a JOIN pp_e b ON a.flag = b.flag AND b.i - a.i BETWEEN 1 AND a.lag GROUP BY 1),
pp_g AS (SELECT flag, n, lag, b, rss / n AS short, rss / n + 2.0 / n * l AS long, v / n AS spread, sqrt(rss / (n - 2) / sxx) AS se FROM pp_s JOIN pp_l USING (flag) JOIN pp_f USING (flag)),
pp AS (SELECT flag, lag, sqrt(short / long) * (b - 1) / se - (long - short) / (2 * sqrt(long) * sqrt(spread)) AS statistic, n * (b - 1) - (long - short) / (2 * spread) AS alpha FROM pp_g)"""


@query(_SERIES + _PP + " SELECT flag, round(statistic, 5) AS statistic, round(alpha, 4) AS alpha, lag FROM pp")
def series_phillips_perron(spark, d):
    out = unitroot.phillips_perron(monthly_flow(spark, d), "q", **BY)
    return out.select("flag", F.round("statistic", 5).alias("statistic"), F.round("alpha", 4).alias("alpha"), "lag")


_OCSB = """, oc_d AS (SELECT flag, i, n, y - lag(y) OVER w AS d, y - lag(y, 12) OVER w AS s FROM t WINDOW w AS (PARTITION BY flag ORDER BY i)),
oc_x AS (SELECT flag, n, d - lag(d, 12) OVER w AS b, lag(s) OVER w AS z4, lag(d, 12) OVER w AS z5 FROM oc_d WINDOW w AS (PARTITION BY flag ORDER BY i)),
oc_s AS (SELECT flag, n, count(*) AS rows, sum(z4 * z4) AS a, sum(z4 * z5) AS c, sum(z5 * z5) AS e, sum(z4 * b) AS p, sum(z5 * b) AS q, sum(b * b) AS v FROM oc_x WHERE b IS NOT NULL AND z4 IS NOT NULL GROUP BY 1, 2),
oc_f AS (SELECT *, a * e - c * c AS det, (e * p - c * q) / (a * e - c * c) AS b4, (a * q - c * p) / (a * e - c * c) AS b5 FROM oc_s),
ocsb AS (SELECT t.flag, CASE WHEN f.n >= 30 THEN b5 / sqrt((v - b4 * p - b5 * q) / (rows - 2) * a / det) END AS statistic FROM (SELECT DISTINCT flag FROM t) t LEFT JOIN oc_f f ON f.flag = t.flag)"""


@query(_SERIES + _OCSB + " SELECT flag, round(statistic, 5) AS statistic FROM ocsb")
def series_ocsb(spark, d):
    return rounded(unitroot.ocsb(monthly_flow(spark, d), "q", M, **BY).select("flag", "statistic"), 5)


_NDIFFS = f""", test AS (SELECT k.flag, k.level, k.n, {_KPSS_P} < 0.05 AS more, s.flat FROM kpss k
JOIN (SELECT flag, level, max(y) = min(y) AS flat FROM levels GROUP BY 1, 2) s USING (flag, level)),
ndiffs AS (SELECT flag, CAST(min(level) AS INT) AS value FROM test WHERE level = 2 OR flat OR (level > 0 AND n < 4) OR NOT more GROUP BY 1)"""


@query(_LEVELS + ", " + sql.kpss("levels", "flag, level", "3 * sqrt(n) / 13") + _NDIFFS + " SELECT flag, value FROM ndiffs")
def series_ndiffs(spark, d):
    return unitroot.ndiffs(monthly_flow(spark, d), "q", **BY)


@query(_PARTS + f" SELECT flag, CAST(value > 0.64 AS INT) AS value FROM ({_STRENGTH})")
def series_nsdiffs(spark, d):
    return unitroot.nsdiffs(monthly_flow(spark, d), "q", M, **BY)


_ACF = _SERIES + """, c AS (SELECT flag, i, n, y - avg(y) OVER (PARTITION BY flag) AS d FROM t),
g AS (SELECT a.flag, b.i - a.i AS k, sum(a.d * b.d) AS g FROM c a JOIN c b ON a.flag = b.flag AND b.i - a.i BETWEEN 0 AND 12 GROUP BY 1, 2),
r AS (SELECT flag, list(g / z ORDER BY k) AS r FROM g JOIN (SELECT flag, g AS z FROM g WHERE k = 0) USING (flag) GROUP BY 1)"""
_PACF = _ACF.replace("WITH flow", "WITH RECURSIVE flow", 1) + """, steps(flag, r, k, phi, a) AS (
SELECT flag, r, 1, [r[2]], r[2] FROM r
UNION ALL SELECT flag, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - v * phi[k + 1 - i]), v), v FROM (
  SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i + 1]))) AS v FROM steps)
WHERE k < len(r) - 1)"""


@query(_PACF + " SELECT flag, CAST(k AS INT) AS lag, round(a, 6) AS value FROM steps")
def series_pacf(spark, d):
    return rounded(fits.pacf(flow_panel(spark, d), "q", 12), 6)


def _guerrero_sql(lower: float, upper: float) -> str:
    """Four rounds of the same grid as the plan's."""
    out = [f"""gb AS MATERIALIZED (SELECT flag, (i - 1 - n % {M}) // {M} AS b, avg(y) AS mean, stddev_samp(y) AS sd FROM t WHERE n > {2 * M} AND i > n % {M} GROUP BY 1, 2)""",
           f"g0 AS (SELECT flag, CASE WHEN min(y) <= 0 THEN {max(lower, 0.0)} ELSE {lower} END AS lo, {upper} AS hi, 0.0 AS lam FROM t WHERE n > {2 * M} GROUP BY 1)"]
    for k in range(4):
        out.append(f"""v{k} AS (SELECT flag, lo, hi, lo + (hi - lo) * s / {ts.STEPS}.0 AS lam FROM g{k}, range({ts.STEPS + 1}) r(s)),
c{k}v AS (SELECT flag, lo, hi, lam, stddev_samp(sd / mean ** (1 - lam)) / avg(sd / mean ** (1 - lam)) AS cv FROM v{k} JOIN gb USING (flag) GROUP BY 1, 2, 3, 4),
g{k + 1} AS MATERIALIZED (SELECT flag, greatest(lo, lam - (hi - lo) / {ts.STEPS}.0) AS lo, least(hi, lam + (hi - lo) / {ts.STEPS}.0) AS hi, lam
FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY cv, lam) AS r FROM c{k}v) WHERE r = 1)""")
    return ", ".join(out) + f", guerrero AS (SELECT flag, lam AS value FROM g4 UNION ALL SELECT DISTINCT flag, 1.0 FROM t WHERE n <= {2 * M})"


@query(_SERIES + ", " + _guerrero_sql(-1.0, 2.0) + " SELECT flag, round(value, 4) AS value FROM guerrero")
def series_box_cox_guerrero(spark, d):
    return rounded(ts.box_cox_lambda(monthly_flow(spark, d), "q", M, **BY), 4)


@query(_SERIES + f""", grid AS (SELECT round(k * 0.05, 2) AS lam FROM range(-20, 41) r(k)),
logs AS (SELECT flag, i, n, y, ln(y) AS x, avg(ln(y)) OVER (PARTITION BY flag) AS mean FROM t),
z AS (SELECT flag, i, lam, (CASE WHEN abs(lam) > 0.02 THEN (y ** lam - 1) / lam ELSE x END) / exp(mean * (lam - 1)) AS z FROM logs, grid WHERE n > {2 * M}),
centred AS (SELECT flag, lam, z - avg(z) OVER w AS z, i - avg(i) OVER w AS i FROM z WINDOW w AS (PARTITION BY flag, lam, i % {M})),
rss AS (SELECT flag, lam, sum(z * z) - sum(z * i) ** 2 / sum(i * i) AS rss FROM centred GROUP BY 1, 2)
SELECT flag, arg_min(lam, rss) AS value FROM rss GROUP BY 1 UNION ALL SELECT DISTINCT flag, 1.0 FROM t WHERE n <= {2 * M}""")
def series_box_cox_loglik(spark, d):
    return ts.box_cox_lambda(monthly_flow(spark, d), "q", M, method="loglik", **BY)


_AUTO = _REVENUE + """, t AS (SELECT priority AS flag, row_number() OVER (PARTITION BY priority ORDER BY i) AS i, count(*) OVER (PARTITION BY priority) AS n, revenue AS y FROM train WHERE revenue > 0), """
_AUTO += _guerrero_sql(-0.9, 2.0) + """, x AS (SELECT priority, i, value AS lam, CASE WHEN revenue > 0 THEN CASE WHEN value = 0 THEN ln(revenue) ELSE (revenue ** value - 1) / value END END AS x FROM train JOIN guerrero ON flag = priority),
r AS (SELECT *, x - lag(x) OVER (PARTITION BY priority ORDER BY i) AS e FROM x),
s AS (SELECT priority, lam, sqrt(avg(e * e)) AS sigma, arg_max(x, i) FILTER (WHERE x IS NOT NULL) AS mean FROM r GROUP BY 1, 2)"""
_BACK = "CASE WHEN lam = 0 THEN exp({0}) WHEN ({0}) * lam + 1 > 0 THEN (({0}) * lam + 1) ** (1 / lam) END"
_AUTO_BOUNDS = ", ".join(f"round({_BACK.format(f'mean {sign} {z!r} * sqrt(step) * sigma')}, 1) AS {side}_{k}" for k, z in _Z.items() for sign, side in (("-", "lower"), ("+", "upper")))


@query(_AUTO + f" SELECT priority, step, round({_BACK.format('mean')}, 1) AS mean, {_AUTO_BOUNDS}, 'naive' AS model FROM s, (SELECT unnest(range(1, 7))::INT AS step)")
def forecast_naive_auto(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.naive(train, "revenue", 6, lam="auto"), 1)


@query()
def forecast_bootstrap(spark, d):
    """Bounds from 2000 drawn paths of each model of the naive family; draws are hashes, so every run gives the same rows."""
    train, _ = split_panel(revenue_panel(spark, d), 6)
    tables = [run(train, "revenue", 6, bootstrap=True, npaths=2000) for run in (nv.naive, nv.snaive, nv.rw, nv.meanf)]
    return rounded(nv.as_table(*tables), 2)


_ALL = " UNION ALL ".join(
    f"SELECT flag, '{name}' AS name, round(CAST(value AS DOUBLE), 4) AS value FROM ({text})"
    for name, text in {
        "ndiffs": _LEVELS + ", " + sql.kpss("levels", "flag, level", "3 * sqrt(n) / 13") + _NDIFFS + " SELECT flag, value FROM ndiffs",
        "nsdiffs": _PARTS + f" SELECT flag, CAST(value > 0.64 AS INT) AS value FROM ({_STRENGTH})",
        "kpss": _SERIES + ", " + _KPSS + " SELECT flag, statistic AS value FROM kpss",
        "adf": _SERIES + _ADF + " SELECT flag, statistic AS value FROM adf",
        "pp": _SERIES + _PP + " SELECT flag, statistic AS value FROM pp",
        "ocsb": _SERIES + _OCSB + " SELECT flag, statistic AS value FROM ocsb",
        "seasonal_strength": _PARTS + " " + _STRENGTH,
        "box_cox_lambda": _SERIES + ", " + _guerrero_sql(-1.0, 2.0) + " SELECT flag, value FROM guerrero",
    }.items()
)


@query(_ALL)
def series_statistics(spark, d):
    return rounded(fits.statistics(flow_panel(spark, d), "q"), 4)


@query()
def series_interpolate(spark, d):
    """Every seventh month is taken out and filled again through the seasons; tests hold this against the array function."""
    t = monthly_flow(spark, d).withColumn("v", F.when(F.month("month") % 7 != 3, F.col("q")))
    return rounded(interpolate_seasonal(t.select("flag", "month", "v"), "v", M, **BY), 3)


#: Price, in cents, that the cumulative sum takes as usual.
_USUAL = 15_000_000


@query(f"""WITH t AS (SELECT o_orderpriority, o_orderdate, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - {_USUAL} AS x FROM orders),
s AS (SELECT *, CAST(sum(x) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM t),
h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS high FROM s),
c AS (SELECT *, count(*) FILTER (high = 0) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT o_orderpriority, o_orderkey AS id, high, sum(CASE WHEN high = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderpriority, g ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS since FROM c""")
def table_function_cusum(spark, d):
    """Upper cumulative sums of order prices per priority: a state carried over ordered groups of a fifth of all rows each."""
    x = (F.round(F.col("o_totalprice") * 100) - _USUAL).cast("long")
    rows = read(spark, d, "orders").select("o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("id"), x.alias("x"))
    return table_function(rows, "panelwright.functions.streams:cusum", "id long, high long, since long", by=["o_orderpriority"], order=["o_orderdate", "id"])
