"""Queries of exponential smoothing and Croston's method as plans.  Given weights have SQL: a recursion over the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import smoothing as sm
from panelwright.operators.panel import panel
from panelwright.operators.verbs import groupby, summarise
from panelwright.plans.catalog import _REVENUE, _Z, query, read, revenue_panel, rounded, split_panel

_RECURSIVE = _REVENUE.replace("WITH raw", "WITH RECURSIVE raw", 1)


def _bounds(spread: str) -> str:
    return ", ".join(f"round(mean - {z!r} * sqrt({spread}), 2) AS lower_{k}, round(mean + {z!r} * sqrt({spread}), 2) AS upper_{k}" for k, z in _Z.items())


_FOLD = """, fold(priority, i, p, w, c0, c1, c2) AS (
SELECT priority, 0::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM panel WHERE i = 1
UNION ALL SELECT f.priority, t.i, 0.3 * t.revenue + 0.7 * p, 0.7 * w, c0 + (t.revenue - p) ** 2, c1 - 2 * w * (t.revenue - p), c2 + w * w
FROM fold f JOIN panel t ON t.priority = f.priority AND t.i = f.i + 1),
starts AS (SELECT priority, -c1 / (2 * c2) AS l FROM fold WHERE i = (SELECT max(k) FROM train)),
fits AS (SELECT priority, i AS n, p + w * l AS level, c0 + c1 * l + c2 * l * l AS sse FROM fold JOIN starts USING (priority) WHERE i = (SELECT max({last}) FROM train)),
fc AS (SELECT priority, step, level AS mean, sse / (n - 1) * (1 + (step - 1) * 0.09) AS v FROM fits, (SELECT unnest(range(1, 7))::INT AS step))"""
_SES, _STORED = _RECURSIVE + _FOLD.replace("{last}", "k"), _RECURSIVE + _FOLD.replace("{last}", "n")


@query(_SES + f" SELECT priority, step, round(mean, 2) AS mean, {_bounds('v')}, 'ses' AS model FROM fc")
def forecast_ses_fixed(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(sm.ses(train, "revenue", 6, alpha=0.3), 2)


_HOLT = _RECURSIVE + """, fold AS (
SELECT priority, 0::BIGINT AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, 0.0::DOUBLE AS r1, 1.0::DOUBLE AS r2,
  0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c11, 0.0::DOUBLE AS c12, 0.0::DOUBLE AS c22 FROM train WHERE i = 1
UNION ALL SELECT priority, i, y - 0.6 * e, q + 0.1 * e, 0.6 * u1, 0.6 * u2, r1 - 0.1 * u1, r2 - 0.1 * u2,
  c0 + e * e, c1 - 2 * e * u1, c2 - 2 * e * u2, c11 + u1 * u1, c12 + 2 * u1 * u2, c22 + u2 * u2
FROM (SELECT f.* EXCLUDE (i), t.i, t.revenue AS y, t.revenue - p - q AS e, k1 + r1 AS u1, k2 + r2 AS u2 FROM fold f JOIN train t ON t.priority = f.priority AND t.i = f.i + 1)),
solved AS (SELECT *, (c12 * c2 - 2 * c22 * c1) / (4 * c11 * c22 - c12 * c12) AS l, (c12 * c1 - 2 * c11 * c2) / (4 * c11 * c22 - c12 * c12) AS b FROM fold WHERE i = (SELECT max(k) FROM train)),
fits AS (SELECT priority, i AS n, p + k1 * l + k2 * b AS level, q + r1 * l + r2 * b AS trend, c0 + c1 * l + c2 * b + c11 * l * l + c12 * l * b + c22 * b * b AS sse FROM solved),
fc AS (SELECT priority, step, level + step * trend AS mean, sse / (n - 1) * (1 + list_sum(list_concat([0.0], list_transform(range(1, step), lambda j: (0.4 + 0.1 * j) ** 2)))) AS v
FROM fits, (SELECT unnest(range(1, 7))::INT AS step))"""


@query(_HOLT + f" SELECT priority, step, round(mean, 1) AS mean, {_bounds('v').replace(', 2)', ', 1)')}, 'holt' AS model FROM fc")
def forecast_holt_fixed(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(sm.holt(train, "revenue", 6, alpha=0.4, beta=0.1), 1)


@query()
def model_smoothing_search(spark, d):
    """Weights and states found by grids; the SQL of given weights holds for each of their points."""
    train, _ = split_panel(revenue_panel(spark, d), 6)
    fits = [sm.smooth(train.df, "revenue", order="month", keys=train.groups, kind=k).select("priority", "kind", "n", F.round("alpha", 3).alias("alpha"), F.round("beta", 3).alias("beta"), F.round("phi", 3).alias("phi"), F.round("sse", 0).alias("sse")) for k in sm.KINDS]
    return fits[0].unionByName(fits[1]).unionByName(fits[2])


def purchase_panel(spark, d):
    """Purchases of every user and day, on one complete grid."""
    e = read(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    t = summarise(groupby(e, "user_id", "day"), demand=("value", "length"))
    return panel(t, groups="user_id", date="day", frequency="day", target="demand", fill_time=True, balanced=True, target_na="zero")


_CROSTON = """WITH RECURSIVE t AS (SELECT user_id, ts::DATE AS day, count(*) AS z FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
gaps AS (SELECT user_id, z, coalesce(day - lag(day) OVER w, day - (SELECT min(day) FROM t) + 1) AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day)),
smooth(user_id, k, n, z, x) AS (SELECT user_id, k, n, z::DOUBLE, x::DOUBLE FROM gaps WHERE k = 1
UNION ALL SELECT s.user_id, g.k, g.n, s.z + 0.1 * (g.z - s.z), s.x + 0.1 * (g.x - s.x) FROM smooth s JOIN gaps g ON g.user_id = s.user_id AND g.k = s.k + 1)
SELECT user_id, step, round({factor} * z / x, 6) AS mean, '{name}' AS model FROM smooth, (SELECT unnest(range(1, 4))::INT AS step) WHERE k = n"""


@query(_CROSTON.format(factor="1.0", name="croston_classic"))
def forecast_croston(spark, d):
    return rounded(sm.croston(purchase_panel(spark, d), "demand", 3), 6)


@query(_CROSTON.format(factor="0.95", name="croston_sba"))
def forecast_croston_sba(spark, d):
    return rounded(sm.croston(purchase_panel(spark, d), "demand", 3, kind="sba"), 6)


@query(_STORED + f" SELECT priority, step, round(mean, 2) AS mean, {_bounds('v')}, 'ses' AS model FROM fc")
def forecast_ses_stored(spark, d):
    """A fit of all but the last six months, kept as a table and brought up to date by these months."""
    train, test = split_panel(revenue_panel(spark, d), 6)
    fits = sm.smooth(train.df, "revenue", order="month", keys=train.groups, alpha=0.3)
    return rounded(sm.project(sm.update(fits, test, "revenue", order="month", keys=train.groups), 6, keys=train.groups), 2)
