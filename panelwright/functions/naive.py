"""Closed-form models of every series of a panel at once: naive, seasonal naive, random walk with drift, mean.

Everything is a DataFrame expression: one shuffle on the group keys serves fit and forecast.
"""

from __future__ import annotations

from functools import wraps
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.levels import label, normalize_levels, t_quantile
from panelwright.functions.series import box_cox, box_cox_by, guerrero, inv_box_cox, inv_box_cox_by
from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, joined, quote
from panelwright.operators.panel import Panel


def _series(p: Panel, target: str) -> DataFrame:
    """keys, _i (row of the series from 1), _n, _y."""
    check_known(p.df, [target, *p.groups])
    if p.date is None:
        raise ArgumentError("a date column is needed")
    y = F.col(quote(target)).cast("double")
    return p.df.select(
        *cols(p.groups),
        F.row_number().over(p.window).alias("_i"),
        F.count(F.lit(1)).over(group_window(p.groups)).alias("_n"),
        F.when(~F.isnan(y), y).alias("_y"),
    )


def _z(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 200)


def _out(fits: DataFrame, keys, mean: Column, se, h: int, level, model: str) -> DataFrame:
    """Long forecast rows; ``se`` maps the step column to the standard error."""
    levels = normalize_levels(level)
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    rows = rows.withColumn("mean", mean).withColumn("_se", se)
    bounds = []
    for lv in levels:
        bounds += [(F.col("mean") - _z(lv) * F.col("_se")).alias(f"lower_{label(lv)}"), (F.col("mean") + _z(lv) * F.col("_se")).alias(f"upper_{label(lv)}")]
    return rows.select(*cols(keys), "step", "mean", *bounds, F.lit(model).alias("model"), "_se")


def _scaled(run):
    """Give a model ``lam`` and ``biasadj``: it runs on the Box-Cox scale, and its table is taken back.

    Values that the transformation isn't defined for (not positive, for ``lam`` of 0 or less) count as missing.  With
    ``biasadj`` the mean is adjusted by the squared standard error of its step; the bounds are quantiles and stay.  ``lam="auto"``
    takes each series' own parameter by Guerrero's method, between -0.9 and 2, from its values above 0.

    ``bootstrap`` takes the bounds from ``npaths`` paths of drawn residuals; see ``bootstrapped``.
    """

    @wraps(run)
    def model(p: Panel, target: str, h: int, level=(80, 95), *args, lam: float | str | None = None, biasadj: bool = False, bootstrap: bool = False, npaths: int = 5000, seed: int = 1, **options) -> DataFrame:
        def bounded(q: Panel) -> DataFrame:
            out = run(q, target, h, level, *args, **options)
            return bootstrapped(out, residuals(run.__name__, q, target, options), q, level, run.__name__, options, npaths, seed) if bootstrap else out

        if lam is None:
            return bounded(p).drop("_se")
        check_known(p.df, [target])
        y = F.col(quote(target)).cast("double")
        if lam == "auto":
            if p.date is None:
                raise ArgumentError("a date column is needed")
            good = F.when(~F.isnan(y) & (y > 0), y)
            m = p.m if isinstance(p.m, int) else 1
            found = guerrero(p.df.withColumn("_v", good), "_v", m, order=p.date, keys=p.groups, lower=-0.9)
            found = found.select(*cols(p.groups), F.col("value").alias("_lam"))
            scaled = joined(p.df, found, p.groups)
            out = bounded(p.with_df(scaled.withColumn(target, box_cox_by(good, F.col("_lam"))).drop("_lam")))
            out, by = joined(out, found, p.groups), F.col("_lam")
            scale = {c: inv_box_cox_by(F.col(c), by) for c in out.columns if c.startswith(("lower_", "upper_")) and c not in p.groups}
            scale["mean"] = inv_box_cox_by(F.col("mean"), by, F.col("_se") * F.col("_se") if biasadj else None)
            return out.withColumns(scale).drop("_se", "_lam")
        if isinstance(lam, str):
            raise ArgumentError("lam is a number or auto")
        y = F.when(~F.isnan(y) & (y > 0), y) if lam <= 0 else y
        out = bounded(p.with_df(p.df.withColumn(target, box_cox(y, lam))))
        scale = {c: inv_box_cox(F.col(c), lam) for c in out.columns if c.startswith(("lower_", "upper_")) and c not in p.groups}
        scale["mean"] = inv_box_cox(F.col("mean"), lam, F.col("_se") * F.col("_se") if biasadj else None)
        return out.withColumns(scale).drop("_se")

    return model


def residuals(model: str, p: Panel, target: str, options: dict) -> DataFrame:
    """keys, _i, residual of a model of the naive family; null where there is none."""
    if model in ("naive", "snaive"):
        m = (options.get("m") or p.m) if model == "snaive" else 1
        return naive_fitted(p, target, m).select(*cols(p.groups), "_i", "residual")
    s = _series(p, target)
    whole = group_window(p.groups)
    d = F.col("_y") - F.lag("_y").over(whole.orderBy("_i")) if model == "rw" else F.col("_y")
    if model == "rw" and options.get("drift") is False:
        return s.withColumn("residual", d).select(*cols(p.groups), "_i", "residual")
    s = s.withColumn("_d", d)
    return s.withColumn("residual", F.col("_d") - F.avg("_d").over(whole)).select(*cols(p.groups), "_i", "residual")


def bootstrapped(out: DataFrame, errors: DataFrame, p: Panel, level, model: str, options: dict, npaths: int, seed: int) -> DataFrame:
    """``out`` with bounds that are quantiles of ``npaths`` simulated paths.

    Which residual a step of a path draws is a hash of (seed, series, path, step), so results depend neither on the
    partitioning nor on the run.  Drawn numbers meet the residuals in a join on (series, rank): no series is gathered.  Errors
    add up along a path, for the seasonal model along its season; those of the mean stand alone.  A series without
    residuals keeps its bounds.
    """
    if npaths < 1:
        raise ArgumentError("npaths must be positive")
    keys, levels = list(p.groups), normalize_levels(level)
    whole = group_window(keys)
    e = errors.where(F.col("residual").isNotNull() & ~F.isnan("residual"))
    e = e.select(*cols(keys), (F.row_number().over(whole.orderBy("_i")) - 1).alias("_draw"), F.col("residual").alias("_e"))
    sizes = e.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("_size"))
    paths = joined(out.select(*cols(keys), "step", "mean"), sizes, keys).where("_size > 0").withColumn("_path", F.explode(F.sequence(F.lit(1), F.lit(npaths))))
    paths = paths.withColumn("_draw", F.pmod(F.xxhash64(F.lit(seed), *cols(keys), "_path", "step"), F.col("_size")).cast("int"))
    drawn = joined(paths, e, [*keys, "_draw"])
    if model == "meanf":
        value = F.col("mean") + F.col("_e")
    else:
        m = (options.get("m") or p.m) if model == "snaive" else 1
        line = Window.partitionBy(*cols(keys), "_path", (F.col("step") - 1) % m).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        value = F.col("mean") + F.sum("_e").over(line)
    shares = [0.5 + side * lv / 200 for lv in levels for side in (-1, 1)]
    if not shares:
        return out
    found = drawn.withColumn("_v", value).groupBy(*cols(keys), "step").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_q"))
    both = joined(out, found, [*keys, "step"])
    names = [f"{side}_{label(lv)}" for lv in levels for side in ("lower", "upper")]
    return both.withColumns({n: F.coalesce(F.get("_q", i), F.col(n)) for i, n in enumerate(names)}).drop("_q")


def naive_fitted(p: Panel, target: str, lag: int = 1) -> DataFrame:
    """keys, _i, fitted and residual: the value one lag before; when both it and the observation are missing, the
    fitted value one lag before is carried on."""
    s = _series(p, target)
    w = group_window(p.groups).orderBy("_i")
    if lag == 1:
        previous = F.lag("_y").over(w)
        fitted = F.coalesce(previous, F.when(F.col("_y").isNull(), F.lag("_y", 2).over(w)))
    else:
        fitted = F.lag("_y", lag).over(w)
    return s.withColumn("fitted", fitted).withColumn("residual", F.col("_y") - F.col("fitted"))


@_scaled
def naive(p: Panel, target: str, h: int, level=(80, 95)) -> DataFrame:
    """The last value, with errors that grow with the square root of the step."""
    f = naive_fitted(p, target)
    fits = f.groupBy(*cols(p.groups)).agg(
        F.max_by("_y", F.when(F.col("_y").isNotNull(), F.col("_i"))).alias("_last"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("_sigma"),
        F.count("_y").alias("_ok"),
    )
    fits = fits.where("_ok >= 2")
    return _out(fits, p.groups, F.col("_last"), F.sqrt("step") * F.col("_sigma"), h, level, "naive")


@_scaled
def snaive(p: Panel, target: str, h: int, level=(80, 95), m: int | None = None) -> DataFrame:
    """The last value of the same season."""
    m = m or p.m
    if not isinstance(m, int) or m < 1:
        raise ArgumentError("a seasonal period is needed")
    f = naive_fitted(p, target, m)
    f = f.withColumn("_s", F.pmod(F.col("_i") - F.col("_n") - 1, F.lit(m)))
    whole = group_window(p.groups)
    sigma = F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(whole))
    f = f.withColumn("_sigma", sigma).withColumn("_ok", F.count("_y").over(whole)).where(F.col("_ok") > m)
    seasons = f.groupBy(*cols(p.groups), "_s", "_sigma").agg(F.max_by("_y", F.when(F.col("_y").isNotNull(), F.col("_i"))).alias("_last"))
    # the season of step i is the one of row n - m + i, i.e. (i - 1) mod m
    seasons = seasons.withColumn("_steps", F.expr(f"case when _s + 1 <= {h} then sequence(int(_s + 1), {h}, {m}) end"))
    levels = normalize_levels(level)
    rows = seasons.withColumn("step", F.explode("_steps")).withColumn("mean", F.col("_last"))
    rows = rows.withColumn("_se", F.sqrt(F.ceil(F.col("step") / m)) * F.col("_sigma"))
    bounds = []
    for lv in levels:
        bounds += [(F.col("mean") - _z(lv) * F.col("_se")).alias(f"lower_{label(lv)}"), (F.col("mean") + _z(lv) * F.col("_se")).alias(f"upper_{label(lv)}")]
    return rows.select(*cols(p.groups), "step", "mean", *bounds, F.lit("snaive").alias("model"), "_se")


@_scaled
def rw(p: Panel, target: str, h: int, level=(80, 95), drift: bool = True) -> DataFrame:
    """Random walk, with the mean of the differences as drift."""
    if not drift:
        return naive.__wrapped__(p, target, h, level).withColumn("model", F.lit("rw"))
    s = _series(p, target)
    w = group_window(p.groups).orderBy("_i")
    s = s.withColumn("_d", F.col("_y") - F.lag("_y").over(w))
    fits = s.groupBy(*cols(p.groups)).agg(
        F.max_by("_y", F.when(F.col("_y").isNotNull(), F.col("_i"))).alias("_last"),
        F.avg("_d").alias("_drift"),
        F.stddev_samp("_d").alias("_sigma"),
        F.count("_d").alias("_nd"),
    )
    fits = fits.where("_nd >= 2").withColumn("_dse", F.col("_sigma") / F.sqrt("_nd"))
    step = F.col("step")
    se = F.sqrt(step * F.col("_sigma") * F.col("_sigma") + step * step * F.col("_dse") * F.col("_dse"))
    return _out(fits, p.groups, F.col("_last") + step * F.col("_drift"), se, h, level, "rw")


rwf = rw


@_scaled
def meanf(p: Panel, target: str, h: int, level=(80, 95)) -> DataFrame:
    """The mean, with Student-t intervals."""
    s = _series(p, target)
    fits = s.groupBy(*cols(p.groups)).agg(F.avg("_y").alias("_mu"), F.stddev_samp("_y").alias("_sd"), F.count("_y").alias("_k")).where("_k >= 1")
    levels = normalize_levels(level)
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("mean", F.col("_mu"))
    rows = rows.withColumn("_w", F.coalesce("_sd", F.lit(0.0)) * F.sqrt(1 + 1 / F.col("_k")))
    bounds = []
    for lv in levels:
        half = F.when(F.col("_k") == 1, F.lit(float("inf"))).otherwise(t_quantile(F.col("_k") - 1, 0.5 + lv / 200) * F.col("_w"))
        bounds += [(F.col("mean") - half).alias(f"lower_{label(lv)}"), (F.col("mean") + half).alias(f"upper_{label(lv)}")]
    return rows.select(*cols(p.groups), "step", "mean", *bounds, F.lit("meanf").alias("model"), F.col("_w").alias("_se"))


def as_table(*tables: DataFrame) -> DataFrame:
    """Forecast tables under each other; levels that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


