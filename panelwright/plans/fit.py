"""Fit and forecast every series of a panel with every spec.

Models without an optimiser are DataFrame expressions.  Croston's forecasts run over batches of series, a series a row.  The
others run as one Arrow-backed grouped function per (series, spec), so both series and specs run in parallel after one shuffle
on the group keys; only keys, order, target and regressors are shipped.  A failure is a row with ``status = 'error'`` unless ``fail_fast``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.functions import local, smoothing, unitroot
from panelwright.functions import naive as nv
from panelwright.functions import series as ts
from panelwright.functions.gaps import interpolate_seasonal
from panelwright.functions.levels import label, normalize_levels
from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, quote
from panelwright.operators.panel import Panel
from panelwright.plans.designs import prepare
from panelwright.plans.formula import auto_regressors, design, model_columns
from panelwright.plans.specs import NATIVE, SMOOTHED, Spec, smoothed
from panelwright.plans.stored import cut

KERNELS = "panelwright.kernels.registry"


def _designed(specs, p: Panel, newdata: DataFrame | None = None) -> tuple[list[Spec], Panel, DataFrame | None]:
    """Specs whose designs have become columns of the panel, and of the new data by the same names."""
    out = []
    for s in [specs] if isinstance(specs, Spec) else specs:
        if s.design is not None:
            made = prepare(p.df, s.design)
            p = p.with_df(made.add(p.df))
            newdata = None if newdata is None else made.add(newdata)
            s = replace(s, regressors=(*s.regressors, *[n for n in made.names if n != "(Intercept)"]), design=None)
        out.append(s)
    return out, p, newdata


def _resolved(specs: list[Spec], p: Panel) -> list[Spec]:
    out = []
    for s in specs:
        check_known(p.df, [s.target, *s.regressors])
        if p.date is None:
            raise ArgumentError("a date column is needed")
        m = s.m if s.m is not None else p.m
        if s.kernel == "holt_winters" and (m is None or m == 1):
            raise ArgumentError("Holt-Winters needs a seasonal period")
        if s.kernel == "arima" and m is None:
            raise ArgumentError("ARIMA needs a seasonal period (1 for none)")
        if s.auto_regressors:
            auto = auto_regressors(p.df, {s.target, *p.groups, p.date, *s.regressors, f"{s.target}_is_imputed"})
            s = replace(s, regressors=(*s.regressors, *auto))
        out.append(replace(s, m=m))
    return out


def _shipped(p: Panel, specs: list[Spec]) -> tuple[DataFrame, list[dict], list[str]]:
    """The rows (keys, _ord, _y, _x..., _spec), the specs as plain data, and the regressors in the order of _x."""
    regressors = list(dict.fromkeys(r for s in specs for r in s.regressors))
    plain = [
        {"kernel": s.kernel, "name": s.name, "options": s.options, "m": s.m, "columns": [regressors.index(r) for r in s.regressors], "auto": s.auto_regressors}
        for s in specs
    ]
    by_target: dict[str, list[int]] = {}
    for i, s in enumerate(specs):
        by_target.setdefault(s.target, []).append(i)
    parts = []
    for target, ids in by_target.items():
        parts.append(
            p.df.select(
                *cols(p.groups),
                F.col(quote(p.date)).alias("_ord"),
                F.col(quote(target)).cast("double").alias("_y"),
                *[F.col(quote(r)).cast("double").alias(f"_x{i}") for i, r in enumerate(regressors)],
                F.explode(F.array(*[F.lit(i) for i in ids])).alias("_spec"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, plain, regressors


def _spread(rows: DataFrame, by: list, partitions: int | None = None) -> DataFrame:
    """Deal series out by their keys to ``partitions`` tasks, spark.sql.shuffle.partitions unless given: adaptive execution
    leaves an explicit number alone, and would otherwise join many short, slow series into one task."""
    return rows.repartition(partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _fields(p: Panel) -> str:
    return "".join(f"{quote(k)} {p.df.schema[k].dataType.simpleString()}, " for k in p.groups)


def forecast(specs, p: Panel, h: int, *, level=(80, 95), newdata: DataFrame | None = None, fail_fast: bool = False, partitions: int | None = None) -> DataFrame:
    """Long table: keys, model_name, step, mean, bounds, method, status, error.

    ``newdata`` holds the regressors of the next h dates of every series.  ``partitions`` is the number of tasks of the
    fitted models; several a core even out specs that take long.
    """
    if h < 1:
        raise ArgumentError("h must be positive")
    specs, p, newdata = _designed(specs, p, newdata)
    specs = _resolved(specs, p)
    levels = normalize_levels(level)
    labels = [label(x) for x in levels]
    tables = []
    native = [s for s in specs if s.kernel in NATIVE]
    for s in native:
        run = getattr(nv, s.kernel)
        options = dict(s.options)
        if s.kernel == "snaive":
            options["m"] = s.m
        t = run(p, s.target, h, levels, **options)
        tables.append(
            t.withColumn("method", F.col("model")).drop("model").withColumn("model_name", F.lit(s.name)).withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
        )
    for s in filter(smoothed, specs):
        tables.append(_smoothed(s, p, h, levels, labels, fail_fast, partitions))
    fitted = [s for s in specs if s.kernel not in NATIVE and not smoothed(s)]
    by_target: dict[str, list[Spec]] = {}
    for s in filter(_batched, fitted):
        by_target.setdefault(s.target, []).append(s)
    for target, some in by_target.items():
        tables.append(_side_by_side(some, p, target, h, labels, fail_fast, partitions))
    fitted = [s for s in fitted if not _batched(s)]
    if fitted:
        rows, plain, regressors = _shipped(p, fitted)
        bounds = "".join(f"lower_{b} double, upper_{b} double, " for b in labels)
        schema = f"{_fields(p)}model_name string, step int, mean double, {bounds}method string, status string, error string"
        keys = list(p.groups)
        by = [*cols(keys), F.col("_spec")]
        if newdata is None or not regressors:
            run = workers.group(KERNELS, "forecast_group", plain, keys, h, levels, labels, fail_fast)
            tables.append(_spread(rows, by, partitions).groupBy(*by).applyInPandas(run, schema))
        else:
            check_known(newdata, [*keys, p.date, *regressors])
            ids = F.explode(F.array(*[F.lit(i) for i in range(len(plain))])).alias("_spec")
            # new data may come from the panel's own table, so its keys get names of their own: else both sides hold the same columns
            others = [f"_k{i}" for i in range(len(keys))]
            named = [F.col(quote(k)).alias(o) for k, o in zip(keys, others, strict=True)]
            new = newdata.select(*named, F.col(quote(p.date)).alias("_ord"), *[F.col(quote(r)).cast("double").alias(f"_x{i}") for i, r in enumerate(regressors)], ids)
            meet = [*cols(others), F.col("_spec")]
            run = workers.cogroup(KERNELS, "forecast_cogroup", plain, keys, h, levels, labels, fail_fast)
            tables.append(_spread(rows, by, partitions).groupBy(*by).cogroup(_spread(new, meet, partitions).groupBy(*meet)).applyInPandas(run, schema))
    order = [*p.groups, "model_name", "step", "mean", *[f"{side}_{b}" for b in labels for side in ("lower", "upper")], "method", "status", "error"]
    out = tables[0].select(*cols(order))
    for t in tables[1:]:
        out = out.unionByName(t.select(*cols(order)))
    return out


def _batched(s: Spec) -> bool:
    """Kernels that search for many series side by side."""
    return s.kernel == "croston" and not s.regressors and not s.auto_regressors


def _side_by_side(specs: list[Spec], p: Panel, target: str, h: int, labels: list[str], fail_fast: bool, partitions: int | None) -> DataFrame:
    """Forecasts by a kernel that takes batches of series, a series a row."""
    _, plain, _ = _shipped(p, specs)
    rows, keys = _one(p, target), list(p.groups)
    inner = F.struct(F.col("_ord").isNull(), "_ord", "_y")  # rows without a date come last
    series = _spread(rows, cols(keys), partitions).groupBy(*cols(keys)).agg(F.array_sort(F.collect_list(inner)).alias("_y"))
    series = series.where(F.size("_y") > 0).select(*cols(keys), F.col("_y._y").alias("_y"))
    bounds = "".join(f"lower_{b} double, upper_{b} double, " for b in labels)
    schema = f"{_fields(p)}model_name string, step int, mean double, {bounds}method string, status string, error string"
    return series.mapInArrow(workers.batches(KERNELS, "croston_batches", plain, keys, h, labels, fail_fast), schema)


def _smoothed(s: Spec, p: Panel, h: int, levels, labels: list[str], fail_fast: bool, partitions: int | None) -> DataFrame:
    """Exponential smoothing as a plan, a failed series a row with its message."""
    options = {k: v for k, v in s.options.items() if k in SMOOTHED[s.kernel]}
    damped = options.pop("damped", False)
    kind = "ses" if s.kernel == "ses" else "damped" if damped else "holt"
    fits = smoothing.smooth(p.df, s.target, order=p.date, keys=p.groups, kind=kind, **options)
    name = {"ses": "Simple exponential smoothing", "holt": "Holt's method", "damped": "Damped Holt's method"}[kind]
    said = F.lit("too few values, or an empty series")
    if fail_fast:
        fits = fits.withColumn("sse", F.coalesce("sse", F.raise_error(said).cast("double")))
    good = smoothing.project(fits, h, levels, keys=p.groups, model=name).withColumnRenamed("model", "method").withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
    bad = fits.where("sse IS NULL").select(
        *cols(p.groups), F.lit(None).cast("int").alias("step"), *[F.lit(None).cast("double").alias(c) for c in ("mean", *[f"{side}_{b}" for b in labels for side in ("lower", "upper")])],
        F.lit(name).alias("method"), F.lit("error").alias("status"), said.alias("error"),
    )
    out = good.unionByName(bad).withColumn("model_name", F.lit(s.name))
    return _spread(out, cols(p.groups), partitions) if p.groups else out


def fit(specs, p: Panel, *, fail_fast: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per series and spec: method, parameters, sigma2, criteria, status."""
    specs, p, _ = _designed(specs, p)
    specs = [s for s in _resolved(specs, p) if s.kernel not in NATIVE]
    if not specs:
        raise ArgumentError("naive, seasonal naive, drift and mean have nothing to fit; forecast them directly")
    rows, plain, _ = _shipped(p, specs)
    keys = list(p.groups)
    schema = f"{_fields(p)}model_name string, method string, params map<string,double>, sigma2 double, aic double, aicc double, bic double, n_obs int, status string, error string"
    by = [*cols(keys), F.col("_spec")]
    return _spread(rows, by, partitions).groupBy(*by).applyInPandas(workers.group(KERNELS, "fit_group", plain, keys, fail_fast), schema)


def fitted(specs, p: Panel, *, fail_fast: bool = False, partitions: int | None = None) -> DataFrame:
    """keys, model_name, _i (row of the series), fitted, residual, status, error of the models that are fitted.

    Residuals are on the scale of the fit: relative for multiplicative errors, transformed under a Box-Cox lambda.  Rows
    outside a model's fitted range are null; a failed fit is one row with its message.  ``naive.naive_fitted`` serves the
    naive family.
    """
    specs, p, _ = _designed(specs, p)
    specs = [s for s in _resolved(specs, p) if s.kernel not in NATIVE]
    if not specs:
        raise ArgumentError("use naive_fitted for the naive family")
    rows, plain, _ = _shipped(p, specs)
    schema = f"{_fields(p)}model_name string, _i int, fitted double, residual double, status string, error string"
    by = [*cols(p.groups), F.col("_spec")]
    return _spread(rows, by, partitions).groupBy(*by).applyInPandas(workers.group(KERNELS, "fitted_group", plain, list(p.groups), fail_fast), schema)


def successful(table: DataFrame) -> DataFrame:
    """Rows of models that worked."""
    return table.where("status = 'ok'")


def failures(table: DataFrame) -> DataFrame:
    """Rows of models that failed, with their messages."""
    return table.where("status <> 'ok'")


def as_table(table: DataFrame, include_failures: bool = False) -> DataFrame:
    """The tidy forecast: without status columns, or with the failures."""
    return table if include_failures else successful(table).drop("status", "error")


def _one(p: Panel, target: str) -> DataFrame:
    check_known(p.df, [target, *p.groups])
    if p.date is None:
        raise ArgumentError("a date column is needed")
    return p.df.select(*cols(p.groups), F.col(quote(p.date)).alias("_ord"), F.col(quote(target)).cast("double").alias("_y"))


def _apply(p: Panel, target: str, name: str, schema: str, *args) -> DataFrame:
    rows = _one(p, target)
    by = cols(p.groups) if p.groups else [F.lit(1).alias("_all")]
    if p.groups:
        rows = _spread(rows, by)
    return rows.groupBy(*by).applyInPandas(workers.group(KERNELS, name, list(p.groups), *args), f"{_fields(p)}{schema}")


STATISTICS = ("ndiffs", "nsdiffs", "kpss", "adf", "pp", "ocsb", "seasonal_strength", "box_cox_lambda")


def statistics(p: Panel, target: str, what: tuple[str, ...] = STATISTICS) -> DataFrame:
    """(keys, name, value) of tests and measures of every series; null where a series is too short for one."""
    m = p.m if isinstance(p.m, int) else 1
    rows, keys = _one(p, target), list(p.groups)
    by = {"order": "_ord", "keys": keys}
    calls = {
        "ndiffs": lambda: unitroot.ndiffs(rows, "_y", **by),
        "nsdiffs": lambda: unitroot.nsdiffs(rows, "_y", m, **by),
        "kpss": lambda: unitroot.kpss(rows, "_y", **by).withColumnRenamed("statistic", "value"),
        "adf": lambda: unitroot.adf(rows, "_y", **by).withColumnRenamed("statistic", "value"),
        "pp": lambda: unitroot.phillips_perron(rows, "_y", **by).withColumnRenamed("statistic", "value"),
        "ocsb": lambda: unitroot.ocsb(rows, "_y", m, **by).withColumnRenamed("statistic", "value"),
        "seasonal_strength": lambda: local.seasonal_strength(rows, "_y", m, **by),
        "box_cox_lambda": lambda: ts.box_cox_lambda(rows, "_y", m, **by),
    }
    unknown = [w for w in what if w not in calls]
    if unknown or not what:
        raise ArgumentError(f"unknown statistics {unknown}; there are {sorted(calls)}")
    seasonal = {"ocsb", "seasonal_strength"}
    out = None
    for w in what:
        if m < 2 and w in seasonal:
            t = rows.select(*cols(keys)).distinct().select(*cols(keys), F.lit(None).cast("double").alias("value"))
        else:
            t = calls[w]()
        t = t.select(*cols(keys), F.lit(w).alias("name"), F.col("value").cast("double").alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def mstl(p: Panel, target: str, periods: list[int] | None = None) -> DataFrame:
    """keys, _i (row of the series), trend, a seasonal column per period, remainder.  Gaps are filled through the shortest season first."""
    periods = sorted(periods or (p.m if isinstance(p.m, (list, tuple)) else [p.m]))
    rows = _one(p, target)
    if not rows.where(F.col("_y").isNull() | F.isnan("_y")).isEmpty():
        rows = cut(interpolate_seasonal(rows, "_y", periods[0], order="_ord", keys=list(p.groups)))
    rows = rows.withColumn("_at", F.row_number().over(group_window(p.groups).orderBy("_ord"))).drop("_ord")
    out = local.mstl(rows, "_y", periods, order="_at", keys=list(p.groups))
    return out.select(*cols(p.groups), F.col("_at").alias("_i"), "trend", *[f"seasonal_{q}" for q in periods], "remainder")


def pacf(p: Panel, target: str, max_lag: int | None = None) -> DataFrame:
    """(keys, lag, value)."""
    return ts.pacf(_one(p, target), "_y", order="_ord", keys=list(p.groups), max_lag=max_lag).drop("ci")


def interpolate(p: Panel, target: str) -> DataFrame:
    """keys, _i, value: gaps filled through the seasonally adjusted series."""
    m = p.m if isinstance(p.m, int) else 1
    out = interpolate_seasonal(_one(p, target), "_y", m, order="_ord", keys=list(p.groups))
    at = F.row_number().over(group_window(p.groups).orderBy("_ord"))
    return out.select(*cols(p.groups), at.alias("_i"), F.col("_y").alias("value"))


def kw_decomposition(p: Panel, target: str, **options) -> DataFrame:
    """keys, _i, trend, cycle by a Kolmogorov-Wiener filter."""
    return _apply(p, target, "kw_group", "_i int, trend double, cycle double", p.m if isinstance(p.m, int) else 1, options)


def ols(df: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, term, estimate, std_error, sigma2, n_obs) of ``y ~ ...`` in every group; rows with a missing value are left out.

    Counts, means and covariances are built-in aggregates, partial on the map side, so no group's rows are gathered; Python
    solves the normal equations of one row per group.  A column that the ones before it explain but for 1e-12 of its
    variance counts as collinear and is left out.
    """
    d = design(text)
    if d.target is None:
        raise ArgumentError("a formula 'y ~ ...' is needed")
    check_known(df, [d.target, *keys])
    columns = model_columns(df, d)
    terms = [c for n, c in columns.items() if n != "(Intercept)"]
    values = [f"_x{i}" for i in range(len(terms))] + ["_y"]
    rows = df.select(*cols(keys), *[c.alias(v) for c, v in zip([*terms, F.col(quote(d.target)).cast("double")], values, strict=True)])
    for v in values:
        rows = rows.where(F.abs(F.col(v)) < F.lit(float("inf")))  # NaN sorts above infinity
    pairs = [F.covar_pop(a, b) for i, a in enumerate(values) for b in values[i:]]
    sums = rows.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(v) for v in values]).alias("_mean"), F.array(*pairs).alias("_cov"))
    fields = "".join(f"{quote(k)} {df.schema[k].dataType.simpleString()}, " for k in keys)
    run = workers.batches(KERNELS, "ols_batches", list(keys), list(columns))
    return sums.mapInArrow(run, f"{fields}term string, estimate double, std_error double, sigma2 double, n_obs int")


def trend_line(df: DataFrame, y: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept, r2) as built-in aggregates: no Python, partial aggregation on the map side."""
    check_known(df, [y, x, *keys])
    a, b = F.col(quote(y)), F.col(quote(x))
    return df.groupBy(*cols(keys)).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))
