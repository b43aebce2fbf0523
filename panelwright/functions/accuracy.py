"""Forecast accuracy: a join by position and one aggregation."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, quote, visible

METRICS = ("ME", "RMSE", "MAE", "MPE", "MAPE", "ACF1", "MASE")
VALUE_NAMES = ("value", "y", "actual", "observed")
GROUP_NAMES = ("series", "model", "model_name", "group")
TIME_NAMES = ("date", "time", "step", "ds", "index")


def accuracy_vectors(actual: list[float], forecast: list[float], training: list[float] | None = None) -> dict[str, float]:
    """The metrics of two vectors of one length."""
    if len(actual) != len(forecast):
        raise ArgumentError("actual and forecast differ in length")
    nan = float("nan")
    e = [a - f for a, f in zip(actual, forecast, strict=True)]
    n = len(e)
    me = sum(e) / n
    share = [100 * x / a for x, a in zip(e, actual, strict=True) if a != 0]
    den = sum((x - me) ** 2 for x in e)
    out = {
        "ME": me,
        "RMSE": (sum(x * x for x in e) / n) ** 0.5,
        "MAE": sum(map(abs, e)) / n,
        "MPE": sum(share) / len(share) if share else nan,
        "MAPE": sum(map(abs, share)) / len(share) if share else nan,
        "ACF1": sum((e[i] - me) * (e[i + 1] - me) for i in range(n - 1)) / den if n > 1 and den else nan,
    }
    if training is not None and len(training) > 1:
        scale = sum(abs(b - a) for a, b in zip(training, training[1:], strict=False)) / (len(training) - 1)
        out["MASE"] = out["MAE"] / scale if scale else nan
    return out


def _value_column(df: DataFrame, taken) -> str:
    for n in VALUE_NAMES:
        if n in df.columns:
            return n
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and f.name not in taken:
            return f.name
    raise ArgumentError("no value column")


def accuracy(
    forecast: DataFrame,
    actual: DataFrame,
    *,
    keys=None,
    value: str | None = None,
    mean: str = "mean",
    step: str = "step",
    time: str | None = None,
    training: DataFrame | None = None,
    by=None,
) -> DataFrame:
    """One row per model and group.  Actuals are ordered by time and aligned with the forecast's steps by position; the
    longer side is cut.  ``training`` (the same keys and value column) gives MASE per group; without it MASE is null."""
    if by is not None:
        warnings.warn("by is accepted and ignored", stacklevel=2)
    keys = [k for k in (keys if keys is not None else [c for c in GROUP_NAMES if c in forecast.columns and c in actual.columns])]
    check_known(forecast, [*keys, mean, step])
    check_known(actual, keys)
    time = time or next((c for c in TIME_NAMES if c in actual.columns), None)
    if time is None:
        raise ArgumentError("no time column in the actuals")
    value = value or _value_column(actual, {*keys, time})
    models = [c for c in ("model", "model_name") if c in forecast.columns and c not in keys]
    pos = F.row_number().over(group_window(keys).orderBy(F.col(quote(time))))
    right = actual.select(*[F.col(quote(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(quote(value)).cast("double").alias("_a"), pos.alias("_pos"))
    on = F.col(quote(step)) == F.col("_pos")
    for i, k in enumerate(keys):
        on = on & F.col(quote(k)).eqNullSafe(F.col(f"_k{i}"))
    rows = forecast.select(*cols(models), *cols(keys), F.col(quote(step)), F.col(quote(mean)).cast("double").alias("_f")).join(right, on)
    rows = rows.withColumn("_e", F.col("_a") - F.col("_f"))
    per = Window.partitionBy(*cols([*models, *keys]), F.lit(1))
    rows = rows.withColumn("_m", F.avg("_e").over(per)).withColumn("_next", F.lead("_e").over(per.orderBy(quote(step))))
    share = F.when(F.col("_a") != 0, 100 * F.col("_e") / F.col("_a"))
    den = F.sum((F.col("_e") - F.col("_m")) * (F.col("_e") - F.col("_m")))
    num = F.sum((F.col("_e") - F.col("_m")) * (F.col("_next") - F.col("_m")))
    out = rows.groupBy(*cols([*models, *keys])).agg(
        F.avg("_e").alias("ME"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("RMSE"),
        F.avg(F.abs("_e")).alias("MAE"),
        F.avg(share).alias("MPE"),
        F.avg(F.abs(share)).alias("MAPE"),
        F.when(den > 0, num / den).alias("ACF1"),
    )
    if training is None:
        return out.withColumn("MASE", F.lit(None).cast("double"))
    tt = time if time in training.columns else next((c for c in TIME_NAMES if c in training.columns), None)
    check_known(training, [*keys, value, *([tt] if tt else [])])
    y = F.col(quote(value)).cast("double")
    d = F.abs(y - F.lag(y).over(group_window(keys).orderBy(F.col(quote(tt)))))
    scale = training.select(*[F.col(quote(k)).alias(f"_k{i}") for i, k in enumerate(keys)], d.alias("_d"))
    scale = scale.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.avg("_d").alias("_scale"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(quote(k)).eqNullSafe(F.col(f"_k{i}"))
    joined = out.join(scale, on, "left") if keys else out.crossJoin(F.broadcast(scale))
    return joined.withColumn("MASE", F.when(F.col("_scale") > 0, F.col("MAE") / F.col("_scale"))).select(*visible(out), "MASE")


def evaluation_metrics(df: DataFrame, actual: str, predicted: str, *, order: str, keys=()) -> DataFrame:
    """(keys, mse, mae, mar, msr) of two columns of every series.

    ``mar`` and ``msr`` add up the absolute and squared distances of the prediction from the running mean of the actual values,
    which over the first 30 percent of the rows is the mean of these rows.  Any missing value makes them null.
    """
    check_known(df, [actual, predicted, order, *keys])
    whole = group_window(keys)
    a, p = (F.col(quote(c)).cast("double") for c in (actual, predicted))
    w = whole.orderBy(F.col(quote(order)))
    rows = df.select(*cols(keys), a.alias("_a"), p.alias("_p"), F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"), F.avg(a).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_mean"))
    first = F.ceil(F.col("_n") * 0.3)
    rows = rows.withColumn("_first", F.max(F.when(F.col("_i") == first, F.col("_mean"))).over(whole))
    rows = rows.withColumn("_e", F.col("_a") - F.col("_p")).withColumn("_r", F.col("_p") - F.when(F.col("_i") <= first, F.col("_first")).otherwise(F.col("_mean")))
    ok = F.count("_e") == F.count(F.lit(1))
    made = {"mse": F.avg(F.col("_e") * F.col("_e")), "mae": F.avg(F.abs("_e")), "mar": F.sum(F.abs("_r")), "msr": F.sum(F.col("_r") * F.col("_r"))}
    return rows.groupBy(*cols(keys)).agg(*[F.when(ok, c).alias(n) for n, c in made.items()])
