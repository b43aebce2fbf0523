"""Gaps of a series filled through its seasons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.local import stl
from panelwright.functions.series import over
from panelwright.functions.unitroot import moments, regression
from panelwright.operators.frame import check_known, cols, group_window, joined, quote
from panelwright.operators.missing import interpolate_linear

#: Seasonal window of the decomposition that parts the seasons from the rest.
WINDOW = 11


def interpolate_seasonal(df: DataFrame, column: str, m: int, *, order: str, keys=(), linear: bool | None = None) -> DataFrame:
    """``column`` with its gaps filled by straight lines through the seasonally adjusted series.

    A first guess of the gaps is a cubic and up to five harmonics of the period, fitted to the present values by moments; the seasons
    are those of a decomposition of the series so completed.  Lines through the values themselves serve series of at most
    two periods or of at most two periods of present values, those without gaps, and series whose seasonal filling leaves the
    range of the values by half of it.  Ends take the nearest adjusted value.  A series without values stays empty.
    """
    check_known(df, [column, order, *keys])
    y = F.col(quote(column)).cast("double")
    rows = df.withColumn("__z", F.when(~F.isnan(y), y))
    lines = interpolate_linear(rows.withColumn("__line", F.col("__z")), "__line", order, tuple(keys))
    if linear or m <= 1:
        return lines.withColumn(column, F.col("__line")).drop("__z", "__line")
    whole = group_window(keys)
    rows = lines.withColumn("__at", F.row_number().over(over(order, keys))).withColumn("__all", F.count(F.lit(1)).over(whole)).withColumn("__ok", F.count("__z").over(whole))
    t = F.col("__at") - 1
    u = t / F.col("__all") - 0.5
    x: list[Column] = [F.lit(1.0), u, u * u, u * u * u]
    for j in range(1, min(m // 2, 5) + 1):
        angle = t * (2 * math.pi * j / m)
        x += [F.cos(angle)] if 2 * j == m else [F.sin(angle), F.cos(angle)]
    used = F.col("__z").isNotNull()
    fit = rows.groupBy(*cols(keys)).agg(regression(moments([F.when(used, c) for c in (*x, F.col("__z"))]))["beta"].alias("__beta"))
    rows = joined(rows, fit, keys)
    guess = x[0] * F.get("__beta", 0)
    for j, c in enumerate(x[1:], 1):
        guess = guess + c * F.get("__beta", j)
    rows = rows.withColumn("__guess", F.coalesce("__z", guess)).drop("__beta")
    # the decomposition names its parts seasonal, trend and remainder
    inner = stl(rows.select(*cols(keys), F.col("__at").alias("__o"), "__guess"), "__guess", m, order="__o", keys=keys, seasonal_window=WINDOW)
    inner = inner.select(*cols(keys), F.col("__o").alias("__at"), F.coalesce("seasonal", F.lit(0.0)).alias("__season"))
    rows = joined(rows, inner, [*keys, "__at"]).withColumn("__adjusted", F.col("__z") - F.col("__season"))
    rows = interpolate_linear(rows, "__adjusted", "__at", tuple(keys)).withColumn("__new", F.coalesce("__z", F.col("__adjusted") + F.col("__season")))
    low, high = F.min("__z").over(whole), F.max("__z").over(whole)
    half = (high - low) * 0.5
    rows = rows.withColumn("__out", F.max((F.col("__new") < low - half) | (F.col("__new") > high + half)).over(whole))
    seasonal = (F.col("__ok") > 2 * m) & (F.col("__ok") < F.col("__all")) & ~F.col("__out")
    if linear is False:
        seasonal = (F.col("__ok") < F.col("__all")) & ~F.col("__out")
    return rows.withColumn(column, F.when(seasonal, F.col("__new")).otherwise(F.col("__line"))).select(*[quote(c) for c in df.columns])
