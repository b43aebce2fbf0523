"""Local regression and the seasonal decompositions built on it, as window expressions.

A fit at a row is a weighted mean or line through the rows near it.  What is near lies in a row frame; its weighted moments
(weights, positions, values and their products) are summed there, so a fit costs its span and no more, and only every
``jump``-th row is fitted: the others lie on straight lines between.  Cycle-subseries are partitions by series and phase.
All windows of a series share its one shuffle.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.series import over, smooth_trend
from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, quote
from panelwright.plans.stored import cut


#: Sums over the points of a frame, weighted by tricube weights of their distance from the spot: 1 next to the spot and 0 from the
#: width on, each within a thousandth.  Text, since a tree of lambdas is built call by call.
MOMENTS = """aggregate(transform(filter(p.points, r -> r.x > p.left and r.x <= p.left + p.q), r -> named_struct('d', double(r.x - p.spot), 'y', r.y,
  'k', r.w * transform(array(abs(r.x - p.spot) / p.width), u -> case when u <= 0.001 then 1D when u <= 0.999 then pow(1 - u * u * u, 3D) else 0D end)[0])),
  named_struct('w', 0D, 'x', 0D, 'y', 0D, 'xx', 0D, 'xy', 0D),
  (s, v) -> named_struct('w', s.w + v.k, 'x', s.x + v.k * v.d, 'y', s.y + v.k * v.y, 'xx', s.xx + v.k * v.d * v.d, 'xy', s.xy + v.k * v.d * v.y), """
MEAN = "s -> try_divide(s.y, s.w))"
LINE = """s -> if(s.w > 0, transform(array(named_struct('at', s.x / s.w, 'mean', s.y / s.w, 'spread', s.xx / s.w - pow(s.x / s.w, 2D), 'both', s.xy / s.w)),
  f -> f.mean - f.at * if(sqrt(greatest(f.spread, 0D)) > 0.001D * (p.n - 1), (f.both - f.at * f.mean) / f.spread, 0D))[0], null))"""


def loess(df: DataFrame, y: str, name: str, *, part: list[Column], order: str, x: str, n: str, span: int | Column, degree: int, jump: int = 1, weight: str | None = None, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """``name``: local regression of ``y`` over positions ``x``, 1 to ``n`` within ``part``.

    Rows with a null ``y`` hold no data and are fitted all the same: they stand at most one position outside.  ``span`` is a
    number of points; a column stands for more than there are, and then only both ends are fitted.  Spots are
    ``first`` (default 1), every ``jump``-th position after it, and ``last`` (default ``n``).
    """
    wide = isinstance(span, Column)
    w = Window.partitionBy(*part).orderBy(order)
    rows, spot = F.col(n), F.col(x)
    first, last = F.lit(1) if first is None else first, rows if last is None else last
    points = F.collect_list(F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))))
    reach = points.over(Window.partitionBy(*part) if wide else w.rowsBetween(-span, span))
    spans = span if wide else F.lit(span)
    q = F.least(spans, rows)
    left = F.greatest(F.lit(0), F.least(spot - 1 - F.floor((q - 1) / 2), rows - q))
    width = F.greatest(spot - left - 1, left + q - spot) + F.when(spans > rows, F.floor((spans - rows) / 2)).otherwise(0)

    is_spot = (spot == last) | ((spot == first) if wide else ((spot - first) % jump == 0))
    df = df.withColumns({"__points": reach, "__left": left, "__q": q, "__width": F.when(width > 0, width).otherwise(1).cast("double"), "__spot": is_spot})
    given = f"named_struct('spot', `{x}`, 'left', __left, 'q', __q, 'n', `{n}`, 'points', __points, 'width', __width)"
    # where no point has weight the value itself stands
    fit = F.expr(f"if(__spot, coalesce(element_at(transform(array({given}), p -> {MOMENTS}{LINE if degree else MEAN}), 1), `{y}`), null)")
    df = df.withColumn("__fit", fit).drop("__points", "__left", "__q", "__width", "__spot")
    if wide or jump > 1:
        at = F.when(F.col("__fit").isNotNull(), F.struct(spot.alias("x"), F.col("__fit").alias("y")))
        before, behind = (w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*part)) if wide else (w.rowsBetween(-jump, 0), w.rowsBetween(0, jump))
        df = df.withColumn("__a", F.last(at, ignorenulls=True).over(before))
        df = df.withColumn("__b", F.max(at).over(behind) if wide else F.first(at, ignorenulls=True).over(behind))
        a, b = F.col("__a"), F.col("__b")
        between = a["y"] + F.try_divide((b["y"] - a["y"]) * (spot - a["x"]), b["x"] - a["x"])
        df = df.withColumn("__fit", F.coalesce("__fit", between)).drop("__a", "__b")
    return df.withColumn(name, F.col("__fit")).drop("__fit")


def next_odd(value: float) -> int:
    k = math.ceil(value)
    return k if k % 2 else k + 1


def stl(df: DataFrame, column: str, m: int, *, order: str, keys=(), seasonal_window: int | str = "periodic", seasonal_degree: int = 0, trend_window: int | None = None, trend_degree: int = 1, lowpass_window: int | None = None, lowpass_degree: int | None = None, robust: bool = False, inner: int | None = None, outer: int | None = None) -> DataFrame:
    """Adds ``seasonal``, ``trend``, ``remainder`` and, if ``robust``, ``weight``: seasonal-trend decomposition by local regression.

    A series has more than two periods and no missing value; the columns are null for others.  ``robust`` weighs rows by
    bisquare weights of their remainders and cuts the plan after every such round.
    """
    if m < 2 or seasonal_degree not in (0, 1) or trend_degree not in (0, 1):
        raise ArgumentError("the period is at least 2, degrees are 0 or 1")
    check_known(df, [column, order, *keys])
    periodic = seasonal_window == "periodic"
    season = None if periodic else int(seasonal_window)
    degree = 0 if periodic else seasonal_degree
    trend_span = trend_window or next_odd(1.5 * m / (1 - 1.5 / season) if season else 1.5 * m * (1 + 1e-9))
    low_span = lowpass_window or next_odd(m)
    low_degree = trend_degree if lowpass_degree is None else lowpass_degree
    inner = inner if inner is not None else (1 if robust else 2)
    outer = outer if outer is not None else (15 if robust else 0)
    series = cols(keys) if keys else [F.lit(1)]
    whole = group_window(keys)
    value = F.col(quote(column)).cast("double")
    whole_rows = F.count(F.when(~F.isnan(value), value)).over(whole)
    df = df.withColumn("__i", F.row_number().over(over(order, keys)).cast("long")).withColumn("__n", F.count(F.lit(1)).over(whole))
    df = df.withColumn("__y", F.when((whole_rows == F.col("__n")) & (F.col("__n") > 2 * m), value))
    df = df.withColumn("__t", F.lit(0.0)).withColumn("__w", F.lit(1.0)).withColumn("__s", F.lit(0.0))
    weight = "__w" if robust else None
    for rounds in range(outer + 1):
        for _ in range(inner):
            # one more cycle before and behind
            here = F.when(F.col("__i") == 1, F.sequence(1 - m + F.lit(0).cast("long"), F.when(F.col("__n") == 1, F.lit(1 + m).cast("long")).otherwise(F.lit(1).cast("long"))))
            here = here.when(F.col("__i") == F.col("__n"), F.sequence(F.col("__n"), F.col("__n") + m)).otherwise(F.array("__i"))
            df = df.withColumn("__g", F.explode(here)).withColumn("__own", F.col("__g") == F.col("__i"))
            df = df.withColumn("__d", F.when(F.col("__own"), F.col("__y") - F.col("__t")))
            df = df.withColumn("__p", F.pmod(F.col("__g") - 1, F.lit(m))).withColumn("__c", F.floor((F.col("__g") + m - 1) / m))
            phase = [*series, F.col("__p")]
            df = df.withColumn("__k", F.sum(F.col("__own").cast("long")).over(Window.partitionBy(*phase)))
            if periodic and not robust:
                df = df.withColumn("__cycle", F.avg("__d").over(Window.partitionBy(*phase)))
            else:
                df = loess(df, "__d", "__cycle", part=phase, order="__g", x="__c", n="__k", span=season or 10 * F.col("__n") + 1, degree=degree,
                           jump=max(1, math.ceil(season / 10)) if season else 1, weight=weight, first=F.lit(0), last=F.col("__k") + 1)
            w = Window.partitionBy(*series).orderBy("__g")
            df = df.withColumn("__a", F.avg("__cycle").over(w.rowsBetween(0, m - 1)))
            df = df.withColumn("__a", F.avg("__a").over(w.rowsBetween(0, m - 1)))
            df = df.withColumn("__a", F.avg("__a").over(w.rowsBetween(0, 2)))
            df = df.withColumn("__a", F.lag("__a", m).over(w)).where("__own")
            df = loess(df, "__a", "__low", part=series, order="__i", x="__i", n="__n", span=low_span, degree=low_degree, jump=max(1, math.ceil(low_span / 10)))
            df = df.withColumn("__s", F.col("__cycle") - F.col("__low")).withColumn("__d", F.col("__y") - F.col("__s"))
            df = loess(df, "__d", "__t", part=series, order="__i", x="__i", n="__n", span=trend_span, degree=trend_degree, jump=max(1, math.ceil(trend_span / 10)), weight=weight)
            df = df.drop("__g", "__own", "__d", "__p", "__c", "__k", "__cycle", "__a", "__low")
        if rounds < outer:
            # the median by ranks: a sort that spills, not a table of values
            df = df.withColumn("__r", F.abs(F.col("__y") - F.col("__s") - F.col("__t")))
            df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*series).orderBy("__r")))
            middle = F.col("__rank").isin(0) | (F.col("__rank") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__rank") == F.ceil((F.col("__n") + 1) / 2))
            df = df.withColumn("__r6", 6 * F.avg(F.when(middle, F.col("__r"))).over(whole))
            u = F.when(F.col("__r6") > 0, F.col("__r") / F.col("__r6")).otherwise(0.0)
            df = df.withColumn("__u", u).withColumn("__w", F.when(F.col("__u") <= 0.001, 1.0).when(F.col("__u") <= 0.999, F.pow(1 - F.col("__u") * F.col("__u"), F.lit(2.0))).otherwise(0.0))
            df = cut(df.drop("__r", "__rank", "__r6", "__u"))
    if periodic:
        df = df.withColumn("__s", F.avg("__s").over(Window.partitionBy(*series, F.pmod(F.col("__i") - 1, F.lit(m)))))
    df = df.withColumn("seasonal", F.when(F.col("__y").isNotNull(), F.col("__s"))).withColumn("trend", F.when(F.col("__y").isNotNull(), F.col("__t")))
    df = df.withColumn("remainder", F.col("__y") - F.col("seasonal") - F.col("trend"))
    if robust:
        df = df.withColumn("weight", F.col("__w"))
    return df.drop("__i", "__n", "__y", "__t", "__w", "__s")


def mstl(df: DataFrame, column: str, periods, *, order: str, keys=(), iterate: int = 2, robust: bool = False, windows: list[int] | None = None) -> DataFrame:
    """Adds ``trend``, ``seasonal_<period>`` for each period, and ``remainder``, by repeated ``stl``.

    A period is used in series of more than two of it; where none is, the seasonal parts are 0 and the trend is
    ``smooth_trend``.  Series with missing values get nulls.
    """
    check_known(df, [column, order, *keys])
    periods = sorted({int(p) for p in ([periods] if isinstance(periods, int) else periods)})
    windows = windows or [11 + 4 * k for k in range(6)]
    whole = group_window(keys)
    value = F.col(quote(column)).cast("double")
    kept = df.columns
    out = df.withColumn("__rows", F.count(F.lit(1)).over(whole)).withColumn("__full", F.count(F.when(~F.isnan(value), value)).over(whole) == F.col("__rows"))
    out = smooth_trend(out.withColumn("__x", value), "__x", order=order, keys=keys, name="__smooth")
    out = out.withColumn("__rest", F.when(F.col("__full"), F.col("__x"))).withColumn("__trend", F.when(F.col("__full"), F.col("__smooth")))
    for p in periods:
        out = out.withColumn(f"_seasonal_{p}", F.when(F.col("__full"), 0.0))
    good = [p for p in periods if p > 1]
    for loop in range(iterate if len(good) > 1 else 1):
        for k, p in enumerate(good):
            if loop or k:
                out = cut(out)
            out = out.withColumn("__rest", F.col("__rest") + F.col(f"_seasonal_{p}"))
            out = stl(out, "__rest", p, order=order, keys=keys, seasonal_window=windows[min(k, len(windows) - 1)], robust=robust)
            used = F.col("__rows") > 2 * p
            out = out.withColumn(f"_seasonal_{p}", F.when(used, F.col("seasonal")).otherwise(F.col(f"_seasonal_{p}")))
            out = out.withColumn("__trend", F.when(used, F.col("trend")).otherwise(F.col("__trend"))).withColumn("__rest", F.col("__rest") - F.col(f"_seasonal_{p}"))
            out = out.drop("seasonal", "trend", "remainder", "weight")
    names = [F.col("__trend").alias("trend"), *[F.col(f"_seasonal_{p}").alias(f"seasonal_{p}") for p in periods], (F.col("__rest") - F.col("__trend")).alias("remainder")]
    return out.select(*[quote(c) for c in kept], *names)


def seasonal_strength(df: DataFrame, column: str, m: int, *, order: str, keys=()) -> DataFrame:
    """(keys, value): 1 - var(remainder) / var(remainder + seasonal), within 0 and 1; 0 for series of at most two periods."""
    parts = mstl(df.select(*cols(keys), F.col(quote(order)), F.col(quote(column))), column, [m], order=order, keys=keys)
    rest, both = F.var_samp("remainder"), F.var_samp(F.col("remainder") + F.col(f"seasonal_{m}"))
    found = parts.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("__n"), rest.alias("__r"), both.alias("__b"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("__r", "__b")))
    return found.select(*cols(keys), F.when((F.col("__n") > 2 * m) & (F.col("__b") > 0), value).otherwise(0.0).alias("value"))
