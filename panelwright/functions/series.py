"""Order-dependent numeric functions of a series, as window expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, joined, quote


def over(order: str, keys=()) -> WindowSpec:
    """The series of a row in order."""
    return group_window(keys).orderBy(F.col(quote(order)))


def diff(df: DataFrame, column: str, *, order: str, keys=(), lag: int = 1, times: int = 1, name: str | None = None) -> DataFrame:
    """Lagged difference, ``times`` over.  The first ``lag`` cells of each pass are null; a series of no more than
    ``lag * times`` rows has no result."""
    if lag < 1 or times < 1:
        raise ArgumentError("lag and times must be positive")
    check_known(df, [column, order, *keys])
    w = over(order, keys)
    out = name or f"{column}_diff"
    df = df.withColumn(out, F.col(quote(column)).cast("double"))
    for _ in range(times):
        df = df.withColumn(out, F.col(quote(out)) - F.lag(quote(out), lag).over(w))
    return df


def diff_columns(df: DataFrame, columns: list[str], *, order: str, keys=(), lag: int = 1, times: int = 1) -> DataFrame:
    """``diff`` of several columns at once, as ``<column>_diff``: all in one pass over the series for each of ``times``."""
    if lag < 1 or times < 1 or not columns:
        raise ArgumentError("lag and times must be positive, and there must be columns")
    check_known(df, [*columns, order, *keys])
    w = over(order, keys)
    df = df.withColumns({f"{c}_diff": F.col(quote(c)).cast("double") for c in columns})
    for _ in range(times):
        df = df.withColumns({n: F.col(quote(n)) - F.lag(quote(n), lag).over(w) for n in (f"{c}_diff" for c in columns)})
    return df


def symmetric_weights(m: int) -> list[float]:
    """Weights of the centred moving average: an even period gets half weights at both ends."""
    return [1 / m] * m if m % 2 else [0.5 / m] + [1 / m] * (m - 1) + [0.5 / m]


def symmetric_filter(column: str, weights: list[float], w: WindowSpec) -> Column:
    """Centred weighted sum; null where the window leaves the series or holds a null."""
    if len(weights) % 2 == 0:
        raise ArgumentError("a symmetric filter has an odd number of weights")
    half = len(weights) // 2
    total = None
    for k, weight in enumerate(weights):
        at = k - half
        c = F.lag(quote(column), -at).over(w) if at < 0 else F.lead(quote(column), at).over(w) if at else F.col(quote(column))
        total = c * weight if total is None else total + c * weight
    return total


def symmetric_ma(df: DataFrame, column: str, m: int, *, order: str, keys=(), name: str = "ma") -> DataFrame:
    """Centred moving average of period m.  Sums over row frames: the plan doesn't grow with m."""
    if m < 1:
        raise ArgumentError("m must be positive")
    check_known(df, [column, order, *keys])
    w = over(order, keys)
    c = F.col(quote(column)).cast("double")
    half = m // 2

    def total(a, b):
        frame = w.rowsBetween(a, b)
        return F.when(F.count(c).over(frame) == b - a + 1, F.sum(c).over(frame))

    if m % 2:
        return df.withColumn(name, total(-half, half) / m)
    return df.withColumn(name, (total(-half, half - 1) + total(-half + 1, half)) / (2 * m))


def smooth_trend(df: DataFrame, column: str, *, order: str, keys=(), name: str = "trend") -> DataFrame:
    """Running mean over n / 10 rows, between 5 and 101; shorter at the ends.

    The window depends on the series' length, so each row averages what it needs of the 101 rows around it.
    """
    w = over(order, keys)
    whole = group_window(keys)
    c = F.col(quote(column)).cast("double")
    df = df.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__i", F.row_number().over(w).cast("long"))
    width = F.greatest(F.lit(3), F.least(F.col("__n"), F.greatest(F.lit(5), F.least(F.lit(101), F.floor(F.col("__n") / 10)))))
    # the window reaches 50 rows to either side at most: the rows around are held as one short array
    near = F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__c").alias("y"))).over(w.rowsBetween(-50, 50))
    df = df.withColumn("__h", F.floor((width - 1) / 2)).withColumn("__c", c).withColumn("__near", near)
    inside = F.filter("__near", lambda r: (F.abs(r["i"] - F.col("__i")) <= F.col("__h")) & r["y"].isNotNull())
    value = F.when(F.size(inside) > 0, F.aggregate(inside, F.lit(0.0), lambda a, r: a + r["y"]) / F.size(inside))
    return df.withColumn(name, value).drop("__n", "__i", "__h", "__c", "__near")


def embed(df: DataFrame, column: str, dimension: int, *, order: str, keys=()) -> DataFrame:
    """Lag matrix: ``lag0 .. lag<dimension-1>``, rows with a whole history only."""
    w = over(order, keys)
    for k in range(dimension):
        df = df.withColumn(f"lag{k}", F.lag(quote(column), k).over(w) if k else F.col(quote(column)))
    full = F.row_number().over(w) >= dimension
    return df.withColumn("_ok", full).where("_ok").drop("_ok")


def is_constant(column: str) -> Column:
    """Aggregate: all present values are equal."""
    c = F.col(quote(column))
    return F.coalesce(F.min(c) == F.max(c), F.lit(True))


def duplicated(df: DataFrame, column: str, *, order: str, keys=(), name: str = "duplicated") -> DataFrame:
    """Whether the value stood in an earlier row of the series."""
    w = Window.partitionBy(*cols([*keys, column])).orderBy(F.col(quote(order)))
    return df.withColumn(name, F.row_number().over(w) > 1)


def row_sums(*columns: str) -> Column:
    return sum((F.col(quote(c)) for c in columns[1:]), F.col(quote(columns[0])))


def col_sums(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the sum of each column, missing values left out."""
    check_known(df, columns)
    return df.agg(*[F.sum(F.when(~F.isnan(c), c)).alias(n) for n, c in ((n, F.col(quote(n)).cast("double")) for n in columns)])


def nearest_odd(value: float) -> int:
    """The odd number next to ``value``."""
    r = round(value)
    return r if r % 2 else r + 1


# --- transformations -------------------------------------------------------------------------------------------


def box_cox(c: Column, lam: float) -> Column:
    """Box-Cox transformation; a negative lambda gives null for negative values."""
    if lam == 0:
        return F.when(c > 0, F.log(c))
    power = (F.signum(c) * F.pow(F.abs(c), F.lit(float(lam))) - 1) / lam
    return F.when(c >= 0, power) if lam < 0 else power


def inv_box_cox(c: Column, lam: float, variance: Column | None = None) -> Column:
    """Inverse of ``box_cox``; with a variance the mean is adjusted for bias."""
    if lam == 0:
        out = F.exp(c)
    else:
        base = c * lam + 1
        inner = F.when(c <= -1 / lam, base) if lam < 0 else base
        out = F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / lam))
    if variance is None:
        return out
    return out * (1 + 0.5 * variance * (1 - lam) / F.pow(out, F.lit(2.0 * lam)))


def box_cox_by(c: Column, lam: Column) -> Column:
    """``box_cox`` of values above 0, with a parameter for each row."""
    return F.when(c > 0, F.when(lam == 0, F.log(c)).otherwise((F.pow(c, lam) - 1) / lam))


def inv_box_cox_by(c: Column, lam: Column, variance: Column | None = None) -> Column:
    """Inverse of ``box_cox_by``; null where no value above 0 leads to ``c``."""
    base = c * lam + 1
    out = F.when(lam == 0, F.exp(c)).when(base > 0, F.pow(base, 1 / lam))
    if variance is None:
        return out
    return out * (1 + 0.5 * variance * (1 - lam) / F.pow(out, 2 * lam))


def guerrero(df: DataFrame, column: str, m: int, *, order: str, keys=(), lower: float = -1.0, upper: float = 2.0) -> DataFrame:
    """(keys, value): the Box-Cox parameter with the least variation of the periods' scaled spread.

    Periods are whole ones up to the last row, of at least two rows.  Their means and deviations are one small table; the
    parameter is searched over ``STEPS`` values between the bounds and, three times over, over as many around the best, each time
    as one aggregation by (series, parameter).  Series of at most two periods get 1; with values that aren't positive
    the parameter isn't negative.
    """
    check_known(df, [column, order, *keys])
    whole, period = group_window(keys), max(2, m)
    y = F.col(quote(column)).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*cols(keys), F.col(quote(order)).alias("_o"), y.alias("_y"))
    rows = rows.select(*cols(keys), "_y", F.row_number().over(whole.orderBy("_o")).alias("_t"), F.count(F.lit(1)).over(whole).alias("_n"), F.min("_y").over(whole).alias("_least"))
    block = F.floor((F.col("_t") - 1 - F.col("_n") % period) / period)
    blocks = rows.withColumn("_b", block).where("_b >= 0").groupBy(*cols(keys), "_n", "_least", "_b").agg(F.avg("_y").alias("_mean"), F.stddev_samp("_y").alias("_sd"))
    low = F.when(F.col("_least") <= 0, F.lit(max(lower, 0.0))).otherwise(F.lit(float(lower)))
    blocks = blocks.withColumn("_from", low).withColumn("_to", F.lit(float(upper))).where(F.col("_n") > 2 * period)
    steps = F.sequence(F.lit(0), F.lit(STEPS))
    bounds = blocks.select(*cols(keys), "_from", "_to").distinct()
    for _ in range(4):
        at = joined(blocks.drop("_from", "_to"), bounds, keys)
        at = at.withColumn("_k", F.explode(steps)).withColumn("_lam", F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("_k") / STEPS)
        ratio = F.col("_sd") / F.pow("_mean", 1 - F.col("_lam"))
        at = at.withColumn("_ratio", F.when(~F.isnan(ratio), ratio))
        spread = F.try_divide(F.stddev_samp("_ratio"), F.avg("_ratio"))
        cv = at.groupBy(*cols(keys), "_lam", "_from", "_to").agg(F.coalesce(spread, F.lit(float("inf"))).alias("_cv"))
        best = cv.groupBy(*cols(keys), "_from", "_to").agg(F.min(F.struct("_cv", "_lam"))["_lam"].alias("_lam"))
        width = (F.col("_to") - F.col("_from")) / STEPS
        bounds = best.select(*cols(keys), F.greatest("_from", F.col("_lam") - width).alias("_from"), F.least("_to", F.col("_lam") + width).alias("_to"), "_lam")
        found, bounds = bounds, bounds.drop("_lam")
    short = rows.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= 2 * period)
    return found.select(*cols(keys), F.col("_lam").alias("value")).unionByName(short.select(*cols(keys), F.lit(1.0).alias("value")))


#: Parameters of one round of a search for lambda.
STEPS = 60


def loglik_lambda(df: DataFrame, column: str, m: int, *, order: str, keys=(), lower: float = -1.0, upper: float = 2.0) -> DataFrame:
    """(keys, value): the Box-Cox parameter of the largest profile likelihood around a line and seasons, on a grid of 0.05.

    Seasons are taken out as means of each (series, parameter, season), of the values and of time alike, and the line is then one
    of moments; so the grid is one aggregation after the other, whatever the length of a series.  A series with a
    value that isn't positive has none; series of at most two periods get 1.
    """
    check_known(df, [column, order, *keys])
    whole = group_window(keys)
    y = F.col(quote(column)).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*cols(keys), F.col(quote(order)).alias("_o"), y.alias("_y"))
    rows = rows.select(*cols(keys), "_y", F.row_number().over(whole.orderBy("_o")).alias("_t"), F.count(F.lit(1)).over(whole).alias("_n"), F.min("_y").over(whole).alias("_least"))
    rows = rows.withColumn("_log", F.when(F.col("_least") > 0, F.log("_y"))).withColumn("_mean", F.avg("_log").over(whole))
    grid = [round(k * 0.05, 2) for k in range(round(lower / 0.05), round(upper / 0.05) + 1)]
    x = F.col("_log")

    def scaled(lam: float) -> Column:
        power = (F.pow("_y", F.lit(lam)) - 1) / lam if abs(lam) > 0.02 else x * (1 + lam * x / 2 * (1 + lam * x / 3 * (1 + lam * x / 4)))
        return power / F.exp(F.col("_mean") * (lam - 1))

    long = rows.where((F.col("_n") > 2 * m) & (F.col("_least") > 0))
    long = long.select(*cols(keys), "_t", "_n", F.explode(F.array(*[F.struct(F.lit(g).alias("lam"), scaled(g).alias("z")) for g in grid])).alias("_p"))
    t = F.col("_t").cast("double")
    part = long.groupBy(*cols(keys), "_p.lam", (F.col("_t") % max(m, 1)).alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), F.var_pop("_p.z").alias("_vz"), F.covar_pop("_p.z", t).alias("_cz"), F.var_pop(t).alias("_vt"),
    )
    fit = part.groupBy(*cols(keys), "lam").agg(*[F.sum(F.col("_c") * F.col(c)).alias(c) for c in ("_vz", "_cz", "_vt")])
    rss = F.col("_vz") - F.col("_cz") * F.col("_cz") / F.col("_vt")
    best = fit.groupBy(*cols(keys)).agg(F.min(F.struct(rss.alias("rss"), "lam"))["lam"].alias("value"))
    short = rows.groupBy(*cols(keys)).agg(F.first("_n").alias("_n")).where(F.col("_n") <= 2 * m)
    return best.unionByName(short.select(*cols(keys), F.lit(1.0).alias("value")))


def box_cox_lambda(df: DataFrame, column: str, m: int = 1, *, order: str, keys=(), method: str = "guerrero", lower: float = -1.0, upper: float = 2.0) -> DataFrame:
    """(keys, value): the Box-Cox parameter of every series, by ``guerrero`` or ``loglik``."""
    methods = {"guerrero": guerrero, "loglik": loglik_lambda}
    if method not in methods:
        raise ArgumentError("method is guerrero or loglik")
    return methods[method](df, column, m, order=order, keys=keys, lower=lower, upper=upper)


def variance_of_bounds(level: float, lower: Column, upper: Column) -> Column:
    """The variance that ``inv_box_cox`` takes, from the bounds of an interval of ``level`` percent (or a share of 1)."""
    share = level / 100 if level > 1 else level
    if not 0 < share < 1:
        raise ArgumentError("level lies between 0 and 100")
    return F.pow((upper - lower) / (2 * NormalDist().inv_cdf((1 + share) / 2)), F.lit(2.0))


def fourier(df: DataFrame, m: float, k: int, *, order: str, keys=(), start: int = 0) -> DataFrame:
    """Columns S1, C1, .. Sk, Ck of the row's place in its series; the sine at the Nyquist frequency is left out."""
    if not 1 <= k <= m / 2:
        raise ArgumentError("k is between 1 and m / 2")
    df = df.withColumn("_t", F.row_number().over(over(order, keys)) + start)
    for j in range(1, k + 1):
        angle = F.col("_t") * (2 * math.pi * j / m)
        if 2 * j != m:
            df = df.withColumn(f"S{j}", F.sin(angle))
        df = df.withColumn(f"C{j}", F.cos(angle))
    return df.drop("_t")


# --- statistics of whole series --------------------------------------------------------------------------------


def autocovariances(df: DataFrame, column: str, *, order: str, keys=(), max_lag: int | None = None) -> DataFrame:
    """(keys, _n, _most, _g): sums of products of each series' deviations at lags 0 to ``_most``, as a short array.

    Missing values are left out first.  A product is one of a row and the row some lags before it, and sums are partial
    aggregates: no series is gathered.  Without ``max_lag`` the lags go to 10 log10 n; in any case they stay below n.
    """
    check_known(df, [column, order, *keys])
    whole = group_window(keys)
    y = F.col(quote(column)).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*cols(keys), F.col(quote(order)).alias("_o"), y.alias("_y"))
    if max_lag is None:
        longest = rows.groupBy(*cols(keys)).count().agg(F.max("count")).first()[0] or 0
        top = min(int(10 * math.log10(longest)), longest - 1) if longest else 0
    else:
        top = int(max_lag)
    w = whole.orderBy("_o")
    rows = rows.withColumn("_d", F.col("_y") - F.avg("_y").over(whole))
    back = [F.col("_d"), *[F.lag("_d", k).over(w) for k in range(1, top + 1)]]
    rows = rows.select(*cols(keys), "_d", *[c.alias(f"_d{k}") for k, c in enumerate(back)])
    sums = rows.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.col("_d") * F.col(f"_d{k}")) for k in range(top + 1)]).alias("_g"))
    most = F.least(F.lit(top) if max_lag is not None else F.floor(10 * F.log10("_n")).cast("int"), (F.col("_n") - 1).cast("int"))
    return sums.where("_n > 0").withColumn("_most", most)


def acf(df: DataFrame, column: str, *, order: str, keys=(), max_lag: int | None = None) -> DataFrame:
    """(keys, lag, value, ci): biased autocorrelations, those of a constant series 1; see ``autocovariances``."""
    sums = autocovariances(df, column, order=order, keys=keys, max_lag=max_lag).withColumn("_z", F.get("_g", 0))
    lags = sums.select(*cols(keys), "_n", "_g", "_z", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("lag"))
    value = F.when(F.col("_z") == 0, F.lit(1.0)).otherwise(F.try_divide(F.get("_g", F.col("lag")), F.col("_z")))
    return lags.select(*cols(keys), "lag", value.alias("value"), (F.lit(1.96) / F.sqrt("_n")).alias("ci"))


def pacf(df: DataFrame, column: str, *, order: str, keys=(), max_lag: int | None = None) -> DataFrame:
    """(keys, lag, value, ci): partial autocorrelations from lag 1, by Durbin and Levinson over the autocorrelations."""
    sums = autocovariances(df, column, order=order, keys=keys, max_lag=max_lag).where("_most > 0")
    sums = sums.withColumn("_r", F.transform("_g", lambda g: F.when(F.get("_g", 0) == 0, F.lit(1.0)).otherwise(g / F.get("_g", 0))))

    def dot(phi, r, k):
        """phi_1 r_(k-1) + .. + phi_(k-1) r_1"""
        return F.aggregate(F.transform(phi, lambda p, i: p * F.get(r, k - 1 - i)), F.lit(0.0), lambda a, x: a + x)

    def step(s, k):
        flat = F.transform(s["phi"], lambda p, i: p * F.get(F.col("_r"), i + 1))
        left = 1 - F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)
        a = F.when(left != 0, (F.get(F.col("_r"), k) - dot(s["phi"], F.col("_r"), k)) / left).otherwise(0.0)
        one = F.transform(F.array(F.struct(s.alias("s"), a.alias("a"))), lambda v: F.struct(
            F.concat(F.transform(v["s"]["phi"], lambda p, i: p - v["a"] * F.get(v["s"]["phi"], F.size(v["s"]["phi"]) - 1 - i)), F.array(v["a"])).alias("phi"),
            F.concat(v["s"]["out"], F.array(v["a"])).alias("out"),
        ))
        return F.element_at(one, 1)

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.col("_most")), start, step, lambda s: s["out"])
    ones = F.transform(F.sequence(F.lit(1), F.col("_most")), lambda _: F.lit(1.0))
    rows = sums.select(*cols(keys), "_n", F.posexplode(F.when(F.get("_g", 0) == 0, ones).otherwise(found)).alias("_k", "value"))
    return rows.select(*cols(keys), (F.col("_k") + 1).alias("lag"), "value", (F.lit(1.96) / F.sqrt("_n")).alias("ci"))


def decompose(df: DataFrame, column: str, m: int, *, order: str, keys=(), kind: str = "additive") -> DataFrame:
    """Classical decomposition: adds ``trend``, ``seasonal`` and ``remainder``; null where the average leaves the series.

    Series of fewer than two periods raise.
    """
    if kind not in ("additive", "multiplicative") or m < 2:
        raise ArgumentError("kind is additive or multiplicative, m at least 2")
    add = kind == "additive"
    whole = group_window(keys)
    y = F.col(quote(column)).cast("double")
    df = symmetric_ma(df, column, m, order=order, keys=keys, name="trend")
    df = df.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_p", (F.row_number().over(over(order, keys)) - 1) % m)
    short = F.when(F.col("_n") < 2 * m, F.raise_error(F.lit("a series has fewer than two periods")).cast("double"))
    detrended = y - F.col("trend") if add else F.when(F.col("trend") != 0, y / F.col("trend"))
    df = df.withColumn("_d", F.coalesce(short, detrended))
    df = df.withColumn("_s", F.avg("_d").over(Window.partitionBy(*cols(keys), F.col("_p"))))
    # the mean of the m seasonal means: each is weighted by one over its number of rows
    rows = F.count(F.lit(1)).over(Window.partitionBy(*cols(keys), F.col("_p")))
    centre = F.sum(F.col("_s") / F.col("_r")).over(whole) / m
    df = df.withColumn("_r", rows).withColumn("_c", centre)
    df = df.withColumn("seasonal", F.col("_s") - F.col("_c") if add else F.col("_s") / F.col("_c"))
    rest = y - F.col("seasonal") - F.col("trend") if add else y / (F.col("seasonal") * F.col("trend"))
    return df.withColumn("remainder", rest).drop("_n", "_p", "_d", "_s", "_r", "_c")


# --- adoption curves -------------------------------------------------------------------------------------------


def bass(t: Column, m: float, p: float, q: float) -> Column:
    """Cumulative adoption at t."""
    e = F.exp(-(p + q) * t)
    return m * (1 - e) / (1 + (q / p) * e)


def gompertz(t: Column, m: float, a: float, b: float) -> Column:
    return m * F.exp(-a * F.exp(-b * t))


def gsgompertz(t: Column, m: float, a: float, b: float, c: float) -> Column:
    e = F.exp(-b * t)
    return m * (1 - e) * F.pow(1 + a * e, F.lit(-float(c)))


def weibull(t: Column, m: float, a: float, b: float) -> Column:
    return m * (1 - F.exp(-F.pow(t / a, F.lit(float(b)))))
