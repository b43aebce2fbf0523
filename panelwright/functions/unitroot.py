"""Tests for unit roots of every series of a table, as plans.

A regression on lagged columns is one pass of moments: the sums of products of its columns, which are partial aggregates,
and a sweep of the small matrix they make.  Long-run variances with Bartlett weights are sums of squared moving sums
of the residuals: each running sum is sent to its own row and, negated, to the row where it leaves the window, so that
they meet by (series, row) whatever the window of a series.  No series is gathered into a row or a task's memory.

Every function takes a table, a column, ``order`` and ``keys``, leaves missing values out first, and returns one row per
series; a series that is too short has nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.local import seasonal_strength
from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, joined, quote


def interpolated(x: Column, xs: list, ys: list) -> Column:
    """Straight lines through the points (xs, ys), ascending; beyond them the last values."""
    out = F.when(x <= xs[0], ys[0])
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= b, c + (d - c) * (x - a) / (b - a))
    return out.otherwise(ys[-1])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda's variable is bound before its body runs."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- regression by moments -------------------------------------------------------------------------------------


def moments(values: list[Column]) -> Column:
    """Aggregate: the matrix of sums of products."""
    n = len(values)
    sums = {(i, j): F.sum(values[i] * values[j]) for i in range(n) for j in range(i, n)}
    return F.array(*[F.array(*[sums[min(i, j), max(i, j)] for j in range(n)]) for i in range(n)])


def chosen(matrix: Column, keep) -> Column:
    """The rows and columns of a matrix for which ``keep(index)`` holds."""
    return F.transform(F.filter(matrix, lambda _, i: keep(i)), lambda row: F.filter(row, lambda _, j: keep(j)))


def swept(matrix: Column, pivots: Column) -> Column:
    """The matrix after a sweep of ``pivots``; one that the others explain is passed over."""

    def step(m, k):
        row = F.get(m, k)
        return let(F.struct(m.alias("m"), row.alias("row"), F.get(row, k).alias("d"), k.alias("k")), lambda v: F.when(v["d"] > 1e-13, F.transform(
            v["m"], lambda r, i: let(F.get(r, v["k"]), lambda f: F.transform(r, lambda x, j: F.when((i == v["k"]) & (j == v["k"]), -1 / v["d"])
                .when(i == v["k"], x / v["d"]).when(j == v["k"], f / v["d"]).otherwise(x - f * F.get(v["row"], j) / v["d"])))
        )).otherwise(v["m"]))

    return F.aggregate(pivots, matrix, step)


def regression(matrix: Column, without: Column | None = None) -> Column:
    """struct(beta, inverse, rss): the last column of the moments regressed on the others.

    ``inverse`` is the diagonal of the inverted moments, ``without`` an array of columns that stay out.  The columns
    are scaled to unit length first.
    """
    def solve(p):
        m, scale = p["m"], p["scale"]
        last = F.size(m) - 1
        use = F.sequence(F.lit(0), last - 1)
        if without is not None:
            use = F.array_except(use, without)
        unit = F.transform(m, lambda r, i: F.transform(r, lambda x, j: F.coalesce(F.try_divide(x, F.get(scale, i) * F.get(scale, j)), F.lit(0.0))))
        return let(F.struct(swept(unit, use).alias("s"), scale.alias("scale"), last.alias("last")), lambda v: F.struct(
            F.transform(F.sequence(F.lit(0), v["last"] - 1), lambda i: F.try_divide(F.get(F.get(v["s"], i), v["last"]) * F.get(v["scale"], v["last"]), F.get(v["scale"], i))).alias("beta"),
            F.transform(F.sequence(F.lit(0), v["last"] - 1), lambda i: F.try_divide(-F.get(F.get(v["s"], i), i), F.get(v["scale"], i) * F.get(v["scale"], i))).alias("inverse"),
            (F.get(F.get(v["s"], v["last"]), v["last"]) * F.get(v["scale"], v["last"]) * F.get(v["scale"], v["last"])).alias("rss"),
        ))

    return let(F.struct(matrix.alias("m"), F.transform(matrix, lambda r, i: F.sqrt(F.get(r, i))).alias("scale")), solve)


# --- series ----------------------------------------------------------------------------------------------------


def present(df: DataFrame, column: str, order: str, keys) -> DataFrame:
    """keys, _t (row of the series from 1), _n, _y: the values that are there."""
    check_known(df, [column, order, *keys])
    y = F.col(quote(column)).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*cols(keys), F.col(quote(order)).alias("_o"), y.alias("_y"))
    whole = group_window(keys)
    return rows.select(*cols(keys), F.row_number().over(whole.orderBy("_o")).cast("long").alias("_t"), F.count(F.lit(1)).over(whole).alias("_n"), "_y")


def window_lag(lags: str | int, n: Column) -> Column:
    """The width of a Bartlett window: ``short``, ``long``, ``root`` (that of the number of differences), or a number."""
    power = F.pow(n / 100, F.lit(0.25))
    rules = {"short": 4 * power, "long": 12 * power, "root": 3 * F.sqrt(n) / 13}
    if isinstance(lags, str) and lags not in rules:
        raise ArgumentError("lags is short, long, root or a number")
    return F.floor(rules[lags] + 1e-12).cast("long") if isinstance(lags, str) else F.lit(int(lags)).cast("long")


def long_run(rows: DataFrame, keys) -> DataFrame:
    """(keys, _long): the Bartlett-weighted sum of squares of residuals ``_e``, which add up to nothing, over rows ``_t`` to ``_n``."""
    rows = rows.withColumn("_run", F.sum("_e").over(group_window(keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    both = F.array(F.struct(F.col("_t").alias("at"), F.col("_run").alias("v")), F.struct((F.col("_t") + F.col("_lag") + 1).alias("at"), (-F.col("_run")).alias("v")))
    ends = rows.select(*cols(keys), "_lag", F.explode(both).alias("_m"))
    sums = ends.groupBy(*cols(keys), "_lag", F.col("_m.at")).agg(F.sum("_m.v").alias("_v"))
    return sums.groupBy(*cols(keys)).agg((F.sum(F.col("_v") * F.col("_v")) / (F.first("_lag") + 1)).alias("_long"))


#: Critical values of the KPSS statistic at 10, 5, 2.5 and 1 %.
KPSS = {"level": (0.347, 0.463, 0.574, 0.739), "trend": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def kpss(df: DataFrame, column: str, *, order: str, keys=(), kind: str = "level", lags: str | int = "short") -> DataFrame:
    """(keys, statistic, lag, pvalue): stationarity around a level or a trend."""
    if kind not in KPSS:
        raise ArgumentError("kind is level or trend")
    rows = present(df, column, order, keys)
    whole = group_window(keys)
    e = F.col("_y") - F.avg("_y").over(whole)
    if kind == "trend":
        middle = F.col("_t") - (F.col("_n") + 1) / 2
        e = e - F.coalesce(F.try_divide(F.sum(F.col("_y") * middle).over(whole), F.sum(middle * middle).over(whole)), F.lit(0.0)) * middle
    rows = rows.withColumn("_e", e).withColumn("_lag", window_lag(lags, F.col("_n")))
    run = F.sum("_e").over(whole.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.withColumn("_run", run).groupBy(*cols(keys)).agg(F.sum(F.col("_run") * F.col("_run")).alias("_s"), F.count(F.lit(1)).alias("_n"), F.first("_lag").alias("lag"))
    found = joined(sums, long_run(rows, keys), keys)
    # a constant series has residuals of rounding errors only
    level = rows.groupBy(*cols(keys)).agg((F.sum(F.col("_e") * F.col("_e")) > 1e-24 * F.sum(F.col("_y") * F.col("_y"))).alias("_moves"))
    found = joined(found, level, keys)
    stat = F.when(F.col("_moves"), F.try_divide(F.col("_s"), F.col("_n") * F.col("_long"))).otherwise(0.0)
    found = found.withColumn("statistic", stat)
    return found.select(*cols(keys), "statistic", "lag", interpolated(F.col("statistic"), KPSS[kind], KPSS_LEVELS).alias("pvalue"))


#: Dickey-Fuller critical values of tau at 1, 5 and 10 % by number of observations.
ADF_ROWS = (25, 50, 100, 250, 500, 1e5)
ADF = {
    "none": ((-2.66, -1.95, -1.6), (-2.62, -1.95, -1.61), (-2.6, -1.95, -1.61), (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62)),
    "drift": ((-3.75, -3.0, -2.63), (-3.58, -2.93, -2.6), (-3.51, -2.89, -2.58), (-3.46, -2.88, -2.57), (-3.44, -2.87, -2.57), (-3.43, -2.86, -2.57)),
    "trend": ((-4.38, -3.6, -3.24), (-4.15, -3.5, -3.18), (-4.04, -3.45, -3.15), (-3.99, -3.43, -3.13), (-3.98, -3.42, -3.13), (-3.96, -3.41, -3.12)),
}
TAU_LEVELS = (0.01, 0.05, 0.10)


def adf(df: DataFrame, column: str, *, order: str, keys=(), kind: str = "drift", lags: int | str = 1, criterion: str | None = None) -> DataFrame:
    """(keys, statistic, lag, pvalue, critical_5 and phi1 or phi2 and phi3): augmented Dickey-Fuller.

    ``lags`` is a number, or ``cube`` for the cube root of a series' differences.  With a criterion (aic or bic) the number of
    lags from 0 to ``lags`` is chosen by it, all on the same rows.  ``phi1`` joins root and drift, ``phi2`` root, drift and
    trend, ``phi3`` root and trend.
    """
    if kind not in ADF or criterion not in (None, "aic", "bic") or (lags == "cube" and criterion):
        raise ArgumentError("kind is none, drift or trend; criterion is aic or bic, for a number of lags")
    rows = present(df, column, order, keys)
    if lags == "cube":
        rows = rows.withColumn("_lag", F.floor(F.pow(F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(1 / 3))).cast("int"))
        most = rows.agg(F.max("_lag")).first()[0] or 0
    else:
        most = int(lags)
        rows = rows.withColumn("_lag", F.lit(most))
    w = group_window(keys).orderBy("_t")
    rows = rows.withColumn("_back", F.lag("_y").over(w)).withColumn("_d", F.col("_y") - F.col("_back"))
    for j in range(1, most + 1):
        rows = rows.withColumn(f"_d{j}", F.lag("_d", j).over(w))
    fixed = [F.col("_back"), *([F.lit(1.0)] if kind != "none" else []), *([F.col("_t") - F.col("_n") / 2] if kind == "trend" else [])]
    used = F.col("_t") >= F.col("_lag") + 2
    values = [F.when(used, c) for c in (*fixed, *[F.coalesce(F.col(f"_d{j}"), F.lit(0.0)) for j in range(1, most + 1)], F.col("_d"))]
    sums = rows.groupBy(*cols(keys)).agg(moments(values).alias("_m"), F.count(values[-1]).alias("_rows"), F.first("_lag").alias("_lag"))
    base, last = len(fixed), len(fixed) + most

    def sub(k):
        return chosen(F.col("_m"), lambda i: (i < base + k) | (i == last))

    if criterion:
        def value(k):
            rss = regression(sub(k))["rss"]
            return F.col("_rows") * F.log(F.greatest(F.try_divide(rss, F.col("_rows")), F.lit(1e-300))) + (base + k) * (2 if criterion == "aic" else F.log("_rows"))

        best = F.array_min(F.array(*[F.struct(value(k).alias("v"), F.lit(k).alias("k")) for k in range(most + 1)]))["k"]
        sums = sums.withColumn("_lag", best)
    sums = sums.withColumn("_sub", sub(F.col("_lag"))).withColumn("_f", regression(F.col("_sub")))
    s2 = F.col("_f.rss") / F.greatest(F.col("_rows") - base - F.col("_lag"), F.lit(1))
    stat = F.get("_f.beta", 0) / F.sqrt(F.greatest(s2 * F.get("_f.inverse", 0), F.lit(1e-300)))
    critical = [interpolated(F.col("_rows"), list(ADF_ROWS), [row[k] for row in ADF[kind]]) for k in range(3)]
    sums = sums.withColumn("_s2", F.greatest(s2, F.lit(1e-300))).withColumn("statistic", F.when(F.col("_rows") >= 5, stat))
    joint = {"drift": {"phi1": (0, 1)}, "trend": {"phi2": (0, 1, 2), "phi3": (0, 2)}}.get(kind, {})
    phi = [
        F.when(F.col("statistic").isNotNull(), (regression(F.col("_sub"), F.array(*map(F.lit, out)))["rss"] - F.col("_f.rss")) / len(out) / F.col("_s2")).alias(name)
        for name, out in joint.items()
    ]
    p = F.when(F.col("statistic").isNotNull(), interpolated(F.col("statistic"), critical, TAU_LEVELS))
    return sums.select(*cols(keys), "statistic", F.col("_lag").cast("int").alias("lag"), p.alias("pvalue"), critical[1].alias("critical_5"), *phi)


#: MacKinnon's (2010) response surfaces of tau at 1, 5 and 10 %, in powers of 1/n, with a constant and with a trend.
MACKINNON = {
    "constant": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "trend": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}


def phillips_perron(df: DataFrame, column: str, *, order: str, keys=(), kind: str = "constant", lags: str | int = "short") -> DataFrame:
    """(keys, statistic, alpha, lag, pvalue, critical_5): Z-tau of Phillips and Perron, and Z-alpha, which has no p-value."""
    if kind not in MACKINNON:
        raise ArgumentError("kind is constant or trend")
    rows = present(df, column, order, keys)
    w = group_window(keys).orderBy("_t")
    # of a single value nothing is left to fit
    rows = rows.withColumn("_x", F.lag("_y").over(w)).where("_t > 1 OR _n = 1").withColumn("_t", F.col("_t") - 1).withColumn("_n", F.col("_n") - 1)
    trend = [F.col("_t") - F.col("_n") / 2] if kind == "trend" else []
    x = [F.col("_x"), F.lit(1.0), *trend]
    t, y, n = F.col("_t").cast("double"), F.col("_y"), F.nullif(F.col("_n"), F.lit(0))
    sums = rows.groupBy(*cols(keys)).agg(
        moments([*x, y]).alias("_m"), F.first("_n").alias("_n"), F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy"), F.sum(t * y).alias("_sty"), F.var_pop(y).alias("_v"),
    ).withColumn("_f", regression(F.col("_m")))
    back = joined(rows, sums.select(*cols(keys), "_f"), keys)
    e = y
    for j, c in enumerate(x):
        e = e - F.get("_f.beta", j) * c
    back = back.withColumn("_e", e).withColumn("_lag", window_lag(lags, n))
    found = joined(sums, long_run(back, keys), keys)
    short, long = F.col("_f.rss") / n, F.col("_long") / n
    if kind == "trend":
        ramp, level = F.col("_sty") / F.pow(n, F.lit(2.5)), F.col("_sy") / F.pow(n, F.lit(1.5))
        spread = (1 - 1 / (n * n)) * F.col("_syy") / (n * n) - 12 * ramp * ramp + 12 * (1 + 1 / n) * ramp * level - (4 + 6 / n + 2 / (n * n)) * level * level
    else:
        spread = F.col("_v") / n
    b = F.get("_f.beta", 0)
    found = found.withColumn("_short", short).withColumn("_lr", long).withColumn("_spread", spread)
    se = F.sqrt(F.try_divide(F.col("_f.rss"), n - len(x)) * F.get("_f.inverse", 0))
    tau = F.sqrt(F.try_divide("_short", "_lr")) * F.try_divide(b - 1, se) - F.try_divide(F.col("_lr") - F.col("_short"), 2 * F.sqrt("_lr") * F.sqrt("_spread"))
    alpha = n * (b - 1) - F.try_divide(F.col("_lr") - F.col("_short"), 2 * F.col("_spread"))
    critical = [sum(v / F.pow(n, F.lit(float(k))) for k, v in enumerate(row)) for row in MACKINNON[kind]]
    enough = n >= 4
    found = found.withColumn("statistic", F.when(enough, tau))
    return found.select(
        *cols(keys), "statistic", F.when(enough, alpha).alias("alpha"), window_lag(lags, n).alias("lag"),
        F.when(F.col("statistic").isNotNull(), interpolated(F.col("statistic"), critical, TAU_LEVELS)).alias("pvalue"), critical[1].alias("critical_5"),
    )


# --- seasonal roots --------------------------------------------------------------------------------------------


def ocsb(df: DataFrame, column: str, m: int, *, order: str, keys=(), lags: int = 0, criterion: str | None = None) -> DataFrame:
    """(keys, statistic, critical, lag): seasonal unit root of Osborn, Chui, Smith and Birchenhall, with the critical value at 5 %.

    With a criterion (aic, bic or aicc) the regressions of 1 to ``lags`` lags are compared on the same rows; the test then has one lag
    less than the best of them and all the rows that this allows.
    """
    if m < 2 or criterion not in (None, "aic", "bic", "aicc"):
        raise ArgumentError("the period is at least 2; criterion is aic, bic or aicc")
    rows = present(df, column, order, keys)
    w = group_window(keys).orderBy("_t")
    rows = rows.withColumn("_d", F.col("_y") - F.lag("_y").over(w)).withColumn("_s", F.col("_y") - F.lag("_y", m).over(w))
    rows = rows.withColumn("_b", F.col("_d") - F.lag("_d", m).over(w))
    back = lambda name, j: F.lag(name, j).over(w)
    rows = rows.select(
        *cols(keys), "_t", "_n", "_b", F.array(*[back("_b", j) for j in range(1, lags + 1)]).alias("_lb"),
        F.array(*[back("_s", 1 + j) for j in range(lags + 1)]).alias("_ls"), F.array(*[back("_d", m + j) for j in range(lags + 1)]).alias("_ld"),
    )

    def test(k: int, first: int, tag: str) -> DataFrame:
        """The regression of k lags on the rows that ``first`` lags leave."""
        some = rows.where(F.col("_t") >= m + 2 + first)
        lagged = [F.get("_lb", j) for j in range(k)]
        if k:
            ar = some.groupBy(*cols(keys)).agg(regression(moments([*lagged, F.col("_b")]))["beta"].alias("_phi"))
            some = joined(some, ar, keys)
        clean = lambda name: F.get(name, 0) - sum((F.get("_phi", j) * F.get(name, j + 1) for j in range(k)), F.lit(0.0))
        some = some.withColumn("_z4", clean("_ls")).withColumn("_z5", clean("_ld"))
        found = some.groupBy(*cols(keys)).agg(regression(moments([*lagged, F.col("_z4"), F.col("_z5"), F.col("_b")])).alias("_f"), F.count(F.lit(1)).alias("_rows"))
        n, rss, size = F.col("_rows"), F.col("_f.rss"), k + 2
        t = F.try_divide(F.get("_f.beta", k + 1), F.sqrt(F.try_divide(rss, n - size) * F.get("_f.inverse", k + 1)))
        base = n * (math.log(2 * math.pi) + 1 + F.log(F.greatest(rss / n, F.lit(1e-300))))
        penalty = {"bic": F.log(n) * (size + 1)}.get(criterion, F.lit(2.0 * (size + 1)))
        if criterion == "aicc":
            penalty = penalty + F.try_divide(F.lit(2 * (size + 1) * (size + 2)), n - size - 2)
        return found.select(*cols(keys), F.when(n > size, t).alias(f"_t{tag}"), (base + penalty).alias(f"_v{tag}"))

    out = rows.groupBy(*cols(keys)).agg(F.first("_n").alias("_n"))
    if criterion and lags:
        for k in range(1, lags + 1):
            out = joined(out, test(k, lags, f"c{k}"), keys)
        best = F.array_min(F.array(*[F.struct(F.col(f"_vc{k}").alias("v"), F.lit(k).alias("k")) for k in range(1, lags + 1)]))["k"]
        out = out.withColumn("lag", best - 1)
        stat = F.lit(None).cast("double")
        for k in range(lags):
            out = joined(out, test(k, k, f"f{k}"), keys)
            stat = F.when(F.col("lag") == k, F.col(f"_tf{k}")).otherwise(stat)
    else:
        out = joined(out, test(lags, lags, "f"), keys).withColumn("lag", F.lit(lags))
        stat = F.col("_tf")
    log = math.log(m) - 0.7656451
    # The published response curve of the critical value.
    critical = -0.2937411 * math.exp(-0.2850853 * log - 0.05983644 * log**2) - 1.652202
    return out.select(*cols(keys), F.when(F.col("_n") >= 2 * m + 6 + lags, stat).alias("statistic"), F.lit(critical).alias("critical"), "lag")


# --- numbers of differences ------------------------------------------------------------------------------------


def _levels(df: DataFrame, column: str, order: str, keys, lag: int, most: int) -> DataFrame:
    """keys, _level, _o, _v: the series and its differences, up to ``most`` times, as series of their own."""
    rows = present(df, column, order, keys)
    w = group_window(keys).orderBy("_t")
    rows = rows.withColumn("_v0", F.col("_y"))
    for d in range(1, most + 1):
        rows = rows.withColumn(f"_v{d}", F.col(f"_v{d - 1}") - F.lag(f"_v{d - 1}", lag).over(w))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.col(f"_v{d}").alias("v")) for d in range(most + 1)]))
    out = rows.select(*cols(keys), F.col("_t").alias("_o"), each.alias("_e"))
    return out.select(*cols(keys), F.col("_e.level").alias("_level"), "_o", F.col("_e.v").alias("_v")).where("_v IS NOT NULL")


def _first_stop(levels: DataFrame, tested: DataFrame, keys, most: int, least_rows: int) -> DataFrame:
    """(keys, value): the first level that is constant, too short, the last, or needs no further difference (``_more`` false)."""
    shape = levels.groupBy(*cols(keys), "_level").agg(F.count(F.lit(1)).alias("_rows"), (F.max("_v") == F.min("_v")).alias("_flat"))
    whole = joined(shape, tested, [*keys, "_level"])
    stop = (F.col("_level") == most) | F.col("_flat") | ((F.col("_level") > 0) & (F.col("_rows") < least_rows)) | ~F.coalesce("_more", F.lit(False))
    return whole.where(stop).groupBy(*cols(keys)).agg(F.min("_level").cast("int").alias("value"))


def ndiffs(df: DataFrame, column: str, *, order: str, keys=(), alpha: float = 0.05, test: str = "kpss", max_d: int = 2) -> DataFrame:
    """(keys, value): differences until the test (kpss, adf or pp) takes a series for stationary."""
    alpha = min(max(alpha, 0.01), 0.1)
    levels = _levels(df, column, order, keys, 1, max_d)
    by = dict(order="_o", keys=(*keys, "_level"))
    if test == "kpss":
        found, more = kpss(levels, "_v", lags="root", **by), F.col("pvalue") < alpha
    elif test == "adf":
        found, more = adf(levels, "_v", lags="cube", **by), F.col("pvalue") > alpha
    elif test == "pp":
        found, more = phillips_perron(levels, "_v", **by), F.col("pvalue") > alpha
    else:
        raise ArgumentError("test is kpss, adf or pp")
    return _first_stop(levels, found.select(*cols(keys), "_level", more.alias("_more")), keys, max_d, 4)


def nsdiffs(df: DataFrame, column: str, m: int, *, order: str, keys=(), test: str = "seas", max_d: int = 1) -> DataFrame:
    """(keys, value): seasonal differences, by a seasonal strength above 0.64 or by the OCSB test."""
    if test not in ("seas", "ocsb"):
        raise ArgumentError("test is seas or ocsb")
    if m <= 1:
        return present(df, column, order, keys).groupBy(*cols(keys)).agg(F.lit(0).alias("value"))
    levels = _levels(df, column, order, keys, m, max_d)
    by = dict(order="_o", keys=(*keys, "_level"))
    if test == "seas":
        found, more = seasonal_strength(levels, "_v", m, **by), F.col("value") > 0.64
    else:
        found, more = ocsb(levels, "_v", m, lags=3, criterion="aic", **by), F.col("statistic") > F.col("critical")
    # a level of at most two periods is not tested
    return _first_stop(levels, found.select(*cols(keys), "_level", more.alias("_more")), keys, max_d, 2 * m + 1)
