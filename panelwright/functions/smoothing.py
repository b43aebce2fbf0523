"""Exponential smoothing of every series as plans: simple, linear and damped trends, and Croston's method.

Given its weights, a step of smoothing maps level and trend to a level and a trend, and is affine; the squared errors of a
run of rows are a quadratic form of the state before it.  So a block of ``BLOCK`` rows folds to a few numbers, blocks of a
long series are folded in parallel, and their maps are composed.  The form of the whole series gives the best
initial state in closed form, so only weights are searched: a grid of weights is exploded into rows, so that series x
weights is spread over tasks, the least error is an aggregate, and finer grids follow around it.

A fit is a row (keys, weights, first and last state, errors): a table that can be stored, and applied to new rows by
``update`` without a new search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.naive import _z
from panelwright.functions.levels import label, normalize_levels
from panelwright.operators.frame import ArgumentError, check_known, cols, group_window, joined, quote
from panelwright.operators.missing import longest_contiguous
from panelwright.operators.panel import Panel
from panelwright.plans.stored import cut

#: Rows that are folded as one block.
BLOCK = 512
#: Bounds of the weights of level and of trend, the latter as a share of the former, and of the damping.
WEIGHTS, DAMPING = (1e-4, 0.9999), (0.8, 0.98)
#: The first grid of each weight: closer near the ends, where errors bend most.
FIRST = {"alpha": (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0), "beta": (0.0, 0.05, 0.15, 0.3, 0.5, 0.75, 1.0), "phi": (0.8, 0.86, 0.92, 0.98)}
#: So many of its best points are followed, by ``ROUNDS`` grids of ``LATER`` points that reach ``REACH`` to either side, and half as far each time.
BEST, ROUNDS = 2, 6
LATER, REACH = {"alpha": 5, "beta": 5, "phi": 5}, {"alpha": 0.08, "beta": 0.2, "phi": 0.06}

KINDS = ("ses", "holt", "damped")
_FIELDS = ("p", "q", "k1", "k2", "r1", "r2", "c0", "c1", "c2", "c11", "c12", "c22")
_START = "named_struct('p', 0D, 'q', 0D, 'k1', 1D, 'k2', 0D, 'r1', 0D, 'r2', 1D, 'c0', 0D, 'c1', 0D, 'c2', 0D, 'c11', 0D, 'c12', 0D, 'c22', 0D)"
#: The state after a row, level p + k1 l + k2 b and trend q + r1 l + r2 b of the state (l, b) before the block, and its squared errors.
_FOLD = f"""aggregate(_ys, {_START}, (s, y) -> transform(array(named_struct('e', y - s.p - phi * s.q, 'u1', s.k1 + phi * s.r1, 'u2', s.k2 + phi * s.r2)), u -> named_struct(
  'p', y - (1 - alpha) * u.e, 'q', phi * s.q + alpha * beta * u.e, 'k1', (1 - alpha) * u.u1, 'k2', (1 - alpha) * u.u2,
  'r1', phi * s.r1 - alpha * beta * u.u1, 'r2', phi * s.r2 - alpha * beta * u.u2,
  'c0', s.c0 + u.e * u.e, 'c1', s.c1 - 2 * u.e * u.u1, 'c2', s.c2 - 2 * u.e * u.u2,
  'c11', s.c11 + u.u1 * u.u1, 'c12', s.c12 + 2 * u.u1 * u.u2, 'c22', s.c22 + u.u2 * u.u2))[0])"""
#: A block's map and form after those of the blocks before it.
_COMPOSE = f"""aggregate(_blocks, {_START}, (s, x) -> named_struct(
  'p', x.f.p + x.f.k1 * s.p + x.f.k2 * s.q, 'q', x.f.q + x.f.r1 * s.p + x.f.r2 * s.q,
  'k1', x.f.k1 * s.k1 + x.f.k2 * s.r1, 'k2', x.f.k1 * s.k2 + x.f.k2 * s.r2, 'r1', x.f.r1 * s.k1 + x.f.r2 * s.r1, 'r2', x.f.r1 * s.k2 + x.f.r2 * s.r2,
  'c0', s.c0 + x.f.c0 + x.f.c1 * s.p + x.f.c2 * s.q + x.f.c11 * s.p * s.p + x.f.c12 * s.p * s.q + x.f.c22 * s.q * s.q,
  'c1', s.c1 + (x.f.c1 + 2 * x.f.c11 * s.p + x.f.c12 * s.q) * s.k1 + (x.f.c2 + 2 * x.f.c22 * s.q + x.f.c12 * s.p) * s.r1,
  'c2', s.c2 + (x.f.c1 + 2 * x.f.c11 * s.p + x.f.c12 * s.q) * s.k2 + (x.f.c2 + 2 * x.f.c22 * s.q + x.f.c12 * s.p) * s.r2,
  'c11', s.c11 + x.f.c11 * s.k1 * s.k1 + x.f.c12 * s.k1 * s.r1 + x.f.c22 * s.r1 * s.r1,
  'c12', s.c12 + 2 * x.f.c11 * s.k1 * s.k2 + x.f.c12 * (s.k1 * s.r2 + s.k2 * s.r1) + 2 * x.f.c22 * s.r1 * s.r2,
  'c22', s.c22 + x.f.c11 * s.k2 * s.k2 + x.f.c12 * s.k2 * s.r2 + x.f.c22 * s.r2 * s.r2))"""
_DET = "4 * f.c11 * f.c22 - f.c12 * f.c12"


def _folded(blocks: DataFrame, keys) -> DataFrame:
    """(keys, alpha, beta, phi, f) over blocks (keys, _b, _ys) with weights."""
    rows = blocks.withColumn("f", F.expr(_FOLD))
    sizes = [*cols(keys), "alpha", "beta", "phi"]
    gathered = rows.groupBy(*sizes).agg(F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("_blocks"))
    return gathered.withColumn("f", F.expr(_COMPOSE)).drop("_blocks")


def _blocks(rows: DataFrame, keys, value: Column) -> DataFrame:
    """(keys, _b, _ys): the values of rows ``_t`` in order, at most ``BLOCK`` in a row."""
    at = rows.withColumn("_v", value).groupBy(*cols(keys), F.floor((F.col("_t") - 1) / BLOCK).alias("_b"))
    return at.agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda r: r["_v"]).alias("_ys"))


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Deal small rows out to ``spark.sql.shuffle.partitions`` tasks: adaptive execution leaves an explicit number alone, and would
    join them, with the work that their grids make, into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols(by))


def smooth(df: DataFrame, column: str, *, order: str, keys=(), kind: str = "ses", alpha: float | None = None, beta: float | None = None, phi: float | None = None) -> DataFrame:
    """(keys, alpha, beta, phi, level0, trend0, level, trend, sse, n, ahead): the best weights and states of every series.

    ``kind`` is ses, holt or damped.  ``beta`` is the weight of the trend as it enters the trend (at most ``alpha``).  Of a series with
    gaps the longest run of values is taken, and ``ahead`` rows lie behind it.  ``sse`` is null where there are too few values.
    """
    if kind not in KINDS:
        raise ArgumentError("kind is ses, holt or damped")
    check_known(df, [column, order, *keys])
    for name, given in (("alpha", alpha), ("beta", beta), ("phi", phi)):
        if given is not None and not 0 <= given <= 1:
            raise ArgumentError(f"{name} lies between 0 and 1")
    y = F.col(quote(column)).cast("double")
    rows = df.select(*cols(keys), F.col(quote(order)).alias("_o"), F.when(~F.isnan(y), y).alias("_y"))
    whole = group_window(keys)
    rows = rows.withColumn("_at", F.row_number().over(whole.orderBy("_o"))).withColumn("_rows", F.count(F.lit(1)).over(whole))
    every = rows.groupBy(*cols(keys)).agg(F.count("_y").alias("_values"))
    run = longest_contiguous(rows, "_y", "_at", tuple(keys)).select(*cols(keys), "_at", "_rows", "_y")
    run = run.withColumn("_t", F.row_number().over(whole.orderBy("_at"))).withColumn("_mean", F.avg("_y").over(whole))
    facts = run.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("n"), F.first("_mean").alias("_mean"), (F.first("_rows") - F.max("_at")).alias("ahead"))
    # deviations from the mean keep the forms well scaled
    blocks = cut(_blocks(run, keys, F.col("_y") - F.col("_mean")))
    share = None if beta is None else (0.0 if not alpha else beta / alpha)
    if beta is not None and alpha is None:
        raise ArgumentError("a given beta needs a given alpha")
    fixed = {"alpha": alpha, "beta": 0.0 if kind == "ses" else share, "phi": {"ses": 0.0, "holt": 1.0}.get(kind, phi)}
    bounds = {"alpha": WEIGHTS, "beta": WEIGHTS, "phi": DAMPING}
    free = [k for k, v in fixed.items() if v is None]
    grid = blocks
    for k, v in fixed.items():
        points = [min(max(x, bounds[k][0]), bounds[k][1]) for x in FIRST[k]] if v is None else [float(v)]
        grid = grid.withColumn(k, F.explode(F.array(*map(F.lit, points))))
        if k == "alpha":  # series x weights are dealt out, not series
            grid = _spread(grid, *keys, "_b", "alpha")

    def solve(folded: DataFrame, keys) -> DataFrame:
        """(keys, _s): errors, weights and states of every point."""
        solved = folded.withColumn("_det", F.expr(_DET))
        two = F.col("_det") > 1e-12 * F.col("f.c11") * F.col("f.c22")
        f = {c: F.col(f"f.{c}") for c in _FIELDS}
        l0 = F.when(two, (f["c12"] * f["c2"] - 2 * f["c22"] * f["c1"]) / F.col("_det")).otherwise(F.coalesce(F.try_divide(-f["c1"], 2 * f["c11"]), F.lit(0.0)))
        b0 = F.when(two, (f["c12"] * f["c1"] - 2 * f["c11"] * f["c2"]) / F.col("_det")).otherwise(0.0)
        solved = solved.withColumn("_l", l0).withColumn("_b0", b0)
        z1, z2 = F.col("_l"), F.col("_b0")
        sse = f["c0"] + f["c1"] * z1 + f["c2"] * z2 + f["c11"] * z1 * z1 + f["c12"] * z1 * z2 + f["c22"] * z2 * z2
        states = [z1.alias("level0"), z2.alias("trend0"), (f["p"] + f["k1"] * z1 + f["k2"] * z2).alias("level"), (f["q"] + f["r1"] * z1 + f["r2"] * z2).alias("trend")]
        return solved.select(*cols(keys), F.struct(F.greatest(sse, F.lit(0.0)).alias("sse"), "alpha", "beta", "phi", *states).alias("_s"))

    # a grid has a few hundred points at most
    leaders = solve(_folded(grid, keys), keys).groupBy(*cols(keys)).agg(F.slice(F.array_sort(F.collect_list("_s")), 1, BEST if free else 1).alias("_s"))
    leaders = leaders.select(*cols(keys), F.posexplode("_s").alias("_c", "_s"))
    reach = {k: REACH[k] for k in free}
    for _ in range(ROUNDS if free else 0):
        finer = joined(leaders.select(*cols(keys), "_c", *[F.col(f"_s.{k}").alias(k) for k in fixed]), blocks, keys)
        for k in free:
            lo, hi = bounds[k]
            at = [F.least(F.greatest(F.col(k) + reach[k] * (2 * i / (LATER[k] - 1) - 1), F.lit(lo)), F.lit(hi)) for i in range(LATER[k])]
            finer = finer.withColumn(k, F.explode(F.array_distinct(F.array(*at))))
            if k == free[0]:
                finer = _spread(finer, *keys, "_c", "_b", k)
        whole = (*keys, "_c")
        leaders = solve(_folded(finer, whole), whole).groupBy(*cols(whole)).agg(F.min("_s").alias("_s"))
        reach = {k: v / 2 for k, v in reach.items()}
    found = leaders.groupBy(*cols(keys)).agg(F.min("_s").alias("_s"))
    whole_fit = joined(joined(every, facts, keys), found, keys)
    enough = F.col("n") >= (2 if kind == "ses" else 3)
    s = {c: F.when(enough, F.col(f"_s.{c}")) for c in ("alpha", "beta", "phi", "level0", "trend0", "level", "trend", "sse")}
    return whole_fit.select(
        *cols(keys), s["alpha"].alias("alpha"), (s["alpha"] * s["beta"]).alias("beta"), s["phi"].alias("phi"),
        (s["level0"] + F.col("_mean")).alias("level0"), s["trend0"].alias("trend0"), (s["level"] + F.col("_mean")).alias("level"), s["trend"].alias("trend"),
        s["sse"].alias("sse"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ahead", F.lit(0)).alias("ahead"), F.lit(kind).alias("kind"), F.lit(len(free)).alias("free"),
    )


def update(fits: DataFrame, new: DataFrame, column: str, *, order: str, keys=()) -> DataFrame:
    """``fits`` after new rows of their series: states, errors and counts move on, weights stay.  New rows have no gaps; series
    without new rows stay as they are, those that were never fitted are left out."""
    y = F.col(quote(column)).cast("double")
    rows = new.where(y.isNotNull() & ~F.isnan(y)).select(*cols(keys), F.row_number().over(group_window(keys).orderBy(F.col(quote(order)))).alias("_t"), y.alias("_y"))
    rows = joined(rows, fits.select(*cols(keys), "alpha", F.coalesce(F.try_divide("beta", "alpha"), F.lit(0.0)).alias("beta"), "phi", F.col("level").alias("_base")), keys).where("alpha IS NOT NULL")
    blocks = rows.withColumn("_v", F.col("_y") - F.col("_base")).groupBy(*cols(keys), "alpha", "beta", "phi", F.floor((F.col("_t") - 1) / BLOCK).alias("_b"))
    blocks = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda r: r["_v"]).alias("_ys"), F.count(F.lit(1)).alias("_c"))
    count = blocks.groupBy(*cols(keys)).agg(F.sum("_c").alias("_c"))
    folded = joined(_folded(blocks.drop("_c"), keys).select(*cols(keys), "f"), count, keys)
    both = joined(fits, folded, keys)
    # the base is the level itself, so only the trend enters the maps
    b, moved = F.col("trend"), F.col("_c").isNotNull()
    changed = {
        "level": F.when(moved, F.col("level") + F.col("f.p") + F.col("f.k2") * b).otherwise(F.col("level")),
        "trend": F.when(moved, F.col("f.q") + F.col("f.r2") * b).otherwise(b),
        "sse": F.col("sse") + F.when(moved, F.col("f.c0") + F.col("f.c2") * b + F.col("f.c22") * b * b).otherwise(0.0),
        "n": F.col("n") + F.coalesce("_c", F.lit(0)),
        "ahead": F.when(moved, F.lit(0)).otherwise(F.col("ahead")),
    }
    return both.select(*[changed.get(c, F.col(quote(c))).alias(c) for c in fits.columns])


def project(fits: DataFrame, h: int, level=(80, 95), *, keys=(), model: str = "ses") -> DataFrame:
    """(keys, step, mean, bounds, model) of the next ``h`` rows of fitted series."""
    levels = normalize_levels(level)
    rows = fits.where("sse IS NOT NULL").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("_k", F.col("step") + F.col("ahead"))
    phi, damped = F.col("phi"), F.col("kind") == "damped"
    total = lambda k: F.when(damped, phi * (1 - F.pow(phi, k)) / (1 - phi)).when(F.col("kind") == "holt", k.cast("double")).otherwise(0.0)
    rows = rows.withColumn("mean", F.col("level") + total(F.col("_k")) * F.col("trend"))
    # the error of a step weighs level and trend of all steps before it
    c = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_k") - 1, F.lit(1))), lambda j: F.pow(F.col("alpha") + F.col("beta") * F.when(damped, (1 - F.pow(phi, j)) / (1 - phi)).otherwise(j.cast("double")), F.lit(2.0)))
    c = F.when(F.col("_k") > 1, F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    se = F.sqrt(F.col("sse") / F.greatest(F.col("n") - F.col("free") - 1, F.lit(1)) * (1 + c))
    bounds = [(F.col("mean") + side * _z(lv) * se).alias(f"{name}_{label(lv)}") for lv in levels for side, name in ((-1, "lower"), (1, "upper"))]
    return rows.select(*cols(keys), "step", "mean", *bounds, F.lit(model).alias("model"))


def _model(p: Panel, target: str, h: int, level, kind: str, name: str, **weights) -> DataFrame:
    if p.date is None:
        raise ArgumentError("a date column is needed")
    fits = smooth(p.df, target, order=p.date, keys=p.groups, kind=kind, **weights)
    return project(fits, h, level, keys=p.groups, model=name)


def ses(p: Panel, target: str, h: int, level=(80, 95), *, alpha: float | None = None) -> DataFrame:
    """Simple exponential smoothing, by the least squared errors of one step."""
    return _model(p, target, h, level, "ses", "ses", alpha=alpha)


def holt(p: Panel, target: str, h: int, level=(80, 95), *, damped: bool = False, alpha: float | None = None, beta: float | None = None, phi: float | None = None) -> DataFrame:
    """Linear trend, or a damped one."""
    return _model(p, target, h, level, "damped" if damped else "holt", "holt", alpha=alpha, beta=beta, phi=phi)


# --- intermittent demand ---------------------------------------------------------------------------------------


def demands(df: DataFrame, column: str, *, order: str, keys=()) -> DataFrame:
    """(keys, _t, size, gap): the rows with demand, numbered, and the periods since the one before; a missing period has none."""
    check_known(df, [column, order, *keys])
    w = group_window(keys).orderBy(F.col(quote(order)))
    y = F.col(quote(column)).cast("double")
    rows = df.select(*cols(keys), F.row_number().over(w).alias("_i"), F.when(~F.isnan(y), y).alias("size")).where("size <> 0")
    w = group_window(keys).orderBy("_i")
    return rows.select(*cols(keys), F.row_number().over(w).alias("_t"), "size", (F.col("_i") - F.coalesce(F.lag("_i").over(w), F.lit(0))).cast("double").alias("gap"))


#: What the ratio is multiplied by: 1, or a correction of its bias by the weight of the intervals.
CROSTON = {"classic": lambda a: F.lit(1.0), "sba": lambda a: 1 - a / 2, "sbj": lambda a: 1 - a / (2 - a)}


def croston(p: Panel, target: str, h: int, *, alpha: float = 0.1, alpha_gap: float | None = None, kind: str = "classic", initial: str = "first") -> DataFrame:
    """(keys, step, mean, model): sizes and intervals smoothed with given weights, and their ratio.

    Both begin with their ``first`` value or with their ``mean``.  A series without demand forecasts 0.
    """
    if kind not in CROSTON or initial not in ("first", "mean"):
        raise ArgumentError("kind is classic, sba or sbj; initial is first or mean")
    if p.date is None:
        raise ArgumentError("a date column is needed")
    keys, b = p.groups, alpha if alpha_gap is None else alpha_gap
    found = demands(p.df, target, order=p.date, keys=keys)
    every = p.df.select(*cols(keys)).distinct() if keys else p.df.sparkSession.range(1).select(F.lit(1).alias("_all"))
    out = every
    for name, weight in (("size", alpha), ("gap", b)):
        begin = found.groupBy(*cols(keys)).agg((F.min_by(name, "_t") if initial == "first" else F.avg(name)).alias("_base"))
        # a first value is the state before the second one; deviations from it start at nothing
        rows = joined(found.where("_t > 1") if initial == "first" else found, begin, keys)
        blocks = _blocks(rows, keys, F.col(name) - F.col("_base")).select("*", F.lit(float(weight)).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("phi"))
        last = _folded(blocks, keys).select(*cols(keys), F.col("f.p").alias("_p"))
        state = joined(begin, last, keys).select(*cols(keys), (F.col("_base") + F.coalesce("_p", F.lit(0.0))).alias(f"_{name}"))
        out = joined(out, state, keys)
    mean = F.coalesce(CROSTON[kind](F.lit(float(b))) * F.try_divide("_size", "_gap"), F.lit(0.0))
    return out.select(*cols(keys), F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), mean.alias("mean"), F.lit(f"croston_{kind}").alias("model"))
