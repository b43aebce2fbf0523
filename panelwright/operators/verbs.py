"""Row and column verbs.  Each returns a lazy plan; nothing runs until the result is used."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from panelwright.operators.frame import (
    ORDER,
    Across,
    ArgumentError,
    Grouped,
    Namespace,
    Selector,
    check_known,
    check_unique,
    cols,
    group_window,
    like,
    ordered,
    quote,
    visible,
)
from panelwright.operators.panel import Panel

DIRECTIONS = {"asc": False, "ascending": False, "desc": True, "descending": True, "reverse": True}


def select(data, *specs):
    """Pick, reorder and rename.  A spec is a name, a pair ``(new, old)`` or a selector; none means every column."""
    if isinstance(data, Panel):
        return data.select(*specs)
    names = visible(data)
    if not specs:
        return data
    picked: list[tuple[str, str]] = []
    explicit: set[str] = set()
    for spec in specs:
        if isinstance(spec, Selector):
            taken = {old for _, old in picked}
            picked += [(n, n) for n in spec.resolve(names) if n not in taken]
            continue
        new, old = (spec, spec) if isinstance(spec, str) else spec
        if old not in names:
            raise ArgumentError(f"unknown column {old!r}")
        if old in explicit:
            raise ArgumentError(f"column {old!r} is selected twice")
        explicit.add(old)
        if any(o == old for _, o in picked):  # an explicit pick after a selector that took it
            raise ArgumentError(f"column {old!r} is selected twice")
        picked.append((new, old))
    check_unique([n for n, _ in picked], "output columns")
    hidden = [ORDER] if ORDER in data.columns else []
    return data.select(*[F.col(quote(o)).alias(n) for n, o in picked], *hidden)


def rename(data, **new_old: str):
    """``rename(df, new="old")``; column order is kept."""
    if isinstance(data, Panel):
        return data.rename(**new_old)
    check_known(data, new_old.values())
    check_unique(new_old.values(), "source columns")
    back = {old: new for new, old in new_old.items()}
    out = [back.get(c, c) for c in data.columns]
    check_unique(out, "column names after renaming")
    return data.select(*[F.col(quote(c)).alias(back.get(c, c)) for c in data.columns])


def query(data, predicate: Callable[[Namespace], Column | tuple] | Column | tuple, na: str = "error"):
    """Rows whose predicate is true, or all of a tuple of predicates.  A null predicate raises unless ``na="drop"``.

    Comparisons are pushed to the scan with either choice: what is neither true nor null is left out before the check, one
    predicate of a tuple at a time.  So name conditions as a tuple rather than joined by ``&`` where missing ones raise.
    """
    if isinstance(data, Panel):
        return data.with_df(query(data.df, predicate, na))
    if not isinstance(data, DataFrame):
        raise ArgumentError("not a table")
    if na not in ("error", "drop"):
        raise ArgumentError("na is 'error' or 'drop'")
    given = predicate(Namespace(visible(data))) if callable(predicate) and not isinstance(predicate, Column) else predicate
    tests = list(given) if isinstance(given, tuple) else [given]
    if not tests or not all(isinstance(p, Column) and isinstance(data.select(p.alias("p")).schema["p"].dataType, BooleanType) for p in tests):
        raise ArgumentError("the predicate must be a Boolean column")
    if na == "drop":
        return data.filter(reduce(and_, tests))
    # as columns first, so that a test that draws random numbers is worked out once
    names = [f"_pw_test{i}" for i in range(len(tests))]
    tested = data.withColumns(dict(zip(names, tests, strict=True)))
    for n in names:
        tested = tested.filter(F.col(n) | F.col(n).isNull())
    p = reduce(and_, [F.col(n) for n in names])
    checked = F.when(p.isNull(), F.raise_error(F.lit("the predicate is missing in some row")).cast("boolean")).otherwise(p)
    return tested.filter(checked).select(*cols(data.columns))


def arrange(data, *keys, rev: bool = False):
    """Stable sort.  A key is a name or ``(name, direction)``; nulls come last either way; ``rev`` flips every direction."""
    if isinstance(data, Panel):
        return data.with_df(arrange(data.df, *[(g, "desc" if rev else "asc") for g in data.groups], *keys, rev=rev))
    df = ordered(data)
    order = []
    for key in keys:
        name, direction = (key, "asc") if isinstance(key, str) else key
        if direction not in DIRECTIONS:
            raise ArgumentError(f"unknown direction {direction!r}")
        check_known(df, [name])
        down = DIRECTIONS[direction] != rev
        c = F.col(quote(name))
        order.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    tie = F.col(ORDER).desc() if rev and not keys else F.col(ORDER).asc()
    # after a range sort the row numbers of the partitions follow the sort
    return df.orderBy(*order, tie).withColumn(ORDER, F.monotonically_increasing_id())


def groupby(data: DataFrame, *keys: str) -> Grouped:
    if not keys:
        raise ArgumentError("groupby needs a column")
    check_unique(keys, "grouping columns")
    check_known(data, keys)
    return Grouped(data, tuple(keys))


def ungroup(data: Grouped) -> DataFrame:
    return data.df


def _namespace(df: DataFrame, keys=()) -> Namespace:
    return Namespace(visible(df), group_window(keys))


def mutate(data, *bundles: Across, **named):
    """Add or replace columns one after the other, so later ones see earlier ones.

    A value is a Column or a function of the namespace.  Functions of ``across`` make ``column_function``; an aggregate
    is spread over the group (the whole table without one).
    """
    if isinstance(data, Panel):
        return data.with_df(_mutate(data.df, data.groups, bundles, named))
    if isinstance(data, Grouped):
        return Grouped(_mutate(data.df, data.keys, bundles, named), data.keys)
    return _mutate(data, (), bundles, named)


def _mutate(df: DataFrame, keys, bundles, named) -> DataFrame:
    for name, value in named.items():
        made = value(_namespace(df, keys)) if callable(value) and not isinstance(value, Column) else value
        if not isinstance(made, Column):
            raise ArgumentError(f"{name}: a column or a function that makes one is needed, not {type(made).__name__}")
        df = df.withColumn(name, made)
    for bundle in bundles:
        out, whole = {}, {}
        for c in _across_columns(bundle, df, ()):
            for fname, f in bundle.functions.items():
                new = f"{c}_{fname}"
                if new in df.columns or new in out or new in whole:
                    raise ArgumentError(f"column {new!r} exists already")
                f = AGGREGATES.get(f, f) if isinstance(f, str) else f
                made = f(F.col(quote(c)))
                if not _is_aggregate(df, made):
                    out[new] = made
                elif keys:
                    out[new] = made.over(group_window(keys))
                else:
                    whole[new] = made
        df = df.withColumns(out)
        if whole:  # one row, so no window over the whole table is needed
            df = df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in whole.items()])))
    return df


def _across_columns(bundle: Across, df: DataFrame, excluded) -> list[str]:
    names = bundle.columns.resolve(visible(df)) if isinstance(bundle.columns, Selector) else list(bundle.columns)
    check_known(df, names)
    return [n for n in names if n not in excluded]


def _is_aggregate(df: DataFrame, c: Column) -> bool:
    """Whether a column needs a group: an aggregate makes one row of a table without grouping."""
    plan = df.select(c.alias("x"))._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return plan == "Aggregate"


def _propagating(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The aggregate is null if any value is, as in a reduction over the plain vector."""
    return lambda c: F.when(F.count(c) == F.count(F.lit(1)), f(c))


_SKIPPING: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "any": F.bool_or,
    "all": F.bool_and,
}
#: Names that stand for built-in aggregates.
AGGREGATES: dict[str, Callable[[Column], Column]] = {k: _propagating(f) for k, f in _SKIPPING.items()} | {
    "length": lambda c: F.count(F.lit(1)),
    "n": lambda c: F.count(F.lit(1)),
    "n_distinct": lambda c: F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0)),
    "first": lambda c: F.min_by(F.struct(c.alias("v")), F.col(ORDER))["v"],
    "last": lambda c: F.max_by(F.struct(c.alias("v")), F.col(ORDER))["v"],
}


def quantile(p: float, na: str = "propagate") -> Callable[[Column], Column]:
    """Linear-interpolation quantile, for ``summarise``."""
    f = lambda c: F.percentile(c, F.lit(p))
    return f if na == "skip" else _propagating(f)


def skipmissing(name: str) -> Callable[[Column], Column]:
    """A named aggregate that leaves nulls out."""
    return _SKIPPING[name]


def _summary(df: DataFrame, spec, name: str) -> Column:
    if isinstance(spec, tuple) and len(spec) == 2:
        source, f = spec
        names = [source] if isinstance(source, str) else list(source)
        check_known(df, names)
        f = AGGREGATES.get(f) if isinstance(f, str) else f
        if not callable(f):
            raise ArgumentError(f"{name}: unknown summary function")
        return f(*cols(names))
    if callable(spec) and not isinstance(spec, Column):
        return spec(_namespace(df))
    if isinstance(spec, Column):
        return spec
    raise ArgumentError(f"{name}: a summary is (column, function), ((columns), function), a function or a Column")


def summarise(data, *bundles: Across, **specs) -> DataFrame:
    """One row per group.  Named aggregates give null for a group with a null; see ``skipmissing``.

    A pandas grouped-aggregate UDF can stand wherever a function of columns can.
    """
    if isinstance(data, Panel):
        if not data.groups:
            raise ArgumentError("a panel without groups can't be summarised")
        data = Grouped(data.df, tuple(data.groups))
    if not isinstance(data, Grouped):
        raise ArgumentError("summarise needs a grouped table")
    df = data.df if ORDER in data.df.columns else ordered(data.df)
    out = {name: _summary(df, spec, name) for name, spec in specs.items()}
    for bundle in bundles:
        for c in _across_columns(bundle, df, data.keys):
            for fname, f in bundle.functions.items():
                new = f"{c}_{fname}"
                if new in out or new in data.keys:
                    raise ArgumentError(f"column {new!r} exists already")
                out[new] = _summary(df, (c, f), new)
    clash = [n for n in out if n in data.keys]
    if clash:
        raise ArgumentError(f"summaries named like grouping columns: {clash}")
    return df.groupBy(*cols(data.keys)).agg(*[c.alias(n) for n, c in out.items()])


summarize = summarise


def distinct(data, *keys: str, keep_all: bool = False):
    """The first row of each key.  Without keys, all columns; without ``keep_all`` only the keys are returned."""
    if isinstance(data, Panel):
        names = list(dict.fromkeys([*data.groups, *keys])) if keys else []
        return data.with_df(distinct(data.df, *names, keep_all=keep_all))
    names = list(keys) or visible(data)
    check_known(data, names)
    if not keep_all or set(names) == set(visible(data)):
        if ORDER in data.columns:
            return data.groupBy(*cols(names)).agg(F.min(ORDER).alias(ORDER))
        return data.select(*cols(names)).distinct()
    df = ordered(data)
    w = Window.partitionBy(*cols(names)).orderBy(ORDER)
    return like(data, df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def bind_rows(*tables: DataFrame, spark=None) -> DataFrame:
    """Union by name; absent columns are null, types meet at their common type, the order is table by table."""
    if not tables:
        if spark is None:
            raise ArgumentError("no tables")
        return spark.createDataFrame([], "x int").drop("x")
    tagged = [ordered(t).withColumn("_t", F.lit(i)) for i, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if len({t.schema[ORDER].dataType.simpleString() for t in tagged}) > 1:
        raise ArgumentError("tables differ in the type of their order")
    names = list(dict.fromkeys(c for t in tables for c in visible(t)))
    return out.select(*cols(names), F.struct("_t", ORDER).alias(ORDER))


def head(data, n: int = 6):
    """First n rows (of each group); a negative n leaves out the last \\|n\\|."""
    return _slice(data, n, False)


def tail(data, n: int = 6):
    """Last n rows (of each group); a negative n leaves out the first \\|n\\|."""
    return _slice(data, n, True)


def _slice(data, n: int, back: bool):
    if isinstance(data, Panel):
        inner = Grouped(data.df, tuple(data.groups)) if data.groups else data.df
        out = _slice(inner, n, back)
        return data.with_df(out.df if isinstance(out, Grouped) else out)
    keys = data.keys if isinstance(data, Grouped) else ()
    source = data.df if isinstance(data, Grouped) else data
    df = ordered(source)
    order = F.col(ORDER).desc() if back else F.col(ORDER).asc()
    # a negative n counts from the other end
    far = order if n >= 0 else (F.col(ORDER).asc() if back else F.col(ORDER).desc())
    if keys:
        rn = F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(far))
        out = df.withColumn("_rn", rn).where(F.col("_rn") <= n if n >= 0 else F.col("_rn") > -n).drop("_rn")
    elif n >= 0:
        out = df.orderBy(order).limit(n)
    else:
        out = _without(df, -n, far, back)
    return Grouped(out, keys) if isinstance(data, Grouped) else out


def _without(df: DataFrame, n: int, far: Column, back: bool) -> DataFrame:
    """All but the first ``n`` rows in the order ``far``.  They are found by a top-n search, and what stays lies beyond the
    last of them; only rows that tie with that one are counted."""
    edge = df.select(F.col(ORDER).alias("_at")).orderBy(F.col("_at").asc() if back else F.col("_at").desc()).limit(n)
    edge = edge.groupBy("_at").agg(F.count(F.lit(1)).alias("_out")).agg((F.max if back else F.min)(F.struct("_at", "_out")).alias("_edge"), F.sum("_out").alias("_all"))
    rows = df.crossJoin(F.broadcast(edge))  # one row
    at = F.col("_edge._at")
    beyond = rows.where(F.col(ORDER) > at if back else F.col(ORDER) < at)
    ties = rows.where(F.col(ORDER) == at).withColumn("_rn", F.row_number().over(Window.partitionBy(ORDER).orderBy(ORDER)))
    ties = ties.where(F.col("_rn") > F.col("_edge._out"))
    return beyond.select(*cols(df.columns)).unionByName(ties.select(*cols(df.columns)))


def glimpse(data, n: int = 5) -> str:
    """Rows, columns, types and first values as text."""
    df = data.df if isinstance(data, (Grouped, Panel)) else data
    names = visible(df)
    first = (df.orderBy(ORDER) if ORDER in df.columns else df).limit(n).select(*cols(names)).collect()
    lines = [f"Rows: {df.count()}", f"Columns: {len(names)}"]
    if isinstance(data, Grouped):
        lines.append(f"Groups: {', '.join(data.keys)}")
    if isinstance(data, Panel):
        lines.append(f"Panel: groups {list(data.groups)}, date {data.date}, m {data.m}, frequency {data.frequency}")
    for i, c in enumerate(names):
        lines.append(f"$ {c} <{df.schema[c].dataType.simpleString()}> {', '.join(str(r[i]) for r in first)}")
    return "\n".join(lines)
