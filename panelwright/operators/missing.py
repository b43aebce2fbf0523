"""Missing values: carry forward and backward, runs, and complete cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.frame import ORDER, ArgumentError, Grouped, check_known, cols, group_window, like, ordered, quote, visible
from panelwright.operators.panel import Panel
from panelwright.operators.positions import carried

DIRECTIONS = ("down", "up", "downup", "updown")


def fill_missing(data, *columns: str, direction: str = "down"):
    """Carry the last value down, the next one up, or both in turn.  All columns by default."""
    if direction not in DIRECTIONS:
        raise ArgumentError(f"direction is one of {', '.join(DIRECTIONS)}")
    if isinstance(data, Panel):
        return data.with_df(_fill(data.df, data.groups, data.date, columns, direction))
    if isinstance(data, Grouped):
        return Grouped(_fill(data.df, data.keys, None, columns, direction), data.keys)
    return _fill(data, (), None, columns, direction)


def _fill(source: DataFrame, keys, date, columns, direction) -> DataFrame:
    df = ordered(source)
    names = list(columns) or [c for c in visible(df) if c not in (*keys, date)]
    check_known(df, names)
    place = F.col(quote(date if date else ORDER))
    if not keys:
        return like(source, carried(df, names, place, direction=direction))
    w = group_window(keys).orderBy(place)
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows a row comes before it in the other direction: a frame to the end would be read anew for each row
    up = group_window(keys).orderBy(place.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def filled(c: str) -> Column:
        last = F.last(F.col(quote(c)), ignorenulls=True).over(down)
        first = F.last(F.col(quote(c)), ignorenulls=True).over(up)
        return {"down": last, "up": first, "downup": F.coalesce(last, first), "updown": F.coalesce(first, last)}[direction]

    return like(source, df.select(*[filled(c).alias(c) if c in names else F.col(quote(c)) for c in df.columns]))


def present(df: DataFrame, column: str) -> Column:
    """Neither null nor NaN."""
    c = F.col(quote(column))
    kind = df.schema[column].dataType
    return c.isNotNull() & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNotNull()


def complete_cases(df: DataFrame, *columns: str, name: str = "complete") -> DataFrame:
    """Flag rows without a missing value."""
    names = list(columns) or visible(df)
    check_known(df, names)
    flag = F.lit(True)
    for c in names:
        flag = flag & present(df, c)
    return df.withColumn(name, flag)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a missing value."""
    names = list(columns) or visible(df)
    return complete_cases(df, *names, name="_ok").where("_ok").drop("_ok")


def check_missing(df: DataFrame, *columns: str) -> DataFrame:
    """The table as it is; using it raises if a value is missing."""
    names = list(columns) or visible(df)
    bad = F.lit(False)
    for c in names:
        bad = bad | ~present(df, c)
    return df.filter(F.when(bad, F.raise_error(F.lit("missing values")).cast("boolean")).otherwise(True))


def longest_contiguous(data, column: str, order: str | None = None, keys=()) -> DataFrame:
    """The longest run of present values of each series; the first of equally long ones."""
    if isinstance(data, Panel):
        keys, order, data = data.groups, data.date, data.df
    df = ordered(data)
    check_known(df, [column, *keys])
    o = F.col(quote(order)) if order else F.col(ORDER)
    w = group_window(keys).orderBy(o)
    ok = present(df, column)
    runs = (
        df.withColumn("_ok", ok)
        .withColumn("_run", F.row_number().over(w) - F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_ok")
    )
    per = Window.partitionBy(*cols(keys), F.col("_run"))
    runs = runs.withColumn("_len", F.count(F.lit(1)).over(per))
    best = group_window(keys).orderBy(F.col("_len").desc(), F.col("_run"))
    out = runs.withColumn("_best", F.first("_run").over(best)).where("_run = _best")
    return like(data, out.drop("_ok", "_run", "_len", "_best"))


def interpolate_linear(data, column: str, order: str | None = None, keys=()) -> DataFrame:
    """Straight lines between present values by row position; the ends keep the nearest value."""
    if isinstance(data, Panel):
        return data.with_df(interpolate_linear(data.df, column, data.date, data.groups))
    df = ordered(data)
    check_known(df, [column, *keys])
    place = F.col(quote(order)) if order else F.col(ORDER)
    w = group_window(keys).orderBy(place)
    # what follows a row comes before it in the other direction: a frame to the end would be read anew for each row
    before, after = (x.rowsBetween(Window.unboundedPreceding, Window.currentRow) for x in (w, group_window(keys).orderBy(place.desc())))
    y = F.when(present(df, column), F.col(quote(column)).cast("double"))
    base = df.withColumn("_y", y).withColumn("_i", F.row_number().over(w))
    at = F.when(F.col("_y").isNotNull(), F.col("_i"))
    base = (
        base.withColumn("_pv", F.last("_y", True).over(before))
        .withColumn("_pi", F.last(at, True).over(before))
        .withColumn("_nv", F.last("_y", True).over(after))
        .withColumn("_ni", F.last(at, True).over(after))
    )
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    new = F.when(F.col("_y").isNotNull(), F.col("_y")).when(F.col("_pi").isNull(), F.col("_nv")).when(F.col("_ni").isNull(), F.col("_pv")).otherwise(between)
    return like(data, base.select(*[new.alias(column) if c == column else F.col(quote(c)) for c in df.columns]))
