"""Panels: a table of many series with its grouping, date, period and imputation rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.frame import ORDER, ArgumentError, Selector, check_known, cols, group_window, quote, visible

#: Seasonal period and step of each frequency.
FREQUENCIES = {
    "second": (60, "1 second"),
    "minute": (60, "1 minute"),
    "halfhour": (48, "30 minutes"),
    "hour": (24, "1 hour"),
    "day": (7, "1 day"),
    "businessday": (5, "1 day"),
    "week": (52, "7 days"),
    "biweekly": (26, "14 days"),
    "month": (12, "1 month"),
    "quarter": (4, "3 months"),
    "year": (1, "1 year"),
}
STRATEGIES = {"locf": "locf", "down": "locf", "nocb": "nocb", "up": "nocb", "linear": "linear", "zero": "zero"}


def frequency_to_m(frequency: str) -> int:
    """Seasonal period of a frequency."""
    return _known(frequency)[0]


def frequency_to_step(frequency: str) -> str:
    """Interval text of one step."""
    return _known(frequency)[1]


def _known(frequency: str) -> tuple[int, str]:
    if frequency not in FREQUENCIES:
        raise ArgumentError(f"unknown frequency {frequency!r}; known: {', '.join(FREQUENCIES)}")
    return FREQUENCIES[frequency]


def format_frequency(frequency: str | None) -> str:
    return "unknown" if frequency is None else {"halfhour": "30 minutes", "businessday": "business day"}.get(frequency, frequency)


def m_description(m) -> str:
    """Label of one period or several."""
    if m is None:
        return "none"
    if isinstance(m, (list, tuple)):
        return "multiple (" + ", ".join(map(str, m)) + ")"
    names = {1: "yearly or none", 4: "quarterly", 7: "weekly", 12: "monthly", 24: "daily", 52: "yearly by week"}
    return f"{m} ({names[m]})" if m in names else str(m)


def resolve_m(m, several: bool = False):
    """The period that a model uses: models of one period take the first of several."""
    return m[0] if isinstance(m, (list, tuple)) and not several and m else m


@dataclass(frozen=True)
class Panel:
    """``df`` is a plan; ``panel`` builds and checks one."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    date: str | None = None
    m: int | list | None = None
    frequency: str | None = None
    target: str | None = None
    imputed: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)

    def with_df(self, df: DataFrame) -> Panel:
        lost = [g for g in self.groups if g not in df.columns]
        if lost:
            raise ArgumentError(f"group columns {lost} were lost")
        date = self.date if self.date in df.columns else None
        return replace(self, df=df, date=date, target=self.target if self.target in df.columns else None)

    @property
    def window(self):
        """The series of the row, in date order."""
        w = group_window(self.groups)
        return w.orderBy(*cols([self.date] if self.date else [ORDER]))

    def select(self, *specs) -> Panel:
        from panelwright.operators.verbs import select

        if not specs:
            if not self.groups:
                raise ArgumentError("an ungrouped panel has nothing to select without columns")
            return self.with_df(select(self.df, *self.groups))
        kept = [*self.groups]
        rest = []
        for s in specs:
            if isinstance(s, Selector):
                rest += [n for n in s.resolve(visible(self.df)) if n not in kept and n not in rest]
            elif isinstance(s, str):
                if s not in kept:
                    rest.append(s)
            else:
                new, old = s
                if old in (*self.groups, self.date) and new != old:
                    raise ArgumentError(f"{old!r} shapes the panel; use rename")
                if old not in kept:
                    rest.append(s)
        return self.with_df(select(self.df, *kept, *rest))

    def rename(self, **new_old: str) -> Panel:
        from panelwright.operators.verbs import rename

        back = {old: new for new, old in new_old.items()}
        return replace(
            self,
            df=rename(self.df, **new_old),
            groups=tuple(back.get(g, g) for g in self.groups),
            date=back.get(self.date, self.date),
            target=self.target if self.target not in back else None,
        )

    def imputation_counts(self) -> DataFrame:
        """Imputed cells of each imputed column: an action's worth of work, run on demand."""
        return self.df.agg(*[F.sum(F.col(quote(f"{c}_is_imputed")).cast("long")).alias(c) for c in self.imputed])


def panel(
    df: DataFrame,
    *,
    groups: tuple[str, ...] | list[str] | str = (),
    date: str | None = None,
    m=None,
    frequency: str | None = None,
    target: str | None = None,
    xreg: tuple[str, ...] = (),
    fill_time: bool = False,
    balanced: bool = False,
    target_na: str | None = None,
    xreg_na: str | None = None,
    max_gap: int | None = None,
) -> Panel:
    """Build a panel: complete the time grid of each series, then fill gaps of target and regressors.

    ``fill_time`` drops dates off the grid and keeps the last row of a date; ``balanced`` gives every series the whole
    table's range.  Filled columns become double and get a ``<column>_is_imputed`` flag.
    """
    keys = (groups,) if isinstance(groups, str) else tuple(groups)
    check_known(df, [*keys, *([date] if date else []), *([target] if target else []), *xreg])
    if frequency is not None:
        _known(frequency)
    if fill_time and (date is None or frequency is None):
        raise ArgumentError("fill_time needs a date and a frequency")
    if balanced and not fill_time:
        raise ArgumentError("balanced needs fill_time")
    if target_na is not None and target is None:
        raise ArgumentError("target_na needs a target")
    for s in (target_na, xreg_na):
        if s is not None and s not in STRATEGIES:
            raise ArgumentError(f"unknown strategy {s!r}")
    if xreg_na is not None and not xreg:
        raise ArgumentError("xreg_na needs regressors")
    if max_gap is not None and max_gap < 1:
        raise ArgumentError("max_gap must be positive")
    if m is None and frequency is not None:
        m = frequency_to_m(frequency)
    if fill_time:
        df = complete_grid(df, keys, date, frequency_to_step(frequency), balanced)
    imputed = []
    for strategy, names in ((target_na, [target]), (xreg_na, xreg)):
        if strategy is not None:
            for c in names:
                df = fill_gaps(df, keys, date, c, strategy, max_gap)
                imputed.append(c)
    return Panel(df, keys, date, m, frequency, target, tuple(imputed), {"fill_time": fill_time, "balanced": balanced})


def complete_grid(df: DataFrame, keys: tuple[str, ...], date: str, step: str, balanced: bool) -> DataFrame:
    """One row per series and step from its first to its last date."""
    names = visible(df)
    kind = df.schema[date].dataType
    if isinstance(kind, (T.LongType, T.IntegerType)):
        interval = F.lit(1).cast(kind)
    else:
        interval = F.expr(f"INTERVAL {step}")
    d = F.col(quote(date))
    # The last row of a date stays; later rows of the source come last.
    order = F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id()
    # A struct, so that a null in the last row isn't passed over for an older value.
    values = [c for c in names if c not in (*keys, date)]
    last = F.max_by(F.struct(*cols(values)), F.col("_o")) if values else None
    rows = df.withColumn("_o", order).where(d.isNotNull()).groupBy(*cols([*keys, date])).agg((last if last is not None else F.count(F.lit(1))).alias("_v"))
    span = df.groupBy(*cols(keys)).agg(F.min(d).alias("_a"), F.max(d).alias("_b"))
    if balanced and keys:
        ends = df.agg(F.min(d).alias("_a"), F.max(d).alias("_b"))
        span = span.drop("_a", "_b").crossJoin(F.broadcast(ends))  # one row
    grid = span.where("_a is not null").select(*cols(keys), F.explode(F.sequence("_a", "_b", interval)).alias(date))
    right = rows.select(*[F.col(quote(k)).alias(f"_k{i}") for i, k in enumerate(keys)], d.alias("_d"), "_v")
    on = grid[quote(date)] == right["_d"]
    for i, k in enumerate(keys):
        on = on & grid[quote(k)].eqNullSafe(right[f"_k{i}"])
    out = grid.join(right, on, "left")
    value = [F.col("_v")[c].alias(c) for c in values]
    by_name = dict(zip(values, value, strict=True))
    return out.select(*[by_name.get(c, F.col(quote(c))) for c in names])


def fill_gaps(df: DataFrame, keys: tuple[str, ...], date: str | None, column: str, strategy: str, max_gap: int | None) -> DataFrame:
    """Fill nulls (and NaN) of one column within each series and flag the filled cells.

    ``locf`` and ``nocb`` fill the ``max_gap`` cells of a gap that are nearest to their source; ``linear`` fills a gap
    only whole and only between two values; ``zero`` heeds no ``max_gap``.
    """
    strategy = STRATEGIES[strategy]
    kind = df.schema[column].dataType
    c = F.col(quote(column)).cast("double")
    c = F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
    order = cols([date]) if date else [F.col(ORDER)] if ORDER in df.columns else [F.monotonically_increasing_id()]
    w = group_window(keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = df.withColumn("_y", c).withColumn("_i", F.row_number().over(w))
    at = F.when(F.col("_y").isNotNull(), F.col("_i"))
    base = (
        base.withColumn("_pv", F.last("_y", ignorenulls=True).over(before))
        .withColumn("_nv", F.first("_y", ignorenulls=True).over(after))
        .withColumn("_pi", F.last(at, ignorenulls=True).over(before))
        .withColumn("_ni", F.first(at, ignorenulls=True).over(after))
    )
    most = F.lit(max_gap if max_gap is not None else 1 << 60)
    if strategy == "locf":
        new = F.when(F.col("_i") - F.col("_pi") <= most, F.col("_pv"))
    elif strategy == "nocb":
        new = F.when(F.col("_ni") - F.col("_i") <= most, F.col("_nv"))
    elif strategy == "linear":
        share = (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
        whole = F.col("_ni") - F.col("_pi") - 1 <= most
        new = F.when(whole, F.col("_pv") + share * (F.col("_nv") - F.col("_pv")))
    else:
        new = F.lit(0.0)
    filled = F.when(F.col("_y").isNull(), new).otherwise(F.col("_y"))
    out = base.withColumn("_f", filled).withColumn(f"{column}_is_imputed", F.col("_y").isNull() & F.col("_f").isNotNull())
    keep = [F.col("_f").alias(column) if n == column else F.col(quote(n)) for n in df.columns]
    return out.select(*keep, F.col(quote(f"{column}_is_imputed")))
