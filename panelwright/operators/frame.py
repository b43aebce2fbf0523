"""Shared ground of the table verbs: row order, selectors, grouped tables and errors.

Row order is data: it lives in the hidden column ``_ord`` that ``ingest`` adds, and verbs that depend on order use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = "_ord"


class ArgumentError(ValueError):
    """A verb was called with arguments that don't fit its table."""


@dataclass(frozen=True)
class Grouped:
    """A table and its grouping columns."""

    df: DataFrame
    keys: tuple[str, ...]

    def __len__(self) -> int:
        return self.df.select(*[F.col(quote(k)) for k in self.keys]).distinct().count()

    def sizes(self) -> DataFrame:
        """Number of groups and least, largest and mean group size."""
        per = self.df.groupBy(*[F.col(quote(k)) for k in self.keys]).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(
            F.count(F.lit(1)).alias("groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size")
        )


@dataclass(frozen=True)
class Selector:
    """Column names resolved against a table."""

    names: tuple[str, ...] | None = None  # None: every column

    def resolve(self, columns: list[str]) -> list[str]:
        if self.names is None:
            return list(columns)
        missing = [n for n in self.names if n not in columns]
        if missing:
            raise ArgumentError(f"unknown columns {missing}")
        return list(self.names)


def all_of(*names) -> Selector:
    """Every named column; each must exist."""
    flat = [x for n in names for x in ([n] if isinstance(n, str) else n)]
    return Selector(tuple(flat))


def everything() -> Selector:
    return Selector(None)


@dataclass(frozen=True)
class Across:
    """Columns times named functions of a column."""

    columns: tuple[str, ...] | Selector
    functions: dict[str, Callable] = field(default_factory=dict)


def across(columns: Iterable[str] | Selector, **functions) -> Across:
    if not functions:
        raise ArgumentError("across needs at least one function")
    cols = columns if isinstance(columns, Selector) else (columns,) if isinstance(columns, str) else tuple(columns)
    return Across(cols, functions)


class Namespace:
    """Columns of a table as attributes, handed to the functions of ``mutate``, ``query`` and ``summarise``."""

    def __init__(self, columns: list[str], window: WindowSpec | None = None):
        self._columns, self._window = columns, window

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise ArgumentError(f"unknown column {name!r}")
        return F.col(quote(name))

    @property
    def window(self) -> WindowSpec:
        """The group of the row: the whole table unless it is grouped."""
        return self._window if self._window is not None else Window.partitionBy(F.lit(1))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cols(names: Iterable[str]) -> list[Column]:
    return [F.col(quote(n)) for n in names]


def ingest(source, spark=None, order: str | Iterable[str] | None = None) -> DataFrame:
    """A DataFrame with the order column.

    ``source`` is a DataFrame, a pandas frame, or a dict of equally long lists.  ``order`` names columns that
    give the row order; without it the order of the source is kept.
    """
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, dict):
        lengths = {len(v) for v in source.values()}
        if len(lengths) > 1:
            raise ArgumentError("columns differ in length")
        from panelwright.sources.literal import table

        df = table(spark, source) if source else spark.createDataFrame([], "x int").drop("x")
    elif hasattr(source, "columns") and hasattr(source, "dtypes"):
        df = spark.createDataFrame(source)
    else:
        raise ArgumentError("not a table")
    if ORDER in df.columns:
        return df
    if order is None:
        return df.withColumn(ORDER, F.monotonically_increasing_id())
    names = [order] if isinstance(order, str) else list(order)
    check_known(df, names)
    return df.withColumn(ORDER, F.struct(*cols(names)) if len(names) > 1 else F.col(quote(names[0])))


def ordered(df: DataFrame) -> DataFrame:
    """``df`` with an order column, taken from the source's order if there is none."""
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def like(df: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` without an order column unless ``df`` had one."""
    return out if ORDER in df.columns or ORDER not in out.columns else out.drop(ORDER)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


def final(df: DataFrame) -> DataFrame:
    """The rows in order, without the order column: for the edge of a program only, since it sorts."""
    return df.orderBy(ORDER).drop(ORDER) if ORDER in df.columns else df


def check_known(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ArgumentError(f"unknown columns {missing}; the table has {visible(df)}")


def check_unique(names: Iterable[str], what: str) -> None:
    seen, twice = set(), []
    for n in names:
        if n in seen:
            twice.append(n)
        seen.add(n)
    if twice:
        raise ArgumentError(f"duplicate {what}: {twice}")


def group_window(keys: Iterable[str]) -> WindowSpec:
    keys = list(keys)
    return Window.partitionBy(*(cols(keys) if keys else [F.lit(1)]))


def joined(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Tables of one row per series side by side; null keys meet."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    renamed = b.select(*[F.col(quote(k)).alias(f"__k{i}") for i, k in enumerate(keys)], *[quote(c) for c in b.columns if c not in keys])
    on = [a[quote(k)].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return a.join(renamed, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
