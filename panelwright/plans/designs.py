"""Design matrices with a rank: which columns the others explain, and designs kept for new data.

Ranks come from a triangle of the whole table: each task reduces its rows to one small triangular factor, block by block, and factors
are reduced in rounds of ``FAN`` until few are left.  So columns that differ by a billionth are told apart, which sums of
squares can't do, and what travels is as many numbers as there are pairs of columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.operators.frame import ArgumentError, check_known, cols, quote
from panelwright.plans.formula import Design, design, model_columns

#: Factors that a task reduces to one in a round, and rows that it reduces at a time.
FAN, ROWS = 32, 4096


def triangle_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The triangular factor, row by row in one list, and the count of the task's rows."""
    top, n = np.zeros((0, size)), 0
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = rows[np.isfinite(rows).all(axis=1)]
        n += len(rows)
        for at in range(0, len(rows), ROWS):
            top = np.linalg.qr(np.vstack([top, rows[at : at + ROWS]]), mode="r")
    yield pa.RecordBatch.from_arrays([pa.array([top.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["r", "n"])


def joined_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One factor of the task's factors."""
    top, n = np.zeros((0, size)), 0
    for batch in batches:
        for r, count in zip(batch.column("r").to_pylist(), batch.column("n").to_pylist(), strict=True):
            top = np.linalg.qr(np.vstack([top, np.array(r).reshape(-1, size)]), mode="r")
            n += count
    yield pa.RecordBatch.from_arrays([pa.array([top.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["r", "n"])


def triangle(df: DataFrame, columns: dict[str, Column]) -> tuple[np.ndarray, int]:
    """The triangular factor of the columns over all rows without a missing or infinite value, and the number of these rows."""
    size = len(columns)
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())]).dropna()
    parts = rows.mapInArrow(workers.batches(__name__, "triangle_batches", size), "r array<double>, n long")
    count = parts.rdd.getNumPartitions()
    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count).mapInArrow(workers.batches(__name__, "joined_batches", size), "r array<double>, n long")
    # at most ``FAN`` factors
    found = [(np.array(r["r"]).reshape(-1, size), r["n"]) for r in parts.collect()]
    if not found:
        return np.zeros((0, size)), 0
    return np.linalg.qr(np.vstack([r for r, _ in found]), mode="r"), sum(n for _, n in found)


def rank(r: np.ndarray, n: int) -> int:
    """Number of singular values above the least that can be told from rounding."""
    if not r.size:
        return 0
    values = np.linalg.svd(r, compute_uv=False)
    return int((values > values.max() * min(n, r.shape[1]) * np.finfo(float).eps).sum())


def pivots(r: np.ndarray) -> list[int]:
    """Columns in the order of what each adds to those before it, the largest first."""
    rest, left, out = r.copy(), list(range(r.shape[1])), []
    while left:
        sizes = (rest[:, left] ** 2).sum(axis=0)
        best = left.pop(int(np.argmax(sizes)))
        out.append(best)
        length = np.linalg.norm(rest[:, best])
        if length > 0:
            unit = rest[:, best] / length
            for _ in range(2):  # twice, for what rounding has left
                rest[:, left] -= np.outer(unit, unit @ rest[:, left])
    return out


def independent(df: DataFrame, columns: dict[str, Column]) -> list[str]:
    """Names of columns that make up the whole rank, in their order."""
    r, n = triangle(df, columns)
    keep = set(pivots(r)[: rank(r, n)]) if r.size else set()
    return [name for i, name in enumerate(columns) if i in keep]


def is_rank_deficient(df: DataFrame, names: list[str], *, intercept: bool = True) -> bool:
    """Whether some column, or the intercept, is explained by the others; a table without a complete row is."""
    check_known(df, names)
    columns = ({"(Intercept)": F.lit(1.0)} if intercept else {}) | {n: F.col(quote(n)) for n in names}
    r, n = triangle(df, columns)
    return n == 0 or rank(r, n) < len(columns)


def ensure_full_rank(df: DataFrame, names: list[str], *, intercept: bool = True) -> DataFrame:
    """``df``; raises if its columns are rank deficient."""
    if is_rank_deficient(df, names, intercept=intercept):
        raise ArgumentError(f"the regressors {names} are rank deficient")
    return df


def drop_constant_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without those of the columns that hold one value; raises if that is all of them."""
    check_known(df, names)
    seen = df.agg(*[F.coalesce(F.min(quote(n)) == F.max(quote(n)), F.lit(True)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    flat = [n for i, n in enumerate(names) if seen[f"c{i}"]]
    if names and len(flat) == len(names):
        raise ArgumentError("all columns are constant")
    return df.drop(*flat)


@dataclass(frozen=True)
class Prepared:
    """A design that was settled on training data: its columns by name, in order, and those left out."""

    design: Design
    names: tuple[str, ...]
    dropped: tuple[str, ...]

    def columns(self, df: DataFrame) -> dict[str, Column]:
        """Expressions of the kept columns over another table that has the variables."""
        made = model_columns(df, self.design)
        return {n: made[n] for n in self.names}

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with the design's products as columns; variables that are columns already stay, and the intercept is left out."""
        made = self.columns(df)
        return df.withColumns({n: c for n, c in made.items() if n != "(Intercept)" and n not in df.columns})


def prepare(df: DataFrame, text: str, *, dropcollinear: bool = False) -> Prepared:
    """Settle a design on ``df``.  With ``dropcollinear`` columns that the others explain are left out, by pivots of the whole table."""
    d = design(text)
    columns = model_columns(df, d)
    kept = independent(df, columns) if dropcollinear else list(columns)
    return Prepared(d, tuple(kept), tuple(n for n in columns if n not in kept))


def matrix(df: DataFrame, text: str | Prepared, keep: tuple[str, ...] = (), *, dropcollinear: bool = False) -> DataFrame:
    """``keep`` and the design's columns; a ``Prepared`` design has the columns of its training data."""
    p = text if isinstance(text, Prepared) else prepare(df, text, dropcollinear=dropcollinear)
    return df.select(*cols(keep), *[c.alias(n) for n, c in p.columns(df).items()])


def model_frame(df: DataFrame, text: str, keep: tuple[str, ...] = (), *, dropcollinear: bool = False) -> DataFrame:
    """``keep``, the response and the design's columns, of rows without a missing value in them."""
    p = prepare(df, text, dropcollinear=dropcollinear)
    if p.design.target is None:
        raise ArgumentError("a formula 'y ~ ...' is needed")
    check_known(df, [p.design.target])
    made = {p.design.target: F.col(quote(p.design.target)).cast("double")} | p.columns(df)
    return df.select(*cols(keep), *[c.alias(n) for n, c in made.items()]).dropna(subset=list(made))


def align_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` in their order; raises for one that is missing."""
    check_known(df, names)
    return df.select(*cols(names))
