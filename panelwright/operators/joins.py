"""Equi-joins in which null matches null and NaN matches NaN, and cross joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frame import ORDER, ArgumentError, check_known, check_unique, ordered, quote, visible


def resolve_by(left: DataFrame, right: DataFrame, by) -> list[tuple[str, str]]:
    """Key pairs (left, right).  None: the common columns; an empty list: a cross join."""
    if by is None:
        pairs = [(c, c) for c in visible(left) if c in visible(right)]
        if not pairs:
            raise ArgumentError("no common columns")
    elif isinstance(by, str):
        pairs = [(by, by)]
    elif isinstance(by, tuple) and len(by) == 2 and all(isinstance(x, str) for x in by):
        pairs = [by]
    elif isinstance(by, dict):
        pairs = list(by.items())
    elif isinstance(by, list):
        pairs = [(x, x) if isinstance(x, str) else tuple(x) if isinstance(x, (tuple, list)) and len(x) == 2 else None for x in by]
        if None in pairs:
            raise ArgumentError("by holds names or (left, right) pairs")
    else:
        raise ArgumentError(f"by can't be a {type(by).__name__}")
    check_known(left, [a for a, _ in pairs])
    check_known(right, [b for _, b in pairs])
    check_unique([a for a, _ in pairs], "left keys")
    check_unique([b for _, b in pairs], "right keys")
    return pairs


def _join(left: DataFrame, right: DataFrame, by, how: str, suffix=("_x", "_y")) -> DataFrame:
    pairs = resolve_by(left, right, by)
    lkeys, rkeys = {a for a, _ in pairs}, {b for _, b in pairs}
    lother = [c for c in visible(left) if c not in lkeys]
    rother = [c for c in visible(right) if c not in rkeys]
    names: list[tuple[str, str, str]] = []  # side, source, output
    key_of = dict((b, a) for a, b in pairs)
    if how == "right":
        # the right table keeps its columns and names; keys are named as on the left
        names += [("k" if c in rkeys else "r", c, key_of.get(c, c)) for c in visible(right)]
        taken = {n for _, _, n in names}
        names += [("l", c, c + suffix[0] if c in taken else c) for c in lother]
    else:
        clash = set(lother) & set(rother)
        names += [("k" if c in lkeys else "l", c, c + suffix[0] if c in clash else c) for c in visible(left)]
        taken = {n for _, _, n in names}
        names += [("r", c, c + suffix[1] if c in clash or c in lkeys else c) for c in rother]
    check_unique([n for _, _, n in names], "output columns")
    lt = ordered(left)
    rt = ordered(right)
    lt = lt.select(*[F.col(quote(c)).alias(f"l{i}") for i, c in enumerate(visible(left))], F.col(ORDER).alias("lo"))
    rt = rt.select(*[F.col(quote(c)).alias(f"r{i}") for i, c in enumerate(visible(right))], F.col(ORDER).alias("ro"))
    lat = {c: f"l{i}" for i, c in enumerate(visible(left))}
    rat = {c: f"r{i}" for i, c in enumerate(visible(right))}
    if pairs:
        on = reduce(lambda a, b: a & b, [F.col(lat[a]).eqNullSafe(F.col(rat[b])) for a, b in pairs])
        out = lt.join(rt, on, how)
    elif how == "inner":
        out = lt.crossJoin(rt)
    else:
        out = lt.join(rt, F.lit(True), how)
    left_of = {b: a for a, b in pairs}
    right_of = {a: b for a, b in pairs}

    def value(side, c):
        if side == "l":
            return F.col(lat[c])
        if side == "r":
            return F.col(rat[c])
        if how == "right":
            return F.col(rat[c])
        if how == "full":
            # a null key of a matched row is null on both sides, so coalescing loses nothing
            return F.coalesce(F.col(lat[c]), F.col(rat[right_of[c]]))
        return F.col(lat[c])

    del left_of
    order = [F.col("ro"), F.col("lo")] if how == "right" else [F.col("lo"), F.col("ro")]
    absent = F.col("lo").isNull().cast("int") if how == "full" else F.lit(0)
    return out.select(*[value(s, c).alias(n) for s, c, n in names], F.struct(absent.alias("s"), order[0].alias("a"), order[1].alias("b")).alias(ORDER))


def inner_join(left: DataFrame, right: DataFrame, by=None, **kw) -> DataFrame:
    """Matching rows, in left order."""
    return _join(left, right, by, "inner", **kw)


def left_join(left: DataFrame, right: DataFrame, by=None, **kw) -> DataFrame:
    """Every left row.  With ``by=[]`` it is a cross join, empty when the right table is."""
    return _join(left, right, by, "inner" if by == [] else "left", **kw)


def right_join(left: DataFrame, right: DataFrame, by=None, **kw) -> DataFrame:
    """Every right row; right columns come first and keep their names."""
    return _join(left, right, by, "right", **kw) if by != [] else _cross_right(left, right, **kw)


def _cross_right(left: DataFrame, right: DataFrame, suffix=("_x", "_y")) -> DataFrame:
    flipped = _join(right, left, [], "inner", suffix=("", suffix[0]))
    return flipped


def full_join(left: DataFrame, right: DataFrame, by=None, **kw) -> DataFrame:
    """Every row of both: left rows first, then right rows without a match, whose keys are the right ones."""
    return _join(left, right, by, "inner" if by == [] else "full", **kw)


def cross_join(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    return _join(left, right, [], "inner", **kw)


def _filtering(left: DataFrame, right: DataFrame, by, how: str) -> DataFrame:
    pairs = resolve_by(left, right, by)
    if not pairs:
        raise ArgumentError("keys are needed")
    keys = right.select(*[F.col(quote(b)).alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    on = reduce(lambda a, b: a & b, [F.col(quote(a)).eqNullSafe(F.col(f"_r{i}")) for i, (a, _) in enumerate(pairs)])
    return left.join(keys, on, how)


def semi_join(left: DataFrame, right: DataFrame, by=None) -> DataFrame:
    """Left rows that have a match, once each."""
    return _filtering(left, right, by, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, by=None) -> DataFrame:
    """Left rows without a match."""
    return _filtering(left, right, by, "left_anti")
