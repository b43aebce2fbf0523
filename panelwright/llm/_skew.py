"""Joins and cuts that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is joined by broadcast: there are at most as many.
SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, *, share: int = SHARE) -> DataFrame:
    """Inner join of a written table with ``right``, which has one row per key.

    Keys with more than one ``share``-th of ``left``'s rows, fewer than ``share`` of them, are joined by broadcast, so their
    rows stay where they are; the others meet in a shuffle whose largest group is that small.
    """
    total = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__pw_n")).where(F.col("__pw_n") * share > total).select(key)
    hot = hot.limit(share)  # no more than that can be
    many = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    few = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return many.select(*few.columns).unionByName(few)


def bounds(sample: list[tuple], weights: list[int], parts: int) -> list[tuple]:
    """At most ``parts - 1`` cut points, each a member of ``sample``, between runs of nearly equal weight."""
    total, seen, full, out = sum(weights), 0, 0, []
    for key, weight in sorted(zip(sample, weights, strict=True)):
        if seen * parts // total > full:  # what stands before the key fills one more part, or several
            full = seen * parts // total
            out.append(key)
        seen += weight
    return out


def place(cuts: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` sorted ``cuts`` are at most ``key``, by bisection."""
    if not n:
        return F.lit(0)

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(cuts, middle) <= key)
        return F.struct(
            F.when(right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda s: s["low"])
