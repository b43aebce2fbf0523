"""Places of rows within their groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import keep

#: ``monotonically_increasing_id`` holds the partition above this many bits.
_ROW_BITS = 33


def ranked(frame: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``frame`` with ``rank``, the row's place in its group from 0, and ``size``, the rows of the group.

    The rows are sorted by ranges of (group, order), so a group with a third of all rows lies in a third of the partitions,
    and written.  What the partitions hold of each group is one row per (partition, group), of which there are at most as
    many as partitions and groups together; sums over these give where each part of a group begins.  Rows that agree in
    every column of ``order`` are told apart by where they were read, so they can lie in several partitions too.
    Null is a group like any other.
    """
    tied = frame.withColumn("__pw_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "__pw_tie"]
    rows = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__pw_tie")
    rows = keep(rows.withColumn("__pw_row", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__pw_part", F.shiftright("__pw_row", _ROW_BITS))
    per = rows.groupBy(*group, "__pw_part").agg(F.min("__pw_row").alias("__pw_first"), F.count(F.lit(1)).alias("__pw_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__pw_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = per.select(
        *[F.col(g).alias(f"__pw_{g}") for g in group],
        F.col("__pw_part").alias("__pw_at"),
        (F.coalesce(F.sum("__pw_n").over(before), F.lit(0)) - F.col("__pw_first")).alias("__pw_shift"),
        F.sum("__pw_n").over(whole).alias("size"),
    )
    same = F.col("__pw_part") == F.col("__pw_at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__pw_{g}"))  # null is a group
    placed = rows.join(runs, same).withColumn("rank", F.col("__pw_row") + F.col("__pw_shift"))
    return placed.select(*frame.columns, "rank", "size")
