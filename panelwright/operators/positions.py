"""Row numbers and carried values over a whole table, without sending it to one task.

Rows are sorted by ranges of their order and written, so that the parts and the places in them are settled; what is known
of a part is one row, and there are no more of these than partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.frame import quote
from panelwright.plans.stored import cut

#: ``monotonically_increasing_id`` holds the partition above this many bits.
_ROW_BITS = 33
PART, ROW = "_pw_part", "_pw_row"


def in_parts(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` by ranges of ``order``, written, with its part and a number that ascends along the order.

    Rows that agree in ``order`` keep some order among them.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn(ROW, F.monotonically_increasing_id()))
    return rows.withColumn(PART, F.shiftright(ROW, _ROW_BITS))


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with each row's place in the whole order, from 1."""
    rows = in_parts(df, *order)
    before, total = [], 0
    for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).orderBy(PART).collect():
        before.append((r[PART], total - (r[PART] << _ROW_BITS) + 1))
        total += r["n"]
    shifts = df.sparkSession.createDataFrame(before, f"{PART} long, _pw_shift long")
    return rows.join(F.broadcast(shifts), PART).withColumn(name, F.col(ROW) + F.col("_pw_shift")).drop(PART, ROW, "_pw_shift")


def carried(df: DataFrame, columns: list[str], *order: Column, direction: str = "down") -> DataFrame:
    """``columns`` with nulls replaced by the last value before them (down), by the next one (up), or by both in turn."""
    rows = in_parts(df, *order)
    line = Window.partitionBy(PART)
    ways = {"down": ("down",), "up": ("up",), "downup": ("down", "up"), "updown": ("up", "down")}[direction]
    ends = []
    for way in ways:
        for i, c in enumerate(columns):
            pick = F.max_by if way == "down" else F.min_by
            ends.append(pick(F.col(quote(c)), F.when(F.col(quote(c)).isNotNull(), F.col(ROW))).alias(f"{way}{i}"))
    known = rows.groupBy(PART).agg(*ends).orderBy(PART).collect()
    carry: dict[int, dict] = {r[PART]: {} for r in known}
    for way in ways:
        for i in range(len(columns)):
            value = None
            for r in known if way == "down" else reversed(known):
                carry[r[PART]][f"{way}{i}"] = value
                value = r[f"{way}{i}"] if r[f"{way}{i}"] is not None else value
    fields = [T.StructField(PART, T.LongType())] + [T.StructField(f"_pw_{way}{i}", df.schema[c].dataType) for way in ways for i, c in enumerate(columns)]
    table = df.sparkSession.createDataFrame([(k, *(v[f.name.removeprefix("_pw_")] for f in fields[1:])) for k, v in carry.items()], T.StructType(fields))
    rows = rows.join(F.broadcast(table), PART)
    new = {}
    for i, c in enumerate(columns):
        found = []
        for way in ways:
            w = line.orderBy(ROW if way == "down" else F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, 0)
            found += [F.last(F.col(quote(c)), ignorenulls=True).over(w), F.col(f"_pw_{way}{i}")]
        new[c] = F.coalesce(*found)
    return rows.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in df.columns])
