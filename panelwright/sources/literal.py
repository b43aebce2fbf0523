"""Schemas for literal columns."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T


def _kind(values) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds <= {datetime.datetime}:
        return T.TimestampNTZType()
    if kinds <= {datetime.date}:
        return T.DateType()
    if kinds <= {str}:
        return T.StringType()
    raise ValueError(f"mixed types {sorted(k.__name__ for k in kinds)}")


def schema_of(columns: dict) -> T.StructType:
    """The common type of each column; integers and floats meet as double."""
    return T.StructType([T.StructField(n, _kind(v)) for n, v in columns.items()])


def table(spark, columns: dict):
    """A DataFrame of literal columns."""
    schema = schema_of(columns)
    floats = {f.name for f in schema if isinstance(f.dataType, T.DoubleType)}
    data = {n: [float(x) if n in floats and x is not None else x for x in v] for n, v in columns.items()}
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), schema)
