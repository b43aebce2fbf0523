"""Functions of whole groups that see a group's rows in order, batch by batch.

``applyInPandas`` holds a whole group in memory.  Here the rows are dealt out by their keys, sorted by keys and order within
a partition (a sort that spills), and read as Arrow batches; a group is what lies between two changes of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from panelwright import workers
from panelwright.operators.frame import ORDER, ArgumentError, Grouped, check_known, check_unique, cols, quote, visible
from panelwright.operators.panel import Panel

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def table_function(data, function: Callable | str, schema: str | T.StructType, *, by: Sequence[str] = (), order: Sequence[str | Column] = (), kind: str = "pandas", partitions: int | None = None) -> DataFrame:
    """The keys and the columns of ``schema``, as ``function(key, batches)`` yields them for each group.

    ``key`` is a dict of the group's keys, ``batches`` an iterator of its rows (pandas frames, or Arrow record batches
    with ``kind="arrow"``) of at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows each.  A function that
    carries a state over them and yields as it reads needs memory for a batch, however large the group; one that stops
    early has the rest of the group skipped.  It is named as ``"module:function"``, which each worker imports, or given.

    Groups of a ``Grouped`` table or a ``Panel`` are theirs, and a panel's order is its date.  Rows follow ``order``
    (nulls first), rows that agree in it the table's row order if it has one.  Null keys, and NaN, form one group each, and
    -0.0 belongs to 0.0.  An empty table has no groups and gives no rows.  A group is read by one task, since its rows come in
    order; what doesn't need that should be an aggregate or a window.  A table without keys is refused.
    """
    if isinstance(data, Panel):
        order = order or ([data.date] if data.date is not None else [])
        data, by = data.df, by or data.groups
    elif isinstance(data, Grouped):
        data, by = data.df, by or data.keys
    if not isinstance(data, DataFrame):
        raise ArgumentError("not a table")
    if not by:
        raise ArgumentError("a table function needs groups")
    if kind not in ("pandas", "arrow"):
        raise ArgumentError("kind is 'pandas' or 'arrow'")
    check_known(data, [*by, *[o for o in order if isinstance(o, str)]])
    check_unique(by, "grouping columns")
    nested = [k for k in by if isinstance(data.schema[k].dataType, _NESTED)]
    if nested:
        raise ArgumentError(f"columns {nested} can't be keys")
    result = data.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    check_unique([*by, *result.names], "columns of the result")
    names = visible(data)
    for k in by:
        if isinstance(data.schema[k].dataType, (T.DoubleType, T.FloatType)):
            # 0.0 for -0.0
            data = data.withColumn(k, (data[quote(k)] + 0.0).cast(data.schema[k].dataType))
    count = partitions or int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = [*cols(by), *[quote(o) if isinstance(o, str) else o for o in order], *([ORDER] if ORDER in data.columns else [])]
    rows = data.repartition(count, *cols(by)).sortWithinPartitions(*line).select(*cols(names))
    if isinstance(function, str):
        module, _, name = function.partition(":")
        if not name:
            raise ArgumentError("a function is named as 'module:function'")
        function = (module, name)
    out = T.StructType([data.schema[k] for k in by] + list(result.fields))
    return rows.mapInArrow(workers.batches(__name__, "run_groups", function, list(by), result.json(), kind), out)


def group_batches(batches, by: list[str]) -> Iterator[tuple]:
    """(key as a batch of one row, iterator of the group's batches) of batches sorted by ``by``.

    An iterator that isn't read to its end is read on before the next group comes.
    """
    pieces = _pieces(batches, by)
    piece = next(pieces, None)
    while piece is not None:
        following = []

        def group(first=piece, following=following):
            yield first[1]
            for p in pieces:
                if p[0]:
                    following.append(p)
                    return
                yield p[1]

        rows = group()
        yield piece[1].select(by).slice(0, 1), rows
        for _ in rows:
            pass
        piece = following[0] if following else None


def _pieces(batches, by: list[str]) -> Iterator[tuple]:
    """(whether a group begins, rows of one group)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = last is None
        for k in by:
            here = batch.column(k)
            ends = here if last is None else pa.concat_arrays([last.column(k), here])
            a, b = ends.slice(0, len(ends) - 1), ends.slice(1)
            both = pc.and_(pc.is_null(a, nan_is_null=False), pc.is_null(b, nan_is_null=False))
            if pa.types.is_floating(here.type):
                both = pc.or_(both, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            same = pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)
            change[len(change) - len(same) :] |= ~same
        cuts = np.flatnonzero(change).tolist()
        begins = [0, *[c for c in cuts if c]]
        for start, stop in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            yield bool(change[start]), batch.slice(start, stop - start)
        last = batch.slice(batch.num_rows - 1).select(by)


def run_groups(batches, function, by: list[str], schema: str, kind: str) -> Iterator:
    """What a task does: ``function`` over each group, its columns by name and type of ``schema``, behind the keys."""
    import importlib
    import json

    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(function, tuple):
        function = getattr(importlib.import_module(function[0]), function[1])
    result = to_arrow_schema(T.StructType.fromJson(json.loads(schema)))
    for key, rows in group_batches(batches, by):
        given = rows if kind == "arrow" else (r.to_pandas() for r in rows)
        made = function(key.to_pylist()[0], given)
        for table in [made] if isinstance(made, (pd.DataFrame, pa.RecordBatch, pa.Table)) else chain(made if made is not None else ()):
            if isinstance(table, pd.DataFrame):
                table = pa.Table.from_pandas(table, schema=result, preserve_index=False)
            else:
                table = pa.table(table.columns, names=table.schema.names).select(result.names).cast(result)
            for piece in table.to_batches():
                if piece.num_rows:
                    places = pa.array([0] * piece.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*[key.column(k).take(places) for k in by], *piece.columns], names=[*by, *result.names])
