"""Wide and long forms, splitting and joining of text columns, completion of combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frame import ORDER, ArgumentError, check_known, check_unique, cols, group_window, like, ordered, quote, visible
from panelwright.operators.panel import Panel


def pivot_longer(data, *, id_cols=None, value_cols=None, names_to: str = "variable", values_to: str = "value"):
    """Wide to long, row by row and column by column.  Columns that are neither become ids."""
    if isinstance(data, Panel):
        fixed = [*data.groups, *([data.date] if data.date else [])]
        ids = list(dict.fromkeys([*fixed, *(id_cols or ([] if value_cols else fixed))]))
        values = value_cols or [c for c in visible(data.df) if c not in ids]
        return data.with_df(pivot_longer(data.df, id_cols=ids, value_cols=values, names_to=names_to, values_to=values_to))
    names = visible(data)
    ids, values = list(id_cols or []), list(value_cols or [])
    check_unique(ids, "id columns")
    check_unique(values, "value columns")
    check_known(data, [*ids, *values])
    if names_to == values_to:
        raise ArgumentError("names_to and values_to must differ")
    if set(ids) & set(values):
        raise ArgumentError(f"columns are ids and values: {sorted(set(ids) & set(values))}")
    values = values or [c for c in names if c not in ids]
    ids = [*ids, *[c for c in names if c not in ids and c not in values]]
    if not values:
        raise ArgumentError("no columns to pivot")
    clash = {names_to, values_to} & set(ids)
    if clash:
        raise ArgumentError(f"output columns {sorted(clash)} exist among the ids")
    df = ordered(data)
    # an array of (position, name, value) keeps the columns' order; unpivot alone has none
    kind = df.unpivot(cols(ids), cols(values), "_n", "_v").schema["_v"].dataType
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(c).alias("n"), F.col(quote(c)).cast(kind).alias("v")) for i, c in enumerate(values)]
    )
    out = df.select(*cols(ids), F.col(ORDER), F.explode(cells).alias("_c"))
    return like(
        data,
        out.select(*cols(ids), F.col("_c.n").alias(names_to), F.col("_c.v").alias(values_to), F.struct(F.col(ORDER).alias("o"), F.col("_c.i").alias("i")).alias(ORDER)),
    )


def pivot_wider(data, *, names_from: str, values_from: str, id_cols=None, fill=None, sort_names: bool = False, max_names: int = 10_000):
    """Long to wide.  New columns appear in the order of their first row; an explicit null stays null, an absent
    cell takes ``fill``; a repeated (id, name) raises.  Learning the names runs one aggregation; more than ``max_names``
    columns are refused."""
    if isinstance(data, Panel):
        fixed = [*data.groups, *([data.date] if data.date else [])]
        ids = list(dict.fromkeys([*fixed, *(id_cols or [])])) or None
        return data.with_df(pivot_wider(data.df, names_from=names_from, values_from=values_from, id_cols=ids, fill=fill, sort_names=sort_names))
    if names_from == values_from:
        raise ArgumentError("names_from and values_from must differ")
    ids = list(id_cols) if id_cols is not None else [c for c in visible(data) if c not in (names_from, values_from)]
    check_known(data, [names_from, values_from, *ids])
    check_unique(ids, "id columns")
    if {names_from, values_from} & set(ids):
        raise ArgumentError("names_from and values_from can't be ids")
    df = ordered(data)
    name, value = F.col(quote(names_from)), F.col(quote(values_from))
    found = df.groupBy(name.alias("n")).agg(F.min(ORDER).alias("o")).orderBy("o").select("n").limit(max_names + 1).collect()
    labels = [r.n for r in found]
    if None in labels:
        raise ArgumentError(f"{names_from!r} has missing names")
    if len(labels) > max_names:
        raise ArgumentError(f"more than {max_names} new columns")
    labels = sorted(labels) if sort_names else labels
    texts = [str(x) for x in labels]
    check_unique(texts, "new column names")
    if set(texts) & set(ids):
        raise ArgumentError(f"new columns {sorted(set(texts) & set(ids))} are ids")
    kind = data.schema[values_from].dataType
    # a row per cell first, which finds repeated ones; then each finds its column by a hash
    keys = [f"_k{i}" for i in range(len(ids))]
    cells = df.select(*[F.col(quote(c)).alias(k) for c, k in zip(ids, keys, strict=True)], name.alias("_n"), value.alias("_v"), F.col(ORDER).alias("_o"))
    cells = cells.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_c"), F.any_value("_v").alias("_v"), F.min("_o").alias("_o"))
    twice = F.raise_error(F.concat(F.lit("several values for one id and name "), F.col("_n").cast("string")))
    cells = cells.withColumn("_v", F.when(F.col("_c") > 1, twice.cast(kind)).otherwise(F.col("_v")))
    cells = cells.withColumn("_o", F.min("_o").over(group_window(keys)) if keys else F.lit(0))
    found = [F.first("_v")] + ([F.first("_c")] if fill is not None else [])
    wide = cells.groupBy(*keys, "_o").pivot("_n", labels).agg(*[a.alias(f"a{i}") for i, a in enumerate(found)])
    places = [f"_p{i}" for i in range(len(labels) * len(found))]
    wide = wide.toDF(*keys, "_o", *places)
    out = []
    for t, p in zip(texts, places[:: len(found)], strict=True):
        cell = F.col(p) if fill is None else F.when(F.col(f"_p{int(p[2:]) + 1}").isNull(), F.lit(fill)).otherwise(F.col(p))
        out.append(cell.alias(t))
    return like(data, wide.select(*[F.col(k).alias(c) for c, k in zip(ids, keys, strict=True)], *out, F.col("_o").alias(ORDER)))


def separate(data: DataFrame, column: str, *, into: list[str], sep: str = " ", regex: bool = False, remove: bool = True, convert: bool = False) -> DataFrame:
    """Split a text column.  Parts beyond ``into`` are dropped, absent ones are null.  ``convert`` makes a part integer if
    all its values are, else double, else text; that takes one aggregation over the column."""
    check_known(data, [column])
    check_unique(into, "new columns")
    if not into:
        raise ArgumentError("into needs names")
    others = [c for c in data.columns if c != column or not remove]
    if set(into) & set(others):
        raise ArgumentError(f"columns {sorted(set(into) & set(others))} exist already")
    pattern = sep if regex else r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E"
    parts = F.split(F.col(quote(column)).cast("string"), pattern)
    new = {n: F.get(parts, F.lit(i)) for i, n in enumerate(into)}
    if convert:
        wide = data.select(*[c.alias(n) for n, c in new.items()])
        tests = []
        for i, n in enumerate(into):
            c = F.col(quote(n))
            whole = c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull()
            tests += [F.bool_and(c.isNull() | whole).alias(f"i{i}"), F.bool_and(c.isNull() | c.try_cast("double").isNotNull()).alias(f"f{i}")]
        seen = wide.agg(*tests).first()
        for i, n in enumerate(into):
            if seen[f"i{i}"]:
                new[n] = F.trim(new[n]).cast("bigint")
            elif seen[f"f{i}"]:
                new[n] = F.trim(new[n]).cast("double")
    out = []
    for c in data.columns:
        if c != column:
            out.append(F.col(quote(c)))
            continue
        if not remove:
            out.append(F.col(quote(c)))
        out += [e.alias(n) for n, e in new.items()]
    return data.select(*out)


def unite(data: DataFrame, new: str, *columns: str, sep: str = "_", remove: bool = True) -> DataFrame:
    """Join columns as text at the place of the first one; null if any is null."""
    if not columns:
        raise ArgumentError("unite needs columns")
    check_known(data, columns)
    others = [c for c in data.columns if not (remove and c in columns)]
    if new in others:
        raise ArgumentError(f"column {new!r} exists already")
    parts = [x for c in columns for x in (F.lit(sep), F.col(quote(c)).cast("string"))][1:]
    first = next(c for c in data.columns if c in columns)
    out = []
    for c in data.columns:
        if c == first:
            out.append(F.concat(*parts).alias(new))
        if not (remove and c in columns):
            out.append(F.col(quote(c)))
    return data.select(*out)


def complete(data: DataFrame, *columns: str, fill=None) -> DataFrame:
    """Append a row for each combination of observed values that is absent; other columns take ``fill``, a value or a
    dict by column.  The product of the distinct values is the result's own size, so it's built by cross joins."""
    if not columns:
        raise ArgumentError("complete needs columns")
    check_known(data, columns)
    check_unique(columns, "columns")
    df = ordered(data)
    values = [df.select(F.col(quote(c)).alias(f"_c{i}")).distinct() for i, c in enumerate(columns)]
    grid = reduce(lambda a, b: a.crossJoin(b), values)
    on = reduce(lambda a, b: a & b, [grid[f"_c{i}"].eqNullSafe(df[quote(c)]) for i, c in enumerate(columns)])
    absent = grid.join(df.select(*cols(columns)), on, "left_anti")
    at = {c: f"_c{i}" for i, c in enumerate(columns)}

    def value(c):
        if c in at:
            return F.col(at[c]).alias(c)
        v = fill.get(c) if isinstance(fill, dict) else fill
        return F.lit(v).cast(data.schema[c].dataType).alias(c)

    names = visible(data)
    if ORDER in data.columns:
        kind = df.schema[ORDER].dataType
        old = F.struct(F.lit(0).alias("s"), F.col(ORDER).alias("o")).alias(ORDER)
        new = F.struct(F.lit(1).alias("s"), F.lit(None).cast(kind).alias("o")).alias(ORDER)
        return df.select(*cols(names), old).unionByName(absent.select(*[value(c) for c in names], new))
    return df.select(*cols(names)).unionByName(absent.select(*[value(c) for c in names]))
