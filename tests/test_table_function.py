import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelwright.operators import verbs as v
from panelwright.operators.frame import ArgumentError
from panelwright.operators.grouped import group_batches, table_function
from panelwright.operators.panel import panel


def functions():
    """Functions that travel by value, since workers can't import this module."""

    def spans(key, batches):
        """One row per batch: number of the batch, rows, first and last value."""
        for i, rows in enumerate(batches):
            yield pd.DataFrame({"batch": [i], "n": [len(rows)], "first": [rows["v"].iloc[0]], "last": [rows["v"].iloc[-1]], "name": [str(key)]})

    def only_first(key, batches):
        return pd.DataFrame({"v": [int(next(batches)["v"].iloc[0])]})

    return spans, only_first


spans, only_first = functions()


def test_large_group_passes_in_ordered_batches(spark):
    rows = spark.range(25000).selectExpr("if(id % 5 = 0, 'small', 'large') AS g", "24999 - id AS v")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        out = table_function(v.groupby(rows, "g"), spans, "batch int, n int, first long, last long, name string", order=["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and plan.count("Exchange ") == 1 and "MapInArrow" in plan
        got = out.orderBy("g", "batch").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for g, total in (("large", 20000), ("small", 5000)):
        mine = [r for r in got if r.g == g]
        assert [r.batch for r in mine] == list(range(len(mine))) and len(mine) >= total // 1000
        assert sum(r.n for r in mine) == total and max(r.n for r in mine) <= 1000
        assert all(a.last < b.first for a, b in zip(mine, mine[1:])) and {r.name for r in mine} == {str({"g": g})}


def test_keys_are_those_of_grouping(spark):
    rows = spark.createDataFrame(
        [(None, 1), (None, 2), (0.0, 3), (-0.0, 4), (float("nan"), 5), (float("nan"), 6), (2.5, 7)], "k double, v long"
    ).selectExpr("k", "v", "if(v % 2 = 0, NULL, 'a') AS t")
    for by in (["k"], ["k", "t"]):
        out = table_function(rows, only_first, "v long", by=by, order=["v"])
        least = rows.selectExpr("nanvl(k, double('nan')) AS k", "v", "t").groupBy(*by).agg({"v": "min"}).collect()
        assert sorted(r.v for r in out.collect()) == sorted(r["min(v)"] for r in least)
    assert table_function(rows, only_first, "v long", by=["k"], order=["v"], partitions=1).count() == 4
    assert table_function(rows.limit(0), only_first, "v long", by=["k"]).collect() == []
    assert table_function(rows, lambda key, batches: None, "x long", by=["k"]).collect() == []


def test_groups_that_are_not_read_are_skipped():
    batches = [pa.record_batch({"k": [1, 1], "v": [1, 2]}), pa.record_batch({"k": [1, 2, 2], "v": [3, 4, 5]}), pa.record_batch({"k": [2, 3], "v": [6, 7]})]
    seen = [key.to_pylist()[0]["k"] for key, _ in group_batches(iter(batches), ["k"])]
    assert seen == [1, 2, 3]
    assert [[r["v"] for b in rows for r in b.to_pylist()] for _, rows in group_batches(iter(batches), ["k"])] == [[1, 2, 3], [4, 5, 6], [7]]
    assert list(group_batches(iter([batches[0].slice(0, 0)]), ["k"])) == []


def test_panels_arrow_and_a_named_function(spark):
    days = spark.range(40).selectExpr("id % 2 AS g", "date_add(date'2024-01-01', cast(20 - id DIV 2 AS int)) AS day", "id AS y")
    p = panel(days, groups="g", date="day", frequency="day", target="y")

    def whole(key, batches):
        for b in batches:
            yield b.select(["day", "y"])

    out = table_function(p, whole, "day date, y long", kind="arrow").toPandas()
    assert len(out) == 40 and all(part["day"].is_monotonic_increasing for _, part in out.groupby("g"))
    numbers = spark.range(3000).selectExpr("id % 3 AS g", "id", "if(id % 11 = 0, NULL, cast((id * 7919) % 201 - 101 AS long)) AS x")
    got = table_function(numbers, "panelwright.functions.streams:cusum", "id long, high long, since long", by=["g"], order=["id"]).toPandas()
    for g, part in numbers.toPandas().sort_values("id").groupby("g"):
        s = since = 0
        want = []
        for x in part["x"]:
            s = max(0, s + (0 if np.isnan(x) else int(x)))
            since = 0 if s == 0 else since + 1
            want.append((s, since))
        mine = got[got["g"] == g].sort_values("id")
        assert list(zip(mine["high"], mine["since"], strict=True)) == want


def test_refusals(spark):
    rows = spark.range(3).selectExpr("id AS g", "id AS v", "array(id) AS a")
    for options in ({}, {"by": ["a"]}, {"by": ["x"]}, {"by": ["g"], "order": ["x"]}, {"by": ["g"], "kind": "rows"}, {"by": ["v"]}):
        with pytest.raises(ArgumentError):
            table_function(rows, only_first, "v long", **options)
    with pytest.raises(ArgumentError):
        table_function(rows, "nothing", "v long", by=["g"])
