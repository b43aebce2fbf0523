import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import missing, verbs
from panelwright.operators.frame import ORDER, ArgumentError, across, ingest
from panelwright.operators.panel import panel
from panelwright.operators.positions import numbered
from panelwright.plans import designs
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def table(spark):
    a, b = RNG.normal(size=(2, 400))
    rows = [(float(x), float(y), float(x + 1e-9 * RNG.normal()), float(2 * x - y), 3.0, float(x * y)) for x, y in zip(a, b, strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 3.0, 1.0)], "a double, b double, near double, both double, flat double, y double").repartition(40)


def test_ranks_of_whole_tables(table):
    # columns equal but for a billionth are independent, as a singular value decomposition finds
    data = np.array([r[:5] for r in table.dropna().collect()])
    for names in (["a", "b"], ["a", "near"], ["a", "b", "near"], ["a", "b", "both"], ["a", "flat"], ["near", "both", "b"]):
        x = np.column_stack([np.ones(len(data)), *[data[:, ["a", "b", "near", "both", "flat"].index(n)] for n in names]])
        assert designs.is_rank_deficient(table, names) == (np.linalg.matrix_rank(x) < x.shape[1])
    assert not designs.is_rank_deficient(table, ["flat"], intercept=False) and designs.is_rank_deficient(table.limit(0), ["a"])
    with pytest.raises(ArgumentError):
        designs.ensure_full_rank(table, ["a", "b", "both"])
    assert designs.ensure_full_rank(table, ["a", "b"]) is table


def test_columns_that_others_explain_are_left_out(table):
    p = designs.prepare(table, "y ~ a + b + both + flat", dropcollinear=True)
    assert len(p.names) == 3 and len(p.dropped) == 2
    x = np.array([list(r) for r in designs.matrix(table, p).dropna().collect()])
    assert np.linalg.matrix_rank(x) == 3
    assert [n for n in designs.matrix(table, "~ a + near - 1", dropcollinear=True).columns] == ["a", "near"]
    assert designs.drop_constant_columns(table, ["a", "flat"]).columns == ["a", "b", "near", "both", "y"]
    with pytest.raises(ArgumentError):
        designs.drop_constant_columns(table, ["flat"])


def test_a_design_is_applied_to_new_data_by_name(spark, table):
    p = designs.prepare(table, "~ a * b + both", dropcollinear=True)
    new = spark.createDataFrame([(1.0, 2.0, 3.0)], "b double, both double, a double")
    got = designs.matrix(new, p).first().asDict()
    whole = {"(Intercept)": 1.0, "a": 3.0, "b": 1.0, "both": 2.0, "a:b": 3.0}
    assert list(got) == list(p.names) and got == {n: whole[n] for n in p.names} and len(got) == 4
    with pytest.raises(ArgumentError):
        designs.matrix(new.drop("a"), p)
    frame = designs.model_frame(table, "y ~ a:b", ("flat",))
    assert frame.columns == ["flat", "y", "(Intercept)", "a:b"] and frame.count() == 400
    with pytest.raises(ArgumentError):
        designs.model_frame(table, "~ a")
    assert designs.align_columns(table, ["b", "a"]).columns == ["b", "a"]


def test_designs_are_regressors_of_models(spark):
    a, b = RNG.normal(size=(2, 60))
    y = 5 + 2 * a * b + 0.01 * RNG.normal(size=60)
    rows = [("g", dt.date(2015 + i // 12, i % 12 + 1, 1), float(y[i]), float(a[i]), float(b[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, month date, y double, a double, b double")
    p = panel(df.where("month < '2019-10-01'"), groups="g", date="month", m=12, target="y")
    new = df.where("month >= '2019-10-01'").drop("y").select("b", "month", "g", "a")
    spec = sp.arima_spec("y = p(0) + d(0) + q(0) + P(0) + Q(0) + D(0)", xreg_formula="~ a:b")
    got = [r["mean"] for r in fits.forecast(spec, p, 3, newdata=new, fail_fast=True).orderBy("step").collect()]
    assert got == pytest.approx(y[57:].tolist(), abs=0.05)
    assert fits.fit(spec, p).first().status == "ok"
    with pytest.raises(ArgumentError):
        fits.forecast(sp.arima_spec("y = p(0) + q(0)", xreg_formula="~ a:unknown"), p, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_numbers_and_slices_of_whole_tables(spark, n):
    rows = [(i, i // 3, None if i % 5 else f"v{i}") for i in range(n)]
    df = ingest(spark.createDataFrame(rows, "k int, tie int, v string").repartition(6), order="tie")
    got = numbered(df, F.col("tie"), F.col("k").desc()).collect()
    want = sorted(range(n), key=lambda i: (i // 3, -i))
    assert [r.k for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(1, n + 1))
    for m in (1, 3, 5, 200):
        for cutter, kept in ((verbs.head, lambda m: want[: max(n - m, 0)]), (verbs.tail, lambda m: want[m:])):
            out = cutter(df, -m)
            # of rows that tie at the edge any may go
            assert sorted(r.tie for r in out.collect()) == sorted(i // 3 for i in kept(m))


@pytest.mark.parametrize("direction", ["down", "up", "downup", "updown"])
def test_values_carried_over_parts(spark, direction):
    v = [None, None, "a", None, None, None, "b", None, None, "c", None]
    w = [None] * 10 + [1]
    df = ingest(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(v, w, strict=True))], "i int, v string, w int").repartition(4), order="i")
    got = [(r.v, r.w) for r in missing.fill_missing(df, "v", "w", direction=direction).orderBy("i").collect()]

    def fill(x):
        x, last = list(x), None
        for i, y in enumerate(x):
            last = x[i] = y if y is not None else last
        return x

    ways = {"down": fill, "up": lambda x: fill(x[::-1])[::-1]}
    for k, x in enumerate((v, w)):
        for way in {"down": ["down"], "up": ["up"], "downup": ["down", "up"], "updown": ["up", "down"]}[direction]:
            x = ways[way](x)
        assert [r[k] for r in got] == x
    assert missing.fill_missing(df.limit(0), "v", direction=direction).count() == 0


def test_no_window_runs_over_a_whole_table(spark):
    df = ingest(spark.createDataFrame([(i, float(i)) for i in range(20)], "i int, x double"), order="i")
    for out in (verbs.mutate(df, across(["x"], mean=F.avg)), verbs.head(df, -3), missing.fill_missing(df, "x"), numbered(df, F.col("i"))):
        for line in plan(out).splitlines():
            assert "SinglePartition" not in line or "Window" not in line
            if "Window [" in line:
                # a partition key stands before the order: (key, order ASC ..)
                assert ", [" in line and not line.rstrip().endswith("[], [")
    assert verbs.mutate(df, across(["x"], mean=F.avg)).select("x_mean").distinct().collect()[0][0] == 9.5
    assert ORDER in df.columns
