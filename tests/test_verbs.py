import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import joins as J
from panelwright.operators import missing as M
from panelwright.operators import reshape as R
from panelwright.operators import verbs as V
from panelwright.operators.frame import ORDER, ArgumentError, across, all_of, everything, final, ingest


def rows(df):
    return [tuple(r) for r in final(df).collect()]


@pytest.fixture(scope="module")
def abc(spark):
    return ingest({"a": [1, 2, 3], "b": [4, 5, 6], "c": [7, 8, 9]}, spark)


@pytest.fixture(scope="module")
def people(spark):
    return ingest({"name": ["x", "y", "z"], "age": [30, 20, 30], "score": [1, 1, 1]}, spark)


@pytest.fixture(scope="module")
def nulls(spark):
    return ingest({"x": [2, None, 1, None], "y": ["a", "b", "c", "d"]}, spark)


def test_ingest(spark):
    with pytest.raises(ArgumentError):
        ingest(5, spark)
    with pytest.raises(ArgumentError):
        ingest({"a": [1], "b": [1, 2]}, spark)
    assert ingest({"a": [1, 2.5]}, spark).schema["a"].dataType.simpleString() == "double"


def test_select_and_rename(abc):
    assert V.select(abc, "c", ("z", "a")).columns[:2] == ["c", "z"]
    assert [c for c in V.select(abc, all_of("b"), everything()).columns if c != ORDER] == ["b", "a", "c"]
    assert V.select(abc).columns == abc.columns
    for bad in (("q",), ("a", "a"), ("a", ("a", "b"))):
        with pytest.raises(ArgumentError):
            V.select(abc, *bad)
    with pytest.raises(ArgumentError):
        V.select(abc, all_of("q"))
    assert V.rename(abc, z="a").columns[0] == "z"
    for bad in ({"z": "q"}, {"b": "a"}, {"p": "a", "q": "a"}):
        with pytest.raises(ArgumentError):
            V.rename(abc, **bad)


def test_query(abc, nulls):
    assert rows(V.query(abc, lambda t: t.a > 1)) == [(2, 5, 8), (3, 6, 9)]
    with pytest.raises(PySparkException, match="missing"):
        V.query(nulls, lambda t: t.x > 1).collect()
    assert rows(V.query(nulls, lambda t: t.x > 1, na="drop")) == [(2, "a")]
    assert rows(V.query(abc, lambda t: (t.a > 1, t.b < 6))) == [(2, 5, 8)]
    with pytest.raises(PySparkException, match="missing"):
        V.query(nulls, lambda t: (t.x.isNull() | (t.x > 0), t.x > 1)).collect()
    halves = V.query(abc.sparkSession.range(20000), lambda t: F.rand(5) < 0.5).count()
    assert 9000 < halves < 11000
    for bad in (lambda t: t.a, lambda t: 5):
        with pytest.raises(ArgumentError):
            V.query(abc, bad)
    with pytest.raises(ArgumentError):
        V.query("x", lambda t: t.a)


def test_arrange(people, nulls):
    assert [r[0] for r in rows(V.arrange(people, ("age", "desc")))] == ["x", "z", "y"]
    assert [r[1] for r in rows(V.arrange(nulls, "x"))] == ["c", "a", "b", "d"]
    assert [r[1] for r in rows(V.arrange(nulls, ("x", "desc")))] == ["a", "c", "b", "d"]
    assert [r[1] for r in rows(V.arrange(nulls, "x", rev=True))] == ["a", "c", "b", "d"]
    assert [r[1] for r in rows(V.arrange(nulls, rev=True))] == ["d", "c", "b", "a"]
    for bad in (("x", "up"), "q"):
        with pytest.raises(ArgumentError):
            V.arrange(nulls, bad)


def test_mutate(abc):
    assert rows(V.mutate(abc, d=lambda t: t.a + 1, e=lambda t: t.d * 2))[0] == (1, 4, 7, 2, 4)
    assert rows(V.mutate(abc, across(["a"], mean=F.avg, twice=lambda c: c * 2)))[0] == (1, 4, 7, 2.0, 2)
    with pytest.raises(ArgumentError):
        V.mutate(abc, d=5)
    with pytest.raises(ArgumentError):
        V.mutate(V.mutate(abc, a_mean=lambda t: t.a), across(["a"], mean=F.avg))


def test_group_and_summarise(spark, nulls):
    t = ingest({"k": ["a", "a", "b", None], "v": [1.0, None, 3.0, 4.0]}, spark)
    g = V.groupby(t, "k")
    out = {r.k: (r.m, r.s, r.n) for r in V.summarise(g, m=("v", "mean"), s=("v", V.skipmissing("mean")), n=("v", "length")).collect()}
    assert out == {"a": (None, 1.0, 2), "b": (3.0, 3.0, 1), None: (4.0, 4.0, 1)}
    assert len(g) == 3 and V.ungroup(g) is t
    first = {r.k: (r.f, r.l) for r in V.summarise(g, f=("v", "first"), l=("v", "last")).collect()}
    assert first["a"] == (1.0, None)
    assert V.summarise(g, across(["v"], max="max")).columns == ["k", "v_max"]
    for bad in (lambda: V.groupby(t), lambda: V.groupby(t, "k", "k"), lambda: V.groupby(t, "q"), lambda: V.summarise(t, a=("v", "mean")), lambda: V.summarise(g, a=5), lambda: V.summarise(g, a=("v", "what")), lambda: V.summarise(g, v_max=("v", "max")) and V.summarise(g, across(["v"], max="max"), v_max=("v", "max"))):
        with pytest.raises(ArgumentError):
            bad()


def test_distinct_bind_head_tail(spark):
    t = ingest({"a": [1, None, 1, None], "b": [10, 20, 30, 40]}, spark)
    assert rows(V.distinct(t, "a", keep_all=True)) == [(1, 10), (None, 20)]
    assert sorted(rows(V.distinct(t, "a")), key=str) == [(1,), (None,)]
    u = ingest({"b": [5], "c": ["x"]}, spark)
    both = V.bind_rows(t, u)
    assert rows(both)[-1] == (None, 5, "x") and len(rows(both)) == 5
    assert rows(V.head(t, 2)) == [(1, 10), (None, 20)] and rows(V.head(t, -3)) == [(1, 10)]
    assert rows(V.tail(t, 1)) == [(None, 40)] and rows(V.tail(t, -3)) == [(None, 40)]
    g = V.groupby(t, "a")
    assert rows(V.head(g, 1).df) == [(1, 10), (None, 20)] and rows(V.tail(g, 1).df) == [(1, 30), (None, 40)]
    assert "Rows: 4" in V.glimpse(t)


def test_joins(spark):
    left = ingest({"id": [1, 2, None, 2], "v": ["a", "b", "c", "d"]}, spark)
    right = ingest({"id": [2, None, 3], "v": ["x", "y", "z"]}, spark)
    assert rows(J.inner_join(left, right, "id")) == [(2, "b", "x"), (None, "c", "y"), (2, "d", "x")]
    assert rows(J.left_join(left, right, "id"))[0] == (1, "a", None)
    full = J.full_join(left, right, "id")
    assert rows(full)[-1] == (3, None, "z") and [c for c in full.columns if c != ORDER] == ["id", "v_x", "v_y"]
    r = J.right_join(left, right, "id")
    assert [c for c in r.columns if c != ORDER] == ["id", "v", "v_x"] and [x[1] for x in rows(r)] == ["x", "x", "y", "z"]
    assert rows(J.semi_join(left, right, "id")) == [(2, "b"), (None, "c"), (2, "d")] and rows(J.anti_join(left, right, "id")) == [(1, "a")]
    assert len(rows(J.inner_join(left, right, []))) == 12 and len(rows(J.left_join(left, right.limit(0), []))) == 0
    for by in ("q", ["id", "id"], 5, [("id",)]):
        with pytest.raises(ArgumentError):
            J.inner_join(left, right, by)
    with pytest.raises(ArgumentError):
        J.inner_join(left, ingest({"w": [1]}, spark))
    a, b = ingest({"id": [1], "x_y": [1], "x": [1]}, spark), ingest({"id": [1], "x": [1]}, spark)
    with pytest.raises(ArgumentError):
        J.inner_join(a, b, "id")
    c, d = ingest({"id": [1], "a": [1], "b": [1]}, spark), ingest({"b": [2], "id": [1], "c": [3]}, spark)
    assert [x for x in J.right_join(c, d, "id").columns if x != ORDER] == ["b", "id", "c", "a", "b_x"]


def test_checked_filters_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = V.select(V.query(lines, lambda t: (t.l_quantity > 45, t.l_tax < 0.03)), "l_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThan(l_quantity,45.0)" in pushed and "LessThan(l_tax,0.03)" in pushed
    assert "struct<l_orderkey:bigint,l_quantity:double,l_tax:double>" in plan
    assert out.count() == lines.where("l_quantity > 45 AND l_tax < 0.03").count()


def test_wide_pivots_take_one_aggregate(spark):
    long = spark.range(6000).selectExpr("id % 20 AS g", "concat('n', id DIV 20) AS n", "id AS v").withColumn(ORDER, F.col("v"))
    wide = R.pivot_wider(long, names_from="n", values_from="v", fill=-1)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" in plan and plan.count("max_by") == 0
    got = wide.orderBy("g").collect()
    assert len(got) == 20 and all(r[f"n{i}"] == i * 20 + r.g for r in got for i in range(300))
    lone = ingest({"n": ["x", "y"], "v": [1, 2]}, spark)
    assert rows(R.pivot_wider(lone, names_from="n", values_from="v", id_cols=[])) == [(1, 2)]
    texts = ingest({"id": [None, None, 3], "n": ["x", "y", "x"], "v": ["a", None, "c"]}, spark)
    assert rows(R.pivot_wider(texts, names_from="n", values_from="v", fill="-")) == [(None, "a", None), (3, "c", "-")]


def test_pivots(spark):
    wide = ingest({"date": ["d1", "d2"], "A": [1, 2], "B": [3, None]}, spark)
    long = R.pivot_longer(wide, id_cols=["date"], names_to="series")
    assert rows(long) == [("d1", "A", 1), ("d1", "B", 3), ("d2", "A", 2), ("d2", "B", None)]
    assert rows(R.pivot_wider(long, names_from="series", values_from="value", fill=0)) == [("d1", 1, 3), ("d2", 2, None)]
    part = ingest({"id": [1, 1, 2], "n": ["b", "a", "a"], "v": [1, 2, 3]}, spark)
    w = R.pivot_wider(part, names_from="n", values_from="v", fill=0)
    assert [c for c in w.columns if c != ORDER] == ["id", "b", "a"] and rows(w) == [(1, 1, 2), (2, 0, 3)]
    twice = ingest({"id": [1, 1], "n": ["a", "a"], "v": [1, 2]}, spark)
    with pytest.raises(PySparkException, match="several values"):
        R.pivot_wider(twice, names_from="n", values_from="v").collect()
    for bad in (dict(names_to="value"), dict(id_cols=["q"]), dict(id_cols=["A"], value_cols=["A"]), dict(id_cols=["date", "A", "B"]), dict(id_cols=["date", "date"]), dict(id_cols=["date"], names_to="date")):
        with pytest.raises(ArgumentError):
            R.pivot_longer(wide, **bad)
    for bad in (dict(names_from="n", values_from="n"), dict(names_from="q", values_from="v"), dict(names_from="n", values_from="v", id_cols=["n"])):
        with pytest.raises(ArgumentError):
            R.pivot_wider(part, **bad)
    with pytest.raises(ArgumentError):
        R.pivot_wider(ingest({"id": [1], "n": ["id"], "v": [1]}, spark), names_from="n", values_from="v")
    with pytest.raises(ArgumentError):
        R.pivot_wider(ingest({"id": [1, 2], "n": ["a", None], "v": [1, 2]}, spark), names_from="n", values_from="v")


def test_separate_unite_complete(spark):
    t = ingest({"id": [1, 2, 3, 4], "s": ["1.x_2", "3_4_5", "6", None]}, spark)
    assert rows(R.separate(t, "s", into=["a", "b"], sep="_")) == [(1, "1.x", "2"), (2, "3", "4"), (3, "6", None), (4, None, None)]
    c = R.separate(t.where("id > 1"), "s", into=["a", "b"], sep="_", convert=True)
    assert c.schema["a"].dataType.simpleString() == "bigint"
    u = R.unite(ingest({"a": [1, None], "b": ["x", "y"], "c": [1, 2]}, spark), "ab", "a", "b")
    assert rows(u) == [("1_x", 1), (None, 2)]
    g = ingest({"a": [1, 1, 2], "b": ["x", "y", "x"], "v": [1, 2, 3]}, spark)
    assert rows(R.complete(g, "a", "b", fill=0))[-1] == (2, "y", 0)
    for bad in (lambda: R.separate(t, "s", into=["a", "a"]), lambda: R.separate(t, "s", into=["id"]), lambda: R.unite(g, "x"), lambda: R.unite(g, "v", "a", "b"), lambda: R.complete(g, "q")):
        with pytest.raises(ArgumentError):
            bad()


def test_missing(spark):
    t = ingest({"a": [None, 1, None, 2, None], "b": [1, 2, 3, 4, 5]}, spark)
    pick = lambda d: [r[0] for r in rows(M.fill_missing(t, "a", direction=d))]
    assert pick("down") == [None, 1, 1, 2, 2] and pick("up") == [1, 1, 2, 2, None] and pick("downup") == [1, 1, 1, 2, 2] and pick("updown") == [1, 1, 2, 2, 2]
    with pytest.raises(ArgumentError):
        M.fill_missing(t, "a", direction="left")
    with pytest.raises(ArgumentError):
        M.fill_missing(t, "q")
    v = ingest({"x": [1.0, float("nan"), 3.0, 4.0, None, 5.0, 6.0]}, spark)
    assert [r[0] for r in rows(M.longest_contiguous(v, "x"))] == [3.0, 4.0]
    assert [r[0] for r in rows(M.interpolate_linear(v, "x"))] == [1.0, 2.0, 3.0, 4.0, 4.5, 5.0, 6.0]
    assert M.drop_missing(v).count() == 5
    with pytest.raises(PySparkException, match="missing"):
        M.check_missing(v).collect()


def test_result_does_not_depend_on_partitions(spark):
    t = ingest(spark.range(200).withColumn("k", F.col("id") % 7).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id"))), order="id")
    for n in (1, 5):
        p = t.repartition(n)
        assert rows(V.select(V.head(V.groupby(p, "k"), 2).df, "id")) == [(i,) for i in range(14)]
        assert rows(M.fill_missing(p, "v"))[3] == (3, 3, 2)


def test_dates_survive(spark):
    t = ingest({"d": [dt.date(2020, 1, 1), None]}, spark)
    assert rows(V.arrange(t, "d"))[0] == (dt.date(2020, 1, 1),)
