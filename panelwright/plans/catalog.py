"""The named queries of the library and their DuckDB counterparts.

A query is registered with ``@query(sql)``; its result and the SQL's have equal column names, and doubles are rounded
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import accuracy as acc
from panelwright.functions import naive as nv
from panelwright.functions import series as ts
from panelwright.operators import joins, missing, reshape, verbs
from panelwright.operators.frame import ORDER, across, all_of, everything, ingest
from panelwright.operators.panel import Panel, panel
from panelwright.operators.positions import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from panelwright.plans import models, smoothers, statistics  # noqa: F401  register their queries

    return QUERIES


def oracle_sql() -> dict:
    queries()
    return ORACLES


def read(spark: SparkSession, sf_dir: str, table: str, order: str | list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return ingest(df, order=order) if order else df


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, the order column dropped."""
    out = [F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes if n != ORDER]
    return df.select(*out)


# --- columns and rows ------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def select_rename(spark, d):
    return verbs.select(read(spark, d, "customer"), ("id", "c_custkey"), ("name", "c_name"), "c_acctbal")


@query("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def select_selectors(spark, d):
    nation = verbs.select(read(spark, d, "nation"), "n_nationkey", "n_name", "n_regionkey")
    return verbs.select(nation, all_of("n_name"), everything())


@query("SELECT s_suppkey AS supplier, s_name, s_acctbal AS balance FROM supplier")
def rename_columns(spark, d):
    return verbs.rename(verbs.select(read(spark, d, "supplier"), "s_suppkey", "s_name", "s_acctbal"), supplier="s_suppkey", balance="s_acctbal")


@query("SELECT o_orderkey, round(o_totalprice / 1000.0, 6) AS k, round(o_totalprice / 1000.0 * 2, 6) AS k2 FROM orders")
def mutate_sequential(spark, d):
    out = verbs.mutate(read(spark, d, "orders"), k=lambda t: t.o_totalprice / 1000.0, k2=lambda t: t.k * 2)
    return rounded(verbs.select(out, "o_orderkey", "k", "k2"), 6)


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 3) AS c_acctbal_dev, round(max(c_acctbal) OVER (PARTITION BY c_mktsegment), 3) AS c_acctbal_max FROM customer")
def mutate_across(spark, d):
    g = verbs.groupby(read(spark, d, "customer"), "c_mktsegment")
    out = verbs.mutate(g, across(["c_acctbal"], max=F.max))
    out = verbs.mutate(out, c_acctbal_dev=lambda t: t.c_acctbal - F.avg(t.c_acctbal).over(t.window))
    return rounded(verbs.select(verbs.ungroup(out), "c_custkey", "c_acctbal_dev", "c_acctbal_max"), 3)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def query_filter(spark, d):
    out = verbs.query(read(spark, d, "lineitem"), lambda t: (t.l_quantity > 45) & (t.l_returnflag == "R"), na="drop")
    return verbs.select(out, "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 300000")
def query_strict(spark, d):
    return verbs.select(verbs.query(read(spark, d, "orders"), lambda t: t.o_totalprice > 300000), "o_orderkey", "o_orderpriority")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC NULLS LAST, s_acctbal ASC NULLS LAST, s_suppkey) AS place
FROM (SELECT *, s_nationkey FROM supplier)""")
def arrange_place(spark, d):
    out = verbs.arrange(read(spark, d, "supplier", "s_suppkey"), ("s_nationkey", "desc"), "s_acctbal")
    return numbered(out.select("s_suppkey", ORDER), F.col(ORDER), name="place").drop(ORDER)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= (SELECT max(c_custkey) - 5 FROM customer)")
def head_negative_table(spark, d):
    return verbs.select(verbs.head(read(spark, d, "customer", "c_custkey"), -5), "c_custkey", "c_name").drop(ORDER)


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r > 11")
def tail_negative_table(spark, d):
    return verbs.select(verbs.tail(read(spark, d, "customer", "c_custkey"), -11), "c_custkey", "c_name").drop(ORDER)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS number FROM orders")
def row_numbers(spark, d):
    return numbered(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc(), F.col("o_orderkey")).drop("o_totalprice")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal, round((SELECT avg(s_acctbal) FROM supplier), 4) AS s_acctbal_mean, round((SELECT max(s_acctbal) FROM supplier), 2) AS s_acctbal_top FROM supplier")
def mutate_across_table(spark, d):
    out = verbs.mutate(verbs.select(read(spark, d, "supplier"), "s_suppkey", "s_acctbal"), across(["s_acctbal"], mean=F.avg, top=F.max))
    return out.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"), F.round("s_acctbal_mean", 4).alias("s_acctbal_mean"), F.round("s_acctbal_top", 2).alias("s_acctbal_top"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 50 = 3 THEN value END AS v FROM events)
SELECT event_id, round(coalesce(first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 4) AS v FROM t""")
def fill_missing_table(spark, d):
    e = read(spark, d, "events", "event_id").withColumn("v", F.when(F.col("event_id") % 50 == 3, F.col("value")))
    return rounded(missing.fill_missing(e, "v", direction="updown").select("event_id", "v"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def arrange_head(spark, d):
    out = verbs.arrange(read(spark, d, "orders", "o_orderkey"), ("o_totalprice", "desc"))
    return rounded(verbs.select(verbs.head(out, 10), "o_orderkey", "o_totalprice"), 2)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def head_grouped(spark, d):
    g = verbs.groupby(read(spark, d, "orders", "o_orderkey"), "o_custkey")
    return verbs.select(verbs.ungroup(verbs.head(g, 2)), "o_orderkey", "o_custkey").drop(ORDER)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 3")
def tail_negative(spark, d):
    g = verbs.groupby(read(spark, d, "orders", "o_orderkey"), "o_custkey")
    return verbs.select(verbs.ungroup(verbs.tail(g, -3)), "o_orderkey", "o_custkey").drop(ORDER)


@query("SELECT * FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 7)")
def tail_table(spark, d):
    return verbs.select(verbs.tail(read(spark, d, "customer", "c_custkey"), 7), "c_custkey", "c_name").drop(ORDER)


# --- groups ----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price,
round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def summarise_pricing(spark, d):
    g = verbs.groupby(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    out = verbs.summarise(g, sum_qty=("l_quantity", "sum"), avg_price=("l_extendedprice", "mean"), avg_disc=("l_discount", "mean"), n=("l_quantity", "length"))
    return out.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("avg_price", 2).alias("avg_price"), F.round("avg_disc", 4).alias("avg_disc"), "n")


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 3) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 3) AS c_acctbal_std,
round(median(c_acctbal), 3) AS c_acctbal_median FROM customer GROUP BY 1""")
def summarise_across(spark, d):
    g = verbs.groupby(read(spark, d, "customer"), "c_mktsegment")
    return rounded(verbs.summarise(g, across(["c_acctbal"], mean="mean", std="std", median="median")), 3)


@query("""SELECT o_orderpriority, round(sum(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / sum(o_totalprice), 6) AS share,
round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY 1""")
def summarise_functions(spark, d):
    g = verbs.groupby(read(spark, d, "orders"), "o_orderpriority")
    out = verbs.summarise(
        g,
        share=(("o_totalprice", "o_orderstatus"), lambda p, s: F.sum(F.when(s == "F", p).otherwise(0.0)) / F.sum(p)),
        p90=("o_totalprice", verbs.quantile(0.9)),
    )
    return out.select("o_orderpriority", F.round("share", 6).alias("share"), F.round("p90", 2).alias("p90"))


@query("""WITH t AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 50 = 0 AND o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_orderpriority, CASE WHEN count(v) = count(*) THEN round(avg(v), 2) END AS strict, round(avg(v), 2) AS skipping FROM t GROUP BY 1""")
def summarise_missing(spark, d):
    t = verbs.mutate(read(spark, d, "orders"), v=lambda t: F.when(~((t.o_orderkey % 50 == 0) & t.o_orderpriority.like("1%")), t.o_totalprice))
    out = verbs.summarise(verbs.groupby(t, "o_orderpriority"), strict=("v", "mean"), skipping=("v", verbs.skipmissing("mean")))
    return rounded(out, 2)


@query("SELECT count(*) AS groups, min(n) AS min_size, max(n) AS max_size, round(avg(n), 4) AS mean_size FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def group_sizes(spark, d):
    return rounded(verbs.groupby(read(spark, d, "orders"), "o_custkey").sizes())


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(spark, d):
    return verbs.distinct(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_keep_all(spark, d):
    out = verbs.distinct(read(spark, d, "orders", "o_orderkey"), "o_custkey", keep_all=True)
    return verbs.select(out, "o_custkey", "o_orderkey", "o_orderstatus").drop(ORDER)


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS extra FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, 's' FROM supplier""")
def bind_rows_union(spark, d):
    a = verbs.select(read(spark, d, "customer"), ("key", "c_custkey"), ("name", "c_name"), ("balance", "c_acctbal"))
    b = verbs.select(read(spark, d, "supplier"), ("key", "s_suppkey"), ("name", "s_name")).withColumn("extra", F.lit("s"))
    return verbs.bind_rows(a, b).drop(ORDER)


# --- joins -----------------------------------------------------------------------------------------------------


def _some_nulls(df: DataFrame, column: str, every: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) % every != 0, F.col(column)))


@query("""SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_inner(spark, d):
    o = verbs.select(read(spark, d, "orders"), "o_orderkey", "o_custkey")
    c = verbs.select(read(spark, d, "customer"), "c_custkey", "c_name", "c_mktsegment")
    return joins.inner_join(o, c, [("o_custkey", "c_custkey")]).drop(ORDER)


_NULL_KEYS = """WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS k FROM supplier),
n AS (SELECT CASE WHEN 2 * n_nationkey % 5 <> 0 THEN 2 * n_nationkey END AS k, n_name FROM nation) """


def _null_keys(spark, d):
    s = _some_nulls(verbs.select(read(spark, d, "supplier"), "s_suppkey", ("k", "s_nationkey")), "k", 5)
    # suppliers of odd nations find none, and keys above 24 no supplier
    doubled = verbs.mutate(read(spark, d, "nation"), k=lambda t: t.n_nationkey * 2)
    n = _some_nulls(verbs.select(doubled, "k", "n_name"), "k", 5)
    return s, n


@query(_NULL_KEYS + "SELECT s.s_suppkey, s.k, n.n_name FROM s JOIN n ON s.k IS NOT DISTINCT FROM n.k")
def join_inner_nulls(spark, d):
    s, n = _null_keys(spark, d)
    return joins.inner_join(s, n, "k").drop(ORDER)


@query(_NULL_KEYS + "SELECT s.s_suppkey, s.k, n.n_name FROM s LEFT JOIN n ON s.k IS NOT DISTINCT FROM n.k")
def join_left(spark, d):
    s, n = _null_keys(spark, d)
    return joins.left_join(s, n).drop(ORDER)


@query(_NULL_KEYS + "SELECT n.k, n.n_name, s.s_suppkey FROM s RIGHT JOIN n ON s.k IS NOT DISTINCT FROM n.k")
def join_right(spark, d):
    s, n = _null_keys(spark, d)
    return joins.right_join(s, n, "k").drop(ORDER)


@query(_NULL_KEYS + "SELECT s.s_suppkey, coalesce(s.k, n.k) AS k, n.n_name FROM s FULL JOIN n ON s.k IS NOT DISTINCT FROM n.k")
def join_full(spark, d):
    s, n = _null_keys(spark, d)
    return joins.full_join(s, n, "k").drop(ORDER)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def join_semi(spark, d):
    c = verbs.select(read(spark, d, "customer"), "c_custkey", "c_name")
    return joins.semi_join(c, read(spark, d, "orders").where("o_totalprice > 350000"), {"c_custkey": "o_custkey"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def join_anti(spark, d):
    dear = read(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000")
    return joins.anti_join(verbs.select(read(spark, d, "customer"), "c_custkey", "c_name"), dear, {"c_custkey": "o_custkey"})


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return joins.cross_join(verbs.select(read(spark, d, "region"), "r_name"), verbs.select(read(spark, d, "nation"), "n_name")).drop(ORDER)


@query("""SELECT a.o_orderkey, a.o_totalprice AS o_totalprice_x, b.o_totalprice AS o_totalprice_y FROM orders a
JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O') b USING (o_orderkey)""")
def join_suffixes(spark, d):
    o = verbs.select(read(spark, d, "orders"), "o_orderkey", "o_totalprice")
    p = verbs.select(read(spark, d, "orders").where("o_orderstatus = 'O'"), "o_orderkey", "o_totalprice")
    return joins.inner_join(o, p, "o_orderkey").drop(ORDER)


# --- shape -----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, variable, round(value, 4) AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax))""")
def pivot_longer_lines(spark, d):
    t = verbs.select(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(reshape.pivot_longer(t, id_cols=["l_orderkey", "l_linenumber"]))


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS "O"
FROM lineitem GROUP BY 1""")
def pivot_wider_status(spark, d):
    t = verbs.summarise(verbs.groupby(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), q=("l_quantity", "sum"))
    return rounded(reshape.pivot_wider(t, names_from="l_linestatus", values_from="q", sort_names=True), 2)


@query("""SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS VARCHAR) AS level, nullif(split_part(o_orderpriority, '-', 2), '') AS word FROM orders""")
def separate_priority(spark, d):
    t = verbs.select(read(spark, d, "orders"), "o_orderkey", "o_orderpriority")
    return reshape.separate(t, "o_orderpriority", into=["level", "word"], sep="-")


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer""")
def separate_convert(spark, d):
    t = verbs.select(read(spark, d, "customer"), "c_custkey", "c_name")
    return reshape.separate(t, "c_name", into=["kind", "number"], sep="#", convert=True)


@query("SELECT n_name || '/' || CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS label FROM nation")
def unite_null(spark, d):
    t = _some_nulls(verbs.select(read(spark, d, "nation"), "n_name", "n_regionkey"), "n_regionkey", 1 << 40)
    t = t.withColumn("n_regionkey", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")))
    return reshape.unite(t, "label", "n_name", "n_regionkey", sep="/")


@query("""WITH t AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT p, month, coalesce(n, 0) AS n FROM (SELECT DISTINCT p FROM t) CROSS JOIN (SELECT DISTINCT month FROM t) LEFT JOIN t USING (p, month)""")
def complete_grid(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
    t = verbs.summarise(verbs.groupby(o, "p", "month"), n=lambda t: F.count(F.lit(1)))
    return reshape.complete(t, "p", "month", fill=0)


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS v FROM t""")
def fill_missing_both(spark, d):
    e = read(spark, d, "events", "event_id").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    out = missing.fill_missing(verbs.groupby(e, "user_id"), "v", direction="downup").df
    return rounded(out.select("event_id", "v"))


@query("""WITH t AS (SELECT user_id, event_id, event_id % 7 <> 0 AS ok FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t),
k AS (SELECT user_id, run, count(*) AS n FROM r WHERE ok GROUP BY 1, 2),
b AS (SELECT user_id, run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) AS rn FROM k) WHERE rn = 1)
SELECT r.user_id, r.event_id FROM r JOIN b ON r.user_id = b.user_id AND r.run = b.run WHERE r.ok""")
def longest_run(spark, d):
    e = read(spark, d, "events", "event_id").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return missing.longest_contiguous(e, "v", "event_id", ("user_id",)).select("user_id", "event_id")


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 1 THEN value END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
u AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
first_value(y IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM t
WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN y IS NOT NULL THEN y WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 4) AS v FROM u""")
def interpolate_events(spark, d):
    e = read(spark, d, "events", "event_id").withColumn("v", F.when(F.col("event_id") % 4 != 1, F.col("value")))
    return rounded(missing.interpolate_linear(e, "v", "event_id", ("user_id",)).select("event_id", "v"))


# --- series ----------------------------------------------------------------------------------------------------

_MONTHS = """WITH flow AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) """


def monthly_flow(spark, d) -> DataFrame:
    t = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_quantity")
    return verbs.summarise(verbs.groupby(t, "flag", "month"), q=("l_quantity", "sum"))


@query(_MONTHS + """SELECT flag, month, round(d1 - lag(d1) OVER (PARTITION BY flag ORDER BY month), 4) AS d2 FROM
(SELECT *, q - lag(q) OVER (PARTITION BY flag ORDER BY month) AS d1 FROM flow)""")
def series_diff(spark, d):
    return rounded(ts.diff(monthly_flow(spark, d), "q", order="month", keys=("flag",), times=2, name="d2").select("flag", "month", "d2"))


@query("""WITH t AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT p, month, round(n - lag(n, 12) OVER w, 3) AS n_diff, round(v - lag(v, 12) OVER w, 3) AS v_diff FROM t WINDOW w AS (PARTITION BY p ORDER BY month)""")
def series_diff_columns(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_totalprice")
    t = verbs.summarise(verbs.groupby(o, "p", "month"), n=("o_totalprice", "length"), v=("o_totalprice", "sum"))
    return rounded(ts.diff_columns(t, ["n", "v"], order="month", keys=("p",), lag=12).select("p", "month", "n_diff", "v_diff"), 3)


@query("SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_discount), 2) AS l_discount FROM lineitem")
def column_sums(spark, d):
    return rounded(ts.col_sums(read(spark, d, "lineitem"), "l_quantity", "l_discount"), 2)


@query("""WITH t AS (SELECT user_id, event_id, value AS a, lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY event_id) AS p,
row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT *, max(CASE WHEN i = ceil(0.3 * n) THEN m END) OVER (PARTITION BY user_id) AS f FROM t),
r AS (SELECT user_id, a - p AS e, p - CASE WHEN i <= ceil(0.3 * n) THEN f ELSE m END AS r FROM u)
SELECT user_id, round(avg(e * e), 3) AS mse, round(avg(abs(e)), 4) AS mae, round(sum(abs(r)), 3) AS mar, round(sum(r * r), 2) AS msr FROM r GROUP BY 1""")
def metrics_of_two_columns(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").withColumn("p", F.lag("value", 1).over(Window.partitionBy("user_id").orderBy("event_id")))
    out = acc.evaluation_metrics(e.withColumn("p", F.coalesce("p", "value")), "value", "p", order="event_id", keys=("user_id",))
    return out.select("user_id", F.round("mse", 3).alias("mse"), F.round("mae", 4).alias("mae"), F.round("mar", 3).alias("mar"), F.round("msr", 2).alias("msr"))


@query(_MONTHS + """SELECT flag, month, round((CASE WHEN count(q) OVER a = 12 THEN sum(q) OVER a END + CASE WHEN count(q) OVER b = 12 THEN sum(q) OVER b END) / 24, 4) AS ma FROM flow
WINDOW a AS (PARTITION BY flag ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (PARTITION BY flag ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)""")
def series_ma(spark, d):
    return rounded(ts.symmetric_ma(monthly_flow(spark, d), "q", 12, order="month", keys=("flag",)).select("flag", "month", "ma"))


@query(_MONTHS + """, x AS (SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY month) AS i, q - avg(q) OVER (PARTITION BY flag) AS dv, count(*) OVER (PARTITION BY flag) AS n FROM flow),
g AS (SELECT a.flag, b.i - a.i AS lag, sum(a.dv * b.dv) AS g, max(a.n) AS n FROM x a JOIN x b ON a.flag = b.flag AND b.i - a.i BETWEEN 0 AND 12 GROUP BY 1, 2)
SELECT flag, CAST(g.lag AS INT) AS lag, round(g.g / (SELECT z.g FROM g z WHERE z.flag = g.flag AND z.lag = 0), 6) AS value, round(1.96 / sqrt(n), 6) AS ci FROM g""")
def series_acf(spark, d):
    return rounded(ts.acf(monthly_flow(spark, d), "q", order="month", keys=("flag",), max_lag=12), 6)


_TREND = _MONTHS + """, t AS (SELECT flag, month, q, row_number() OVER (PARTITION BY flag ORDER BY month) AS i,
(CASE WHEN count(q) OVER a = 12 THEN sum(q) OVER a END + CASE WHEN count(q) OVER b = 12 THEN sum(q) OVER b END) / 24 AS trend FROM flow
WINDOW a AS (PARTITION BY flag ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (PARTITION BY flag ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) """


@query(_TREND + """, f AS (SELECT flag, (i - 1) % 12 AS p, avg(q - trend) AS s FROM t GROUP BY 1, 2),
c AS (SELECT flag, avg(s) AS c FROM f GROUP BY 1)
SELECT t.flag, t.month, round(t.trend, 3) AS trend, round(f.s - c.c, 3) AS seasonal, round(t.q - (f.s - c.c) - t.trend, 3) AS remainder
FROM t JOIN f ON t.flag = f.flag AND (t.i - 1) % 12 = f.p JOIN c ON c.flag = t.flag""")
def series_decompose(spark, d):
    out = ts.decompose(monthly_flow(spark, d), "q", 12, order="month", keys=("flag",))
    return rounded(out.select("flag", "month", "trend", "seasonal", "remainder"), 3)


@query(_TREND + """, f AS (SELECT flag, (i - 1) % 12 AS p, avg(q / trend) AS s FROM t GROUP BY 1, 2),
c AS (SELECT flag, avg(s) AS c FROM f GROUP BY 1)
SELECT t.flag, t.month, round(f.s / c.c, 5) AS seasonal, round(t.q / (f.s / c.c * t.trend), 5) AS remainder
FROM t JOIN f ON t.flag = f.flag AND (t.i - 1) % 12 = f.p JOIN c ON c.flag = t.flag""")
def series_decompose_multiplicative(spark, d):
    out = ts.decompose(monthly_flow(spark, d), "q", 12, order="month", keys=("flag",), kind="multiplicative")
    return rounded(out.select("flag", "month", "seasonal", "remainder"), 5)


@query("SELECT o_orderkey, round((pow(o_totalprice, 0.25) - 1) / 0.25, 5) AS bc, round(o_totalprice, 3) AS back FROM orders")
def box_cox_roundtrip(spark, d):
    o = read(spark, d, "orders").withColumn("bc", ts.box_cox(F.col("o_totalprice"), 0.25))
    return o.select("o_orderkey", F.round("bc", 5).alias("bc"), F.round(ts.inv_box_cox(F.col("bc"), 0.25), 3).alias("back"))


@query(_MONTHS + """, t AS (SELECT flag, month, row_number() OVER (PARTITION BY flag ORDER BY month) AS t FROM flow)
SELECT flag, month, round(sin(2 * pi() * t / 12), 6) + 0.0 AS "S1", round(cos(2 * pi() * t / 12), 6) + 0.0 AS "C1", round(sin(4 * pi() * t / 12), 6) + 0.0 AS "S2", round(cos(4 * pi() * t / 12), 6) + 0.0 AS "C2" FROM t""")
def series_fourier(spark, d):
    out = ts.fourier(monthly_flow(spark, d), 12, 2, order="month", keys=("flag",))
    return rounded(out.drop("q"), 6).select("flag", "month", *[(F.col(c) + 0.0).alias(c) for c in ("S1", "C1", "S2", "C2")])


# --- panels, closed-form models, accuracy ----------------------------------------------------------------------

_REVENUE = """WITH raw AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS revenue FROM orders
WHERE o_orderdate < (SELECT CASE WHEN max(o_orderdate)::DATE = last_day(max(o_orderdate)::DATE) THEN max(o_orderdate) + INTERVAL 1 DAY
ELSE date_trunc('month', max(o_orderdate)) END FROM orders) GROUP BY 1, 2),
grid AS (SELECT p.priority, m.month::DATE AS month FROM (SELECT DISTINCT priority FROM raw) p,
(SELECT unnest(generate_series((SELECT min(month) FROM raw)::TIMESTAMP, (SELECT max(month) FROM raw)::TIMESTAMP, INTERVAL 1 MONTH)) AS month) m),
panel AS (SELECT grid.priority, grid.month, coalesce(revenue, 0.0) AS revenue, revenue IS NULL AS revenue_is_imputed,
row_number() OVER (PARTITION BY grid.priority ORDER BY grid.month) AS i, count(*) OVER (PARTITION BY grid.priority) AS n
FROM grid LEFT JOIN raw ON raw.priority = grid.priority AND raw.month = grid.month),
train AS (SELECT *, n - 6 AS k FROM panel WHERE i <= n - 6), test AS (SELECT *, i - (n - 6) AS step FROM panel WHERE i > n - 6) """


def revenue_panel(spark, d) -> Panel:
    """Monthly revenue per order priority on a complete, common grid; months without orders are 0, and the last month goes
    unless orders reach its last day."""
    orders = read(spark, d, "orders")
    day = F.max(F.col("o_orderdate").cast("date"))
    end = orders.agg(F.when(day == F.last_day(day), F.date_add(day, 1)).otherwise(F.trunc(day, "month")).alias("end")).scalar()
    o = orders.where(F.col("o_orderdate").cast("date") < end)
    o = o.select(F.col("o_orderpriority").alias("priority"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_totalprice")
    t = verbs.summarise(verbs.groupby(o, "priority", "month"), revenue=("o_totalprice", "sum"))
    return panel(t, groups="priority", date="month", frequency="month", target="revenue", fill_time=True, balanced=True, target_na="zero")


def split_panel(p: Panel, last: int) -> tuple[Panel, DataFrame]:
    """All but the ``last`` rows of each series, and those rows."""
    from panelwright.operators.frame import group_window

    tagged = p.df.withColumn("_left", F.count(F.lit(1)).over(group_window(p.groups)) - F.row_number().over(p.window))
    train = tagged.where(F.col("_left") >= last).drop("_left")
    return p.with_df(train), tagged.where(F.col("_left") < last).drop("_left")


@query(_REVENUE + "SELECT priority, month, round(revenue, 2) AS revenue, revenue_is_imputed FROM panel")
def panel_fill_time(spark, d):
    return rounded(revenue_panel(spark, d).df, 2)


@query("""WITH t AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2),
g AS (SELECT user_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM t GROUP BY 1),
j AS (SELECT g.user_id, g.day, t.v AS y, row_number() OVER (PARTITION BY g.user_id ORDER BY g.day) AS i FROM g LEFT JOIN t ON t.user_id = g.user_id AND t.day = g.day),
u AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
first_value(y IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM j
WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, day, round(CASE WHEN y IS NOT NULL THEN y WHEN ni - pi - 1 <= 2 THEN pv + (i - pi) * (nv - pv) / (ni - pi) END, 4) AS v,
y IS NULL AND ni - pi - 1 <= 2 AS v_is_imputed FROM u""")
def panel_linear_gaps(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    t = verbs.summarise(verbs.groupby(e, "user_id", "day"), v=("value", "sum"))
    p = panel(t, groups="user_id", date="day", frequency="day", target="v", fill_time=True, target_na="linear", max_gap=2)
    return rounded(p.df)


_Z = {80: 1.2815515655446004, 95: 1.959963984540054}


def _bounds(se: str) -> str:
    return ", ".join(f"round(mean - {z!r} * {se}, 2) AS lower_{k}, round(mean + {z!r} * {se}, 2) AS upper_{k}" for k, z in _Z.items())


_SNAIVE = _REVENUE + """, r AS (SELECT *, revenue - lag(revenue, 12) OVER (PARTITION BY priority ORDER BY i) AS e FROM train),
s AS (SELECT priority, sqrt(avg(e * e)) AS sigma, max(k) AS k FROM r GROUP BY 1),
fc AS (SELECT s.priority, h.step, t.revenue AS mean, sigma FROM s, (SELECT unnest(range(1, 7))::INT AS step) h, train t
WHERE t.priority = s.priority AND t.i = s.k - 12 + h.step) """


@query(_SNAIVE + f"SELECT priority, step, round(mean, 2) AS mean, {_bounds('sqrt(ceil(step / 12)) * sigma')}, 'snaive' AS model FROM fc")
def forecast_snaive(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.snaive(train, "revenue", 6), 2)


@query(_REVENUE + f""", r AS (SELECT *, revenue - lag(revenue) OVER (PARTITION BY priority ORDER BY i) AS e FROM train),
s AS (SELECT priority, sqrt(avg(e * e)) AS sigma, arg_max(revenue, i) AS mean FROM r GROUP BY 1)
SELECT priority, step, round(mean, 2) AS mean, {_bounds('sqrt(step) * sigma')}, 'naive' AS model FROM s, (SELECT unnest(range(1, 7))::INT AS step)""")
def forecast_naive(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.naive(train, "revenue", 6), 2)


_LOG = ", ".join(f"round(exp(mean - {z!r} * sqrt(step) * sigma), 2) AS lower_{k}, round(exp(mean + {z!r} * sqrt(step) * sigma), 2) AS upper_{k}" for k, z in _Z.items())


@query(_REVENUE + f""", t AS (SELECT *, CASE WHEN revenue > 0 THEN ln(revenue) END AS ly FROM train), r AS (SELECT *, ly - lag(ly) OVER (PARTITION BY priority ORDER BY i) AS e FROM t),
s AS (SELECT priority, sqrt(avg(e * e)) AS sigma, arg_max(ly, i) FILTER (WHERE ly IS NOT NULL) AS mean FROM r GROUP BY 1)
SELECT priority, step, round(exp(mean) * (1 + 0.5 * step * sigma * sigma), 2) AS mean, {_LOG}, 'naive' AS model FROM s, (SELECT unnest(range(1, 7))::INT AS step)""")
def forecast_naive_log(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.naive(train, "revenue", 6, lam=0, biasadj=True), 2)


@query(_REVENUE + f""", r AS (SELECT *, revenue - lag(revenue) OVER (PARTITION BY priority ORDER BY i) AS e FROM train),
s AS (SELECT priority, stddev_samp(e) AS sigma, avg(e) AS drift, count(e) AS ne, arg_max(revenue, i) AS last FROM r GROUP BY 1),
f AS (SELECT priority, step, last + step * drift AS mean, sqrt(step * sigma * sigma + step * step * sigma * sigma / ne) AS se FROM s, (SELECT unnest(range(1, 7))::INT AS step))
SELECT priority, step, round(mean, 2) AS mean, {_bounds('se')}, 'rw' AS model FROM f""")
def forecast_rw_drift(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.rw(train, "revenue", 6), 2)


@query(_REVENUE + """SELECT priority, step, round(avg(revenue), 2) AS mean, 'meanf' AS model FROM train, (SELECT unnest(range(1, 7))::INT AS step) GROUP BY 1, 2""")
def forecast_meanf(spark, d):
    train, _ = split_panel(revenue_panel(spark, d), 6)
    return rounded(nv.meanf(train, "revenue", 6).select("priority", "step", "mean", "model"), 2)


@query(_SNAIVE + """, e AS (SELECT fc.priority, fc.step, test.revenue AS a, test.revenue - fc.mean AS e FROM fc JOIN test ON test.priority = fc.priority AND test.step = fc.step),
m AS (SELECT *, avg(e) OVER (PARTITION BY priority) AS m, lead(e) OVER (PARTITION BY priority ORDER BY step) AS nx FROM e),
sc AS (SELECT priority, avg(abs(dd)) AS scale FROM (SELECT priority, revenue - lag(revenue) OVER (PARTITION BY priority ORDER BY i) AS dd FROM train) GROUP BY 1)
SELECT 'snaive' AS model, m.priority, round(avg(e), 2) AS "ME", round(sqrt(avg(e * e)), 2) AS "RMSE", round(avg(abs(e)), 2) AS "MAE",
round(avg(CASE WHEN a <> 0 THEN 100 * e / a END), 4) AS "MPE", round(avg(CASE WHEN a <> 0 THEN abs(100 * e / a) END), 4) AS "MAPE",
round(sum((e - m) * (nx - m)) / sum((e - m) * (e - m)), 4) AS "ACF1", round(avg(abs(e)) / max(scale), 4) AS "MASE"
FROM m JOIN sc ON sc.priority = m.priority GROUP BY 2""")
def revenue_forecast_accuracy(spark, d):
    """The flagship: aggregate, complete the panel, forecast by seasonal naive, score on the last six months."""
    train, test = split_panel(revenue_panel(spark, d), 6)
    out = acc.accuracy(nv.snaive(train, "revenue", 6), test, keys=["priority"], value="revenue", time="month", training=train.df)
    money = [F.round(c, 2).alias(c) for c in ("ME", "RMSE", "MAE")]
    return out.select("model", "priority", *money, *[F.round(c, 4).alias(c) for c in ("MPE", "MAPE", "ACF1", "MASE")])


@query("""SELECT p_partkey, CAST(t AS INT) AS t, round(1000 * (1 - exp(-(0.03 + 0.38) * t)) / (1 + (0.38 / 0.03) * exp(-(0.03 + 0.38) * t)), 5) AS bass,
round(1000 * exp(-4 * exp(-0.4 * t)), 5) AS gompertz, round(1000 * (1 - exp(-0.3 * t)) * pow(1 + 2 * exp(-0.3 * t), -1.5), 5) AS gsgompertz,
round(1000 * (1 - exp(-pow(t / 6.0, 1.8))), 5) AS weibull FROM (SELECT p_partkey, p_size AS t FROM part)""")
def diffusion_curves(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("t"))
    x = F.col("t").cast("double")
    return rounded(
        t.select("p_partkey", "t", ts.bass(x, 1000, 0.03, 0.38).alias("bass"), ts.gompertz(x, 1000, 4, 0.4).alias("gompertz"),
                 ts.gsgompertz(x, 1000, 2, 0.3, 1.5).alias("gsgompertz"), ts.weibull(x, 1000, 6, 1.8).alias("weibull")), 5,
    )
