"""SQL texts of the series statistics, put together from the same definitions in plain SQL: self-joins where the plans use windows."""

from __future__ import annotations


def loess(name: str, source: str, part: str, x: str, y: str, n: str, span: int, degree: int, jump: int, first: str = "1", last: str | None = None) -> str:
    """CTEs: ``name`` is ``source`` with ``fit``, the local regression of ``y`` over the positions ``x`` of each ``part``."""
    last, keys = last or n, part.split(", ")
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    q = f"least({span}, {n})"
    mine = f"s.{x}"
    value = "sum(w * y) / sum(w)"
    if degree:
        value = """CASE WHEN sqrt(greatest(sum(w * dx * dx) / sum(w) - (sum(w * dx) / sum(w)) ** 2, 0)) > 0.001 * (max(n) - 1)
      THEN sum(w * y) / sum(w) - (sum(w * dx) / sum(w)) * (sum(w * dx * y) / sum(w) - sum(w * dx) / sum(w) * (sum(w * y) / sum(w)))
        / (sum(w * dx * dx) / sum(w) - (sum(w * dx) / sum(w)) ** 2) ELSE sum(w * y) / sum(w) END"""
    return f"""{name}_spots AS MATERIALIZED (
  SELECT *, CASE WHEN greatest(x - lft - 1, lft + q - x) > 0 THEN greatest(x - lft - 1, lft + q - x) ELSE 1 END + CASE WHEN {span} > n THEN ({span} - n) // 2 ELSE 0 END AS width
  FROM (SELECT {part}, {x} AS x, {n} AS n, {q} AS q, greatest(0, least({x} - 1 - ({q} - 1) // 2, {n} - {q})) AS lft FROM {source} WHERE ({x} - {first}) % {jump} = 0 OR {x} = {last})),
{name}_near AS MATERIALIZED (
  SELECT {", ".join("s." + k for k in keys)}, s.x, s.n, d.{x} - s.x AS dx, d.{y} AS y, abs(d.{x} - s.x) / s.width AS u
  FROM {name}_spots s JOIN {source} d ON {same("s", "d")} AND d.{x} > s.lft AND d.{x} <= s.lft + s.q AND d.{y} IS NOT NULL),
{name}_fits AS MATERIALIZED (
  SELECT {part}, x, {value} AS fit FROM (SELECT *, CASE WHEN u <= 0.001 THEN 1.0 WHEN u <= 0.999 THEN (1 - u ** 3) ** 3 ELSE 0.0 END AS w FROM {name}_near) GROUP BY {part}, x),
{name} AS MATERIALIZED (
  SELECT s.*, CASE WHEN b.x > a.x THEN a.fit + (b.fit - a.fit) * ({mine} - a.x) / (b.x - a.x) ELSE a.fit END AS fit
  FROM {source} s JOIN {name}_fits a ON {same("s", "a")} AND a.x = {first} + ({mine} - {first}) // {jump} * {jump}
    JOIN {name}_fits b ON {same("s", "b")} AND b.x = least(a.x + {jump}, {last.replace(n, "s." + n)}))"""


def stl(source: str, m: int, window: int, trend: int, low: int) -> str:
    """CTEs after ``source`` (flag, i, n, y): ``stl`` has (flag, i, n, y, seasonal, trend), two passes, a flat cycle and lines."""
    jump = lambda span: -(-span // 10)
    out, at = [], f"(SELECT *, 0.0 AS t FROM {source})"
    for k in (1, 2):
        out += [
            f"c{k} AS MATERIALIZED (SELECT e.flag, e.g, e.n, (e.g - 1 + {m}) % {m} AS p, (e.g - 1 + {m}) // {m} AS c, b.y - b.t AS d"
            f" FROM (SELECT flag, n, unnest(range(1 - {m}, n + {m} + 1)) AS g FROM {source} WHERE i = 1) e LEFT JOIN {at} b ON b.flag = e.flag AND b.i = e.g)",
            f"k{k} AS MATERIALIZED (SELECT *, count(d) OVER (PARTITION BY flag, p) AS k, g BETWEEN 1 AND n AS own FROM c{k})",
            loess(f"y{k}", f"k{k}", "flag, p", "c", "d", "k", window, 0, jump(window), "0", "k + 1"),
            f"a{k} AS MATERIALIZED (SELECT *, avg(fit) OVER (PARTITION BY flag ORDER BY g ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS a FROM y{k})",
            f"b{k} AS MATERIALIZED (SELECT *, avg(a) OVER (PARTITION BY flag ORDER BY g ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS b FROM a{k})",
            f"l{k} AS MATERIALIZED (SELECT *, avg(b) OVER (PARTITION BY flag ORDER BY g ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM b{k})",
            f"m{k} AS MATERIALIZED (SELECT flag, g AS i, n, fit AS cycle, lag(l, {m}) OVER (PARTITION BY flag ORDER BY g) AS l, own FROM l{k})",
            f"o{k} AS MATERIALIZED (SELECT * FROM m{k} WHERE own)",
            loess(f"w{k}", f"o{k}", "flag", "i", "l", "n", low, 1, jump(low)),
            f"s{k} AS MATERIALIZED (SELECT w.flag, w.i, w.n, t.y, w.cycle - w.fit AS s, t.y - (w.cycle - w.fit) AS d FROM w{k} w JOIN {source} t ON t.flag = w.flag AND t.i = w.i)",
            loess(f"t{k}", f"s{k}", "flag", "i", "d", "n", trend, 1, jump(trend)),
        ]
        at = f"(SELECT flag, i, y, fit AS t FROM t{k})"
    return ",\n".join([*out, "stl AS MATERIALIZED (SELECT flag, i, n, y, s AS seasonal, fit AS trend FROM t2)"])


def interpolated(x: str, xs: list, ys: list) -> str:
    lines = [f"WHEN {x} <= {b} THEN {c} + ({d} - ({c})) * ({x} - ({a})) / ({b} - ({a}))" for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False)]
    return f"CASE WHEN {x} <= {xs[0]} THEN {ys[0]} {' '.join(lines)} ELSE {ys[-1]} END"


def kpss(source: str, keys: str, lag: str) -> str:
    """CTEs after ``source`` (keys, i, n, y): ``kpss`` has (keys, n, lag, statistic) of the test around a level."""
    names = keys.split(", ")
    same = " AND ".join(f"a.{k} = b.{k}" for k in names)
    mine = ", ".join(f"a.{k}" for k in names)
    return f"""kpss_e AS MATERIALIZED (SELECT *, y - avg(y) OVER (PARTITION BY {keys}) AS e, CAST(floor({lag}) AS BIGINT) AS lag FROM {source}),
kpss_run AS (SELECT {keys}, n, lag, e, sum(e) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM kpss_e),
kpss_s AS (SELECT {keys}, n, lag, sum(run * run) / n ** 2 AS s, sum(e * e) / n AS v FROM kpss_run GROUP BY {keys}, n, lag),
kpss_l AS (SELECT {mine}, sum((1 - (b.i - a.i) / (a.lag + 1.0)) * a.e * b.e) AS l FROM kpss_e a JOIN kpss_e b ON {same} AND b.i - a.i BETWEEN 1 AND a.lag GROUP BY {mine}),
kpss AS (SELECT {mine}, a.n, a.lag, a.s / (a.v + 2.0 / a.n * coalesce(b.l, 0)) AS statistic FROM kpss_s a LEFT JOIN kpss_l b ON {same})"""
