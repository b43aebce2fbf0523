import numpy as np
import pyarrow as pa
import pytest

from panelwright.kernels import croston, optimize, registry
from panelwright.operators.panel import panel
from panelwright.plans import catalog
from panelwright.plans import fit as fits
from panelwright.plans import specs as sp

SF = "/root/testdata/sf0.001"
KINDS = ("classic", "sba", "sbj")


def demands(n: int, b: int, whole: bool) -> np.ndarray:
    rng = np.random.default_rng(n)
    y = np.where(rng.random((b, n)) < 0.2 + 0.6 * rng.random((b, 1)), rng.integers(1, 5, (b, n)) if whole else rng.gamma(2, 3, (b, n)), 0.0)
    y[:, 0], y[:, -1] = 1.0, 2.5  # two demands at least
    y[0] *= -1
    return y


def test_searches_side_by_side_take_the_steps_of_single_ones():
    f = lambda p: (p[0] - 1) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2 + abs(p[2] - p[3])
    many = lambda p, rows: (p[:, 0] - 1) ** 2 + 100 * (p[:, 1] - p[:, 0] ** 2) ** 2 + np.abs(p[:, 2] - p[:, 3])
    x0 = np.random.default_rng(3).normal(size=(20, 4))
    x0[0] = 0
    for maxit in (5, 9, 40, 400):
        assert optimize.nelder_mead_many(many, x0, maxit=maxit).tolist() == [optimize.nelder_mead(f, x, maxit=maxit).x.tolist() for x in x0]


@pytest.mark.parametrize("n, whole", [(2, True), (9, False), (30, True)])
@pytest.mark.parametrize(
    "options", [{}, {"cost_metric": "mse", "number_of_params": 1}, {"cost_metric": "mae", "init_strategy": "naive"}, {"cost_metric": "msr", "optimize_init": False}]
)
def test_rates_of_many_series_are_those_of_single_ones(n, whole, options):
    with np.errstate(all="ignore"):
        y = demands(n, 6, whole)
        want = [[croston.croston(r, kind=k, **options).forecast(1).mean[0] for k in KINDS] for r in y]
        assert np.array_equal(croston.last_rates(y, list(KINDS), **options), want, equal_nan=True)
        z = np.vstack([np.abs(y), np.zeros(n), np.eye(1, n, n // 2)[0]])
        assert croston.last_ratios(z, 0.2).tolist() == [croston.croston_hyndman(r, alpha=0.2).forecast(1).mean[0] for r in z]


def test_no_series_of_a_batch_is_searched_alone(monkeypatch):
    monkeypatch.setattr(croston, "nelder_mead", lambda *a, **k: pytest.fail("a single search"))
    y = np.vstack([demands(20, 12, True)[1:], np.abs(demands(20, 12, False))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(y))), pa.array(y.tolist(), pa.list_(pa.float64()))], ["g", "_y"])
    specs = [{"kernel": "croston", "name": k, "options": {"kind": k}, "m": 7, "columns": [], "auto": False} for k in KINDS]
    out = pa.Table.from_batches(registry.croston_batches([batch], specs, ["g"], 2, [], True)).to_pylist()
    assert len(out) == len(y) * 3 * 2 and {r["status"] for r in out} == {"ok"}


def test_forecasts_in_batches_are_those_of_groups(spark, monkeypatch):
    """Gaps, single and negative demands, unequal lengths, a null key and options that are refused."""
    rows = []
    for g in range(12):
        for i in range(14 + g % 3):
            y = float((g * i * 7 + i * i) % 5 % 3)
            y = None if g == 3 and i == 4 else -y if g == 5 else 0.0 if g == 6 or (g == 7 and i != 2) else y
            rows.append((None if g == 0 else g, i, y))
    df = spark.createDataFrame(rows, "g int, day long, y double").repartition(5)
    p = panel(df, groups="g", date="day", m=7, target="y")
    some = [sp.croston_spec("y", name="h"), sp.croston_spec("y", kind="sba", name="a"), sp.croston_spec("y", kind="sbj", rm_missing=True, name="j")]
    some += [sp.croston_spec("y", kind="classic", missing="interpolate", name="c"), sp.croston_spec("y", kind="sba", cost_metric="no", name="n")]
    run = lambda q: sorted((tuple(r) for r in fits.forecast(some, q, 2, level=[80]).collect()), key=repr)
    one = p.with_df(p.df.where("g = 8").drop("x"))
    alone = fits.replace(one, groups=())
    got, single = run(p), run(alone)
    monkeypatch.setattr(fits, "_batched", lambda s: False)
    assert got == run(p) and {r[-2] for r in got} == {"ok", "error"}
    assert single == run(alone) and len(single) == 4 * 2 + 1


def test_croston_query_has_no_group_per_series(spark):
    plan = catalog.queries()["model_croston"](spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
