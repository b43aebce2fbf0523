"""Model specifications: what to fit, as plain data that travels to the executors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from panelwright.operators.frame import ArgumentError
from panelwright.plans.formula import ARIMA_TERMS, ETS_TERMS, ModelFormula, formula, order_range


@dataclass(frozen=True)
class Spec:
    """``kernel`` names an entry of ``panelwright.kernels.registry``."""

    kernel: str
    target: str
    name: str
    options: dict = field(default_factory=dict)
    regressors: tuple[str, ...] = ()
    auto_regressors: bool = False
    m: int | list | None = None
    #: A formula whose design is settled on the training data and gives further regressors.
    design: str | None = None

    def named(self, name: str) -> Spec:
        return replace(self, name=name)


def _formula(f) -> ModelFormula:
    return formula(f) if isinstance(f, str) else f


def _target(f: str | ModelFormula, kind: str) -> tuple[str, dict]:
    """Target and options of a formula with one term; a bare name is a target too."""
    if isinstance(f, str) and "=" not in f:
        return f.strip(), {}
    m = _formula(f)
    terms = [t for t in m.terms if t.kind != "var"]
    if len(terms) != 1 or len(m.terms) != 1 or terms[0].kind.removesuffix("_term") not in (kind, {"holt_winters": "hw"}.get(kind, kind)):
        raise ArgumentError(f"the formula needs the single term {kind}()")
    return m.target, dict(terms[0].kwargs)


def arima_spec(f, *, m=None, name: str = "arima", xreg_formula: str | None = None, **options) -> Spec:
    """Orders by terms p, d, q, P, D, Q; a fixed order for all of p, q (P, Q) skips the search.  Other names are regressors, and so are
    the columns of the design ``xreg_formula``, such as ``~ a * b``, but for its intercept."""
    mf = _formula(f)
    bad = [t.kind for t in mf.terms if t.kind not in ARIMA_TERMS | {"var"}]
    if bad:
        raise ArgumentError(f"terms {bad} don't belong to an ARIMA formula")
    orders = {k: order_range(mf, k) for k in ("p", "q", "P", "Q", "d", "D")}
    given = [k for k in ("p", "q", "P", "Q") if orders[k] is not None]
    fixed = bool(given) and all(orders[k][0] == orders[k][1] for k in given)
    opts = dict(options)
    for k in ("d", "D"):
        if orders[k] is not None:
            opts[k] = orders[k][0]  # a range gives its minimum
    if fixed:
        # an omitted term takes the least order of the search
        least = {"p": 2, "q": 2, "P": 1, "Q": 1}
        get = lambda k: orders[k][0] if orders[k] else least[k]
        opts["fixed"] = (get("p"), get("q"), get("P"), get("Q"))
    else:
        lows, highs = [0, 0, 0, 0], [5, 5, 2, 2]
        start = [2, 2, 1, 1]
        for i, k in enumerate(("p", "q", "P", "Q")):
            if orders[k] is not None:
                highs[i] = orders[k][1]
                start[i] = orders[k][0]
                if orders[k][0] == orders[k][1]:
                    lows[i] = orders[k][0]
        opts |= {"max_p": highs[0], "max_q": highs[1], "max_P": highs[2], "max_Q": highs[3], "start": tuple(start), "min_orders": tuple(lows)}
    return Spec("arima", mf.target, name, opts, tuple(mf.regressors), mf.of("auto") is not None, m, xreg_formula)


def ets_spec(f, *, m=None, name: str = "ets", **options) -> Spec:
    """Components by e("A"), t("N"), s("M"), damping by drift(True); omitted ones are searched."""
    if isinstance(f, str) and "=" not in f:
        return Spec("ets", f.strip(), name, options, m=m)
    mf = _formula(f)
    bad = [t.kind for t in mf.terms if t.kind not in ETS_TERMS]
    if bad:
        raise ArgumentError(f"terms {bad} don't belong to an ETS formula")
    code = "".join((mf.of(k).args or ("Z",))[0] if mf.of(k) else "Z" for k in "ets")
    opts = dict(options) | {"model": code}
    if mf.of("drift"):
        opts["damped"] = {True: True, False: False}.get((mf.of("drift").args or (True,))[0])
    return Spec("ets", mf.target, name, opts, m=m)


def _simple(kernel: str, term: str | None = None):
    def make(f, *, m=None, name: str | None = None, **options) -> Spec:
        target, opts = _target(f, term or kernel)
        return Spec(kernel, target, name or kernel, {**opts, **options}, m=m)

    make.__name__ = f"{kernel}_spec"
    make.__doc__ = f"{kernel}: 'y' or 'y = {term or kernel}(...)', options of the kernel as keywords."
    return make


ses_spec = _simple("ses")
holt_spec = _simple("holt")
holt_winters_spec = _simple("holt_winters")
croston_spec = _simple("croston")
arar_spec = _simple("arar")
ararma_spec = _simple("ararma")
theta_spec = _simple("theta")
diffusion_spec = _simple("diffusion")
bats_spec = _simple("bats")
tbats_spec = _simple("tbats")
kw_spec = _simple("kw_filter")
naive_spec = _simple("naive")
snaive_spec = _simple("snaive")
rw_spec = _simple("rw")
meanf_spec = _simple("meanf")

#: Models without an optimiser run as DataFrame expressions.
NATIVE = ("naive", "snaive", "rw", "meanf")
#: So do these, as searches over grids of weights, with these options.
SMOOTHED = {"ses": {"alpha"}, "holt": {"damped", "alpha", "beta", "phi"}}


def smoothed(s: Spec) -> bool:
    """Whether the spec is one of exponential smoothing that needs no array function."""
    given = {k for k, v in s.options.items() if (k, v) not in (("initial", "optimal"), ("lam", None), ("biasadj", False), ("exponential", False))}
    whole = s.options.get("beta") is None or s.options.get("alpha") is not None
    return s.kernel in SMOOTHED and given <= SMOOTHED[s.kernel] and whole and not s.regressors and not s.auto_regressors


def model(*specs: Spec, names: list[str] | None = None) -> list[Spec]:
    """A collection of specs with distinct names."""
    if not specs:
        raise ArgumentError("no specs")
    out = [s.named(n) for s, n in zip(specs, names, strict=True)] if names else list(specs)
    seen: dict[str, int] = {}
    for i, s in enumerate(out):
        seen[s.name] = seen.get(s.name, 0) + 1
        if seen[s.name] > 1:
            if names:
                raise ArgumentError(f"two models are named {s.name!r}")
            out[i] = s.named(f"{s.name}_{seen[s.name]}")
    return out
