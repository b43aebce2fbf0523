"""The two formula languages: model formulas (``sales = p(1, 2) + q() + price``) and design formulas (``~ a*b + c:d``)."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.frame import ArgumentError, quote


@dataclass(frozen=True)
class Term:
    """A call such as ``p(1, 2)``; a bare name is a regressor (``kind`` 'var')."""

    kind: str
    args: tuple = ()
    kwargs: tuple = ()

    def option(self, name: str, default=None):
        return dict(self.kwargs).get(name, default)


@dataclass(frozen=True)
class ModelFormula:
    target: str
    terms: tuple[Term, ...] = field(default_factory=tuple)

    def of(self, kind: str) -> Term | None:
        found = [t for t in self.terms if t.kind == kind]
        if len(found) > 1:
            raise ArgumentError(f"{kind}() stands twice")
        return found[0] if found else None

    @property
    def regressors(self) -> list[str]:
        return [t.args[0] for t in self.terms if t.kind == "var"]


#: Default search ranges of the order terms.
ORDER_DEFAULTS = {"p": (2, 5), "q": (2, 5), "P": (1, 2), "Q": (1, 2)}
ARIMA_TERMS = {"p", "q", "P", "Q", "d", "D", "auto"}
ETS_TERMS = {"e", "t", "s", "drift"}
SINGLE_TERMS = {
    "ses", "holt", "hw", "holt_winters", "croston", "arar", "ararma", "bats", "tbats", "theta", "diffusion", "kw_filter",
    "naive_term", "snaive_term", "rw_term", "meanf_term", "naive", "snaive", "rw", "meanf",
}


def _value(node: ast.expr):
    try:
        return ast.literal_eval(node)
    except ValueError:
        if isinstance(node, ast.Name):
            return node.id
        raise ArgumentError("arguments are literals") from None


def _term(node: ast.expr) -> Term:
    if isinstance(node, ast.Name):
        return Term("auto") if node.id == "_dot_" else Term("var", (node.id,))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        kind = node.func.id
        if kind not in ARIMA_TERMS | ETS_TERMS | SINGLE_TERMS:
            raise ArgumentError(f"unknown term {kind}()")
        return Term(kind, tuple(_value(a) for a in node.args), tuple((k.arg, _value(k.value)) for k in node.keywords))
    raise ArgumentError("a term is a name or a call")


def formula(text: str) -> ModelFormula:
    """Parse a model formula; ``.`` stands for every usable regressor.  The text is parsed, never evaluated."""
    left, eq, right = text.partition("=")
    target = left.strip()
    if not eq or not target.isidentifier():
        raise ArgumentError("a formula is 'target = term + term'")
    right = re.sub(r"(^|\+)\s*\.\s*(?=\+|$)", r"\1 _dot_ ", right)
    try:
        node = ast.parse(right.strip(), mode="eval").body
    except SyntaxError as e:
        raise ArgumentError(f"can't read {right.strip()!r}") from e
    terms = []
    while isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        terms.append(_term(node.right))
        node = node.left
    terms.append(_term(node))
    return ModelFormula(target, tuple(reversed(terms)))


def order_range(f: ModelFormula, kind: str) -> tuple[int, int] | None:
    """(min, max) of an order term; None if the formula lacks it."""
    t = f.of(kind)
    if t is None:
        return None
    if kind in ("d", "D"):
        if not t.args or t.args[0] is None:
            return None
        lo = int(t.args[0])
        return (lo, int(t.args[1]) if len(t.args) > 1 else lo)
    if not t.args:
        return ORDER_DEFAULTS[kind]
    lo, hi = int(t.args[0]), int(t.args[-1])
    if len(t.args) > 2 or lo < 0 or hi < lo:
        raise ArgumentError(f"{kind}() takes one order or a range")
    return lo, hi


# --- design formulas -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """Products of columns, and whether there is an intercept."""

    target: str | None
    products: tuple[tuple[str, ...], ...]
    intercept: bool

    @property
    def names(self) -> list[str]:
        return [":".join(p) for p in self.products]


def design(text: str) -> Design:
    """``y ~ a*b + c:d - 1``: ``*`` gives all products of its factors, ``:`` one product, ``- 1`` or ``0`` no intercept."""
    left, tilde, right = text.partition("~")
    target = left.strip() or None if tilde else None
    right = right if tilde else text
    intercept, products = True, []
    for sign, term in re.findall(r"([+-]?)\s*([^+\-]+)", right):
        term = term.strip()
        if not term:
            continue
        if term in ("0", "1"):
            intercept = term == "1" and sign != "-" or (term == "0" and sign == "-")
            continue
        if sign == "-":
            raise ArgumentError("only the intercept can be taken out")
        factors = [[x.strip() for x in part.split(":")] for part in term.split("*")]
        names = [n for part in factors for n in part]
        if not all(re.fullmatch(r"[^\W\d]\w*", n) for n in names):
            raise ArgumentError(f"can't read {term!r}")
        for k in range(1, len(factors) + 1):
            for combo in combinations(factors, k):
                p = tuple(n for part in combo for n in part)
                if not any(sorted(p) == sorted(q) for q in products):
                    products.append(p)
    products.sort(key=len)
    return Design(target, tuple(products), intercept)


def model_columns(df: DataFrame, d: Design) -> dict[str, Column]:
    """Columns of the design; raises for unknown or non-numeric ones."""
    for p in d.products:
        for n in p:
            if n not in df.columns:
                raise ArgumentError(f"unknown column {n!r}")
            if not isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType)):
                raise ArgumentError(f"column {n!r} isn't numeric")
    out = {"(Intercept)": F.lit(1.0)} if d.intercept else {}
    for p in d.products:
        c = F.col(quote(p[0])).cast("double")
        for n in p[1:]:
            c = c * F.col(quote(n)).cast("double")
        out[":".join(p)] = c
    return out


def model_matrix(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the design's columns."""
    return df.select(*[F.col(quote(k)) for k in keep], *[c.alias(n) for n, c in model_columns(df, design(text)).items()])


def auto_regressors(df: DataFrame, exclude) -> list[str]:
    """Every numeric column without a missing value, but for the excluded ones; one aggregation tells."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude and f.name != "_ord"]
    if not names:
        return []
    seen = df.agg(*[F.count(F.when(F.col(quote(n)).isNull(), 1)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if seen[f"c{i}"] == 0]
