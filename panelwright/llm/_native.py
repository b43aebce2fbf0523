"""Column helpers shared by the operators that run as DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda variable is bound eagerly.  A plain column that a lambda captures could be inlined by the
    optimizer into the lambda body and would then be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers(first: Column, last: Column) -> Column:
    """``[first .. last]``, empty when ``last < first`` (``sequence`` alone would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.  Pure ASCII text takes the byte-wise path of ``lower``."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))
