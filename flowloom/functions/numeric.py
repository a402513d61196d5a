"""Number rules shared by all operators: NaN never compares as large, and nothing divides by zero."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    x = as_column(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    return F.when(finite(c), as_column(c).cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den; NaN where den is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(NAN))


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def log_or_limit(c: Column) -> Column:
    """Natural logarithm: minus infinity for 0, NaN below and for NaN."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def scaled(c: Column, scale: str) -> Column:
    """An axis value on a "linear" or "log" scale."""
    if scale == "linear":
        return c
    if scale == "log":
        return log_or_limit(c)
    raise ValueError(f"scale must be 'linear' or 'log', not {scale!r}")


def sum_of(columns: Iterable[Column]) -> Column:
    return functools.reduce(operator.add, columns)
