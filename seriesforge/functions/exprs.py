"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published(value: Column, digits: int = 6) -> Column:
    """A double as results show it: rounded, and without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null or not finite."""
    quotient = a / F.nullif(b, F.lit(0.0))
    return F.when(F.abs(quotient) < F.lit(float("inf")), quotient)


def cell(coordinate: Column, size: float) -> Column:
    """Lower edge of the grid cell of a coordinate, as a double."""
    return F.floor(coordinate / F.lit(float(size))).cast("double") * F.lit(float(size))


def flag_is_set(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) > 0


def plogp(p: Column) -> Column:
    """-p log2 p, 0 for p = 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def agreement_class(ratio_: Column, good: float = 2.0, moderate: float = 5.0) -> Column:
    """good within a factor of ``good``, moderate within ``moderate``, else (and for null) poor."""
    return (
        F.when(ratio_.between(1 / good, good), "good").when(ratio_.between(1 / moderate, moderate), "moderate").otherwise("poor")
    )


def return_level(u: Column, sigma: Column, xi: Column, period: float, exceedances: Column, n: Column) -> Column:
    """Level exceeded once in ``period``; the logarithmic form where xi is about 0, u where the rate is 1 at most."""
    rate = F.lit(float(period)) * exceedances / n
    return F.when(rate <= 1, u).when(F.abs(xi) < 1e-8, u + sigma * F.ln(rate)).otherwise(u + sigma / F.nullif(xi, F.lit(0.0)) * (F.pow(rate, xi) - 1))
