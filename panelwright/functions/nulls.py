"""Missing-value algebra shared by all panel operators: null is missing, and ANSI mode stays on."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(n: Column, d: Column) -> Column:
    """n / d; null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def div0(n: Column, d: Column) -> Column:
    """n / d with x/0 counted as 0; 0/0 stays missing."""
    return F.when((d == 0) & (n != 0), F.lit(0.0)).otherwise(ratio(n, d))


def positive(x: Column) -> Column:
    """x where it is above 0, else null."""
    return F.when(x > 0, x)


def half_even(x: Column, digits: int) -> Column:
    """Rounding to even on the scaled value, as numeric libraries round arrays."""
    k = 10.0**digits
    return F.rint(x * k) / k
