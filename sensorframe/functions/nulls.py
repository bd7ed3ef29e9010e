"""Column expressions for missing values: null, NaN and infinity are kept apart on purpose."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative error that a sum may carry: a decimal tie goes up whatever the last bits of the sum are.
_SUM_ERROR = 1e-11
# From here on a double has no fraction.
_WHOLE = float(2**52)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for ordinary numbers; false (never null) for null, NaN and both infinities."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c))


def finite_or_zero(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c)).otherwise(F.lit(0.0))


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued choice: an unknown condition gives null, unlike ``when`` / ``otherwise``."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is false for null, so its negation keeps null rows."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def strict_mean(c: Column | str) -> Column:
    """Mean that is null as soon as one value of the group is missing."""
    x = col(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean; null when the weights add up to zero."""
    v, w = col(value), col(weight)
    return F.try_divide(F.sum(v * w), F.sum(w))


def finite_share(c: Column | str, digits: int = 1) -> Column:
    """Percentage of finite values among all rows of the group, missing ones included."""
    return round_to(F.avg(is_finite(c).cast("int")) * 100, digits)


def round_to(c: Column | str, digits: int = 0) -> Column:
    """Round half up as a double. Ties are decided the same way for sums taken in any order.

    NaN, infinities and numbers too large to have a digit to round come back as they are.
    """
    x = col(c).cast("double")
    scaled = x * float(10**digits)
    rounded = F.floor(scaled + 0.5 + F.abs(scaled) * _SUM_ERROR).cast("double") / float(10**digits)
    return F.when(F.abs(scaled) < _WHOLE, rounded).otherwise(x)


def clamp_negative(c: Column | str) -> Column:
    """Negative values become zero; null stays null (``greatest`` would turn it into zero)."""
    x = col(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)
