"""Missing-value rules of statistical data frames, as column expressions.

Spark's own rules differ in the places named here; everything else behaves the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def in_set(c: Column, values: Iterable) -> Column:
    """Membership that is never missing: a missing value is simply not in the set."""
    return F.coalesce(c.isin(*values), F.lit(False))


def not_in_set(c: Column, values: Iterable) -> Column:
    """Negated membership that keeps rows with a missing value."""
    return ~in_set(c, values)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is missing where its condition is missing."""
    return F.when(cond, yes).when(~cond, no)


def floor_at_one(c: Column) -> Column:
    """Values under one become one; missing stays missing (``greatest`` would turn it into one)."""
    return if_else(c < 1, F.lit(1), c)


def strict_sum(c: Column, where: Column | None = None) -> Column:
    """Sum that is missing as soon as one input is missing; zero on no rows.

    With ``where`` only the rows in which it holds count. Strict sums of strict sums equal the strict sum
    of the rows, so it may be taken in steps.
    """
    rows = F.lit(1)
    if where is not None:
        c, rows = F.when(where, c), F.when(where, rows)
    return F.when(F.count(c) == F.count(rows), F.coalesce(F.sum(c), F.lit(0)))


def sum0(c: Column) -> Column:
    """Sum over the present values; zero when there are none."""
    return F.coalesce(F.sum(c), F.lit(0))


def strict_mean(c: Column) -> Column:
    """Mean that is missing as soon as one input is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def known(c: Column) -> Column:
    """A number, or missing if it is NaN: the result of 0/0 is a missing value in comparisons and sums."""
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column) -> Column:
    """Floating-point division: x/0 is an infinity, 0/0 is NaN, missing stays missing."""
    num, den = num.cast("double"), den.cast("double")
    by_zero = (F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
               .when(num.isNotNull(), F.lit(float("nan"))))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def mean_numerator(x: Column, w: Column) -> Column:
    """Per-row numerator of :func:`weighted_mean`: a missing value counts unless its weight is 0."""
    return F.when(w != 0, x * w).when(w == 0, F.lit(0))


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean; missing if a value with non-zero weight is missing, NaN if all weights are 0."""
    return ratio(strict_sum(mean_numerator(x, w)), strict_sum(w))
