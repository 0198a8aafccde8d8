"""Small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def flag(cond: Column) -> Column:
    """A three-valued condition as 1, 0 or missing, for arithmetic."""
    return cond.cast("int")


def percent_text(x: Column, digits: int = 2) -> Column:
    """``12.346`` as ``'12.35%'``; missing stays missing.

    The exact binary value is rounded, and ties go to the even digit, as C and R print numbers: ``2.675``, which
    is a little less, becomes ``'2.67%'``, and ``0.125``, a tie, ``'0.12%'``. The product with a power of ten is
    taken in two parts (its double and what that lost), so the comparison with one half is exact.
    """
    if not 1 <= digits <= 6:
        raise ValueError("1 to 6 digits")
    x = x.cast("double")
    a, scale = F.abs(x), 10.0 ** digits
    cut = a * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = cut - (cut - a)
    p = a * scale
    lost = (high * scale - p) + (a - high) * scale
    whole = F.floor(p)
    off = (p - whole - 0.5) + lost
    n = F.when((off > 0) | ((off == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)
    # beyond 2**52 a double has no binary places left to round
    shown = F.when(p < 4.5e15, F.concat(
        (n / scale).cast("long").cast("string"), F.lit("."),
        F.lpad((n % int(scale)).cast("string"), digits, "0"))).otherwise(F.format_string(f"%.{digits}f", a))
    text = F.when(F.isnan(x), "NaN").when(a == float("inf"), "Inf").otherwise(shown)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), text, F.lit("%")))


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(x, digits)
