"""Subtotal rows, shares and year spines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.nulls import ratio, strict_sum
from tallyframe.operators.reshape import across, union_fill


def append_totals(df: DataFrame, by: Sequence[str], label: str, text: str, sums: Sequence[str],
                  f: Callable[[Column], Column] = strict_sum,
                  derived: dict[str, Column] | None = None) -> DataFrame:
    """Add one row per ``by`` group that holds ``text`` in ``label`` and the sums of ``sums``.

    ``derived`` columns are computed from the sums. Columns in neither are missing in the new rows.
    """
    total = df.groupBy(*by).agg(*across(sums, f)).withColumn(label, F.lit(text))
    if derived:
        total = total.withColumns(derived)
    return union_fill(df, total)


def group_share(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Each row's percentage of its group's sum.

    Meant for aggregated tables (a window holds the rows of one group in one task).
    """
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, ratio(F.col(value), total) * 100)


def with_missing_years(df: DataFrame, year: str, first: int, last: int, fill: dict) -> DataFrame:
    """Add a row for every year of the range that ``df`` lacks; ``fill`` gives its other columns."""
    spine = df.sparkSession.range(first, last + 1).select(
        F.col("id").cast(df.schema[year].dataType).alias(year))
    joined = spine.join(df.withColumn("__had", F.lit(True)), year, "full")
    filled = {c: F.when(F.col("__had"), F.col(c)).otherwise(F.lit(v)) for c, v in fill.items()}
    return joined.withColumns(filled).select(*df.columns)
