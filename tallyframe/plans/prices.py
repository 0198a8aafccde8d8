"""Price index to yearly deflator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import ratio, strict_mean


def deflator(prices: DataFrame, base_year: int, date: str = "observation_date",
             index: str = "CPIAUCSL") -> DataFrame:
    """``YEAR, cpi, adj_factor``: yearly mean index and the factor to base-year money.

    One row per calendar year, whatever the size of the input; the window runs over those rows.
    """
    yearly = prices.groupBy(F.year(date).alias("YEAR")).agg(strict_mean(F.col(index)).alias("cpi"))
    base = F.max(F.when(F.col("YEAR") == base_year, F.col("cpi"))).over(Window.partitionBy())
    return yearly.withColumn("adj_factor", ratio(base, F.col("cpi")))
