"""Weighted median over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window, functions as F

from tallyframe.operators.joins import keyed_join
from tallyframe.operators.quantile_sketch import SIZE, brackets
from tallyframe.session import release_staged, stage

#: Distinct values of a group that the last step may sort.
LEFT = 50_000


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str,
                    out: str | None = None, left: int = LEFT, size: int = SIZE) -> DataFrame:
    """Per group, the mean of the first value whose cumulative weight reaches one half of the total
    and the first whose cumulative weight exceeds it. Missing values are left out; weights are not negative.

    ``df`` is read twice, whatever its values are. The first pass sketches every group and brackets its median with
    certainty (:mod:`quantile_sketch`); the second sums the weights below the brackets, of every distinct value inside
    and above. Inside lies about ``1 / size`` of a group, apart from ties. Should that be more than ``left`` distinct
    values, the sums, which are staged, are bracketed again, which takes no further look at ``df``. The last step sorts
    the few values inside, so no task holds a group of the input. Stage ``df`` if two readings are costly.
    """
    out = out or value
    if not by:
        whole = weighted_median(df.withColumn("__all", F.lit(1)), ["__all"], value, weight, out, left, size)
        return whole.drop("__all")
    rows = df.select(*by, F.col(value).cast("double").alias("__x"), F.col(weight).alias("__v")).filter(
        F.col("__x").isNotNull() & ~F.isnan("__x") & F.col("__v").isNotNull())
    sums, before = rows.withColumn("__side", F.lit(0)), None
    while True:
        # what earlier brackets left out stands at both ends, so that the middle stays that of the whole group
        ends = F.when(F.col("__side") < 0, F.lit(float("-inf"))).when(F.col("__side") > 0, F.lit(float("inf")))
        near = brackets(sums.select(*by, F.coalesce(ends, F.col("__x")).alias("__x"), F.col("__v").cast("double").alias("__w")), by, size)
        side = F.when(F.col("__side") != 0, F.col("__side")).when(F.col("__x") <= F.col("__after"), -1).when(
            F.col("__x") > F.col("__until"), 1).otherwise(0)
        sides = keyed_join(sums, near, by, "inner").withColumn("__side", side)
        inside = Observation()
        narrower = stage(sides.withColumn("__x", F.when(F.col("__side") == 0, F.col("__x"))).groupBy(*by, "__side", "__x").agg(
            F.sum("__v").alias("__v")).observe(inside, F.count_if(F.col("__side") == 0).alias("n")))
        if before is not None:
            release_staged(sums)
        sums, n = narrower, inside.get["n"]
        # few values even if one group has them all, or no more than half of them gone: ties
        if n <= left or (before is not None and n * 2 > before) or sums.filter("__side = 0").groupBy(*by).count().filter(
                F.col("count") > left).isEmpty():
            break
        before = n
    group = Window.partitionBy(*by)
    middle = sums.withColumn("__total", F.sum("__v").over(group)).withColumn(
        "__below", F.sum(F.when(F.col("__side") < 0, F.col("__v")).otherwise(F.col("__v") - F.col("__v"))).over(group)).filter("__side = 0")
    steps = Window.partitionBy(*by).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    cum = (F.col("__below") + F.sum("__v").over(steps)) * 2
    reach = F.min(F.when(F.col("__cum") >= F.col("__total"), F.col("__x")))
    exceed = F.min(F.when(F.col("__cum") > F.col("__total"), F.col("__x")))
    # a weight of zero in all, or rounding at the end of a group, leaves nothing that exceeds one half: the last value does
    last = F.max("__x")
    return (middle.withColumn("__cum", cum).groupBy(*by).agg(
        ((F.coalesce(reach, last) + F.coalesce(exceed, last)) / 2).alias(out)))
