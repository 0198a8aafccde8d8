"""Target headship as the mean of past rates, and its sensitivity to the last year averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import age_breaks, cut, cut_id, if_else, in_set, ratio, strict_mean
from tallyframe.operators.design import survey_counts
from tallyframe.operators.reshape import relocate, union_fill
from tallyframe.operators.totals import append_totals
from tallyframe.plans import codes as C
from tallyframe.plans.housing import person_design

BREAKS = age_breaks(65, lowest=None)
SUMMED = ["total_hh", "total_hh_se", "total_persons", "total_persons_se", "target_hh", "missing_hh"]


def banded_persons(persons: DataFrame, units: DataFrame) -> DataFrame:
    """Persons in occupied households with age bin, projection age band and head flag."""
    quarters = units.select("YEAR", "SERIAL", "GQ")
    joined = persons.join(quarters, ["YEAR", "SERIAL"], "left").filter(in_set(F.col("GQ"), C.GQ_OCCUPIED))
    return joined.withColumns({
        "age_bin": cut(F.col("AGE"), BREAKS, right=False),
        "head_of_household": if_else(F.col("PERNUM") == 1, F.lit(1), F.lit(0)),
        "age_group_id": cut_id(F.col("AGE"), C.PROJECTION_BANDS, include_lowest=True),
    })


def person_counts(people: DataFrame) -> DataFrame:
    """Heads and persons per year and age bin with standard errors; rows follow the heads."""
    counts = survey_counts(person_design(people), ["YEAR", "age_bin"], {
        "total_hh": F.col("PERNUM") == 1, "total_persons": F.lit(True)})
    return counts.filter(F.col("total_hh").isNotNull())


def headship_targets(counts: DataFrame, end_years: Sequence[int]) -> DataFrame:
    """Rates, target rates (mean up to each end year) and missing households, with a row per year in total.

    All end years are computed together: the counts are repeated per end year, which is a column.
    """
    swept = counts.withColumn("end_year", F.explode(F.array(*[F.lit(y) for y in end_years])))
    # one row per year in each group
    group = Window.partitionBy("end_year", "age_bin")
    rate = ratio(F.col("total_hh"), F.col("total_persons"))
    past = F.col("YEAR") <= F.col("end_year")
    used, known = F.count(F.when(past, F.lit(1))).over(group), F.count(F.when(past, F.col("hr"))).over(group)
    mean = F.when(used == 0, F.lit(float("nan"))).when(
        used == known, F.avg(F.when(past, F.col("hr"))).over(group))
    rated = (swept.withColumn("hr", rate).withColumn("target_hr", mean)
             .withColumn("target_hh", F.col("target_hr") * F.col("total_persons"))
             .withColumn("missing_hh", F.col("target_hh") - F.col("total_hh")))
    table = append_totals(rated, ["end_year", "YEAR"], "age_bin", "total", SUMMED, derived={
        "hr": rate, "target_hr": ratio(F.col("target_hh"), F.col("total_persons"))})
    return relocate(table, "end_year")


def total_rate_with_average(table: DataFrame, first: int, last: int) -> DataFrame:
    """The total rate per year and, as ``avg``, its mean repeated for every year of the range."""
    series = table.filter(F.col("age_bin") == "total")
    mean = series.agg(strict_mean(F.col("hr")).alias("hr")).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("YEAR"), F.lit("avg").alias("age_bin"), "hr")
    return union_fill(series, mean)

