"""Headship rates and missing households against baseline-year rates.

Persons are summed once to cells; baseline rates, expected households and totals are computed from the
cells. Expected households are the rate times the cell's population because the rate is constant in a
cell, so the microdata is neither read twice nor joined to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import flag, if_else, ratio, strict_sum, sum0
from tallyframe.functions.nulls import known, mean_numerator
from tallyframe.operators.design import survey_mean
from tallyframe.operators.reshape import wider
from tallyframe.plans.housing import attach_area, person_design

METRO_CELL = ("msa", "AGEGROUP", "MET2013", "age_dummy")


def headship_table(people: DataFrame, state: int, years: Sequence[int], min_age: int = 15) -> DataFrame:
    """Headship rate and standard error by age group, one column per year."""
    rates = survey_mean(person_design(people.filter((F.col("STATEFIP") == state) & (F.col("AGE") >= min_age))),
                        ["AGEGROUP", "YEAR"], "HEADSHIP")
    long = rates.select("AGEGROUP", "YEAR", F.explode(F.array(
        F.struct(F.lit("HEADSHIP").alias("TYPE"), F.col("HEADSHIP").alias("value")),
        F.struct(F.lit("HEADSHIP_se").alias("TYPE"), F.col("HEADSHIP_se").alias("value")))).alias("e"))
    return wider(long.select("AGEGROUP", "YEAR", "e.*"), ["AGEGROUP", "TYPE"], "YEAR", years, "value")


def cells(people: DataFrame, keys: Sequence[str], weight: str = "PERWT") -> DataFrame:
    """Persons, heads and the rate numerator summed to ``keys`` and year."""
    w, head = F.col(weight), flag(F.col("HEADSHIP"))
    return people.groupBy("YEAR", *keys).agg(
        strict_sum(w).alias("people"), strict_sum(head * w).alias("HH"),
        strict_sum(mean_numerator(head, w)).alias("heads"))


def missing_households(cell_table: DataFrame, rate_keys: Sequence[str], baseline_year: int,
                       clamp: Column | None = None) -> DataFrame:
    """``NEWHR, NEWHH_, HH, NEWHH, MISSINGHH`` per cell against the baseline-year rate of ``rate_keys``.

    The rate is a window aggregate over the cells, in which missing keys form a group like any other.
    A baseline of zero weight has no rate. Without ``clamp`` the expected households are the target. With it they are the target only where it
    holds and they exceed the actual ones, else the actual ones are.
    """
    group = Window.partitionBy(*rate_keys)
    base = F.col("YEAR") == baseline_year

    def base_sum(c: str) -> Column:
        whole = F.count(F.when(base, F.col(c))).over(group) == F.count(F.when(base, F.lit(1))).over(group)
        return F.when(whole, F.sum(F.when(base, F.col(c))).over(group))

    rated = cell_table.withColumn("NEWHR", known(ratio(base_sum("heads"), base_sum("people"))))
    expected = rated.withColumn("NEWHH_", F.col("NEWHR") * F.col("people"))
    target = F.col("NEWHH_") if clamp is None else if_else(
        clamp & (F.col("NEWHH_") > F.col("HH")), F.col("NEWHH_"), F.col("HH").cast("double"))
    return (expected.withColumn("NEWHH", target)
            .withColumn("MISSINGHH", F.col("NEWHH") - F.col("HH")).drop("people", "heads"))


def metro_cells(people: DataFrame, labels: DataFrame, state: int, baseline_year: int) -> DataFrame:
    """Clamped missing households by area, small area, age group and target-age flag, for all years."""
    here = people.filter(F.col("STATEFIP") == state)
    table = cells(here, ["MET2013", "PUMA", "AGEGROUP", "age_dummy"])
    return missing_households(attach_area(table, labels), METRO_CELL, baseline_year,
                              clamp=F.col("age_dummy"))


def state_cells(people: DataFrame, state: int, baseline_year: int, min_age: int = 15) -> DataFrame:
    """Unclamped missing households by age group, for all years."""
    here = people.filter((F.col("STATEFIP") == state) & (F.col("AGE") >= min_age))
    return missing_households(cells(here, ["AGEGROUP"]), ["AGEGROUP"], baseline_year)


def small_area_cells(people: DataFrame, state: int, baseline_year: int, min_age: int, max_age: int,
                     area: str = "PUMA") -> DataFrame:
    """Unclamped missing households of the target ages by age group and small area."""
    here = people.filter((F.col("STATEFIP") == state) & (F.col("AGE") >= min_age)
                         & (F.col("AGE") < max_age))
    return missing_households(cells(here, ["AGEGROUP", area]), ["AGEGROUP", area], baseline_year)


def positive_missing(cell_table: DataFrame, by: Sequence[str] = ("YEAR",)) -> DataFrame:
    """Sum of the positive missing households; zero where none is positive."""
    missing = F.col("MISSINGHH")
    return cell_table.groupBy(*by).agg(sum0(F.when(missing > 0, missing)).alias("MISSINGHH"))


def relabelled_baseline(people: DataFrame, baseline_year: int, label_year: int) -> DataFrame:
    """The table with a copy of the baseline year under another year.

    Each baseline row becomes two in place, so the table is computed once.
    """
    year = F.col("YEAR")
    label = F.lit(label_year).cast(people.schema["YEAR"].dataType)
    both = F.when(year == baseline_year, F.array(year, label)).otherwise(F.array(year))
    return people.withColumn("YEAR", F.explode(both))
