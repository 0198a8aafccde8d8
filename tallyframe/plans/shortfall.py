"""From household and person records to the shortfall of areas and the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.plans import headship, housing, people
from tallyframe.session import stage


def area_shortfall(households: DataFrame, persons: DataFrame, labels: DataFrame, state: int,
                   baseline_year: int, min_age: int = 18, max_age: int = 45,
                   vacancy_rate: float = 0.05) -> DataFrame:
    """Households, missing households, units and underproduction per year and area.

    Households are read for the unit counts and once more, with other columns, beside the persons.
    """
    units = housing.housing_units(households)
    members = people.with_headship(people.household_members(units, persons), min_age, max_age)
    cells = headship.metro_cells(members, labels, state, baseline_year)
    counts = housing.unit_counts(units, labels, state, se=False)
    return housing.metro_totals(cells, counts, vacancy_rate)


def shortfall_report(households: DataFrame, persons: DataFrame, labels: DataFrame, state: int,
                     baseline_year: int, min_age: int = 18, max_age: int = 45, vacancy_rate: float = 0.05,
                     label: str = "Statewide", mode: str = "recompute") -> DataFrame:
    """:func:`area_shortfall` by year and area, missing names last, followed by the state rows by year."""
    areas = area_shortfall(households, persons, labels, state, baseline_year, min_age, max_age, vacancy_rate)
    areas = stage(areas)  # read for the area rows and for the state rows
    report = housing.all_totals(areas, label=label, vacancy_rate=vacancy_rate, mode=mode)
    return report.orderBy(F.col("msa").eqNullSafe(F.lit(label)), F.asc_nulls_last("YEAR"), F.asc_nulls_last("msa"))
