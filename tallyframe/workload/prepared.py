"""Prepared tables of the test data, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyframe.plans import housing, people, prices, target_rates, vacancy
from tallyframe.workload import views
from tallyframe.workload.views import MAX_AGE, MIN_AGE, PRICE_YEAR


def units(spark, sf_dir, mode: str = "duration_or_listed") -> DataFrame:
    """Units with flags, by area code."""
    return housing.housing_units(views.households(spark, sf_dir), mode)


def named_units(spark, sf_dir) -> DataFrame:
    """Units with flags and area name."""
    return housing.attach_area(units(spark, sf_dir), views.area_labels(spark, sf_dir))


def members(spark, sf_dir, min_age: int = MIN_AGE, max_age: int = MAX_AGE) -> DataFrame:
    """Persons in households with headship and age group, without money columns."""
    joined = people.household_members(units(spark, sf_dir), views.persons(spark, sf_dir))
    return people.with_headship(joined, min_age, max_age)


def analysis_people(spark, sf_dir) -> DataFrame:
    """The full person table."""
    return people.analysis_people(units(spark, sf_dir), views.persons(spark, sf_dir),
                                  prices.deflator(views.cpi(spark, sf_dir), PRICE_YEAR), MIN_AGE, MAX_AGE)


def banded(spark, sf_dir) -> DataFrame:
    """Persons in occupied households with age bands."""
    return target_rates.banded_persons(views.persons(spark, sf_dir),
                                       vacancy.market_units(views.households(spark, sf_dir)))
