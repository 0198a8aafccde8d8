"""Headship from external household projections, and its comparison with the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import cut_id, if_else, ratio, strict_sum
from tallyframe.operators.design import SurveyDesign, survey_counts
from tallyframe.operators.joins import full_join, keyed_join
from tallyframe.plans import codes as C
from tallyframe.plans.housing import person_design

ALL_AGES = 0


def projected_households(table: DataFrame) -> DataFrame:
    """State rows over all household types; filter and column choice go to the source."""
    return table.filter((F.col("area_code") == 0) & (F.col("household_type_id") == 0)).select(
        "area_code", "year", "age_group_id", F.col("age_group_description").alias("age_group"),
        F.col("total_households").alias("hh"))


def projected_population(table: DataFrame) -> DataFrame:
    """Adult state population by year and age band, with an all-ages row (id 0)."""
    adults = table.select(F.col("countyfips").alias("area_code"), "year", "age", "totalpopulation").filter(
        (F.col("area_code") == 0) & (F.col("age") >= 18))
    band = cut_id(F.col("age"), C.PROJECTION_BANDS, include_lowest=True)
    bands = adults.groupBy("area_code", "year", band.alias("age_group_id")).agg(
        strict_sum(F.col("totalpopulation")).alias("pop"))
    # the few sums by band count in the all-ages row too
    both = bands.withColumn("age_group_id", F.explode(F.array("age_group_id", F.lit(ALL_AGES))))
    return both.groupBy("area_code", "year", "age_group_id").agg(strict_sum(F.col("pop")).alias("pop"))


def projected_headship(households: DataFrame, population: DataFrame) -> DataFrame:
    joined = keyed_join(projected_households(households), projected_population(population),
                        ["area_code", "year", "age_group_id"])
    return joined.withColumn("headship_rate", ratio(F.col("hh"), F.col("pop")))


def surveyed_headship(people: DataFrame) -> DataFrame:
    """Persons and heads per year and age band with standard errors, and an all-ages row (id 0).

    The all-ages standard error is not a sum, so the records are collapsed once and every cell enters
    both its band and the all-ages group.
    """
    head = F.coalesce(F.col("PERNUM") == 1, F.lit(False))
    cube = person_design(people).with_columns({"is_head": head}).collapse("YEAR", "age_group_id", "is_head")
    band = F.explode(F.array(F.col("age_group_id"), F.lit(ALL_AGES)))
    both = SurveyDesign(cube.df.withColumn("age_group_id", band), cube.weight, cube.replicates, cube.scale)
    counts = survey_counts(both, ["YEAR", "age_group_id"], {"pop": F.lit(True), "hh": F.col("is_head")})
    return (counts.filter(F.col("age_group_id").isNotNull())
            .withColumn("headship_rate", ratio(F.col("hh"), F.col("pop")))
            .withColumnRenamed("YEAR", "year"))


def comparison(survey: DataFrame, projected: DataFrame,
               suffix: tuple[str, str] = ("_survey", "_projected")) -> DataFrame:
    """Survey beside projection, every year and band of either, with the population check."""
    s, p = suffix
    both = full_join(survey, projected, ["year", "age_group_id"], suffix)
    diff = F.col(f"pop{s}") - F.col(f"pop{p}")
    return both.withColumn("pop_diff", diff).withColumn(
        "check_pop", if_else(F.abs("pop_diff") <= F.col("pop_se"), F.lit(True), F.lit(False))).select(
        "year", "age_group_id", "age_group", f"pop{s}", "pop_se", f"pop{p}", "pop_diff", "check_pop",
        f"hh{s}", "hh_se", f"headship_rate{s}", f"headship_rate{p}")
