"""Shortfall from long-run vacancy rates by tenure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import in_set, not_in_set, ratio
from tallyframe.operators.design import SurveyDesign, survey_count
from tallyframe.operators.totals import append_totals
from tallyframe.plans import codes as C
from tallyframe.plans.housing import household_design


def market_units(households: DataFrame) -> DataFrame:
    """Households and vacant units on the market; units taken but not yet occupied count as occupied."""
    kept = households.filter(in_set(F.col("GQ"), C.GQ_HOUSEHOLDS)
                             & not_in_set(F.col("VACANCY"), C.VACANCY_NOT_ON_MARKET))
    return kept.withColumn("VACANCY", recode(F.col("VACANCY"), {C.VACANCY_TAKEN: C.VACANCY_OCCUPIED}))


def recode(c: Column, values: dict) -> Column:
    """Replace single codes; others and missing stay."""
    out = None
    for old, new in values.items():
        hit = c == old
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return out.otherwise(c)


def tenure_of_vacant(c: Column) -> Column:
    return F.when(c == C.VACANCY_RENT, F.lit("rent")).when(c == C.VACANCY_SALE, F.lit("own"))


def tenure_of_occupied(c: Column) -> Column:
    return F.when(c == C.OWNED, F.lit("own")).when(c == C.RENTED, F.lit("rent"))


def tenure_counts(units: DataFrame) -> DataFrame:
    """``YEAR, tenure, vac, vac_moe, occ, occ_moe``: rows follow the vacant units.

    Vacant units are classed by vacancy code and occupied ones by ownership code. Both counts come from
    one collapse of the records, in which each cell enters the counts it belongs to.
    """
    cube = household_design(units).collapse("YEAR", "VACANCY", "OWNERSHP")
    roles = F.array(
        F.struct(F.lit("vac").alias("role"), tenure_of_vacant(F.col("VACANCY")).alias("tenure")),
        F.struct(F.lit("occ").alias("role"), tenure_of_occupied(F.col("OWNERSHP")).alias("tenure")))
    cast = cube.df.withColumn("r", F.explode(roles)).select("*", "r.role", "r.tenure").filter(
        F.col("tenure").isNotNull())
    counts = survey_count(SurveyDesign(cast, cube.weight, cube.replicates, cube.scale),
                          ["YEAR", "tenure", "role"], "n")
    n, moe = F.col("n"), F.col("n_se") * C.MOE_FACTOR
    cells = []
    for role in ("vac", "occ"):
        here = F.col("role") == role
        cells += [F.max(F.when(here, n)).alias(role), F.max(F.when(here, moe)).alias(f"{role}_moe")]
    return counts.groupBy("YEAR", "tenure").agg(*cells).filter(F.col("vac").isNotNull())


def vacancy_shortfall(counts: DataFrame) -> DataFrame:
    """Vacancy rate by tenure and in total, its long-run mean, and the units that close the gap.

    Margins of error add up in the total row, as in the published method.
    """
    table = append_totals(counts, ["YEAR"], "tenure", "total", ["vac", "vac_moe", "occ", "occ_moe"])
    rated = table.withColumn("total", F.col("vac") + F.col("occ")).withColumn(
        "vac_rate", ratio(F.col("vac"), F.col("total")))
    # one row per year in each group
    mean = strict_mean_over(F.col("vac_rate"), Window.partitionBy("tenure"))
    return (rated.withColumn("avg_vac_rate", mean)
            .withColumn("diff_from_avg", F.col("avg_vac_rate") - F.col("vac_rate"))
            .withColumn("shortfall", F.col("diff_from_avg") * F.col("total")))


def strict_mean_over(c: Column, window) -> Column:
    """Mean over the window, missing as soon as one value is."""
    return F.when(F.count(c).over(window) == F.count(F.lit(1)).over(window), F.avg(c).over(window))


def shortfall_of_year(table: DataFrame, year: int) -> DataFrame:
    """One year's rows with the tenure in title case."""
    return table.filter(F.col("YEAR") == year).drop("YEAR").withColumn("tenure", F.initcap("tenure"))

