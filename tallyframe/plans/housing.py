"""Housing units: flags, unit counts by area, shares and yearly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions import (
    flag, if_else, in_set, not_in_set, percent_text, ratio, strict_sum,
)
from tallyframe.functions.nulls import known
from tallyframe.operators.design import SurveyDesign, survey_counts
from tallyframe.operators.joins import keyed_join
from tallyframe.operators.totals import group_share
from tallyframe.plans import codes as C


def attach_area(df: DataFrame, labels: DataFrame, code: str = "MET2013", name: str = "msa") -> DataFrame:
    """Area name by code; ``labels`` holds ``val, lbl``. Unknown and missing codes stay unnamed."""
    return keyed_join(df, labels.select(F.col("val").alias(code), F.col("lbl").alias(name)), [code])


def uninhabitable(mode: str = "duration_or_listed") -> Column:
    """Units lacking kitchen or plumbing that stand empty, in one of three definitions.

    ``duration_or_listed``: empty for long, or on the market where the duration is unknown;
    ``duration``: empty for long, unknown duration stays unknown; ``vacant``: any empty unit.
    """
    lacking = (F.col("KITCHEN") == C.KITCHEN_NONE) | (F.col("PLUMBING") == C.PLUMBING_NONE)
    if mode == "duration_or_listed":
        return lacking & if_else(F.col("VACDUR").isNull(), in_set(F.col("VACANCY"), C.VACANCY_AVAILABLE),
                                 F.col("VACDUR") >= C.LONG_VACANT)
    if mode == "duration":
        return lacking & (F.col("VACDUR") >= C.LONG_VACANT)
    if mode == "vacant":
        return lacking & (F.col("VACANCY") != C.VACANCY_OCCUPIED)
    raise ValueError(f"unknown mode {mode!r}")


def housing_units(households: DataFrame, mode: str = "duration_or_listed") -> DataFrame:
    """Units outside institutions, with their condition flags (three-valued)."""
    return households.drop("RECTYPE").filter(not_in_set(F.col("GQ"), C.GQ_INSTITUTIONS)).withColumns({
        "SEASONAL": F.col("VACANCY") == C.VACANCY_SEASONAL,
        "UNINHABITABLE": uninhabitable(mode),
        "VACAVAIL": in_set(F.col("VACANCY"), C.VACANCY_AVAILABLE),
        "VACANT": F.col("VACANCY") != C.VACANCY_OCCUPIED,
    })


def household_design(units: DataFrame) -> SurveyDesign:
    return SurveyDesign.from_pattern(units, "HHWT", "REPWT[0-9]+")


def person_design(persons: DataFrame) -> SurveyDesign:
    return SurveyDesign.from_pattern(persons, "PERWT", "REPWTP[0-9]+")


def unit_counts(units: DataFrame, labels: DataFrame, state: int, se: bool = True) -> DataFrame:
    """The five unit counts per year and area, in one pass, with standard errors if ``se``.

    Units are summed by area code; names are attached to the sums.
    """
    domains = {
        "housing_units": F.lit(True),
        "housing_units_seasonal": F.col("SEASONAL"),
        "housing_units_uninhabitable": F.col("UNINHABITABLE"),
        "housing_units_vacant": F.col("VACAVAIL"),
        "households": (F.col("STATEFIP") == state) & (F.col("VACANCY") == C.VACANCY_OCCUPIED),
    }
    design = household_design(units) if se else SurveyDesign(units, "HHWT", (), 0.0)
    flags = {f"is_{n}": F.coalesce(c, F.lit(False)) for n, c in domains.items()}
    cube = design.with_columns(flags).collapse("YEAR", "MET2013", *flags)
    named = SurveyDesign(attach_area(cube.df, labels), cube.weight, cube.replicates, cube.scale)
    return survey_counts(named, ["YEAR", "msa"], {n: F.col(f"is_{n}") for n in domains}, se=se)


def metro_totals(cells: DataFrame, counts: DataFrame, vacancy_rate: float) -> DataFrame:
    """Shortfall per year and area from household cells and unit counts."""
    totals = cells.groupBy("YEAR", "msa").agg(
        strict_sum(F.col("HH")).alias("HH"), strict_sum(F.col("NEWHH")).alias("NEWHH"),
        strict_sum(F.col("MISSINGHH")).alias("MISSINGHH"))
    units = counts.select("YEAR", "msa", "housing_units_seasonal", "housing_units_uninhabitable",
                          "housing_units_vacant", "housing_units")
    return shortfall_columns(keyed_join(totals, units, ["YEAR", "msa"]), vacancy_rate)


def shortfall_columns(totals: DataFrame, vacancy_rate: float) -> DataFrame:
    """Vacancy rate, units needed at the target vacancy, units available, and their difference."""
    return totals.withColumns({
        "vacancy_rate": ratio(F.col("housing_units_vacant"), F.col("housing_units")),
        "necessary_units": (F.col("HH") + F.col("MISSINGHH")) / F.lit(1 - vacancy_rate),
        "available_units": F.col("housing_units") - F.col("housing_units_seasonal")
        - F.coalesce(F.col("housing_units_uninhabitable"), F.lit(0)),
    }).withColumn("underproduction", F.col("necessary_units") - F.col("available_units"))


def state_totals(metro: DataFrame, label: str = "Statewide", vacancy_rate: float = 0.05,
                 mode: str = "recompute") -> DataFrame:
    """One row per year over all areas.

    ``reference`` sums every column and skips missing values (NaN among them), as the published totals do: the vacancy
    rate there is a sum of rates, and years without a baseline show 0. ``recompute`` sums the counts
    (missing stays missing) and derives the rates and shortfall again from the sums.
    """
    if mode == "reference":
        floating = {f.name for f in metro.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        sums = [F.coalesce(F.sum(known(F.col(c)) if c in floating else F.col(c)), F.lit(0)).alias(c)
                for c in metro.columns if c not in ("YEAR", "msa")]
        total = metro.groupBy("YEAR").agg(*sums)
    elif mode == "recompute":
        strict = ("HH", "NEWHH", "MISSINGHH")
        skip = ("housing_units_seasonal", "housing_units_uninhabitable", "housing_units_vacant",
                "housing_units")
        total = shortfall_columns(metro.groupBy("YEAR").agg(
            *[strict_sum(F.col(c)).alias(c) for c in strict],
            *[F.sum(c).alias(c) for c in skip]), vacancy_rate)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return total.withColumn("msa", F.lit(label)).select(*metro.columns)


def all_totals(metro: DataFrame, **state) -> DataFrame:
    """Area rows followed by state rows."""
    return metro.unionByName(state_totals(metro, **state))


def underproduction(households: Column, missing: Column, units: Column, seasonal: Column,
                    unfit: Column, vacancy_rate: float, mode: str = "target_vacancy") -> Column:
    """Units short, in one of three published forms.

    ``target_vacancy`` divides the households wanted by the occupied share; ``uplift`` adds a flat
    percentage; ``stock`` starts from the stock of units and subtracts the terms one after another.
    """
    if mode == "target_vacancy":
        return (households + missing) / F.lit(1 - vacancy_rate) - (units - seasonal - unfit)
    if mode == "uplift":
        return (households + missing) * F.lit(C.VACANCY_UPLIFT) - (units - unfit - seasonal)
    if mode == "stock":
        return (missing + units) / F.lit(1 - vacancy_rate) - units - seasonal
    raise ValueError(f"unknown mode {mode!r}")


def yearly_units(units: DataFrame, state: int) -> DataFrame:
    """Unit statistics per year of one state, as conditional sums in one pass."""
    w = F.col("HHWT")
    return units.filter(F.col("STATEFIP") == state).groupBy("YEAR").agg(
        strict_sum(w * flag(F.col("SEASONAL"))).alias("SEASONAL"),
        strict_sum(w * flag(F.col("UNINHABITABLE"))).alias("UNINHABITABLE"),
        strict_sum(w * flag(F.col("VACANCY") == C.VACANCY_OCCUPIED)).alias("HOUSEHOLDS"),
        strict_sum(w).alias("HU"))


def yearly_shortfall(missing: DataFrame, stats: DataFrame) -> DataFrame:
    """Rounded missing households per year beside unit statistics, uplift shortfall and unit change.

    Both inputs hold one row per year, so the ordered window runs over a few dozen rows.
    """
    per_year = missing.groupBy("YEAR").agg(F.bround(strict_sum(F.col("MISSINGHH")), 0).alias("MISSINGHH"))
    joined = keyed_join(per_year, stats, ["YEAR"])
    short = underproduction(F.col("HOUSEHOLDS"), F.col("MISSINGHH"), F.col("HU"), F.col("SEASONAL"),
                            F.col("UNINHABITABLE"), 0.0, mode="uplift")
    by_year = Window.partitionBy().orderBy("YEAR")
    return joined.withColumns({"UNDERPROD": short,
                               "DELTA": F.col("HU") - F.lag("HU").over(by_year)})


def housing_type() -> Column:
    return (F.when(F.col("SEASONAL"), F.lit("Seasonal"))
            .when(F.col("UNINHABITABLE"), F.lit("Uninhabitable")).otherwise(F.lit("Remaining")))


def occupancy_type() -> Column:
    return if_else(F.col("VACANT"), F.lit("Vacant"), F.lit("Occupied"))


def share_table(units: DataFrame, kind: Column, state: int) -> DataFrame:
    """Weighted share of each kind of unit overall and in one state, as percent text.

    Both columns come from one pass: the state's sum is a conditional sum, missing where the state has
    no unit of the kind.
    """
    here = F.col("STATEFIP") == state
    sums = units.withColumn("HOUSINGTYPE", kind).groupBy("HOUSINGTYPE").agg(
        strict_sum(F.col("HHWT")).alias("USHH"), F.sum(F.when(here, F.col("HHWT"))).alias("COHH"))
    shares = group_share(group_share(sums, "USHH", out="us"), "COHH", out="co")
    return shares.select("HOUSINGTYPE", percent_text(F.col("us")).alias("US"),
                         percent_text(F.col("co")).alias("STATE"))


def in_use(units: DataFrame) -> DataFrame:
    """Units that are neither seasonal nor uninhabitable; unknown counts as neither kind."""
    return units.filter(~(F.col("SEASONAL") | F.col("UNINHABITABLE")))
