"""Counterfactual headship: how many households would form at another year's housing cost burden.

Every model interacts all covariates with the age group, so one grouped fit serves all years, age groups
and models together, and all counterfactual predictions are sums over the same rows. A sweep over years
costs as many passes as one year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import flag, in_set, ratio, strict_sum, weighted_mean
from tallyframe.functions.bins import cut
from tallyframe.functions.nulls import mean_numerator
from tallyframe.operators.joins import keyed_join
from tallyframe.operators.logit import LogitSpec, fit_logit_by, predicted
from tallyframe.operators.median import weighted_median
from tallyframe.operators.reshape import longer, wider
from tallyframe.operators.totals import group_share
from tallyframe.plans import codes as C
from tallyframe.plans.housing import underproduction
from tallyframe.session import stage

COST = "LOGRATIO"
FAMILY = ("MARRIED", "NCHILD", "TRIGEN")
WORK = ("INLABOR", "HSEDU", "COLEDU")
MODELS = (
    LogitSpec("age"),
    LogitSpec("base", (COST,)),
    LogitSpec("family", (COST, *FAMILY)),
    LogitSpec("income_education", (COST, *WORK)),
    LogitSpec("full", (COST, *FAMILY, *WORK)),
)
FULL = MODELS[-1]
CELL = ("YEAR", "AGEGROUP")


def burden_shares(people: DataFrame, state: int, years: Sequence[int]) -> DataFrame:
    """Heads' weighted distribution over cost-burden classes, one column per year, in percent."""
    heads = people.filter(F.col("YEAR").isin(*years) & (F.col("RELATE") == C.HEAD)
                          & (F.col("STATEFIP") == state))
    burden = cut(F.col("HCOSTRATIO"), C.BURDEN_BREAKS, labels=C.BURDEN_LABELS)
    sums = heads.groupBy("YEAR", burden.alias("HCOSTQ")).agg(strict_sum(F.col("HHWT")).alias("P"))
    return wider(group_share(sums, "P", ["YEAR"], out="P"), ["HCOSTQ"], "YEAR", years, "P")


def model_rows(people: DataFrame, state: int, years: Sequence[int] | None = None,
               min_age: int | None = None, max_age: int | None = None) -> DataFrame:
    """Rows and covariates of the models; every covariate is numeric."""
    rows = people.filter(F.col("STATEFIP") == state)
    if years is not None:
        rows = rows.filter(F.col("YEAR").isin(*years))
    if min_age is not None:
        rows = rows.filter(F.col("AGE") >= min_age)
    if max_age is not None:
        rows = rows.filter(F.col("AGE") <= max_age)
    educ = F.col("EDUC")
    return rows.select(
        "YEAR", "AGE", "AGEGROUP", "PERWT", "NCHILD", "HCOSTRATIO",
        flag(F.col("HEADSHIP")).alias("HEADSHIP"),
        flag(in_set(F.col("MARST"), C.MARRIED)).alias("MARRIED"),
        flag(F.col("LABFORCE") == C.IN_LABOR_FORCE).alias("INLABOR"),
        flag((educ >= C.EDUC_HIGH_SCHOOL) & (educ < C.EDUC_COLLEGE)).alias("HSEDU"),
        flag(educ >= C.EDUC_COLLEGE).alias("COLEDU"),
        flag(F.col("MULTGEN") > C.MULTGEN_TWO).alias("TRIGEN"),
        F.log("HCOSTRATIO").alias(COST))


def _ages(min_age: int, max_age: int) -> Column:
    return (F.col("AGE") >= min_age) & (F.col("AGE") <= max_age)


def baseline_burden(rows: DataFrame, baseline_year: int, min_age: int, max_age: int) -> DataFrame:
    """``AGEGROUP, HCOSTRATIO``: weighted median cost ratio of the baseline year, one row per age group."""
    base = rows.filter(_ages(min_age, max_age) & (F.col("PERWT") != 0) & (F.col("YEAR") == baseline_year))
    return weighted_median(base, ["AGEGROUP"], "HCOSTRATIO", "PERWT")


def counterfactual_input(rows: DataFrame, medians: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rows of the analysis years with the cost ratio replaced by their age group's ``medians``.

    ``medians`` has one row per age group and is small, so the rows stay where they are.
    """
    current = rows.filter(F.col("YEAR").isin(*years)).drop("HCOSTRATIO", COST)
    return keyed_join(current, medians, ["AGEGROUP"])


def fit_models(rows: DataFrame, min_age: int, max_age: int, years: Sequence[int] | None = None,
               models: Sequence[LogitSpec] = MODELS) -> DataFrame:
    """Coefficients of the models per year and age group."""
    fit = rows.filter(_ages(min_age, max_age) & (F.col("PERWT") != 0))
    if years is not None:
        fit = fit.filter(F.col("YEAR").isin(*years))
    return fit_logit_by(fit, CELL, "HEADSHIP", "PERWT", models)


def counterfactual_sums(rows: DataFrame, coefs: DataFrame, medians: DataFrame, years: Sequence[int],
                        min_age: int, max_age: int, models: Sequence[LogitSpec]) -> DataFrame:
    """Per year and age group: weight, and per model the weighted rates at the baseline cost ratio."""
    cf = counterfactual_input(rows.filter(_ages(min_age, max_age)), medians, years)
    joined = keyed_join(cf, coefs, CELL)
    w = F.col("PERWT")
    at_base = {COST: F.log("HCOSTRATIO")}
    means = [strict_sum(mean_numerator(predicted(m, at_base), w)).alias(f"mean_{m.name}") for m in models]
    return joined.groupBy(*CELL).agg(strict_sum(w).alias("people"), *means)


def counterfactual_rates(sums: DataFrame, models: Sequence[LogitSpec] = MODELS) -> DataFrame:
    """Counterfactual headship rate per year and age group, one column per model."""
    return sums.select(*CELL, *[ratio(F.col(f"mean_{m.name}"), F.col("people")).alias(m.name)
                                for m in models])


def observed_rates(rows: DataFrame, years: Sequence[int], min_age: int = 15) -> DataFrame:
    """Observed headship rate by age group, one column per year."""
    seen = rows.filter(F.col("YEAR").isin(*years) & (F.col("AGE") >= min_age))
    rates = seen.groupBy(*CELL).agg(weighted_mean(F.col("HEADSHIP"), F.col("PERWT")).alias("rate"))
    return wider(rates, ["AGEGROUP"], "YEAR", years, "rate")


def target_households(rows: DataFrame, coefs: DataFrame, medians: DataFrame, years: Sequence[int],
                      min_age: int, max_age: int, model: LogitSpec = FULL) -> DataFrame:
    """``YEAR, AGEGROUP, HH, NEWHH, MISSINGHH``: actual heads from age 15 against the wanted households.

    Those are modelled ones from ``min_age`` on and a constant rate below it. An age group cut by
    ``min_age`` has a row for each of its two targets. All sums come from one pass over the rows.
    """
    joined = keyed_join(counterfactual_input(rows.filter(_ages(15, max_age)), medians, years), coefs, CELL)
    w, counted = F.col("PERWT"), F.col("PERWT") != 0
    young, grown = counted & (F.col("AGE") < min_age), F.col("AGE") >= min_age
    sums = joined.groupBy(*CELL).agg(
        F.count(F.when(counted, 1)).alias("n"), F.count(F.when(young, 1)).alias("n_young"),
        F.count(F.when(grown, 1)).alias("n_grown"),
        strict_sum(w * F.col("HEADSHIP"), counted).alias("HH"),
        strict_sum(w * F.lit(C.YOUNG_HEADSHIP), young).alias("by_rate"),
        strict_sum(w * predicted(model, {COST: F.log("HCOSTRATIO")}), grown).alias("by_model"))
    targets = F.filter(
        F.array(F.struct(F.col("n_young").alias("n"), F.col("by_rate").cast("double").alias("NEWHH")),
                F.struct(F.col("n_grown").alias("n"), F.col("by_model").cast("double").alias("NEWHH"))),
        lambda t: t["n"] > 0)
    return (sums.filter(F.col("n") > 0).select(*CELL, "HH", F.explode_outer(targets).alias("t"))
            .select(*CELL, "HH", F.col("t.NEWHH").alias("NEWHH"))
            .withColumn("MISSINGHH", F.col("NEWHH") - F.col("HH")))


def decomposition_summary(by_age: DataFrame, stats: DataFrame, baseline_year: int,
                          vacancy_rate: float) -> DataFrame:
    """One row per analysis year; ``stats`` holds ``YEAR, HOUSEHOLDS, HU, SEASONAL, UNINHABITABLE``."""
    sums = by_age.groupBy("YEAR").agg(
        strict_sum(F.col("NEWHH")).alias("target_hh"), strict_sum(F.col("HH")).alias("current_hh"),
        strict_sum(F.col("MISSINGHH")).alias("missing_hh"))
    joined = keyed_join(sums, stats, ["YEAR"])
    return joined.select(
        F.lit(baseline_year).alias("baseline_year"), F.col("YEAR").alias("analysis_year"),
        "target_hh", "current_hh", "missing_hh", F.col("HOUSEHOLDS").alias("households"),
        F.lit(vacancy_rate).alias("vacancy_rate"), F.col("HU").alias("housing_units"),
        F.col("SEASONAL").alias("seasonal_housing"), F.col("UNINHABITABLE").alias("uninhabitable_housing"),
        underproduction(F.col("HOUSEHOLDS"), F.col("missing_hh"), F.col("HU"), F.col("SEASONAL"),
                        F.col("UNINHABITABLE"), vacancy_rate).alias("underproduction"))


def unit_scalars(units: DataFrame, state: int) -> DataFrame:
    """Unit counts per year the summaries look up: all units, seasonal, uninhabitable, and households.

    The file's units count in all states and the households in one, as in the published analysis. A
    year without uninhabitable units has 0; the other counts are missing where no unit qualifies.
    """
    w = F.col("HHWT")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w))

    return units.groupBy("YEAR").agg(
        total((F.col("STATEFIP") == state) & (F.col("VACANCY") == C.VACANCY_OCCUPIED)).alias("HOUSEHOLDS"),
        total(F.lit(True)).alias("HU"), total(F.col("SEASONAL")).alias("SEASONAL"),
        F.coalesce(total(F.col("UNINHABITABLE")), F.lit(0)).alias("UNINHABITABLE"))


def decompose(people: DataFrame, stats: DataFrame, years: Sequence[int], baseline_year: int, state: int,
              min_age: int, max_age: int, vacancy_rate: float,
              model: LogitSpec = FULL) -> tuple[DataFrame, DataFrame]:
    """Summary row per analysis year and the table by age behind it, for all ``years`` together."""
    wanted = sorted({*years, baseline_year})
    rows = stage(model_rows(people, state, wanted, 15, max_age))
    medians = baseline_burden(rows, baseline_year, min_age, max_age)
    coefs = fit_models(rows, min_age, max_age, years, (model,))
    by_age = target_households(rows, coefs, medians, years, min_age, max_age, model)
    summary = decomposition_summary(by_age, stats, baseline_year, vacancy_rate)
    table = by_age.select(F.lit(baseline_year).alias("baseline_year"), F.col("YEAR").alias("analysis_year"),
                          "AGEGROUP", "HH", "NEWHH", "MISSINGHH")
    return summary, table


def long_summary(summary: DataFrame) -> DataFrame:
    """Distinct summary rows as ``baseline_year, analysis_year, variable, value``."""
    ids = ["baseline_year", "analysis_year"]
    return longer(summary.distinct(), ids, [c for c in summary.columns if c not in ids],
                  "variable", "value")


def fixed_ratio_scenarios(rows: DataFrame, coefs: DataFrame, years: Sequence[int],
                          ratios: Sequence[float], min_age: int, max_age: int,
                          model: LogitSpec = FULL) -> DataFrame:
    """``YEAR, ratio, missing_hh`` if every person spent the given share of income on housing.

    All scenarios are sums over the same rows, so the rows are read once however many there are.
    """
    w, counted, grown = F.col("PERWT"), F.col("PERWT") != 0, F.col("AGE") >= min_age
    current = rows.filter(F.col("YEAR").isin(*years) & _ages(15, max_age))
    joined = keyed_join(current, coefs, CELL)
    sums = joined.groupBy(*CELL).agg(
        F.count(F.when(counted, 1)).alias("n"), F.count(F.when(grown, 1)).alias("n_grown"),
        strict_sum(w * F.col("HEADSHIP"), counted).alias("HH"), *[
            strict_sum(w * predicted(model, {COST: F.log(F.lit(float(r)))}), grown).alias(f"r{i}")
            for i, r in enumerate(ratios)])
    actual = F.when(F.col("n") > 0, F.col("HH"))
    swept = sums.filter(F.col("n_grown") > 0).withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(float(r)).alias("ratio"), (F.col(f"r{i}") - actual).alias("missing_hh"))
        for i, r in enumerate(ratios)])))
    return swept.groupBy("YEAR", F.col("s.ratio").alias("ratio")).agg(
        strict_sum(F.col("s.missing_hh")).alias("missing_hh"))
