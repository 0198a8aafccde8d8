"""Persons with their household: joins, recodes, real money, headship and age groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import age_breaks, cut, cut_id, floor_at_one, if_else, in_set
from tallyframe.operators.joins import keyed_join
from tallyframe.plans import codes as C

AGE_BREAKS = age_breaks(65)


def age_group(age: Column, breaks=AGE_BREAKS) -> Column:
    return cut(age, breaks, right=False, include_lowest=True)


def age_group_id(age: Column, breaks=AGE_BREAKS) -> Column:
    return cut_id(age, breaks, right=False, include_lowest=True)


def household_members(units: DataFrame, persons: DataFrame) -> DataFrame:
    """Every person beside their household, limited to households.

    The group-quarters condition needs a matched household, so the optimizer plans an inner join. Its
    shuffle keys spread evenly (a household has a handful of members), over partitions that grow in number with the files.
    """
    joined = keyed_join(units, persons.drop("RECTYPE"), C.HOUSEHOLD_KEY, "right", C.NULLABLE_KEY, deal=True)
    return joined.filter(in_set(F.col("GQ"), C.GQ_HOUSEHOLDS))


def with_headship(people: DataFrame, min_age: int, max_age: int) -> DataFrame:
    """Head-of-household flag, five-year age group, and the flag of the target ages."""
    age = F.col("AGE")
    return people.withColumns({
        "HEADSHIP": F.col("RELATE") == C.HEAD,
        "AGEGROUP": age_group(age),
        "age_dummy": (age >= min_age) & (age < max_age),
    })


def with_costs(people: DataFrame) -> DataFrame:
    """Sentinels recoded; housing cost by tenure; no income for children without one."""
    return people.withColumns({
        "HHINCOME": if_else(F.col("HHINCOME") == C.INCOME_MISSING, F.lit(0), F.col("HHINCOME")),
        "OWNCOST": if_else(F.col("OWNCOST") == C.OWNCOST_MISSING, F.lit(0), F.col("OWNCOST")),
        "INCTOT": if_else(F.col("INCTOT") == C.INCOME_MISSING, F.lit(None), F.col("INCTOT")),
    }).withColumns({
        "HOUSINGCOST": F.when(F.col("OWNERSHP") == C.OWNED, F.col("OWNCOST"))
        .when(F.col("OWNERSHP") == C.RENTED, F.col("RENTGRS")),
        "INCTOT": if_else(F.col("INCTOT").isNull() & (F.col("AGE") <= 15), F.lit(0), F.col("INCTOT")),
    })


def in_base_money(people: DataFrame, deflators: DataFrame) -> DataFrame:
    """Money columns in base-year prices, floored at one, and the yearly cost-to-income ratio.

    ``deflators`` has one row per calendar year, hence the broadcast.
    """
    factor = F.col("adj_factor")
    money = people.join(F.broadcast(deflators.select("YEAR", "adj_factor")), "YEAR", "left")
    return money.withColumns({c: F.col(c) * factor
                              for c in ("HOUSINGCOST", "HHINCOME", "INCTOT", "FTOTINC")}).withColumns({
        "INCTOT": floor_at_one(F.col("INCTOT")),
        "HOUSINGCOST": floor_at_one(F.col("HOUSINGCOST")),
    }).withColumn("HCOSTRATIO", F.col("HOUSINGCOST") / F.col("INCTOT") * 12)


def analysis_people(units: DataFrame, persons: DataFrame, deflators: DataFrame, min_age: int,
                    max_age: int) -> DataFrame:
    """The full person table of the analyses; columns a later step does not use are not read."""
    people = with_headship(household_members(units, persons), min_age, max_age)
    return in_base_money(with_costs(people), deflators)
