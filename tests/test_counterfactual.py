"""Targets, scenarios and summaries on a few written-out rows."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import LogitSpec
from tallyframe.plans import counterfactual as cf
from tests.conftest import rows

BASE = LogitSpec("base", (cf.COST,))
PEOPLE = "YEAR int, AGE int, AGEGROUP string, PERWT int, HEADSHIP int, HCOSTRATIO double"


@pytest.fixture(scope="module")
def people(spark):
    data = [
        (2010, 16, "[15,20)", 10, 0, 1.0), (2010, 17, "[15,20)", 20, 1, None), (2010, 19, "[15,20)", 30, 1, 2.0),
        (2010, 30, "[30,35)", 5, 1, 3.0), (2010, 31, "[30,35)", 7, 0, 4.0), (2010, 31, "[30,35)", 0, 1, 9.0),
        (2010, 70, "[65,Inf]", 4, 1, 1.0), (2000, 30, "[30,35)", 2, 1, 1.0), (2010, 14, "[0,15)", 50, 0, 1.0),
    ]
    return spark.createDataFrame(data, PEOPLE).withColumn(cf.COST, F.log("HCOSTRATIO"))


@pytest.fixture(scope="module")
def coefs(spark):
    return spark.createDataFrame([(2010, "[15,20)", -1.0, 0.5), (2010, "[30,35)", 0.2, -0.3)],
                                 f"YEAR int, AGEGROUP string, {BASE.coef(0)} double, {BASE.coef(1)} double")


@pytest.fixture(scope="module")
def medians(spark):
    return spark.createDataFrame([("[15,20)", 1.5), ("[30,35)", 2.5), ("[65,Inf]", 1.0)],
                                 "AGEGROUP string, HCOSTRATIO double")


def rate(a, b, ratio):
    return 1 / (1 + math.exp(-(a + b * math.log(ratio))))


def test_targets_by_age(people, coefs, medians):
    got = rows(cf.target_households(people, coefs, medians, (2010,), 18, 199, BASE))
    young, old = rate(-1.0, 0.5, 1.5), rate(0.2, -0.3, 2.5)
    want = [
        # the group cut by the model age has its constant-rate and its modelled target
        (2010, "[15,20)", 50, pytest.approx(1.2), pytest.approx(1.2 - 50)),
        (2010, "[15,20)", 50, pytest.approx(30 * young), pytest.approx(30 * young - 50)),
        (2010, "[30,35)", 5, pytest.approx(12 * old), pytest.approx(12 * old - 5)),
        # no model was fitted for the group, so its target is missing
        (2010, "[65,Inf]", 4, None, None),
    ]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def test_summary_and_long_form(spark, people, coefs, medians):
    by_age = cf.target_households(people, coefs, medians, (2010,), 18, 199, BASE).filter("AGEGROUP = '[30,35)'")
    stats = spark.createDataFrame([(2010, 900, 1000, 40, 10)],
                                  "YEAR int, HOUSEHOLDS long, HU long, SEASONAL long, UNINHABITABLE long")
    summary = cf.decomposition_summary(by_age, stats, 2000, 0.05)
    r = summary.collect()[0]
    missing = 12 * rate(0.2, -0.3, 2.5) - 5
    assert (r.baseline_year, r.analysis_year, r.current_hh) == (2000, 2010, 5)
    assert r.underproduction == pytest.approx((missing + 900) / 0.95 - 950)
    long = {x.variable: x.value for x in cf.long_summary(summary.union(summary)).collect()}
    assert len(long) == 9 and long["housing_units"] == 1000.0 and long["missing_hh"] == pytest.approx(missing)


def test_scenarios(people, coefs):
    got = {r.ratio: r.missing_hh for r in cf.fixed_ratio_scenarios(
        people.filter("AGE < 65"), coefs, (2010,), (1.0, 0.1), 18, 199, BASE).collect()}
    for ratio in (1.0, 0.1):
        want = 30 * rate(-1.0, 0.5, ratio) + 12 * rate(0.2, -0.3, ratio) - 55
        assert got[ratio] == pytest.approx(want)


def test_counterfactual_rates(people, coefs, medians):
    sums = cf.counterfactual_sums(people, coefs, medians, (2010,), 18, 199, (BASE,))
    got = {r.AGEGROUP: r.base for r in cf.counterfactual_rates(sums, (BASE,)).collect()}
    assert got["[30,35)"] == pytest.approx(rate(0.2, -0.3, 2.5))
    assert got["[65,Inf]"] is None


def test_unit_scalars(spark):
    units = spark.createDataFrame(
        [(2010, 8, 0, 5, False, False), (2010, 4, 0, 7, False, None), (2010, 8, 4, 2, True, False)],
        "YEAR int, STATEFIP int, VACANCY int, HHWT int, SEASONAL boolean, UNINHABITABLE boolean")
    r = cf.unit_scalars(units, 8).collect()[0]
    assert (r.HOUSEHOLDS, r.HU, r.SEASONAL, r.UNINHABITABLE) == (5, 14, 2, 0)
