"""Weighted counts and means with replicate weights, against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import SurveyDesign, survey_count, survey_counts, survey_mean
from tallyframe.operators.design import BLOCK

R = 8


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    out = []
    for i in range(400):
        g = rnd.choice(["a", "a", "a", "b", None])
        y = rnd.choice([True, False, None])
        w = rnd.randint(1, 90)
        out.append((g, y, rnd.choice([1.5, 2.0, None]), w, *[w + rnd.randint(-5, 5) for _ in range(R)]))
    return out


@pytest.fixture(scope="module")
def design(spark, data):
    cols = ", ".join(f"REPWT{i} int" for i in range(1, R + 1))
    df = spark.createDataFrame(data, f"g string, y boolean, x double, W int, {cols}")
    return SurveyDesign.from_pattern(df, "W", "REPWT[0-9]+")


def se(theta, reps, scale=4 / R):
    return math.sqrt(scale * sum((r - theta) ** 2 for r in reps))


def test_replicate_columns_are_found_by_pattern(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "HHWT int, REPWT1 int, repwt2 int, REPWTP1 int")
    assert SurveyDesign.from_pattern(df, "HHWT", "REPWT[0-9]+").replicates == ("REPWT1", "repwt2")
    with pytest.raises(ValueError):
        SurveyDesign.from_pattern(df, "HHWT", "NOPE")


def test_count(design, data):
    got = {r.g: (r.n, r.n_se) for r in survey_count(design, ["g"]).collect()}
    for g in ("a", "b", None):
        w = np.array([r[3:] for r in data if r[0] == g]).sum(axis=0)
        assert got[g][0] == w[0]
        assert got[g][1] == pytest.approx(se(w[0], w[1:]))


def test_collapsing_first_changes_nothing(design):
    direct = {r.g: (r.n, r.n_se) for r in survey_count(design, ["g"]).collect()}
    steps = {r.g: (r.n, r.n_se) for r in survey_count(design.collapse("g", "y"), ["g"]).collect()}
    assert direct == steps


def test_domains_together_equal_domains_apart(design):
    domains = {"yes": F.col("y"), "big": F.col("W") > 60, "none": F.col("W") > 1000}
    fused = {r.g: r for r in survey_counts(design, ["g"], {"all": F.lit(True), **domains}).collect()}
    for name, cond in domains.items():
        apart = {r.g: (r.n, r.n_se) for r in survey_count(design.filter(cond), ["g"]).collect()}
        for g, row in fused.items():
            # a group without a row in the domain is missing, not zero
            assert (row[name], row[f"{name}_se"]) == apart.get(g, (None, None))


@pytest.mark.parametrize("column,at", [("y", 1), ("x", 2)])
def test_mean_over_present_values(design, data, column, at):
    got = {r.g: (r.m, r.m_se) for r in survey_mean(design, ["g"], column, "m").collect()}
    for g in ("a", "b", None):
        mine = [r for r in data if r[0] == g and r[at] is not None]
        y = np.array([float(r[at]) for r in mine])
        w = np.array([r[3:] for r in mine], dtype=float)
        theta = (w * y[:, None]).sum(axis=0) / w.sum(axis=0)
        assert got[g][0] == pytest.approx(theta[0])
        assert got[g][1] == pytest.approx(se(theta[0], theta[1:]))


@pytest.mark.parametrize("kind", ["int", "boolean", "double"])
def test_a_mean_of_many_weights_is_taken_in_blocks(spark, kind):
    reps = 2 * BLOCK + 3
    rnd = random.Random(9)
    value = {"int": lambda: rnd.choice([0, 2, 3, None]), "boolean": lambda: rnd.choice([True, False, None]),
             "double": lambda: rnd.choice([-0.5, 1.25, None])}[kind]
    data = [(rnd.choice(["a", "b", None]), value(), *[rnd.randint(1, 99) for _ in range(reps + 1)]) for _ in range(90)]
    data.append(("only missing", None, *[1] * (reps + 1)))
    cols = ", ".join(f"REPWT{i} int" for i in range(1, reps + 1))
    df = spark.createDataFrame(data, f"g string, v {kind}, W int, {cols}")
    result = survey_mean(SurveyDesign.from_pattern(df, "W", "REPWT[0-9]+"), ["g"], "v")
    got = {r.g: (r.v, r.v_se) for r in result.collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        mine = [r for r in data if r[0] == g and r[1] is not None]
        y, w = np.array([float(r[1]) for r in mine]), np.array([r[2:] for r in mine], dtype=float)
        theta = (w * y[:, None]).sum(axis=0) / w.sum(axis=0)
        assert got[g] == (pytest.approx(theta[0]), pytest.approx(se(theta[0], theta[1:], 4 / reps)))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert max(line.count(" partial_sum(") for line in plan.splitlines()) <= 2 * BLOCK


def test_equal_replicates_have_no_error(spark):
    df = spark.createDataFrame([(1, 5, 5, 5), (1, 7, 7, 7)], "g int, W int, REPWT1 int, REPWT2 int")
    row = survey_count(SurveyDesign.from_pattern(df, "W", "REPWT"), ["g"]).collect()[0]
    assert (row.n, row.n_se) == (12, 0.0)


def test_error_scales_with_the_weights(design):
    once = {r.g: r.n_se for r in survey_count(design, ["g"]).collect()}
    tripled = design.with_columns({w: F.col(w) * 3 for w in design.weights})
    for r in survey_count(tripled, ["g"]).collect():
        assert r.n_se == pytest.approx(3 * once[r.g])
