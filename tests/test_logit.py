"""Grouped logistic fits against direct Newton steps, Spark ML, and the properties of an optimum."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import LogitSpec, fit_formula, fit_logit_by, keyed_join, predicted
from tallyframe.operators.logit import predict_formula

SPEC = LogitSpec("m", ("x", "z"))
BARE = LogitSpec("bare")


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    out = []
    for _ in range(900):
        g = rnd.choice(["a", "b", "b", "b"])
        x, z = rnd.gauss(0, 1), rnd.randint(0, 1)
        p = 1 / (1 + math.exp(-((0.4 if g == "a" else -1.0) + 0.8 * x - 0.5 * z)))
        out.append((g, int(rnd.random() < p), x if rnd.random() > 0.05 else None, z, rnd.randint(1, 30)))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "g string, y int, x double, z int, w int").cache()


def newton(rows):
    x = np.array([[1.0, r[2], r[3]] for r in rows if r[2] is not None])
    y = np.array([r[1] for r in rows if r[2] is not None], dtype=float)
    w = np.array([r[4] for r in rows if r[2] is not None], dtype=float)
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return b


@pytest.mark.parametrize("whole", [0, 300, 100_000])
def test_coefficients(df, data, whole):
    coefs = {r.g: r for r in fit_logit_by(df, ["g"], "y", "w", [SPEC, BARE], whole=whole).collect()}
    for g in "ab":
        mine = [r for r in data if r[0] == g]
        assert [coefs[g][SPEC.coef(j)] for j in range(3)] == pytest.approx(list(newton(mine)), abs=1e-9)
        share = sum(r[1] * r[4] for r in mine) / sum(r[4] for r in mine)
        assert 1 / (1 + math.exp(-coefs[g][BARE.coef(0)])) == pytest.approx(share, abs=1e-12)


def test_scores_vanish_at_the_optimum(df):
    joined = keyed_join(df, fit_logit_by(df, ["g"], "y", "w", [SPEC]), ["g"])
    resid = F.col("w") * (F.col("y") - predicted(SPEC))
    for r in joined.groupBy("g").agg(F.sum(resid).alias("a"), F.sum(resid * F.col("x")).alias("b"),
                                     F.sum(F.when(F.col("x").isNotNull(), resid * F.col("z"))).alias("c")).collect():
        assert max(abs(r.a), abs(r.b), abs(r.c)) < 1e-6


def test_equals_one_formula_with_all_interactions(df):
    formula = "y ~ (x + z) * g"
    told = predict_formula(fit_formula(df, formula, "w"), df, formula, "ml")
    assert told.count() == df.count()
    assert told.filter("x is null and ml is not null").count() == 0
    both = keyed_join(told, fit_logit_by(df, ["g"], "y", "w", [SPEC]), ["g"]).withColumn("own", predicted(SPEC))
    assert both.agg(F.max(F.abs(F.col("own") - F.col("ml")))).collect()[0][0] < 1e-6


def test_replaced_covariate(df):
    coefs = fit_logit_by(df, ["g"], "y", "w", [SPEC])
    row = keyed_join(df, coefs, ["g"]).filter("z = 1").select(
        "*", predicted(SPEC, {"x": F.lit(2.0)}).alias("p")).first()
    eta = row[SPEC.coef(0)] + 2 * row[SPEC.coef(1)] + row[SPEC.coef(2)]
    assert row.p == pytest.approx(1 / (1 + math.exp(-eta)))


def test_separated_and_collinear_groups_still_give_rates(spark):
    data = [("sep", int(i >= 10), float(i >= 10), 1, 1) for i in range(20)]
    data += [("const", i % 3 == 0 and 1 or 0, 2.0, 1, 1) for i in range(30)]
    t = spark.createDataFrame(data, "g string, y int, x double, z int, w int")
    told = keyed_join(t, fit_logit_by(t, ["g"], "y", "w", [SPEC]), ["g"]).withColumn("p", predicted(SPEC))
    for r in told.collect():
        assert r.p == pytest.approx(r.y if r.g == "sep" else 1 / 3, abs=1e-3)


def test_group_without_a_complete_row_has_no_coefficients(spark):
    t = spark.createDataFrame([("a", 1, None, 1, 1), ("b", 1, 1.0, 0, 1), ("b", 0, 1.0, 1, 2), ("b", 0, 0.0, 0, 2),
                               ("b", 1, 0.0, 1, 2)], "g string, y int, x double, z int, w int")
    got = {r.g: r for r in fit_logit_by(t, ["g"], "y", "w", [SPEC]).collect()}
    assert got["a"][SPEC.coef(0)] is None and got["b"][SPEC.coef(0)] is not None


def test_statuses(spark, df):
    told = fit_logit_by(df, ["g"], "y", "w", [SPEC], max_iter=2).collect()
    assert {r[SPEC.status] for r in told} == {"unsettled"}
    data = [("sep", int(i >= 10), float(i >= 10), 1, 1) for i in range(20)] + [("none", 1, None, 1, 1)]
    data += [("mixed", i % 2, float(i % 3), i % 2, 1 + i % 5) for i in range(40)] + [("fine", int(i % 7 < 3), float(i % 5), i % 2, 1) for i in range(70)]
    t = spark.createDataFrame(data, "g string, y int, x double, z int, w int")
    got = {r.g: r[SPEC.status] for r in fit_logit_by(t, ["g"], "y", "w", [SPEC]).collect()}
    assert got["none"] == "empty" and got["fine"] == "settled" and got["sep"] == got["mixed"] == "separated"


def test_coefficients_of_separated_groups_are_those_evaluated(spark):
    """One more step would add about one to the slope; the same fit with a step less would differ."""
    t = spark.createDataFrame([("sep", int(i >= 10), float(i >= 10), 1, 1) for i in range(20)], "g string, y int, x double, z int, w int")
    r = fit_logit_by(t, ["g"], "y", "w", [SPEC]).first()
    eta = [r[SPEC.coef(0)] + r[SPEC.coef(1)] * x for x in (0.0, 1.0)]
    left = 10 * math.log1p(math.exp(eta[0])) + 10 * math.log1p(math.exp(-eta[1]))
    # the first evaluated point whose likelihood is next to one
    assert 1e-7 * 20 * math.log(2) < left <= 1e-6 * 20 * math.log(2)


def test_closed_groups_are_not_read_again(spark, monkeypatch):
    from tallyframe.operators import logit as module

    staged, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda d: staged.append(real(d)) or staged[-1])
    kept = []
    monkeypatch.setattr(module, "release_staged", lambda d: kept.append(d))
    data = [("easy", i % 2, 0.0, 0, 1) for i in range(300)]  # settles at once
    data += [("hard", int(i % 5 == 0), float(i % 11), i % 2, 1 + i % 9) for i in range(100)]
    t = spark.createDataFrame(data, "g string, y int, x double, z int, w int")
    fit_logit_by(t, ["g"], "y", "w", [SPEC], whole=0).collect()
    rows = [d for d in staged if "y" in d.columns]
    assert len(rows) == 1 and {r.g for r in rows[0].select("g").distinct().collect()} == {"hard"}


def test_many_groups(spark):
    t = spark.range(200_000).selectExpr("id % 50000 as g", "int(id / 50000) as k").selectExpr(
        "g", "int(k < 1 + g % 3) as y", "1 + g % 2 as w", "double(0) as x", "0 as z")
    got = fit_logit_by(t, ["g"], "y", "w", [BARE]).withColumn(
        "off", F.abs(1 / (1 + F.exp(-F.col(BARE.coef(0)))) - (1 + F.col("g") % 3) / 4))
    r = got.agg(F.count("*").alias("n"), F.max("off").alias("off")).first()
    assert r.n == 50_000 and r.off < 1e-9


def _odd_groups(spark):
    data = [("sep", int(i >= 10), float(i >= 10), 1, 1) for i in range(20)] + [("none", 1, None, 1, 1)]
    data += [("mixed", i % 2, float(i % 3), i % 2, 1 + i % 5) for i in range(40)]
    data += [("fine", int(i % 7 < 3), float(i % 5) if i % 6 else None, i % 2, 1) for i in range(70)] + [(None, int(i % 3 == 0), i / 9, i % 2, 2) for i in range(90)]
    data += [("const", int(i % 3 == 0), 2.0, 1, 1) for i in range(30)] + [("gone", None, 1.0, 1, 1), ("fine", 1, 1.0, 1, None)]
    return spark.createDataFrame(data, "g string, y int, x double, z int, w int")


@pytest.mark.parametrize("max_iter", [1, 3, 16])
def test_whole_groups_and_steps_over_all_rows_agree(spark, max_iter):
    t = _odd_groups(spark)
    ways = [{r.g: r.asDict() for r in fit_logit_by(t, ["g"], "y", "w", [SPEC, BARE], max_iter=max_iter, whole=n).collect()} for n in (0, 50, 10_000)]
    assert set(ways[0]) == set(ways[1]) == set(ways[2]) and "gone" not in ways[0]
    for g, want in ways[0].items():
        for other in ways[1:]:
            for c, v in want.items():
                assert other[g][c] == (pytest.approx(v, rel=1e-7, abs=1e-9) if isinstance(v, float) else v), (g, c)


def test_blocks_hold_whole_groups(spark, monkeypatch):
    from tallyframe.operators import logit as module

    monkeypatch.setattr(module, "WHOLE", 7)  # rows of a block; a group may have more
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        t = spark.range(600).selectExpr("id % 40 as g", "int(id * 7 % 11 < 1 + id % 5) as y", "1 + id % 3 as w", "double(id % 13) as x", "id % 2 as z")
        few = {r.g: r.asDict() for r in fit_logit_by(t, ["g"], "y", "w", [SPEC], whole=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.g: r.asDict() for r in fit_logit_by(t, ["g"], "y", "w", [SPEC], whole=0).collect()}
    assert len(few) == 40
    for g, r in want.items():
        assert few[g] == {c: pytest.approx(v, rel=1e-6, abs=1e-8) if isinstance(v, float) else v for c, v in r.items()}


def test_a_step_is_one_write(spark, monkeypatch):
    """Between the writes of the states the driver asks for nothing: progress is observed by the writes."""
    from tallyframe.operators import logit as module

    staged, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda d: staged.append(real(d)) or staged[-1])

    def refuse(*_, **__):
        raise AssertionError("an action besides the writes")

    data = [("a", int(i % 5 == 0), float(i % 11), i % 2, 1 + i % 9) for i in range(200)]
    t = spark.createDataFrame(data, "g string, y int, x double, z int, w int")
    with monkeypatch.context() as m:
        for action in ("collect", "first", "count", "isEmpty", "take", "toPandas", "toArrow", "head"):
            m.setattr(type(t), action, refuse)
        stepped = fit_logit_by(t, ["g"], "y", "w", [SPEC], max_iter=5, whole=0)
        assert len(staged) <= 1 + 5
        staged.clear()
        whole = fit_logit_by(t, ["g"], "y", "w", [SPEC])
        assert len(staged) == 2
    assert stepped.count() == whole.count() == 1
