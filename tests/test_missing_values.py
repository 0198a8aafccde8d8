"""The rules in which statistical data frames differ from SQL, one by one."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import keyed_join
from tests.conftest import rows


@pytest.fixture
def t(spark):
    return spark.createDataFrame(
        [("a", 1, 2.0), ("a", None, 1.0), ("b", 3, 1.0), ("b", 5, 3.0), ("c", None, 0.0), ("c", 4, 2.0)],
        "g string, x int, w double")


def one(df, expr):
    return df.select(expr.alias("v")).collect()[0].v


def test_membership_is_never_missing(t):
    assert rows(t.filter(fn.not_in_set(F.col("x"), [3, 4])).select("x")) == [(1,), (5,), (None,), (None,)]
    assert t.filter(fn.in_set(F.col("x"), [3, 4])).count() == 2


def test_choice_with_missing_condition(t):
    got = rows(t.select(fn.if_else(F.col("x") > 2, F.lit("hi"), F.lit("lo")).alias("v")))
    assert got == [("hi",), ("hi",), ("hi",), ("lo",), (None,), (None,)]


def test_case_treats_missing_as_no_match(t):
    assert t.filter(F.when(F.col("x") > 2, 1).otherwise(0) == 0).count() == 3


def test_strict_sum(t):
    assert rows(t.groupBy("g").agg(fn.strict_sum(F.col("x")))) == [("a", None), ("b", 8), ("c", None)]
    assert one(t.filter("g='z'"), fn.strict_sum(F.col("x"))) == 0


def test_strict_sum_may_be_taken_in_steps(t):
    twice = t.groupBy("g").agg(fn.strict_sum(F.col("x")).alias("s")).agg(fn.strict_sum(F.col("s")).alias("v"))
    assert twice.collect()[0].v is None
    whole = t.filter("g='b'").groupBy("g").agg(fn.strict_sum(F.col("x")).alias("s")).agg(
        fn.strict_sum(F.col("s")).alias("v"))
    assert whole.collect()[0].v == 8


def test_sum_of_present_values(t):
    assert rows(t.groupBy("g").agg(fn.sum0(F.col("x")))) == [("a", 1), ("b", 8), ("c", 4)]
    assert one(t.filter("x is null"), fn.sum0(F.col("x"))) == 0


def test_joins_match_missing_to_missing(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, a string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, b string")
    assert rows(keyed_join(a, b, ["k"])) == [(1, "p", "x"), (3, "r", None), (None, "q", "y")]
    assert rows(keyed_join(a, b, ["k"], "right")) == [(1, "p", "x"), (4, None, "z"), (None, "q", "y")]
    assert rows(keyed_join(a, b, ["k"], "full")) == [
        (1, "p", "x"), (3, "r", None), (4, None, "z"), (None, "q", "y")]
    assert rows(keyed_join(a, b, ["k"], nullable=())) == [(1, "p", "x"), (3, "r", None), (None, "q", None)]


def test_sort_puts_missing_last(t):
    assert t.orderBy(F.asc_nulls_last("x")).select("x").collect()[-1].x is None


def test_three_valued_logic(spark):
    v = spark.range(1).select((F.lit(False) & F.lit(None).cast("boolean")).alias("f"),
                              (F.lit(True) & F.lit(None).cast("boolean")).alias("t")).collect()[0]
    assert v.f is False and v.t is None


def test_filter_drops_missing_condition(t):
    assert t.filter(F.col("x") > 0).count() == 4


def test_weighted_mean(t):
    got = {r.g: r.v for r in t.groupBy("g").agg(fn.weighted_mean(F.col("x"), F.col("w")).alias("v")).collect()}
    # "a" has a missing value that counts; the one of "c" has weight 0
    assert got == {"a": None, "b": 4.5, "c": 4.0}
    nothing = one(t.filter("w=0").withColumn("x", F.lit(1)), fn.weighted_mean(F.col("x"), F.col("w")))
    assert math.isnan(nothing)


def test_group_keys_keep_missing(t):
    assert rows(t.groupBy("x").count())[-1] == (None, 2)


def test_ratio_follows_floating_point(spark):
    t = spark.createDataFrame([(1, 0), (-1, 0), (0, 0), (None, 0), (1, None), (1, 4)], "a int, b int")
    got = [r.v for r in t.select(fn.ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, None, 0.25]


def test_floor_at_one_keeps_missing(spark):
    t = spark.createDataFrame([(-3.0,), (0.5,), (7.0,), (None,)], "x double")
    assert [r.v for r in t.select(fn.floor_at_one(F.col("x")).alias("v")).collect()] == [1.0, 1.0, 7.0, None]


def test_strict_mean(t):
    assert rows(t.groupBy("g").agg(fn.strict_mean(F.col("x")))) == [("a", None), ("b", 4.0), ("c", None)]


def test_rounding_half_to_even(spark):
    t = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.51,)], "x double")
    assert [r.v for r in t.select(fn.round_half_even(F.col("x")).alias("v")).collect()] == [0, 2, 2, 0, 3]
