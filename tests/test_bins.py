import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.functions.bins import cut_labels

AGES = [0, 14, 15, 19, 20, 64, 65, 99, None]


def labels(spark, values, kind, *args, **kw):
    t = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r.v for r in t.select(fn.cut(F.col("x"), *args, **kw).alias("v")).collect()]


def test_age_groups(spark):
    assert labels(spark, AGES, "int", fn.age_breaks(65), right=False, include_lowest=True) == [
        "[0,15)", "[0,15)", "[15,20)", "[15,20)", "[20,25)", "[60,65)", "[65,Inf]", "[65,Inf]", None]


def test_open_age_bins_have_no_children(spark):
    assert labels(spark, AGES, "int", fn.age_breaks(65, lowest=None), right=False) == [
        None, None, "[15,20)", "[15,20)", "[20,25)", "[60,65)", "[65,Inf)", "[65,Inf)", None]


def test_right_closed_codes(spark):
    t = spark.createDataFrame([(v,) for v in (17, 18, 24, 25, 44, 45, 64, 65, 120, None)], "x int")
    ids = fn.cut_id(F.col("x"), (18, 24, 44, 64, math.inf), include_lowest=True)
    assert [r.v for r in t.select(ids.alias("v")).collect()] == [None, 1, 1, 2, 2, 3, 3, 4, 4, None]


def test_custom_labels(spark):
    got = labels(spark, [0.0, 0.1, 0.35, 0.36, 0.6, 0.61, 9.0, None, math.nan], "double",
                 (0, 0.35, 0.60, math.inf), labels=("0-35%", "35-60%", ">60%"))
    assert got[:8] == [None, "0-35%", "0-35%", "35-60%", "35-60%", ">60%", ">60%", None]


def test_label_text():
    assert cut_labels([0, 15, math.inf], right=False, include_lowest=True) == ["[0,15)", "[15,Inf]"]
    assert cut_labels([0, 0.35, 1], include_lowest=True) == ["[0,0.35]", "(0.35,1]"]


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("lowest", [True, False])
def test_bins_against_their_definition(spark, right, lowest):
    breaks = [-2, 0, 1.5, 4, 9]

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from([-2.0, 0.0, 1.5, 4.0, 9.0]), st.floats(-5, 12)), min_size=1,
                    max_size=40))
    def check(values):
        t = spark.createDataFrame([(v,) for v in values], "x double")
        got = [r.v for r in t.select(fn.cut_id(F.col("x"), breaks, right, lowest).alias("v")).collect()]
        for x, g in zip(values, got):
            want = None
            for i in range(len(breaks) - 1):
                lo, hi = breaks[i], breaks[i + 1]
                inside = lo < x <= hi if right else lo <= x < hi
                edge = lowest and ((right and i == 0 and x == lo) or (not right and i == 3 and x == hi))
                if inside or edge:
                    want = i + 1
            assert g == want, x

    check()
