import pytest
from pyspark.sql import functions as F

from tallyframe.operators import (
    append_totals, full_join, group_share, longer, matching, natural_join, relocate, union_fill, wider,
    with_missing_years, without,
)
from tallyframe.operators.reshape import column_range
from tallyframe.plans.labels import label_table
from tests.conftest import rows


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(2000, "a", 1, 10.0), (2000, "b", 2, 20.0), (2001, "a", 3, None)],
                                 "y int, k string, n int, v double")


def test_relocate(t):
    assert relocate(t, "v").columns == ["v", "y", "k", "n"]
    assert relocate(t, "v", after="y").columns == ["y", "v", "k", "n"]
    assert relocate(t, ["n", "v"], before="k").columns == ["y", "n", "v", "k"]


def test_column_choice(t):
    assert matching(t, "^[KN]$") == ["k", "n"]
    assert without(t, "y", "v") == ["k", "n"]
    assert column_range(t, "k", "v") == ["k", "n", "v"]


def test_wide_and_back(t):
    wide = wider(t, ["k"], "y", [2000, 2001], "n")
    assert rows(wide) == [("a", 1, 3), ("b", 2, None)]
    back = longer(wide, ["k"], ["2000", "2001"], "y", "n", "int").filter("n is not null")
    assert rows(back.select(F.col("y").cast("int"), "k", "n")) == rows(t.select("y", "k", "n"))


def test_totals(t):
    got = rows(append_totals(t, ["y"], "k", "total", ["n", "v"], derived={"v": F.col("n") * 2.0}))
    assert (2000, "total", 3, 6.0) in got and len(got) == 5


def test_strict_totals_are_missing_where_a_part_is(t):
    got = {r.y: r.v for r in append_totals(t, ["y"], "k", "total", ["n", "v"]).filter("k='total'").collect()}
    assert got == {2000: 30.0, 2001: None}


def test_share(t):
    assert [r.share for r in group_share(t, "n", ["y"]).orderBy("y", "k").collect()] == pytest.approx(
        [100 / 3, 200 / 3, 100])


def test_missing_years_are_filled_but_missing_values_are_not(t):
    got = rows(with_missing_years(t.filter("k='a'").select("y", "v"), "y", 1999, 2002, {"v": 0.0}))
    assert got == [(1999, 0.0), (2000, 10.0), (2001, None), (2002, 0.0)]


def test_union_fills_absent_columns(t):
    assert rows(union_fill(t.select("y"), t.select("k")))[-1] == (None, "b")


def test_full_join_suffixes(spark):
    a = spark.createDataFrame([(1, 5)], "k int, n int")
    b = spark.createDataFrame([(1, 6), (2, 7)], "k int, n int")
    got = full_join(a, b, ["k"], ("_a", "_b"))
    assert got.columns == ["k", "n_a", "n_b"] and rows(got) == [(1, 5, 6), (2, None, 7)]


def test_natural_join_needs_a_common_column(spark, t):
    with pytest.raises(ValueError):
        natural_join(t, spark.range(1))


def test_label_table(spark):
    d = spark.createDataFrame([("A", [(1, "x"), (2, "y")]), ("B", [(7, "z")])],
                              "var_name string, val_labels array<struct<val:int,lbl:string>>")
    got = label_table(d, ["A", "B"], last="A")
    assert got.columns == ["B_val", "B_lbl", "A_val", "A_lbl"]
    assert rows(got) == [(7, "z", 1, "x"), (None, None, 2, "y")]
