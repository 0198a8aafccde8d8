import math
import random

import pytest

from tallyframe.functions import percent_text
from pyspark.sql import functions as F


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_percent_text_prints_as_c_does(spark, digits):
    rnd = random.Random(digits)
    values = [0.125, 1.005, 2.675, 0.375, -0.125, 0.0, 99.995, 1e15, 123456.785, -2.5, 0.05, 1e-9, 1e17]
    values += [rnd.uniform(-100, 100) for _ in range(400)] + [rnd.randint(-10**6, 10**6) / 8 for _ in range(400)]
    values += [round(rnd.uniform(0, 100), digits) + 5 * 10.0 ** -(digits + 1) for _ in range(400)]
    t = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = {r.i: r.s for r in t.select("i", percent_text(F.col("v"), digits).alias("s")).collect()}
    for i, v in enumerate(values):
        want = f"%.{digits}f%%" % v
        assert found[i] == want or (float(want[:-1]) == 0 and found[i].lstrip("-") == want.lstrip("-")), v


def test_percent_text_of_what_is_no_number(spark):
    t = spark.createDataFrame([(math.nan,), (math.inf,), (None,)], "v double")
    assert [r.s for r in t.select(percent_text(F.col("v")).alias("s")).collect()] == ["NaN%", "Inf%", None]
