import random

import numpy as np

import pytest

from tallyframe.operators import quantile_sketch as qs, weighted_median


def brute(pairs):
    pairs = sorted((x, w) for x, w in pairs if x is not None)
    total, run, low, high = sum(w for _, w in pairs), 0, None, None
    for x, w in pairs:
        run += w
        if low is None and 2 * run >= total:
            low = x
        if high is None and 2 * run > total:
            high = x
    return (low + (high if high is not None else low)) / 2 if pairs else None


def check(spark, data, **kw):
    df = spark.createDataFrame(data, "g string, x double, w int")
    got = {r.g: r.x for r in weighted_median(df, ["g"], "x", "w", **kw).collect()}
    want = {g: brute([(x, w) for h, x, w in data if h == g]) for g in {d[0] for d in data}}
    want = {g: m for g, m in want.items() if m is not None}
    assert got == pytest.approx(want)


def test_small_cases(spark):
    check(spark, [("a", 1.0, 1), ("a", 2.0, 1), ("a", 3.0, 1), ("b", 1.0, 1), ("b", 2.0, 1),
                  (None, 5.0, 3), ("c", None, 1), ("d", 4.0, 2), ("d", None, 9)])


def test_half_reached_exactly_takes_the_middle(spark):
    check(spark, [("a", 1.0, 2), ("a", 5.0, 1), ("a", 9.0, 1)])


@pytest.mark.parametrize("left", [0, 1, 20, 10_000])
def test_random_values_ties_signs_and_scales(spark, left):
    rnd = random.Random(left)
    data = []
    for _ in range(3000):
        g = rnd.choice(["hot"] * 8 + ["b", "c", None])
        x = rnd.choice([rnd.uniform(-1, 1), 10 ** rnd.uniform(-6, 6), -(10 ** rnd.uniform(-3, 9)),
                        float(rnd.randint(0, 3)), None])
        data.append((g, x, rnd.randint(1, 40)))
    check(spark, data, left=left)


def test_values_packed_closely_together(spark):
    rnd = random.Random(1)
    check(spark, [("a", 1.0 + rnd.randint(0, 500) * 2.0 ** -50, rnd.randint(1, 5)) for _ in range(800)]
          + [("a", -1e300, 1), ("a", 1e300, 1)], left=5)


def test_no_group_columns(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 5), (8.0, 1)], "x double, w int")
    assert weighted_median(df, [], "x", "w").collect()[0].x == 2.0


def test_fractional_weights(spark):
    df = spark.createDataFrame([(float(i), 0.1) for i in range(11)], "x double, w double")
    assert weighted_median(df, [], "x", "w").collect()[0].x == 5.0


def _reads(spark, df, **kw):
    """How often the rows of ``df`` are read by the median, from a counter in the rows' own plan."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    n = df.count()
    found = weighted_median(df.mapInPandas(count, df.schema), ["g"], "x", "w", **kw).collect()
    return seen.value / n, {r.g: r.x for r in found}


@pytest.mark.parametrize("spread", ["even", "wide", "narrow", "ties"])
def test_two_reads_whatever_the_spread(spark, spread):
    rnd = random.Random(5)
    draw = {"even": lambda: rnd.uniform(0, 1), "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300),
            "narrow": lambda: 1.0 + rnd.randint(0, 3000) * 2.0 ** -50, "ties": lambda: float(rnd.randint(0, 2))}[spread]
    data = [(rnd.choice(["a", "a", "a", "b"]), draw(), rnd.randint(0, 40)) for _ in range(6000)] + [("a", -1e300, 1), ("a", 1e300, 1)]
    df = spark.createDataFrame(data, "g string, x double, w int").repartition(4)
    reads, got = _reads(spark, df, size=32, left=20)
    assert reads == 2
    assert got == pytest.approx({g: brute([(x, w) for h, x, w in data if h == g]) for g in "ab"})


def test_sketch_bounds_hold_and_are_narrow():
    rng = np.random.default_rng(3)
    for trial in range(60):
        blocks, values, weights = [], [], []
        for _ in range(rng.integers(1, 12)):
            x = np.sort(rng.choice([rng.normal(size=400), rng.integers(0, 9, 400).astype(float), rng.normal(size=400) * 1e-9], p=None)[: rng.integers(1, 400)])
            w = rng.integers(0, 20, len(x)).astype(float) if trial % 2 else rng.random(len(x))
            values.append(x)
            weights.append(w)
            blocks.append(qs.pruned(qs.exact(x, w), 40))
        half = len(blocks) // 2
        first = [qs.pruned(qs.merged(blocks[:half]), 40)] if half else []
        sketch = qs.pruned(qs.merged(first + blocks[half:]), 40)
        x, w = np.concatenate(values), np.concatenate(weights)
        for v, low, high, before in zip(*sketch):
            upto, under = w[x <= v].sum(), w[x < v].sum()
            assert low <= upto + 1e-9 and upto <= high + 1e-9 and under <= before + 1e-9
        order = np.argsort(x, kind="stable")
        run = np.cumsum(w[order])
        after, until = qs.bracket(sketch)
        if run[-1] > 0:
            reach = x[order][np.flatnonzero(run * 2 >= run[-1] * (1 - 1e-12))[0]]
            assert after < reach <= until
            ties = w[x == until].sum()
            assert w[(x > after) & (x <= until)].sum() - ties <= 0.35 * run[-1]


def test_many_small_groups(spark):
    df = spark.range(60_000).selectExpr("id % 20000 as g", "double(id * 7919 % 60000) as x", "1 + id % 3 as w")
    got = {r.g: r.x for r in weighted_median(df, ["g"], "x", "w").collect()}
    data = {}
    for i in range(60_000):
        data.setdefault(i % 20000, []).append((float(i * 7919 % 60000), 1 + i % 3))
    assert len(got) == 20_000 and all(got[g] == brute(data[g]) for g in range(0, 20_000, 997))
