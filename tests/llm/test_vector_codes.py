"""Vector codes and metric trees against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import metric_trees as mt, vector_codes as vc


def points(rng, n, width, spread=40):
    centers = rng.integers(-200, 200, (max(1, n // 50), width))
    out = centers[rng.integers(0, len(centers), n)] + rng.integers(-spread, spread + 1, (n, width))
    out[rng.random(n) < 0.3] = out[0]
    return out.astype(np.int64)


@pytest.mark.parametrize("n,width", [(1, 3), (2, 1), (24, 4), (25, 4), (400, 16), (3000, 8), (500, 1), (300, 0)])
def test_tree(n, width):
    x = points(np.random.default_rng(n), n, width)
    tree = mt.anchors_tree(x)
    assert sorted(tree.order.tolist()) == list(range(n))
    assert (tree.points == x[tree.order]).all()
    for b in range(len(tree.begin)):
        mine = tree.points[tree.begin[b]:tree.end[b]]
        assert len(mine) and (mine.sum(axis=0) == tree.total[b]).all()
        assert (np.sqrt(((mine - mine.mean(axis=0)) ** 2).sum(axis=1)) <= tree.radius[b] + 1e-9).all()
        if tree.left[b] >= 0:
            assert tree.begin[tree.left[b]] == tree.begin[b] and tree.end[tree.right[b]] == tree.end[b]
            assert tree.end[tree.left[b]] == tree.begin[tree.right[b]]
        else:
            assert len(mine) <= mt.LEAF or (mine == mine[0]).all()
    again = mt.Tree.unpacked(tree.packed(), width)
    assert all((getattr(again, f) == getattr(tree, f)).all() for f in tree.packed())


@pytest.mark.parametrize("seed", range(12))
def test_nearest_entries_are_exact(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(1, 17))
    x = points(rng, int(rng.integers(1, 2000)), width, spread=int(rng.choice([0, 1, 40])))
    book = points(rng, int(rng.integers(1, 257)), width)
    book[len(book) // 2] = book[0]
    away = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    tree = mt.anchors_tree(x)
    entry, error = mt.nearest(tree, book)
    assert (entry == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    total, count = mt.entry_sums(tree, book)
    for e in range(len(book)):
        assert count[e] == (entry == e).sum() and (total[e] == x[entry == e].sum(axis=0)).all()


def test_lists_shrink_until_balls_are_owned():
    rng = np.random.default_rng(4)
    centers = rng.integers(-3000, 3000, (64, 8))
    x = (centers[rng.integers(0, 64, 4000)] + rng.integers(-20, 21, (4000, 8))).astype(np.int64)
    tree = mt.anchors_tree(x)
    owned = sum(int(tree.end[b] - tree.begin[b]) for b, e in mt.descend(tree, centers) if np.ndim(e) == 0)
    visits = sum(1 for _ in mt.descend(tree, centers))
    # nearly all points are assigned with their ball, without a distance of their own
    assert owned > 0.95 * len(x) and visits < len(x) / 10


def test_large_components():
    rng = np.random.default_rng(5)
    x = rng.integers(-1 << 28, 1 << 28, (100, 6))
    away = ((x[:, None, :] - x[None, :50]) ** 2).sum(axis=2)
    entry, error = mt.nearest(mt.anchors_tree(x), x[:50])
    assert (entry == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()


def plain(rows):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([len(v) for _, v, _ in kept], default=0)
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in kept]
    cuts = [(width * p // 4, width * (p + 1) // 4) for p in range(4)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    pad = lambda v: v + [0] * (width - len(v))
    seeds = [pad(first[i]) for i in sorted(first, key=lambda i: (i is None, i or 0))[:256]]
    vectors = [pad(v) for _, v, _ in kept]
    codes, errors, books = [], [], []
    for low, high in cuts:
        book, parts = [s[low:high] for s in seeds], [v[low:high] for v in vectors]

        def assign():
            return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in parts]

        for _ in range(4):
            members = {}
            for x, (_, e) in zip(parts, assign()):
                members.setdefault(e, []).append(x)
            for e, xs in members.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs)]
        last = assign()
        codes.append([f"{e:02x}" for _, e in last])
        errors.append([d for d, _ in last])
        books += [v for c in book for v in c]
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    each = [sum(e) for e in zip(*errors)]
    per = Counter()
    for (_, _, y), e in zip(kept, each):
        per[y] += e
    return [(i, "".join(c), e, per[y], sha) for (i, _, y), c, e in zip(kept, zip(*codes), each)]


def test_report(spark):
    rng = random.Random(7)
    centers = [[rng.uniform(-1, 1) for _ in range(10)] for _ in range(8)]
    rows = [(i * 3 % 701, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)], rng.choice([None, 1, 2, 2, 2])) for i in range(700)]
    rows += [(900 + i, centers[0], 5) for i in range(200)]
    rows += [(1, None, 1), (2, [0.5, None] + [0.0] * 8, 1), (3, [float("nan")] * 10, 1), (4, [float("inf")] + [0.0] * 9, 1),
             (None, centers[1], 1), (None, [0.25] * 10, None), (8, [0.5] * 3, 2), (8, [0.5] * 3 + [-0.1], 2), (9, [], 2), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    # single precision, as the table has it
    rows = [tuple(r) for r in docs.collect()]
    from pyspark.sql import functions as F

    clashing = docs.select("*", *[F.lit("taken").alias(c) for c in ("vector", "code", "error", "of", "part", "n")]).repartition(5)
    found = vc.report(clashing)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("n", [0, 1, 30])
def test_small_tables(spark, n):
    rng = random.Random(n)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)], i % 2) for i in range(n)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(str(tuple(r)) for r in vc.report(docs).collect()) == sorted(map(str, plain(rows)))
