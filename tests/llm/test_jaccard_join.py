import random
from collections import defaultdict

import numpy as np
import pytest

from tallyframe.llm import jaccard_join as jj
from tests.llm.cases import fold, frame, odd_rows, prose, words


def family(seed, size, copies, changes, first):
    """Near copies of one text with a few words changed, and copies of copies."""
    rng, base = random.Random(seed), prose(seed, size, 2000).split()
    rows = [(first, " ".join(base), "en", "a", 1)]
    for k in range(1, copies):
        text = list(base)
        for _ in range(rng.choice(changes)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(text), "en", "a", 1))
    return rows


def documents():
    rows = odd_rows()
    for k, (size, copies, changes) in enumerate([(120, 30, (1, 2, 3)), (400, 25, (2, 8, 14)), (40, 20, (0, 1)), (15, 10, (0, 1)),
                                                 (700, 6, (10, 25)), (9, 6, (0, 1))]):
        rows += family(k, size, copies, changes, 1000 * (k + 1))
    # boilerplate that many different texts share
    shared = prose(99, 60)
    return rows + [(9000 + k, f"{shared} {prose(500 + k, 60)}", "en", "a", 1) for k in range(30)]


def brute(rows, width, percent):
    sets = {}
    for i, text, *_ in rows:
        w = fold(text)
        w = words(w)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    by, common, parent = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            u, v = sorted((root(a), root(b)))
            parent[v] = u
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent,block", [(3, 90, 4096), (3, 90, 7), (5, 80, 4096), (5, 80, 5)])
def test_components(spark, width, percent, block):
    rows = [r for r in documents() if r[0] is not None]
    want = brute(rows, width, percent)
    found = jj.linked(frame(spark, rows), width, percent, block).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_one_of_each_group(spark):
    rows = [r for r in documents() if r[0] is not None]
    want = sorted({c for _, c in brute(rows, 5, 80).values()})
    assert sorted({r.doc_id for r in jj.one_of_each_group(frame(spark, rows)).collect()}) == want


def test_size_classes_hold_linked_sizes():
    for percent in (50, 80, 90, 95):
        classes = jj.SizeClasses(percent)
        for a in range(1, 600):
            largest = a * 100 // percent
            assert classes.of(largest) - classes.of(a) in (0, 1)
            # the most shingles a linked pair of these sizes can differ in
            for b in (a, largest):
                overlap = -(-percent * (a + b) // (100 + percent))
                differ = a + b - 2 * overlap
                if overlap <= a and differ > 0:
                    assert classes.segments(classes.of(a)) > differ + classes.spare(classes.of(a))


def test_bounds_keep_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = []
    for _ in range(90):
        s = base[rng.random(300) > rng.choice([0.0, 0.02, 0.3])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])))
    tree = jj.Tree(sets)
    passed = {(int(a), int(b)) for x, y, _ in jj._candidates(tree, 90) for a, b in zip(x, y)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            s, t = tree.sets[a], tree.sets[b]
            n = len(np.intersect1d(s, t))
            if 100 * n >= 90 * (len(s) + len(t) - n):
                assert (a, b) in passed
    assert len(passed) < 90 * 89 / 2


def phrases(n, pool, seed=3):
    """Texts of eight phrases each from a pool: many share a phrase, next to none link."""
    rng = random.Random(seed)
    names = [prose(7000 + i, 15, 4000) for i in range(pool)]
    return [(i, " ".join(rng.choice(names) for _ in range(8)), "en", "a", 1) for i in range(n)]


def _counted(spark, monkeypatch, rows, block):
    """Verified pairs, and copies of bitmaps and of sets that trees and verifications take."""
    seen = {"pairs": 0, "bitmaps": 0}
    verified, candidates = jj._verified, jj._candidate_pairs
    monkeypatch.setattr(jj, "_verified", lambda pairs, *a: seen.update(pairs=seen["pairs"] + pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(jj, "_candidate_pairs", lambda placed, *a: seen.update(bitmaps=seen["bitmaps"] + placed.count()) or candidates(placed, *a))
    found = {r.doc_id: r.component_id for r in jj.linked(frame(spark, rows), 5, 80, block).collect()}
    return seen, found


def test_shared_phrases_cost_in_proportion(spark, monkeypatch):
    """Twice the texts from twice the phrases: one cluster of most of them, and the work about doubles."""
    few, _ = _counted(spark, monkeypatch, phrases(1500, 500), 64)
    monkeypatch.undo()
    rows = phrases(3000, 1000)
    many, found = _counted(spark, monkeypatch, rows + family(1, 120, 30, (1, 2, 3), 10_000), 64)
    assert few["pairs"] > 0
    for what in few:
        assert many[what] < 3 * few[what] + 2000, (few, many)
    # a set is verified against few others, and its bitmap is copied a few times, far below one copy per block
    assert many["pairs"] < 8 * len(rows) and many["bitmaps"] < 16 * len(rows)
    want = brute(rows + family(1, 120, 30, (1, 2, 3), 10_000), 5, 80)
    assert found == {i: c for i, (_, c) in want.items()}


def test_large_clusters_of_near_copies(spark):
    """Copies of one text that link with it but hardly with each other, and a chain, cut into blocks of a few sets."""
    rng, base = random.Random(8), prose(1, 200, 2000).split()
    rows = [(500, " ".join(base), "en", "a", 1)]
    for i in range(120):
        text = list(base)
        for _ in range(4):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "a", 1))
    text = prose(2, 150, 2000).split()
    for i in range(40):
        text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(text), "en", "a", 1))
    want = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    for block in (6, 50):
        assert {r.doc_id: r.component_id for r in jj.linked(frame(spark, rows), 5, 80, block).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_bounded_pairs_leave_no_link_out(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(int(rng.integers(2, 150))):
        if sets and rng.random() < 0.6:
            old = sets[rng.integers(len(sets))]
            keep = old[rng.random(len(old)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, int(rng.integers(0, 5)))])))
        else:
            sets.append(np.unique(rng.choice(pool, int(rng.integers(1, 200)))))
    maps = jj._folded([jj._bitmap(s) for s in sets])
    size, of = np.array([len(s) for s in sets]), rng.integers(0, 3, len(sets))
    half = len(sets) // 2
    for left, right in ((np.arange(len(sets)), None), (np.arange(half + 1), np.arange(half + 1, len(sets)))):
        one = jj.Bounds(maps[left], size[left], of[left])
        x, y = jj._bounded_pairs(one, one if right is None else jj.Bounds(maps[right], size[right], of[right]), 80)
        found = {tuple(sorted((int(left[a]), int((left if right is None else right)[b])))) for a, b in zip(x, y)}
        for a in left:
            for b in (left if right is None else right):
                if a < b and of[a] != of[b]:
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        assert (a, b) in found


def test_bitmaps_of_sorted_trees_prune_above_the_leaves():
    """Groups of near copies of equal size: most pairs of nodes of different groups go by their bitmaps."""
    rng = np.random.default_rng(1)
    bases = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(40)]
    sets = [np.unique(np.where(rng.random(100) < 0.02, rng.integers(0, 1 << 63, 100, dtype=np.uint64), b)) for b in bases for _ in range(32)]
    of = np.repeat(np.arange(40), 32)
    shuffled = rng.permutation(len(sets))
    tree = jj.Bounds(jj._folded([jj._bitmap(sets[i]) for i in shuffled]), np.array([len(sets[i]) for i in shuffled]), of[shuffled])
    seen = []
    real = jj._children
    jj._children = lambda x, y, level, *a: (seen.append((level, len(x))) or real(x, y, level, *a))
    try:
        x, _ = jj._bounded_pairs(tree, tree, 80)
    finally:
        jj._children = real
    # node pairs that reach the leaves: far fewer than all pairs of the 160 lowest nodes
    assert len(x) == 0 and dict(seen)[0] < 160 * 161 / 2 / 10


def test_verified_pairs_in_any_order(spark):
    """Rows of a hub and of its partners may come to a task in any order, and a hub's partners in several batches."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:200 - int(k)], rng.integers(0, 1 << 63, int(k), dtype=np.uint64)])) for k in rng.integers(0, 60, 80)]
    large = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "key long, shingles binary").repartition(5)
    pairs = [(int(a), int(b)) for a in range(80) for b in range(0, 80, 3) if a != b]
    found = {(r.a, r.b) for r in jj._verified(spark.createDataFrame(pairs, "hub long, key long").repartition(7), large, 80).collect()}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    assert found == {(a, b) for a, b in pairs if 100 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - both(a, b))}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_clusters_of_few_large_sets(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jj, "TASK_BYTES", 3000)
    rows = [r for r in documents() if r[0] is not None]
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jj.linked(frame(spark, rows), width, percent).collect()} == want
