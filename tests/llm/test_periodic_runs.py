"""Periodic runs against plain Python that compares words at every distance."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallyframe.llm import periodic_runs as pr
from tests.llm.cases import frame, odd_rows, prose, words


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and smallest_period(w[i:j + q]) == q:
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def generated(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 50])
    if rng.random() < 0.3:
        return [rng.randrange(letters) for _ in range(rng.randrange(150))]
    w = []
    for _ in range(rng.randrange(1, 5)):
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.5:
            base += [rng.randrange(letters) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 12)
        w += base * rng.randrange(1, 6) + base[:rng.randrange(len(base))]
        if rng.random() < 0.5:
            w += [rng.randrange(letters) for _ in range(rng.randrange(20))]
    return w[:400]


def found_runs(texts):
    ids = np.array([x + 1 for w in texts for x in w], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    runs = pr.runs_of(ids, bounds)
    return [list(zip((runs.start[s] - bounds[d]).tolist(), runs.length[s].tolist(), runs.period[s].tolist()))
            for d in range(len(texts)) for s in [slice(runs.bounds[d], runs.bounds[d + 1])]]


@pytest.mark.parametrize("seed", range(40))
def test_generated_words(seed):
    rng = random.Random(seed)
    texts = [generated(rng) for _ in range(12)]
    assert found_runs(texts) == [plain_runs(w) for w in texts]


def test_structured_words():
    fibonacci, morse = [[0], [0, 1]], [0]
    for _ in range(9):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
        morse = morse + [1 - x for x in morse]
    texts = [fibonacci[-1], morse, [0] * 23, [0] * 24, list(range(8)) * 3, (list(range(8)) * 3)[:-1], [], [1],
             ([0] * 40 + [1]) * 5, [0] * 30 + [1] * 30, list(range(100)) * 3 + [5] * 24]
    assert found_runs(texts) == [plain_runs(w) for w in texts]


def test_long_periods_are_compressed():
    rng = random.Random(3)
    base = [rng.randrange(400) for _ in range(9_000)]
    w = base * 4 + base[:17]
    assert found_runs([w]) == [[(0, len(w), 9_000)]]
    ids = np.array(w, dtype=np.uint64)
    text = pr._repeating(ids, np.array([0, len(w)]))
    cuts = pr._repair(text)
    # boundaries are looked at once per nonterminal: those of one period's grammar, not one per word of the text
    assert len(cuts.at) < len(base)


def test_deep_repetition_needs_few_boundaries():
    w = [0] * 50_000
    assert found_runs([w]) == [[(0, 50_000, 1)]]
    text = pr._repeating(np.array(w, dtype=np.uint64), np.array([0, len(w)]))
    assert len(pr._repair(text).at) < 60


def expected(doc_id, text):
    w, h = words(text), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if n < 5_000 else [(0, n, 1)]
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def rows_for_runs():
    line, rows = prose(70, 11), odd_rows()
    rows += [(100 + i, " ".join([prose(80 + i, 30), *[line] * (i % 7), prose(90 + i, 25)]), "en", "a", 1) for i in range(60)]
    rows += [(200 + i, prose(300 + i, 20 * (i + 1)), "en", "a", 1) for i in range(60)]
    return rows + [(300, (line + "\n") * 5 + prose(5, 30) + " ha" * 24, "en", "a", 1)]


def test_digests(spark):
    rows = rows_for_runs()
    found = pr.report(frame(spark, rows, clashes=True)).collect()
    assert sum(r.n_runs for r in found) > 30
    assert sorted(str(tuple(r)) for r in found) == sorted(str(expected(r[0], r[1])) for r in rows)


def test_collapse_keeps_rows_and_texts(spark):
    docs = frame(spark, rows_for_runs(), clashes=True)
    out = pr.collapse(docs)
    assert out.select("row.*").columns == docs.columns
    for r in out.collect():
        w = words(r.row.text)
        runs = plain_runs(w) if len(w) < 5_000 else [(0, len(w), 1)]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert pr.collapse(docs.limit(0)).collect() == []
