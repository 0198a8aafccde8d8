"""Line quality, source mix and language-model scores against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tallyframe.llm import class_bigrams as cb, line_quality as lq, source_mix as sm
from tests.llm.cases import fold, frame, odd_rows, prose, words


def base_counts(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    exact = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if exact[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_base_counts(spark):
    line = prose(50, 12)
    rows = odd_rows() + [
        (100, "\n".join([line] * 3 + [prose(51, 30)]), "en", "a", 1), (101, f"{line}\n{line} \n{line}\n\n\n", "en", "a", 1),
        (102, "# * $ <b> é|é " * 9, "en", "a", 1), (103, f"{line} {line} x", "en", "a", 1), (104, f"{line.upper()} {line}", "en", "a", 1)]
    found = lq.report(frame(spark, rows)).collect()
    want = sorted(str((r[0], *base_counts(r[1]))) for r in rows)
    assert sorted(str(tuple(r[:7])) for r in found) == want


def test_frequent_lines_reject_depleted_documents(spark):
    notice = "All rights reserved by the makers of this page 2024 and 2025"
    rows = []
    for i in range(80):
        own = prose(1000 + i, 40)
        rows.append((i, f"{own}\n{notice.replace('2024', str(2000 + i))}", "en", "a", 1))  # digits alike
        rows.append((1000 + i, "\n".join([notice] * 3 + [prose(2000 + i, 5)]), "en", "a", 1))  # little but the notice
        rows.append((2000 + i, f"{notice} {prose(3000 + i, 30)}", "en", "b", 1))  # another host, other lines
    copy = "\n".join(prose(5000 + k, 12) for k in range(6))
    rows += [(5000 + i, copy, "en", "a", 1) for i in range(60)]  # copies of a good text are no boilerplate
    near = copy.split()
    rows += [(6000 + i, " ".join(near[:i % 60] + [f"n{i}"] + near[i % 60 + 1:]), "en", "a", 1) for i in range(60)]
    kept = {r.doc_id: r for r in lq.report(frame(spark, rows)).collect()}
    assert all(kept[i].kept and kept[i].n_words_left == kept[i].n_words - 12 for i in range(80))
    assert not any(kept[1000 + i].kept for i in range(80))
    assert all(kept[i].kept for i in (*range(2000, 2080), *range(5000, 5060), *range(6000, 6060)))
    docs = frame(spark, rows, clashes=True)
    assert {r.doc_id for r in lq.kept_documents(docs).collect()} == {i for i, r in kept.items() if r.kept}


def targets(sizes):
    """Shares by weight; what is above twice a size is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = [s for s in order if s not in full]
        share = (left - sum(2 * sizes[s] for s in full)) / max(sum(weight[s] for s in rest), 1)
        target = {s: 2.0 * sizes[s] if s in full else share * weight[s] for s in order}
        above = [s for s in rest if target[s] > 2 * sizes[s] * (1 + 1e-12)]
        if not above:
            return target
        full.update(above)


def test_mix(spark):
    rows = odd_rows() + [(1000 + i, prose(i, 5 + i % 90), "en", f"s{i % 7 if i % 3 else 0}", 1) for i in range(900)]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    found = sm.taken(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in found:
        source = by_id[r.doc_id][3] if r.doc_id != 5 else None
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - want[s]) < 0.15 * max(want[s], 1)
    docs = frame(spark, rows, clashes=True)
    mixed = Counter(r.doc_id for r in sm.mix(docs).collect())
    copies = Counter()
    for r in found:
        copies[r.doc_id] += r.taken // r.size if r.size else 0
    assert all(mixed[i] == n for i, n in copies.items() if by_id[i][1] and words(by_id[i][1]))
    assert sorted(map(str, found)) == sorted(map(str, sm.taken(frame(spark, rows[::-1])).collect()))


def test_language_model(spark):
    # half of the words follow the other half, which classes can learn and counts of words cannot
    rng = np.random.default_rng(4)
    names = prose(1, 4000, 4000).split()
    first, second = [f"a{w}" for w in names[:60]], [f"b{w}" for w in names[60:120]]
    rows = [(i, " ".join(f"{rng.choice(first)} {rng.choice(second)}" for _ in range(rng.integers(20, 60))), "en", "a", 1) for i in range(10_000, 10_300)]
    rows += odd_rows()
    found = cb.scores(frame(spark, rows), classes=4).collect()
    tokens = [(r[0], [*words(fold(r[1])), None]) for r in rows]
    train = [t for i, t in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t), sum(counts[w] > 0 for w in t)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in found) == want
    base = {i: sum(math.log10((counts[w] + .1) / (total + .1 * (distinct + 1))) for w in t) for i, t in tokens}
    for r in found:
        assert r.train_tokens == total and math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id >= 10_000]
    # a bigram over classes gains about one bit a token here
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 10 and gain > 0.2


def _lettered(seed, n, first=0):
    """Texts in which words of one kind follow words of another, and rare words of neither."""
    rng = np.random.default_rng(seed)
    names = prose(1, 4000, 4000).split()
    kinds = [[f"{k}{w}" for w in names[40 * i:40 * i + 40]] for i, k in enumerate("abc")]
    rows = []
    for i in range(first, first + n):
        text = [w for _ in range(rng.integers(5, 30)) for k in kinds for w in [rng.choice(k)]]
        text += [f"rare{rng.integers(400)}" for _ in range(3)]
        rows.append((i, " ".join(text), "en", "a", 1))
    return rows


def _hashes(names):
    from tallyframe.llm.text_arrays import chunks, words_of
    import pyarrow as pa

    out = words_of(next(chunks(pa.array([" ".join(names)]))))
    return dict(zip(names, out.hash.view(np.int64).tolist()))


def test_scores_by_hand(spark, monkeypatch):
    """Transitions and emissions from the words' classes, in plain Python; several runs, hash groups and tasks."""
    monkeypatch.setattr(cb, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(cb, "GROUP_WORDS", 200)
    monkeypatch.setattr(cb.token_runs, "__defaults__", (900,))
    rows = _lettered(5, 250, 10_000) + odd_rows()
    model = cb.train(frame(spark, rows), min_count=12, classes=3)
    found = {}
    for r in cb.scored(model).collect():
        found.setdefault(r.doc_id, r.score)
    tokens = [(r[0], words(fold(r[1]))) for r in rows]
    train = [t for i, t in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    told = {r["word"]: r for r in cb.word_classes(model).collect()}
    names = _hashes([w for w, n in counts.items() if n >= 12])
    assert {names[w] for w in names} == set(told) and all(told[names[w]]["n"] == counts[w] for w in names)
    bands = int(math.log2(11)) + 1
    of = lambda w: told[names[w]]["class"] if w in names else 3 + max(0, int(math.log2(max(counts[w], 1))))
    end = 3 + bands
    steps, mass, kinds = Counter(), Counter(), Counter(of(w) for w in counts)
    for t in train:
        line = [end, *[of(w) for w in t], end]
        steps.update(zip(line[:-1], line[1:]))
    for (_, c), n in steps.items():
        mass[c] += n
    out = Counter()
    for (a, _), n in steps.items():
        out[a] += n
    for i, t in tokens:
        line, want = [end, *[of(w) for w in t], end], 0.0
        for a, c, w in zip(line[:-1], line[1:], [*t, None]):
            want += math.log10((steps[a, c] + .1) / (out[a] + .1 * (end + 1)))
            if w is not None:
                want += math.log10((counts[w] + .1) / (mass[c] + .1 * (kinds[c] + 1)))
        assert math.isclose(found[i], want, rel_tol=1e-9, abs_tol=1e-9), i
    assert list(model.steps) == sorted(model.steps) and len(model.steps) > 1
    # the last pass of either half gained nothing, and the classes are the kinds of words
    groups = {k: Counter(told[names[w]]["class"] for w in names if w[0] == k and len(w) > 1 and not w.startswith("rare")) for k in "abc"}
    assert sum(max(g.values()) for g in groups.values()) > 0.9 * sum(sum(g.values()) for g in groups.values())


def test_words_are_counted_for_moves_that_stay(spark, monkeypatch):
    """The two passes that end the training count class bigrams only, and these are those of the word counts."""
    calls, counted, bigrams = [], cb.Exchange.counted, cb.Exchange.bigrams

    def count(self, state):
        calls.append("words")
        counts, table = counted(self, state)
        assert (table == bigrams(self, state)).all()
        return counts, table

    def look(self, state):
        calls.append("classes")
        return bigrams(self, state)

    monkeypatch.setattr(cb.Exchange, "counted", count)
    monkeypatch.setattr(cb.Exchange, "bigrams", look)
    model = cb.train(frame(spark, _lettered(5, 120) + odd_rows()), min_count=12, classes=3)
    assert calls[-2:] == ["classes", "classes"]
    # the first state, what stayed, and the moves of all words that did not
    assert calls.count("words") == len(model.steps) + 1


def test_packed_hashes():
    top = 2 ** 64 - 1
    for values in ([], [0], [top], [0, 5, 1 << 40, top - 1, top]):
        got = cb._from_rising(cb._rising(np.array(values, dtype=np.uint64)))
        assert got.dtype == np.uint64 and got.tolist() == values


def test_small_numbers_travel_as_single_bytes():
    """Counts and steps of a pass are below 256 but for a few; each took four bytes."""
    small = np.array([0, 1, 255] * 50)
    assert len(cb._planes(small)) <= len(small) + 1
    for values in ([], [0], [255], [256, 3], [1 << 16, 0], [2 ** 32 - 1, 7]):
        assert cb._from_planes(cb._planes(np.array(values, dtype=np.int64))).tolist() == values


def test_transitions_and_emissions_sum_to_one(spark):
    model = cb.train(frame(spark, _lettered(6, 120)), min_count=10, classes=4)
    t, width = model.totals, len(model.table)
    step = (model.table + cb.SMOOTH) / (model.table.sum(axis=1, keepdims=True) + cb.SMOOTH * width)
    assert np.allclose(step.sum(axis=1), 1)
    told = cb.word_classes(model).collect()
    kinds = np.concatenate([model.kinds, t.band_words])
    for c in range(width - 1):
        n = [r["n"] for r in told if r["class"] == c]
        known = sum(n) if c < 4 else int(t.band_tokens[c - 4])
        assert known == model.table.sum(axis=0)[c] and (c >= 4 or len(n) == kinds[c])
        total = model.table.sum(axis=0)[c] + cb.SMOOTH * (kinds[c] + 1)
        # the words of the class, and one for all that were never seen
        assert math.isclose((known + cb.SMOOTH * kinds[c] + cb.SMOOTH) / total, 1)
    assert t.tokens == int(model.table.sum()) and t.distinct == int(kinds.sum()) + 1


def test_clustered_words_grow_with_the_corpus(spark):
    few, many = (cb.word_classes(cb.train(frame(spark, _zipf(n)), classes=4)).count() for n in (60, 600))
    assert many > 4 * few > 0


def _zipf(n):
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 5001)
    names = [f"w{i}" for i in range(5000)]
    return [(i, " ".join(rng.choice(names, 200, p=share / share.sum())), "en", "a", 1) for i in range(n)]


def test_bands():
    assert cb.band(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 0, 1, 1, 2, 2, 3]
