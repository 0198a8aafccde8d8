"""Personal data, benchmark windows, toxicity and trees against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyframe.llm import boosted_trees as bt, decontaminate as dc, personal_data as pd, toxicity as tx
from tests.llm.cases import fold, frame, odd_rows, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


TEXTS = ["a@b.cd@e.f x@y a.b+c@d-e.f.g", "a@b.c_d@e.fg", "..@x.y %@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "1.2.3 4.5.6.7",
         "4111 1111 1111 1111 and 4111-1111-1111-1112", "41111111111111111111111", "+1 (262) 555-3752, +49 30 123456 7", "+1 2 +12345678901234567",
         "é🙂 mail hans@example.org 🙂 +33 1 23 45 67 89", "1" * 3000, "a." * 2000 + "@b.c", "a@b" + ".c" * 4000, "SSN 123-45-6789, call 262-555-3752",
         "Dr. Maria Weber, name: Mr John Smith", "john (at) example (dot) com", "5500 0055 5555 5559 5500005555555559"]


def test_agreed_spans(spark):
    rows = [(100 + i, t, "en", "a", 1) for i, t in enumerate(TEXTS)] + odd_rows()
    found = pd.report(frame(spark, rows)).collect()
    want = []
    for i, text, *_ in rows:
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *[sum(k == x for x, *_ in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:6]) for r in found) == sorted(want)
    for r in found:  # agreed spans stay, and come in order
        kinds = [s.split(":")[0] for s in r.spans.split(",")] if r.spans else []
        assert sum(k in PATTERNS for k in kinds) == r.n_email + r.n_ip + r.n_card + r.n_phone
        assert kinds == sorted(kinds, key=pd.KINDS.index)
    plan = pd.report(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_votes_are_weighed(spark):
    """Announced numbers of a looser kind are found, denied ones are not, whatever single labelers say."""
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 899)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = []
    for i in range(200):
        rows.append((i, f"{prose(i, 8)} phone: {number()} {prose(i + 1, 4)} mail: u{i}@example.com", "en", "a", 1))
        rows.append((1000 + i, f"{prose(i, 8)} order 100-100-{1000 + i % 9}x {prose(i + 2, 4)}", "en", "a", 1))
    found = {r.doc_id: r.spans for r in pd.report(frame(spark, rows)).collect()}
    assert np.mean(["local_phone" in found[i] for i in range(200)]) > 0.95
    assert np.mean(["local_phone" in found[1000 + i] for i in range(200)]) < 0.05


def brute_windows(rows, items):
    out = []
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, text in items:
        w = re.findall(pattern, fold(text))
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for i, text, *_ in rows:
        w, hit, found = re.findall(pattern, fold(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        joined = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(found), joined, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_benchmark_windows(spark, block):
    items = [(i, prose(700 + i, 30)) for i in range(12)] + [(50, "of the"), (51, "a,B.c"), (52, ""), (53, None), (54, prose(700, 30)), (50, "one two")]
    rng, rows = random.Random(1), [r for r in odd_rows() if r[0] != 8]
    for k in range(60):
        text = prose(800 + k, 40)
        item = items[k % 12][1].split()
        if k % 3 == 0:
            a = rng.randint(0, 18)
            text = f"{text} {'; '.join(x.upper() for x in item[a:a + rng.randint(8, 14)])} {text[:20]}"
        if k % 7 == 0:
            text += " of, the a b C "
        rows.append((1000 + k, text, "en", "a", 1))
    found = dc.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == brute_windows(rows, [x for x in items if x[1]])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_edit_distance_does():
    rng = random.Random(8)
    terms, stems = {"idiot": 2.0, "moron": 3.0, "scum": 1.0, "worthless": 4.0}, {"lowei": 1.5}
    automaton = tx.automaton(terms, stems)
    letters = "idotmrnscuwheslx1é"
    tried = [*terms, "loweixyz", "lowe", "idiiot", "idot", "scam", "scumm", "id1ot", "moronn", "wortless", "wothless", "xidiot"]
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k, how = rng.randrange(len(w) + 1), rng.randrange(3)
                w[k:k + (how > 0)] = [] if how == 2 else [rng.choice(letters)]
            tried.append("".join(w) or "x")
    for w in tried:
        data = np.frombuffer(w.encode(), dtype=np.uint8)
        state = automaton.match(data, np.array([0]), np.array([len(data)]))[0]
        exact = w in terms or w.startswith("lowei")
        fuzzy = any(len(t) >= 5 and edits(w, t) <= 1 for t in terms)
        assert automaton.accepts[state] == (2 if exact else 1 if fuzzy else 0), w


def _toxic_documents(n=900):
    rng, bad = random.Random(3), ["zorgface", "blargwit", "snotling", "grubbler"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(i, 40).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _toxic_documents()
    calm = " ".join(prose(7001, 30).split())
    more = [(5000, f"{calm} you blargwi and zorgfacee {calm}", "en", "a", 1), (5001, f'{calm} he said the word "grubbler" was used {calm}', "en", "a", 1),
            (5002, f"{calm} you grubbler you {calm}", "en", "a", 1), (5003, calm, "en", "a", 1), (5004, "", "en", "a", 1)]
    found = {r.doc_id: r for r in tx.toxicity_scores(frame(spark, rows + more),
             spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, t in labels if found[i].held_out]
    right = [found[i].predicted == (i % 4 == 0) for i in held]
    assert len(held) > 200 and np.mean(right) > 0.97
    assert found[5000].score > 0.5 and found[5000].score > found[5003].score
    assert found[5001].score < found[5002].score and found[5003].predicted == found[5004].predicted == 0


@pytest.mark.parametrize("scale", [0.5, 3.0, 40.0])
def test_logit_finds_the_maximum(scale):
    """Also far from the prior, and where classes are separated."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(2000, len(tx.SIGNS)))) * scale * (rng.random((2000, 1)) < 0.2)
    y = (x[:, 0] > 0.1 * scale).astype(float)
    w = tx.fit_logit(x, y)
    z = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (y - p) - (w - tx.PRIOR)).max() < 1e-3
    assert ((p > 0.5) == (y > 0)).mean() > 0.97


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = bt.fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9 and p.min() >= 0 and p.max() <= 1
    # the vectorised walk equals one row at a time
    for row, score in zip(x[2000:2020], p):
        total = trees.base
        for f, t, leaf in zip(trees.statistic, trees.threshold, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert np.isclose(1 / (1 + np.exp(-total)), score)
    assert np.allclose(bt.fit(x, np.ones(3000)).score(x), 3001 / 3002)


def test_quality_scores(spark):
    rows, labels = [], []
    for i in range(600):
        junk = i % 5 == 0
        text = " ".join(f"{w}{random.Random(i).choice(['###', '$$$'])}" for w in prose(i, 30).split()) if junk else prose(i, 60)
        rows.append((i, text, "en", "a", 1))
        labels.append((i, int(not junk), 0))
    found = bt.quality_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == (r.doc_id % 5 > 0) for r in held]) > 0.97


def test_equal_windows_of_many_items_are_one():
    text = prose(5, 14)
    items = [str(i) for i in range(50)]
    windows = dc.Windows(items, [text] * 50, {})
    assert len(windows.start) == 5 and len(windows.items_of) == 250
    again = dc.Windows(["a", "b"], ["x " * 12, "x x"], {})
    # three equal windows of one item, and a shorter one of another
    assert sorted(again.size.tolist()) == [2, 10] and len(again.items_of) == 2


def test_clean_documents_of_one_and_of_several_blocks(spark, monkeypatch):
    items = [(i, prose(600 + i, 13)) for i in range(12)] + [(1, prose(600, 13)), (90, None), (91, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_rows() + [(100 + i, f"{prose(i, 30)} {items[i % 12][1] if i % 3 == 0 else 'none'} {prose(i + 50, 9)}", "en", "a", 1) for i in range(40)]
    docs = frame(spark, rows, clashes=True).selectExpr("*", "doc_id as __hit_key")
    want = sorted(str(r[0]) for r in rows if not (r[0] is not None and r[0] >= 100 and (r[0] - 100) % 3 == 0))
    held = []
    real = dc._filed
    monkeypatch.setattr(dc, "_filed", lambda *a: held.append(real(*a)) or held[-1])
    for block in (dc.BLOCK_WORDS, 30):
        out = dc.clean_documents(docs, benchmark, block)
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(held) > 4
