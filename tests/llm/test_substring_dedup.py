import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import merged_bwt, substring_dedup as sd
from tests.llm.cases import frame, odd_rows, prose


def brute(rows):
    texts = [(sd._NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    lowest = {}
    for i, b in sorted(texts):
        for k in range(len(b) - sd.LENGTH + 1):
            lowest.setdefault(b[k:k + sd.LENGTH], i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - sd.LENGTH + 1):
            if lowest[b[k:k + sd.LENGTH]] < i:
                gone[k:k + sd.LENGTH] = b"\1" * sd.LENGTH
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(None if i == sd._NO_ID else i), len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def documents():
    rng = random.Random(5)
    passage, licence = prose(7, 40), prose(8, 90)
    rows = [r for r in odd_rows() if r[0] != 7 and r[0] != 8]
    for i in range(60):
        text = prose(100 + i, rng.randint(5, 60))
        if i % 3 == 0:
            text = f"{text[:50]} {licence} {text[50:]}"
        if i % 4 == 1:
            cut = rng.randint(0, len(passage) - 60)
            text += passage[cut:]
        if i % 10 == 2:
            text = text + "ab" * 60 + text
        rows.append((1000 - i, text, "en", "a", 1))
    return rows + [(2000 + i, prose(100, 40), "en", "a", 1) for i in range(6)] + [(3000, "x" * 49, "en", "a", 1), (3001, "x" * 120, "en", "a", 1)]


@pytest.mark.parametrize("run_bytes,shard,hot,very_hot", [
    (4 << 20, 1 << 18, 10_000, 1_000_000), (3000, 500, 10_000, 1_000_000), (3000, 500, 3, 1_000_000), (3000, 500, 2, 8), (900, 500, 0, 0)])
def test_removed(spark, monkeypatch, run_bytes, shard, hot, very_hot):
    monkeypatch.setattr(sd, "VERY_HOT", very_hot)
    monkeypatch.setattr(sd, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "GROUP_BYTES", 4000)
    monkeypatch.setattr(sd, "GROUP_ANCHORS", 200)
    rows = documents()
    found = sd.report(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == brute(rows)


def test_real_output(spark):
    rows = documents()
    left = {r.doc_id: (bytes(r.text), r.removed) for r in sd.deduplicated(frame(spark, rows)).collect()}
    for i, n, gone, runs, digest in brute(rows):
        if i not in ("None", "5"):
            text, spans = left[int(i)]
            assert hashlib.sha256(text).hexdigest() == digest
            assert len(spans) == 2 * runs and sum(spans[1::2]) - sum(spans[::2]) == gone


@pytest.mark.parametrize("shard", [50, 400, 10**6])
def test_merged_transforms_find_all_repeats(shard):
    rng = np.random.default_rng(shard)
    parts, starts, at = [], [], 0
    for k in range(40):
        s = rng.integers(1, 4 if k % 2 else 250, rng.integers(1, 60)).astype(np.uint16)
        if k % 5 == 0 and parts:
            s = np.concatenate([s[:5], parts[-1][:-1], s[:5]])
        parts.append(np.append(s, 0).astype(np.uint16))
        starts.append(at)
        at += len(parts[-1])
    text, depth = np.concatenate(parts), 12
    suffix, block = merged_bwt.repeated(text, np.array(starts), depth, shard)
    where = {}
    for i in range(len(text) - depth + 1):
        w = text[i:i + depth]
        if w.all():
            where.setdefault(w.tobytes(), []).append(i)
    want = sorted(sorted(v) for v in where.values() if len(v) > 1)
    assert sorted(sorted(suffix[block == b].tolist()) for b in np.unique(block)) == want


def test_a_passage_of_all_runs_is_no_group(spark, monkeypatch):
    """One passage in every run: its windows are rows, combined per task, and no group of stretches has a run's copy."""
    monkeypatch.setattr(sd, "RUN_BYTES", 2000)
    cut = sd.chunks
    monkeypatch.setattr(sd, "chunks", lambda column: cut(column, 2000))
    monkeypatch.setattr(sd, "HOT", 10)
    monkeypatch.setattr(sd, "VERY_HOT", 20)
    licence = prose(8, 60)
    rows = [(i, f"{prose(500 + i, 200)} {licence} {prose(900 + i, 60)}", "en", "a", 1) for i in range(80)]
    held = []
    real = sd.stretches
    monkeypatch.setattr(sd, "stretches", lambda *a: held.append(sd.stage(real(*a))) or held[-1])
    found = sd.report(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == brute(rows)
    rows_of_runs = held[0].groupBy("part").count().collect()
    runs = held[0].select("run").distinct().count()
    assert runs > 40 and {r.part for r in rows_of_runs} >= {-1}
    # what groups still hold are the few stretches at the passage's ends
    packed = sum(len(r.bytes) for r in held[0].filter("part >= 0").select("bytes").collect())
    assert packed < 80 * len(licence) / 4


def told_all(data, sizes):
    """All anchors of a run, as if other documents had them."""
    h = np.unique(sd._run_anchors(data, sizes)[-1])
    return [{"part": 0, "shared": sd._planes(h >> np.uint64(16)), "hot": bytes(len(h))}]


def test_a_run_sends_many_groups_together():
    """Runs times groups grow with the square of the corpus: a run's rows are packed together, not group by group."""
    texts = [prose(i, 400).encode() for i in range(120)]
    data, sizes = b"".join(texts), [len(t) for t in texts]
    row = {"run": 3, "doc_ids": list(range(120)), "sizes": sizes, "text": data, "told": told_all(data, sizes)}
    batches = list(sd._cut_stretches(row, 12, 0))
    assert sum(len(b) for b in batches) > 2000
    assert len(batches) < 10
    for b in batches:
        for r in b.to_pylist():
            size = list(r["sizes"])
            assert 4 * len(size) == len(r["names"]) and sum(size) == len(r["bytes"]) and r["run"] == 3
            assert sum(r["new"]) == len(size)
            at = np.concatenate([[0], np.cumsum(size)])
            starts, owner = (np.frombuffer(r[c], np.uint8).reshape(w, -1).T.copy().view(k)[:, 0] for c, w, k in (
                ("starts", 4, np.int32), ("ids", 8, np.int64)))
            for of, start, doc in zip(np.cumsum(list(r["new"])) - 1, starts, owner):
                assert data[start:start + size[of]] == r["bytes"][at[of]:at[of + 1]]
                assert sum(sizes[:doc]) <= start < sum(sizes[:doc + 1])


def test_rows_of_a_corpus_grow_in_proportion(spark, monkeypatch):
    """Three megabytes are one run, and groups of stretches stop growing in number before they outgrow a task."""
    rows = [(i, prose(i, 4000), "en", "a", 1) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        runs = sd.runs_of(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(len(r.text) for r in runs) > 3_000_000 and len(runs) == 1
    asked = []
    monkeypatch.setattr(sd, "GROUP_BYTES", 1 << 12)
    monkeypatch.setattr(sd, "GROUPS", 4, raising=False)
    real = sd.stretches
    monkeypatch.setattr(sd, "stretches", lambda runs, shared, bits, anchor_bits: asked.append(bits) or real(runs, shared, bits, anchor_bits))
    few = [(i, f"{prose(i % 40, 120)} {i}", "en", "a", 1) for i in range(120)]
    assert sorted((str(r.doc_id), *r[1:]) for r in sd.report(frame(spark, few)).collect()) == brute(few)
    assert asked == [2]


@pytest.mark.parametrize("hot,very_hot", [(10_000, 1_000_000), (3, 1_000_000), (2, 8)])
def test_removed_in_small_slices(spark, monkeypatch, hot, very_hot):
    for name, value in {"SENT": 50, "COMPARED": 200, "BATCH_BYTES": 500, "COLLECTION_BYTES": 300, "_SLICE": 90, "SHARD_BYTES": 120,
                        "HOT": hot, "VERY_HOT": very_hot}.items():
        monkeypatch.setattr(sd, name, value)
    rows = documents()
    assert sorted((str(r.doc_id), *r[1:]) for r in sd.report(frame(spark, rows)).collect()) == brute(rows)


@pytest.mark.parametrize("symbols,n", [(1, 300), (3, 5000), (40, 5000), (256, 70_000)])
def test_transform_is_in_order(symbols, n):
    """Whatever the alphabet and the size leave room for in a key."""
    rng = np.random.default_rng(n)
    text = rng.integers(1, symbols + 1, n).astype(np.uint16)
    text[::97] = 0
    text[-1] = 0
    starts = np.concatenate([[0], np.flatnonzero(text == 0)[:-1] + 1])
    order, before, first = merged_bwt.transform(text, starts, 12)
    bounds = np.append(starts, n)
    end = bounds[np.searchsorted(bounds, order, side="right")] - 1
    keys = [text[i:min(i + 12, e)].tolist() for i, e in zip(order.tolist(), end.tolist())]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
    begins = set(starts.tolist())
    assert before.tolist() == [0 if i in begins else int(text[i - 1]) for i in order.tolist()]
    assert sorted(first.tolist()) == list(range(n))
