"""A quality classifier: histogram gradient-boosted trees over document statistics.

Every document is reduced to a few statistics in one vectorised pass, which is all that is kept of it. The
trees are fitted on a bounded sample of labelled rows (``MAX_ROWS``, chosen by a hash of the id): statistics are
cut into quantile bins once, and each level of a tree takes one histogram of gradients per node and statistic.
Fitted trees are flattened into arrays (statistic, threshold and leaf value by place in the tree), which the
executors walk for all rows of a batch at once, one step per level.

Labels, language, source and id never enter a score. Missing and empty texts have statistics of zero and are
scored like any other; without labels the score is 0.5; with one class it is the smoothed share of that class;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.line_quality import SYMBOLS, repeated_words
from tallyframe.llm.tables import doc_remainder, hash_share, map_texts
from tallyframe.llm.text_arrays import Texts, byte_class, code_points, mix, sums_by, words_of
from tallyframe.session import stage

#: Most labelled rows a fit sees.
MAX_ROWS = 20_000
HELD_OUT = 5
THRESHOLD = 0.3

_DIGIT, _UPPER, _LETTER = byte_class((48, 57)), byte_class((65, 90)), byte_class((65, 90), (97, 122), (128, 255))
_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?,;:", dtype=np.uint8)] = True


def statistics(texts: Texts) -> np.ndarray:
    """One row of statistics per text."""
    words = words_of(texts)
    n = np.diff(words.bounds).astype(np.float64)
    size = np.maximum(np.diff(texts.offsets), 1).astype(np.float64)
    each = np.maximum(n, 1)
    points = code_points(texts)
    length = (points[words.end] - points[words.start]) if len(words.start) else np.zeros(0, np.int64)
    data = texts.data
    count = lambda table: sums_by(table[data].astype(np.int64), texts.offsets)
    lines = sums_by((data == 10).astype(np.int64), texts.offsets) + 1
    same_doc = words.doc[1:] == words.doc[:-1]
    doubled = np.zeros(len(words.hash), dtype=np.int64)
    doubled[1:] = same_doc & (words.hash[1:] == words.hash[:-1])
    key = mix(words.hash ^ mix(words.doc.astype(np.uint64)))
    _, first, copies = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(words.doc[first], minlength=len(n))
    often = np.zeros(len(n))
    np.maximum.at(often, words.doc[first], copies)
    wordy = lambda mask: sums_by(mask.astype(np.int64), words.bounds)
    return np.column_stack([
        np.log1p(n),
        sums_by(length, words.bounds) / each,
        sums_by(length ** 2, words.bounds) / each,
        count(SYMBOLS) / size,
        count(_DIGIT) / size,
        count(_LETTER) / size,
        wordy(_UPPER[data[words.start]]) / each,
        wordy(_STOP[data[words.end - 1]]) / each,
        wordy(~_LETTER[data[words.start]] & (length == 1)) / each,
        repeated_words(words) / each,
        wordy(doubled) / each,
        distinct / each,
        often / each,
        n / lines,
        np.log1p(lines),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays: row t holds tree t, node i has its children at 2i+1 and 2i+2."""

    statistic: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.statistic.shape[1] if len(self.statistic) else 0
        for f, t, leaf in zip(self.statistic, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[0:1].size and at[0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
        penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss, second-order splits on histograms."""
    inner = 2 ** depth - 1
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(none.statistic, none.threshold, none.leaf, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    wide, columns = bins, x.shape[1]
    total = np.full(len(y), base)
    out: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        statistic, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((at - first)[:, None] * columns + np.arange(columns)) * wide + binned
            shape = (width, columns, wide)
            gs = np.bincount(cell.ravel(), np.repeat(g, columns), width * columns * wide).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell.ravel(), np.repeat(h, columns), width * columns * wide).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + penalty) + (ga - gs) ** 2 / (ha - hs + penalty) - ga ** 2 / (ha + penalty)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, k = divmod(b, wide)
                if gain[i, j, k] > 1e-6 and k < len(edges[j]):
                    statistic[first + i], threshold[first + i] = j, edges[j][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), statistic[at]] > threshold[at])
        leaf_of = at - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + penalty)
        total += leaf[leaf_of]
        out.append((statistic, threshold, leaf))
    return Trees(np.array([t[0] for t in out]), np.array([t[1] for t in out]), np.array([t[2] for t in out]), base)


def labelled_sample(labels: DataFrame, label: str, remainder: int, held_out: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out part, chosen by a hash of their id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(doc_remainder(remainder) != held_out)
    return rows.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label")).orderBy(
        hash_share(F.col("labelled_id"), "sample"), "labelled_id", "label").limit(max_rows)


def _features(docs: DataFrame) -> DataFrame:
    def one(rows: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        x = statistics(texts)
        flat = pa.array(x.ravel(), pa.float32())
        return {"doc_id": rows.column("doc_id"), "x": pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, x array<float>", one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, width)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    features = stage(_features(docs))
    sample = labelled_sample(labels, "quality", HELD_OUT, 0, max_rows)
    known = features.join(sample, features["doc_id"] == sample["labelled_id"]).select("labelled_id", "label", "x").toArrow()
    known = known.sort_by([("labelled_id", "ascending"), ("label", "ascending")]).combine_chunks()
    width = statistics(Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64), 0)).shape[1]
    x = np.array(known.column("x").to_pylist(), dtype=np.float32).reshape(-1, width)
    trees = fit(x, known.column("label").to_numpy().astype(np.float64), **how)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(trees.score(matrix(b.column("x"), width)), pa.float64())],
                names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (doc_remainder(HELD_OUT) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
