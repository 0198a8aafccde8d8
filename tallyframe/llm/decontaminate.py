"""Benchmark passages in documents: a prefix-filtered containment join.

A benchmark item gives windows of ten consecutive words (one shorter window if it has fewer). A document
contains a window only if it contains the window's rarest word, so that word is the window's necessary prefix:

1. Words of the benchmark are counted over all documents (in how many each occurs), which orders them by rarity.
2. Every window is filed under its rarest word, with that word's position in the window.
3. Documents are scanned for filed words. A hit at position p of a window whose word stands at position o
   places the window at p - o; placements before the text's first word or beyond its last are dropped
   (positional and length bounds), and the others are verified word by word over the whole window.

The benchmark is taken in blocks of bounded words, one after another: a block's result is staged before the next is
fetched, so that driver and tasks hold one block of ``BLOCK_WORDS``; more blocks mean more passes over the documents,
never more memory. Windows of several items are verified once. Documents are never shuffled: each scan returns counts
for its rows, and only if there are several blocks are those put together per row. :func:`clean_documents` drops rows
in the scan itself.

Missing or empty texts have no words and no hits; an item without words has no window, and one without id has the
empty id; repeated items with the same id count once; repeated documents get a row each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.tables import map_texts
from tallyframe.llm.text_arrays import LETTER_OR_DIGIT, Texts, Words, chunks, mix, sums_by, words_of
from tallyframe.session import stage

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Placements verified at a time.
_VERIFY = 1 << 18
_TABLE = 20


class Windows:
    """The windows of one block, filed under their rarest words."""

    def __init__(self, items: list[str], texts: list[str], rarity: dict[int, int] | None = None):
        found = list(chunks(pa.array(texts, pa.string()), limit=1 << 60)) if texts else []
        empty = Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0)
        words = words_of(found[0] if found else empty, LETTER_OR_DIGIT)
        self.items, self.hash = items, words.hash
        size = np.diff(words.bounds)
        starts = [np.arange(words.bounds[i], words.bounds[i] + max(1, n - WINDOW + 1)) for i, n in enumerate(size) if n]
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        item = words.doc[start] if len(start) else start
        length = np.minimum(size[item], WINDOW) if len(start) else start
        # equal windows of several items, or of one, are one window
        padded, name = np.append(words.hash, np.zeros(WINDOW, np.uint64)), length.astype(np.uint64)
        for k in range(WINDOW):
            name = mix(name + np.where(k < length, padded[start + k], np.uint64(0)) * np.uint64(2 * k + 3))
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        self.start, self.size = start[first], length[first]
        have = np.unique(which * np.int64(max(len(items), 1)) + item)
        self.items_of = have % max(len(items), 1)
        self.bounds = np.searchsorted(have // max(len(items), 1), np.arange(len(first) + 1))
        self.vocabulary = np.unique(words.hash)
        if rarity is not None:
            self._file(np.array([rarity.get(int(h), 0) for h in self.vocabulary], dtype=np.int64))

    def _file(self, documents: np.ndarray) -> None:
        rank = documents[np.searchsorted(self.vocabulary, self.hash)] if len(self.hash) else documents
        padded = np.append(rank, np.full(WINDOW, np.iinfo(np.int64).max))
        rows = padded[self.start[:, None] + np.arange(WINDOW)] if len(self.start) else np.zeros((0, WINDOW), np.int64)
        rows[np.arange(WINDOW) >= self.size[:, None]] = np.iinfo(np.int64).max
        self.offset = rows.argmin(axis=1) if len(rows) else self.start
        key = self.hash[self.start + self.offset] if len(self.start) else self.hash
        order = np.argsort(key, kind="stable")
        self.order, self.key = order, key[order]
        self.prefix, self.first = np.unique(self.key, return_index=True)
        self.last = np.append(self.first[1:], len(self.key))
        self.table = _table(self.prefix)


def _table(keys: np.ndarray) -> np.ndarray:
    """A fixed-size table that tells most hashes not among ``keys`` apart in one look."""
    table = np.zeros(1 << _TABLE, dtype=bool)
    table[keys >> np.uint64(64 - _TABLE)] = True
    return table


def _among(h: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that are among the sorted ``keys``, and where in ``keys`` they are."""
    at = np.flatnonzero(table[h >> np.uint64(64 - _TABLE)])
    if not len(at) or not len(keys):
        return at[:0], at[:0]
    place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    hit = keys[place] == h[at]
    return at[hit], place[hit]


def occurrences(words: Words, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (first word in the chunk, window) pairs, a bounded number at a time."""
    at, key = _among(words.hash, windows.prefix, windows.table)
    if not len(at):
        return
    many = windows.last[key] - windows.first[key]
    ends = np.cumsum(many)
    padded = np.append(windows.hash, np.zeros(WINDOW, np.uint64))
    text = np.append(words.hash, np.zeros(WINDOW, np.uint64))
    i = 0
    while i < len(at):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + _VERIFY, side="right")))
        n = many[i:j]
        position = np.repeat(at[i:j], n)
        filed = np.repeat(windows.first[key[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = windows.order[filed]
        begin = position - windows.offset[window]
        doc = words.doc[position]
        fits = (begin >= words.bounds[doc]) & (begin + windows.size[window] <= words.bounds[doc + 1])
        begin, window = begin[fits], window[fits]
        for k in range(WINDOW):
            same = (text[begin + k] == padded[windows.start[window] + k]) | (k >= windows.size[window])
            begin, window = begin[same], window[same]
        yield begin, window
        i = j


def _match(words: Words, texts: Texts, windows: Windows):
    """Which words are hit, and the (text, item) pairs found."""
    covered = np.zeros(len(words.hash) + 1, dtype=np.int64)
    pairs = [np.zeros(0, np.int64)]
    for begin, window in occurrences(words, windows):
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + windows.size[window], -1)
        found = np.unique(words.doc[begin] * len(windows.start) + window)
        doc, window = found // max(len(windows.start), 1), found % max(len(windows.start), 1)
        many = windows.bounds[window + 1] - windows.bounds[window]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(windows.bounds[window], many)
        pairs.append(np.unique(np.repeat(doc, many) * len(windows.items) + windows.items_of[at]))
    hit = np.cumsum(covered[:-1]) > 0
    return hit, np.unique(np.concatenate(pairs))


def _spans(hit: np.ndarray, words: Words) -> list[list[int]]:
    """Per text the hit runs as begin, end, begin, end …, counted in words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[int]] = [[] for _ in range(len(words.bounds) - 1)]
    for b, e in zip(begin.tolist(), end.tolist()):
        while b < e:  # a run may go on in the next text
            d = int(words.doc[b])
            stop = min(e, int(words.bounds[d + 1]))
            out[d] += [b - int(words.bounds[d]), stop - int(words.bounds[d])]
            b = stop
    return out


_SCHEMA = "row_key long, doc_id long, n_words long, spans array<int>, items array<string>"


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    def one(rows: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        words = words_of(texts, LETTER_OR_DIGIT)
        hit, pairs = _match(words, texts, windows)
        items: list[list[str]] = [[] for _ in range(len(texts))]
        for p in pairs.tolist():
            items[p // len(windows.items)].append(windows.items[p % len(windows.items)])
        return {"row_key": rows.column("row_key"), "doc_id": rows.column("doc_id"),
                "n_words": pa.array(np.diff(words.bounds), pa.int64()),
                "spans": pa.array(_spans(hit, words), pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.string()))}

    return map_texts(docs, _SCHEMA, one)


def _rarity(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """In how many documents each word of a block occurs; the answer is no larger than the block."""
    table = _table(vocabulary)

    def one(rows: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        words = words_of(texts, LETTER_OR_DIGIT)
        at, place = _among(words.hash, vocabulary, table)
        once = np.unique(words.doc[at] * len(vocabulary) + place) % max(len(vocabulary), 1)
        word, n = np.unique(once, return_counts=True)
        return {"word": pa.array(word, pa.int64()), "n": pa.array(n, pa.int64())}

    counts = map_texts(docs, "word long, n long", one).groupBy("word").agg(F.sum("n").alias("n"))
    return {int(vocabulary[r["word"]]): r["n"] for r in counts.toLocalIterator()}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """How many blocks there are, and each one's items, of about ``block_words`` words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(
        F.col("text").isNotNull()).distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = -(-int(words) // block_words)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for b in range(n):
        rows = items.filter(block == b).collect()
        yield n, [r["item_id"] for r in rows], [r["text"] for r in rows]


def _filed(rows: DataFrame, items: list[str], texts: list[str]) -> Windows:
    return Windows(items, texts, _rarity(rows, Windows(items, texts).vocabulary))


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``row_key, doc_id, n_words, spans`` (hit runs of words) and ``items`` found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    scans = []
    for n, items, texts in _blocks(benchmark, block_words):
        scan = _scan(rows, _filed(rows, items, texts))
        if n == 1:
            return scan
        scans.append(stage(scan))
    if not scans:
        return _scan(rows, Windows([], [], {}))
    # several blocks: the first gives every row, the others the rows they hit; repeated rows come back as often
    parts = scans[0].withColumn("n", F.lit(1))
    for scan in scans[1:]:
        parts = parts.unionByName(scan.filter(F.size("items") > 0).withColumn("n", F.lit(0)))
    whole = parts.groupBy("row_key", "doc_id", "n_words").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.sum("n").cast("int").alias("n"))
    return whole.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _covered(spans: pa.Array) -> pa.Array:
    """Words covered by begin, end pairs in any order."""
    total = []
    for s in spans.to_pylist():
        n, reach = 0, 0
        for b, e in sorted(zip(s[::2], s[1::2])):
            n += max(0, e - max(b, reach))
            reach = max(reach, e)
        total.append(n)
    return pa.array(total, pa.int64())


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    found = contamination(docs, benchmark, block_words)

    def count(batches):
        for b in batches:
            names = [sorted(set(x)) for x in b.column("items").to_pylist()]
            hit = _covered(b.column("spans"))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("n_words"), hit, pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array([x > 0 for x in hit.to_pylist()], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                                   "contaminated boolean")


def _without(docs: DataFrame, windows: Windows) -> DataFrame:
    """The rows of ``docs`` without a window of one block, filtered where they are read."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [np.zeros(0, dtype=bool)]
            for texts in chunks(batch.column("text")):
                words = words_of(texts, LETTER_OR_DIGIT)
                hit, _ = _match(words, texts, windows)
                clean.append(sums_by(hit.astype(np.int64), words.bounds) == 0)
            yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns. Repeated rows stay or go together, rows
    without a text stay. What several blocks leave over is staged from block to block."""
    left = docs
    for n, items, texts in _blocks(benchmark, block_words):
        clean = _without(left, _filed(docs.select("doc_id", "text"), items, texts))
        left = clean if n == 1 else stage(clean)
    return left


REPORT_SQL = r"""
with words as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select distinct item_id::varchar as item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
places as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select r, n, w, unnest(range(1, len(w) - n + 2)) as i
        from words, (select distinct n from windows) as sizes where len(w) >= n)),
hits as (select p.r, p.i, p.n, v.item_id from places p join windows v on v.n = p.n and v.g = p.g),
hit_words as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hits) group by r),
hit_items as (
  select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct r, item_id from hits) group by r)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words using (r) left join hit_items using (r)
"""
