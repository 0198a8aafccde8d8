"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words with smallest period q and at least ``max(24, 3 q)`` words that no neighbouring word
extends keeping that period.

1. Only stretches whose every word lies in a window of 16 words found again in the text are looked at. Every run
   lies wholly in one: it has 16 words and a period more, so each of its windows comes again one period on.
2. Re-Pair over the word numbers of these stretches. In each round every pair of symbols that occurs twice and
   outranks the pairs it overlaps (by the power of two of its count, then by hash) becomes a nonterminal wherever
   it was chosen, until no pair occurs twice. A nonterminal's places of that round are all places at which the
   derivation has it.
3. Runs that cross the boundary between the two halves of a nonterminal are computed once, at its first place; the
   boundaries left between the start symbols are treated like nonterminals of one place. One side of the boundary
   has half of the run, so the window next to the boundary comes again one period away: its later (right side) or
   earlier (left side) places are the candidate periods. Longest common extensions to both sides, by doubling
   window hashes, give the stretch of that period.
4. Runs are translated to all places of their nonterminal, and intervals of one period that overlap by it are
   merged. The smallest nonterminal that holds a whole run has found it whole, so merged intervals are maximal.
   Of equal intervals the smallest period counts.

Everything is numpy over chunks of texts inside tasks; there is no shuffle, and a task holds one chunk (about a
quarter of a megabyte, or one longer text) at a time. Words are told apart by 64-bit hashes.

Missing and empty texts have no words, no run and an empty collapsed text. Texts are whole, whatever their length.
A missing id counts as empty text where a rule depends on it. Runs with equal exponents are ordered by start, then
period. Repeated rows give equal results each; an empty table gives none. Other columns, whatever their names, are
not read by :func:`report`; :func:`collapse` keeps them inside ``row``.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.tables import map_texts
from tallyframe.llm.text_arrays import Texts, Words, mix, window_hashes, words_of

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words of a window that every run repeats.
WINDOW = 16
#: Doubling levels kept for common extensions; longer ones take several steps of the last.
LEVELS = 14
#: Candidate periods looked at together.
BLOCK = 1 << 19

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Stretches:
    """The words in question, one stretch after the other: index in the chunk, number of the word, and where the
    word's stretch begins and ends here."""

    at: np.ndarray
    symbol: np.ndarray
    first: np.ndarray
    last: np.ndarray


@dataclass
class Boundaries:
    """Where two halves meet, the interval they cover together, and (node, shift) of every further place."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    node: np.ndarray
    shift: np.ndarray


@dataclass
class Runs:
    """Runs of a chunk by text, start and period; starts count the words of the chunk."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray
    bounds: np.ndarray


def _repeating(ids: np.ndarray, bounds: np.ndarray) -> Stretches:
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    covered = np.zeros(len(ids) + 1, dtype=np.int32)
    windows = window_hashes(ids, WINDOW)
    if len(windows):
        at = np.flatnonzero(doc[:len(windows)] == doc[WINDOW - 1:])
        key = mix(windows[at] + doc[at].astype(np.uint64) * _C2)
        # most windows are alone in their bucket, and only the rest is sorted
        bits = max(12, int(len(at)).bit_length() + 2)
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        shared = np.bincount(bucket, minlength=1 << bits)[bucket] > 1
        at, key = at[shared], key[shared]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    at = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    if len(at):
        opens = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc[at]) != 0)])
        size = np.diff(np.append(np.flatnonzero(opens), len(at)))
        at = at[np.repeat(size >= MIN_LENGTH, size)]
        size = size[size >= MIN_LENGTH]
        edges = np.concatenate([[0], np.cumsum(size)])
        first, last = np.repeat(edges[:-1], size), np.repeat(edges[1:], size)
    else:
        first = last = at
    return Stretches(at, np.unique(ids[at], return_inverse=True)[1].astype(np.int64), first, last)


def _repair(text: Stretches) -> Boundaries:
    symbol, place = text.symbol.copy(), np.arange(len(text.symbol))
    size, made, count = np.ones(len(symbol), dtype=np.int64), int(symbol.max(initial=0)) + 1, 0
    at, low, high, node, shift = [], [], [], [], []
    while len(symbol) > 1:
        joined = text.first[place[1:]] == text.first[place[:-1]]
        pair = (symbol[:-1].astype(np.uint64) << np.uint64(32)) | symbol[1:].astype(np.uint64)
        kinds, kind, times = np.unique(pair[joined], return_inverse=True, return_counts=True)
        value = np.empty(len(kinds), dtype=np.int64)
        value[np.lexsort((mix(kinds), np.log2(times).astype(np.int64)))] = np.arange(len(kinds))
        value[times < 2] = -1
        rank, which = np.full(len(pair), -1), np.zeros(len(pair), dtype=np.int64)
        rank[joined], which[joined] = value[kind], kind
        # neighbours of one rank are the same symbol thrice; of those every second pair is taken
        edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        tall = rank[edge]
        top = (tall >= 0) & (tall > np.append(-1, tall[:-1])) & (tall > np.append(tall[1:], -1))
        length = np.diff(np.append(edge, len(rank)))
        odd = (np.arange(len(rank)) - np.repeat(edge, length)) % 2
        chosen = np.flatnonzero(np.repeat(top, length) & (odd == 0))
        if not len(chosen):
            break
        new = np.unique(which[chosen], return_inverse=True)[1]
        left, begin = size[chosen], place[chosen]
        whole = left + size[chosen + 1]
        long = whole >= MIN_LENGTH
        if long.any():
            names, where, each = np.unique(new[long], return_index=True, return_inverse=True)
            lead, own = begin[long][where], np.arange(len(names)) + count
            at.append(lead + left[long][where])
            low.append(lead)
            high.append(lead + whole[long][where])
            node.append(own[each])
            shift.append(begin[long] - lead[each])
            count += len(names)
        symbol[chosen] = made + new
        size[chosen] = whole
        made += int(new.max()) + 1
        keep = np.ones(len(symbol), dtype=bool)
        keep[chosen + 1] = False
        symbol, place, size = symbol[keep], place[keep], size[keep]
    ends = place[1:][text.first[place[1:]] == text.first[place[:-1]]] if len(place) else place
    at.append(ends)
    low.append(text.first[ends])
    high.append(text.last[ends])
    node.append(np.arange(len(ends)) + count)
    shift.append(np.zeros(len(ends), dtype=np.int64))
    return Boundaries(*[np.concatenate(x) for x in (at, low, high, node, shift)])


def _doubled(name: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    return mix(name[:-width] * _C1 + (name[width:] ^ _C2)) if len(name) > width else name[:0]


def _ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words are equal from the places i and j on, or before them, at most ``limit``."""
    got = np.zeros(len(i), dtype=np.int64)
    for k in reversed(range(len(names))):
        width = 1 << k
        more = np.arange(len(i))
        while len(more):
            more = more[got[more] + width <= limit[more]]
            step = -got[more] - width if back else got[more]
            more = more[names[k][i[more] + step] == names[k][j[more] + step]]
            got[more] += width
            if k < len(names) - 1:
                break
    return got


def _candidates(text: Stretches, names: list[np.ndarray], name: np.ndarray, width: int, low: int, high: int,
                cuts: Boundaries):
    """Yields (boundary, base, period): the words of the window beside the boundary are found again a period in
    [low, high) away; ``base`` and ``base + period`` are places to compare from."""
    wide = np.flatnonzero(cuts.high - cuts.low >= max(MIN_LENGTH, MIN_EXPONENT * low))
    if not len(wide):
        return
    n = len(text.symbol)
    places = np.flatnonzero((np.arange(len(name)) + width <= text.last[:len(name)])
                            & (text.last - text.first >= max(MIN_LENGTH, MIN_EXPONENT * low))[:len(name)])
    key = mix(name[places] + text.first[places].astype(np.uint64) * _C1)
    order = np.lexsort((places, key))
    places, key = places[order], key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(key) else key.astype(np.int64)
    sorted_by = group * n + places
    own = np.full(n, -1)
    own[places] = np.arange(len(places))
    for right in (True, False):
        start = cuts.at[wide] if right else cuts.at[wide] - width
        inside = (start + width <= cuts.high[wide]) & (start >= cuts.low[wide])
        which, start = wide[inside], start[inside]
        mine = own[start]
        least = np.full(len(which), low)
        # a window that comes again at a short distance d, with d + q words of period d: q is not the smallest
        beside = np.clip(mine + (1 if right else -1), 0, max(len(places) - 1, 0))
        gap = np.abs(places[beside] - start)
        near = np.flatnonzero((group[beside] == group[mine]) & (gap > 0) & (gap <= low // 2))
        if len(near):
            edge, away = cuts.at[which[near]], gap[near]
            if right:
                held = _ahead(names, edge, edge + away, np.maximum(cuts.high[which[near]] - edge - away, 0))
            else:
                held = _ahead(names, edge - away, edge, np.maximum(edge - away - cuts.low[which[near]], 0), back=True)
            least[near] = np.maximum(least[near], held + 1)
        here = group[mine] * n
        if right:
            begin = np.searchsorted(sorted_by, here + start + np.minimum(least, n))
            end = np.searchsorted(sorted_by, here + np.minimum(start + high, cuts.high[which]))
        else:
            begin = np.searchsorted(sorted_by, here + np.maximum(start - high + 1, cuts.low[which]))
            end = np.searchsorted(sorted_by, here + np.maximum(start - least, -1), side="right")
        found = np.maximum(end - begin, 0)
        # places of other groups are never reached: the bounds lie inside the group's own range
        cum = np.concatenate([[0], np.cumsum(found)])
        i = 0
        while i < len(which):
            j = max(i + 1, int(np.searchsorted(cum, cum[i] + BLOCK, side="right")) - 1)
            n_of = found[i:j]
            slot = np.arange(n_of.sum()) - np.repeat(cum[i:j] - cum[i], n_of) + np.repeat(begin[i:j], n_of)
            period = np.abs(places[slot] - np.repeat(start[i:j], n_of))
            cut = np.repeat(which[i:j], n_of)
            yield cut, (cuts.at[cut] if right else cuts.at[cut] - period), period
            i = j


def _crossing(text: Stretches, cuts: Boundaries) -> list[np.ndarray]:
    """Boundary, start, end and period of every stretch of a period that is long enough, once each."""
    if not len(cuts.at):
        return [np.zeros(0, dtype=np.int64)] * 4
    names = [mix(text.symbol.astype(np.uint64) + _C2)]
    while len(names) < LEVELS and len(names[-1]) > 1 << (len(names) - 1):
        names.append(_doubled(names[-1], 1 << (len(names) - 1)))
    widest, out = int((cuts.high - cuts.low).max()), []
    k, name = 2, names[2] if len(names) > 2 else names[0][:0]
    while len(name):
        width = 1 << k
        # the window is no longer than what half of the run repeats of it: half of its words, less a period
        for low, high in {2: [(4, 16)], 3: [(1, 4), (16, 32)]}.get(k, [(2 * width, 4 * width)]):
            for cut, base, period in _candidates(text, names, name, width, low, high, cuts):
                end = base + period + _ahead(names, base, base + period, cuts.high[cut] - base - period)
                start = base - _ahead(names, base, base + period, base - cuts.low[cut], back=True)
                whole = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
                out.append(np.stack([cut[whole], start[whole], end[whole], period[whole]]))
        if k >= 3 and widest < MIN_EXPONENT * 4 * width:
            break
        name = names[k + 1] if k + 1 < len(names) else _doubled(name, width)
        k += 1
    cut, start, end, period = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    order = np.lexsort((period, end, start, cut))
    cut, start, end, period = cut[order], start[order], end[order], period[order]
    fresh = np.ones(len(cut), dtype=bool)
    fresh[1:] = (cut[1:] != cut[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return [cut[fresh], start[fresh], end[fresh], period[fresh]]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Intervals of one period that overlap by a period are parts of one run."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    wide = int(end.max()) + 1
    group = np.cumsum(np.concatenate([[0], np.diff(period) != 0]))
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    first = np.flatnonzero(opens)
    start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[smallest], end[smallest], period[smallest]


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> Runs:
    """Runs of texts given as word ids; text d has ``ids[bounds[d]:bounds[d + 1]]``."""
    text = _repeating(ids, bounds)
    cuts = _repair(text)
    cut, start, end, period = _crossing(text, cuts)
    # every place of the nonterminal has the run
    order = np.argsort(cuts.node, kind="stable")
    spread = np.searchsorted(cuts.node[order], np.arange(len(cuts.at) + 1))
    times = np.diff(spread)[cut]
    slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(spread[cut], times)
    shift = cuts.shift[order][slot]
    start, end, period = _merged(np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(period, times))
    begin = text.at[start] if len(start) else start
    order = np.lexsort((period, begin))
    begin, length, period = begin[order], (end - start)[order], period[order]
    return Runs(begin, length, period, np.searchsorted(begin, bounds))


def _dropped(runs: Runs, n: int) -> np.ndarray:
    """Which words some run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


def _joined(texts: Texts, words: Words, source: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of all texts, each followed by a space, and where the texts begin and end in that."""
    own = source[keep]
    begin, size = words.start[own], words.end[own] - words.start[own]
    after = np.cumsum(size + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 32, dtype=np.uint8)
    jump = begin - (after - size - 1)
    place = np.ones(len(out), dtype=bool)
    place[after - 1] = False
    to = np.flatnonzero(place)
    out[to] = texts.data[to + np.repeat(jump, size)]
    so_far = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return out, np.concatenate([[0], after])[so_far]


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of the greatest exact length per period; ties by start, then period, which is their order."""
    best = 0
    for i in range(1, len(start)):
        if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


def planted_source(doc_ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    """The word each word is read from: texts whose CRC-32 of the id is divisible by ten repeat a passage."""
    source = np.arange(bounds[-1])
    for d, doc_id in enumerate(doc_ids):
        h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), int(bounds[d + 1] - bounds[d])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place = np.arange(a, n)
            source[bounds[d] + place] = bounds[d] + a + (place - a) % p
    return source


_DIGESTS = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long,
runs_sha256 string, collapsed_sha256 string"""


def _digests(rows: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
    words = words_of(texts, lower=False)
    doc_ids = rows.column("doc_id").to_pylist()
    source = planted_source(doc_ids, words.bounds)
    runs = runs_of(words.hash[source], words.bounds)
    data, edges = _joined(texts, words, source, ~_dropped(runs, len(source)))
    out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    buffer = memoryview(data)
    for d in range(len(texts)):
        mine = slice(runs.bounds[d], runs.bounds[d + 1])
        start, length, period = runs.start[mine] - words.bounds[d], runs.length[mine], runs.period[mine]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
        best = [None] * 4
        if len(start):
            b = _best(start, length, period)
            best = [int(start[b]), int(length[b]), int(period[b]), 1000 * int(length[b]) // int(period[b])]
        text = buffer[edges[d]:max(edges[d], edges[d + 1] - 1)]
        for c, v in zip(out, [len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]):
            out[c].append(v)
    return {"doc_id": rows.column("doc_id")} | {
        c: pa.array(v, pa.string() if c.endswith("sha256") else pa.int64()) for c, v in out.items()}


def report(docs: DataFrame) -> DataFrame:
    """Digests of all runs per document, after the planted repetitions of :func:`planted_source`."""
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _DIGESTS, _digests)


def collapse(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns), ``runs`` (start, length, period in words) and ``collapsed``: the text's
    words without those that a run contains after its first period, joined by single spaces."""

    def collapsed(rows: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        words = words_of(texts, lower=False)
        found = runs_of(words.hash, words.bounds)
        data, edges = _joined(texts, words, np.arange(len(words.hash)), ~_dropped(found, len(words.hash)))
        struct = pa.StructArray.from_arrays([
            pa.array(found.start - np.repeat(words.bounds[:-1], np.diff(found.bounds)), pa.int64()),
            pa.array(found.length, pa.int64()), pa.array(found.period, pa.int64())], names=["start", "length", "period"])
        text = [data[edges[d]:max(edges[d], edges[d + 1] - 1)].tobytes().decode() for d in range(len(texts))]
        return {"row": rows.column("row"), "runs": pa.ListArray.from_arrays(pa.array(found.bounds, pa.int32()), struct),
                "collapsed": pa.array(text, pa.string())}

    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    schema = rows.select("row", F.expr("cast(null as array<struct<start:long,length:long,period:long>>)").alias("runs"),
                         F.lit("").alias("collapsed")).schema
    return map_texts(rows, schema, collapsed)
