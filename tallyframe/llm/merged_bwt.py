"""Repeated intervals of a string collection from merged Burrows-Wheeler transforms.

Every shard of the collection gets its own transform. The shards are then merged by refining their interleave:
after p rounds rows are ordered by the first p characters of their suffixes, and a round is one stable
distribution of the rows by the character before their suffix, followed through each shard's own last-to-first
mapping. Suffixes are never compared again. Rows that still stand in one block after p rounds have a common
prefix of p characters; a row alone in its block has settled and is not carried on for long.
"""

from __future__ import annotations

import numpy as np


def transform(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: suffix starts in order of their first ``depth`` characters (at least), the character before
    each, and the last-to-first mapping. ``text`` holds characters above 0, each string followed by a 0;
    ``starts`` are the strings' begins. Suffixes end at their string's 0."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    # places stand in the lowest bits of what is sorted, so that values need no second array; above them are as many
    # characters, and then as many ranks of what follows one another, as a number holds
    present = np.bincount(text) > 0
    codes = (np.cumsum(present) - present[0]).astype(np.uint64)
    order, rank = _sorted(codes[text], left, 1, int(codes[-1]), max_width=depth)
    known = _held(n, int(codes[-1]))
    while known < depth:
        width = min(_held(n, n), -(-depth // known))
        order, rank = _sorted(rank + np.uint64(1), left, known, n, max_width=width)
        known *= width
    before = np.empty_like(text)
    before[1:] = text[:-1]
    before[starts] = 0
    before = before[order]
    first = np.empty(n, dtype=np.int32)
    first[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    return order.astype(np.int32), before, first


def _held(n: int, most: int) -> int:
    """How many numbers up to ``most`` a 64-bit number holds above a place below ``n``; two at least, see below."""
    return max(2, (64 - n.bit_length()) // max(1, most.bit_length()))


def _sorted(value: np.ndarray, left: np.ndarray, step: int, most: int, max_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the values (up to ``most``) at them and at the next places, ``step`` apart, of their string,
    and ranks by these values."""
    n, bits = len(value), np.uint64(max(1, most.bit_length()))
    width = min(_held(n, most), max_width)
    key = value.copy()
    for k in range(step, step * width, step):
        after = np.zeros(n, dtype=np.uint64)
        after[:max(n - k, 0)] = value[k:]
        after[left < k] = 0
        key = key << bits | after
    place = np.uint64(n.bit_length())
    if width * int(bits) + int(place) <= 64:
        key = key << place | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << int(place)) - 1)).astype(np.int64)
        key >>= place
    else:
        order = np.argsort(key)
        key = key[order]
    rank = np.empty(n, dtype=np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return order, rank


def repeated(strings: np.ndarray, starts: np.ndarray, depth: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all substrings of ``depth`` characters that occur twice or more, and the block of each; equal
    substrings are one block, and rows come block by block. ``strings`` and ``starts`` are as in :func:`transform`;
    about ``shard`` characters are sorted at a time."""
    suffixes, befores, firsts, at = [], [], [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + shard)))
        low, high = starts[at], starts[end] if end < len(starts) else len(strings)
        order, before, first = transform(strings[low:high], starts[at:end] - low, depth)
        suffixes.append(order + np.int32(low))
        befores.append(before)
        firsts.append(first + np.int32(low))
        at = end
    if not suffixes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix, before, first = np.concatenate(suffixes), np.concatenate(befores), np.concatenate(firsts)
    if before.max(initial=0) < 256:
        before = before.astype(np.uint8)
    rows, block = np.arange(len(suffix), dtype=np.int32), np.zeros(len(suffix), dtype=np.int32)
    for left in reversed(range(depth)):
        c = before[rows]
        order = np.argsort(c, kind="stable")[len(c) - np.count_nonzero(c):]
        c, rows, block = c[order], first[rows[order]], block[order]
        if not len(rows):
            break
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32) - 1
        alone = new & np.append(new[1:], True)
        # rows alone stay so, and are taken out when they are many, and at the end
        if not left or 8 * np.count_nonzero(alone) > len(alone):
            rows, block = rows[~alone], block[~alone]
    return suffix[rows].astype(np.int64), block
