"""Metric trees of an anchors hierarchy, and nearest codebook entries for whole balls at once.

The tree of a set of points is built from its middle: about the square root of n anchors are chosen, each the point
farthest from the anchor that owns it, and take over the points that are nearer to them; by the triangle inequality
a point nearer to its anchor than half of the anchors' distance is not looked at. Upwards the anchors' balls are
joined in pairs, those with the smallest common ball first; downwards each anchor's points are split alike. Every
ball caches its points' sum and number.

:func:`descend` goes down with a list of the entries that may be nearest to some point of the ball. A ball inherits
its parent's list and strikes entries that are farther from the pivot than the nearest one by more than the ball's
diameter. With one entry left the ball is wholly owned, and its cached sum and number serve for all its points.
Points are whole numbers and the last distances are exact, so the result does not depend on the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

#: Points of a ball that is not split further.
LEAF = 24


@dataclass
class Tree:
    """Points in the order of the leaves (``points[i]`` was ``order[i]``); a ball is ``begin:end`` of them, with its
    halves (-1: none), radius around the mean, and sum. Ball 0 holds all points."""

    points: np.ndarray
    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def packed(self) -> dict[str, bytes]:
        """Every array in the smallest whole-number type that holds it."""
        return {f.name: _small(getattr(self, f.name)) for f in fields(self)}

    @classmethod
    def unpacked(cls, columns: dict[str, bytes], width: int) -> Tree:
        arrays = {name: _wide(value) for name, value in columns.items()}
        arrays["points"] = arrays["points"].reshape(len(arrays["order"]), width)
        arrays["total"] = arrays["total"].reshape(len(arrays["begin"]), width)
        return cls(**arrays)


_KINDS = (np.int8, np.int16, np.int32, np.int64, np.float64)


def _small(values: np.ndarray) -> bytes:
    kind = 4
    if values.dtype != np.float64:
        low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
        kind = next(k for k, t in enumerate(_KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind]) + values.astype(_KINDS[kind]).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    packed = memoryview(packed)
    values = np.frombuffer(packed[1:], dtype=_KINDS[packed[0]])
    return values if packed[0] == 4 else values.astype(np.int64)


def _anchors(x: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Owner of every point, and how many anchors there are."""
    own, centers = np.zeros(len(x), dtype=np.int64), [x[0]]
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(centers) < most:
        far = int(away.argmax())
        if away[far] <= 0:
            break
        new = x[far]
        gap = np.sqrt(((np.array(centers) - new) ** 2).sum(axis=1))
        maybe = np.flatnonzero(away > gap[own] / 2)
        near = np.sqrt(((x[maybe] - new) ** 2).sum(axis=1))
        taken = near < away[maybe]
        own[maybe[taken]], away[maybe[taken]] = len(centers), near[taken]
        centers.append(new)
    return own, len(centers)


class _Builder:
    def __init__(self, x: np.ndarray):
        self.x, self.halves, self.members = x, [], []

    def ball(self, left: int, right: int, members: np.ndarray | None) -> int:
        self.halves.append((left, right))
        self.members.append(members)
        return len(self.halves) - 1

    def split(self, index: np.ndarray) -> int:
        if len(index) > LEAF:
            x = self.x[index]
            own, count = _anchors(x, math.isqrt(len(index) - 1) + 1)
            if count > 1:
                parts = [np.flatnonzero(own == a) for a in range(count)]
                return self.join(x, parts, [self.split(index[p]) for p in parts])
        return self.ball(-1, -1, index)

    def join(self, x: np.ndarray, parts: list[np.ndarray], balls: list[int]) -> int:
        """Pairs of balls are joined until one is left, the smallest common ball first."""
        n = np.array([len(p) for p in parts], dtype=float)
        center = np.array([x[p].mean(axis=0) for p in parts])
        radius = np.array([np.sqrt(((x[p] - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, center)])

        def common(i):
            gap = np.sqrt(((center - center[i]) ** 2).sum(axis=1))
            return np.maximum((gap + radius + radius[i]) / 2, np.maximum(radius, radius[i]))

        size = np.array([common(i) for i in range(len(balls))])
        np.fill_diagonal(size, np.inf)
        for _ in range(len(balls) - 1):
            i, j = divmod(int(size.argmin()), len(balls))
            balls[i] = self.ball(balls[i], balls[j], None)
            grown = size[i, j]
            center[i] = (center[i] * n[i] + center[j] * n[j]) / (n[i] + n[j])
            n[i], radius[i] = n[i] + n[j], grown
            gone = np.isinf(size[i])
            gone[j] = True
            gone[i] = True
            size[j], size[:, j] = np.inf, np.inf
            row = np.where(gone, np.inf, common(i))
            size[i], size[:, i] = row, row
        return balls[i]


def anchors_tree(points: np.ndarray) -> Tree:
    """The tree of at least one point; points are rows of whole numbers."""
    made = _Builder(points.astype(np.float64))
    root = made.split(np.arange(len(points)))
    # balls are numbered from the root, and a ball's points are next to each other
    order, begin, end, left, right = [], [], [], [], []
    stack, at = [(root, -1, False)], 0
    after = []
    while stack:
        ball, above, is_right = stack.pop()
        me = len(begin)
        if above >= 0:
            (right if is_right else left)[above] = me
        begin.append(at)
        left.append(-1)
        right.append(-1)
        after.append(above)
        if made.members[ball] is None:
            one, other = made.halves[ball]
            stack += [(other, me, True), (one, me, False)]
        else:
            order.append(made.members[ball])
            at += len(made.members[ball])
        end.append(at)
    begin, end, left, right = (np.array(v, dtype=np.int64) for v in (begin, end, left, right))
    for ball in range(len(begin) - 1, 0, -1):
        end[after[ball]] = max(end[after[ball]], end[ball])
    order = np.concatenate(order)
    points = points[order]
    so_far = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points, axis=0)])
    total = so_far[end] - so_far[begin]
    pivot = total / (end - begin)[:, None]
    radius = np.array([np.sqrt(((points[b:e] - p) ** 2).sum(axis=1).max()) for b, e, p in zip(begin, end, pivot)])
    return Tree(points, order, begin, end, left, right, radius, total)


def exact_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, as whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    bound = x.shape[1] * 4 * most * most
    if bound >= 1 << 62:
        raise ValueError("components are too large for squared distances in 64 bits")
    if bound < 1 << 51:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1) if len(y) else np.zeros((len(x), 0), dtype=np.int64)


def descend(tree: Tree, book: np.ndarray):
    """Yields (ball, entry) for balls that an entry owns wholly, and (ball, entries of its points) for leaves that
    several share. Ties go to the lower entry."""
    # an entry equal to an earlier one is never chosen
    entry = np.sort(np.unique(book, axis=0, return_index=True)[1]) if book.shape[1] else np.zeros(1, dtype=np.int64)
    center = book[entry].astype(np.float64)
    square = (center * center).sum(axis=1)
    most = max(np.abs(center).max(initial=0), np.abs(tree.points[:1]).max(initial=0) + 2 * tree.radius[0])
    # rounding never strikes an entry
    slack = 1e-6 * (most + 1) * math.sqrt(max(book.shape[1], 1))
    balls, lists = np.zeros(1, dtype=np.int64), np.ones((1, len(entry)), dtype=bool)
    while len(balls):
        pivot = tree.total[balls] / (tree.end[balls] - tree.begin[balls])[:, None]
        away = (pivot * pivot).sum(axis=1)[:, None] - 2 * (pivot @ center.T) + square
        away = np.where(lists, np.sqrt(np.maximum(away, 0)), np.inf)
        lists = away <= away.min(axis=1)[:, None] + 2 * tree.radius[balls][:, None] + slack
        alone = lists.sum(axis=1) == 1
        for i in np.flatnonzero(alone):
            yield balls[i], entry[lists[i].argmax()]
        leaf = ~alone & (tree.left[balls] < 0)
        for i in np.flatnonzero(leaf):
            mine = entry[lists[i]]
            away_from = exact_squares(tree.points[tree.begin[balls[i]]:tree.end[balls[i]]], book[mine])
            yield balls[i], mine[away_from.argmin(axis=1)]
        down = ~alone & ~leaf
        balls, lists = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([lists[down]] * 2)


def entry_sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of every entry."""
    total, count = np.zeros(book.shape, dtype=np.int64), np.zeros(len(book), dtype=np.int64)
    for ball, entry in descend(tree, book):
        if np.ndim(entry) == 0:
            total[entry] += tree.total[ball]
            count[entry] += tree.end[ball] - tree.begin[ball]
        else:
            np.add.at(total, entry, tree.points[tree.begin[ball]:tree.end[ball]])
            np.add.at(count, entry, 1)
    return total, count


def nearest(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every point and squared distance to it, in the order in which the points were given."""
    chosen = np.zeros(len(tree.points), dtype=np.int64)
    for ball, entry in descend(tree, book):
        chosen[tree.begin[ball]:tree.end[ball]] = entry
    error = ((tree.points - book[chosen]) ** 2).sum(axis=1)
    entry, away = np.empty_like(chosen), np.empty_like(error)
    entry[tree.order], away[tree.order] = chosen, error
    return entry, away
