"""Interval binning: a label for people and an ordinal for sorting and grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

INF = float("inf")


def age_breaks(top: int, step: int = 5, first: int = 15, lowest: int | None = 0) -> list[float]:
    """Breaks ``lowest, first, first+step, …, top, Inf``."""
    start = [] if lowest is None else [lowest]
    return [*start, *range(first, top + 1, step), INF]


def _num(b: float) -> str:
    if b in (INF, -INF):
        return "Inf" if b > 0 else "-Inf"
    return f"{b:.3g}"


def cut_labels(breaks: Sequence[float], right: bool = True, include_lowest: bool = False) -> list[str]:
    """Interval names; the outermost closed end is shown closed with ``include_lowest``."""
    n = len(breaks) - 1
    out = []
    for i in range(n):
        lo, hi = _num(breaks[i]), _num(breaks[i + 1])
        if right:
            left = "[" if include_lowest and i == 0 else "("
            out.append(f"{left}{lo},{hi}]")
        else:
            end = "]" if include_lowest and i == n - 1 else ")"
            out.append(f"[{lo},{hi}{end}")
    return out


def _chain(c: Column, breaks: Sequence[float], outcomes: Sequence, right: bool,
           include_lowest: bool) -> Column:
    def lit(b: float) -> Column:
        return F.lit(int(b)) if float(b).is_integer() else F.lit(float(b))

    lowest = lit(breaks[0])
    if right:
        below = c < lowest if include_lowest else c <= lowest
    else:
        below = c < lowest
    col = F.when(below, None)
    for i, value in enumerate(outcomes):
        hi = lit(breaks[i + 1])
        closed = right or (include_lowest and i == len(outcomes) - 1)
        col = col.when(c <= hi if closed else c < hi, F.lit(value))
    return col


def cut(c: Column, breaks: Sequence[float], right: bool = True, include_lowest: bool = False,
        labels: Sequence[str] | None = None) -> Column:
    """Interval label of ``c``; missing outside the breaks."""
    names = list(labels) if labels is not None else cut_labels(breaks, right, include_lowest)
    return _chain(c, breaks, names, right, include_lowest)


def cut_id(c: Column, breaks: Sequence[float], right: bool = True,
           include_lowest: bool = False) -> Column:
    """Interval number from 1; the ordinal of :func:`cut`."""
    return _chain(c, breaks, list(range(1, len(breaks))), right, include_lowest)
