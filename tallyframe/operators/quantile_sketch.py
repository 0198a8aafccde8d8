"""A mergeable sketch of weighted values that brackets ranks with certainty.

A sketch of a group is a list of its values, the boundaries, each with bounds of two weights: that of all values up to
and including it (``low``, ``high``) and that of the values before it (at most ``before``). For rows at hand the
bounds are exact; what lies between two boundaries may lie anywhere there. Sketches are merged by adding the bounds
at every boundary of either, and pruned by leaving boundaries out, so that at most about ``1 / SIZE`` of the weight
lies between two that remain, with every level of merging. Weights must not be negative.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Boundaries of a sketch, rows that are sorted together, and tasks whose sketches are merged first.
SIZE, BLOCK, TASKS = 1024, 1 << 18, 256
#: Relative rounding of sums of weights that a bracket allows for.
ROUNDING = 1e-9
_FIELDS = ("__value", "__low", "__high", "__before")

Sketch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pruned(sketch: Sketch, size: int = SIZE) -> Sketch:
    """The first and last boundaries, and those that pass another part of the weight."""
    value, low, high, before = sketch
    if len(value) <= size:
        return sketch
    part = np.floor((low + high) / 2 * (size - 2) / max(high[-1], 1e-300))
    keep = np.ones(len(value), dtype=bool)
    # both sides of a step: a heavy value stays a boundary of its own
    keep[1:-1] = (part[1:-1] != part[:-2]) | (part[2:] != part[1:-1])
    return value[keep], low[keep], high[keep], before[keep]


def exact(x: np.ndarray, w: np.ndarray) -> Sketch:
    """The sketch of sorted values with their weights, before it is pruned."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    until = np.cumsum(np.add.reduceat(w, first))
    return x[first], until, until, np.concatenate([[0.0], until[:-1]])


def merged(sketches: Sequence[Sketch]) -> Sketch:
    """The sketch of all the values of several."""
    if len(sketches) == 1:
        return sketches[0]
    value = np.concatenate([s[0] for s in sketches])
    gain = np.concatenate([np.diff(s[1], prepend=0.0) for s in sketches])
    # at a boundary its own bound holds; past it, until the next one, what may lie before that
    after = [np.append(s[3][1:], s[2][-1]) for s in sketches]
    at = np.concatenate([s[2] - s[3] for s in sketches])
    step = np.concatenate([a - s[3] for a, s in zip(after, sketches)])
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    low = np.cumsum(np.add.reduceat(gain[order], first))
    passed = np.cumsum(np.add.reduceat(step[order], first))
    start = sum(s[3][0] for s in sketches)
    before = start + np.concatenate([[0.0], passed[:-1]])
    return value[first], low, before + np.add.reduceat(at[order], first), before


def bracket(sketch: Sketch, share: float = 0.5) -> tuple[float, float]:
    """``(after, until]``: where the values lie at which the running weight reaches, and exceeds, that share."""
    value, low, high, _ = sketch
    under = np.flatnonzero(high < share * high[-1] * (1 - ROUNDING))
    over = np.flatnonzero(low > share * high[-1] * (1 + ROUNDING))
    return (value[under[-1]] if len(under) else -np.inf), (value[over[0]] if len(over) else np.inf)


def _groups(table: pa.Table, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's group, and a row of each."""
    code = np.zeros(len(table), dtype=np.int64)
    for c in by:
        encoded = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy(), return_inverse=True)
    _, rows, code = np.unique(code, return_index=True, return_inverse=True)
    return code, rows


def brackets(rows: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """One row per group: ``by``, and ``__after`` and ``__until``, between which the weighted median lies, from columns
    ``__x`` and ``__w`` (present doubles).

    Tasks sketch what they read, a block at a time. The sketches of ``TASKS`` neighbouring tasks are merged, then
    those of all; a group's rows never meet. ``size`` boundaries are kept at a time.
    """
    keys = [f for f in rows.schema if f.name in by]
    names = [f.name for f in keys]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def batch(held: list[tuple[pa.Table, Sketch]], part: int) -> pa.RecordBatch:
        cells = [pa.concat_arrays([c for k, _ in held for c in k.column(name).chunks]) for name in names]
        ends = np.concatenate([[0], np.cumsum([len(s[0]) for _, s in held])])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s[i] for _, s in held])))
                 for i in range(len(_FIELDS))]
        return pa.RecordBatch.from_arrays([*cells, pa.array([part] * len(held), pa.int32()), *lists],
                                          names=[*names, "__part", *_FIELDS])

    def block(table: pa.Table, held: dict) -> None:
        code, first = _groups(table, names)
        x, w = table.column("__x").to_numpy(), table.column("__w").to_numpy()
        order = np.lexsort((x, code))
        x, w, edges = x[order], w[order], np.searchsorted(code[order], np.arange(len(first) + 1))
        group_keys = table.select(names).take(pa.array(first))
        for g, name in enumerate(zip(*[group_keys.column(c).to_pylist() for c in names])):
            mine = slice(edges[g], edges[g + 1])
            have = held.setdefault(name, (group_keys.slice(g, 1), []))[1]
            have.append(pruned(exact(x[mine], w[mine]), size))
            if len(have) > 8:
                have[:] = [pruned(merged(have), size)]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = {}, [], 0
        part = TaskContext.get().partitionId() // TASKS

        def out() -> pa.RecordBatch:
            return batch([(key, pruned(merged(have), size)) for key, have in held.values()], part)

        for one in batches:
            waiting.append(one)
            n += len(one)
            if n >= BLOCK:
                block(pa.Table.from_batches(waiting), held)
                waiting, n = [], 0
            if len(held) > BLOCK:
                yield out()
                held = {}
        if n:
            block(pa.Table.from_batches(waiting), held)
        if held:
            yield out()

    def together(table: pa.Table) -> Sketch:
        columns = []
        for c in _FIELDS:
            column = table.column(c).combine_chunks()
            columns.append(np.split(column.flatten().to_numpy(), column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py()))
        return merged(list(zip(*columns)))

    def meet(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch([(table.select(names).slice(0, 1), pruned(together(table), size))], 0)])

    def ends(table: pa.Table) -> pa.Table:
        after, until = bracket(together(table))
        key = table.select(names).slice(0, 1)
        return key.append_column("__after", pa.array([after])).append_column("__until", pa.array([until]))

    schema = ", ".join([key_schema, "__part int", *[f"{c} array<double>" for c in _FIELDS]])
    packed = rows.select(*names, "__x", "__w").mapInArrow(sketched, schema)
    near = packed.groupBy(*names, "__part").applyInArrow(meet, schema)
    return near.groupBy(*names).applyInArrow(ends, f"{key_schema}, __after double, __until double")
