"""Column choice, column order, unions and reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns in which ``pattern`` is found, ignoring case, in table order."""
    rx = re.compile(pattern, re.IGNORECASE)
    return [c for c in df.columns if rx.search(c)]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Columns from ``first`` to ``last`` in table order."""
    return df.columns[df.columns.index(first):df.columns.index(last) + 1]


def without(df: DataFrame, *names: str) -> list[str]:
    """All columns but these."""
    return [c for c in df.columns if c not in names]


def relocate(df: DataFrame, names: str | Sequence[str], after: str | None = None,
             before: str | None = None) -> DataFrame:
    """Move columns after or before another one, or to the front."""
    moved = [names] if isinstance(names, str) else list(names)
    rest = [c for c in df.columns if c not in moved]
    if after is not None:
        at = rest.index(after) + 1
    elif before is not None:
        at = rest.index(before)
    else:
        at = 0
    return df.select(*rest[:at], *moved, *rest[at:])


def across(names: Sequence[str], f: Callable[[Column], Column]) -> list[Column]:
    """The same expression over many columns, each keeping its name."""
    return [f(F.col(c)).alias(c) for c in names]


def union_fill(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is missing there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def wider(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence,
          values: str | Sequence[str], name: Callable[[object, str], str] | None = None) -> DataFrame:
    """Long to wide for the given ``names``.

    The names are given, not discovered, so no extra pass over the data is needed. With several value
    columns each name's values stand together, in the order of ``values``.
    """
    cols = [values] if isinstance(values, str) else list(values)
    if name is None:
        name = (lambda n, v: str(n)) if len(cols) == 1 else (lambda n, v: f"{n}_{v}")
    key = F.col(names_from)
    cells = [F.first(F.when(key.eqNullSafe(F.lit(n)), F.col(v)), ignorenulls=True).alias(name(n, v))
             for n in names for v in cols]
    return df.groupBy(*ids).agg(*cells)


def longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str,
           values_to: str, as_type: str = "double") -> DataFrame:
    """Wide to long; the values are cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), names_to, values_to)
