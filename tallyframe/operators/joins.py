"""Equi-joins in which missing matches missing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, functions as F, types as T

_R = "__right_"
#: Bytes of input files behind one partition of a large join.
PART_BYTES = 4 << 20


def dealt(left: DataFrame, right: DataFrame, left_keys: Sequence[Column], right_keys: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a large join, dealt by its keys into partitions whose number grows with the files behind them.

    The number of shuffle partitions of a session is fixed, so what a task sorts for a join would grow with the input.
    For keys with few rows each: adaptive execution splits no partitions that were asked for. Sides that need no more
    partitions than there are cores, and bucketed tables, are left as they are.
    """
    leaves = [leaf for df in (left, right) for leaf in _leaves(df)]
    parts = -(-sum(map(_file_bytes, leaves)) // PART_BYTES)
    if parts <= left.sparkSession.sparkContext.defaultParallelism or any(map(_bucketed, leaves)):
        return left, right
    return left.repartition(parts, *left_keys), right.repartition(parts, *right_keys)


def _leaves(df: DataFrame) -> list[JavaObject]:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def _of_files(leaf: JavaObject) -> bool:
    """Database tables are relations, too, but do not know their size: they call it the largest number there is."""
    return leaf.nodeName().startswith("LogicalRelation") and "HadoopFsRelation" in leaf.relation().getClass().getName()


def _file_bytes(leaf: JavaObject) -> int:
    return int(leaf.relation().sizeInBytes()) if _of_files(leaf) else 0


def _bucketed(leaf: JavaObject) -> bool:
    return _of_files(leaf) and leaf.relation().bucketSpec().isDefined()


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
               nullable: Sequence[str] | None = None, deal: bool = False) -> DataFrame:
    """Join on equal names: left columns in their order (each key once), then right columns.

    ``nullable`` names the keys that may be missing (all of them by default); those match missing to
    missing. Keys known to be present compare by plain equality, which keeps bucketing usable. With ``deal`` the sides
    of a large join are dealt into more partitions (see :func:`dealt`) if the nullable keys are numbers.
    """
    if not on:
        raise ValueError("no key to join on")
    nullable = on if nullable is None else nullable
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides that are not keys: {sorted(clash)}")
    r = right.withColumnsRenamed({k: _R + k for k in on})
    terms = [F.col(k).eqNullSafe(F.col(_R + k)) if k in nullable else F.col(k) == F.col(_R + k) for k in on]
    cond = reduce(lambda a, b: a & b, terms)
    if deal and all(isinstance(df.schema[k].dataType, T.NumericType) for df in (left, right) for k in nullable):
        left, r = dealt(left, r, _hashed(on, nullable), _hashed([_R + k for k in on], [_R + k for k in nullable]))
    joined = left.join(r, cond, how)
    if how in ("left", "inner"):
        key = {k: F.col(k) for k in on}
    elif how == "right":
        key = {k: F.col(_R + k).alias(k) for k in on}
    else:
        key = {k: F.coalesce(F.col(k), F.col(_R + k)).alias(k) for k in on}
    return joined.select(*[key.get(c, c) for c in left.columns],
                         *[c for c in right.columns if c not in on])


def _hashed(keys: Sequence[str], nullable: Sequence[str]) -> list[Column]:
    """What Spark compares in a join on ``keys``, so that sides dealt by it are not moved again."""
    return [x for k in keys for x in ([F.coalesce(F.col(k), F.lit(0)), F.col(k).isNull()] if k in nullable else [F.col(k)])]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column the two tables share."""
    return keyed_join(left, right, [c for c in left.columns if c in right.columns], how)


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str],
              suffix: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join; columns on both sides that are not keys get a suffix each."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    return keyed_join(left.withColumnsRenamed({c: c + suffix[0] for c in clash}),
                      right.withColumnsRenamed({c: c + suffix[1] for c in clash}), on, "full")
