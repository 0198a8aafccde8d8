"""Registration of queries with their result columns and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.workload.views import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"int": "int", "bigint": "bigint", "str": "string", "bool": "boolean", "date": "date"}
_DUCK = {"int": "integer", "bigint": "bigint", "str": "varchar", "bool": "boolean", "date": "date"}


def _columns(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(":", 1)) for c in cols.split()]


def _spark_column(name: str, kind: str) -> Column:
    if kind in _SPARK:
        return F.col(f"`{name}`").cast(_SPARK[kind]).alias(name)
    # "d6": a double rounded to six digits, negative zero made positive
    return (F.round(F.col(f"`{name}`").cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def _duck_column(name: str, kind: str) -> str:
    if kind in _DUCK:
        return f'cast("{name}" as {_DUCK[kind]}) as "{name}"'
    return f'round(cast("{name}" as double), {kind[1:]}) + cast(0 as double) as "{name}"'


def query(name: str, cols: str, uses: str = "", sql: str | None = None):
    """Register a query.

    ``cols`` lists result columns as ``name:type``; both engines cast to these types, and floating
    results (``d6``) are rounded because their last digits depend on the order of summation. ``uses``
    names views; ``sql`` may define further ones, starting with ``with``.
    """
    spec = _columns(cols)

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[_spark_column(*c) for c in spec])

        run.__doc__ = f.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ctes = [f"{v} as ({SQL[v]})" for v in uses.split()]
            body = sql.strip()
            recursive = "recursive " if body.startswith("with recursive ") else ""
            if body.startswith("with "):
                # further views end where the line with the final select starts
                more, final = body[5 + len(recursive):].rsplit("\nselect", 1)
                ctes.append(more.strip())
                body = "select" + final
            head = f"with {recursive}{', '.join(ctes)} " if ctes else ""
            chosen = ", ".join(_duck_column(*c) for c in spec)
            ORACLES[name] = f"{head}select {chosen} from ({body}) as result"
        return run

    return register
