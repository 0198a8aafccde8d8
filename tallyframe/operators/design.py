"""Survey designs with replicate weights: weighted counts and means with standard errors.

A replicate estimate is the same sum taken with another weight column, so everything below is one
grouped aggregation with one sum per weight column. Sums are additive, hence a design may be collapsed
to any grouping first and counted from there with the same result; that is how several counts share
one pass over the microdata.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.nulls import ratio
from tallyframe.operators.reshape import matching

_DOMAIN = "__domain"
#: Weight columns in one pass of a mean. The JVM only interprets the methods of many more columns, and rows with all of
#: them fill a task's memory where they are sorted for a join.
BLOCK = 21


@dataclass(frozen=True)
class SurveyDesign:
    """Rows, their weight column and replicate weight columns.

    The variance of an estimate is ``scale`` times the sum of squared distances of the replicate
    estimates from the full-sample estimate; ``scale`` is 4/R for successive-difference replicates.
    """

    df: DataFrame
    weight: str
    replicates: tuple[str, ...]
    scale: float

    @classmethod
    def from_pattern(cls, df: DataFrame, weight: str, pattern: str,
                     numerator: float = 4.0) -> SurveyDesign:
        """Choose the replicate columns by a regular expression."""
        reps = tuple(matching(df, pattern))
        if not reps:
            raise ValueError(f"no column matches {pattern!r}")
        return cls(df, weight, reps, numerator / len(reps))

    @property
    def weights(self) -> list[str]:
        return [self.weight, *self.replicates]

    def filter(self, cond: Column) -> SurveyDesign:
        """The domain for which ``cond`` holds; exact for replicate weights."""
        return replace(self, df=self.df.filter(cond))

    def with_columns(self, cols: dict[str, Column]) -> SurveyDesign:
        return replace(self, df=self.df.withColumns(cols))

    def collapse(self, *by: str) -> SurveyDesign:
        """The design summed to ``by``: one row per group instead of one per record."""
        return replace(self, df=summed(self.df, by, self.weights))

    def error_text(self, estimates: str) -> str:
        """SQL of the standard error, from an array of the estimate followed by its replicates."""
        return (f"sqrt({self.scale!r}D * aggregate(slice({estimates}, 2, {len(self.replicates)}), 0D, "
                f"(acc, r) -> acc + (r - {estimates}[0]) * (r - {estimates}[0])))")

    def folded(self, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
        """``keep`` columns, the estimate and its standard error from summed weight columns."""
        packed = df.selectExpr(*_quoted(keep), f"`{self.weight}` as `{name}`",
                               f"{_array(self.weights)} as __est")
        return packed.selectExpr(*_quoted(keep), f"`{name}`", f"{self.error_text('__est')} as `{name}_se`")


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _array(names: Sequence[str]) -> str:
    return "array(" + ", ".join(f"double(`{n}`)" for n in names) + ")"


def summed(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of many columns under their own names; 0 where a group has no present value."""
    return df.groupBy(*by).sum(*columns).toDF(*by, *columns).fillna(0, list(columns))


def survey_count(design: SurveyDesign, by: Sequence[str], name: str = "n") -> DataFrame:
    """Weighted count per group with its standard error ``{name}_se``."""
    return design.folded(design.collapse(*by).df, by, name)


def survey_counts(design: SurveyDesign, by: Sequence[str], domains: dict[str, Column],
                  se: bool = True) -> DataFrame:
    """Several domain counts side by side from one pass.

    ``domains`` names conditions; a count is missing in a group that has no row in the domain. The
    records are first summed per group and combination of conditions, which leaves a table of at most
    ``groups * 2**len(domains)`` rows; only that is repeated per domain.
    """
    flags = {f"__in_{name}": F.coalesce(cond, F.lit(False)) for name, cond in domains.items()}
    if not se:
        design = replace(design, replicates=())
    cube = design.with_columns(flags).collapse(*by, *flags)
    member = F.filter(
        F.array(*[F.when(F.col(f), F.lit(n)) for f, n in zip(flags, domains)]),
        lambda x: x.isNotNull())
    long = summed(cube.df.withColumn(_DOMAIN, F.explode(member)), [*by, _DOMAIN], design.weights)
    if se:
        long = design.folded(long, [*by, _DOMAIN], "est")
    else:
        long = long.withColumnRenamed(design.weight, "est")
    cells = []
    for n in domains:
        here = F.col(_DOMAIN) == n
        cells.append(F.max(F.when(here, F.col("est"))).alias(n))
        if se:
            cells.append(F.max(F.when(here, F.col("est_se"))).alias(f"{n}_se"))
    return long.groupBy(*by).agg(*cells)


def survey_mean(design: SurveyDesign, by: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """Weighted mean of a number or condition per group, with standard error, over present values.

    The weights are summed in blocks of ``BLOCK`` columns, each a pass of its own that reads and moves only these.
    """
    name = name or value
    present = design.filter(F.col(value).isNotNull())
    blocks = [_mean_terms(present.df, by, value, design.weights[i:i + BLOCK]).withColumn("__block", F.lit(i))
              for i in range(0, len(design.weights), BLOCK)]
    whole = reduce(DataFrame.unionByName, blocks).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("__block", "__sums", "__weights"))).alias("__blocks"))
    means = whole.select(*by, F.zip_with(F.flatten("__blocks.__sums"), F.flatten("__blocks.__weights"), ratio).alias("__est"))
    return means.selectExpr(*_quoted(by), f"__est[0] as `{name}`",
                            f"{design.error_text('__est')} as `{name}_se`")


def _mean_terms(present: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Per group the sums of the value times each weight, and of each weight, as two arrays."""
    if isinstance(present.schema[value].dataType, T.BooleanType):
        # Two rows per group carry all a proportion needs, so the wide second step runs on few rows.
        present = summed(present, [*by, value], weights)
    sums = [f"__t{i}" for i in range(len(weights))]
    products = present.selectExpr(*_quoted(by), *_quoted(weights), *[
        f"double(`{value}`) * `{w}` as {t}" for w, t in zip(weights, sums)])
    totals = summed(products, by, [*sums, *weights])
    return totals.selectExpr(*_quoted(by), f"{_array(sums)} as __sums", f"{_array(weights)} as __weights")
