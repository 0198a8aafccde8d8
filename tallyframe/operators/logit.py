"""Weighted logistic models.

A formula ``(a + b + …) * group`` gives every group its own intercept and slopes, so its likelihood
splits by group. :func:`fit_logit_by` uses that: groups of bounded size take all their steps in one task, and for
larger ones each Newton step is one grouped aggregation that serves every group and every model at once. :func:`fit_formula`
fits any other formula with Spark ML.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tallyframe.operators.design import summed
from tallyframe.operators.joins import keyed_join
from tallyframe.session import release_staged, stage

#: What becomes of a group's model: at its optimum; outcomes separated, rates next to 0 and 1; no complete row;
#: still moving after the last step, which quasi-separated outcomes are the usual reason for.
SETTLED, SEPARATED, EMPTY, UNSETTLED = "settled", "separated", "empty", "unsettled"
_OPEN = "open"
#: Rows of a group that one task solves whole, and about as many rows of smaller groups at a time.
WHOLE = 100_000


@dataclass(frozen=True)
class LogitSpec:
    """A model's name and its covariates (names of numeric columns), besides the intercept."""

    name: str
    terms: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return len(self.terms) + 1

    def coef(self, j: int) -> str:
        return f"{self.name}__b{j}"

    @property
    def status(self) -> str:
        return f"{self.name}__status"


def predicted(spec: LogitSpec, replaced: dict[str, Column] | None = None) -> Column:
    """Fitted probability from joined coefficient columns; missing if a covariate is missing.

    ``replaced`` swaps covariates for other expressions, which is how a counterfactual is predicted
    without copying the rows.
    """
    eta = F.col(spec.coef(0))
    for j, term in enumerate(spec.terms, start=1):
        eta = eta + F.col(spec.coef(j)) * (replaced or {}).get(term, F.col(term)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def _step_sums(df: DataFrame, by: Sequence[str], specs: Sequence[LogitSpec], outcome: str, weight: str) -> DataFrame:
    """Per group and model: row count, log-likelihood, gradient and Hessian, as plain sums.

    Linear predictor, probability, residual and curvature weight are columns of their own, so the
    exponential is taken once per row and model and every summand is one short product. A row with a
    missing covariate has a missing predictor and drops out of every sum of its model. The expressions
    are SQL text because there are about a hundred of them in every step.
    """
    keys = [f"`{k}`" for k in by]
    terms = list(dict.fromkeys(t for s in specs for t in s.terms))
    xs = [f"double(`{t}`) as `{t}`" for t in terms]
    passed = [*keys, "__y", "__w", *[f"`{t}`" for t in terms]]
    eta, prob, weights, summands = [], [], [], []
    for s in specs:
        coefs = [f"`{s.coef(j)}`" for j in range(s.size)]
        eta.append(" + ".join([coefs[0], *[f"{c} * double(`{t}`)" for c, t in zip(coefs[1:], s.terms)]])
                   + f" as {s.name}__eta")
        e, p = f"{s.name}__eta", f"{s.name}__p"
        prob.append(f"1D / (1D + exp(-{e})) as {p}")
        weights += [f"if({e} is null, 0, 1) as {s.name}__n",
                    f"__w * (__y * {e} - greatest({e}, 0D) - log1p(exp(-abs({e})))) as {s.name}__ll",
                    f"__w * (__y - {p}) as {s.name}__r", f"__w * {p} * (1D - {p}) as {s.name}__c"]
        summands += [f"{s.name}__n", f"{s.name}__ll"]
        cols = ["1D", *[f"`{t}`" for t in s.terms]]
        for j, xj in enumerate(cols):
            summands.append(f"{s.name}__r * {xj} as {s.name}__g{j}")
            summands += [f"{s.name}__c * {xj} * {xk} as {s.name}__h{j}_{k}" for k, xk in enumerate(cols[:j + 1])]
    rows = df.selectExpr(*keys, f"double(`{outcome}`) as __y", f"double(`{weight}`) as __w", *xs, *eta)
    rows = rows.selectExpr("*", *prob).selectExpr(*passed, *weights).selectExpr(*keys, *summands)
    return summed(rows, by, [c for c in rows.columns if c not in by])


def _solve(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Newton steps of many groups at once, by elimination in the order of the terms. A term that the ones before
    it explain (constant or collinear covariates) gets no step, as if it were not in the model."""
    h, g, size = hessian.copy(), gradient.copy(), gradient.shape[1]
    used = np.zeros(gradient.shape, dtype=bool)
    for k in range(size):
        pivot = h[:, k, k]
        used[:, k] = pivot > 1e-9 * np.maximum(hessian[:, k, k], 1e-300)
        share = np.where(used[:, k], 1 / np.where(used[:, k], pivot, 1), 0.0)
        for i in range(k + 1, size):
            factor = h[:, i, k] * share
            h[:, i, :] -= factor[:, None] * h[:, k, :]
            g[:, i] -= factor * g[:, k]
    out = np.zeros_like(g)
    for k in reversed(range(size)):
        rest = g[:, k] - (h[:, k, k + 1:] * out[:, k + 1:]).sum(axis=1)
        out[:, k] = np.where(used[:, k], rest / np.where(used[:, k], h[:, k, k], 1), 0.0)
    return out


def _kept(spec: LogitSpec, j: int) -> str:
    return f"{spec.name}__k{j}"


def _advance(specs: Sequence[LogitSpec], tol: float, last: bool):
    """One Newton step for every open group and model of a batch of state rows with their new sums."""

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            for s in specs:
                points, kept = [s.coef(j) for j in range(s.size)], [_kept(s, j) for j in range(s.size)]
                is_open = (pdf[s.status] == _OPEN).to_numpy()
                rows, ll = pdf[f"{s.name}__n"].to_numpy(), pdf[f"{s.name}__ll"].to_numpy(dtype=float)
                at, best = pdf[points].to_numpy(dtype=float), pdf[kept].to_numpy(dtype=float)
                first = np.isnan(pdf[f"{s.name}__start"].to_numpy(dtype=float))
                start = np.where(first, np.abs(ll), pdf[f"{s.name}__start"].to_numpy(dtype=float))
                status = pdf[s.status].to_numpy(dtype=object).copy()
                before = np.where(first, -np.inf, pdf[f"{s.name}__best"].to_numpy(dtype=float))
                empty = is_open & ~(rows > 0)
                worse = is_open & ~empty & (ll < before - 1e-9 * start)
                good = is_open & ~empty & ~worse
                h, g = np.zeros((len(pdf), s.size, s.size)), np.zeros((len(pdf), s.size))
                for j in range(s.size):
                    g[:, j] = pdf[f"{s.name}__g{j}"]
                    for k in range(j + 1):
                        h[:, j, k] = h[:, k, j] = pdf[f"{s.name}__h{j}_{k}"]
                step = _solve(np.where(good[:, None, None], h, np.eye(s.size)), np.where(good[:, None], g, 0.0))
                status[empty] = EMPTY
                status[good & (ll >= -1e-6 * start)] = SEPARATED
                status[good & ((step * g).sum(axis=1) <= tol * start) & (status == _OPEN)] = SETTLED
                if last:
                    status[status == _OPEN] = UNSETTLED
                best = np.where(good[:, None], at, best)  # missing where nothing was evaluated
                moves = np.where(worse[:, None], (at + best) / 2, best + step)
                moves[status != _OPEN] = np.nan
                out[points], out[kept] = moves, best
                out[f"{s.name}__start"] = start
                out[f"{s.name}__best"] = np.where(good, ll, np.where(np.isinf(before), np.nan, before))
                out[s.status] = status
            yield out

    return run


def _blank(specs: Sequence[LogitSpec]) -> dict[str, object]:
    """The state of a group before its first step."""
    out: dict[str, object] = {s.coef(j): 0.0 for s in specs for j in range(s.size)}
    out |= {_kept(s, j): float("nan") for s in specs for j in range(s.size)}
    for s in specs:
        out |= {f"{s.name}__start": float("nan"), f"{s.name}__best": float("nan"), s.status: _OPEN}
    return out


def _is_open(specs: Sequence[LogitSpec]) -> Column:
    some = F.lit(False)
    for s in specs:
        some = some | (F.col(s.status) == _OPEN)
    return some


def _fitted(specs: Sequence[LogitSpec]) -> list[Column]:
    """Coefficients at which each group's last sums were taken, and the statuses."""
    coefs = [F.when(~F.isnan(_kept(s, j)), F.col(_kept(s, j))).alias(s.coef(j)) for s in specs for j in range(s.size)]
    return [*coefs, *[F.col(s.status) for s in specs]]


def _block_sums(state: pd.DataFrame, spec: LogitSpec, starts: np.ndarray, group: np.ndarray, y: np.ndarray, w: np.ndarray,
                x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums of :func:`_step_sums` over rows that lie group by group in memory."""
    columns = [np.ones(len(y)), *[x[t] for t in spec.terms]]
    eta = sum(state[spec.coef(j)].to_numpy(dtype=float)[group] * c for j, c in enumerate(columns))
    there = ~np.isnan(eta)
    columns, eta = [np.where(there, c, 0.0) for c in columns], np.where(there, eta, 0.0)
    p = 1 / (1 + np.exp(-eta))
    seen = np.where(there, w, 0.0)
    left, curve = seen * (y - p), seen * p * (1 - p)
    likely = seen * (y * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta))))
    out = {"n": np.add.reduceat(there.astype(np.int64), starts), "ll": np.add.reduceat(likely, starts)}
    for j, xj in enumerate(columns):
        out[f"g{j}"] = np.add.reduceat(left * xj, starts)
        out |= {f"h{j}_{k}": np.add.reduceat(curve * xj * xk, starts) for k, xk in enumerate(columns[:j + 1])}
    return {f"{spec.name}__{c}": v for c, v in out.items()}


def _solve_block(pdf: pd.DataFrame, specs: Sequence[LogitSpec], tol: float, max_iter: int) -> pd.DataFrame:
    """All Newton steps of the groups of ``pdf``, whose rows lie group by group."""
    numbers = pdf["__group"].to_numpy()
    y, w = pdf["__y"].to_numpy(dtype=float), pdf["__w"].to_numpy(dtype=float)
    x = {t: pdf[t].to_numpy(dtype=float) for s in specs for t in s.terms}
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    state = pd.DataFrame({"__group": numbers[starts], **_blank(specs)})
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(numbers))))
    for i in range(max_iter):
        opened = np.zeros(len(state), dtype=bool)
        for s in specs:
            opened |= (state[s.status] == _OPEN).to_numpy()
        if not opened.any():
            break
        rows = opened[group]
        own, first = np.flatnonzero(opened), np.concatenate([[0], np.cumsum(np.bincount(group[rows], minlength=len(state))[opened])[:-1]])
        now, place = state.iloc[own].reset_index(drop=True), np.cumsum(opened)[group[rows]] - 1
        sums: dict[str, np.ndarray] = {}
        for s in specs:
            sums |= _block_sums(now, s, first, place, y[rows], w[rows], {t: v[rows] for t, v in x.items()})
        moved = next(_advance(specs, tol, i == max_iter - 1)(iter([pd.concat([now, pd.DataFrame(sums)], axis=1)])))
        for c in state.columns:
            values = state[c].to_numpy(copy=True)
            values[own] = moved[c].to_numpy()
            state[c] = values
    return state


def _whole_groups(specs: Sequence[LogitSpec], tol: float, max_iter: int, block: int):
    """Solves the groups of a task that is sorted by them, a block of whole groups at a time."""

    def run(batches):
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < block:
                continue
            pdf = pd.concat(held, ignore_index=True)
            # the last group may go on in the next batch
            whole = int(np.searchsorted(pdf["__group"].to_numpy(), pdf["__group"].iloc[-1]))
            if whole:
                yield _solve_block(pdf.iloc[:whole], specs, tol, max_iter)
            held, rows = [pdf.iloc[whole:]], len(pdf) - whole
        if rows:
            yield _solve_block(pd.concat(held, ignore_index=True), specs, tol, max_iter)

    return run


def _fit_whole(data: DataFrame, groups: DataFrame, by: Sequence[str], outcome: str, weight: str,
               specs: Sequence[LogitSpec], tol: float, max_iter: int) -> DataFrame:
    """Fits of groups that are solved in one task each; ``groups`` numbers them."""
    terms = list(dict.fromkeys(t for s in specs for t in s.terms))
    rows = keyed_join(data, groups.select(*by, "__group"), by, "inner").select(
        "__group", F.col(outcome).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"),
        *[F.col(t).cast("double").alias(t) for t in terms])
    together = rows.repartition("__group").sortWithinPartitions("__group")
    schema = ", ".join(["__group long", *[f"{c} {'string' if v == _OPEN else 'double'}" for c, v in _blank(specs).items()]])
    solved = stage(together.mapInPandas(_whole_groups(specs, tol, max_iter, WHOLE), schema))
    out = keyed_join(groups.select(*by, "__group"), solved, ["__group"], "inner").select(*by, *_fitted(specs))
    return out


def _fit_stepwise(data: DataFrame, groups: DataFrame, by: Sequence[str], outcome: str, weight: str,
                  specs: Sequence[LogitSpec], tol: float, max_iter: int) -> DataFrame:
    """Fits of groups of any size. A step is one job: sums of all rows of open groups, solved and written as the
    next state; how many groups and rows stay open is observed on the way."""
    state = groups.select(*by, "__rows", *[F.lit(v).alias(c) for c, v in _blank(specs).items()])
    points = [s.coef(j) for s in specs for j in range(s.size)]
    owned, rest, total = False, None, None
    for i in range(max_iter):
        sums = _step_sums(keyed_join(data, state.filter(_is_open(specs)).select(*by, *points), by, "inner"), by, specs, outcome, weight)
        names = [c for c in sums.columns if c not in by]
        merged = keyed_join(state, sums, by, "left").fillna(0, names)
        progress = Observation()
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in merged.schema])
        advanced = merged.mapInPandas(_advance(specs, tol, i == max_iter - 1), nullable).drop(*names).observe(
            progress, F.count_if(_is_open(specs)).alias("open"), F.sum(F.when(_is_open(specs), F.col("__rows"))).alias("rows"),
            F.sum("__rows").alias("all"))
        newer = stage(advanced)
        if owned:
            release_staged(state)
        state, owned = newer, True
        left, rows = progress.get["open"], progress.get["rows"] or 0
        total = total or progress.get["all"]
        if not left:
            break
        if rows * 2 <= total and i < max_iter - 1:
            # closed groups are not read again
            kept = stage(keyed_join(data, state.filter(_is_open(specs)).select(*by), by, "inner"))
            if rest is not None:
                release_staged(rest)
            data, rest, total = kept, kept, rows
    if rest is not None:
        release_staged(rest)
    return state.select(*by, *_fitted(specs))


def fit_logit_by(df: DataFrame, by: Sequence[str], outcome: str, weight: str,
                 specs: Sequence[LogitSpec], tol: float = 1e-19, max_iter: int = 16, whole: int = WHOLE) -> DataFrame:
    """Coefficients per ``by`` group, one column per model and term, and each model's status.

    Rows are counted per group first. Groups of at most ``whole`` rows are brought together, many in a task, and
    take all their Newton steps there, in one job. Larger ones stay where they are: each step is one job, a grouped
    sum that serves all their models, solved on the executors and written as the next state. The driver learns only
    how many groups and rows are open; once these are half of the rows or less, only they are staged and read from
    then on. Both ways take the same steps, so ``whole`` changes costs, not results. Coefficients are those at which the
    last sums were taken: a group has settled when the step from there would gain less than ``tol`` of the initial
    log-likelihood. Stage ``df`` if it is costly.
    """
    used = list(dict.fromkeys(t for s in specs for t in s.terms))
    data = df.select(*by, outcome, weight, *used).filter(F.col(outcome).isNotNull() & F.col(weight).isNotNull())
    sizes = Observation()
    groups = stage(data.groupBy(*by).agg(F.count("*").alias("__rows")).withColumn("__group", F.monotonically_increasing_id()).observe(
        sizes, F.count_if(F.col("__rows") <= whole).alias("whole"), F.count_if(F.col("__rows") > whole).alias("large")))
    fits = []
    if sizes.get["large"]:
        fits.append(_fit_stepwise(data, groups.filter(F.col("__rows") > whole), by, outcome, weight, specs, tol, max_iter))
    if sizes.get["whole"] or not fits:
        fits.append(_fit_whole(data, groups.filter(F.col("__rows") <= whole), by, outcome, weight, specs, tol, max_iter))
    return fits[0] if len(fits) == 1 else fits[0].unionByName(fits[1])


def _columns_of(df: DataFrame, formula_side: str) -> list[str]:
    words = re.findall(r"\w+", formula_side)
    return [c for c in df.columns if c in words]


def fit_formula(df: DataFrame, formula: str, weight: str, max_iter: int = 25) -> PipelineModel:
    """Weighted binomial model of an R-style formula over the rows complete in its columns."""
    complete = _numeric_flags(df).dropna(subset=[*_columns_of(df, formula), weight])
    formula_stage = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", weightCol=weight,
                                      maxIter=max_iter, tol=1e-8)
    model = Pipeline(stages=[formula_stage, glm]).fit(complete)
    if model.stages[-1].summary.numIterations >= max_iter:
        # separated outcomes are the usual reason; the rates are next to 0 and 1 by then
        warnings.warn(f"no convergence in {max_iter} steps: {formula}", stacklevel=2)
    return model


def predict_formula(model: PipelineModel, df: DataFrame, formula: str, out: str) -> DataFrame:
    """Add the fitted probability; rows that lack a covariate get a missing one."""
    complete = F.lit(True)
    for c in _columns_of(df, formula.split("~")[1]):
        complete = complete & F.col(c).isNotNull()
    numeric = _numeric_flags(df)
    told = model.transform(numeric.filter(complete)).withColumnRenamed("prediction", out)
    return told.select(*df.columns, out).unionByName(
        numeric.filter(~complete).withColumn(out, F.lit(None).cast("double")))


def _numeric_flags(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("double") for c in flags}) if flags else df
