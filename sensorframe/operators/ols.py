"""Many small linear models at once.

Spark aggregates counts, means and covariances per model cell (one pass, combined before the shuffle, so
a cell may hold any share of the rows). What is left per cell is one row of at most a few dozen numbers;
the small linear algebra on that row runs in ``mapInPandas``, spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.clean import complete_cases
from sensorframe.operators.reshape import spread
from sensorframe.operators.tails import f_upper, t_two_sided

INTERCEPT = "(Intercept)"
ALIAS_TOLERANCE = 1e-7


def moments(
    df: DataFrame, keys: Sequence[str], response: str, predictors: Sequence[str], eligible: Column | None = None
) -> DataFrame:
    """Count, means and covariances of the complete rows of every cell.

    ``means`` holds the predictors, then the response; ``cov`` is the upper triangle of their
    population covariances, row by row. ``eligible``, an expression over the keys, gives an array of
    booleans that says which predictors a cell may use; rows must be complete in all of them.
    """
    names = [*predictors, response]
    rows = complete_cases(df, [*keys, *names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nobs"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
    )
    mask = F.array(*[F.lit(True)] * len(predictors)) if eligible is None else eligible
    return out.withColumn("eligible", mask)


def stack_responses(
    df: DataFrame, ids: Sequence[str], responses: Sequence[str], name: str = "resp", value: str = "y"
) -> DataFrame:
    """One row per response, so that the response becomes part of the model cell."""
    return df.unpivot(list(ids), list(responses), name, value)


def _square(cov: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cov
    return out + np.triu(out, 1).T


def _independent(s: np.ndarray, columns: Sequence[int]) -> list[int]:
    """Predictors, in order, that are not a linear combination of those before them."""
    kept: list[int] = []
    for j in columns:
        if not s[j, j] > 0:
            continue
        left = s[j, j]
        if kept:
            left -= s[j, kept] @ np.linalg.solve(s[np.ix_(kept, kept)], s[kept, j])
        if left > ALIAS_TOLERANCE**2 * s[j, j]:
            kept.append(j)
    return kept


class Fit:
    """A linear model with intercept over a subset of predictors, from moments alone."""

    def __init__(self, nobs: int, means: np.ndarray, s: np.ndarray, columns: Sequence[int]):
        self.n, self.means, self.s = nobs, means, s
        self.y = len(means) - 1
        self.columns = list(columns)
        self.kept = _independent(s, self.columns)
        k = self.kept
        self.beta = np.linalg.solve(s[np.ix_(k, k)], s[k, self.y]) if k else np.zeros(0)
        self.tss = nobs * s[self.y, self.y]
        explained = nobs * float(self.beta @ s[k, self.y]) if k else 0.0
        self.rss = max(self.tss - explained, 0.0)
        self.rank = len(k) + 1
        self.df_residual = nobs - self.rank

    def aic_step(self) -> float:
        return self.n * math.log(self.rss / self.n) + 2 * self.rank if self.rss > 0 else -math.inf

    def coefficients(self, predictors: Sequence[str]) -> list[tuple]:
        k = self.kept
        inverse = np.linalg.inv(self.s[np.ix_(k, k)]) / self.n if k else np.zeros((0, 0))
        m = self.means[k]
        estimates = [float(self.means[self.y] - m @ self.beta), *map(float, self.beta)]
        variances = [1.0 / self.n + float(m @ inverse @ m), *map(float, np.diag(inverse))]
        by_column = dict(zip([None, *k], zip(estimates, variances)))
        rows = []
        for c in [None, *self.columns]:
            term = INTERCEPT if c is None else predictors[c]
            if c not in by_column:
                rows.append((term, None, None, None, None))
                continue
            b, v = by_column[c]
            if self.df_residual <= 0:
                rows.append((term, b, None, None, None))
                continue
            se = math.sqrt(v * self.rss / self.df_residual)
            t = b / se if se > 0 else math.copysign(math.inf, b) if b else math.nan
            rows.append((term, b, se, t, t_two_sided(t, self.df_residual)))
        return rows

    def summary(self) -> tuple:
        n, df1, df2, rss = self.n, self.rank - 1, self.df_residual, self.rss
        r2 = 1 - rss / self.tss if self.tss > 0 else math.nan
        sigma = math.sqrt(rss / df2) if df2 > 0 else math.nan
        adjusted = 1 - (1 - r2) * (n - 1) / df2 if df2 > 0 else math.nan
        f = p = math.nan
        if df1 > 0 and df2 > 0 and rss > 0:
            f = (self.tss - rss) / df1 / (rss / df2)
            p = f_upper(f, df1, df2)
        log_lik = -0.5 * n * (math.log(2 * math.pi) + 1 + math.log(rss / n)) if rss > 0 else math.inf
        estimated = self.rank + 1
        aic, bic = 2 * estimated - 2 * log_lik, math.log(n) * estimated - 2 * log_lik
        return (r2, adjusted, sigma, f, p, float(df1), log_lik, aic, bic, rss, df2, n)


def stepwise(full: Fit) -> Fit:
    """Drop or re-add one predictor at a time while the information criterion falls."""
    scope, current = full.kept, full
    current = Fit(full.n, full.means, full.s, scope)
    while current.rss > 0:
        moves = [[c for c in current.kept if c != out] for out in current.kept]
        moves += [sorted([*current.kept, new]) for new in scope if new not in current.kept]
        fits = [Fit(full.n, full.means, full.s, m) for m in moves]
        best = min(fits, key=Fit.aic_step, default=current)
        if not best.aic_step() < current.aic_step() - 1e-7:
            break
        current = best
    return current


COEF = "term string, estimate double, std_error double, statistic double, p_value double"
FIT = (
    "r_squared double, adj_r_squared double, sigma double, statistic double, p_value double, df double, "
    "log_lik double, aic double, bic double, deviance double, df_residual long, nobs long"
)
MODEL = "nobs long, means array<double>, cov array<double>, beta array<double>, in_model array<boolean>"


def cell_fit(row, step: bool) -> Fit:
    """The model of one cell of moments, full or after stepwise selection."""
    means = np.asarray(row.means, dtype=float)
    s = _square(row.cov, len(means))
    full = Fit(int(row.nobs), means, s, [i for i, ok in enumerate(row.eligible) if ok])
    return stepwise(full) if step else full


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys] + [rest])


def _per_cell(cells: DataFrame, keys: Sequence[str], predictors: Sequence[str], step: bool, rest: str, rows_of) -> DataFrame:
    keys, predictors = list(keys), list(predictors)
    schema = _schema(cells, keys, rest)
    names = [*keys, *[part.split()[0] for part in rest.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                out += [key + tuple(r) for r in rows_of(row, cell_fit(row, step), predictors)]
            yield pd.DataFrame(out, columns=names)

    return spread(cells, keys).mapInPandas(run, schema)


def coefficients(cells: DataFrame, keys: Sequence[str], predictors: Sequence[str], step: bool = False) -> DataFrame:
    """One row per term; a term that depends linearly on earlier ones has missing values."""
    return _per_cell(cells, keys, predictors, step, COEF, lambda row, fit, names: fit.coefficients(names))


def fit_summaries(cells: DataFrame, keys: Sequence[str], predictors: Sequence[str], step: bool = False) -> DataFrame:
    """One row of fit statistics per model."""
    return _per_cell(cells, keys, predictors, step, FIT, lambda row, fit, names: [fit.summary()])


def models(cells: DataFrame, keys: Sequence[str], predictors: Sequence[str], step: bool = False) -> DataFrame:
    """Moments and slopes per cell, in the order of ``predictors``; unused slopes are zero."""

    def rows_of(row, fit: Fit, names):
        beta = np.zeros(len(names))
        beta[fit.kept] = fit.beta
        used = [i in fit.columns for i in range(len(names))]
        return [(row.nobs, list(row.means), list(row.cov), beta.tolist(), used)]

    return _per_cell(cells, keys, predictors, step, MODEL, rows_of)


def trend_lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line per group: slope, intercept and squared correlation."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )
