"""Least squares with fixed effects and heteroskedasticity-robust errors.

Two passes over the data: sums of products of the design columns, and, once the coefficients are known, residual sums and
products weighted by squared residuals. Each pass is one aggregate with map-side sums of p * (p + 1) / 2 numbers; only these
sums, as large as the number of parameters squared, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_quantile, t_two_sided


def design(df: DataFrame, outcome: str, predictors: Sequence[str], fixed_effects: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Rows without nulls in what is used, and the design columns: const, predictors (dummies of those that aren't numeric, but
    for the first level), FE_<column>_<level> but for the first level."""
    missing = [c for c in (outcome, *predictors, *fixed_effects) if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    rows = df.dropna(subset=[outcome, *predictors, *fixed_effects])
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean")}
    columns: list[tuple[str, Column]] = [("const", F.lit(1.0))]

    def dummies(c: str, prefix: str) -> list[tuple[str, Column]]:
        levels = sorted(str(r[0]) for r in rows.select(F.col(c).cast("string")).distinct().collect())  # one parameter each
        return [(f"{prefix}{c}_{x}", F.when(F.col(c).cast("string") == x, 1.0).otherwise(0.0)) for x in levels[1:]]

    for c in predictors:
        columns += [(c, F.col(c).cast("int").cast("double") if df.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("double"))] if c in numeric else dummies(c, "")
    for c in fixed_effects:
        columns += dummies(c, "FE_")
    return rows, columns


def gram(rows: DataFrame, columns: Sequence[Column], y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'WX, X'Wy, y'Wy, sum of y and the number of rows."""
    w = F.lit(1.0) if weight is None else weight
    p = len(columns)
    aggs = [F.sum(w * columns[i] * columns[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * c * y) for c in columns] + [F.sum(w * y * y), F.sum(y), F.count(F.lit(1))]
    v = list(rows.agg(*(a.alias(f"s{i}") for i, a in enumerate(aggs))).first())
    if not v[-1]:
        raise ValueError("no complete rows")
    m, at = np.zeros((p, p)), 0
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = v[at]
            at += 1
    return m, np.array(v[at : at + p], float), float(v[-3]), float(v[-2]), int(v[-1])


def independent(m: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns that the ones before them don't explain, from left to right, by elimination on the scaled sums of products."""
    d = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    s, kept, basis = m / np.outer(d, d), [], []
    for j in range(len(m)):
        v = s[:, j].copy()
        for b, pivot in basis:
            v -= b * (b[j] / pivot)
        if m[j, j] > 0 and v[j] > tolerance:
            basis.append((v, v[j]))
            kept.append(j)
    return kept


@dataclass
class Fit:
    names: list[str]
    dropped: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    r2: float
    adjusted_r2: float
    rmse: float
    robust: str
    outcome: str

    @property
    def table(self) -> list[tuple[str, float, float, float, float, float, float]]:
        """(term, coefficient, standard error, t, p, low, high) with 95 % intervals."""
        df = self.n - len(self.beta)
        q = t_quantile(0.975, df)
        out = []
        for name, b, v in zip(self.names, self.beta.tolist(), np.diag(self.covariance).tolist()):
            se = math.sqrt(max(v, 0.0))
            t = b / se if se else math.nan
            out.append((name, b, se, t, t_two_sided(t, df), b - q * se, b + q * se))
        return out

    def report(self) -> str:
        lines = [f"outcome: {self.outcome}", f"observations: {self.n}, parameters: {len(self.beta)}, errors: {self.robust}", f"R2 {self.r2:.6f}, adjusted {self.adjusted_r2:.6f}, RMSE {self.rmse:.6f}"]
        lines += [f"dropped as redundant: {', '.join(self.dropped)}"] if self.dropped else []
        lines += [f"{n:40s} {b: .6f} {se:.6f} {t: .4f} {p:.4g} [{lo: .6f}, {hi: .6f}]" for n, b, se, t, p, lo, hi in self.table]
        return "\n".join(lines)


def fit_ols(df: DataFrame, outcome: str, predictors: Sequence[str], fixed_effects: Sequence[str] = (), robust: str = "HC1") -> Fit:
    rows, named = design(df, outcome, predictors, fixed_effects)
    y = F.col(outcome).cast("double")
    m, xy, yy, sy, n = gram(rows, [c for _, c in named], y)
    kept = independent(m)
    names, columns = [named[i][0] for i in kept], [named[i][1] for i in kept]
    p = len(kept)
    if n <= p:
        raise ValueError(f"{n} rows for {p} parameters")
    a = m[np.ix_(kept, kept)]
    d = np.sqrt(np.diag(a))
    inverse = np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)
    beta = inverse @ xy[kept]
    fitted = _sum(c * float(b) for c, b in zip(columns, beta))
    e = y - fitted
    with_error = rows.withColumn("_e2", e * e)
    if robust == "HC1":
        meat = gram(with_error, columns, F.lit(1.0), F.col("_e2"))[0]
        sse = float(meat[0, 0])  # const: the sum of squared residuals
        covariance = n / (n - p) * inverse @ meat @ inverse
    else:
        sse = with_error.agg(F.sum("_e2")).first()[0]
        covariance = sse / (n - p) * inverse
    sst = rows.agg(F.sum((y - F.lit(sy / n)) * (y - F.lit(sy / n)))).first()[0]
    r2 = 1 - sse / sst if sst else math.nan
    return Fit(names, [named[i][0] for i in range(len(named)) if i not in kept], beta, covariance, n, r2, 1 - (1 - r2) * (n - 1) / (n - p), math.sqrt(sse / (n - p)), robust, outcome)


def _sum(parts) -> Column:
    out = F.lit(0.0)
    for x in parts:
        out = out + x
    return out


def with_fitted(df: DataFrame, fit: Fit, predictors: Sequence[str], fixed_effects: Sequence[str] = ()) -> DataFrame:
    """The complete rows with `fitted` and `residual`."""
    rows, named = design(df, fit.outcome, predictors, fixed_effects)
    columns = dict(named)
    fitted = _sum(columns[n] * float(b) for n, b in zip(fit.names, fit.beta))
    return rows.withColumn("fitted", fitted).withColumn("residual", F.col(fit.outcome) - F.col("fitted"))


def within(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Columns less their group means."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
