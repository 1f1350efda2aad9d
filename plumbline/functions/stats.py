"""Scalar statistics over already-reduced rows: Welch, tails, small linear solves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL_DF = 1e6


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation of the incomplete-beta continued fraction."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    live = np.ones(x.shape, dtype=bool)
    for m in range(1, 5000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = np.where(live, h * step, h)
        live &= np.abs(step - 1.0) > 1e-15
        if not live.any():
            break
    return h


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided Student-t tail for real df; NaN in, NaN out."""
    t = np.abs(np.asarray(t, dtype=float))
    df = np.asarray(df, dtype=float)
    t, df = np.broadcast_arrays(t, df)
    out = np.full(t.shape, np.nan)
    big = np.isfinite(t) & (df > _NORMAL_DF)
    if big.any():
        z = t[big] * (1 - 1 / (4 * df[big])) / np.sqrt(1 + t[big] ** 2 / (2 * df[big]))
        out[big] = [math.erfc(v / math.sqrt(2)) for v in z]
    ok = np.isfinite(t) & (df > 0) & (df <= _NORMAL_DF)
    if ok.any():
        tt, nu = t[ok], df[ok]
        a, b = nu / 2, np.full(nu.shape, 0.5)
        denom = nu + tt**2
        x, y = nu / denom, tt**2 / denom
        log_beta = np.array([math.lgamma(v) - math.lgamma(v + 0.5) for v in a]) + math.lgamma(0.5)
        with np.errstate(divide="ignore", under="ignore"):
            front = np.exp(a * np.log(x) + b * np.log(y) - log_beta)
        low = x < (a + 1) / (a + b + 2)
        p = np.where(
            low,
            front * _beta_fraction(a, b, np.where(low, x, 0.5)) / a,
            1.0 - front * _beta_fraction(b, a, np.where(low, 0.5, y)) / b,
        )
        out[ok] = np.where(tt == 0, 1.0, np.clip(p, 0.0, 1.0))
    out[np.isinf(t)] = 0.0
    return out


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student-t p over per-feature rows (no Spark builtin has this tail)."""
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided normal p."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan"))


def welch_columns(m0: Column, v0: Column, n0: Column, m1: Column, v1: Column, n1: Column) -> tuple[Column, Column]:
    """(t, Satterthwaite df) of alternate minus reference; se = 0 gives t = 0."""
    s0, s1 = F.try_divide(v0, n0), F.try_divide(v1, n1)
    se2 = s0 + s1
    t = F.when(se2 > 0, (m1 - m0) / F.sqrt(se2)).otherwise(F.lit(0.0))
    denom = F.try_divide(s0 * s0, n0 - 1) + F.try_divide(s1 * s1, n1 - 1)
    df = F.when(denom > 0, se2 * se2 / denom).otherwise((n0 + n1 - 2).cast("double"))
    return t, df


def guarded_p(t: Column, df: Column, n0: Column, n1: Column) -> Column:
    """p = 1 whenever an arm has fewer than two rows or the statistic is not finite."""
    enough = (n0 >= 2) & (n1 >= 2)
    p = t_pvalue(F.when(enough, t), F.when(enough, df))
    return F.when(enough & p.isNotNull() & ~F.isnan(p), F.greatest(p, F.lit(1e-300))).otherwise(F.lit(1.0))


def variance_from_sums(s1: Column, s2: Column, n: Column) -> Column:
    """Sample variance from power sums; clipped at 0 against cancellation."""
    return F.when(n > 1, F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))


def _solve_fit(k: int, xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, j: int):
    """(beta_j, se_j, dof) from normal equations; None where the design is rank short."""
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = xtx
    a = a + np.triu(a, 1).T
    dof = n - k
    if dof <= 0 or np.linalg.matrix_rank(a) < k:
        return None
    inv = np.linalg.inv(a)
    beta = inv @ xty
    rss = max(float(yty - beta @ xty), 0.0)
    if rss <= 1e-12 * max(abs(yty), 1e-300):
        rss = 0.0
    return float(beta[j]), math.sqrt(rss / dof * inv[j, j]), dof


def ols_pvalue(k: int, j: int):
    """Arrow UDF: packed upper-triangle X'X, X'y, y'y, n -> p of coefficient j.

    Only k(k+3)/2 sums per feature reach Python, whatever the number of samples.
    """

    @F.pandas_udf(T.DoubleType())
    def solve(xtx: pd.Series, xty: pd.Series, yty: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, c, m in zip(xtx, xty, yty, n):
            fit = _solve_fit(k, np.asarray(a, float), np.asarray(b, float), float(c), float(m), j)
            if fit is None:
                out.append(None)
            elif fit[1] <= 0:
                out.append(1.0)
            else:
                out.append(float(t_two_sided(fit[0] / fit[1], fit[2])))
        return pd.Series(out, dtype="float64")

    return solve
