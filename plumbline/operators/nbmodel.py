"""Negative-binomial Wald test on pseudobulk samples.

A feature's non-zero counts come together in one row; features are fitted side by side within tasks, a
slice of them against all samples of their case at a time, so zeros are never shuffled or stored. Two passes over the
features: likelihood dispersions, of which Spark sums a 1/mean trend and its spread; then dispersions shrunk to
the trend and the test. Results carry the engine label so they are never read as another implementation's digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import normal_pvalue
from plumbline.operators.ordered import attach
from plumbline.session import keep

ENGINE = "pseudobulk sum + NB Wald"
FALLBACK = "pseudobulk sum + Welch on per-unit log1p CPM"
#: Log dispersions tried first; the best is refined between its neighbours, twice.
GRID = np.linspace(np.log(1e-8), np.log(100.0), 48)
#: A fit has converged when no coefficient moves further in a step.
STILL = 1e-8
#: Features times samples in memory at once, and samples sent to all tasks at most; more travel with their features.
CELLS, SENT = 1 << 20, 1_000_000


def size_factors(totals: DataFrame, samples: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Median-of-ratios over features seen in every sample; depth ratios where there are none."""
    sk = [*by, *keys]
    n = samples.groupBy(*by).agg(F.count("*").alias("__n"))
    gm = (
        totals.groupBy(*by, "gene")
        .agg(F.avg(F.log("total")).alias("__lm"), F.count("*").alias("__k"))
        .join(n, by)
        .filter(F.col("__k") == F.col("__n"))
        .select(*by, "gene", "__lm")
    )
    med = (
        totals.join(gm, [*by, "gene"])
        .groupBy(*sk)
        .agg(F.exp(F.percentile(F.log("total") - F.col("__lm"), F.lit(0.5))).alias("__s"))
    )
    depth = totals.groupBy(*sk).agg(F.sum("total").alias("__d"))
    mean_depth = depth.groupBy(*by).agg(F.avg("__d").alias("__md"))
    return (
        samples.join(depth, sk)
        .join(mean_depth, by)
        .join(med, sk, "left")
        .withColumn("size", F.coalesce("__s", F.col("__d") / F.col("__md")))
        .drop("__s", "__d", "__md")
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift beyond 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    i = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x - shift


def _means(beta: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(beta @ x.T, -30, 30)) * size


def _coefficients(y, x, size, alpha, beta=None, steps=100):
    """Coefficients of every feature (row of y) at its dispersion by scoring steps, and whether they stood still."""
    k = x.shape[1]
    if beta is None:
        beta = np.linalg.lstsq(x, np.log((y + 0.5) / size).T, rcond=None)[0].T
    still = np.zeros(len(y), bool)
    ridge = np.eye(k) * 1e-12
    for _ in range(steps):
        mu = _means(beta, x, size)
        w = mu / (1 + alpha[:, None] * mu)
        score = (w * (y - mu) / mu) @ x
        step = np.linalg.solve(np.einsum("fs,si,sj->fij", w, x, x) + ridge, score[:, :, None])[:, :, 0]
        step = np.clip(step, -2, 2)
        beta = np.where(still[:, None], beta, beta + step)
        still |= np.abs(step).max(axis=1) < STILL
        if still.all():
            break
    return beta, still


def _likelihood(y, mu, x, log_alpha):
    """Log likelihood of each feature at its dispersion with means held, less half the log determinant of the information."""
    a = np.exp(log_alpha)[:, None]
    r = 1 / a
    seen = y > 0
    terms = np.where(seen, _log_gamma(y + r) - _log_gamma(np.broadcast_to(r, y.shape)) + y * np.log(a * np.maximum(mu, 1e-300)), 0.0)
    ll = (terms - (y + r) * np.log1p(a * mu)).sum(axis=1)
    info = np.einsum("fs,si,sj->fij", mu / (1 + a * mu), x, x)
    return ll - 0.5 * np.linalg.slogdet(info)[1]


def _best_dispersion(y, mu, x, centre=None, spread=None):
    """Log dispersion of the largest likelihood, or with a prior of that mean and variance."""

    def value(at):
        out = _likelihood(y, mu, x, at)
        return out if centre is None else out - (at - centre) ** 2 / (2 * spread)

    points = np.repeat(GRID[None], len(y), axis=0)
    for _ in range(3):
        tried = np.stack([value(points[:, j]) for j in range(points.shape[1])], axis=1)
        best = np.take_along_axis(points, tried.argmax(axis=1)[:, None], 1)[:, 0]
        gap = points[:, 1] - points[:, 0]
        points = np.clip(best[:, None] + np.linspace(-1, 1, 15)[None] * gap[:, None], GRID[0], GRID[-1])
    return best


def _case_arrays(rows: pd.DataFrame, width: int):
    ids = {s: i for i, s in enumerate(rows["sample"])}
    return ids, np.array(rows["x"].tolist(), float), rows["size"].to_numpy(float)


def _fitted(by: list[str], shared, prior: bool):
    """(by, gene, ids, ys): first the likelihood dispersion; with a prior at hand, the shrunk one and the test."""

    def one(y, x, size, rows):
        full = np.linalg.matrix_rank(x) == x.shape[1] and len(x) > x.shape[1]
        nothing = np.full(len(y), np.nan)
        base = (y / size).mean(axis=1)
        if not full:
            return dict(base_mean=base, log_alpha=nothing, effect=nothing, se=nothing, beta=[None] * len(y), converged=False)
        start = np.full(len(y), 0.1)
        if prior:
            start = np.exp(rows["trend"].to_numpy(float))
        beta, _ = _coefficients(y, x, size, start)
        mu = _means(beta, x, size)
        if prior:
            la = _best_dispersion(y, mu, x, rows["trend"].to_numpy(float), rows["spread"].to_numpy(float))
        else:
            for _ in range(2):  # means at the dispersion found, then the dispersion again
                la = _best_dispersion(y, mu, x)
                beta, _ = _coefficients(y, x, size, np.exp(la), beta)
                mu = _means(beta, x, size)
        beta, still = _coefficients(y, x, size, np.exp(la), beta)
        mu = _means(beta, x, size)
        info = np.einsum("fs,si,sj->fij", mu / (1 + np.exp(la)[:, None] * mu), x, x)
        se = np.sqrt(np.maximum(np.linalg.inv(info + np.eye(x.shape[1]) * 1e-12)[:, 1, 1], 0)) if x.shape[1] > 1 else nothing
        effect = beta[:, 1] if x.shape[1] > 1 else nothing
        return dict(base_mean=base, log_alpha=la, effect=effect, se=se, beta=list(beta), converged=still)

    def run(batches):
        for pdf in batches:
            for case, rows in pdf.groupby(by, sort=False, dropna=False):
                if shared is not None:
                    ids, x, size = shared.value[case]
                else:
                    first = rows.iloc[0]
                    ids, x, size = {s: i for i, s in enumerate(first["all_ids"])}, np.array(first["all_x"].tolist(), float), np.array(first["all_size"], float)
                for lo in range(0, len(rows), max(1, CELLS // len(size))):
                    part = rows.iloc[lo : lo + max(1, CELLS // len(size))]
                    y = np.zeros((len(part), len(size)))
                    for i, (names, values) in enumerate(zip(part["ids"], part["ys"], strict=True)):
                        y[i, [ids[s] for s in names]] = values
                    yield part[[*by, "gene"]].assign(**one(y, x, size, part))

    return run


def nb_wald(totals: DataFrame, samples: DataFrame, by: list[str], keys: list[str], design: list) -> DataFrame:
    """Wald p of the second design column (alternate vs reference) for every feature.

    `totals` has by + keys + gene + total (non-zero); `samples` one row per sample carrying the factor columns;
    `design` is a list of column expressions, intercept first. Dispersion is the maximum of the likelihood adjusted
    for the coefficients, on a refined grid, then the same with a normal prior in log space around a 1/mean trend.
    `converged` tells whether a feature's coefficients stood still; where they did not there is no p. A feature holds
    one number per sample of its case, so what one row carries is bounded by the samples.
    """
    totals = keep(totals.select(*by, *keys, "gene", "total"), "totals")
    name = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys]).alias("sample")
    sized = size_factors(totals, samples, by, keys).withColumn("x", F.array(*[c.cast("double") for c in design]))
    sized = keep(sized.select(*by, name, "x", "size"), "sized")
    rows = totals.groupBy(*by, "gene").agg(F.collect_list(F.struct(name, F.col("total").cast("double").alias("y"))).alias("v"))
    rows = keep(rows.select(*by, "gene", F.col("v.sample").alias("ids"), F.col("v.y").alias("ys")), "features")
    shared = None
    if sized.count() <= SENT:
        known = sized.orderBy(*by, "sample").toPandas()
        arrays = {case: _case_arrays(part, len(design)) for case, part in known.groupby(by, sort=False, dropna=False)}
        shared = totals.sparkSession.sparkContext.broadcast(arrays)
    else:
        every = sized.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sample", "x", "size"))).alias("a"))
        rows = rows.join(every.select(*by, F.col("a.sample").alias("all_ids"), F.col("a.x").alias("all_x"), F.col("a.size").alias("all_size")), by)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", gene string, base_mean double, log_alpha double, effect double, se double, beta array<double>, converged boolean"
    first = keep(rows.mapInPandas(_fitted(by, shared, False), schema), "dispersions")
    told = first.where("not isnan(log_alpha) and base_mean > 0").select(*by, "base_mean", "log_alpha", F.exp("log_alpha").alias("raw"))
    inverse = 1 / F.col("base_mean")
    line = told.groupBy(*by).agg(F.regr_slope("raw", inverse).alias("a1"), F.avg("raw").alias("avg"), F.avg(inverse).alias("im"))
    height = lambda m: F.log(F.greatest(F.col("avg") + F.coalesce("a1", F.lit(0.0)) * (1 / m - F.col("im")), F.lit(1e-8)))
    far = attach(told, line, by).select(*by, (F.col("log_alpha") - height(F.col("base_mean"))).alias("e"))
    middle = far.groupBy(*by).agg(F.percentile("e", F.lit(0.5)).alias("mid"))
    spread = attach(far, middle, by).groupBy(*by).agg(F.percentile(F.abs(F.col("e") - F.col("mid")), F.lit(0.5)).alias("mad"))
    # What is left of the spread around the trend after that of a dispersion estimated from so many samples.
    free = sized.groupBy(*by).agg(F.greatest(F.count("*") - F.lit(len(design)), F.lit(1)).alias("free"))
    z = F.col("free") / 2
    noise = 1 / z + 1 / (2 * z * z) + 1 / (6 * z * z * z)
    prior = line.join(spread, by).join(free, by).select(*by, "avg", "a1", "im", F.greatest(F.pow(F.col("mad") * 1.4826, 2) - noise, F.lit(0.25)).alias("spread"))
    second = attach(rows.join(first.select(*by, "gene", "base_mean"), [*by, "gene"]), keep(prior, "prior"), by, "left")
    second = second.withColumn("trend", F.coalesce(height(F.col("base_mean")), F.lit(float(np.log(0.1))))).withColumn("spread", F.coalesce("spread", F.lit(1.0)))
    fit = second.select(*rows.columns, "trend", "spread").mapInPandas(_fitted(by, shared, True), schema)
    p = normal_pvalue("stat")
    return (
        fit.withColumn("alpha", F.exp("log_alpha"))
        .withColumn("log2fc", F.col("effect") / F.log(F.lit(2.0)))
        .withColumn("stat", F.col("effect") / F.col("se"))
        .withColumn("p", p)
        .select(*by, "gene", "base_mean", "alpha", "log2fc", "se", "stat", F.when(F.col("converged") & ~F.isnan("p"), F.col("p")).alias("p"), "converged", "beta")
        .withColumn("engine", F.lit(ENGINE))
    )
