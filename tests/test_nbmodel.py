"""The count model: score equations, dispersions beside a dense optimiser, shrinkage, awkward designs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import nbmodel

BY, KEYS = ["case_id"], ["unit", "arm"]


def two_arms():
    return [F.lit(1.0), F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)]


def planted(spark, cases=("a", "b"), genes=30, units=12, seed=0):
    rng = np.random.default_rng(seed)
    y, samples, totals = {}, [], []
    for c in cases:
        size = rng.uniform(0.5, 2, 2 * units)
        arm = np.repeat([0, 1], units)
        for s in range(2 * units):
            samples.append((c, f"u{s}", "alt" if arm[s] else "ref"))
        for g in range(genes):
            alpha = [0.05, 0.3, 1.0][g % 3]
            mean = size * rng.uniform(5, 60) * np.where(arm & (g % 5 == 0), 4, 1)
            y[c, f"g{g}"] = rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mean))
            totals += [(c, f"u{s}", "alt" if arm[s] else "ref", f"g{g}", int(v)) for s, v in enumerate(y[c, f"g{g}"]) if v]
    return y, spark.createDataFrame(totals, "case_id string, unit string, arm string, gene string, total long"), spark.createDataFrame(samples, "case_id string, unit string, arm string")


def test_log_gamma():
    x = np.concatenate([np.logspace(-6, 6, 200), np.arange(1.0, 30)])
    assert nbmodel._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


def profile(y, mu, x, alpha):
    r = 1 / alpha
    ll = sum(math.lgamma(v + r) - math.lgamma(r) + r * math.log(r / (r + m)) + v * math.log(m / (r + m)) for v, m in zip(y, mu))
    return ll - 0.5 * np.linalg.slogdet(x.T @ (x * (mu / (1 + alpha * mu))[:, None]))[1]


def test_dispersion_is_the_likelihoods_best(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(16), np.repeat([0.0, 1.0], 8)])
    size = rng.uniform(0.5, 2, 16)
    y = np.array([rng.negative_binomial(1 / a, 1 / (1 + a * 20 * size)) for a in (0.05, 0.4, 2.0)], float)
    beta, still = nbmodel._coefficients(y, x, size, np.full(3, 0.3))
    mu = nbmodel._means(beta, x, size)
    got = nbmodel._best_dispersion(y, mu, x)
    assert still.all()
    for f in range(3):
        fine = np.linspace(math.log(1e-8), math.log(100), 6001)
        values = [profile(y[f], mu[f], x, math.exp(v)) for v in fine]
        want = fine[int(np.argmax(values))]
        assert profile(y[f], mu[f], x, math.exp(got[f])) >= max(values) - 1e-4
        assert want < -10 or got[f] == pytest.approx(want, abs=0.01)  # below, the likelihood is flat


def test_scores_are_zero_and_p_follow(spark):
    y, totals, samples = planted(spark)
    sized = {(r.case_id, r.unit): r["size"] for r in nbmodel.size_factors(totals, samples, BY, KEYS).collect()}
    arm = {(r.case_id, r.unit): r.arm == "alt" for r in samples.collect()}
    rows = nbmodel.nb_wald(totals, samples, BY, KEYS, two_arms()).collect()
    assert len(rows) == 60
    for r in rows:
        units = [u for c, u in sized if c == r.case_id]
        values = y[r.case_id, r.gene]
        at = np.array([values[int(u[1:])] for u in units], float)
        x = np.array([[1.0, float(arm[r.case_id, u])] for u in units])
        mu = np.exp(x @ np.array(r.beta)) * np.array([sized[r.case_id, u] for u in units])
        score = ((at - mu) / (1 + r.alpha * mu)) @ x
        assert r.converged and np.abs(score).max() < 1e-5 * max(1, at.sum())
        assert r.stat == pytest.approx(r.log2fc * math.log(2) / r.se) and r.p == pytest.approx(math.erfc(abs(r.stat) / math.sqrt(2)), rel=1e-6, abs=1e-12)
    small = {r.gene: r for r in rows if r.case_id == "a"}
    assert np.median([small[f"g{g}"].p for g in range(0, 30, 5)]) < 0.01 < np.median([small[f"g{g}"].p for g in range(30) if g % 5])
    by_planted = [np.median([r.alpha for r in rows if int(r.gene[1:]) % 3 == k]) for k in range(3)]
    assert by_planted[0] < by_planted[1] < by_planted[2]


def test_awkward_designs_and_samples(spark, monkeypatch):
    _, totals, samples = planted(spark, cases=("a",), genes=6, units=3)
    twin = nbmodel.nb_wald(totals, samples, BY, KEYS, [F.lit(1.0), F.lit(2.0)]).collect()
    assert len(twin) == 6 and all(r.p is None and not r.converged for r in twin)
    want = {r.gene: r.p for r in nbmodel.nb_wald(totals, samples, BY, KEYS, two_arms()).collect()}
    monkeypatch.setattr(nbmodel, "SENT", 0)
    monkeypatch.setattr(nbmodel, "CELLS", 10)
    got = {r.gene: r.p for r in nbmodel.nb_wald(totals, samples, BY, KEYS, two_arms()).collect()}
    assert got == pytest.approx(want)
    assert nbmodel.nb_wald(totals.limit(0), samples, BY, KEYS, two_arms()).count() == 0
