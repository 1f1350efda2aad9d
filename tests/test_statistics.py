import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws
from plumbline.functions.stats import t_two_sided
from plumbline.operators import inference as inf
from plumbline.operators import inventory as inv
from plumbline.operators import ordered
from plumbline.operators import separation as sep


@pytest.fixture
def many_ranges(spark):
    """Small tables keep all their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_t_tail_known_values():
    assert t_two_sided(2.0, 10.0) == pytest.approx(0.0733880347707404, rel=1e-10)
    assert t_two_sided(1.0, 1.0) == pytest.approx(0.5, rel=1e-12)
    assert t_two_sided(3.0, 2.0) == pytest.approx(1 - 3 / math.sqrt(2 + 9), rel=1e-10)
    assert t_two_sided(0.0, 5.0) == 1.0
    assert t_two_sided(1.96, 1e9) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-6)
    assert math.isnan(t_two_sided(float("nan"), 3.0))
    assert t_two_sided(8.0, 51840.0) == pytest.approx(1.27e-15, rel=0.02)


def brute_fdr(p, by):
    p = np.asarray(p, float)
    ok = np.flatnonzero(~np.isnan(p))
    m = len(ok)
    c = sum(1 / i for i in range(1, m + 1)) if by else 1.0
    order = ok[np.argsort(p[ok], kind="mergesort")]
    q, low = np.full(len(p), np.nan), 1.0
    for rank in range(m, 0, -1):
        low = min(low, p[order[rank - 1]] * m * c / rank)
        q[order[rank - 1]] = low
    return q


VECTORS = [
    [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205],
    [0.04] * 5,
    list(np.random.default_rng(0).uniform(size=200)),
    [1e-9] * 10 + list(np.random.default_rng(1).uniform(size=90)),
    [0.01, float("nan"), 0.02, 0.5],
]


@pytest.mark.parametrize("method", ["bh", "by"])
def test_fdr_matches_step_up(spark, many_ranges, method):
    rows = [(str(v), i, float(p)) for v, vec in enumerate(VECTORS) for i, p in enumerate(vec)]
    df = spark.createDataFrame(rows, "v string, i int, p double")
    got = {(r.v, r.i): r.q for r in inf.fdr(df, ["v"], method).collect()}
    for v, vec in enumerate(VECTORS):
        for i, q in enumerate(brute_fdr(vec, method == "by")):
            have = got[(str(v), i)]
            assert (have is None) == math.isnan(q)
            if have is not None:
                assert have == pytest.approx(q, rel=1e-12)


def test_harmonic_expansion(spark):
    ms = [1, 2, 64, 65, 1000, 100000]
    got = spark.createDataFrame([(m,) for m in ms], "m long").select("m", inf.harmonic(F.col("m")).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx(sum(1 / i for i in range(1, r.m + 1)), rel=1e-13)


def test_running_sums_over_ranges(spark, many_ranges):
    rng = np.random.default_rng(3)
    vals = {g: sorted(set(rng.integers(0, 500, size=300).tolist())) for g in ("a", "b")}
    rows = [(g, float(v), i % 5 + 1) for g, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, s double, n int")
    out = ordered.running_sum(df, ["g"], "s", {"c": "n"})
    assert ordered.placed(df, ["g"], "s").select("__range").distinct().count() > 1
    for g in vals:
        total = 0
        for r in sorted(out.filter(F.col("g") == g).collect(), key=lambda r: r.s):
            total += r.n
            assert r.c == total


def test_positions_by_string_and_wide_long_keys(spark, many_ranges):
    """The order key keeps its type: strings, and longs that doubles cannot tell apart."""
    names = [f"k{i:05d}x" for i in range(900)]
    df = spark.createDataFrame([(n, 2**60 + i) for i, n in enumerate(names)], "s string, v long").repartition(7)
    for key in ("s", "v"):
        out = ordered.position_in_group(df.withColumn("g", F.lit(1)), ["g"], key, "pos").collect()
        assert [r.s for r in sorted(out, key=lambda r: r.pos)] == names
        assert sorted(r.pos for r in out) == list(range(1, 901))


@pytest.mark.parametrize("ties", [0.0, 0.5, 1.0])
def test_ranks_and_steps_over_cut_runs(spark, many_ranges, ties):
    """A run of equal keys is cut over ranges, no range holds most of it, and all its rows agree with brute force."""
    rng = np.random.default_rng(4)
    keys = [(g, None if g == "b" and i % 50 == 0 else 1.0 if rng.random() < ties else float(rng.integers(0, 60)) / 59) for g in "ab" for i in range(1500)]
    df = spark.createDataFrame([(g, v, i, i % 7) for i, (g, v) in enumerate(keys)], "g string, v double, i long, n int")
    if ties:
        sizes = [r["count"] for r in ordered.placed(df, ["g"], "v").groupBy("__range").count().collect()]
        assert len(sizes) > 3 and max(sizes) < 0.5 * len(keys)
    rank = {r.i: r.r for r in ordered.average_rank(df, ["g"], "v", "r").collect()}
    upto = {r.i: r.c for r in ordered.running_sum(df, ["g"], "v", {"c": "n"}).collect()}
    low = lambda v: -1.0 if v is None else v
    order = {g: np.array([low(v) for h, v in keys if h == g]) for g in "ab"}
    some = {g: np.array([i % 7 for i, (h, _) in enumerate(keys) if h == g]) for g in "ab"}
    for i, (g, v) in enumerate(keys):
        under, level = int((order[g] < low(v)).sum()), int((order[g] == low(v)).sum())
        assert rank[i] == under + (level + 1) / 2
        assert upto[i] == int(some[g][order[g] <= low(v)].sum())
    q = {r.i: r.q for r in inf.fdr(df.withColumnRenamed("v", "p"), ["g"]).collect()}
    for g in "ab":
        mine = [(v, i) for i, (h, v) in enumerate(keys) if h == g and v is not None]
        p = np.array([v for v, _ in mine])
        raw = {x: x * len(p) / (p <= x).sum() for x in set(p)}
        for v, i in mine:
            assert q[i] == pytest.approx(min(1.0, min(r for x, r in raw.items() if x >= v)), rel=1e-12)


def test_repeated_splits_equal_one_split_at_a_time(spark):
    """Same draws, same separations; counts beyond the batch's size and rows with a null count included."""
    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([("k", f"c{i}", i % 3 == 0) for i in range(120)], "case_id string, cell_id string, member boolean")
    rows = [(f"c{i}", f"g{j}", float(rng.integers(1, 9)) if (i + j) % 11 else 250_000.0 + i) for i in range(120) for j in range(3) if rng.random() < 0.7]
    counts = spark.createDataFrame([*rows, ("c1", "g9", None)], "cell_id string, gene string, value double")
    for draw, eps in (("md5", 0.5), ("xx", 0.5), ("xx", 0.3)):
        few = counts.where("value < 100") if eps != 0.5 else counts
        got = {(r.seed, r.gene): (r.disc, r.hold) for r in sep.repeated_split_aucs(few, cells, ["case_id"], eps, 5, 4, draw).collect()}
        for seed in range(5, 9):
            one = sep.split_aucs(sep.thin(few.where("value is not null"), eps, seed, draw=draw), cells, ["case_id"]).collect()
            assert {(seed, r.gene): (r.disc, r.hold) for r in one} == {k: v for k, v in got.items() if k[0] == seed}


def test_average_rank_ties(spark, many_ranges):
    df = spark.createDataFrame([("x", v) for v in (3.0, 1.0, 3.0, 2.0)], "k string, v double")
    got = sorted((r.v, r.r) for r in ordered.average_rank(df, ["k"], "v", "r").collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_ranks_of_sums_that_differ_between_evaluations(spark, many_ranges):
    """No row is lost, however the float sums behind the values fall out."""
    noisy = spark.range(4000, numPartitions=16).selectExpr("id % 200 as gene", "1 + rand() / 1e3 as v").groupBy("gene").agg(F.sum("v").alias("v"))
    df = noisy.withColumn("k", F.lit("a"))
    ranked = ordered.average_rank(ordered.average_rank(df, ["k"], "v", "ra"), ["k"], "v", "rb")
    assert ranked.count() == 200 and ranked.filter("ra = rb").count() == 200
    scored = inf.fdr(df.withColumn("p", F.col("v") / 100), ["k"])
    spark.catalog.clearCache()
    assert scored.filter("q is not null").count() == 200


def test_auc_of_histograms_against_pairs(spark, many_ranges):
    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", float(rng.integers(0, 40)), int(rng.integers(0, 4)), int(rng.integers(0, 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, n1 int, n0 int")
    for r in ordered.mann_whitney(df, ["g"], "score").collect():
        mine = [x for x in rows if x[0] == r.g]
        assert r.u == sum(a[2] * b[3] * (1 if b[1] < a[1] else 0.5 if b[1] == a[1] else 0) for a in mine for b in mine)


def test_ols_against_lstsq(spark):
    rng = np.random.default_rng(5)
    n = 60
    arm = rng.integers(0, 2, n)
    other = rng.integers(0, 4, n)
    y = 0.4 * arm + 0.3 * other + rng.normal(size=n)
    df = spark.createDataFrame(
        [("c", "alt" if a else "ref", f"l{o}", float(v)) for a, o, v in zip(arm, other, y)], "case_id string, arm string, other string, y double"
    )
    x = np.column_stack([np.ones(n), arm, *[(other == k) for k in (1, 2, 3)]]).astype(float)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    dof = n - x.shape[1]
    se = math.sqrt(r @ r / dof * np.linalg.inv(x.T @ x)[1, 1])
    want = float(t_two_sided(beta[1] / se, dof))
    fit = inf.two_factor_p(df, ["case_id"], "other").first()
    assert fit.adjusted_p == pytest.approx(want, rel=1e-9)
    levels = inf.factor_levels(df, "other")
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    general = inf.ols_p(df, ["case_id"], F.col("y"), [F.lit(1.0), alt, *inf.dummies("other", levels)], 1).first()
    assert general.p == pytest.approx(want, rel=1e-9)


def test_adjusted_is_null_when_nested(spark):
    rows = [("c", a, a, float(i)) for i, a in enumerate(["ref", "alt"] * 6)]
    df = spark.createDataFrame(rows, "case_id string, arm string, other string, y double")
    assert inf.two_factor_p(df, ["case_id"], "other").first().adjusted_p is None


def test_strided_sample_takes_positions_of_repeated_and_null_keys(spark):
    keys = [None] * 5 + [7] * 700 + list(range(8, 503))
    rows = [(k, float(i)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(7)
    got = inv.strided_sample(df, "k").collect()
    inorder = sorted(keys, key=lambda k: (k is None, k))
    at = [int(i * (len(keys) - 1) / 399) for i in range(400)]
    assert sorted(((r.k is None, r.k) for r in got), key=str) == sorted(((inorder[i] is None, inorder[i]) for i in at), key=str)
    assert len({r.x for r in got}) == 400
    assert inv.strided_sample(df.limit(300), "k").count() == 300


def test_running_sums_keep_a_column_named_k(spark):
    df = spark.createDataFrame([(0, i, i % 3) for i in range(60)], "__k int, pos int, x int")
    got = {r.pos: r.s for r in ordered.running_sum(df, ["__k"], "pos", {"s": "x"}).collect()}
    assert got == {i: sum(j % 3 for j in range(i + 1)) for i in range(60)}


@pytest.mark.parametrize("draw", ["md5", "xx"])
def test_array_draws_equal_column_draws(spark, draw):
    """Counts of several chunks, marks of all lengths (some longer than a block), nulls, empty and non-ASCII keys, seeds of all widths."""
    make, mark = (draws.binomial_md5, draws.md5_mark) if draw == "md5" else (draws.binomial_xx, draws.xx_mark)
    rows = [("" if i % 7 == 0 else "é" * (i % 40) + str(i), None if i % 11 == 0 else f"Brand#{i}", [0, 1, 59, 60, 61, 130, 7][i % 7]) for i in range(90)]
    keys, seeds = [F.col("cell_id"), F.col("gene")], [0, 9, 10, 123, 12345678, 123456789012]
    df = spark.createDataFrame(rows, "cell_id string, gene string, n long")
    told = df.select("n", mark(keys).alias("m"), *[make(F.col("n"), [*keys, F.lit(s).cast("string")], 0.5).alias(f"s{s}") for s in seeds]).collect()
    got = draws.half_draws(np.array([r.n for r in told]), pa.array([r.m for r in told]), seeds)
    assert got.tolist() == [[r[f"s{s}"] for s in seeds] for r in told]


def test_many_even_splits_take_little_time(spark):
    """600,000 rows x 200 splits drew for minutes of CPU time as columns."""
    n, marks = np.arange(4000) % 60, pa.array([f"{i}|Brand#{i % 25}|" for i in range(4000)])
    started = time.process_time()
    draws.half_draws(n, marks, list(range(200)))
    assert time.process_time() - started < 1.0  # about 0.3 us a draw; columns take 2
