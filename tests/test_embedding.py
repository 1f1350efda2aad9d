"""Components of sparse values beside dense PCA, on both sides of widths that once had another method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clustering as clu


def planted(spark, n, width, rank, seed=0):
    """A low-rank matrix over a floor of noise, most entries zero, one row all zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) * np.linspace(6, 3, rank) @ rng.normal(size=(rank, width)) / np.sqrt(width)
    x += rng.normal(0, 0.02, (n, width))
    x[rng.random((n, width)) < 0.3] = 0
    x[0] = 0
    rows = [(f"c{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return x, spark.createDataFrame(rows, "cell_id string, gene string, x double"), spark.createDataFrame([(f"c{i}",) for i in range(n)], "cell_id string")


@pytest.mark.parametrize(("n", "width", "k"), [(60, 8, 5), (80, 300, 4), (40, 5000, 3)])
def test_components_are_those_of_dense_pca(spark, n, width, k):
    x, values, cells = planted(spark, n, width, k)
    got = {r.cell_id: r.vec for r in clu.components(values, cells, k).collect()}
    y = np.array([got[f"c{i}"] for i in range(n)])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert y.shape == (n, k)
    assert np.sqrt((y**2).sum(axis=0)) == pytest.approx(s[:k], rel=1e-6)
    far = y / s[:k] - u[:, :k] @ (u[:, :k].T @ (y / s[:k]))
    assert np.abs(far).max() < 1e-6  # the same subspace
    assert np.abs(y.mean(axis=0)).max() < 1e-8


def test_components_of_little(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    none = spark.createDataFrame([], "cell_id string, gene string, x double")
    assert [r.vec for r in clu.components(none, cells, 3).collect()] == [[], []]
    one = spark.createDataFrame([("a", "g", 2.0), ("b", "g", 4.0), ("a", "h", 1.0), ("b", "h", 2.0)], "cell_id string, gene string, x double")
    got = {r.cell_id: r.vec for r in clu.components(one, cells, 3).collect()}
    assert abs(got["a"][0]) == pytest.approx(abs(got["b"][0])) == pytest.approx(np.sqrt(5) / 2)


def test_variable_features_beside_dense(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(rng.uniform(1, 6, 12), (90, 12)).astype(float)
    x[45:, :4] *= 4
    rows = [(f"c{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    counts = spark.createDataFrame(rows, "cell_id string, gene string, value double").withColumn("layer", F.lit("counts"))
    cells = spark.createDataFrame([(f"c{i}", "k") for i in range(90)], "cell_id string, case_id string")
    got = {r.cell_id: r.vec for r in clu.embed_hvg(counts, cells, ["case_id"], k=3).collect()}
    z = np.log1p(x / x.sum(axis=1, keepdims=True) * 1e4)
    z = np.minimum((z - z.mean(axis=0)) / z.std(axis=0, ddof=1), 10)
    u, s, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    y = np.array([got[f"c{i}"] for i in range(90)])
    assert np.abs(np.abs(y) - np.abs(u[:, :3] * s[:3])).max() < 1e-5


def test_cells_and_scores_are_not_cached(spark):
    """The embedding and a sweep read one written table: no cached blocks that fill executors, whatever the cells; rows of `cells` stay as they are."""
    rng = np.random.default_rng(6)
    x = rng.poisson(3, (40, 6))
    rows = [(f"c{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [("c1", None, 2.0), ("c2", "h", None), ("else", "g1", 4.0)]
    counts = spark.createDataFrame(rows, "cell_id string, gene string, value double")
    cells = spark.createDataFrame([(f"c{i}",) for i in [*range(40), 3]] + [("bare",), (None,)], "cell_id string")
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    labels, _ = clu.sweep(clu.embed(counts, cells), [0.5, 1.0], 0)
    got = labels.collect()
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= held
    assert sorted(r.cell_id or "" for r in got) == sorted(["", "bare", "c3", *[f"c{i}" for i in range(40)]])
    assert len({tuple(r.vec) for r in got if r.cell_id == "c3"}) == 1
    assert [r.vec for r in got if r.cell_id is None] == [r.vec for r in got if r.cell_id == "bare"]


def test_many_models_in_the_same_scans(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 6, (5, 4))
    x = np.array([middle[i % 5] + rng.normal(0, 0.5, 4) for i in range(300)])
    emb = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "cell_id string, vec array<double>").repartition(3)
    models = [(k, seed) for seed in (0, 1) for k in (2, 5, 7)]
    centres, report = clu.fit_models(emb, models)
    for (k, _), c, r in zip(models, centres, report, strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        own = d.argmin(axis=1)
        assert c.shape == (k, 4) and r["converged"]
        assert d.min(axis=1).sum() <= r["inertia"] * (1 + 1e-9)  # no pass made it worse
        for j in set(own):
            assert np.abs(x[own == j].mean(axis=0) - c[j]).max() < 0.05 * np.abs(x).max()  # a mean of what it owns
    labels, engine = clu.sweep(emb, [0.5, 1.0], 0, repeats=3)
    rows = labels.collect()
    assert engine == clu.ENGINE and len(rows) == 900 and {r.r for r in rows} == {0, 1, 2}
    for r in (0, 1, 2):
        for s in (0, 1):
            assert len({q.labels[s] for q in rows if q.r == r}) <= clu.k_for([0.5, 1.0][s], 300)
    assert len({q.labels[0] for q in rows if q.r == 0}) == 5  # five groups, k = 5


def test_scores_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """Values that come partitioned by cell meet their directions in place: only sums by feature travel, and no table of scores is written."""
    written, keep = [], clu.keep
    monkeypatch.setattr(clu, "keep", lambda df, name="kept": written.append(name) or keep(df, name))
    rng = np.random.default_rng(1)
    x = rng.poisson(2.0, (200, 6))
    counts = spark.createDataFrame([(f"c{i}", f"g{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([(f"c{i}", "c") for i in range(200)], "cell_id string, case_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # cells and counts are joined by shuffles, directions are not
    try:
        emb = clu.embed_hvg(counts, cells, ["case_id"], k=3)
        assert emb.count() == 200 and emb.where("size(vec) = 3").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written and "scores" not in written


def test_components_by_arrays_and_by_joins_agree(spark, monkeypatch):
    """Cells held as arrays give the scores that joins give, for cells with null values, with none but nulls and without rows too."""
    _, values, cells = planted(spark, 60, 14, 4)
    odd = spark.createDataFrame([("c1", "g1", None), ("c60", "g2", None), ("c2", None, 3.0), ("c3", "new", None)], values.schema)
    values, cells = values.union(odd), cells.union(spark.createDataFrame([("c60",), ("c61",)], "cell_id string"))
    got = {}
    for wide in (clu.WIDE, 0):
        monkeypatch.setattr(clu, "WIDE", wide)
        got[wide] = {r.cell_id: np.array(r.vec, float) for r in clu.components(values, cells, 4).collect()}
    one, two = got.values()
    assert one.keys() == two.keys() and len(one) == 62
    assert np.isnan(one["c60"]).all() and np.isnan(two["c60"]).all()
    for c in one.keys() - {"c60"}:
        assert one[c] == pytest.approx(two[c], abs=1e-6)
