import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.operators import association as asc
from plumbline.operators import claims as cl
from plumbline.operators import clustering as clu
from plumbline.operators import profile as pro
from plumbline.operators import reduce as red
from plumbline.operators import scoring as sc
from plumbline.operators import selection as sel
from plumbline.operators import separation as sep
from plumbline.sources import manifest, tables

BY = ["case_id"]


# --- association ---
def grid_rows(grid):
    return [("c", f"r{i}", f"k{j}") for i, row in enumerate(grid) for j, n in enumerate(row) for _ in range(n)]


@pytest.mark.parametrize("grid,chi2,v", [([[2, 0, 2], [2, 4, 2]], 3.0, 0.5), ([[3, 3, 0, 0], [0, 0, 3, 3]], 12.0, 1.0)])
def test_cramers_v_golden(spark, grid, chi2, v):
    df = spark.createDataFrame(grid_rows(grid), "case_id string, a string, b string")
    r = asc.cramers_v(df, BY, "a", "b").first()
    assert r.chi2 == pytest.approx(chi2) and r.v == pytest.approx(v)
    assert r.nested == (v == 1.0)


def test_constant_side_has_no_association(spark):
    df = spark.createDataFrame([("c", "x", "y"), ("c", "x", "z")], "case_id string, a string, b string")
    assert asc.cramers_v(df, BY, "a", "b").first().v == 0.0


def test_design_rank_against_matrix(spark):
    rng = np.random.default_rng(2)
    for trial in range(4):
        n = 12 if trial % 2 else 40
        f = [rng.integers(0, k, n) for k in (2, 3, 3)]
        if trial == 2:
            f[2] = f[1].copy()
        df = spark.createDataFrame([("c", *(f"v{int(c[i])}" for c in f)) for i in range(n)], "case_id string, a string, b string, d string")
        x = [np.ones(n)] + [(c == lv).astype(float) for c in f for lv in sorted(set(c.tolist()))[1:]]
        want = int(np.linalg.matrix_rank(np.column_stack(x)))
        got = asc.design_rank(df, BY, ["a", "b", "d"]).first()
        assert (got["rank"], got["columns"]) == (want, len(x))


def test_design_rank_of_two_factors(spark):
    split = spark.createDataFrame([("c", "a1", "b1"), ("c", "a2", "b2"), ("c", "a2", "b3"), ("c", None, "b1"), ("d", "a1", "b1")], "case_id string, a string, b string")
    joined = split.union(spark.createDataFrame([("c", "a1", "b3")], split.schema))
    for df, rank in [(split, 3), (joined, 4)]:
        got = {r.case_id: (r["rank"], r["columns"], r.rank_deficient) for r in asc.design_rank(df, BY, ["a", "b"]).collect()}
        assert got == {"c": (rank, 4, rank < 4), "d": (1, 1, False)}
    assert asc.design_rank(split.limit(0), BY, ["a", "b"]).count() == 0


@pytest.mark.parametrize("block", [2, 6])
def test_design_rank_by_rounds_against_matrix(spark, block):
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for case in range(12):
        n, sizes = int(rng.integers(6, 30)), (2, int(rng.integers(2, 9)), int(rng.integers(2, 9)))
        f = [rng.integers(0, k, n) for k in sizes]
        x = [np.ones(n)] + [(c == lv).astype(float) for c in f for lv in sorted(set(c.tolist()))[1:]]
        want[f"c{case}"] = (int(np.linalg.matrix_rank(np.column_stack(x))), len(x))
        rows += [(f"c{case}", *(f"v{int(c[i])}" for c in f)) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, a string, b string, d string")
    got = {r.case_id: (r["rank"], r["columns"]) for r in asc.design_rank(df, BY, ["a", "b", "d"], block=block).collect()}
    assert got == want


@pytest.mark.parametrize("levels", [10, 10_000])
def test_joint_deficiency_at_any_number_of_levels(spark, levels):
    """g = u + v with u a property of t1 and v one of t2: short of rank jointly, fine in every pair."""
    rows = [(i, (i % 4 == 0) * 1, j, (j % 2) * 1) for i in range(levels) for j in range(6)]
    short = [("c", f"g{u + v}", f"t{i}", f"s{j}") for i, u, j, v in rows if u + v < 2]
    full = short + [("c", "g0", "t0", "s0")]
    for data, deficient in [(short, True), (full, False)]:
        df = spark.createDataFrame(data, "case_id string, g string, t1 string, t2 string")
        assert asc.design_rank(df, BY, ["g", "t1", "t2"]).first()["rank_deficient"] == deficient
    df = spark.createDataFrame(short, "case_id string, g string, t1 string, t2 string")
    assert not any(asc.design_rank(df, BY, list(p)).first()["rank_deficient"] for p in (("g", "t1"), ("g", "t2"), ("t1", "t2")))


# --- arms and roles ---
def test_two_arms_rules(spark):
    rows = [("c", g) for g, n in (("drug", 5), ("ctrl", 4), ("other", 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "case_id string, g string")
    pick = lambda **k: (lambda r: (r.ref, r.alt, r.n_ref, r.n_alt) if r else None)(red.two_arms(df, "g", BY, **k).first())
    assert pick() == ("ctrl", "drug", 4, 5)
    assert pick(groups=("other", "drug")) == ("other", "drug", 2, 5)
    assert pick(groups=("absent", "drug")) is None
    assert pick(reference="other") == ("other", "drug", 2, 5)
    assert pick(reference="absent") == ("ctrl", "drug", 4, 5)
    assert red.two_arms(df.filter("g = 'drug'"), "g", BY).first() is None


@pytest.mark.parametrize("level,want", [("Control", True), ("NT_1", True), ("drug_veh", True), ("stimulated", False), ("refined", True), ("x", False)])
def test_control_labels(spark, level, want):
    assert L.is_control(level) is want
    assert spark.createDataFrame([(level,)], "l string").select(L.is_control_col(F.col("l"))).first()[0] is want


def test_roles_of_a_typical_table(spark):
    n = 1200
    rows = [
        (i, f"d{i % 4}", "stim" if i % 4 < 2 else "ctrl", f"bc{i}", "L1" if i % 4 < 2 else "L2", f"g{i % 6}", str(i % 5), "Naive" if i % 3 else "Eff", 200 + i, i / 7.0, ("G1", "S", "G2M")[i % 3])
        for i in range(n)
    ]
    names = ["row", "donor", "condition", "cell_barcode", "lane", "guide_batch", "leiden", "cell_state", "n_genes", "pct_mito", "phase"]
    df = spark.createDataFrame(rows, names)
    f = {r.id: r for r in pro.resolve_fields(df, "row", names[1:]).collect()}
    roles = {k: v.role for k, v in f.items()}
    assert roles == {
        "donor": "unit", "condition": "grouping", "cell_barcode": "observation", "lane": "nuisance", "guide_batch": "grouping",
        "leiden": "derived", "cell_state": "derived", "n_genes": "covariate", "pct_mito": "covariate", "phase": "nuisance",
    }
    assert f["condition"].confidence == "high" and f["donor"].confidence == "high"
    assert f["lane"].reason.startswith("Lines up with 'condition'")
    assert f["donor"].sample == "d0 · d1 · d2" and f["n_genes"].levels is None


def test_stratified_cap_salted(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("s"), "id")
    big = sel.stratified_cap(df, ["s"], "id", 1400, 1)
    assert {r["s"]: r["count"] for r in big.groupBy("s").count().collect()} == {0: 1400, 1: 1400}
    want = df.withColumn("h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("1")))).filter("s = 0").orderBy("h", "id").limit(1400)
    assert big.filter("s = 0").select("id").exceptAll(want.select("id")).isEmpty()


# --- splitting and separation ---
def brute_auc(score, label):
    pos, neg = [s for s, m in zip(score, label) if m], [s for s, m in zip(score, label) if not m]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_auc_with_ties_and_implicit_zeros(spark):
    rng = np.random.default_rng(4)
    member = rng.integers(0, 2, 120).astype(bool)
    value = rng.integers(0, 25, 120) * (rng.uniform(size=120) < 0.6)
    cells = spark.createDataFrame([("c", str(i), bool(m)) for i, m in enumerate(member)], "case_id string, cell_id string, member boolean")
    rows = spark.createDataFrame(
        [("c", "g", float(v), bool(m)) for v, m in zip(value, member) if v > 0], "case_id string, gene string, v double, member boolean"
    )
    got = sep.gene_auc(rows, sep.member_sizes(cells, BY), BY, F.col("v"), fold=False).first().auc
    assert got == pytest.approx(brute_auc(value, member), rel=1e-12)


def test_one_class_is_chance(spark):
    df = spark.createDataFrame([("c", 1.0, True), ("c", 2.0, True)], "case_id string, s double, m boolean")
    assert sep.auc(df, BY, F.col("s"), F.col("m")).first().auc == 0.5


@pytest.mark.parametrize("draw", ["md5", "xx"])
@pytest.mark.parametrize("eps", [0.5, 0.3])
def test_thinning_is_keyed_and_unbiased(spark, draw, eps):
    df = spark.range(2000).select(F.col("id").cast("string").alias("cell_id"), F.lit("g").alias("gene"), (F.col("id") % 150).cast("double").alias("value"))
    a = sep.thin(df, eps, 3, draw)
    b = sep.thin(df.repartition(7), eps, 3, draw)
    assert a.select("cell_id", "train").exceptAll(b.select("cell_id", "train")).isEmpty()
    t = a.agg(F.sum("train").alias("t"), F.sum("value").alias("n"), F.min("test").alias("low"), F.min("train").alias("low2")).first()
    assert t.low >= 0 and t.low2 >= 0
    assert t.t / t.n == pytest.approx(eps, abs=0.01)
    spread = a.filter("value > 0").agg(F.avg(F.pow(F.col("train") - F.col("value") * eps, 2) / (F.col("value") * eps * (1 - eps)))).first()[0]
    assert spread == pytest.approx(1.0, abs=0.15)


def test_interval_downsamples(spark):
    df = spark.range(1000).select(F.lit("c").alias("case_id"), F.col("id").cast("double").alias("v"))
    assert len(sep.interval(df, BY, "v").first().samples) == 1000
    r = sep.interval(df, BY, "v", cap=200).first()
    assert (r.median, r.n, len(r.samples)) == (499.5, 1000, 200)
    assert r.samples[0] == 0.0 and r.samples[-1] == 999.0
    assert r.lo == pytest.approx(24.975) and r.hi == pytest.approx(974.025)


# --- clustering ---
def brute_ari(a, b):
    from itertools import combinations

    pairs = list(combinations(range(len(a)), 2))
    same_a, same_b = [a[i] == a[j] for i, j in pairs], [b[i] == b[j] for i, j in pairs]
    both, sa, sb = sum(x and y for x, y in zip(same_a, same_b)), sum(same_a), sum(same_b)
    exp, top = sa * sb / len(pairs), (sa + sb) / 2
    return 1.0 if top == exp else (both - exp) / (top - exp)


def test_silhouette_scores_every_row(spark):
    """More rows than any sample held, against the sums written out."""
    rng = np.random.default_rng(9)
    pts, lab = rng.normal(size=(2600, 4)), rng.integers(0, 3, 2600)
    rows = [(str(i), pts[i].tolist(), [str(lab[i])]) for i in range(2600)]
    df = spark.createDataFrame(rows, "cell_id string, vec array<double>, labels array<string>")
    d = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    per = np.stack([d[:, lab == c].sum(axis=1) for c in range(3)], axis=1)
    size = np.bincount(lab)
    a = per[np.arange(2600), lab] / (size[lab] - 1)
    mean = per / size
    mean[np.arange(2600), lab] = np.inf
    b = mean.min(axis=1)
    got = clu.silhouette(df, 1).first()
    assert got.k == 3 and got.score == pytest.approx(np.mean((b - a) / np.maximum(a, b)), rel=1e-9)


def test_ari_and_silhouette(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(60, 3))
    labs = [[str(v) for v in rng.integers(0, k, 60)] for k in (2, 3, 1)]
    rows = [("c", str(i), pts[i].tolist(), [labs[s][i] for s in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id string, cell_id string, vec array<double>, labels array<string>")
    ari = {r.pair: r.ari for r in clu.adjacent_ari(df, BY, 3).collect()}
    for i in (0, 1):
        assert ari[i] == pytest.approx(brute_ari(labs[i], labs[i + 1]), abs=1e-12)
    sil = {r.setting: r.score for r in clu.silhouette(df, 3).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2) ** 2
    for s in (0, 1):
        lab = np.array(labs[s])
        vals = []
        for i in range(60):
            own = (lab == lab[i]) & (np.arange(60) != i)
            b = min(d[i, lab == o].mean() for o in set(lab) - {lab[i]})
            a = d[i, own].mean()
            vals.append((b - a) / max(a, b))
        assert sil[s] == pytest.approx(np.mean(vals), rel=1e-9)
    assert sil[2] is None


def test_supported_window_edges(spark):
    grid = [0.2, 0.4, 0.6, 0.8, 1.0]
    df = lambda s: spark.createDataFrame([("c", i, v) for i, v in enumerate(s)], "case_id string, setting int, score double")
    w = clu.supported_window(df([0.1, 0.5, 0.51, None, 0.51]), BY, grid, 1.0).first()
    assert (w.supported_lo, w.supported_hi, w.best) == (0.4, 0.6, 0.6)
    w = clu.supported_window(df([None] * 5), BY, grid, 0.7).first()
    assert (w.supported_lo, w.supported_hi, w.best) == (0.2, 1.0, 0.7)


def test_resolution_grid():
    assert clu.resolutions(0.2, 2.0, 0.2) == [round(0.2 * i, 4) for i in range(1, 11)]
    assert len(clu.resolutions(0.2, 1.0, 0)) == 5
    assert clu.reconcile_engine(["graph", "KMeans (fallback)"]) == "KMeans (fallback)"


# --- claims ---
def brute_ids(claims):
    used, out = set(), []
    for pos, raw in claims:
        base = f"claim-{pos}" if raw.strip() == "" else raw
        name, n = base, 2
        while name in used:
            name, n = f"{base}-{n}", n + 1
        used.add(name)
        out.append((pos, name))
    return out


def test_unique_ids_follow_claim_order(spark):
    rng = np.random.default_rng(8)
    pool = ["a", "a-2", "a-3", "a-2-2", "b", "", " ", "claim-4", "a-4", "b-2"]
    sets = {f"d{t}": [(i, pool[int(rng.integers(0, len(pool)))]) for i in range(40)] for t in range(4)}
    sets["hot"] = [(i, "a" if i % 3 else "a-5") for i in range(30)]
    df = spark.createDataFrame([(d, p, i) for d, cs in sets.items() for p, i in cs], "dataset_id string, pos long, id string")
    got = {(r.dataset_id, r.pos): r.id for r in cl.unique_ids(df).collect()}
    for d, cs in sets.items():
        for pos, want in brute_ids(cs):
            assert got[(d, pos)] == want


# --- scoring ---
def test_scoring_arms_can_fail(spark):
    truth = spark.createDataFrame([(f"c{i}", k, "planted" if i else "clean_control", bool(i and (i + j) % 2)) for i in range(6) for j, k in enumerate(sc.ERROR_CLASSES)], "case_id string, error_class string, family string, present boolean")
    arms = truth.select("case_id", "error_class", F.explode(F.array(
        F.struct(F.lit("null").alias("arm"), F.lit(False).alias("detected")),
        F.struct(F.lit("all").alias("arm"), F.lit(True).alias("detected")),
        F.struct(F.lit("exact").alias("arm"), F.col("present").alias("detected")),
    )).alias("a")).select("case_id", "error_class", "a.*")
    by = ["case_id", "error_class"]
    r = {x.arm: x for x in sc.rates(sc.confusion(arms, truth, by)).filter("error_class is null").collect()}
    assert r["null"].detection == 0 and r["null"].f1 == 0 and r["null"].precision is None
    assert r["all"].fp_rate == 1 and r["exact"].youden_j == 1
    c = {x.arm: x for x in sc.clean_control_flags(arms, truth, by).collect()}
    assert c["all"].case_fp_rate == 1 and c["exact"].case_fp_rate == 0


# --- sources ---
def test_manifest_shapes(spark, tmp_path):
    full = {"unit": "u", "group": "g", "technical": "t", "stateCol": "s", "gene": "G", "tracked": "X", "markers": ["A", "B"], "eps": 0.4}
    shapes = {
        "list": [{"id": "one", "path": "p", **full}],
        "cases": {"cases": [{"case": "one", "h5ad": "p", **full, "markers": "A, B"}]},
        "keyed": {"one": {"file": "p", **full}, "bad": {"unit": "u"}},
    }
    for name, doc in shapes.items():
        f = tmp_path / f"{name}.json"
        f.write_text(json.dumps(doc))
        rows = {r.case_id: r for r in manifest.read_cases(spark, str(f), {"alpha": 0.05}).collect()}
        r = rows["one"]
        assert (r.foil, r.unit, r.grouping, r.error, r.alpha, r.split, r.markers) == ("p", "u", "g", None, 0.05, 0.4, ["A", "B"])
        if name == "keyed":
            assert rows["bad"].error.startswith("missing foil")


def test_json_sink_drops_non_finite(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 2.5, [3.0])], "i int, x double, a array<double>")
    tables.write_results(df, str(tmp_path / "o"))
    lines = sorted(
        (json.loads(x) for p in (tmp_path / "o").glob("*.json") for x in p.read_text().splitlines()), key=lambda d: d["i"]
    )
    assert lines == [{"i": 1, "a": [1.0, None]}, {"i": 2, "x": 2.5, "a": [3.0]}]


def test_margins_are_checked_again(spark):
    rows = [("a", "spurious_state", "pos", True, 0.4), ("b", "continuum", "pos", True, 0.6), ("c", "p1", "pos", False, 0.7), ("d", "real_state", "neg", False, 0.9), ("e", "p4", "pos", False, None), ("f", "p1", "neg", True, 0.1)]
    labels = spark.createDataFrame(rows, "case_id string, family string, polarity string, fragility boolean, stability double")
    assert sorted(r.case_id for r in sc.lost_margins(labels).collect()) == ["b", "c", "e"]


def test_inventory_names_embeddings(spark):
    from plumbline.operators import inventory as inv
    from plumbline.operators import profile as prof
    from plumbline.plans import views

    sf = "/root/testdata/sf0.001"
    cells = views.order_cells(spark, sf).select("cell_id", "region", "price")
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    typed = prof.column_dtypes(prof.profile_columns(cells, "cell_id"))
    typed.collect()
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= held  # distinct values, as many as cells, are not cached
    counts = views.brand_counts(spark, sf)
    layers = counts if "layer" in counts.columns else counts.withColumn("layer", F.lit("counts"))
    stored = spark.createDataFrame([], "key string, kind string")
    row = inv.inventory(cells, typed, layers, views.brand_features(spark, sf), stored, ["X_umap", "X_pca"]).first()
    assert row.embeddings == ["X_pca", "X_umap"] and row.has_raw_counts
