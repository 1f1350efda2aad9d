"""Queries that no SQL can express: what must hold of their results on the smallest data."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.checks.base import STATES
from plumbline.operators import clustering as clu
from plumbline.operators import separation as sep
from plumbline.plans import audits, views
from plumbline.plans.catalogue import PLANS, SQL
from plumbline.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2))


def thin_counts_fast_hash(spark, rows):
    totals = {r.gene: r.t for r in views.brand_counts(spark, SF).groupBy("gene").agg(F.sum("value").alias("t")).collect()}
    assert {r.gene: r.train + r.test for r in rows} == totals


def wilcoxon_markers_with_fdr(spark, rows):
    by = defaultdict(list)
    for r in rows:
        by[r.level].append(r)
        assert r.p == pytest.approx(two_sided(r.score), rel=1e-6, abs=1e-12) and r.p <= r.q <= 1
    for mine in by.values():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.score >= b.score for a, b in zip(mine, mine[1:]))


def check1_negative_binomial(spark, rows):
    (r,) = rows
    assert r.state in STATES and r.asked == "nb" and (r.state != "clean" or r.original >= 0.05 or r.corrected < 0.05)


def check2_double_dipping(spark, rows):
    holds = [r.hold for r in rows]
    assert all(0 <= h <= 1 for h in holds) and rows[0].corrected == pytest.approx(np.mean(holds), abs=1e-4)
    ok = np.mean(holds) >= 0.62 and sum(h >= 0.6 for h in holds) >= -(-len(holds) // 2)
    assert {r.state for r in rows} == {"clean" if ok else "flagged"}


def check3_fragility(spark, rows):
    assert sorted(r.r for r in rows) == clu.resolutions(0.2, 2.0, 0.2)
    assert all(r.original == pytest.approx(np.mean([x.present for x in rows]), abs=1e-4) for r in rows)
    assert all(2 <= r.clusters <= round(3 + 4 * r.r) for r in rows)


def check3_whole_clustering(spark, rows):
    (r,) = rows
    assert -1 <= r.original <= 1 and r.state == ("clean" if r.original >= 0.8 else "flagged")


def check7_resolution_choice(spark, rows):
    (r,) = rows
    assert r.supported_lo <= r.best <= r.supported_hi
    assert r.state == ("clean" if r.supported_lo <= r.original <= r.supported_hi else "flagged")


def check7_resolution_by_ari(spark, rows):
    (r,) = rows
    assert r.supported_lo <= r.supported_hi
    assert r.state == ("clean" if r.supported_lo <= r.original <= r.supported_hi else "flagged")


def full_audit(spark, rows):
    ids = [r.check_id for r in rows]
    assert ids == list(range(1, 9)) and all(r.state in STATES and r.stamped for r in rows)
    assert all(r.engine for r in rows if r.check_id in (2, 3, 7) and r.state != "flag_only")
    assert all(r.corrected is None or r.original is not None for r in rows)


def audit_report(spark, rows):
    (r,) = rows
    assert r.flagged + r.hard_stop + r.clean + r.need_input == r.checks


def audit_previews(spark, rows):
    assert rows and all(r.after is None for r in rows if r.unsalvageable)


def audit_recommendations(spark, rows):
    by = defaultdict(list)
    for r in rows:
        by[r.check_id].append(r.pos)
        assert r.action and r.rationale and r.changes
    assert all(sorted(p) == list(range(len(p))) for p in by.values())


def negative_binomial_wald(spark, rows):
    assert len(rows) == 25
    for r in rows:
        assert r.stat == pytest.approx(r.log2fc * math.log(2) / r.se, rel=1e-9)
        assert (r.p is None) == (not r.converged) and (r.p is None or r.p == pytest.approx(two_sided(r.stat), rel=1e-6))


def multi_factor_survival(spark, rows):
    (r,) = rows
    assert r.survives == (r.best_q < 0.05) and r.tests <= 25


def focus_feature_call(spark, rows):
    (r,) = rows
    assert r.p <= r.q <= 1 and r.significant == (r.q < 0.05)


def unique_claim_ids(spark, rows):
    keys = [(r.dataset_id, r.id) for r in rows]
    assert len(keys) == len(set(keys))


def components_of(spark, rows):
    x = np.array([r.vec for r in rows])
    assert len(x) == views.order_cells(spark, SF).count() and np.isfinite(x).all()
    cov = np.cov(x.T)
    var = np.diag(cov)
    assert np.allclose(x.mean(axis=0), 0, atol=1e-8) and np.allclose(cov - np.diag(var), 0, atol=1e-6 * var[0])
    assert all(a >= b - 1e-9 for a, b in zip(var, var[1:]))


def cluster_sweep(spark, rows):
    n, by = views.embedding(spark, SF).count(), defaultdict(list)
    for r in rows:
        by[r.setting].append(r.n)
    grid = clu.resolutions(0.2, 2.0, 0.2)
    assert sorted(by) == list(range(len(grid)))
    assert all(sum(v) == n and len(v) <= clu.k_for(grid[s], n) for s, v in by.items())


def cluster_to_k(spark, rows):
    assert sum(r.n for r in rows) == views.embedding(spark, SF).count() and len({r.cluster for r in rows}) <= 10


def spurious_groups(spark, rows):
    assert len(rows) == 6
    fallen = sorted((-round(r.collapse, 10), r.cluster) for r in rows if r.collapse >= 0.2 and r.hold_auc <= 0.65)
    assert [r.cluster for r in rows if r.spurious] == [c for _, c in fallen[:1]]
    assert all(r.collapse == pytest.approx(r.disc_auc - r.hold_auc) and 0.5 <= r.disc_auc <= 1 for r in rows)


def truth_labels(spark, rows):
    told = {r.segment: r for r in PLANS["case_truth"](spark, SF).collect()}
    assert len(rows) == len(told) == 5
    for r in rows:
        assert r.settings == 10 and r.fragility == (r.stability < 0.5) and round(r.stability * 10, 5) in range(11)
        assert all(r[c] == told[r.segment][c] for c in ("hold_auc", "pseudoreplication", "double_dipping", "confounding"))


def graph_communities(spark, rows):
    assert sorted(r.r for r in rows) == clu.resolutions(0.2, 2.0, 0.2) and {r.engine for r in rows} == {"graph communities"}
    rows = sorted(rows, key=lambda r: r.r)
    assert all(0 < r.modularity < 1 and r.communities >= 1 for r in rows)
    assert rows[0].communities <= rows[-1].communities and rows[0].modularity > rows[-1].modularity


CHECKS = {f.__name__: f for f in (
    thin_counts_fast_hash, wilcoxon_markers_with_fdr, check1_negative_binomial, check2_double_dipping, check3_fragility, check3_whole_clustering,
    check7_resolution_choice, check7_resolution_by_ari, full_audit, audit_report, audit_previews, audit_recommendations, negative_binomial_wald,
    multi_factor_survival, focus_feature_call, unique_claim_ids, cluster_sweep, cluster_to_k, spurious_groups,
    truth_labels, graph_communities,
)} | {"pca_embedding": components_of, "pca_embedding_variable_features": components_of}


def test_case_members_leave_only_small_tables(spark):
    def thinned():
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
        return {n for n in names if n.startswith("thinned-")}

    ensure_checkpoint_dir(spark)
    held, before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet()), thinned()
    aucs, cells = audits.case_members(spark, SF)
    assert aucs.count() == 5 and cells.columns == ["cell_id", "segment", "member"]
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= held and thinned() <= before


def test_every_query_is_checked():
    assert set(CHECKS) == set(PLANS) - set(SQL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_invariant(spark, name):
    CHECKS[name](spark, PLANS[name](spark, SF).collect())


def test_a_planted_spurious_group_is_found(spark):
    scores = spark.createDataFrame([("c", "0", 0.9, 0.55), ("c", "1", 0.9, 0.85), ("c", "2", 0.8, 0.58), ("c", "3", 0.95, 0.7)], "case_id string, cluster string, disc_auc double, hold_auc double")
    (r,) = sep.spurious_group(scores, ["case_id"]).collect()
    assert r.cluster == "0" and r.collapse == pytest.approx(0.35)
