"""Planted designs must return their intended verdicts."""

import numpy as np
import pytest

from plumbline.checks import audit as au
from plumbline.checks import base
from plumbline.checks.base import Finding, findings_frame
from plumbline.dataset import Claim, Dataset, Design
from plumbline.operators import clustering as clu
from plumbline.operators import scoring as sc
from plumbline.session import hold

DE = Claim(kind="de")


def frame(spark, obs, x):
    """Cells and long counts from dense arrays."""
    names = list(obs)
    cells = spark.createDataFrame([(str(i), *(str(obs[n][i]) for n in names)) for i in range(x.shape[0])], ["cell_id", *names])
    rows = [(str(i), f"g{j}", "counts", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    counts = spark.createDataFrame(rows, "cell_id string, gene string, layer string, value double")
    features = spark.createDataFrame([(f"g{j}", j) for j in range(x.shape[1])], "gene string, pos int")
    return Dataset(hold(cells), hold(counts), features)


@pytest.fixture(scope="module")
def toy(spark):
    """4 donors x 150; donor effect on g0; g10-g14 mark a real state; lane equals condition."""
    rng = np.random.default_rng(11)
    n = 600
    donor = np.arange(n) // 150
    cond = np.where(donor < 2, "ctrl", "stim")
    state = np.where(rng.uniform(size=n) < 0.4, "Naive", "Eff")
    x = rng.poisson(2.0, size=(n, 30))
    x[:, 0] = rng.poisson(np.array([2.0, 9.0, 4.0, 14.0])[donor])
    x[:, 10:15] += rng.poisson(9.0, size=(n, 5)) * (state == "Naive")[:, None]
    batch = np.where(rng.uniform(size=n) < 0.85, cond, np.where(cond == "ctrl", "stim", "ctrl"))
    obs = {"donor": donor, "condition": cond, "lane": cond, "batch": batch, "cell_state": state, "guide": cond}
    return frame(spark, obs, x)


def design(**k):
    return Design(unit="donor", grouping="condition", nuisance=("lane",), derived="cell_state", knobs=k)


def test_pseudoreplication_collapses(toy):
    f = au.run_check(1, toy, design(gene="g0"), DE, safe=False)
    assert f.state == "flagged" and f.original < 1e-4 and f.corrected > 0.05
    assert f.numbers["n_units"] == 4 and f.numbers["icc"] > 0.2 and "Welch" in f.engine


def test_one_unit_per_arm_is_a_hard_stop(toy):
    f = au.run_check(1, toy, Design(unit="guide", grouping="condition"), DE, safe=False)
    assert f.state == "hard_stop" and f.unsalvageable and f.corrected is None


def test_cell_as_unit_falls_back(toy):
    f = au.run_check(1, toy, design(unit="cell_id", gene="g0"), DE, safe=False)
    assert f.numbers["total_units"] == 4 and f.charts["significance"]["bad_unit"]


def test_missing_counts_only_flag(toy):
    bare = Dataset(toy.cells)
    assert au.run_check(2, bare, design(), Claim(kind="marker"), safe=False).state == "flag_only"
    assert au.run_check(8, bare, design(claimedTest="ttest"), DE, safe=False).state == "flag_only"


def test_real_markers_hold(toy):
    f = au.run_check(2, toy, design(grouping="cell_state", target_group="Naive", markers=[f"g{i}" for i in range(10, 15)] + ["nope"]), Claim(kind="marker"), safe=False)
    assert f.state == "clean" and f.corrected > 0.8 and f.numbers["tested"] == 5


def test_size_guard(toy):
    few = Dataset(toy.cells.limit(30), toy.counts, toy.features)
    assert au.run_check(2, few, design(grouping="cell_state"), Claim(kind="marker"), safe=False).state == "flag_only"


def test_stable_group_is_clean(toy):
    f = au.run_check(3, toy, design(track="Naive", max=0.6), Claim(kind="cluster"), safe=False)
    assert "KMeans" in f.engine and len(f.charts["fragility"]["steps"]) == 3


def test_nested_technical_is_unsalvageable(toy):
    f = au.run_check(4, toy, design(), DE, safe=False)
    assert f.state == "flagged" and f.unsalvageable and f.corrected is None and f.numbers["v"] == pytest.approx(1.0)


def test_overlapping_technical_is_adjusted(toy):
    f = au.run_check(4, toy, design(nuisance=["batch"]), DE, safe=False)
    assert f.state == "flagged" and not f.unsalvageable and f.corrected is not None
    g = au.run_check(6, toy, design(covariate="batch"), DE, safe=False)
    assert g.state == "flagged" and g.original is not None


def test_inseparable_covariate_is_left_to_check_4(toy):
    assert au.run_check(6, toy, design(covariate="lane"), DE, safe=False).state == "clean"


def test_multiplicity(toy):
    f = au.run_check(5, toy, design(), DE, safe=False)
    assert f.state == "flagged" and f.numbers["tests"] == 30 and f.corrected <= f.original
    assert au.run_check(5, toy, design(adjusted="yes"), DE, safe=False).state == "clean"


def test_test_assumptions(toy):
    assert au.run_check(8, toy, design(), DE, safe=False).state == "flag_only"
    assert au.run_check(8, toy, design(claimedTest="wilcoxon"), DE, safe=False).state == "clean"
    assert au.run_check(8, toy, design(method="DESeq2"), DE, safe=False).state == "clean"
    f = au.run_check(8, toy, design(claimedTest="t"), DE, safe=False)
    assert f.state == "flagged" and f.numbers["overdispersion"] > 1


def test_negative_binomial_separates_effect_from_null(spark):
    rng = np.random.default_rng(12)
    n = 720
    donor = np.arange(n) // 120
    cond = np.where(donor < 3, "ctrl", "stim")
    x = rng.poisson(6.0, size=(n, 24))
    x[:, 0] += rng.poisson(18.0, size=n) * (cond == "stim")
    ds = frame(spark, {"donor": donor, "condition": cond}, x)
    strong = au.run_check(1, ds, design(gene="g0", engine="nb"), DE, safe=False)
    assert strong.state == "clean" and strong.corrected < 1e-4 and "NB" in strong.engine
    from plumbline.operators import reduce as red
    from plumbline.checks.replicate import replicate_p
    from plumbline.checks.base import BY, unit_cells

    kept = red.filter_arms(unit_cells(ds, "condition", "donor"), "grp", "ctrl", "stim")
    p, _ = replicate_p(red.sample_moments(ds.counts, kept, BY), red.sample_table(kept, [*BY, "unit", "arm"]), "g1", "nb")
    assert p > 0.01


def test_a_failing_check_never_invents_numbers(toy):
    class Broken:
        id = 1

        def __init__(self, error):
            self.error = error

        def run(self, *_):
            raise self.error

    original = au.REGISTRY[1]
    try:
        au.REGISTRY[1] = Broken(ValueError("boom"))
        f = au.run_check(1, toy, design(), DE)
        au.REGISTRY[1] = Broken(RuntimeError("executor lost"))
        with pytest.raises(RuntimeError):
            au.run_check(1, toy, design(), DE)
    finally:
        au.REGISTRY[1] = original
    assert f.state == "flag_only" and f.original is None and "boom" in f.headline


def test_details_hold_every_row(spark, toy):
    f = au.run_check(1, toy, design(), DE, safe=False)
    rows = base.details_frame([f])
    assert rows.filter("detail = 'units'").count() == len(f.charts["significance"]["units"]) > 0


def test_rescue_guard():
    with pytest.raises(ValueError):
        Finding(4, "flagged", "x", corrected=0.1, feasibility="unsalvageable")


def test_applicability_needs_roles():
    empty = Design()
    assert not any(au.REGISTRY[c].applies_to(DE, empty) for c in (1, 4, 5, 6, 8))
    assert au.REGISTRY[3].applies_to(Claim(kind="unknown"), empty) and not au.REGISTRY[7].applies_to(Claim(kind="unknown"), empty)


def test_audit_report_and_actions(spark, toy):
    fields, found = au.audit(toy, "cell_id", {"kind": "de"}, checks=[1, 4])
    df = findings_frame(spark, found)
    assert [f.check_id for f in found] == [1, 4]
    assert sc.assemble_report(df, ["case_id"]).first().checks == 2
    assert au.recommend(df).filter("check_id = 4 and feasibility = 'unsalvageable'").count() == 1
    p = au.preview(df).filter("check_id = 4").first()
    assert p.unsalvageable and p.after is None


def test_double_dipping_reports_its_spread(toy):
    one = Claim(kind="marker", genes=("g10", "g11"), group="Naive")
    f = au.run_check(2, toy, design(grouping="cell_state", split=0.5, repeats=30), one, safe=False)
    again = au.run_check(2, toy, design(grouping="cell_state", split=0.5, repeats=30), one, safe=False)
    assert f.numbers["repeats"] == 30 and f.numbers["hold_lo"] <= f.numbers["hold_median"] <= f.numbers["hold_hi"]
    assert [f.numbers[k] for k in ("hold_lo", "hold_median", "hold_hi")] == [again.numbers[k] for k in ("hold_lo", "hold_median", "hold_hi")]


def test_fragility_over_repeated_sweeps(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (60, 4)), rng.normal(5, 0.1, (60, 4))])
    cells = spark.createDataFrame([(str(i), str(i // 60)) for i in range(120)], "cell_id string, label string")
    emb = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(120)], "cell_id string, vec array<double>")
    ds = Dataset(cells, embedding=emb)
    one = Claim(kind="cluster", group="1")
    f = au.run_check(3, ds, Design(knobs={"max": 0.4, "repeats": 3}), one, safe=False)
    assert f.numbers["repeats"] == 3 and f.numbers["stability_lo"] <= f.original <= f.numbers["stability_hi"]
    assert au.run_check(3, ds, Design(knobs={"max": 0.4}), one, safe=False).numbers["repeats"] == 1


def test_covariates_are_factors_of_the_count_model(spark):
    """The lane doubles a feature and is uneven between arms: left out, the arms seem to differ."""
    rng = np.random.default_rng(5)
    n = 800
    donor = np.arange(n) // 100
    cond = np.where(donor < 4, "ctrl", "stim")
    lane = np.where(rng.random(n) < np.where(donor < 4, 0.2, 0.8), "b", "a")
    x = rng.poisson(np.where(lane == "b", 20.0, 5.0)[:, None] * np.array([1.0] + [0.0] * 11) + np.array([0.0] + [6.0] * 11), size=(n, 12))
    ds = frame(spark, {"donor": donor, "condition": cond, "lane": lane, "only": np.repeat("x", n)}, x)
    with_lane = au.run_check(1, ds, design(gene="g0", covariates=["lane", "only", "absent"]), DE, safe=False)
    plain = au.run_check(1, ds, design(gene="g0", engine="nb"), DE, safe=False)
    assert with_lane.engine == "pseudobulk sum + NB Wald ~ condition + lane + only" and "~" not in plain.engine
    assert plain.corrected < 1e-6 and with_lane.corrected > 1e-3 > plain.corrected
    same = au.run_check(1, ds, design(gene="g0", covariates="condition"), DE, safe=False)
    assert same.engine == "pseudobulk sum + Welch on per-unit log1p CPM"  # collinear: no p from the model, the fallback says so


def test_checks_of_an_audit_share_one_embedding_and_sweep(toy, monkeypatch):
    made = {"embed": 0, "sweep": 0}
    for name in made:
        def counted(*a, f=getattr(clu, name), n=name, **k):
            made[n] += 1
            return f(*a, **k)

        monkeypatch.setattr(clu, name, counted)
    _, found = au.audit(toy, "cell_id", {"track": "Naive"}, checks=[3, 7])
    assert [f.check_id for f in found] == [3, 7] and made == {"embed": 1, "sweep": 1}
    alone = au.run_check(7, toy, Design(), Claim(kind="cluster"), safe=False)
    assert made == {"embed": 2, "sweep": 2}
    assert (alone.state, alone.numbers["supported_lo"], alone.numbers["supported_hi"]) == (found[1].state, found[1].numbers["supported_lo"], found[1].numbers["supported_hi"])


def test_double_dipping_plans_start_from_tables(spark, monkeypatch):
    """What check 2 hands on is written, so no later plan repeats the plans before it, which doubled their text with each table held."""
    from plumbline.checks import clusters

    seen = {}

    def spy(aucs, markers, by):
        seen["aucs"] = aucs._jdf.queryExecution().toString()
        return report(aucs, markers, by)

    report = clusters.sep.holdout_report
    monkeypatch.setattr(clusters.sep, "holdout_report", spy)
    cells = spark.createDataFrame([(f"c{i}", "a" if i % 2 else "b") for i in range(80)], "cell_id string, state string")
    rows = [(f"c{i}", f"g{j}", "counts", float(1 + (i * j) % 7 + 9 * (i % 2) * (j < 3))) for i in range(80) for j in range(6)]
    counts = spark.createDataFrame(rows, "cell_id string, gene string, layer string, value double")
    found = au.run_check(2, Dataset(cells, counts), Design(grouping="state", knobs={"repeats": 3, "target_group": "a"}), Claim(kind="marker"), safe=False)
    assert found.numbers["repeats"] == 3
    assert "InMemoryRelation" not in seen["aucs"] and seen["aucs"].count("Relation") <= 4
