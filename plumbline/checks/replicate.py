"""Checks 1 and 8: the unit of analysis, and whether the test fits counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.checks import base
from plumbline.checks.base import BY, Check, Finding
from plumbline.dataset import Claim, Dataset, Design
from plumbline.functions.labels import p_words, unit_noun
from plumbline.operators import inference as inf
from plumbline.operators import nbmodel
from plumbline.operators import reduce as red
from plumbline.session import hold


def count_model_p(totals: DataFrame, samples: DataFrame, gene: str, factors: list[str]) -> float | None:
    """p of the audited feature from the count model ~ arm + factors on samples keyed by (unit, arm, factors).

    A factor with one level is left out; None where the feature dropped out or its fit did not stand still.
    """
    levels = {f: inf.factor_levels(samples, f) for f in factors}
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    design = [F.lit(1.0), alt, *[d for f in factors if len(levels[f]) > 1 for d in inf.dummies(f, levels[f])]]
    fit = nbmodel.nb_wald(totals, samples, BY, ["unit", "arm", *factors], design)
    row = fit.filter(F.col("gene") == gene).select("p").first()
    return None if row is None else row["p"]


def replicate_p(moments: DataFrame, samples: DataFrame, gene: str, engine: str) -> tuple[float | None, str]:
    """p of the audited feature between arms at the replicate level, and the engine that ran.

    `samples` has one row per (unit, arm).
    """
    if engine == "nb":
        totals = moments.withColumn("total", F.round("total").cast("long")).filter(F.col("total") > 0)
        p = count_model_p(totals, samples, gene, [])
        if p is not None:
            return p, nbmodel.ENGINE
    values = red.moments_cpm(moments, BY).filter(F.col("gene") == gene)
    row = inf.welch_by_gene_units(values, samples, BY).select("p").first()
    return (row["p"] if row else 1.0), nbmodel.FALLBACK


class Pseudoreplication(Check):
    id = 1
    kinds = ("de",)

    def applies_to(self, claim: Claim, design: Design) -> bool:
        grouping, unit = design.grouping or design.knob("grouping"), design.unit or design.knob("unit")
        return self.kind_fits(claim, True) and bool(grouping) and bool(unit)

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        alpha = float(design.knob("alpha", 0.05))
        group = design.knob("grouping") or design.grouping
        true_unit = design.unit or design.knob("unit")
        unit = design.knob("unit") or true_unit
        unresolved = Finding(1, base.FLAG_ONLY, "The comparison and its replicate unit are not resolved.", feasibility=base.NEEDS_DATA)
        if not has(ds, group, unit if has(ds, unit) else true_unit):
            return unresolved
        unit = unit if has(ds, unit) else true_unit
        cells = base.unit_cells(ds, group, unit)
        table = base.sample_counts(cells)
        bad_unit = bool(red.bad_unit(table, "unit", BY).first()["bad_unit"]) if has(ds, true_unit) else False
        if bad_unit:
            unit = true_unit
            cells = base.unit_cells(ds, group, unit)
            table = base.sample_counts(cells)
        arms = red.two_arms(table, "grp", BY, design.knob("groups"), design.knob("reference")).first()
        if arms is None:
            return unresolved
        kept = red.filter_arms(cells, "grp", arms["ref"], arms["alt"])
        samples = hold(red.filter_arms(table, "grp", arms["ref"], arms["alt"]))
        rep = red.replicates(samples, BY).first()
        sizes = arm_sizes(samples)
        n_cells = arms["n_ref"] + arms["n_alt"]
        shared = {"n_cells": n_cells, "n_units": rep["n_samples"], "total_units": rep["total_units"], "per_group": rep["per_group"]}
        if rep["per_group"] < 2:
            return Finding(
                1,
                base.HARD_STOP,
                f"'{unit}' leaves {rep['per_group']} replicate in an arm: no test is valid.",
                feasibility=base.UNSALVAGEABLE,
                target=str(unit),
                numbers=shared,
                charts={"hard_stop": {"units": rep["total_units"], "per_group": rep["per_group"]}},
            )
        counts = base.count_rows(ds)
        rows = counts if counts is not None else ds.counts
        if rows is None:
            return unresolved
        moments = hold(red.sample_moments(rows, kept, BY))
        scale = "log" if counts is not None else "raw"
        tests = inf.welch_from_moments(moments, sizes, BY, scale)
        given = design.knob("gene") or (claim.genes[0] if claim.genes else None)
        named = tests.filter(F.col("gene") == given).first() if given else None
        audited = named or inf.pick_gene(tests, BY).first()
        if audited is None:
            return unresolved
        gene, naive = audited["gene"], audited["p"]
        per_unit = (
            samples.join(moments.filter(F.col("gene") == gene).select("unit", "arm", "log_sum"), ["unit", "arm"], "left")
            .select(
                F.col("unit").alias("id"),
                F.col("arm").alias("group"),
                F.col("n_cells").alias("n"),
                (F.coalesce("log_sum", F.lit(0.0)) / F.col("n_cells")).alias("value"),
            )
            .orderBy("id", "group")
        )
        units, details = base.detail(per_unit), {"units": per_unit}
        if naive >= alpha:
            return Finding(
                1,
                base.CLEAN,
                f"{gene} is not significant even over cells.",
                original=naive,
                target=gene,
                numbers=shared,
                charts={"significance": base.significance(n_cells, naive, rep["total_units"], naive, alpha, bad_unit, units)},
                details=details,
            )
        if counts is None:
            return Finding(
                1, base.FLAG_ONLY, "The replicate-level test needs raw counts.", original=naive, feasibility=base.NEEDS_DATA, target=gene, numbers=shared
            )
        # With covariates the count model comes first, as they can be factors of it; the fallback has no place for them.
        named_too = design.knob("covariates") or []
        factors = [c for c in ([named_too] if isinstance(named_too, str) else named_too) if has(ds, c)]
        p, engine = None, nbmodel.ENGINE
        if factors:
            wide = base.unit_cells(ds, group, unit, *factors)
            wide = hold(red.filter_arms(wide, "grp", arms["ref"], arms["alt"]))
            keys = [*BY, "unit", "arm", *map(base.extra_name, factors)]
            p = count_model_p(red.pseudobulk(counts, wide, keys), red.sample_table(wide, keys), gene, keys[len(BY) + 2 :])
            engine += " ~ " + " + ".join([group, *factors])
        if p is None:
            p, engine = replicate_p(moments, samples, gene, design.knob("engine", "welch"))
        icc = red.moments_icc(moments, samples, BY, gene).first()["icc"]
        holds = p < alpha
        head = (
            f"{gene} holds over {rep['n_samples']} {unit_noun(unit)} samples (p {p_words(p)})."
            if holds
            else f"{gene} has p {p_words(naive)} over {n_cells:,} cells but {p_words(p)} over replicates."
        )
        return Finding(
            1,
            base.CLEAN if holds else base.FLAGGED,
            head,
            original=naive,
            corrected=p,
            engine=engine,
            target=gene,
            numbers={**shared, "icc": icc},
            charts={"significance": base.significance(n_cells, naive, rep["n_samples"], p, alpha, bad_unit, units)},
            details=details,
        )


def arm_sizes(samples: DataFrame) -> DataFrame:
    """Cells per arm out of the sample table."""
    arm = lambda a: F.sum(F.when(F.col("arm") == a, F.col("n_cells")).otherwise(0))
    return samples.groupBy(*BY).agg(arm("ref").alias("n_ref"), arm("alt").alias("n_alt"))


def has(ds: Dataset, *names: str | None) -> bool:
    return all(base.has_column(ds, n) for n in names)


# Methods that model counts.
COUNT_AWARE = ("deseq", "deseq2", "edger", "edge_r", "negative-binomial", "negativebinomial", "nb", "glmgampoi", "glm-nb")


class TestAssumptions(Check):
    id = 8
    kinds = ("de",)

    def applies_to(self, claim: Claim, design: Design) -> bool:
        return self.kind_fits(claim, False) and bool(design.grouping or design.knob("grouping"))

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        alpha = float(design.knob("alpha", 0.05))
        used = next((str(design.knob(k)) for k in ("method", "deTest", "test") if str(design.knob(k, "")).lower() in COUNT_AWARE), None)
        claimed = str(design.knob("claimedTest", "unknown")).lower()
        if used or claimed == "wilcoxon":
            return Finding(8, base.CLEAN, f"{used or 'A rank test'} does not assume normal counts.", target=used or claimed)
        if claimed == "unknown":
            return Finding(8, base.FLAG_ONLY, "The test used was not recorded.", target="unknown")
        group, unit = design.grouping or design.knob("grouping"), design.unit
        counts = base.count_rows(ds)
        if not has(ds, group) or counts is None:
            return Finding(8, base.FLAG_ONLY, "The raw-count premise of the t-test cannot be checked here.", target="t-test")
        cells = base.unit_cells(ds, group, unit if has(ds, unit) else None)
        table = base.sample_counts(cells)
        arms = red.two_arms(table, "grp", BY, design.knob("groups"), design.knob("reference")).first()
        if arms is None:
            return Finding(8, base.FLAG_ONLY, "Fewer than two levels to compare.", target="t-test")
        kept = red.filter_arms(cells, "grp", arms["ref"], arms["alt"])
        samples = hold(red.filter_arms(table, "grp", arms["ref"], arms["alt"]))
        sizes = arm_sizes(samples)
        moments = hold(red.sample_moments(counts, kept, BY))
        audited = inf.pick_gene(inf.welch_from_moments(moments, sizes, BY, "raw"), BY).first()
        od = red.moments_overdispersion(moments, sizes, BY).first()
        ratio = od["overdispersion"] if od else 1.0
        if audited is None:
            return Finding(8, base.FLAG_ONLY, "No feature is expressed in the compared cells.", target="t-test")
        p, engine = replicate_p(moments, samples, audited["gene"], design.knob("engine", "welch"))
        n_cells = arms["n_ref"] + arms["n_alt"]
        n_units = samples.select("unit").distinct().count() if has(ds, unit) else n_cells
        flips = audited["p"] < alpha <= p
        return Finding(
            8,
            base.FLAGGED,
            f"Counts vary {ratio:.1f}x their mean; the t-test's p {p_words(audited['p'])} is {p_words(p)} under a fitting test"
            + (" and is lost." if flips else "."),
            original=audited["p"],
            corrected=p,
            engine=engine,
            target=audited["gene"],
            numbers={"overdispersion": ratio, "n_cells": n_cells, "n_units": n_units},
            charts={"significance": base.significance(n_cells, audited["p"], n_units, p, alpha, True)},
        )
