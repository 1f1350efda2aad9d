"""Checks 2, 3 and 7: held-out markers, fragile groups, and the choice of resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.checks import base
from plumbline.checks.base import BY, Check, Finding
from plumbline.checks.replicate import has
from plumbline.dataset import Claim, Dataset, Design, case_key
from plumbline.operators import clustering as clu
from plumbline.operators import separation as sep
from plumbline.session import discard, hold, keep

# Thresholds of the decisions.
CLEAN_AUC, STABLE, DEFAULT_K, REPEATS, SWEEPS = 0.62, 0.8, 8, 200, 1


def embedding_of(ds: Dataset, counts: DataFrame | None) -> DataFrame | None:
    """The stored embedding if there is one, else components of CP10K-log1p counts."""
    if ds.embedding is not None:
        return ds.embedding.select("cell_id", "vec")
    if counts is None:
        return None
    if ds.clustered is None:
        return clu.embed(counts, ds.cells.select("cell_id"))
    if "embedding" not in ds.clustered:
        ds.clustered["embedding"] = clu.embed(counts, ds.cells.select("cell_id"))
    return ds.clustered["embedding"]


def swept(ds: Dataset, emb: DataFrame, grid: list[float], seed: int, repeats: int = 1) -> tuple[DataFrame, str]:
    """`clustering.sweep`; within an audit, checks that ask for the same sweep share it."""
    if ds.clustered is None:
        return clu.sweep(emb, grid, seed, repeats)
    asked = (tuple(grid), seed, repeats)
    if asked not in ds.clustered:
        ds.clustered[asked] = clu.sweep(emb, grid, seed, repeats)
    return ds.clustered[asked]


class DoubleDipping(Check):
    id = 2
    kinds = ("marker",)

    def applies_to(self, claim: Claim, design: Design) -> bool:
        return self.kind_fits(claim, True) and bool(design.knob("grouping") or design.grouping or design.derived)

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        split = min(max(float(design.knob("split", 0.5)), 0.05), 0.95)
        seed, repeats, draw = int(design.knob("seed", 0)), int(design.knob("repeats", REPEATS)), design.knob("draw", "xx")
        group = design.knob("grouping") or design.grouping or design.derived
        target = design.knob("target_group") or design.knob("group") or claim.group
        markers = next((list(design.knob(k)) for k in ("markers", "marker_genes", "genes") if design.knob(k)), list(claim.genes))
        counts = base.count_rows(ds)
        if counts is None:
            return Finding(2, base.FLAG_ONLY, "Count splitting needs raw counts.", feasibility=base.NEEDS_DATA)
        cells = ds.cells.select("cell_id", (F.col(group).cast("string") if has(ds, group) else F.lit(None).cast("string")).alias("level"))
        cells = keep(cells.withColumn("case_id", case_key("case", "cell_id")), "cells")
        n = cells.count()
        if not sep.holdout_guard(n, split):
            return Finding(2, base.FLAG_ONLY, "The held-out half is too small to judge.", feasibility=base.NEEDS_DATA)
        k = cells.select("level").distinct().count() if has(ds, group) else DEFAULT_K
        thinned = keep(sep.thin(counts.select("cell_id", "gene", "value"), split, seed, draw=draw), "thinned")
        train = thinned.select("cell_id", "gene", F.col("train").cast("double").alias("value")).filter("value > 0")
        emb = embedding_of(Dataset(ds.cells, features=ds.features), train)
        labels = clu.cluster_to_k(emb, max(2, min(k, n - 1)), seed)
        member = F.coalesce(F.col("level") == F.lit(str(target) if target else None), F.lit(False))
        joined = keep(cells.join(labels.select("cell_id", "cluster"), "cell_id").withColumn("member", member), "members")
        best = sep.best_cluster(joined, BY).first()
        claimed = joined.withColumn("member", F.col("cluster") == best["cluster"])
        aucs = keep(sep.split_aucs(thinned, claimed, BY), "aucs")
        discard(thinned)
        if markers:
            wanted = cells.sparkSession.createDataFrame([("case", str(m)) for m in markers], "case_id string, gene string")
        else:
            wanted = sep.top_markers(aucs.withColumnRenamed("disc", "auc"), BY).select(*BY, "gene")
        report = sep.holdout_report(aucs, wanted, BY)
        rows = [r.asDict() for r in report.select("gene", "disc", "hold", "survives").collect()]
        s = sep.holdout_summary(report, BY).first()
        spread = self.spread(counts, claimed, wanted, split, seed, repeats, draw)
        discard(cells, joined, aucs)
        ok = s["hold_mean"] >= CLEAN_AUC and s["surviving"] >= max(1, -(-s["tested"] // 2))
        return Finding(
            2,
            base.CLEAN if ok else base.FLAGGED,
            f"{s['surviving']} of {s['tested']} markers hold; separation {s['disc_mean']:.2f} at discovery, {s['hold_mean']:.2f} held out.",
            original=round(s["disc_mean"], 4),
            corrected=round(s["hold_mean"], 4),
            engine=clu.ENGINE,
            target=str(target or group or ""),
            numbers={"surviving": s["surviving"], "tested": s["tested"], "heldout_cells": round(n * min(split, 1 - split)), **spread},
            charts={"groups": {"markers": [r for r in rows if r["hold"] is not None], "split": split, "disc_auc": s["disc_mean"], "hold_auc": s["hold_mean"]}},
        )


    @staticmethod
    def spread(counts, claimed, wanted, split, seed, repeats, draw) -> dict[str, float]:
        """Median and 95 % interval of the held-out separation over `repeats` splits of all cells.

        All repeats are one job over rows that are never copied; only the tested markers are drawn again.
        """
        if repeats < 1:
            return {}
        rows = counts.select("cell_id", "gene", "value").join(wanted.select("gene").distinct(), "gene", "left_semi")
        aucs = sep.repeated_split_aucs(rows, claimed, BY, split, seed, repeats, draw)
        per = sep.holdout_summary(aucs.withColumn("survives", F.col("hold") >= sep.HOLDS), [*BY, "seed"])
        iv = sep.interval(per, BY, "hold_mean").first()
        return {"repeats": repeats} if iv is None else {"repeats": iv["n"], "hold_median": iv["median"], "hold_lo": iv["lo"], "hold_hi": iv["hi"]}


def _grid(design: Design) -> list[float]:
    lo, hi, step = (float(design.knob(k, d)) for k, d in (("min", 0.2), ("max", 2.0), ("step", 0.2)))
    return clu.resolutions(lo, hi, max(step, 0.05))


class Fragility(Check):
    id = 3
    kinds = ("cluster",)

    def applies_to(self, claim: Claim, design: Design) -> bool:
        return self.kind_fits(claim, True)

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        seed, grid = int(design.knob("seed", 0)), _grid(design)
        track = design.knob("track") or claim.group
        emb = embedding_of(ds, base.count_rows(ds))
        if emb is None:
            return Finding(3, base.FLAG_ONLY, "There is nothing to cluster.", feasibility=base.NEEDS_DATA)
        column = clu.find_track_column(ds.cells, track) if track else None
        labels, engine = swept(ds, emb, grid, seed, max(1, int(design.knob("repeats", SWEEPS))))
        labels = labels if "r" in labels.columns else labels.withColumn("r", F.lit(0))
        labels = labels.withColumn("case_id", case_key("case", "cell_id"))
        numbers, name = {}, f"'{track}'" if column else "the clustering"
        if column:
            tracked = ds.cells.select("cell_id", (F.col(column).cast("string") == str(track)).alias("tracked"))
            present = hold(clu.presence(labels.join(tracked, "cell_id"), [*BY, "r"]))
            steps = [
                {"r": grid[r["setting"]], "present": r["present"], "clusters": int(r["clusters"])}
                for r in clu.repeated_presence(present, BY, "r").orderBy("setting").collect()
            ]
            per = clu.stability(present, [*BY, "r"]).withColumnRenamed("stability", "score")
            where = [s["r"] for s in steps if s["present"]]
            numbers = {"present_lo": min(where) if where else grid[0], "present_hi": max(where) if where else grid[0]}
        else:
            per = clu.mean_ari(clu.adjacent_ari(labels, [*BY, "r"], len(grid)), [*BY, "r"]).withColumnRenamed("ari", "score") if len(grid) > 1 else None
            steps = [{"r": r, "present": None, "clusters": None} for r in grid]
        iv = sep.interval(per, BY, "score").first() if per is not None else None
        stability = 1.0 if iv is None else iv["median"]
        if iv is not None:
            numbers |= {"repeats": iv["n"], "stability_lo": iv["lo"], "stability_hi": iv["hi"]}
        ok = stability >= STABLE
        return Finding(
            3,
            base.CLEAN if ok else base.FLAGGED,
            f"{name} scores {stability:.0%} stability over {len(grid)} settings.",
            original=round(stability, 4),
            corrected=round(stability, 4),
            engine=clu.reconcile_engine([engine]),
            target=str(track or ""),
            numbers=numbers,
            charts={"fragility": {"steps": steps, "track": str(track or ""), "stability": stability}},
        )


class ResolutionChoice(Check):
    id = 7
    kinds = ("cluster",)

    def applies_to(self, claim: Claim, design: Design) -> bool:
        return self.kind_fits(claim, False)

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        seed, grid = int(design.knob("seed", 0)), _grid(design)
        criterion = str(design.knob("criterion", "silhouette")).lower()
        criterion = criterion if criterion in ("silhouette", "ari") else "silhouette"
        chosen = float(design.knob("chosen", round((grid[0] + grid[-1]) / 2, 4)))
        emb = embedding_of(ds, base.count_rows(ds))
        if emb is None:
            return Finding(7, base.FLAG_ONLY, "There is nothing to cluster.")
        labels, engine = swept(ds, emb, grid, seed)
        labels = labels.withColumn("case_id", case_key("case", "cell_id"))
        if criterion == "silhouette":
            scores = clu.silhouette(labels, len(grid)).withColumn("case_id", case_key("case", "setting"))
        else:
            scores = clu.ari_by_setting(clu.adjacent_ari(labels, BY, len(grid)), BY)
        scores = hold(scores)
        seen = {r["setting"]: r["score"] for r in scores.collect()}
        if all(v is None for v in seen.values()):
            return Finding(7, base.FLAG_ONLY, "No setting could be scored.", original=chosen)
        w = clu.supported_window(scores, BY, grid, chosen).first()
        lo, hi = w["supported_lo"], w["supported_hi"]
        justified = any(design.knob(k) for k in ("resolutionJustified", "criterionRecorded", "justified"))
        ok = justified or lo <= chosen <= hi
        steps = [
            {"r": r, "present": lo <= r <= hi, "clusters": None, "score": seen.get(i)} for i, r in enumerate(grid)
        ]
        return Finding(
            7,
            base.CLEAN if ok else base.FLAGGED,
            f"Resolution {chosen:.2f} is {'inside' if ok else 'outside'} the {criterion} window {lo:.2f} to {hi:.2f}.",
            original=chosen,
            corrected=None if ok else lo,
            engine=clu.reconcile_engine([engine]),
            target=criterion,
            numbers={"supported_lo": lo, "supported_hi": hi, "best": w["best"]},
            charts={"fragility": {"steps": steps, "track": criterion, "chosen": chosen, "supported": [lo, hi]}},
        )
