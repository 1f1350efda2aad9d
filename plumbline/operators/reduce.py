"""Reductions from cell x feature counts to small per-unit, per-arm, per-feature tables.

`cells` joins to `counts` once on the cell key; everything after it is a map-side-combined
aggregate. Joins carry no broadcast hint: adaptive execution broadcasts a side when its
measured size allows and otherwise shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.stats import variance_from_sums
from plumbline.operators.ordered import attach, top_k


# --- expression scales -------------------------------------------------------------
def log1p_counts(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def log1p_cpm(value: Column, library: Column) -> Column:
    return F.when(library > 0, F.log1p(value / library * 1e6)).otherwise(F.lit(0.0))


def log1p_cp10k(value: Column, library: Column) -> Column:
    return F.log1p(value / F.greatest(library, F.lit(1.0)) * 1e4)


def log2_fold(mean_ref: Column, mean_alt: Column) -> Column:
    """Fold change between means on the natural log1p scale."""
    return (mean_alt - mean_ref) / F.log(F.lit(2.0))


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("library"))


def with_library(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Library size stored on the cell once, so no later step rescans counts for it."""
    return cells.join(cell_totals(counts), "cell_id", "left").withColumn(
        "library", F.coalesce("library", F.lit(0.0))
    )


# --- arms --------------------------------------------------------------------------
def level_counts(cells: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Cells per level; rows already counted carry their weight in `n_cells`."""
    n = F.sum("n_cells") if "n_cells" in cells.columns else F.count("*")
    return (
        cells.withColumn("level", F.col(group).cast("string"))
        .filter(F.col("level").isNotNull())
        .groupBy(*by, "level")
        .agg(n.alias("n"))
    )


def busiest_levels(cells: DataFrame, group: str, by: list[str]) -> DataFrame:
    """The two most populous levels per case, ties to the smaller label; no orientation."""
    top = top_k(level_counts(cells, group, by), by, [F.desc("n"), F.asc("level")], 2, out="rn")
    return (
        top.groupBy(*by)
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("level"))).alias("ref"),
            F.max(F.when(F.col("rn") == 2, F.col("level"))).alias("alt"),
            F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("n_ref"),
            F.max(F.when(F.col("rn") == 2, F.col("n"))).alias("n_alt"),
        )
        .filter(F.col("alt").isNotNull())
    )


def two_arms(
    cells: DataFrame, group: str, by: list[str], groups: tuple[str, str] | None = None, reference: str | None = None
) -> DataFrame:
    """(ref, alt) per case: explicit pair, else a named reference, else the busiest two.

    A control-looking level becomes the reference when only the second of the two looks
    like one. Cases with fewer than two levels, or an empty arm, have no row.
    """
    from plumbline.functions.labels import is_control_col

    if groups:
        ref, alt = map(str, groups)
        pair = level_counts(cells, group, by).filter(F.col("level").isin(ref, alt))
        out = pair.groupBy(*by).agg(
            F.sum(F.when(F.col("level") == ref, F.col("n"))).alias("n_ref"),
            F.sum(F.when(F.col("level") == alt, F.col("n"))).alias("n_alt"),
        )
        return (
            out.filter(F.col("n_ref").isNotNull() & F.col("n_alt").isNotNull())
            .select(*by, F.lit(ref).alias("ref"), F.lit(alt).alias("alt"), "n_ref", "n_alt")
        )
    top = busiest_levels(cells, group, by)
    swap = is_control_col(F.col("alt")) & ~is_control_col(F.col("ref"))
    oriented = top.select(
        *by,
        F.when(swap, F.col("alt")).otherwise(F.col("ref")).alias("ref"),
        F.when(swap, F.col("ref")).otherwise(F.col("alt")).alias("alt"),
        F.when(swap, F.col("n_alt")).otherwise(F.col("n_ref")).alias("n_ref"),
        F.when(swap, F.col("n_ref")).otherwise(F.col("n_alt")).alias("n_alt"),
    )
    if reference is None:
        return oriented
    named = level_counts(cells, group, by).filter(F.col("level") == str(reference)).select(*by, F.col("n").alias("__n"))
    first_other = top.select(
        *by,
        F.when(F.col("ref") == str(reference), F.col("alt")).otherwise(F.col("ref")).alias("__alt"),
        F.when(F.col("ref") == str(reference), F.col("n_alt")).otherwise(F.col("n_ref")).alias("__na"),
    )
    has = F.col("__n").isNotNull()
    return (
        oriented.join(named, by, "left")
        .join(first_other, by)
        .select(
            *by,
            F.when(has, F.lit(str(reference))).otherwise(F.col("ref")).alias("ref"),
            F.when(has, F.col("__alt")).otherwise(F.col("alt")).alias("alt"),
            F.when(has, F.col("__n")).otherwise(F.col("n_ref")).alias("n_ref"),
            F.when(has, F.col("__na")).otherwise(F.col("n_alt")).alias("n_alt"),
        )
    )


def keep_arms(cells: DataFrame, group: str, arms: DataFrame, by: list[str]) -> DataFrame:
    """Rows in either arm, with `arm` = 'ref' / 'alt'; labels compare as strings."""
    label = F.col(group).cast("string")
    return (
        attach(cells, arms.select(*by, "ref", "alt"), by)
        .filter((label == F.col("ref")) | (label == F.col("alt")))
        .withColumn("arm", F.when(label == F.col("ref"), F.lit("ref")).otherwise(F.lit("alt")))
    )


def filter_arms(cells: DataFrame, group: str, ref: str, alt: str) -> DataFrame:
    """The same for one dataset whose arms are known: a literal filter the scan can push down."""
    label = F.col(group).cast("string")
    return cells.filter(label.isin(ref, alt)).withColumn(
        "arm", F.when(label == ref, F.lit("ref")).otherwise(F.lit("alt"))
    )


def arm_sizes(kept: DataFrame, by: list[str]) -> DataFrame:
    return kept.groupBy(*by).agg(
        F.count_if(F.col("arm") == "ref").alias("n_ref"), F.count_if(F.col("arm") == "alt").alias("n_alt")
    )


# --- feature-level moments ---------------------------------------------------------
def measured(counts: DataFrame, kept: DataFrame, cols: list[str]) -> DataFrame:
    """Non-zero count rows of the kept cells, carrying the role columns in `cols`."""
    return counts.select("cell_id", "gene", "value").join(kept.select("cell_id", *cols), "cell_id")


def expressed(counts: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Features whose total over the kept cells is above zero."""
    return (
        measured(counts, kept, by)
        .groupBy(*by, "gene")
        .agg(F.sum("value").alias("total"))
        .filter(F.col("total") > 0)
    )


def arm_moments(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Power sums per feature and arm, both arms on one row."""
    x = rows.withColumn("__x", value)
    ref, alt = F.col("arm") == "ref", F.col("arm") == "alt"
    zero = F.lit(0.0)
    return x.groupBy(*by, "gene").agg(
        F.sum(F.when(ref, F.col("__x")).otherwise(zero)).alias("s1_ref"),
        F.sum(F.when(ref, F.col("__x") * F.col("__x")).otherwise(zero)).alias("s2_ref"),
        F.sum(F.when(alt, F.col("__x")).otherwise(zero)).alias("s1_alt"),
        F.sum(F.when(alt, F.col("__x") * F.col("__x")).otherwise(zero)).alias("s2_alt"),
    )


def arm_means(moments: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Means and sample variances from power sums and the true arm sizes."""
    m = moments.join(sizes, by)
    out = m
    for a in ("ref", "alt"):
        n = F.col(f"n_{a}")
        out = out.withColumn(f"mean_{a}", F.try_divide(f"s1_{a}", n)).withColumn(
            f"var_{a}", variance_from_sums(F.col(f"s1_{a}"), F.col(f"s2_{a}"), n)
        )
    return out.drop("s1_ref", "s2_ref", "s1_alt", "s2_alt")


# --- replicate-level tables --------------------------------------------------------
def pseudobulk(counts: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded counts summed per sample key and feature; all-zero features drop out."""
    return (
        measured(counts, cells, keys)
        .groupBy(*keys, "gene")
        .agg(F.sum(F.round("value")).cast("long").alias("total"))
        .filter(F.col("total") > 0)
    )


def sample_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pseudobulk sample with its cell count."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))


def unit_means(counts: DataFrame, kept: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean of `value` per (unit, arm, feature) over every cell of the sample."""
    keys = [*by, "unit", "arm"]
    extra = ["library"] if "library" in kept.columns else []
    sums = (
        measured(counts, kept, [*keys, *extra])
        .withColumn("__x", value)
        .groupBy(*keys, "gene")
        .agg(F.sum("__x").alias("__s"))
    )
    return sums.join(sample_table(kept, keys), keys).select(
        *keys, "gene", "n_cells", (F.col("__s") / F.col("n_cells")).alias("value")
    )


def unit_cpm(counts: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """log1p CPM of the summed counts of each (unit, arm) sample."""
    keys = [*by, "unit", "arm"]
    sums = measured(counts, kept, keys).groupBy(*keys, "gene").agg(F.sum("value").alias("total"))
    depth = sums.groupBy(*keys).agg(F.sum("total").alias("depth"))
    return sums.join(depth, keys).withColumn("value", log1p_cpm(F.col("total"), F.col("depth")))


def unit_arm_sizes(kept: DataFrame, by: list[str]) -> DataFrame:
    """Number of (unit, arm) samples per arm."""
    return arm_sizes(kept.select(*by, "unit", "arm").distinct(), by)


def focus_values(counts: DataFrame, kept: DataFrame, by: list[str], gene: str | None = None) -> DataFrame:
    """One row per kept cell with the audited feature's count, zeros included.

    The feature is `gene`, or per case the one named in a `gene` column of `kept`.
    """
    rows = counts.select("cell_id", "gene", "value")
    if gene is not None:
        rows = rows.filter(F.col("gene") == gene)
        return kept.join(rows.select("cell_id", "value"), "cell_id", "left").withColumn(
            "value", F.coalesce("value", F.lit(0.0))
        )
    return kept.join(rows, ["cell_id", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unit_profiles(focus: DataFrame, by: list[str]) -> DataFrame:
    """Cell count and mean log1p of the audited feature per (unit, arm)."""
    return focus.groupBy(*by, "unit", "arm").agg(
        F.count("*").alias("n"), F.avg(log1p_counts(F.col("value"))).alias("value")
    )


def replicates(kept: DataFrame, by: list[str]) -> DataFrame:
    """Units per arm, the smaller arm, units overall, and distinct (unit, arm) samples."""
    samples = kept.groupBy(*by, "unit").agg(
        F.max((F.col("arm") == "ref").cast("int")).alias("r"), F.max((F.col("arm") == "alt").cast("int")).alias("a")
    )
    return samples.groupBy(*by).agg(
        F.sum("r").alias("units_ref"),
        F.sum("a").alias("units_alt"),
        F.least(F.sum("r"), F.sum("a")).alias("per_group"),
        F.count("*").alias("total_units"),
        F.sum(F.col("r") + F.col("a")).alias("n_samples"),
    )


def bad_unit(cells: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """A unit column with about one value per row is the cell, not the replicate."""
    n = F.sum("n_cells") if "n_cells" in cells.columns else F.count("*")
    per = cells.groupBy(*by, unit).agg(n.alias("n"))
    return (
        per.groupBy(*by)
        .agg(F.count_if(F.col(unit).isNotNull()).alias("units"), F.sum("n").alias("n"))
        .withColumn("bad_unit", F.col("units") >= F.greatest(F.col("n") * 0.9, F.col("n") - 1))
    )


def overdispersion(counts: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Mean population variance over mean across expressed features; 1 when there are none."""
    n = kept.groupBy(*by).agg(F.count("*").alias("n"))
    per = (
        measured(counts, kept, by)
        .groupBy(*by, "gene")
        .agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
        .filter(F.col("s1") > 0)
        .join(n, by)
        .withColumn("m", F.col("s1") / F.col("n"))
        .withColumn("ratio", (F.col("s2") / F.col("n") - F.col("m") * F.col("m")) / F.col("m"))
    )
    return (
        n.join(per.groupBy(*by).agg(F.avg("ratio").alias("r")), by, "left")
        .select(*by, F.coalesce("r", F.lit(1.0)).alias("overdispersion"))
    )


def highly_variable(counts: DataFrame, cells: DataFrame, by: list[str], top: int = 25, min_rate: float = 0.02):
    """Top features by population variance of log1p counts among those detected in >= 2 % of cells."""
    return variable_features(measured(counts, cells, by), cells, by, top, min_rate)


def variable_features(rows: DataFrame, cells: DataFrame, by: list[str], top: int = 25, min_rate: float = 0.02):
    """`highly_variable` of rows already `measured`."""
    n = cells.groupBy(*by).agg(F.count("*").alias("n"))
    per = (
        rows.withColumn("x", log1p_counts(F.col("value")))
        .groupBy(*by, "gene")
        .agg(
            F.count_if(F.col("value") > 0).alias("detected"),
            F.sum("x").alias("s1"),
            F.sum(F.col("x") * F.col("x")).alias("s2"),
        )
        .join(n, by)
        .filter(F.col("detected") >= F.col("n") * min_rate)
        .withColumn("variance", F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2))
    )
    return top_k(per, by, [F.desc(F.round("variance", 12)), F.asc("gene")], top, out="rank").select(
        *by, "gene", "variance", "rank"
    )


def qc_covariates(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """Detected features and percent of counts in flagged (`mt`) features, per cell."""
    per = (
        counts.join(features.select("gene", "mt"), "gene", "left")
        .groupBy("cell_id")
        .agg(
            F.count_if(F.col("value") > 0).alias("n_genes"),
            F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0.0)).alias("__mt"),
            F.sum("value").alias("__all"),
        )
    )
    return cells.join(per, "cell_id", "left").select(
        *cells.columns,
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        F.coalesce(F.when(F.col("__all") > 0, F.col("__mt") / F.col("__all") * 100), F.lit(0.0)).alias("pct_mt"),
    )


def icc(rows: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """Between-unit share of variance; null with fewer than two units or no variance."""
    per = rows.groupBy(*by, unit).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    total = F.col("between") + F.col("within")
    return (
        per.groupBy(*by)
        .agg(
            F.count("*").alias("units"),
            F.var_samp("m").alias("between"),
            F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("v"))), F.lit(0.0)).alias("within"),
        )
        .withColumn("icc", F.when((F.col("units") >= 2) & (total > 0), F.col("between") / total))
    )


def to_vectors(rows: DataFrame, genes: DataFrame, value: str) -> DataFrame:
    """ML vectors per cell over features numbered by `pos`; a cell holds at most one row per feature."""
    from pyspark.ml.functions import array_to_vector

    width = genes.count()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scatter(pos: pd.Series, val: pd.Series) -> pd.Series:
        out = np.zeros((len(pos), width))
        if len(pos):
            row = np.repeat(np.arange(len(pos)), pos.map(len))
            out[row, np.concatenate(pos.to_numpy())] = np.concatenate(val.to_numpy())
        return pd.Series(list(out))

    order = genes.select("gene", F.col("pos").cast("int").alias("pos"))
    packed = rows.join(order, "gene").groupBy("cell_id").agg(
        F.collect_list(F.struct("pos", F.col(value).cast("double").alias("val"))).alias("__m")
    )
    return packed.select("cell_id", array_to_vector(scatter("__m.pos", "__m.val")).alias("vec"))


def to_long(vectors: DataFrame) -> DataFrame:
    """(cell_id, pos, value) rows of the non-zero entries of an array column `vec`."""
    return vectors.select("cell_id", F.posexplode("vec").alias("pos", "value")).filter(F.col("value") != 0)


def sample_moments(counts: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """The one heavy pass behind the replicate checks.

    Per (unit, arm, feature): sums of raw counts and of log1p, and of their squares. Naive
    tests, pseudobulk, CPM of sums, ICC and overdispersion all derive from these rows.
    """
    keys = [*by, "unit", "arm"]
    x = log1p_counts(F.col("value"))
    return (
        measured(counts, kept, keys)
        .groupBy(*keys, "gene")
        .agg(
            F.sum("value").alias("total"),
            F.sum(F.col("value") * F.col("value")).alias("total_sq"),
            F.sum(x).alias("log_sum"),
            F.sum(x * x).alias("log_sq"),
        )
    )


def arm_totals(moments: DataFrame, by: list[str], s1: str, s2: str) -> DataFrame:
    """Per-feature arm power sums out of `sample_moments`."""
    ref, alt = F.col("arm") == "ref", F.col("arm") == "alt"
    pick = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    return moments.groupBy(*by, "gene").agg(
        pick(ref, s1).alias("s1_ref"), pick(ref, s2).alias("s2_ref"), pick(alt, s1).alias("s1_alt"), pick(alt, s2).alias("s2_alt")
    )


def moments_icc(moments: DataFrame, samples: DataFrame, by: list[str], gene: str) -> DataFrame:
    """ICC of log1p over units for one feature, from sample sums; `samples` has n_cells."""
    one = moments.filter(F.col("gene") == gene).select(*by, "unit", "arm", "log_sum", "log_sq")
    per = (
        samples.join(one, [*by, "unit", "arm"], "left")
        .groupBy(*by, "unit")
        .agg(
            F.sum("n_cells").alias("n"),
            F.sum(F.coalesce("log_sum", F.lit(0.0))).alias("s1"),
            F.sum(F.coalesce("log_sq", F.lit(0.0))).alias("s2"),
        )
        .withColumn("m", F.col("s1") / F.col("n"))
        .withColumn("v", variance_from_sums(F.col("s1"), F.col("s2"), F.col("n")))
    )
    total = F.col("between") + F.col("within")
    return (
        per.groupBy(*by)
        .agg(F.count("*").alias("units"), F.var_samp("m").alias("between"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("within"))
        .withColumn("icc", F.when((F.col("units") >= 2) & (total > 0), F.col("between") / total))
    )


def moments_cpm(moments: DataFrame, by: list[str]) -> DataFrame:
    """log1p CPM of each (unit, arm, feature) sum."""
    keys = [*by, "unit", "arm"]
    depth = moments.groupBy(*keys).agg(F.sum("total").alias("depth"))
    return moments.join(depth, keys).withColumn("value", log1p_cpm(F.col("total"), F.col("depth")))


def moments_overdispersion(moments: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    n = F.col("n_ref") + F.col("n_alt")
    per = (
        moments.groupBy(*by, "gene")
        .agg(F.sum("total").alias("s1"), F.sum("total_sq").alias("s2"))
        .filter(F.col("s1") > 0)
        .join(sizes, by)
        .withColumn("m", F.col("s1") / n)
        .withColumn("ratio", (F.col("s2") / n - F.col("m") * F.col("m")) / F.col("m"))
    )
    return per.groupBy(*by).agg(F.avg("ratio").alias("overdispersion"))
