"""Replicate- and feature-level tests, error-rate control and their top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import neg_log10
from plumbline.functions.stats import guarded_p, ols_pvalue, t_pvalue, welch_columns
from plumbline.operators import ordered
from plumbline.operators.reduce import (
    arm_means,
    arm_moments,
    arm_sizes,
    arm_totals,
    log2_fold,
    measured,
    unit_arm_sizes,
)


def welch(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Welch test of alternate against reference over rows with an `arm` column."""
    ref, alt = F.col("arm") == "ref", F.col("arm") == "alt"
    x = rows.withColumn("__x", value)
    agg = x.groupBy(*by).agg(
        F.count_if(ref).alias("n_ref"),
        F.count_if(alt).alias("n_alt"),
        F.avg(F.when(ref, F.col("__x"))).alias("mean_ref"),
        F.avg(F.when(alt, F.col("__x"))).alias("mean_alt"),
        F.var_samp(F.when(ref, F.col("__x"))).alias("var_ref"),
        F.var_samp(F.when(alt, F.col("__x"))).alias("var_alt"),
    )
    return _welch_finish(agg)


def _welch_finish(agg: DataFrame) -> DataFrame:
    t, df = welch_columns(
        F.col("mean_ref"), F.col("var_ref"), F.col("n_ref"), F.col("mean_alt"), F.col("var_alt"), F.col("n_alt")
    )
    out = agg.withColumn("t", t).withColumn("df", df)
    return out.withColumn("p", guarded_p(F.col("t"), F.col("df"), F.col("n_ref"), F.col("n_alt")))


def welch_by_gene(counts: DataFrame, kept: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Cell-level Welch per feature from power sums; absent rows count as zeros."""
    extra = ["library"] if "library" in kept.columns else []
    rows = measured(counts, kept, [*by, "arm", *extra])
    return _gene_welch(arm_moments(rows, by, value), arm_sizes(kept, by), by)


def welch_by_gene_units(unit_values: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Replicate-level Welch per feature over (unit, arm) values; absent samples count as zeros."""
    return _gene_welch(arm_moments(unit_values, by, F.col("value")), unit_arm_sizes(kept, by), by)


def _gene_welch(moments: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    m = _welch_finish(arm_means(moments, sizes, by))
    return m.withColumn("log2fc", log2_fold(F.col("mean_ref"), F.col("mean_alt")))


def welch_from_moments(moments: DataFrame, sizes: DataFrame, by: list[str], scale: str = "log") -> DataFrame:
    """Cell-level Welch per feature out of `sample_moments`, on log1p or raw counts."""
    s1, s2 = ("log_sum", "log_sq") if scale == "log" else ("total", "total_sq")
    return _gene_welch(arm_totals(moments, by, s1, s2), sizes, by)


def pick_gene(tests: DataFrame, by: list[str]) -> DataFrame:
    """The feature the naive test calls most confidently: largest |t|, ties to the first name.

    With an arm below two cells it is the feature with the highest mean.
    """
    thin = (F.col("n_ref") < 2) | (F.col("n_alt") < 2)
    mean = (F.col("mean_ref") * F.col("n_ref") + F.col("mean_alt") * F.col("n_alt")) / (
        F.col("n_ref") + F.col("n_alt")
    )
    score = F.round(F.when(thin, mean).otherwise(F.abs("t")), 10)
    return ordered.top_k(tests.withColumn("__score", score), by, [F.desc("__score"), F.asc("gene")], 1).drop("__score")


def most_significant(tests: DataFrame, by: list[str]) -> DataFrame:
    """The feature with the smallest p (missing counts as 1), ties to the first name."""
    p = F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0))
    return tests.groupBy(*by).agg(F.min(F.struct(p.alias("p"), F.col("gene"))).alias("s")).select(*by, "s.gene", "s.p")


# --- error-rate control ------------------------------------------------------------
_EULER = 0.5772156649015329


def harmonic(m: Column) -> Column:
    """Harmonic number: the exact sum while short, its expansion (error < 1e-15) beyond."""
    x = m.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    tail = F.log(x) + _EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4))
    return F.when(m <= 64, exact).otherwise(tail)


def fdr(tests: DataFrame, by: list[str], method: str = "bh", p: str = "p", out: str = "q") -> DataFrame:
    """Step-up q-values per group. Missing p-values stay missing and are not counted as tests.

    Equal p-values share a rank, their last.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    scale = harmonic if method == "by" else lambda m: F.lit(1.0)
    scored = ordered.step_up(tests.filter(ok), by, p, scale, out)
    return scored.unionByName(tests.filter(~ok).withColumn(out, F.lit(None).cast("double")))


def top_genes(tests: DataFrame, by: list[str], alpha: float, k: int = 25) -> DataFrame:
    """The k smallest p-values per contrast, with q and whether they survive."""
    return ordered.top_k(tests, by, [F.asc("p"), F.asc("gene")], k, out="rank").withColumn(
        "survives", F.col("q") < alpha
    )


def volcano(tests: DataFrame, by: list[str], claimed: DataFrame, alpha: float, limit: int = 200) -> DataFrame:
    """-log10 points: the top `limit` by q plus every claimed feature; `n_sig` counts all."""
    marked = (
        tests.join(claimed.select("gene").distinct().withColumn("__c", F.lit(True)), "gene", "left")
        .withColumn("claimed", F.coalesce("__c", F.lit(False)))
        .drop("__c")
        .withColumn("sig", F.col("q") < alpha)
    )
    n_sig = marked.groupBy(*by).agg(F.count_if(F.col("sig")).alias("n_sig"))
    shown = ordered.top_k(marked, by, [F.asc("q"), F.asc("p"), F.asc("gene")], limit)
    extra = marked.filter("claimed").join(shown.select(*by, "gene"), [*by, "gene"], "left_anti")
    return (
        shown.unionByName(extra)
        .join(n_sig, by)
        .withColumn("neg_log10_q", neg_log10(F.col("q")))
    )


MAX_LEVELS = 64


# --- least squares -----------------------------------------------------------------
def ols_p(rows: DataFrame, by: list[str], y: Column, xs: list[Column], coef: int, out: str = "p") -> DataFrame:
    """Two-sided p of one coefficient of y ~ xs, per group, from summed cross-products.

    `xs` includes the intercept. The sums combine map-side, so a group may be any size.
    """
    k = len(xs)
    wide = rows.withColumn("__y", y)
    for i, x in enumerate(xs):
        wide = wide.withColumn(f"__x{i}", x.cast("double"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    agg = wide.groupBy(*by).agg(
        F.array(*[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in pairs]).alias("__xtx"),
        F.array(*[F.sum(F.col(f"__x{i}") * F.col("__y")) for i in range(k)]).alias("__xty"),
        F.sum(F.col("__y") * F.col("__y")).alias("__yty"),
        F.count("*").alias("n_samples"),
    )
    return agg.select(
        *by, "n_samples", ols_pvalue(k, coef)("__xtx", "__xty", "__yty", F.col("n_samples").cast("double")).alias(out)
    )


def factor_levels(rows: DataFrame, factor: str) -> list[str]:
    """Ordered levels of a design factor; the model has one column per level, so they must be few.

    `demeaned_p` fits a single categorical with any number of levels.
    """
    levels = [r[0] for r in rows.select(F.col(factor).cast("string").alias("v")).distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{factor} has more than {MAX_LEVELS} levels")
    return levels


def dummies(factor: str, levels: list[str]) -> list[Column]:
    """Drop-first one-hot columns."""
    return [F.when(F.col(factor).cast("string") == v, 1.0).otherwise(0.0) for v in levels[1:]]


def sample_means(focus: DataFrame, by: list[str], keys: list[str], value: Column) -> DataFrame:
    """One row per pseudobulk sample: the mean of the audited value over all its cells."""
    return focus.withColumn("__v", value).groupBy(*by, *keys).agg(F.avg("__v").alias("y"))


def two_factor_p(samples: DataFrame, by: list[str], other: str, adjust: bool = True) -> DataFrame:
    """Naive (~ interest) and adjusted (~ interest + other) p on the same samples.

    `samples` has `y`, `arm` and the other factor. Adjusted is null when the factor is
    nested in the arms or the samples do not exceed the parameters.
    """
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    naive = ols_p(samples, by, F.col("y"), [F.lit(1.0), alt], 1, "naive_p")
    if not adjust:
        return naive.withColumn("adjusted_p", F.lit(None).cast("double"))
    return naive.join(demeaned_p(samples, by, other).select(*by, F.col("p").alias("adjusted_p")), by)


def demeaned_p(samples: DataFrame, by: list[str], other: str) -> DataFrame:
    """The adjusted p for interest + one categorical by removing level means first.

    Works per group with any number of levels, including levels that differ between groups.
    """
    x = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    rows = samples.withColumn("__x", x)
    means = rows.groupBy(*by, other).agg(F.avg("y").alias("__my"), F.avg("__x").alias("__mx"))
    parts = (
        rows.join(means, [*by, other])
        .withColumn("__dy", F.col("y") - F.col("__my"))
        .withColumn("__dx", F.col("__x") - F.col("__mx"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("__dx") * F.col("__dx")).alias("sxx"),
            F.sum(F.col("__dx") * F.col("__dy")).alias("sxy"),
            F.sum(F.col("__dy") * F.col("__dy")).alias("syy"),
        )
        .join(means.groupBy(*by).agg(F.count("*").alias("levels")), by)
        .withColumn("dof", F.col("n") - F.col("levels") - 1)
        .withColumn("beta", F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")))
        .withColumn("rss", F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)))
        .withColumn("se", F.when((F.col("dof") > 0) & (F.col("sxx") > 1e-12), F.sqrt(F.col("rss") / F.col("dof") / F.col("sxx"))))
        .withColumn("t", F.when((F.col("dof") > 0) & (F.col("se") > 0), F.col("beta") / F.col("se")))
    )
    p = F.when((F.col("dof") <= 0) | F.col("beta").isNull(), F.lit(None)).when(F.col("se") <= 0, F.lit(1.0)).otherwise(
        t_pvalue(F.col("t"), F.when(F.col("dof") > 0, F.col("dof")).cast("double"))
    )
    return parts.withColumn("p", p).select(*by, "n", "levels", "dof", "beta", "p")


# --- agreement ---------------------------------------------------------------------
def agreement(ours: DataFrame, published: DataFrame, by: list[str]) -> DataFrame:
    """Spearman, Pearson and sign agreement of two fold-change tables over shared features."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    pairs = (
        ours.select(*by, "gene", F.col("log2fc").alias("a"))
        .join(published.select(*by, "gene", F.col("log2fc").alias("b")), [*by, "gene"])
        .filter(finite("a") & finite("b"))
    )
    ranked = ordered.average_rank(ordered.average_rank(pairs, by, "a", "ra"), by, "b", "rb")
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("shared"),
        F.corr("ra", "rb").alias("spearman"),
        F.corr("a", "b").alias("pearson"),
        F.avg((F.signum("a") == F.signum("b")).cast("int")).alias("sign_agreement"),
    )
    return out.withColumn(
        "passed",
        (F.col("spearman") >= 0.8) & (F.col("sign_agreement") >= 0.85) & (F.col("shared") >= 50),
    )
