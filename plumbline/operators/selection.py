"""Row selection: contrasts, capped samples, and the two published-summary reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import top_k


def first_present(columns: list[str], candidates: list[str], override: str | None = None, fold_case: bool = False) -> str | None:
    """The override if it exists (else an error), otherwise the first candidate present."""
    if override is not None:
        if override not in columns:
            raise ValueError(f"column {override!r} is absent")
        return override
    lookup = {c.lower(): c for c in reversed(columns)} if fold_case else {c: c for c in columns}
    return next((lookup[k] for k in ((c.lower() if fold_case else c) for c in candidates) if k in lookup), None)


def mentions(column: str, tokens: list[str]) -> Column:
    low = F.lower(F.col(column).cast("string"))
    return reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in tokens])


def build_contrast(df: DataFrame, column: str, target: str, controls: list[str]) -> DataFrame:
    """Rows naming the target or a control token, labelled `<target>-KD` or `non-targeting`."""
    hit, ctl = mentions(column, [target]), mentions(column, controls)
    return df.filter(hit | ctl).withColumn(
        "condition", F.when(ctl, F.lit("non-targeting")).otherwise(F.lit(f"{target}-KD"))
    )


def stratified_cap(df: DataFrame, strata: list[str], key: str, size: int, seed: int = 0) -> DataFrame:
    """At most `size` rows per stratum, chosen without replacement by a keyed hash order."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return top_k(df.withColumn("__h", order), strata, [F.asc("__h"), F.asc(key)], size).drop("__h")


def design_summary(samples: DataFrame, donor: str, order: str, first: list[str], condition: str, run: str) -> DataFrame:
    """Per donor: its first record, sorted condition and run lists, and sample count."""
    return samples.groupBy(donor).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        F.array_sort(F.collect_set(condition)).alias("conditions"),
        F.array_sort(F.collect_set(run)).alias("runs"),
        F.count("*").alias("samples"),
    )


def perturbation_summary(de: DataFrame, genes: list[str], conditions: list[str], measures: list[str]) -> DataFrame:
    """Selected targets with their measures per condition, one column per (condition, measure).

    Where a target repeats within a condition, each measure is taken from the row with the smallest
    measures, so the answer does not depend on the order of rows.
    """
    key = F.struct(*[F.col(m).isNull() for m in measures], *measures)
    return (
        de.filter(F.col("gene").isin(genes))
        .groupBy("gene")
        .pivot("condition", conditions)
        .agg(*[F.min_by(m, key).alias(m) for m in measures])
    )


def significance_totals(de: DataFrame) -> DataFrame:
    return de.agg(F.count_if(F.col("significant")).alias("significant"), F.count("*").alias("rows"))
