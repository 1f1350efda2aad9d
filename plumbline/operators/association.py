"""Association between two categorical columns, and whether a design can separate them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.functions.labels import column as named
from plumbline.session import keep


def contingency(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Occupied cells of the a x b grid in long form."""
    return (
        df.select(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(*by, "a", "b")
        .agg(F.count("*").alias("n"))
    )


def dense_grid(occupied: DataFrame, by: list[str]) -> DataFrame:
    """The grid with its empty cells, for display; its size is the product of the level counts."""
    levels = occupied.groupBy(*by).agg(
        F.array_sort(F.collect_set("a")).alias("as"), F.array_sort(F.collect_set("b")).alias("bs")
    )
    full = levels.withColumn("a", F.explode("as")).withColumn("b", F.explode("bs")).select(*by, "a", "b")
    return full.join(occupied, [*by, "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def association(occupied: DataFrame, by: list[str]) -> DataFrame:
    """n, levels, chi2 without continuity correction, Cramer's V and perfect nesting, per group."""
    rows = occupied.groupBy(*by, "a").agg(F.sum("n").alias("ra"), F.count("*").alias("used"))
    cols = occupied.groupBy(*by, "b").agg(F.sum("n").alias("cb"), F.count("*").alias("used"))
    r = rows.groupBy(*by).agg(
        F.count("*").alias("levels_a"), F.max("used").alias("__ua"), F.sum("ra").alias("n")
    )
    c = cols.groupBy(*by).agg(F.count("*").alias("levels_b"), F.max("used").alias("__ub"))
    chi = (
        occupied.join(rows.drop("used"), [*by, "a"])
        .join(cols.drop("used"), [*by, "b"])
        .groupBy(*by)
        .agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb").cast("double"))).alias("__f"))
    )
    k = F.least("levels_a", "levels_b") - 1
    chi2 = F.greatest(F.col("n") * (F.col("__f") - 1), F.lit(0.0))
    return (
        r.join(c, by)
        .join(chi, by)
        .withColumn("chi2", chi2)
        .withColumn("v", F.when(k < 1, F.lit(0.0)).otherwise(F.sqrt(F.col("chi2") / (F.col("n") * k))))
        .withColumn("nested", (F.col("__ua") <= 1) | (F.col("__ub") <= 1))
        .drop("__f", "__ua", "__ub")
    )


def cramers_v(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return association(contingency(df, by, a, b), by)


def technical_long(df: DataFrame, by: list[str], interest: str, technical: list[str]) -> DataFrame:
    """Technical columns stacked as (column, a, b) so one pass scores them all."""
    cols = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), named(c).cast("string").alias("b"))
            for i, c in enumerate(technical)
        ]
    )
    return df.select(*by, named(interest).cast("string").alias("a"), F.explode(cols).alias("s")).select(
        *by, "s.pos", "s.column", "a", "s.b"
    )


def technical_scores(df: DataFrame, by: list[str], interest: str, technical: list[str]) -> DataFrame:
    keys = [*by, "pos", "column"]
    long = technical_long(df, by, interest, technical)
    return association(contingency(long, keys, "a", "b"), keys)


def most_aligned(scores: DataFrame, by: list[str]) -> DataFrame:
    """The technical column with the highest V; the first candidate wins a tie."""
    best = F.max_by(F.struct("column", "v", "chi2", "nested"), F.struct(F.round("v", 12), -F.col("pos")))
    return scores.groupBy(*by).agg(best.alias("s")).select(*by, "s.column", "s.v", "s.nested")


PRIME = 2**31 - 1
#: Remaining levels up to which a design is finished as one dense block of a task, 2 MB.
BLOCK = 512


def _dense_rank(width: int):
    """Rank modulo PRIME of one design's remaining cross-product, by elimination with any pivot."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows.iloc[:1, :width]
        names = pd.Index(pd.unique(pd.concat([rows["a"], rows["b"]])))
        m = np.zeros((len(names), len(names)), np.int64)
        m[names.get_indexer(rows["a"]), names.get_indexer(rows["b"])] = rows["x"].to_numpy()
        rank, row = 0, 0
        for col in range(len(names)):
            at = np.flatnonzero(m[row:, col])
            if not len(at):
                continue
            m[[row, row + at[0]]] = m[[row + at[0], row]]
            m[row] = m[row] * pow(int(m[row, col]), -1, PRIME) % PRIME
            rest = np.flatnonzero(m[row + 1 :, col]) + row + 1
            m[rest] = (m[rest] - m[rest, col][:, None] * m[row][None, :]) % PRIME
            rank, row = rank + 1, row + 1
            if row == len(names):
                break
        return keys.assign(rank=rank)

    return run


@F.pandas_udf(LongType())
def _inverse(x: pd.Series) -> pd.Series:
    return x.map(lambda v: pow(int(v), -1, PRIME))


def _eliminate(m: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: the rank of an independent set of pivots per design, and the cross-product that they leave.

    A level is a pivot if it has fewer partners than each of its partners (ties by hash), so no two pivots meet and
    all go at once. Eliminating one adds entries only among its partners. A cross-product is semi-definite:
    a level whose own entry is zero has none.
    """
    off = m.where("a <> b")
    degree = off.groupBy(*by, "a").agg(F.count("*").alias("d"))
    prio = lambda c, d: F.struct(F.col(d), F.xxhash64(c), F.col(c))
    ends = degree.select(*by, "a", prio("a", "d").alias("pa"))
    met = off.join(ends, [*by, "a"]).join(ends.select(*by, F.col("a").alias("b"), F.col("pa").alias("pb")), [*by, "b"])
    beaten = met.groupBy(*by, "a").agg(F.bool_or(F.col("pb") < F.col("pa")).alias("beaten")).where("beaten").select(*by, "a")
    own = m.where("a = b").select(*by, F.col("a").alias("p"), F.col("x").alias("own"))
    pivots = keep(own.join(beaten.withColumnRenamed("a", "p"), [*by, "p"], "left_anti"))
    ranks = pivots.groupBy(*by).agg(F.count("*").alias("rank"))
    name = pivots.select(*by, "p")
    rest = m.join(name.withColumnRenamed("p", "a"), [*by, "a"], "left_anti").join(name.withColumnRenamed("p", "b"), [*by, "b"], "left_anti")
    arms = m.where("a <> b").withColumnRenamed("a", "p").join(pivots.withColumn("inverse", _inverse("own")), [*by, "p"])
    left = arms.select(*by, "p", F.col("b").alias("a"), (F.col("x") * F.col("inverse") % PRIME).alias("y"))
    fill = left.join(arms.select(*by, "p", "b", "x"), [*by, "p"]).select(*by, "a", "b", (PRIME - F.col("y") * F.col("x") % PRIME).alias("x"))
    grown = rest.unionByName(fill).groupBy(*by, "a", "b").agg((F.sum("x") % PRIME).alias("x")).where("x <> 0")
    return ranks, keep(grown)


def design_rank(df: DataFrame, by: list[str], factors: list[str], block: int = BLOCK) -> DataFrame:
    """Rank of intercept + drop-first one-hots of all factors against its column count, for any number of levels.

    These columns span the same space as all one-hot columns, whose cross-product X'X is made of level and level-pair
    counts, so the rank is taken on pairwise counts; rows with a missing level are left out. The elimination is
    exact, in whole numbers modulo a prime, and keyed by level: rounds of independent pivots until `block` levels
    remain per design, which one task finishes. A rank modulo a prime is never above the true one, so no deficiency goes
    unseen; it is below with a chance of about levels / 2^31.
    """
    whole = df.select(*by, *[F.col(f).cast("string").alias(f) for f in factors]).dropna(subset=factors)
    levels = F.array(*[F.concat(F.lit(f"{i}\x1f"), F.col(f)) for i, f in enumerate(factors)])
    pairs = F.flatten(F.transform(levels, lambda a: F.transform(levels, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    combos = whole.groupBy(*by, *factors).agg(F.count("*").alias("n"))
    entries = combos.select(*by, "n", F.explode(pairs).alias("e")).groupBy(*by, F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    m = keep(entries.agg((F.sum("n") % PRIME).alias("x")).where("x <> 0"))
    columns = m.where("a = b").groupBy(*by).agg((F.count("*") - F.lit(len(factors) - 1)).cast("int").alias("columns"))
    ranks = None
    while (m.where("a = b").groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > block:
        part, m = _eliminate(m, by)
        ranks = part if ranks is None else ranks.unionByName(part)
    last = m.select(*by, "a", "b", "x").groupBy(*by).applyInPandas(_dense_rank(len(by)), f"{', '.join(f'{c} {t}' for c, t in df.select(*by).dtypes)}, rank long")
    ranks = last if ranks is None else ranks.unionByName(last)
    total = ranks.groupBy(*by).agg(F.sum("rank").cast("int").alias("rank"))
    return columns.join(total, by).select(*by, "columns", "rank", (F.col("rank") < F.col("columns")).alias("rank_deficient"))
