"""Count splitting and rank-based separation of a group by its features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.draws import binomial_md5, binomial_xx, half_draws, md5_mark, xx_mark
from plumbline.functions.stats import normal_pvalue
from plumbline.operators import ordered
from plumbline.operators.inference import fdr
from plumbline.operators.reduce import log1p_counts, measured
from plumbline.session import hold, keep


def thin(counts: DataFrame, eps: float = 0.5, seed: Column | int = 0, draw: str = "md5") -> DataFrame:
    """Splits each count into train ~ Binomial(count, eps) and test = count - train.

    Draws are keyed by (cell, feature, seed), so retries and repartitioning change nothing.
    """
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    n = F.round(F.greatest(F.col("value"), F.lit(0.0))).cast("long")
    keys = [F.col("cell_id"), F.col("gene"), seed_col.cast("string")]
    train = (binomial_md5 if draw == "md5" else binomial_xx)(n, keys, float(eps))
    out = counts.withColumn("train", train)
    return out.withColumn("test", n - F.col("train"))


def holdout_guard(n: int, eps: float) -> bool:
    """False when the smaller half would hold fewer than 20 cells."""
    e = min(max(float(eps), 0.05), 0.95)
    return round(n * min(e, 1 - e)) >= 20


HOLDS = 0.60  # held-out separation at which a marker holds


# --- AUC ---------------------------------------------------------------------------
def auc_from_hist(hist: DataFrame, by: list[str], fold: bool = True) -> DataFrame:
    """Tie-averaged AUC from (score, n1, n0) histograms; one class only gives 0.5."""
    agg = ordered.mann_whitney(hist, by, "score")
    raw = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0").cast("double")))
    raw = F.coalesce(raw, F.lit(0.5))
    return agg.withColumn("auc", F.greatest(raw, 1 - raw) if fold else raw)


def auc(rows: DataFrame, by: list[str], score: Column, label: Column, fold: bool = True) -> DataFrame:
    """AUC of a dense score against a boolean label; cost scales with distinct scores."""
    hist = (
        rows.withColumn("score", score)
        .withColumn("__l", label.cast("int"))
        .groupBy(*by, "score")
        .agg(F.sum("__l").alias("n1"), F.sum(1 - F.col("__l")).alias("n0"))
    )
    return auc_from_hist(hist, by, fold)


def gene_auc(
    rows: DataFrame, sizes: DataFrame, by: list[str], score: Column, fold: bool = True, size_keys: list[str] | None = None
) -> DataFrame:
    """AUC per (by, gene) from non-zero rows with a boolean `member`; zeros are added from `sizes`.

    `sizes` has N1 and N0 cells per `size_keys` (all of `by` unless given).
    """
    keys = [*by, "gene"]
    seen = keep(
        rows.withColumn("score", score)
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("member")).alias("n1"), F.count_if(~F.col("member")).alias("n0")),
        "histograms",
    )
    return sparse_auc(seen, sizes, keys, fold, size_keys or by)


def sparse_auc(seen: DataFrame, sizes: DataFrame, keys: list[str], fold: bool, size_keys: list[str]) -> DataFrame:
    """AUC per `keys` from (score, n1, n0) of the stored rows; the cells that have none score zero."""
    hist = seen.filter(F.col("score") != 0)
    count = lambda c: F.sum(F.when(F.col("score") != 0, F.col(c)).otherwise(0))
    genes = seen.groupBy(*keys).agg(count("n1").alias("__k1"), count("n0").alias("__k0"))
    zeros = genes.join(sizes, size_keys).select(
        *keys,
        F.lit(0.0).alias("score"),
        (F.col("N1") - F.col("__k1")).alias("n1"),
        (F.col("N0") - F.col("__k0")).alias("n0"),
    )
    return auc_from_hist(hist.unionByName(zeros), keys, fold)


def member_sizes(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.count_if(F.col("member")).alias("N1"), F.count_if(~F.col("member")).alias("N0")
    )


def one_vs_rest(counts: DataFrame, cells: DataFrame, by: list[str], state: str, fold: bool = True) -> DataFrame:
    """AUC and mean log1p of every (level, feature) against the rest of the cells.

    A level's pairs with the rest are its pairs with all cells less those within itself, which its size
    gives. So each level needs only its own scores beside the running count of all cells; no
    histogram is repeated per level. Zeros lie below everything and follow from the sizes.
    """
    rows = measured(counts, cells, [*by, state]).withColumn("score", log1p_counts(F.col("value"))).filter("score > 0")
    hist = rows.groupBy(*by, F.col(state).alias("level"), "gene", "score").agg(F.count("*").alias("n"))
    seen = hold(ordered.placed_sums(hist, [*by, "gene"], "score", "n", ["level"]))
    keys = [*by, "level", "gene"]
    own = seen.select(*keys, F.col("u").alias("__u"), F.col("n").alias("__k"), F.col("weighted").alias("__s"))
    genes = seen.groupBy(*by, "gene").agg(F.sum("n").alias("__kall"), F.sum("weighted").alias("__sall"))
    levels = cells.groupBy(*by, F.col(state).alias("level")).agg(F.count("*").alias("n1"))
    levels = levels.join(levels.groupBy(*by).agg(F.sum("n1").alias("cells")), by)
    levels = levels.join(seen.select(*by, "level").distinct(), [*by, "level"], "left_semi")
    grid = ordered.attach(genes, levels, by).join(own, keys, "left")
    k, u, s1 = (F.coalesce(c, F.lit(0)) for c in ("__k", "__u", "__s"))
    n1, n0, none = F.col("n1"), F.col("cells") - F.col("n1"), F.col("cells") - F.col("__kall")
    pairs = u + k * none + (n1 - k) * none / 2.0 - n1 * n1 / 2.0
    raw = F.coalesce(F.when((n1 > 0) & (n0 > 0), pairs / (n1 * n0.cast("double"))), F.lit(0.5))
    return grid.select(
        *keys,
        "n1",
        n0.alias("n0"),
        (F.greatest(raw, 1 - raw) if fold else raw).alias("auc"),
        F.try_divide(s1, n1).alias("mean_in"),
        F.try_divide(F.col("__sall") - s1, n0).alias("mean_out"),
    )


def rank_markers(counts: DataFrame, cells: DataFrame, by: list[str], state: str) -> DataFrame:
    """One-vs-rest rank-sum per level: z (no tie correction), p, adjusted p, log fold change."""
    a, keys = one_vs_rest(counts, cells, by, state, fold=False), [*by, "level", "gene"]
    prod = F.col("n1") * F.col("n0").cast("double")
    z = F.try_divide((F.col("auc") - 0.5) * prod, F.sqrt(prod * (F.col("n1") + F.col("n0") + 1) / 12.0))
    out = (
        a.withColumn("score", z)
        .withColumn("p", normal_pvalue("score"))
        .withColumn(
            "logfc",
            F.log2((F.expm1("mean_in") + 1e-9) / (F.expm1("mean_out") + 1e-9)),
        )
    )
    return fdr(out, [*by, "level"]).select(*keys, "score", "p", "q", "logfc", "auc")


# --- claimed groups and markers ----------------------------------------------------
def claimed_group(counts: DataFrame, cells: DataFrame, by: list[str], state: str, target: str | None, markers: list[str]) -> DataFrame:
    """The level a claim speaks about: named, else best separated by its markers, else the largest."""
    sizes = cells.groupBy(*by, F.col(state).cast("string").alias("level")).agg(F.count("*").alias("n"))
    scored = None
    if markers:
        wanted = counts.filter(F.col("gene").isin(list(markers)))
        scored = (
            one_vs_rest(wanted, cells, by, state)
            .groupBy(*by, "level")
            .agg(F.avg("auc").alias("mean_auc"))
        )
    ranked = sizes.withColumn("named", (F.col("level") == F.lit(target)) if target else F.lit(False))
    ranked = ranked.join(scored, [*by, "level"], "left") if scored is not None else ranked.withColumn(
        "mean_auc", F.lit(None).cast("double")
    )
    order = [
        F.desc("named"),
        F.desc(F.round(F.coalesce("mean_auc", F.lit(0.0)), 10)),
        F.desc("n"),
        F.asc("level"),
    ]
    return ordered.top_k(ranked, by, order, 1).select(*by, "level", "n", "mean_auc")


def best_cluster(overlap: DataFrame, by: list[str]) -> DataFrame:
    """Cluster with the largest Jaccard to the claimed group; an empty claim takes the largest.

    `overlap` has one row per cell with `cluster` and boolean `member`.
    """
    per = overlap.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.count_if(F.col("member")).alias("hit"))
    claim = per.groupBy(*by).agg(F.sum("hit").alias("claimed"))
    scored = per.join(claim, by).withColumn(
        "jaccard",
        F.when(F.col("claimed") > 0, F.col("hit") / (F.col("size") + F.col("claimed") - F.col("hit"))),
    )
    order = [F.desc(F.coalesce("jaccard", F.col("size").cast("double"))), F.asc("cluster")]
    return ordered.top_k(scored, by, order, 1).select(*by, "cluster", "size", "hit", "jaccard")


def top_markers(aucs: DataFrame, by: list[str], k: int = 4, exclude: list[str] | None = None) -> DataFrame:
    """The k features with the highest discovery AUC, after dropping excluded names."""
    src = aucs.filter(~F.col("gene").isin(list(exclude))) if exclude else aucs
    return ordered.top_k(src, by, [F.desc(F.round("auc", 10)), F.asc("gene")], k, out="rank")


def split_aucs(thinned: DataFrame, cells: DataFrame, by: list[str], extra: list[str] = ()) -> DataFrame:
    """Discovery and held-out AUC of every feature on raw log1p, `cells` carrying `member`.

    `extra` names columns of `thinned` that multiply the work, such as the split seed.
    """
    keys = [*by, *extra]
    halves = F.array(
        F.struct(F.lit("disc").alias("half"), F.col("train").alias("c")),
        F.struct(F.lit("hold").alias("half"), F.col("test").alias("c")),
    )
    long = (
        thinned.join(cells.select("cell_id", *by, "member"), "cell_id")
        .select(*keys, "gene", "member", F.explode(halves).alias("h"))
        .select(*keys, "gene", "member", "h.half", "h.c")
    )
    score = F.log1p(F.col("c").cast("double"))
    out = gene_auc(long, member_sizes(cells, by), [*keys, "half"], score, size_keys=by)
    return out.groupBy(*keys, "gene").agg(
        F.max(F.when(F.col("half") == "disc", F.col("auc"))).alias("disc"),
        F.max(F.when(F.col("half") == "hold", F.col("auc"))).alias("hold"),
    )


def _histograms(keys: list[str], seeds: list[int], even: bool, cells: int = 2_000_000):
    """Adds draws into one array per key, half, score and membership, from rows (keys, member, n, draws).

    `draws` has what the even split's draws are made of here, else the draws of all seeds. A task holds at most about `cells` numbers more than one batch brings, then hands on what it has.
    """
    repeats = len(seeds)
    width = repeats * 2

    def counted(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of a rows x repeats matrix and, per value, its count in each repeat."""
        top = int(t.max()) + 1
        values, at = (np.arange(top), t) if top <= 2 * len(t) else np.unique(t, return_inverse=True)
        at = at.reshape(t.shape) + np.arange(repeats) * len(values)
        n = np.bincount(at.ravel(), minlength=repeats * len(values)).reshape(repeats, -1).T
        some = n.any(axis=1)
        return values[some], n[some]

    def flush(sums: dict, kinds: list) -> pa.RecordBatch:
        rows = [(*k, half, int(v), a[:repeats], a[repeats:]) for (k, half, v), a in sums.items()]
        cols = list(zip(*rows, strict=True))
        types = [*kinds, pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keys, "half", "c", "a1", "a0"])

    def run(batches):
        sums: dict = {}
        for batch in batches:
            n, drawn = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1)
            train = half_draws(n, drawn, seeds) if even else drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, repeats)
            kinds = [batch.schema.field(c).type for c in keys]
            frame = pa.Table.from_batches([batch]).select([*keys, "member"]).to_pandas()
            for group, at in frame.groupby([*keys, "member"], dropna=False, sort=False).indices.items():
                k, lo = group[:-1], 0 if group[-1] else repeats
                for half, t in (("disc", train[at]), ("hold", n[at, None] - train[at])):
                    for v, c in zip(*counted(t), strict=True):
                        if (a := sums.get((k, half, v))) is None:
                            a = sums[k, half, v] = np.zeros(width, np.int64)
                        a[lo : lo + repeats] += c
            if len(sums) * width > cells:
                yield flush(sums, kinds)
                sums = {}
        if sums:
            yield flush(sums, kinds)

    return run


def repeated_split_aucs(counts: DataFrame, cells: DataFrame, by: list[str], eps: float, seed: int, repeats: int, draw: str = "md5") -> DataFrame:
    """`split_aucs` of the splits seeded seed, seed + 1, ... (column `seed`), with the same draws.

    Rows meet their cells once and are never copied: each draws all its splits as one array (an even
    split's by arrays of hashes, several rows at a time), which its task adds into arrays of counts per feature, half and score. What is shuffled follows the
    number of distinct scores, not of rows.
    """
    n = F.round(F.greatest(F.col("value"), F.lit(0.0))).cast("long")
    make, mark = (binomial_md5, md5_mark) if draw == "md5" else (binomial_xx, xx_mark)
    own, even = [F.col("cell_id"), F.col("gene")], float(eps) == 0.5
    seeds = F.sequence(F.lit(seed), F.lit(seed + repeats - 1))
    train = mark(own) if even else F.transform(seeds, lambda s: make(n, [*own, s.cast("string")], float(eps)))
    keys = [*by, "gene"]
    drawn = counts.join(cells.select("cell_id", *by, "member"), "cell_id").where(F.col("value").isNotNull())
    drawn = drawn.select(*keys, "member", n.alias("n"), train.alias("train"))
    fields = ", ".join(f"{c} {drawn.schema[c].dataType.simpleString()}" for c in keys)
    arrays = drawn.mapInArrow(_histograms(keys, list(range(seed, seed + repeats)), even), f"{fields}, half string, c long, a1 array<long>, a0 array<long>")
    long = arrays.select(*keys, "half", "c", F.posexplode(F.arrays_zip("a1", "a0")).alias("r", "a"))
    keys = [*by, "seed", "half", "gene"]
    score = F.log1p(F.col("c").cast("double")).alias("score")
    long = long.where("a.a1 > 0 OR a.a0 > 0").withColumn("seed", F.col("r") + F.lit(seed))
    seen = keep(long.groupBy(*keys, score).agg(F.sum("a.a1").alias("n1"), F.sum("a.a0").alias("n0")), "histograms")
    out = sparse_auc(seen, member_sizes(cells, by), keys, True, by)
    return out.groupBy(*by, "seed", "gene").agg(
        F.max(F.when(F.col("half") == "disc", F.col("auc"))).alias("disc"),
        F.max(F.when(F.col("half") == "hold", F.col("auc"))).alias("hold"),
    )


def holdout_report(aucs: DataFrame, markers: DataFrame, by: list[str]) -> DataFrame:
    """Per claimed marker: both AUCs and whether it holds (>= 0.60); unknown markers stay null."""
    return (
        markers.join(aucs, [*by, "gene"], "left")
        .withColumn("survives", F.coalesce(F.col("hold") >= HOLDS, F.lit(False)))
    )


def holdout_summary(report: DataFrame, by: list[str]) -> DataFrame:
    """Mean AUCs over found markers (0.5 if none) and how many hold."""
    return report.groupBy(*by).agg(
        F.count("*").alias("markers"),
        F.count("hold").alias("tested"),
        F.coalesce(F.avg("disc"), F.lit(0.5)).alias("disc_mean"),
        F.coalesce(F.avg("hold"), F.lit(0.5)).alias("hold_mean"),
        F.count_if(F.col("survives")).alias("surviving"),
    )


def mean_differences(rows: DataFrame, cells: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Member-minus-rest mean and pooled spread per feature, zeros included."""
    sizes = member_sizes(cells, [c for c in by if c in cells.columns])
    x = rows.withColumn("__x", value)
    inside = F.col("member")
    agg = x.groupBy(*by, "gene").agg(
        F.sum(F.when(inside, F.col("__x")).otherwise(0.0)).alias("s1"),
        F.sum(F.when(~inside, F.col("__x")).otherwise(0.0)).alias("s0"),
        F.sum(F.when(inside, F.col("__x") * F.col("__x")).otherwise(0.0)).alias("q1"),
        F.sum(F.when(~inside, F.col("__x") * F.col("__x")).otherwise(0.0)).alias("q0"),
    )
    m = agg.join(sizes, [c for c in by if c in cells.columns])
    mu1, mu0 = F.try_divide("s1", "N1"), F.try_divide("s0", "N0")
    v1 = F.greatest(F.try_divide("q1", "N1") - mu1 * mu1, F.lit(0.0))
    v0 = F.greatest(F.try_divide("q0", "N0") - mu0 * mu0, F.lit(0.0))
    return m.select(*by, "gene", (mu1 - mu0).alias("diff"), F.sqrt((v1 + v0) / 2).alias("pooled"))


def cell_scores(rows: DataFrame, cells: DataFrame, weights: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Weighted sum per cell over the selected features; cells without rows score 0."""
    scored = (
        rows.withColumn("__x", value)
        .join(weights.select(*by, "gene", "w"), [*by, "gene"])
        .groupBy("cell_id")
        .agg(F.sum(F.col("w") * F.col("__x")).alias("score"))
    )
    return cells.join(scored, "cell_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 10))


def mean_score_auc(thinned: DataFrame, cells: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Top-k features by discovery mean difference; AUC of their row mean on each half."""
    rows = thinned.join(cells.select("cell_id", *by, "member"), "cell_id")
    disc, hold = F.log1p(F.col("train").cast("double")), F.log1p(F.col("test").cast("double"))
    diffs = mean_differences(rows, cells, by, disc)
    top = ordered.top_k(diffs, by, [F.desc(F.round("diff", 10)), F.asc("gene")], k, out="rank")
    weights = keep(top.select(*by, "gene", F.lit(1.0 / k).alias("w")), "weights")  # both halves are scored in one pass over the rows of these features
    few = thinned.join(weights.select("gene").distinct(), "gene", "left_semi").join(cells.select("cell_id", *by, "member"), "cell_id")
    sums = few.join(weights, [*by, "gene"]).groupBy("cell_id").agg(*[F.sum(F.col("w") * x).alias(n) for n, x in (("disc", disc), ("hold", hold))])
    halves = F.explode(F.array(*[F.struct(F.lit(n).alias("half"), F.round(F.coalesce(n, F.lit(0.0)), 10).alias("score")) for n in ("disc", "hold")]))
    each = cells.join(sums, "cell_id", "left").select(*by, "member", halves.alias("h")).select(*by, "member", "h.half", "h.score")
    each = each.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by))
    found = auc(each, [*by, "half"], F.col("score"), F.col("member"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("half") == n, F.col("auc"))).alias(f"{n}_auc") for n in ("disc", "hold")])


def direction_score_auc(thinned: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Standardised mean-difference direction fitted and oriented on discovery, scored on both halves."""
    rows = thinned.join(cells.select("cell_id", *by, "member"), "cell_id")
    disc, hold = F.log1p(F.col("train").cast("double")), F.log1p(F.col("test").cast("double"))
    pooled = F.when(F.col("pooled") < 1e-8, 1.0).otherwise(F.col("pooled"))
    weights = mean_differences(rows, cells, by, disc).withColumn("w", F.col("diff") / pooled)
    d = auc(cell_scores(rows, cells, weights, by, disc), by, F.col("score"), F.col("member"), fold=False)
    h = auc(cell_scores(rows, cells, weights, by, hold), by, F.col("score"), F.col("member"), fold=False)
    out = d.select(*by, F.col("auc").alias("d")).join(h.select(*by, F.col("auc").alias("h")), by)
    flip = F.col("d") < 0.5
    return out.select(
        *by,
        F.when(flip, 1 - F.col("d")).otherwise(F.col("d")).alias("disc_auc"),
        F.when(flip, 1 - F.col("h")).otherwise(F.col("h")).alias("hold_auc"),
    )


def spurious_group(scores: DataFrame, by: list[str]) -> DataFrame:
    """Cluster whose separation collapses most: collapse >= 0.2 and held-out <= 0.65."""
    c = scores.withColumn("collapse", F.col("disc_auc") - F.col("hold_auc"))
    return ordered.top_k(
        c.filter((F.col("collapse") >= 0.2) & (F.col("hold_auc") <= 0.65)),
        by,
        [F.desc(F.round("collapse", 10)), F.asc("cluster")],
        1,
    )


def interval(repeats: DataFrame, by: list[str], value: str, level: float = 0.95, cap: int | None = None) -> DataFrame:
    """Median and linear-interpolated quantiles of repeated runs, with their sorted samples.

    `cap`, off by default, thins the samples shown to so many.

    A group holds one value per repeat (hundreds), never raw data.
    """
    lo = (1 - level) / 2
    ok = repeats.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    agg = ok.groupBy(*by).agg(
        F.percentile(value, F.array(F.lit(lo), F.lit(0.5), F.lit(1 - lo))).alias("q"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(value)).alias("sorted"),
    )
    shown = F.col("sorted")
    if cap:
        at = lambda i: F.get(F.col("sorted"), F.rint(i * (F.col("n") - 1) / float(cap - 1)).cast("int"))
        shown = F.when(F.col("n") > cap, F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), at)).otherwise(shown)
    return agg.select(
        *by,
        F.col("q")[1].alias("median"),
        F.col("q")[0].alias("lo"),
        F.col("q")[2].alias("hi"),
        F.lit(level).alias("level"),
        "n",
        shown.alias("samples"),
    )
