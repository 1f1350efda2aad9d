"""Embedding, k-means at a resolution, and stability of clusterings.

A sweep keeps its labels as one array per cell, aligned with the list of settings, so
comparing settings is a row-local explode and never a self-join.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import column
from plumbline.operators import ordered
from plumbline.operators.reduce import log1p_cp10k, measured, variable_features, with_library
from plumbline.session import discard, hold, keep, sweep_up

ENGINE = "KMeans (fallback)"


# --- settings ----------------------------------------------------------------------
def resolutions(lo: float, hi: float, step: float) -> list[float]:
    """lo..hi inclusive with a little slack, rounded to 4 places; a bad step becomes 0.2."""
    step = step if step > 0 else 0.2
    n = int((hi - lo + 1e-9) / step) if hi >= lo - 1e-9 else -1
    return [round(lo + i * step, 4) for i in range(n + 1)] or [lo]


def k_for(resolution: float, n: int) -> int:
    return int(max(2, min(round(3 + 4 * float(resolution)), n - 1)))


def reconcile_engine(engines: list[str]) -> str:
    """One label for a sweep; a mixed sweep reports the fallback that ran."""
    seen = list(dict.fromkeys(engines))
    fallback = [e for e in seen if "fallback" in e]
    return (fallback or seen or [""])[0] if len(seen) != 1 else seen[0]


# --- embedding ---------------------------------------------------------------------
EXTRA, TOLERANCE, POWER_ROUNDS = 10, 1e-7, 60
#: Features up to which the directions are broadcast as one matrix; beyond, cells meet them by joins.
WIDE = 50_000


def _gram(batches):
    """Rows (q, z): sums of z'z, q'z, q'q and of q, so that only width-free matrices leave a task."""
    total = None
    for pdf in batches:
        if len(pdf):
            q, z = np.array(pdf["q"].tolist()), np.array(pdf["z"].tolist())
            part = np.concatenate([z.T @ z, q.T @ z, q.T @ q, q.sum(axis=0)[None]])
            total = part if total is None else total + part
    if total is not None:
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})


def _grams(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sums = rows.select("q", "z").mapInPandas(_gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    out = np.zeros((3 * width + 1, width))
    for i, j, v in sums:
        out[i, j] = v
    return out[:width], out[width : 2 * width], out[2 * width : 3 * width], out[-1]


def _times(matrix: np.ndarray, column_: str, shift: np.ndarray | None = None):
    """Array column times a small matrix, row by row."""

    def run(batches):
        for pdf in batches:
            y = np.array(pdf[column_].tolist(), dtype=float).reshape(len(pdf), len(matrix)) @ matrix
            yield pdf.assign(**{column_: list(y if shift is None else y - shift)})

    return run


def _entries(batch, q: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow batch with cells' features `g` and values `x` as arrays: features, values, each one's row, and rows x directions X Q.

    Features that are not `used` are left out. Null values add nothing; the scores of a cell that has no other are NaN.
    """
    g, x = batch.column("g"), batch.column("x")
    sizes = np.diff(g.offsets.to_numpy())
    row, g, x = np.repeat(np.arange(len(sizes)), sizes), g.flatten().to_numpy(), x.flatten()
    valid, x, mine = x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy(), used[g]
    if not mine.all():
        row, g, x, valid = row[mine], g[mine], x[mine], valid[mine]
    y = np.stack([np.bincount(row, x * q[g, j], len(sizes)) for j in range(q.shape[1])], axis=1)
    y[(np.bincount(row, minlength=len(sizes)) > 0) & (np.bincount(row, valid, len(sizes)) == 0)] = np.nan
    return g, x, row, y


def _back(shared, names: list[str]):
    """X'(X Q) by feature, added up within the task over cells held as arrays."""

    def run(batches):
        (q, used), total = shared.value, None
        for batch in batches:
            g, x, row, y = _entries(batch, q, used)
            y = np.where(np.isnan(y) & (np.bincount(row, x != 0, len(y)) == 0)[:, None], 0.0, y)
            part = np.stack([np.bincount(g, x * y[row, j], len(q)) for j in range(q.shape[1])], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(total), pa.list_(pa.float64()))], ["gene", "z"])

    return run


def _scored(shared, turnto: np.ndarray, shift: np.ndarray):
    """Scores X Q, turned and shifted, of cells held as arrays."""

    def run(batches):
        for batch in batches:
            y = _entries(batch, *shared.value)[-1] @ turnto - shift
            ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.ListArray.from_arrays(ends, y.ravel())], ["cell_id", "vec"])

    return run


def _whiten(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with this Gram matrix orthonormal, less those that depend on others."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-12 * max(values.max(), 1e-300)
    return vectors[:, good] / np.sqrt(values[good])


def _numbered(values: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """(cell_id, copies, g, x), written once: a cell's features, by their place in `names`, and values, and its rows in `cells`.

    Features without a name have the place behind the last. `copies` is null for a cell that `cells` lacks; a cell without values has empty arrays.
    """
    index = values.sparkSession.createDataFrame([*enumerate(names), (len(names), None)], "g int, __gene string")
    met = values.join(F.broadcast(index), F.col("gene").eqNullSafe(F.col("__gene")))
    own = met.groupBy("cell_id").agg(F.collect_list(F.struct("g", F.col("x").cast("double").alias("x"))).alias("own"))
    all_ = own.join(cells.groupBy("cell_id").agg(F.count("*").alias("copies")), "cell_id", "full")
    none = F.array().cast("array<struct<g:int,x:double>>")
    all_ = all_.withColumn("own", F.coalesce("own", none))
    out = keep(all_.select(F.col("cell_id").cast(cells.schema["cell_id"].dataType), "copies", F.col("own.g").alias("g"), F.col("own.x").alias("x")), "cells")
    sweep_up(values.sparkSession)
    return out


def components(
    values: DataFrame, cells: DataFrame, k: int, seed: int = 0, extra: int = EXTRA, tolerance: float = TOLERANCE, rounds: int = POWER_ROUNDS, genes: DataFrame | None = None
) -> DataFrame:
    """(cell_id, vec): scores on at most k principal components of values (cell_id, gene, x), zeros implicit, for any width.

    Block power iteration on the centred matrix, which is never formed: with k + `extra` directions Q, a cell's rows
    give its X Q and, in the same pass, their part of X'(X Q), combined map-side by feature; centring is a correction by
    column means. Scores are never stored: up to WIDE features, cells are one written table of arrays, read as a stream, and Q is broadcast, so a
    round shuffles one row of sums per feature and task; beyond, cells meet Q by joins, and values that come partitioned by cell are not shuffled.
    The result is made from that table in place, whenever it is read. `genes`, if given, has all features of `values`, and maybe more.
    But for a broadcast Q, matrices of k + `extra` columns alone reach the driver. It ends when the k leading directions leave a residual
    of `tolerance` times the largest eigenvalue; with no more features than directions, after the first round.
    A warning tells if `rounds` are not enough. A component's sign makes its loadings sum to a positive number.
    """
    n = cells.count()
    known = (values if genes is None else genes).select("gene").where("gene is not null").distinct().limit(WIDE + 1).collect()
    names, own = sorted(r.gene for r in known), None
    if len(names) <= WIDE:
        own = _numbered(values, cells, names)
        index = values.sparkSession.createDataFrame([*enumerate(names), (len(names), None)], "g int, gene string")
        sums = own.select(F.inline(F.arrays_zip("g", "x"))).groupBy("g").agg((F.sum("x") / F.lit(max(n, 1))).alias("mu"))
        base = sums.join(F.broadcast(index), "g").select("gene", "mu")
    else:
        base = values.groupBy("gene").agg((F.sum("x") / F.lit(max(n, 1))).alias("mu"))
    base = keep(base.where("mu is not null"), "means")
    width = base.count()
    b = min(width, k + extra)
    if not b:
        return cells.select("cell_id", F.array().cast("array<double>").alias("vec"))

    def shared(q: DataFrame):
        rows = dict(q.select("gene", "q").where("gene is not null").collect())
        at = np.zeros((len(names), b))
        used = np.array([g in rows for g in [*names, None]])  # the last place is that of features without a name
        at[used[:-1]] = np.array([rows[g] for g in names if g in rows], float).reshape(-1, b)
        return values.sparkSession.sparkContext.broadcast((at, used))

    def scores(q: DataFrame, *more: Column) -> DataFrame:
        sums = F.array(*[F.sum(F.col("x") * F.get("q", F.lit(i))) for i in range(b)])
        return values.join(q.select("gene", "q"), "gene").groupBy("cell_id").agg(sums.alias("y"), *more)

    start = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.pmod(F.xxhash64("gene", i, F.lit(seed)), F.lit(2_000_001)) / 1e6 - 1.0)
    old = keep(base.select("gene", "mu", start.alias("q")).withColumn("z", F.col("q")), "directions")
    gram, worst = _grams(old, b)[0], np.inf
    for turn in range(rounds):
        q = old.select("gene", "mu", F.col("z").alias("q")).mapInPandas(_times(_whiten(gram), "q"), "gene string, mu double, q array<double>")
        first = keep(q.withColumn("z", F.col("q")), "directions")
        b = len(first.select("q").first()[0])
        # Whitened once more: one pass leaves rounding of the square of the condition number.
        again = _whiten(_grams(first, b)[0])
        q = keep(first.select("gene", "mu", "q").mapInPandas(_times(again, "q"), "gene string, mu double, q array<double>"), "directions")
        b = again.shape[1]
        c = np.array(q.agg(*[F.sum(F.col("mu") * F.get("q", F.lit(i))) for i in range(b)]).first())
        if own is None:
            z = scores(q, F.collect_list(F.struct("gene", "x")).alias("own")).select("y", F.inline("own"))
            z = z.groupBy("gene").agg(F.array(*[F.sum(F.col("x") * F.get("y", F.lit(i))) for i in range(b)]).alias("z"))
        else:
            z = own.select("g", "x").mapInArrow(_back(shared(q), names), "gene string, z array<double>")
            z = z.groupBy("gene").agg(F.array(*[F.sum(F.get("z", F.lit(i))) for i in range(b)]).alias("z"))
        centre = F.array(*[F.lit(float(v)) for v in c])
        z = q.join(z, "gene").withColumn("z", F.zip_with("z", centre, lambda s, m: s - m * F.col("mu") * F.lit(float(n)))).select("gene", "mu", "q", "z")
        new = keep(z, "directions")
        discard(old, first, q)
        gram, cross, _, ones = _grams(new, b)
        values_, turnto = np.linalg.eigh((cross + cross.T) / 2)
        values_, turnto = values_[::-1][:k], turnto[:, ::-1][:, :k]
        worst = np.sqrt(np.maximum(np.diag(turnto.T @ gram @ turnto) - values_**2, 0)).max() / max(values_[0], 1e-300)
        old = new
        if worst <= tolerance or b == width or turn == rounds - 1:
            break
    if worst > tolerance and b < width:
        warnings.warn(f"components: residual {worst:.1e} after {rounds} rounds", stacklevel=2)
    turnto = turnto * np.where(ones @ turnto < 0, -1.0, 1.0)
    kind = dict(cells.select("cell_id").dtypes)["cell_id"]
    if own is not None:
        each = own.select("cell_id", "g", "x", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return each.select("cell_id", "g", "x").mapInArrow(_scored(shared(old), turnto, c @ turnto), f"cell_id {kind}, vec array<double>")
    found = cells.select("cell_id").join(scores(old), "cell_id", "left").withColumn("y", F.coalesce("y", F.array_repeat(F.lit(0.0), b)))
    return found.mapInPandas(_times(turnto, "y", c @ turnto), f"cell_id {kind}, y array<double>").withColumnRenamed("y", "vec")


def embed(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """CP10K-log1p, centred, at most 30 principal components, over all features whatever their number."""
    rows = measured(counts, with_library(cells, counts), ["library"])
    rows = rows.select("cell_id", "gene", log1p_cp10k(F.col("value"), F.col("library")).alias("x"))
    genes = counts.select("gene").distinct()
    n, width = cells.count(), genes.count()
    rows = rows if width <= WIDE else hold(rows)  # those are read in every round
    return components(rows, cells, min(30, max(2, min(n, width) - 1)), genes=genes)


def embed_hvg(counts: DataFrame, cells: DataFrame, by: list[str], top: int = 2000, k: int = 50) -> DataFrame:
    """Most variable features, z-scored and clipped at 10, then at most k components.

    A zero count has the score -mu / sd, so scores less that are as sparse as the counts; components do not change.
    """
    deep = with_library(cells, counts)
    rows = hold(measured(counts, deep, [*by, "library"]).withColumn("x", log1p_cp10k(F.col("value"), F.col("library"))))
    n = cells.count()
    chosen = variable_features(rows, cells, by, top=top, min_rate=0.0).select("gene")
    stats = rows.join(chosen, "gene").groupBy("gene").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / n) / max(n - 1, 1))
    stats = keep(stats.select("gene", (F.col("s1") / n).alias("m"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd")), "scales")
    scaled = F.least((F.col("x") - F.col("m")) / F.col("sd"), F.lit(10.0)) + F.col("m") / F.col("sd")
    return components(rows.join(stats, "gene").select("cell_id", "gene", scaled.alias("x")), cells, min(k, max(1, stats.count())), genes=stats)


# --- clustering --------------------------------------------------------------------
#: Rows that place the first centres, by hash: a bounded sample, and runs on it. Rounds over all rows at most; a model ends when no centre moves by more than
#: MOVED of the data's spread, or a round improves its inertia by less than that share.
SEED_ROWS, RESTARTS, LLOYD_ROUNDS, MOVED = 4_096, 10, 100, 1e-4


def _first_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The best of RESTARTS k-means runs on a sample, each from k-means++: next centres drawn by squared distance to those before."""
    rng, best, least = np.random.default_rng(seed), None, np.inf
    squares = (x * x).sum(axis=1)
    for _ in range(RESTARTS):
        chosen = [int(rng.integers(len(x)))]
        far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            total = far.sum()
            at = int(np.searchsorted(np.cumsum(far), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
            chosen.append(min(at, len(x) - 1))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        c = x[chosen].copy()
        for _ in range(20):
            d = squares[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
            own = d.argmin(axis=1)
            rows = np.zeros((k, len(x)))
            rows[own, np.arange(len(x))] = 1
            size = rows.sum(axis=1, keepdims=True)
            new = np.where(size > 0, rows @ x / np.maximum(size, 1), c)
            if np.array_equal(new, c):
                break
            c = new
        inertia = float(d[np.arange(len(x)), own].sum())
        if inertia < least:
            best, least = c, inertia
    return best


def _nearest_centres(x: np.ndarray, stacked: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every model, a slice of the stacked centres: each row's nearest centre and its squared distance."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ stacked.T) + (stacked * stacked).sum(axis=1)
    out = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        own = d[:, lo:hi].argmin(axis=1)
        out.append((own, np.maximum(d[np.arange(len(x)), lo + own], 0)))
    return out


def _matrix(batch, at: int = 0) -> np.ndarray:
    """The vectors of an Arrow batch, its column `at`, as rows of one array; all are of one length."""
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(batch.num_rows, -1)


def _lloyd(shared, ends: np.ndarray):
    """A pass: per centre of every model, the rows it owns, their inertia and vector sum, added up within the task."""

    def run(batches):
        stacked, total = shared.value, None
        for batch in batches:
            rows_ = _matrix(batch) if batch.num_rows else ()
            for lo in range(0, batch.num_rows, 4096):
                x = rows_[lo : lo + 4096]
                part = np.zeros((len(stacked), x.shape[1] + 2))
                for m, (own, far) in enumerate(_nearest_centres(x, stacked, ends)):
                    rows = np.zeros((ends[m + 1] - ends[m], len(x)))
                    rows[own, np.arange(len(x))] = 1
                    part[ends[m] : ends[m + 1], 0] = rows.sum(axis=1)
                    part[ends[m] : ends[m + 1], 1] = rows @ far
                    part[ends[m] : ends[m + 1], 2:] = rows @ x
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"centre": np.arange(len(total), dtype=np.int32), "sums": list(total)}))

    return run


def fit_models(emb: DataFrame, models: list[tuple[int, int]], rounds: int = LLOYD_ROUNDS) -> tuple[list[np.ndarray], list[dict]]:
    """Centres of many k-means models (k, seed), fitted in the same scans, and how each ended.

    A round is one scan: all models' centres are one broadcast, and a task sends one row of sums per centre, whatever
    its rows. So 10 settings x 40 repeats cost as many scans as the slowest of them. Centres are width x sum of k
    numbers, set by the models asked for and not by the data. First centres come from SEED_ROWS rows at most;
    rounds run over all rows. An empty cluster keeps its centre.
    """
    spark = emb.sparkSession
    picked = emb.orderBy(F.xxhash64("cell_id"), "cell_id").limit(SEED_ROWS).select("vec").collect()
    x = np.array([r.vec for r in picked], float)
    centres = [_first_centres(x, k, seed) for k, seed in models]
    spread = float(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()) or 1.0
    report = [{"k": k, "seed": seed, "rounds": 0, "inertia": np.inf, "converged": False} for k, seed in models]
    for _ in range(rounds):
        open_ = [m for m, r in enumerate(report) if not r["converged"]]
        if not open_:
            break
        ends = np.concatenate([[0], np.cumsum([len(centres[m]) for m in open_])])
        shared = spark.sparkContext.broadcast(np.concatenate([centres[m] for m in open_]))
        parts = emb.select(F.col("vec").cast("array<double>")).mapInArrow(_lloyd(shared, ends), "centre int, sums array<double>")
        width = x.shape[1] + 2
        rows = parts.groupBy("centre").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("s")).orderBy("centre").collect()
        sums = np.array([r.s for r in rows])
        shared.unpersist()
        for j, m in enumerate(open_):
            mine = sums[ends[j] : ends[j + 1]]
            new = np.where(mine[:, :1] > 0, mine[:, 2:] / np.maximum(mine[:, :1], 1), centres[m])
            moved = ((new - centres[m]) ** 2).sum(axis=1).max()
            inertia, r = mine[:, 1].sum(), report[m]
            r["converged"] = bool(moved <= MOVED**2 * spread or r["inertia"] - inertia <= MOVED * inertia)
            r["inertia"], r["rounds"] = float(inertia), r["rounds"] + 1
            centres[m] = new
    return centres, report


def _labelled(emb: DataFrame, centres: list[np.ndarray], out: str) -> DataFrame:
    """Rows with one label per model as an array of strings."""
    ends = np.concatenate([[0], np.cumsum([len(c) for c in centres])])
    shared = emb.sparkSession.sparkContext.broadcast(np.concatenate(centres))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in emb.schema.fields)
    at = emb.columns.index("vec")

    def run(batches):
        for batch in batches:
            x, parts = _matrix(batch, at) if batch.num_rows else (), []
            for lo in range(0, batch.num_rows, 4096):
                parts += [own for own, _ in _nearest_centres(x[lo : lo + 4096], shared.value, ends)]
            models = len(ends) - 1
            own = np.stack([np.concatenate(parts[m::models]) for m in range(models)], axis=1) if parts else np.zeros((0, models), np.int64)
            cuts = np.arange(len(own) + 1, dtype=np.int32) * models
            labels = pa.ListArray.from_arrays(cuts, pa.array(own.ravel()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, labels], [*batch.schema.names, out])

    return emb.mapInArrow(run, f"{kinds}, {out} array<string>")


def cluster_to_k(emb: DataFrame, k: int, seed: int, out: str = "cluster") -> DataFrame:
    """k groups on an embedding; `emb` has an array column `vec`. Neither it nor the result is stored: a scan makes them from what `emb` reads."""
    centres, _ = fit_models(emb, [(k, seed)])
    return _labelled(emb, centres, out).withColumn(out, F.get(out, F.lit(0)))


def sweep(emb: DataFrame, settings: list[float], seed: int, repeats: int = 1) -> tuple[DataFrame, str]:
    """Labels at every resolution as one array column `labels`, plus the engine that ran.

    With `repeats`, re-seeded sweeps over the same rows, all in one fit: a row per sweep, told apart by `r`.
    Neither `emb` nor the labels are stored: a scan makes them from what `emb` reads.
    """
    n = emb.count()
    models = [(k_for(r, n), seed + i) for i in range(repeats) for r in settings]
    centres, _ = fit_models(emb, models)
    flat = _labelled(emb, centres, "labels")
    each = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda i: F.struct(i.alias("r"), F.slice("labels", i * len(settings) + 1, len(settings)).alias("l")))
    if repeats == 1:
        return flat, ENGINE
    return flat.withColumn("__s", F.explode(each)).withColumns({"r": F.col("__s.r"), "labels": F.col("__s.l")}).drop("__s"), ENGINE


# --- agreement between settings ----------------------------------------------------
def _pairs2(n: Column) -> Column:
    x = n.cast("double")
    return x * (x - 1) / 2


def adjacent_ari(labels: DataFrame, by: list[str], settings: int) -> DataFrame:
    """Adjusted Rand index of each setting with the next, per `by`."""
    links = F.transform(
        F.sequence(F.lit(0), F.lit(settings - 2)),
        lambda i: F.struct(i.alias("pair"), F.get("labels", i).alias("a"), F.get("labels", i + 1).alias("b")),
    )
    keys = [*by, "pair"]
    grid = (
        labels.select(*by, F.explode(links).alias("s"))
        .select(*by, "s.pair", "s.a", "s.b")
        .groupBy(*keys, "a", "b")
        .agg(F.count("*").alias("n"))
    )
    rows = grid.groupBy(*keys, "a").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs2(F.col("n"))).alias("sa"))
    cols = grid.groupBy(*keys, "b").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs2(F.col("n"))).alias("sb"))
    both = grid.groupBy(*keys).agg(F.sum(_pairs2(F.col("n"))).alias("sij"), F.sum("n").alias("n"))
    expected = F.col("sa") * F.col("sb") / _pairs2(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return (
        both.join(rows, keys)
        .join(cols, keys)
        .select(*keys, F.when(top == expected, F.lit(1.0)).otherwise((F.col("sij") - expected) / (top - expected)).alias("ari"))
    )


def mean_ari(ari: DataFrame, by: list[str]) -> DataFrame:
    return ari.groupBy(*by).agg(F.avg("ari").alias("ari"))


def ari_by_setting(ari: DataFrame, by: list[str]) -> DataFrame:
    """Mean ARI of every setting with its neighbours."""
    near = F.array(F.col("pair"), F.col("pair") + 1)
    return ari.select(*by, F.explode(near).alias("setting"), "ari").groupBy(*by, "setting").agg(F.avg("ari").alias("score"))


def silhouette(labels: DataFrame, settings: int) -> DataFrame:
    """Mean silhouette of every row, per setting, by squared Euclidean distance (named in `distance`).

    A row's summed distance to a cluster follows from the cluster's size, vector sum and sum of squares, so one
    pass adds those up and a second scores every row; no pair of rows is formed. Null with one cluster,
    or one per row. The cluster table has one row per setting and cluster and goes to every task;
    its size follows from the clusters asked for, not from the rows.
    """
    n = labels.count()

    def sums(batches):
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=float)
            for s in range(settings):
                names, code = np.unique([v[s] for v in pdf["labels"]], return_inverse=True)
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, code, x)
                squares = np.bincount(code, (x * x).sum(axis=1))
                yield pd.DataFrame({"setting": s, "cluster": names, "n": np.bincount(code), "q": squares, "s": list(total)})

    part = labels.select("vec", "labels").mapInPandas(sums, "setting int, cluster string, n long, q double, s array<double>")
    grown = part.select("setting", "cluster", "n", "q", F.posexplode("s").alias("i", "v")).groupBy("setting", "cluster", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    rows = grown.groupBy("setting", "cluster").agg(F.max("n").alias("n"), F.max("q").alias("q"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    table = rows.select("setting", "cluster", "n", "q", F.col("s.v").alias("s")).orderBy("setting", "cluster").collect()
    known = []
    for s in range(settings):
        mine = [r for r in table if r.setting == s]
        known.append(({r.cluster: i for i, r in enumerate(mine)}, np.array([r.n for r in mine], float), np.array([r.q for r in mine]), np.array([r.s for r in mine])))

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=float)
            for s, (names, size, squares, total) in enumerate(known):
                own = np.array([names[v[s]] for v in pdf["labels"]])
                far = np.maximum(size * (x * x).sum(axis=1)[:, None] - 2 * x @ total.T + squares, 0)
                pick = np.arange(len(own))
                a = far[pick, own] / np.maximum(size[own] - 1, 1)
                other = far / size
                other[pick, own] = np.inf
                b = other.min(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = np.where(size[own] > 1, (b - a) / np.maximum(a, b), 0.0)
                yield pd.DataFrame({"setting": [s], "total": [float(np.nansum(v))], "rows": [len(own)]})

    scored = labels.select("vec", "labels").mapInPandas(score, "setting int, total double, rows long")
    ks = F.array(*[F.lit(len(names)) for names, *_ in known])
    out = scored.groupBy("setting").agg(F.sum("total").alias("t"), F.sum("rows").alias("r")).withColumn("k", F.get(ks, F.col("setting")))
    good = (F.col("k") >= 2) & (F.col("k") < n)
    return out.select("setting", "k", F.when(good, F.col("t") / F.col("r")).alias("score"), F.lit("squared euclidean").alias("distance"))


# --- presence and stability --------------------------------------------------------
def presence(labels: DataFrame, by: list[str]) -> DataFrame:
    """Per setting: cluster count, and whether one cluster both covers and is mostly the tracked group.

    `labels` has the label array and boolean `tracked`.
    """
    per = (
        labels.select(*by, "tracked", F.posexplode("labels").alias("setting", "cluster"))
        .groupBy(*by, "setting", "cluster")
        .agg(F.count("*").alias("size"), F.count_if(F.col("tracked")).alias("hit"))
    )
    total = per.groupBy(*by, "setting").agg(F.sum("hit").alias("total"))
    good = (F.col("total") > 0) & F.coalesce(F.try_divide("hit", "total") >= 0.5, F.lit(False)) & (F.col("hit") / F.col("size") >= 0.5)
    return (
        per.join(total, [*by, "setting"])
        .groupBy(*by, "setting")
        .agg(F.count("*").alias("clusters"), F.coalesce(F.bool_or(good), F.lit(False)).alias("present"))
    )


def stability(present: DataFrame, by: list[str]) -> DataFrame:
    """Share of settings where the group is present and the range it holds over."""
    return present.groupBy(*by).agg(
        F.count("*").alias("settings"),
        F.count_if(F.col("present")).alias("present_in"),
        F.avg(F.col("present").cast("int")).alias("stability"),
        F.min(F.when(F.col("present"), F.col("setting"))).alias("first"),
        F.max(F.when(F.col("present"), F.col("setting"))).alias("last"),
    )


def repeated_presence(present: DataFrame, by: list[str], repeat: str) -> DataFrame:
    """Over repeated sweeps: presence share per setting (>= 0.5 counts) and median clusters."""
    keys = [*by, "setting"]
    return present.groupBy(*keys).agg(
        F.count_distinct(repeat).alias("repeats"),
        F.avg(F.col("present").cast("int")).alias("share"),
        (F.avg(F.col("present").cast("int")) >= 0.5).alias("present"),
        F.percentile("clusters", F.lit(0.5)).alias("clusters"),
    )


def mechanical_stability(ari: DataFrame, by: list[str], repeat: str) -> DataFrame:
    """Whole-clustering stability: median over repeats of the mean adjacent ARI; stable at >= 0.8."""
    from plumbline.operators.separation import interval

    per = mean_ari(ari, [*by, repeat])
    return interval(per, by, "ari").withColumn("stable", F.col("median") >= 0.8)


def supported_window(scores: DataFrame, by: list[str], settings: list[float], chosen: float) -> DataFrame:
    """The contiguous settings around the score peak within 0.02 of it.

    `scores` has (by, setting ordinal, score). With nothing scorable the window is the whole
    grid and the best setting is the chosen one.
    """
    s = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    peak = s.groupBy(*by).agg(F.max(F.struct("score", -F.col("setting"))).alias("m")).select(
        *by, F.col("m.score").alias("peak"), (-F.col("m.col2")).alias("best")
    )
    last = len(settings) - 1
    grid = scores.select(*by, "setting", "score").join(peak, by, "left")
    off = F.col("score").isNull() | F.isnan("score") | (F.col("score") < F.col("peak") - 0.02)
    out = grid.groupBy(*by).agg(
        F.first("best").alias("best"),
        F.max(F.when(off & (F.col("setting") < F.col("best")), F.col("setting"))).alias("under"),
        F.min(F.when(off & (F.col("setting") > F.col("best")), F.col("setting"))).alias("over"),
    )
    values = F.array(*[F.lit(float(v)) for v in settings])
    lo = F.when(F.col("best").isNull(), 0).otherwise(F.coalesce(F.col("under") + 1, F.lit(0)))
    hi = F.when(F.col("best").isNull(), last).otherwise(F.coalesce(F.col("over") - 1, F.lit(last)))
    return out.select(
        *by,
        F.get(values, lo.cast("int")).alias("supported_lo"),
        F.get(values, hi.cast("int")).alias("supported_hi"),
        F.when(F.col("best").isNull(), F.lit(float(chosen))).otherwise(F.get(values, F.col("best").cast("int"))).alias("best"),
        F.get(values, lo.cast("int")).alias("corrected"),
    )


def find_track_column(cells: DataFrame, level: str) -> str | None:
    """First column holding the tracked level, from one pass over all columns."""
    names = [f.name for f in cells.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "boolean")]
    flags = cells.agg(*[F.max(column(c).cast("string") == str(level)).alias(c) for c in names]).first()
    return next((c for c in names if flags[c]), None)


def persistence(labels: DataFrame, by: list[str], settings: int, anchor: int) -> DataFrame:
    """Best Jaccard of every anchor cluster in each other setting, averaged; artifact at <= 0.4."""
    others = F.filter(F.sequence(F.lit(0), F.lit(settings - 1)), lambda i: i != anchor)
    grid = (
        labels.select(*by, F.get("labels", F.lit(anchor)).alias("cluster"), "labels", F.explode(others).alias("setting"))
        .select(*by, "cluster", "setting", F.get("labels", F.col("setting")).alias("other"))
        .groupBy(*by, "setting", "cluster", "other")
        .agg(F.count("*").alias("n"))
    )
    a = grid.groupBy(*by, "setting", "cluster").agg(F.sum("n").alias("na"))
    b = grid.groupBy(*by, "setting", "other").agg(F.sum("n").alias("nb"))
    best = (
        grid.join(a, [*by, "setting", "cluster"])
        .join(b, [*by, "setting", "other"])
        .groupBy(*by, "cluster", "setting")
        .agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))
    )
    return best.groupBy(*by, "cluster").agg(F.avg("j").alias("persistence")).withColumn(
        "artifact", F.col("persistence") <= 0.4
    )


# --- signatures --------------------------------------------------------------------
def signature_scores(counts: DataFrame, cells: DataFrame, signatures: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Mean over `keys` of (signature mean - mean of the other features), zeros included.

    `signatures` has (state, gene); features missing from the data do not count.
    """
    genes = counts.select("gene").distinct()
    found = hold(signatures.join(genes, "gene"))
    sizes = found.groupBy("state").agg(F.count("*").alias("k"))
    width = genes.count()
    rows = measured(counts, cells, keys).withColumn("__x", value)
    totals = rows.groupBy(*keys).agg(F.sum("__x").alias("total"))
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    hits = rows.join(found, "gene").groupBy(*keys, "state").agg(F.sum("__x").alias("hit"))
    grid = n.withColumn("state", F.explode(F.array(*[F.lit(r[0]) for r in sizes.select("state").orderBy("state").collect()])))
    return (
        grid.join(hits, [*keys, "state"], "left")
        .join(totals, keys, "left")
        .join(sizes, "state")
        .withColumn("hit", F.coalesce("hit", F.lit(0.0)))
        .withColumn("total", F.coalesce("total", F.lit(0.0)))
        .select(
            *keys,
            "state",
            ((F.col("hit") / F.col("k") - F.coalesce(F.try_divide(F.col("total") - F.col("hit"), width - F.col("k")), F.lit(0.0))) / F.col("n")).alias("score"),
        )
    )


def annotate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Each cluster takes the state with the highest mean score, ties to the first name."""
    return ordered.top_k(scores, keys, [F.desc(F.round("score", 10)), F.asc("state")], 1)


def cell_cycle(scores: DataFrame, keys: list[str], s: str = "S", g2m: str = "G2M") -> DataFrame:
    """Phase per key from the S and G2M scores: G1 when neither is positive, else the higher."""
    wide = scores.groupBy(*keys).agg(
        F.max(F.when(F.col("state") == s, F.col("score"))).alias("s_score"),
        F.max(F.when(F.col("state") == g2m, F.col("score"))).alias("g2m_score"),
    )
    absent = F.col("s_score").isNull() | F.col("g2m_score").isNull()
    phase = (
        F.when(absent | ((F.col("s_score") <= 0) & (F.col("g2m_score") <= 0)), F.lit("G1"))
        .when(F.col("s_score") > F.col("g2m_score"), F.lit("S"))
        .otherwise(F.lit("G2M"))
    )
    return wide.withColumn("phase", phase)
