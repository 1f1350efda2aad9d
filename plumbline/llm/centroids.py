"""Centroid clustering in whole numbers: Lloyd's rounds with drift bounds tightened by plane geometry.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of the distance
to all others. When centroids move, the usual bound loosens by the whole drift of the farthest mover. Here
a cluster's vectors are known to lie in a sphere; in the plane through a moving centroid's path and that
sphere's centre, a tangent to the sphere shows how much nearer the mover can come at all, which is less than
its drift and often negative. Only vectors whose bounds meet are scanned against all centroids, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, keep, slices

SIZE, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Share of a drift that bounds are loosened by beyond their formula, for rounding of roots and angles.
SLACK = 1e-6
#: Whole components must stay below this, so that a squared distance is a long.
LARGEST = 2**27


def whole(vec: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of every component x; null unless there are `size` components, all finite."""
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    near = F.forall(vec, lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    fail = F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}: squared distances would exceed a long")).cast("array<int>")
    x = F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    return F.when((F.size(vec) == size) & fits, F.when(near, x).otherwise(fail))


def drifts(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For cluster i the most by which a vector in its sphere can come nearer to any other centroid.

    Let centroid j move by d from p to q. A vector seen from p at angle a to the path comes nearer by at
    most d * cos(a), as the angle only widens on the way; if it comes nearer at all, it lies within the
    asymptotes of a hyperbola, and by at most d * cos(b), b its angle seen from the path's middle. A sphere
    seen at angle g and of half-width h holds no smaller angle than g - h.
    """
    out = np.full(len(old), -np.inf)
    path = new - old
    far = np.sqrt((path.astype(float) ** 2).sum(axis=1))
    for i in range(len(old)):
        least = np.zeros((2, len(old)))
        for row, eye in enumerate((old.astype(float), (old + new) / 2)):
            to = old[i] - eye
            reach = np.sqrt((to**2).sum(axis=1))
            outside = (reach > radius[i] * (1 + SLACK)) & (far > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.arccos(np.clip((to * path).sum(axis=1) / (reach * far), -1, 1))
                half = np.arcsin(np.clip(radius[i] / reach, 0, 1))
            least[row] = np.where(outside, np.maximum(seen - half, 0), 0)
        nearer = far * np.minimum(np.cos(least[0]), np.maximum(np.cos(least[1]), 0)) + far * SLACK
        nearer[i] = -np.inf
        out[i] = nearer.max(initial=-np.inf)
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:  # sums that a double holds exactly
        x, c = x.astype(float), c.astype(float)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    return d.astype(np.int64)


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, size)


def _scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number), its distance, and the next one's."""
    d = _squares(x, c)
    best = d.argmin(axis=1)
    own = np.take_along_axis(d, best[:, None], 1)[:, 0]
    np.put_along_axis(d, best[:, None], np.iinfo(np.int64).max, 1)
    other = np.sqrt(d.min(axis=1).astype(float)) if len(c) > 1 else np.full(len(x), np.inf)
    return best, np.sqrt(own.astype(float)), other


def _assign(step: dict, size: int):
    """A pass over (id, x, cluster, upper, lower, scans): the same rows with their state brought up to the moved centroids."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, moved, nearer, half = step["centroids"], step["moved"], step["nearer"], step["half"]
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(1), size)
            if moved is None:
                cluster, upper, lower = _scan(x, c)
                scans = np.ones(len(x), np.int32)
            else:
                cluster, upper, lower, scans = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(2, 6))
                upper += moved[cluster]
                lower -= nearer[cluster]
                safe = np.maximum(lower, half[cluster]) * (1 - SLACK)
                open_ = np.flatnonzero(upper >= safe)
                gap = x[open_] - c[cluster[open_]]
                upper[open_] = np.sqrt((gap * gap).sum(axis=1).astype(float))
                open_ = open_[upper[open_] >= safe[open_]]
                if len(open_):
                    cluster[open_], upper[open_], lower[open_] = _scan(x[open_], c)
                    scans[open_] += 1
            state = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans)]
            yield pa.record_batch([batch.column(0), batch.column(1), *state], names=["id", "x", "cluster", "upper", "lower", "scans"])

    return run


def _sums(size: int):
    """Count, largest upper bound and component sums of each cluster in a task's rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(0), size)
            cluster, upper = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for i in np.unique(cluster):
                at = cluster == i
                n, r, s = held.get(int(i), (0, 0.0, 0))
                held[int(i)] = [n + int(at.sum()), max(r, float(upper[at].max())), s + x[at].sum(axis=0)]
        for i, (n, r, s) in held.items():
            yield pa.record_batch([pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array([n] * size), pa.array([r] * size), pa.array(s)], names=["cluster", "at", "n", "r", "s"])

    return run


def _distances(c: np.ndarray, size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            gap = _matrix(batch.column(1), size) - c[at]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array((gap * gap).sum(axis=1)), batch.column(5)], names=["id", "cluster", "distance", "scans"])

    return run


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): id, cluster, distance long (squared) and scans (passes that compared it with all centroids).

    Kept vectors have exactly `size` components, none null or non-finite, as whole numbers floor(scale * x).
    Centroids start as the k vectors with the smallest SHA-256 of "<seed>:<id>"; each of `rounds` rounds assigns
    every vector to the nearest (ties: smaller number) and moves non-empty centroids to floor(sum / count).
    Distances are exact whole numbers; bounds only choose which vectors need a scan.

    One kept table of vectors and bounds a round, the one before deleted; per task only k sums of `size`
    numbers are shuffled, and the driver holds k centroids.

    Defined cases: null vectors and those of another length or with null or non-finite components take no part;
    repeated rows are vectors of their own; rows of one id start in the order of their components; rows without
    id come last among starts; fewer vectors than k give as many clusters; an empty table gives no rows and no
    centroids; a component whose whole number reaches 2^27 raises, as its squared distance might not be a long;
    other columns play no part.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).alias("id"), whole(F.col(vec_col), size, scale).alias("x")).where("x is not null")
    vectors = keep(vectors, "vectors")
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = vectors.select(sha.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(-1, size)
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, x array<int>, cluster int, upper double, lower double, scans int"
    step = {"centroids": centroids, "moved": None, "nearer": None, "half": None}
    state = vectors if len(centroids) else vectors.limit(0)
    for turn in range(rounds + 1):
        before = state
        state = keep(before.mapInArrow(_assign(step, size), schema), "state")
        discard(before)
        if turn == rounds or not len(centroids):
            break
        parts = state.select("x", "cluster", "upper").mapInArrow(_sums(size), "cluster int, at int, n long, r double, s long")
        sums = parts.groupBy("cluster", "at").agg(F.max("r").alias("r"), F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        new, radius = centroids.copy(), np.zeros(len(centroids))
        for row in sums.collect():
            new[row.cluster, row.at] = int(row.s) // row.n
            radius[row.cluster] = row.r
        moved = np.sqrt(((new - centroids).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)
        apart = np.sqrt(_squares(new, new).astype(float))
        np.fill_diagonal(apart, np.inf)
        step = {"centroids": new, "moved": moved, "nearer": drifts(centroids, new, radius), "half": apart.min(axis=1) / 2}
        centroids = new
    rows = keep(state.mapInArrow(_distances(centroids, size), f"id {kind}, cluster int, distance long, scans int"), "clustered")
    discard(state)
    return rows.withColumnRenamed("id", id_col), centroids


def digest(centroid: np.ndarray) -> str:
    """SHA-256, in lowercase hex, of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """The rows of `cluster` with the inertia of their cluster and of all, and their centroid's digest.

    The k per-cluster rows are joined by broadcast; k is a parameter and does not grow with the input.
    """
    rows, centroids = cluster(df, id_col, vec_col, **options)
    spark = df.sparkSession
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in sums)
    sums = spark.createDataFrame([(r.cluster, r.cluster_inertia, total) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(sums), "cluster").join(F.broadcast(names), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
