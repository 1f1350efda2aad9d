"""Whitening of embeddings from exact sums: bit-sliced cross-products of whole-number components.

Components become whole numbers; less their dimension's smallest, they are cut into bit planes. A plane's bits of 64 rows
are one word, so that popcount(plane a of i AND plane b of j) * 2^(a+b), summed over planes and words, is the
exact cross-product of dimensions i and j. The covariance is centred in whole numbers, n * sum(xy) - sum(x) * sum(y),
and becomes floating point only for the eigenvectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, keep, lookup, slices, small

SCALE, COMPONENTS = 256, 4
#: Whole components must stay below this.
LARGEST = 2**46
#: Eigenvalues up to this share of the trace count as zero: directions in which the fit list does not vary.
FLAT = 1e-12
#: Rows whose planes are packed at once: a multiple of 64.
BLOCK = 4096


def _whole(scale: int):
    """(id, embedding) to (id, x, key): floor(scale * c), and SHA-256 of x; rows with null or non-finite entries go."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            batch = batch.filter(batch.column(1).is_valid())
            vec = batch.column(1)
            sizes = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vec.flatten()
            c = np.asarray(flat.to_numpy(zero_copy_only=False), float)  # nulls become NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(row, ~np.isfinite(c), minlength=len(sizes)) == 0
            c, sizes = np.floor(c[good[row]] * scale), sizes[good]
            if len(c) and np.abs(c).max() >= LARGEST:
                raise OverflowError(f"a component times {scale} reaches 2^46: exact sums would not fit")
            x = c.astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            keys = [hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), lists, pa.array(keys, pa.binary())], names=["id", "x", "key"])

    return run


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def _ranges(batches) -> Iterator[pa.RecordBatch]:
    """Count, sum, smallest and largest of every dimension of a task's rows."""
    n, s, lo, hi = 0, 0, None, None
    for batch in slices(batches, BLOCK):
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        n, s = n + len(x), s + x.sum(axis=0).astype(object)
        lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
        hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
    if n:
        d = len(lo)
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d), _decimals(s), pa.array(lo), pa.array(hi)], names=["i", "n", "s", "lo", "hi"])


def _decimals(values) -> pa.Array:
    text = pa.array([str(v) for v in values], pa.string())
    return text.cast(pa.decimal128(38, 0))


def planes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of whole non-negative columns, 64 rows a word: bits[0] planes of column 0, then those of column 1, ..."""
    rows = -(-len(x) // 64) * 64
    owner = np.repeat(np.arange(len(bits)), bits)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(bits) - bits, bits)
    out = np.zeros((len(owner), rows // 8), np.uint8)
    for at, (i, a) in enumerate(zip(owner, place, strict=True)):
        out[at, : -(-len(x) // 8)] = np.packbits((x[:, i] >> a) & 1)
    return out.view(np.uint64)


def cross_products(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums over rows of x[:, i] * x[:, j] for i <= j, as Python integers, from popcounts of the planes."""
    words = planes(x, bits)
    start = np.concatenate([[0], np.cumsum(bits)])
    weight = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if len(bits) else np.zeros(0, np.int64)
    out = np.zeros((len(bits), len(bits)), object)
    for i in range(len(bits)):
        later = words[start[i] :]
        sums = np.zeros(len(later), np.int64)
        for a in range(bits[i]):  # rows < 2^13 and bits < 2^48: below 2^61
            met = np.bitwise_count(words[start[i] + a] & later).sum(axis=1, dtype=np.int64)
            sums += met << a
        at = np.flatnonzero(sums)
        owner = np.repeat(np.arange(i, len(bits)), bits[i:])
        np.add.at(out[i], owner[at], sums[at].astype(object) << weight[start[i] :][at].astype(object))
    return out


def _scatter(low: np.ndarray, bits: np.ndarray):
    upper = np.triu_indices(len(bits))

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in slices(batches, BLOCK):
            if batch.num_rows:
                total = total + cross_products(_matrix(batch.column(0)) - low, bits)
        if isinstance(total, np.ndarray):
            i, j = (u.astype(np.int32) for u in upper)
            yield pa.record_batch([pa.array(i), pa.array(j), _decimals(total[upper])], names=["i", "j", "v"])

    return run


def _project(mean: np.ndarray, axes: np.ndarray):
    """(id, x) or (x): coordinates on the axes, each axis divided by its deviation already."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            w = (_matrix(batch.column(1)) - mean) @ axes.T if batch.num_rows else np.zeros((0, len(axes)))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(axes))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(w.ravel())), batch.column(2)], names=["id", "w", "deviation"])

    return run


def _deviation(n: int, s: list[int]):
    """(id, x): x beside the sum over dimensions of (n * x - s)^2, exact."""
    total = np.array(s, object)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(s)), np.int64)
            reach = max((abs(n * int(m) - t) for side in (x.min(axis=0), x.max(axis=0)) for m, t in zip(side, s, strict=True)), default=0) if len(x) else 0
            if len(s) * reach * reach < 2**63 and n < 2**62:
                gap = x * np.int64(n) - total.astype(np.int64)
                squares = pa.array((gap * gap).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                gap = x.astype(object) * n - total
                squares = _decimals((gap * gap).sum(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), squares], names=["id", "x", "deviation"])

    return run


def _moments(batches) -> Iterator[pa.RecordBatch]:
    """Sums of whitened coordinates and of their products."""
    s = p = None
    for batch in slices(batches, BLOCK):
        if batch.num_rows:
            w = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            s = w.sum(axis=0) + (0 if s is None else s)
            p = w.T @ w + (0 if p is None else p)
    if s is not None:
        i, j = np.indices(p.shape)
        i, j = np.append(i.ravel(), np.full(len(s), -1)), np.append(j.ravel(), np.arange(len(s)))
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.append(p.ravel(), s))], names=["i", "j", "v"])


def fit(rows: DataFrame) -> dict:
    """Exact n, sums and centred scatter of the fit list (x array<long>, one length), with axes and shares.

    Only sums leave the tasks: width^2 / 2 numbers each, added up by Spark before the driver takes them.
    """
    ranges = rows.select("x").mapInArrow(_ranges, "i int, n long, s decimal(38,0), lo long, hi long")
    found = ranges.groupBy("i").agg(F.sum("n"), F.sum("s"), F.min("lo"), F.max("hi")).orderBy("i").collect()
    if not found:
        return {"n": 0, "sums": [], "values": np.zeros(0), "axes": np.zeros((0, 0)), "trace": 0.0, "mean": np.zeros(0)}
    n, sums = int(found[0][1]), [int(r[2]) for r in found]
    low, high = (np.array([r[k] for r in found], np.int64) for k in (3, 4))
    bits = np.array([int(h - lo_).bit_length() for lo_, h in zip(low, high, strict=True)], np.int64)
    parts = rows.select("x").mapInArrow(_scatter(low, bits), "i int, j int, v decimal(38,0)")
    centred = np.zeros((len(low), len(low)), object)
    shifted = [s - n * int(m) for s, m in zip(sums, low, strict=True)]
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        centred[i, j] = centred[j, i] = n * int(v) - shifted[i] * shifted[j]
    # n^2 times the covariance, in whole numbers until here
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred], float).reshape(centred.shape))
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    trace = sum(int(centred[i, i]) for i in range(len(low))) / (n * n)
    return {"n": n, "sums": sums, "mean": np.array([s / n for s in sums]), "values": values, "axes": vectors, "trace": trace}


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: id, component int, n long, deviation decimal, whitened, explained and identity_error double.

    x = floor(scale * c) of every finite vector; each distinct x counts once in the fit. Copies are found by the
    SHA-256 of x: only keys that have company are looked up again, so that vectors are not shuffled to find them.

    Defined cases: null vectors and those with null or non-finite entries are dropped; of several lengths the
    commonest (ties: the longer) takes part and others are dropped; repeated rows come back each; directions
    without variance (one distinct vector, constant or dependent dimensions) give no component, so fewer than
    `components` or none; an empty table gives no rows; a whole component of 2^46 or more raises; other columns
    play no part.
    """
    kind = dict(df.dtypes)[id_col]
    chosen = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("c"))
    rows = chosen.mapInArrow(_whole(scale), f"id {kind}, x array<long>, key binary")
    rows = keep(rows.select("id", "x", "key", F.monotonically_increasing_id().alias("at")), "whole")
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = size["size"] if size else 0
    rows = rows.where(F.size("x") == width)
    company = keep(rows.groupBy("key").agg(F.count("*").alias("times"), F.min("at").alias("first")).where("times > 1"), "company")
    if small(company) is company:
        marked = lookup(rows, company, ["key"], "times", ["first"])
    else:
        marked = rows.join(F.broadcast(company), "key", "left")
    first = marked.where("first is null or first = at").select("id", "x")
    model = fit(first)
    top = min(components, int((model["values"] > FLAT * model["trace"]).sum())) if model["n"] > 1 else 0
    values = model["values"][:top]
    axes = model["axes"][:top] / np.sqrt(values)[:, None] if top else np.zeros((0, width))
    project = _project(model["mean"], axes)
    exact = f"id {kind}, x array<long>, deviation decimal(38,0)"
    schema = f"id {kind}, w array<double>, deviation decimal(38,0)"
    error = 0.0
    if top:
        seen = first.select("id", "x", F.lit(None).cast("decimal(38,0)").alias("deviation")).mapInArrow(project, schema)
        sums = seen.select("w").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()
        met = {(i, j): v / model["n"] for i, j, v in sums}
        error = max(abs(met[i, j] - met[-1, i] * met[-1, j] - (i == j)) for i in range(top) for j in range(top))
    done = rows.select("id", "x").mapInArrow(_deviation(model["n"], model["sums"]), exact).mapInArrow(project, schema)
    share = F.array(*[F.lit(float(v / model["trace"])) for v in values]) if top else F.array().cast("array<double>")
    out = done.select("id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).alias("component"),
        F.lit(model["n"]).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, "k").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
    discard(company)
    return out
