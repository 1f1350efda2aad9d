"""SimHash near-dedup by covering locality-sensitive hashing.

A table is a bit mask; fingerprints that agree on the masked bits share a bucket. Bit i gets a non-zero vector
phi(i) of RADIUS + 1 bits, and table v masks the bits whose phi has an odd product with v. Two fingerprints that differ in
RADIUS bits or fewer span a space that some v is orthogonal to: that table masks none of the differing bits,
so the pair collides there, always. Masks hold half of the bits.

A bucket with many fingerprints is covered again over the bits that its mask leaves free, with the same
guarantee. Each step halves the free bits, and ten free bits admit only 1,024 fingerprints: no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, keep, lookup, slices, small
from plumbline.llm.jaccard import components

BITS, RADIUS, SIZE = 64, 4, 4
#: Seed of XXH64, part of the definition.
SEED = 42
#: Fingerprints compared within one bucket at most; larger buckets are covered again.
BUCKET = 1024
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SIZE, chunk: int = CHUNK) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    counts, total = np.zeros(BITS, np.int64), len(starts)
    of = xxhash.xxh64_intdigest
    for lo in range(0, total, chunk):
        some = zip(starts[lo : lo + chunk], stops[lo : lo + chunk], strict=True)
        h = np.fromiter((of(line[a:b], SEED) for a, b in some), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            marks = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(marks)], names=["id", "f"])

    return run


def masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the `free` bits: any `radius` bits of them are left out by at least one mask whole.

    phi runs over all non-zero vectors in turn, those with one bit first, so that masks are even and none is empty.
    """
    space = range(1, 2 ** (radius + 1))
    order = sorted(space, key=lambda v: (v.bit_count(), v))
    places = [i for i in range(BITS) if free >> i & 1]
    phi = {i: order[k % len(order)] for k, i in enumerate(places)}
    return sorted({sum(1 << i for i in places if (phi[i] & v).bit_count() % 2) for v in space})


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _within(radius: int):
    """Rows (mask, value, f) sorted, buckets of bounded size: links that keep each bucket's components together."""

    def bucket(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        todo, v, w = np.arange(len(f)), [], []
        while len(todo):  # breadth first from the smallest fingerprint left
            near, todo = todo[:1], todo[1:]
            while len(near) and len(todo):
                apart = np.bitwise_count((f[near][:, None] ^ f[todo][None, :]).view(np.uint64))
                hit = apart <= radius
                found = hit.any(axis=0)
                v.append(f[near[hit[:, found].argmax(axis=0)]])
                w.append(f[todo[found]])
                near, todo = todo[found], todo[~found]
        return np.concatenate(v or [f[:0]]), np.concatenate(w or [f[:0]])

    def run(batches) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            edges = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from spanning(rows[2][:last], np.concatenate([[0], edges]) if last else np.zeros(1, int))
            rest = [r[last:].copy() for r in rows]
        yield from spanning(rest[2], np.array([0, len(rest[2])]))

    def spanning(f: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [bucket(f[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
        v, w = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if len(v):
            yield pa.record_batch([pa.array(v), pa.array(w)], names=["v", "w"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (v, w) among distinct fingerprints f: all pairs within `radius` lie in one component of them.

    Fingerprints alone in their bucket, nearly all, stop at a count that Spark combines before its shuffle.
    Small buckets are compared within a task, which holds one bucket; it emits a spanning forest, not pairs.
    Large buckets go through the masks of their free bits, level by level, until they are small: a bucket with
    log2(bucket) free bits or fewer always is.
    """
    spark = prints.sparkSession
    if bucket < 2 ** (radius + 1):
        raise ValueError(f"a bucket must hold {2 ** (radius + 1)} fingerprints, or masks may be empty")
    entries = prints.select("f")
    found, level, heavy = [], [0], None
    while level:
        below = {_signed(m): [_signed(m | more) for more in masks(~m & (2**BITS - 1), radius)] for m in level}
        if heavy is None:
            at = entries.select("f", F.explode(F.array(*[F.lit(m) for m in below[0]])).alias("mask"))
        else:
            table = F.broadcast(spark.createDataFrame(list(below.items()), "mask long, next array<long>"))
            at = entries.join(table, "mask").select("f", F.explode("next").alias("mask"))
        at = at.select("f", "mask", F.col("f").bitwiseAND(F.col("mask")).alias("value"))
        at = at.distinct() if heavy is not None else at  # below, several paths may lead to one mask
        crowd = keep(at.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "crowd")
        # A bucket may hold a third of all fingerprints: its rows are spread before they meet its count.
        placed = keep(lookup(at, crowd, ["mask", "value"], "n", ["n"]).where("n is not null"), "placed")
        discard(crowd)
        few = placed.where(F.col("n") <= bucket).repartition("mask", "value").sortWithinPartitions("mask", "value", "f")
        found.append(keep(few.select("mask", "value", "f").mapInArrow(_within(radius), "v long, w long"), "links"))
        if heavy is not None:
            discard(heavy)
        heavy = placed.where(F.col("n") > bucket)
        level = sorted(r.mask & (2**BITS - 1) for r in heavy.select("mask").distinct().collect())  # masks, not data
        entries, heavy = heavy.select("f", "mask", "value"), placed
    discard(heavy)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Ids are integers. Equal fingerprints are one vertex, so copies of any number take part once.

    Defined cases: null, empty and white-space texts have fingerprint zero and link like others; fewer words
    than a shingle are one shingle; rows without id have a fingerprint, no component, and link nothing; repeated rows
    get equal rows; an empty table gives no rows; other columns play no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = keep(rows.mapInArrow(_fingerprints(size), "id long, f long"), "fingerprints")
    prints = docs.where("id is not null").groupBy("f").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    prints = keep(prints, "prints")
    joined = components(links(prints, radius, bucket))
    named = prints.join(joined.withColumnRenamed("v", "f"), "f", "left").select("f", "rep", "weight", F.coalesce("comp", "f").alias("comp"))
    tops = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = keep(named.join(small(tops), "comp").select("f", "weight", "component_id"), "named")
    out = lookup(docs, named, ["f"], "weight", ["component_id"])
    alone = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), alone.alias("component_id"))
