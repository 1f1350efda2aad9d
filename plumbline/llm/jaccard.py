"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

Every text is a set of hashed word shingles; equal sets are one class. All shingles stand in one
global order, frequent ones last, which is cut into fragments.

1. `profile`: class key and size of every row, and a count sketch of all shingles: the order.
2. `entries`: by the prefix filter, two sets at or above the threshold share a shingle within the
   first quarter of both. Each class sends those shingles; classes that meet in one are candidates.
   A bucket of m classes sends m - 1 pairs, each with the bucket's best-placed class, not all m * m.
3. `overlaps`: the sets of candidate classes are cut into the fragments; per pair and fragment the
   partial overlap is counted, and summed per pair. The first fragments show what a pair has lost
   already; only pairs that can still reach the threshold go through the others.
4. Components of the links found. Buckets that now lie in one component need nothing more. For the
   others the missing pairs between components follow, so no link between components is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, keep, lookup, slices, small
from plumbline.llm.shingles import SIZE, set_key, shingles

#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Fragments of the order, and how many of them are counted before pairs that cannot reach the threshold go.
FRAGMENTS, FIRST = 16, 3
#: Cells of the count sketch, a fixed size, sent in slices.
CELLS, SLICE = 1 << 23, 1 << 18
#: All missing pairs are listed when that takes at most this many comparisons an entry; before that come rounds
#: of one pair per bucket member, so many at most.
WORK, STAR_ROUNDS = 512, 6


def _profile(size: int):
    def run(batches):
        sketch, seen = np.zeros(CELLS, np.int32), set()
        for batch in slices(batches, 512):
            n, key = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), size)
                n.append(len(grams))
                key.append(set_key(grams) if len(grams) else None)
                if key[-1] not in seen:
                    seen.add(key[-1])
                    np.add.at(sketch, (grams % np.uint64(CELLS)).astype(np.int64), 1)
            none = [None] * len(n)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=NAMES)
        if not seen:
            return
        for i in range(CELLS // SLICE):
            part = zlib.compress(sketch[i * SLICE : (i + 1) * SLICE].tobytes(), 1)
            yield pa.record_batch([pa.array([None], id_type), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([i], pa.int32()), pa.array([part], pa.binary())], names=NAMES)

    NAMES, id_type = ["id", "n", "cls", "slice", "cells"], pa.int64()
    return run


def _add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(part.as_py()), np.int32).astype(np.int64)
    for i, cells in sums.items():
        yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], names=["slice", "cells"])


def global_ranks(profiles: DataFrame) -> np.ndarray:
    """Rank of every sketch cell: 0 for the common run, then by powers of two above it.

    The sketch has CELLS cells whatever the input; each task adds up slices as they stream past.
    """
    parts = profiles.where("slice is not null").select("slice", "cells").repartition("slice").mapInArrow(_add_slices, "slice int, cells binary")
    sketch = np.zeros(CELLS, np.int64)
    for i, cells in parts.collect():
        sketch[i * SLICE : (i + 1) * SLICE] = np.frombuffer(zlib.decompress(cells), np.int64)
    mean = sketch.mean()
    usual = mean + 4 * mean**0.5 + 4  # what rare shingles that share a cell add up to, with room for chance
    return np.ceil(np.log2(np.maximum(sketch / usual, 1))).astype(np.uint8)


def _ordered(grams: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = ranks[(grams % np.uint64(CELLS)).astype(np.int64)]
    at = np.argsort(rank, kind="stable")  # the shingles come sorted by hash
    return grams[at], rank[at]


def _entries(shared, size: int, threshold: int):
    def run(batches):
        ranks, seen = shared.value, set()
        for batch in slices(batches, 512):
            gs, cs, ns, ps, hs = [], [], [], [], []
            for text in batch.column(0):
                grams = shingles(text.as_py(), size)
                if not len(grams) or (key := set_key(grams)) in seen:
                    continue
                seen.add(key)
                grams, rank = _ordered(grams, ranks)
                m = len(grams) - (threshold * len(grams) + 99) // 100 + 1
                gs.append(grams[:m].view(np.int64))
                hs.append(rank[:m] > 0)
                cs.append(np.full(m, key, np.int64))
                ns.append(np.full(m, len(grams), np.int32))
                ps.append(np.arange(m, dtype=np.int32))
            if gs:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (gs, cs, ns, ps, hs)], names=["g", "cls", "n", "pos", "hot"])

    return run


def _buckets(batches):
    """Entries sorted by hot, g, pos, cls: pairs of each bucket's first class, and entries that later steps need.

    Rows of hot shingles pass as they are; their buckets may be of any size and are joined by Spark.
    A cold bucket is bounded by its sketch count; only its first class is held while it streams past.
    """
    last = None  # (g, cls, n, pos) of the bucket's first class
    second = None  # its second class, held back until a third shows that the bucket needs more
    more = False
    for batch in batches:
        g, cls, n, pos, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        out: list[tuple] = []
        cold = ~hot
        if len(g):
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[0] = last is not None and last[0] == g[0]
            run_on = same.copy()
            run_on[:-1] |= same[1:]
            run_on[-1] = True  # it may go on in the next batch
            for i in np.flatnonzero(run_on & cold):
                row = (int(g[i]), int(cls[i]), int(n[i]), int(pos[i]))
                if not same[i]:
                    last, second, more = row, None, False
                elif row[1] != last[1] and (second is None or row[1] != second[1]):
                    out.append((*last, *row[1:], True))
                    if second is None:
                        second = row
                    else:
                        if not more:
                            out += [(*last, None, None, None, False), (*second, None, None, None, False)]
                            more = True
                        out.append((*row, None, None, None, False))
            for i in np.flatnonzero(hot):
                out.append((int(g[i]), int(cls[i]), int(n[i]), int(pos[i]), None, None, None, False))
        if out:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "cls", "n", "pos", "cls2", "n2", "pos2", "pair"])


def _segments(shared, size: int, fragments: int, lo: int, hi: int):
    """Sets cut into fragments lo..hi-1: ranges of the hash for the common run, the last for frequent shingles."""

    def run(batches):
        ranks = shared.value
        for batch in slices(batches, 256):
            keys, frags, parts = [], [], []
            for text in batch.column(0):
                grams = shingles(text.as_py(), size)
                key = set_key(grams)
                grams, rank = _ordered(grams, ranks)
                cold = (grams // np.uint64(2**64 // (fragments - 1) + 1)).astype(np.int64)
                frag = np.where(rank > 0, fragments - 1, cold)
                for f in np.unique(frag[(frag >= lo) & (frag < hi)]):
                    keys.append(key)
                    frags.append(int(f))
                    parts.append(grams[frag == f].view(np.int64))
            if keys:
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["cls", "frag", "seg"])

    return run


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """For each pair (a, na, b, nb, common): common shingles so far, and those of either side that the other lacks.

    Partial counts by fragment, summed per pair; a pair that shares no fragment keeps its count.
    """
    left = segments.select(F.col("cls").alias("a"), "frag", F.col("seg").alias("sa"))
    right = segments.select(F.col("cls").alias("b"), "frag", F.col("seg").alias("sb"))
    met = left.join(small(pairs.drop("common")), "a").join(right, ["b", "frag"])
    pair, part = ["a", "na", "b", "nb"], F.size(F.array_intersect("sa", "sb"))
    partial = met.select(*pair, part.alias("common"), F.size("sa").alias("la"), F.size("sb").alias("lb"))
    partial = partial.select(*pair, "common", (F.col("la") - F.col("common")).alias("lost_a"), (F.col("lb") - F.col("common")).alias("lost_b"))
    begun = pairs.select(*pair, F.col("common"), F.lit(0).alias("lost_a"), F.lit(0).alias("lost_b"))
    return begun.union(partial).groupBy(*pair).agg(*[F.sum(c).cast("int").alias(c) for c in ("common", "lost_a", "lost_b")])


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, comp): the smallest vertex reachable from each vertex of links (v, w), in at most `rounds` rounds if given.

    Each round takes the smallest label among neighbours; every third also takes the label's own
    label, so rounds grow with the logarithm of the longest path. Sums are by key with map-side
    combine; nothing is gathered.
    """
    edges = keep(links.select("v", "w").union(links.select("w", "v")), "edges")
    labels = keep(edges.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("comp"), F.lit(True).alias("changed")), "labels")
    turn = 0
    while turn != rounds and labels.where("changed").limit(1).count():
        turn += 1
        own = labels.select("v", "comp", F.col("comp").alias("was"))
        near = edges.join(labels.select(F.col("v").alias("w"), "comp"), "w").select("v", "comp", F.lit(None).cast("long").alias("was"))
        best = own.union(near).groupBy("v").agg(F.min("comp").alias("comp"), F.max("was").alias("was"))
        if turn % 3 == 0:
            up = labels.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
            best = best.join(up, "comp", "left").select("v", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "was")
        labels = keep(best.select("v", "comp", (F.col("comp") != F.col("was")).alias("changed")), "labels")
    return labels.select("v", "comp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: int = THRESHOLD, fragments: int = FRAGMENTS, with_key: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links), and the set's key if asked.

    Ids are integers. Shingles are compared by 64-bit hashes.

    Defined cases: null and empty texts, and texts of white space, have no shingles and are alone; a
    text with fewer words than a shingle is one shingle; equal sets of any number are one class and
    take part once; rows without id have no component; repeated rows get equal rows; an empty table
    gives an empty result; other columns play no part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = keep(rows.mapInArrow(_profile(size), "id long, n long, cls long, slice int, cells binary"), "profiles")
    docs = profiles.where("slice is null").select("id", "n", "cls")
    ranks = spark.sparkContext.broadcast(global_ranks(profiles))
    classes = docs.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = keep(classes, "classes")
    repeated = docs.groupBy("id").count().where("count > 1").limit(1).count() > 0

    sent = rows.where("id is not null").select("text").mapInArrow(_entries(ranks, size, threshold), "g long, cls long, n int, pos int, hot boolean")
    place = F.when(F.col("hot"), F.xxhash64("g", "cls")).otherwise(F.col("g"))
    sorted_ = sent.repartition(place).sortWithinPartitions("hot", "g", "pos", "cls")
    met = keep(sorted_.mapInArrow(_buckets, "g long, cls long, n int, pos int, cls2 long, n2 int, pos2 int, pair boolean"), "met")
    bucketed = met.where("not pair").select("g", "cls", "n", "pos")
    cold = met.where("pair").select("cls", "n", "pos", "cls2", "n2", "pos2")
    pair = ["a", "na", "b", "nb"]
    least = lambda n, n2: F.ceil(F.lit(threshold) * (F.col(n) + F.col(n2)) / F.lit(100 + threshold))

    def ordered(pairs: DataFrame) -> DataFrame:
        first = F.col("cls") < F.col("cls2")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        # Sets that first share a shingle at these places hold at most what follows in common.
        fit = pairs.where((F.col("cls") != F.col("cls2")) & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= least("n", "n2")))
        return fit.select(pick("cls", "cls2").alias("a"), pick("n", "n2").alias("na"), pick("cls2", "cls").alias("b"), pick("n2", "n").alias("nb")).distinct()

    def star(open_: DataFrame, turn: int) -> DataFrame:
        """Each bucket's classes beside its chosen class: the best placed at first, then any."""
        lead = F.struct("pos", "cls", "n") if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "pos")
        lead = open_.groupBy("g").agg(F.min(lead).alias("p")).select("g", F.col("p.cls").alias("cls2"), F.col("p.n").alias("n2"), F.col("p.pos").alias("pos2"))
        return open_.join(keep(lead, "lead"), "g")  # kept, so that a bucket's rows may be split over tasks

    def cut(pairs: DataFrame, lo: int, hi: int) -> DataFrame:
        """Some fragments of the sets of the paired classes."""
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        wanted = keep(ends.join(classes, "cls").select(F.col("rep").alias("id")), "wanted")
        texts = rows.join(small(wanted), "id", "left_semi").select("text")
        segments = texts.mapInArrow(_segments(ranks, size, fragments, lo, hi), "cls long, frag int, seg array<long>")
        segments = keep(segments.dropDuplicates(["cls", "frag"]) if repeated else segments, "segments")
        discard(wanted)
        return segments

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, na, b, nb, common) of the pairs that the first fragments leave."""
        pairs = pairs.withColumn("common", F.lit(0))
        at_most = F.least(F.col("na") - F.col("lost_a"), F.col("nb") - F.col("lost_b"))
        begun = cut(pairs, 0, FIRST)
        alive = keep(overlaps(pairs, begun).where(at_most >= least("na", "nb")).select(*pair, "common"), "alive")
        discard(begun)
        rest = cut(alive, FIRST, fragments)
        done = keep(overlaps(alive, rest).select(*pair, "common"), "verified")
        discard(rest, alive)
        return done

    enough = F.col("common") * (100 + threshold) >= F.lit(threshold) * (F.col("na") + F.col("nb"))
    pairs = keep(ordered(cold.unionByName(star(bucketed, 0).select(*cold.columns))), "pairs")
    checked, counted = pairs.select("a", "b"), verified(pairs)
    turn = 0
    while turn <= STAR_ROUNDS:
        # A few rounds of labels do here: classes not yet merged are only compared once more.
        labels = components(counted.where(enough).select(F.col("a").alias("v"), F.col("b").alias("w")), 2)
        named = bucketed.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        per = named.groupBy("g", "comp").agg(F.count("*").alias("c"))
        mixed = per.groupBy("g").agg(F.max_by("comp", "c").alias("top"), F.sum("c").alias("m"), F.max("c").alias("most")).where("most < m")
        mixed = keep(mixed, "mixed")
        work, entries = mixed.agg(F.sum(F.col("m").cast("double") * (F.col("m") - F.col("most"))), F.sum("m")).first()
        if not entries:
            break
        open_ = keep(named.join(mixed.select("g", "top"), "g"), "open")
        turn += 1
        if turn > STAR_ROUNDS or work <= WORK * entries:
            # All missing pairs: classes outside their bucket's largest component, with all others.
            turn = STAR_ROUNDS + 1
            other = open_.select("g", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "pos", "comp")])
            more = open_.where("comp <> top").join(other, "g").where("comp <> comp2 and (comp2 = top or cls < cls2)")
        else:
            more = star(open_, turn)
        more = keep(ordered(more).join(checked, ["a", "b"], "left_anti"), "pairs")
        checked, counted = checked.union(more.select("a", "b")), counted.union(verified(more))
    labels = components(counted.where(enough).select(F.col("a").alias("v"), F.col("b").alias("w")))
    named = classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "rep", "weight", F.coalesce("comp", "cls").alias("comp"))
    tops = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = keep(named.join(tops, "comp").select("cls", "weight", "component_id"), "named")
    # A class may hold a third of all rows; those of large classes meet a broadcast row.
    out = lookup(docs, named, ["cls"], "weight", ["component_id"])
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    key = [F.col("cls").alias("set_key")] if with_key else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"), *key)


def _keyed(at: int, names: list[str], size: int):
    """The rows with the key of their text, column `at`, behind their other columns."""

    def run(batches):
        for batch in slices(batches, 512):
            grams = [shingles(text.as_py(), size) for text in batch.column(at)]
            keys = pa.array([set_key(g) if len(g) else None for g in grams], pa.int64())
            yield pa.record_batch([*batch.columns, keys], names=[*names, "__set"])

    return run


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, **options) -> DataFrame:
    """The row with the smallest id of every component; rows without text or id all stay.

    If the smallest id of a component occurs in several rows, all of them stay: an id is one document. An id
    that comes with several texts loses only those that are near copies: its rows are matched by the set of
    their text too.
    """
    found = keep(near_duplicates(df, id_col, text_col, size=size, with_key=True, **options), "found")
    dropped = keep(found.where(F.col(id_col) != F.col("component_id")).select(id_col, F.col("set_key").alias("__set")).distinct(), "dropped")
    several = found.groupBy(id_col).agg((F.count_distinct("set_key") + F.max(F.col("set_key").isNull().cast("int"))).alias("n")).where("n > 1").select(id_col)
    several = keep(several.join(dropped, id_col, "left_semi"), "several")
    if not several.limit(1).count():
        return df.join(small(dropped.select(id_col)), id_col, "left_anti").select(*df.columns)
    plain = df.join(small(dropped.select(id_col)), id_col, "left_anti").select(*df.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    mixed = df.join(small(several), id_col, "left_semi").select(*df.columns)
    mixed = mixed.mapInArrow(_keyed(df.columns.index(text_col), df.columns, size), f"{fields}, __set long")
    return plain.unionByName(mixed.join(small(dropped), [id_col, "__set"], "left_anti").select(*df.columns))
