"""Nearest neighbours by inner product: NN-descent builds a graph, greedy search walks it.

Equal vectors are one node. Vectors travel as they are, without rounding, and every score is a double: in a
group of near-equal vectors the scores differ by less than any code of a few bits can tell.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, keep, lookup, slices, small

#: Neighbours of a node, reverse neighbours that join in, random partitions to start from, nodes of a block.
DEGREE, REVERSE, TREES, LEAF = 32, 12, 4, 512
#: Rounds of NN-descent at most; it ends when fewer than this share of the edges is new.
ROUNDS, SETTLED = 5, 0.01
#: Best nodes a query keeps and expands, expansions a round, rounds at most, nodes scored again (sums in SQL's order).
POOL, BEAM, STEPS, EXACT = 384, 96, 24, 64
#: Vectors that place the hyperplanes, by hash; a bounded sample.
ANCHORS = 256
PAIRS_PER_MEMBER = 6
SEED = 11


def usable(vec: Column, size: int | None = None) -> Column:
    """Not null, not zero, all components finite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False)) & (F.lit(True) if size is None else F.size(vec) == size)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    """n packed vectors of components of a kind as rows of float64."""
    return np.frombuffer(blob, kind).reshape(n, -1).astype(np.float64)


def _packed(kind: str):
    def run(batches):
        for batch in slices(batches, 2048):
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "q"])

    return run


def _codes(planes: np.ndarray, centre: np.ndarray, kind: str):
    trees = len(planes)

    def run(batches):
        for batch in batches:
            q = batch.column(1).to_pylist()
            if not q:
                continue
            x = _unpack(b"".join(q), len(q), kind) - centre
            for t in range(trees):
                bits = x @ planes[t].T > 0
                code = (bits * (1 << np.arange(bits.shape[1]))).sum(axis=1).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(q), t, np.int32)), pa.array(code), batch.column(0), batch.column(1)], names=["tree", "code", "node", "q"])

    return run


def _block_edges(degree: int, kind: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, n = rows["node"].to_numpy(), len(rows)
        if n < 2:
            return pd.DataFrame({"v": [], "u": [], "s": []})
        x = _unpack(b"".join(rows["q"]), n, kind)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, n - 1)
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"v": np.repeat(nodes, k), "u": nodes[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel()})

    return run


def _local_joins(degree: int, kind: str):
    """Rows (v, members' ids, thresholds, packed vectors): each member's best new partners among the others."""

    def run(batches):
        for batch in slices(batches, 256):
            vs, us, ss = [], [], []
            for ids, least, q in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids = np.array(ids.values)
                if len(ids) < 2:
                    continue
                x = _unpack(b"".join(q.as_py()), len(ids), kind)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(PAIRS_PER_MEMBER, len(ids) - 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(s, at, 1)
                new = best > np.array(least.values)[:, None]
                vs.append(np.repeat(ids, k).reshape(-1, k)[new])
                us.append(ids[at][new])
                ss.append(best[new])
            v, u, s = (np.concatenate(x) if x else np.zeros(0) for x in (vs, us, ss))
            if not len(v):
                continue
            # A hub meets many lists; of what one batch finds for a node, only the best can matter.
            order = np.lexsort((u, -s, v))
            v, u, s = v[order], u[order], s[order]
            twice = np.concatenate([[False], (v[1:] == v[:-1]) & (u[1:] == u[:-1])])
            v, u, s = v[~twice], u[~twice], s[~twice]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            place = np.arange(len(v)) - np.repeat(first, np.diff(first, append=len(v)))
            keep_ = place < degree
            yield pa.record_batch([pa.array(v[keep_].astype(np.int64)), pa.array(u[keep_].astype(np.int64)), pa.array(s[keep_].astype(np.float64))], names=["v", "u", "s"])

    return run


def _best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """(v, ids, scores, least) with the best `degree` distinct partners of each node, best first."""
    one = edges.groupBy("v", "u").agg(F.max("s").alias("s"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "u"))), 1, degree)
    rows = one.groupBy("v").agg(top.alias("t"))
    least = F.when(F.size("t") < degree, F.lit(float("-inf"))).otherwise(-F.element_at("t", -1)["m"]).cast("double")
    return rows.select("v", F.col("t.u").alias("ids"), F.transform("t.m", lambda m: -m).alias("scores"), least.alias("least"))


def graph(nodes: DataFrame, count: int, kind: str, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent over kept nodes (node, q): (v, ids, scores, least).

    It starts from the best partners within blocks of about LEAF nodes, cut by random hyperplanes;
    a block with more nodes is dealt by hash. In a round each node brings its neighbours
    and some reverse neighbours together, each scored against the others, and every node keeps its best.
    Reverse neighbours are picked by hash slots, so a hub gathers no more than others.
    """
    dims = len(nodes.first()["q"]) // np.dtype(kind).itemsize
    picked = nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(ANCHORS).collect()
    anchors = _unpack(b"".join(r.q for r in picked), len(picked), kind)
    rng = np.random.default_rng(SEED)
    depth = max(0, int(np.ceil(np.log2(max(count / LEAF, 1)))))
    planes = rng.normal(size=(TREES, depth, dims)).astype(np.float32)
    dealt = nodes.mapInArrow(_codes(planes, anchors.mean(axis=0), kind), "tree int, code long, node long, q binary") if depth else nodes.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("code"), "node", "q")
    parts = keep(dealt.groupBy("tree", "code").agg(F.ceil(F.count("*") / F.lit(2.0 * LEAF)).alias("parts")), "blocks")
    dealt = dealt.join(small(parts), ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    edges = dealt.groupBy("tree", "code", "part").applyInPandas(_block_edges(degree, kind), "v long, u long, s double")
    lists = keep(_best_edges(edges, degree), "lists")
    if not depth:
        return lists
    for turn in range(rounds):
        forward = lists.select("v", F.explode("ids").alias("u"))
        slot = F.pmod(F.xxhash64("v", "u", F.lit(turn)), F.lit(REVERSE))
        backward = forward.groupBy(F.col("u").alias("v"), slot.alias("slot")).agg(F.min_by("v", F.xxhash64("v", F.lit(turn))).alias("u")).select("v", "u")
        own = lists.select("v", F.col("v").alias("u"))
        about = nodes.join(lists.select(F.col("v").alias("node"), "least"), "node", "left").select(F.col("node").alias("u"), F.coalesce("least", F.lit(float("-inf"))).alias("least"), "q")
        met = forward.union(backward).union(own).distinct().join(about, "u")
        groups = met.groupBy("v").agg(F.collect_list(F.struct("u", "least", "q")).alias("m")).select("m.u", "m.least", "m.q")
        found = keep(groups.mapInArrow(_local_joins(degree, kind), "v long, u long, s double"), "found")
        old = lists.select("v", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("v", F.col("e.ids").alias("u"), F.col("e.scores").alias("s"))
        before = lists
        lists = keep(_best_edges(old.union(found), degree), "lists")
        new = lists.join(before.select("v", F.col("ids").alias("was")), "v", "left").select(F.sum(F.size(F.array_except("ids", F.coalesce("was", F.array().cast("array<long>"))))))
        settled = (new.first()[0] or 0) < SETTLED * degree * count
        discard(found, before)
        if settled:
            break
    return lists


def _expand(kind: str):
    """Frontier rows (query, thr, query vector, neighbour ids, their vectors): neighbours above thr."""

    def run(batches):
        for batch in slices(batches, 1024):
            ids_out, s_out = [], []
            for thr, qv, ids, q in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
                ids = np.array(ids.values)
                s = _unpack(q.as_py(), len(ids), kind) @ _unpack(qv.as_py(), 1, kind)[0]
                ok = s > thr
                ids_out.append(ids[ok])
                s_out.append(s[ok])
            yield pa.record_batch([batch.column(0), pa.array(ids_out, pa.list_(pa.int64())), pa.array(s_out, pa.list_(pa.float64()))], names=["query", "ids", "scores"])

    return run


def _merge(pool: int):
    """Pools with new candidates: the best `pool` distinct nodes, which of them are expanded already."""

    def run(batches):
        for batch in slices(batches, 256):
            rows = []
            for ids, s, done, more, ms in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                ids, s, done = np.array(ids.values), np.array(s.values), np.array(done.values)
                if more.is_valid and len(more):
                    new = np.concatenate([np.zeros(0, np.int64), *[np.array(x.values) for x in more]])
                    ns = np.concatenate([np.zeros(0, np.float64), *[np.array(x.values) for x in ms]])
                    new, at = np.unique(new, return_index=True)
                    fresh = ~np.isin(new, ids)
                    ids, s, done = np.append(ids, new[fresh]), np.append(s, ns[at][fresh]), np.append(done, np.zeros(fresh.sum(), bool))
                order = np.lexsort((ids, -s))[:pool]
                rows.append((ids[order], s[order], done[order]))
            cols = [[r[i] for r in rows] for i in range(3)]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["query", "ids", "scores", "done"])

    return run


def greedy_search(queries: DataFrame, lists: DataFrame, nodes: DataFrame, kind: str, pool: int = POOL, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(query, ids): the best nodes of each query node, best first, itself among them.

    Each step expands the best unexpanded nodes of every pool through the graph; a query is done
    when all of its pool is expanded. Neighbours' vectors stand beside the node, so a step is one join.
    """
    each = lists.select("v", F.posexplode("ids").alias("at", "u")).join(nodes.select(F.col("node").alias("u"), "q"), "u")
    rows = each.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("at", "u", "q"))).alias("m"))
    around = keep(rows.select(F.col("v").alias("node"), F.col("m.u").alias("ids"), F.aggregate("m.q", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("qs")), "around")
    vectors = keep(nodes.join(queries.select(F.col("query").alias("node")), "node").select(F.col("node").alias("query"), "q"), "vectors")
    top = F.array(F.lit(float("inf"))).cast("array<double>")
    state = keep(vectors.select("query", F.array("query").alias("ids"), top.alias("scores"), F.array(F.lit(False)).alias("done")), "state")
    for _ in range(steps):
        open_ = F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"])
        # A full pool admits only what beats its last; an unfilled one admits all.
        thr = F.when(F.size("ids") < pool, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1)).cast("double")
        chosen = state.select("query", thr.alias("thr"), F.slice(F.transform(open_, lambda x: x["ids"]), 1, beam).alias("next"))
        frontier = keep(chosen.select("query", "thr", F.explode("next").alias("node")).join(vectors, "query"), "frontier")
        if not frontier.limit(1).count():
            break
        side = small(frontier, 500_000)
        found = around.join(side, "node").select("query", "thr", "q", "ids", "qs").mapInArrow(_expand(kind), "query long, ids array<long>, scores array<double>")
        found = found.where(F.size("ids") > 0).groupBy("query").agg(F.collect_list("ids").alias("more"), F.collect_list("scores").alias("ms"))
        taken = chosen.select("query", "next")
        seen = state.join(taken, "query").withColumn("done", F.zip_with("ids", "done", lambda i, d: d | F.array_contains(F.col("next"), i)))
        state = keep(seen.drop("next").join(found, "query", "left").mapInArrow(_merge(pool), "query long, ids array<long>, scores array<double>, done array<boolean>"), "state")
    return state.select("query", "ids")


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Rows to Python by so many at a time: a row holds the vectors of a whole neighbourhood."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each row marked `is_query`: query_id, rank, vec_id, score.

    Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
    those of another length than the most common one; null ids take no part; a query never finds its own
    id; equal scores go by smaller id; equal vectors are found by their smallest ids; with fewer
    candidates than k all are returned; rows that repeat id and vector count once; an empty table
    gives an empty result; other columns play no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null")
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.where(usable(F.col("vec"))).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    rows = rows.where(usable(F.col("vec"), sizes.n)).withColumn("key", F.struct(F.xxhash64("vec"), F.hash("vec")))
    classes = keep(rows.groupBy("key").agg(F.min("id").alias("node"), F.min_by("vec", "id").alias("vec"), F.count("*").alias("weight")), "classes")
    single = df.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    nodes = keep(classes.select("node", F.col("vec").cast("array<float>" if single else "array<double>")).mapInArrow(_packed(kind), "node long, q binary"), "nodes")
    named = keep(lookup(rows.select("id", "asks", "key"), classes.select("key", "node", "weight"), ["key"], "weight", ["node"]).select("id", "asks", "node").distinct(), "named")
    # The smallest ids of a class, by shares of it first: a class may hold a third of all rows.
    for share in (64, 1):
        part = F.pmod(F.xxhash64("id"), F.lit(share))
        few = (few if share == 1 else named).groupBy("node", part.alias("part")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("members"))
        few = few.select("node", F.explode("members").alias("id")) if share > 1 else few.select("node", "members")
    members = keep(few, "members")
    with _batches(df.sparkSession, 1024):
        lists = graph(nodes, nodes.count(), kind)
    asked = keep(named.where("asks").groupBy("node").agg(F.count("*").alias("weight")), "asked")
    with _batches(df.sparkSession, 1024):
        found = greedy_search(asked.select(F.col("node").alias("query")), lists, nodes, kind)
    pairs = found.select("query", F.explode(F.slice("ids", 1, EXACT)).alias("node"))
    vectors = classes.select("node", "vec")
    scored = pairs.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "query")
    scored = scored.select("query", "node", dot(F.col("vec"), F.col("qvec")).alias("score")).join(members, "node")
    each = scored.select("query", "score", F.explode("members").alias("vec_id"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))), 1, k + 1)
    results = keep(each.groupBy("query").agg(best.alias("best")).join(asked.withColumnRenamed("node", "query"), "query"), "results")
    asks = named.where("asks").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    out = lookup(asks, results, ["query"], "weight", ["best"])
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
