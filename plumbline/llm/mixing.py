"""Mixing sources to target weights by blocks of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep, words

#: Words in a block, blocks in an output shard, documents in a bucket of a source's word order.
BLOCK = 512
SHARD = 1024
BUCKET = 512
#: Weights of the sources in code-point order, repeating; words of the mix per word of the input;
#: most times a source is read.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
MAX_SOURCES = 100_000
SEED = 20_240


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """Words wanted of each source: by weight, at most `passes` times its size, the excess reshared."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > passes * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to `index`, by a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def f(x: np.ndarray, r: int) -> np.ndarray:
        h = (x + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))) & mask

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for r in range(3, -1, -1) if inverse else range(4):
            a, b = (b ^ f(a, r), a) if inverse else (b, a ^ f(b, r))
        return (a << shift) | b

    out = step(index.astype(np.uint64))
    while (wide := out >= n).any():
        out[wide] = step(out[wide])
    return out.astype(np.int64)


@dataclass
class Source:
    """One source of the plan: its words, blocks, target and the slots that the mix gives it."""

    key: int
    size: int
    target: float
    block: int

    def __post_init__(self):
        self.blocks = -(-self.size // self.block)
        self.wanted = min(round(self.target), PASSES * self.size) if self.size else 0
        self.full, rest = divmod(self.wanted, self.size) if self.size else (0, 0)
        self.slots, self.trim = self.full * self.blocks, 0
        if rest:
            short = self.blocks * self.block - self.size
            at = int(permuted(np.array([self.blocks - 1]), self.blocks, self.seed(self.full), True)[0])
            n = -(-rest // self.block)
            if n > at:
                n = -(-(rest + short) // self.block)
            self.slots += n
            self.trim = rest - ((n - 1) * self.block - (short if n - 1 > at else 0))  # words of the last slot

    def seed(self, turn: int) -> int:
        return SEED + self.key * 101 + turn


def before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Rows (s, order, value) with `before`, the sum of value over smaller orders of s.

    Sums run within chunks of 1024 orders, then over chunk totals, so no task gets all orders of a source.
    """
    far = rows.withColumn("chunk", F.expr(f"{order} div 1024"))
    inside = Window.partitionBy("s", "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = far.groupBy("s", "chunk").agg(F.sum(value).alias("__n"))
    chunks = chunks.select("s", "chunk", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__base"))
    summed = far.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(chunks, ["s", "chunk"])
    return summed.withColumn("before", F.col("__base") + F.col("__in")).drop("chunk", "__base", "__in")


def _draws(shared, shard: int):
    def run(batches):
        sources = [Source(*s) for s in shared.value]
        n = np.array([s.slots for s in sources], np.float64)
        total = int(n.sum())
        for batch in batches:
            at, of, count = [], [], []
            for k in batch.column(0).to_pylist():
                drawn = np.random.default_rng([SEED, k]).multinomial(min(shard, total - k * shard), n / n.sum())
                some = np.flatnonzero(drawn)
                at.append(np.full(len(some), k, np.int64))
                of.append(some.astype(np.int32))
                count.append(drawn[some].astype(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (at, of, count)], names=["shard", "s", "n"])

    return run


def _slots(shared, drawn: list[int]):
    def run(batches):
        sources = [Source(*s) for s in shared.value]
        quota = np.array([s.slots for s in sources], np.int64)
        total = np.array(drawn, np.int64)
        over = np.concatenate([[0], np.cumsum(np.maximum(total - quota, 0))])
        under = np.concatenate([[0], np.cumsum(np.maximum(quota - total, 0))])
        for batch in batches:
            shard, s, n, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            shard, s, first = np.repeat(shard, n), np.repeat(s, n).astype(np.int64), np.repeat(first, n)
            g = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            beyond = g >= quota[s]
            rank = over[s[beyond]] + g[beyond] - quota[s[beyond]]
            to = np.searchsorted(under, rank, side="right") - 1
            s[beyond] = to
            g[beyond] = total[to] + rank - under[to]
            turn, block, use = np.zeros(len(g), np.int32), np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            for k in np.unique(s):
                src, mine = sources[k], s == k
                turn[mine] = g[mine] // src.blocks
                for t in np.unique(turn[mine]):
                    now = mine & (turn == t)
                    block[now] = permuted(g[now] % src.blocks, src.blocks, src.seed(int(t)))
                use[mine] = np.where((g[mine] == src.slots - 1) & (src.trim > 0), src.trim, src.block)
            yield pa.record_batch([pa.array(x) for x in (shard, s.astype(np.int32), g, turn, block, use)], names=["shard", "s", "g", "turn", "block", "use"])

    return run


@dataclass
class Mix:
    """rows: s, id, thash, size, start (the row's first word in its source) for every row with words;
    empty: id for the others; pieces: shard, s, g, turn, start, word (of the row), n: what the mix takes."""

    rows: DataFrame
    empty: DataFrame
    pieces: DataFrame
    sources: list[Source]
    names: list[str | None]


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, shard: int = SHARD, size: Column | None = None) -> Mix:
    """Plan the mix of all rows.

    Each source's words stand in one order (rows by hash buckets of their id) and are cut into blocks of `block`
    words. Output shards of `shard` slots draw their source counts from one multinomial each, seeded
    by shard. A source's slots are numbered over the shards; number g is block perm(g mod blocks) of
    pass g div blocks, perm being a keyed permutation for each source and pass. Slots drawn beyond a
    source's quota go to sources drawn below theirs, so the quotas are met exactly, and no word is
    taken more often than its source is read. Slots meet the blocks' documents by (source, block).

    Running sums go over buckets of bounded size, then over bucket totals; a source that holds most
    rows is spread like the others. Rows equal in id and text are one row with a number of copies, dealt in
    parts of BUCKET copies, until their places are known. Only one row per source reaches the driver (at most MAX_SOURCES).

    Defined cases: null and white-space texts have size 0 and are never taken; a null source is a
    source of its own, the last; rows that repeat are rows of their own; ties in the order fall to the
    text's hash; an empty table gives empty results; other columns play no part.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (words(text) if size is None else size).alias("size"), F.xxhash64(text).alias("thash"))
    rows = keep(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    want = targets([r["size"] for r in per], [weights[i % len(weights)] for i in range(len(per))], share)
    sources = [Source(i, r["size"], t, block) for i, (r, t) in enumerate(zip(per, want, strict=True))]
    names = [r.source for r in per]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)] or [(None, 0)], "name string, s int")
    named = rows.join(F.broadcast(table), rows.source.eqNullSafe(table.name)).drop("name", "source")

    buckets = max(1, rows.count() // BUCKET)
    same = named.where("size > 0").groupBy("s", "id", "size", "thash").agg(F.count("*").alias("copies"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BUCKET}"))))
    parts = parts.withColumn("m", F.least(F.lit(BUCKET).cast("long"), F.col("copies") - F.col("part") * BUCKET)).withColumn("all", F.col("size") * F.col("m"))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "thash", "part", F.lit(SEED)), F.lit(buckets)))
    earlier = Window.partitionBy("s", "bucket").orderBy("id", "size", "thash", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("within", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    totals = parts.groupBy("s", "bucket").agg(F.sum("all").alias("n"))
    base = before(totals, "bucket", "n").select("s", "bucket", F.col("before").alias("base"))
    placed = placed.join(base, ["s", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = placed.select("s", "id", "thash", "size", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))
    placed = keep(placed, "placed")

    shared = spark.sparkContext.broadcast([(s.key, s.size, s.target, s.block) for s in sources])  # plain values: workers need no copy of this package
    slots = sum(s.slots for s in sources)
    shards = spark.range(-(-slots // shard))
    draws = keep(shards.mapInArrow(_draws(shared, shard), "shard long, s int, n long"), "draws")
    drawn = {r.s: r.n for r in draws.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    numbered = before(draws, "shard", "n").select("shard", "s", "n", F.col("before").alias("first"))
    taken = numbered.mapInArrow(_slots(shared, [drawn.get(i, 0) for i in range(len(sources))]), "shard long, s int, g long, turn int, block long, use long")

    last = F.expr(f"(start + size - 1) div {block}")
    spans = placed.select("s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    spans = spans.select("s", "block", "start", (lo - F.col("block") * block).alias("from"), (hi - F.col("block") * block).alias("to"), (lo - F.col("start")).alias("word"))
    pieces = taken.join(spans, ["s", "block"]).withColumn("n", F.least("to", "use") - F.col("from")).where("n > 0")
    pieces = pieces.select("shard", "s", "g", "turn", "start", "word", "n")
    return Mix(placed, named.where("size = 0").select("s", "id", "thash"), pieces, sources, names)


def taken_words(plan: Mix, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    spark = plan.rows.sparkSession
    per = [(s.key, s.size, s.target) for s in plan.sources] or [(0, 0, 0.0)]
    table = F.broadcast(spark.createDataFrame(per, "s int, source_size long, target double"))
    sums = plan.pieces.groupBy("s", "start").agg(F.sum("n").alias("taken"))
    some = plan.rows.join(sums, ["s", "start"], "left").select("s", "id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = plan.empty.select("s", "id", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"))
    out = some.unionByName(none).join(table, "s")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as rows of `df`: one row for each pass over a document, its text the words taken.

    A document taken whole keeps its text as it is; one taken in part keeps its taken words with the
    white space behind them; one not taken is gone. A column n_chars is set to the new length.
    """
    plan = mix(df, id_col, text_col, **options)
    runs = plan.pieces.groupBy("s", "start", "turn").agg(F.sum("n").alias("__n"), F.collect_list(F.struct("word", "n")).alias("__runs"))
    parts = plan.rows.join(runs, ["s", "start"]).select(F.col("id").alias("__id"), F.col("thash").alias("__thash"), F.col("size").alias("__size"), "__n", "__runs")
    texts = df.withColumn("__thash", F.xxhash64(text_col))
    if plan.rows.groupBy("id", "thash").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates([id_col, "__thash"])
    met = texts.join(parts, texts[id_col].eqNullSafe(parts["__id"]) & (texts["__thash"] == parts["__thash"]))
    each = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    chosen = F.filter(each, lambda w, i: F.exists(F.col("__runs"), lambda r: (i >= r["word"]) & (i < r["word"] + r["n"])))
    text = F.when(F.col("__n") == F.col("__size"), F.col(text_col)).otherwise(F.rtrim(F.array_join(chosen, "")))
    out = met.withColumn("__text", text)
    new = {text_col: F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[new.get(c, F.col(c)).alias(c) if c in new else texts[c] for c in df.columns])
