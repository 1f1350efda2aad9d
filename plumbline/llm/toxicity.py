"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keep as kept_table
from plumbline.llm.common import slices, small

#: Labelled rows that the gradient steps use at most (about; a hash picks them), terms kept, factors.
TRAIN_ROWS = 20_000
TERMS = 1024
FACTORS = 8
#: Labelled rows that must hold a term, whatever their number.
SUPPORT_ROWS = 5
EPOCHS, LINEAR, BATCH, RATE, SEED = 60, 30, 256, 0.2, 7
#: Shrinkage of weights and of factors, divided by the number of training rows.
SHRINK, SHRINK_FACTORS = 3.0, 10.0
THRESHOLD = 0.3

#: Stands in every document's terms, so that one pass counts documents too; hashes of terms are not negative.
EVERY = -1
_TERM = re.compile(r"[^\W\d_]{2,}")


def term_hash(term: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) >> 1


class Terms(dict):
    """Term to its number in the model, -1 for others; remembered while there is room."""

    ROOM = 1 << 16

    def __init__(self, numbers: dict[int, int]):
        self.numbers = numbers

    def __missing__(self, term: str) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        self[term] = n = self.numbers.get(term_hash(term), -1)
        return n

    def of(self, text: str | None) -> np.ndarray:
        """Sorted numbers of the distinct known terms of a whole text."""
        found = set(map(self.__getitem__, set(_TERM.findall((text or "").lower()))))
        found.discard(-1)
        return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise products of factors of the terms present)."""

    hashes: list[int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def terms(self) -> Terms:
        return Terms({h: i for i, h in enumerate(self.hashes)})

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(docs), self.bias)
        some = [i for i, d in enumerate(docs) if len(d)]
        if some:
            at = np.concatenate([docs[i] for i in some])
            starts = np.cumsum([0, *(len(docs[i]) for i in some[:-1])])
            v = self.factor[at]
            both = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
            z[some] += np.add.reduceat(self.weight[at], starts) + 0.5 * both.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def learn(docs: list[np.ndarray], labels: np.ndarray, hashes: list[int], factors: int = FACTORS, epochs: int = EPOCHS, start: np.ndarray | None = None) -> Machine:
    """Logistic loss by mini-batches with per-parameter step sizes; the same input gives the same model.

    Weights begin at `start`, zero if not given, and shrink towards it. The first LINEAR epochs fit the weights alone, so that the factors learn what single terms do not explain.
    """
    rng = np.random.default_rng(SEED)
    n = max(len(hashes), 1)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
    start = np.zeros(n) if start is None or not hashes else start
    m = Machine(hashes, float(np.log(share / (1 - share))), start.copy(), rng.normal(0, 0.01, (n, factors)))
    if not len(labels) or not hashes:
        return m
    sq_b, sq_w, sq_v = 1e-6, np.full(n, 1e-6), np.full((n, factors), 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            part = [docs[i] for i in rows]
            err = m.scores(part) - labels[rows]
            gb = err.mean()
            sizes = np.array([len(d) for d in part])
            if sizes.any():
                at, of = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
                e = err[of] / len(part)
                gw = np.bincount(at, e, n) + SHRINK / len(docs) * (m.weight - start)
                sq_w += gw * gw
                m.weight -= RATE * gw / np.sqrt(sq_w)
                if epoch >= LINEAR:
                    v, sums, gv = m.factor[at], np.zeros((len(part), factors)), SHRINK_FACTORS / len(docs) * m.factor
                    np.add.at(sums, of, v)
                    np.add.at(gv, at, e[:, None] * (sums[of] - v))
                    sq_v += gv * gv
                    m.factor -= RATE * gv / np.sqrt(sq_v)
            sq_b += gb * gb
            m.bias -= RATE * gb / np.sqrt(sq_b)
    return m


def _distinct_terms(batches):
    for batch in slices(batches, 256):
        found = [[EVERY, *(term_hash(t) for t in set(_TERM.findall(x.lower())))] for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "terms"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, terms: int = TERMS) -> Machine:
    """Choose terms by all labelled rows; take gradient steps on about `train_rows` of them, picked by a hash of the id.

    labels: id and a 0/1 label; null labels teach nothing, and an id with both labels counts as 1.
    Spark counts in how many labelled documents with either label each hashed term occurs; the `terms` with
    the largest chi-square among those in SUPPORT_ROWS documents make the features. A term in fewer than
    SUPPORT_ROWS picked rows begins at its log odds over all labelled rows, shrunk. Only the numbers of
    the terms in the picked rows reach the driver. Copies of one text count once.
    """
    spark = df.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = kept_table(known, "known")
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(known), id_col)
    rows = rows.withColumn("h", F.xxhash64("text"))
    first = kept_table(rows.groupBy("h").agg(F.min(id_col).alias(id_col)).select(id_col).distinct(), "first")
    texts = rows.join(small(first), id_col, "left_semi").select(id_col, "toxic", "text").dropDuplicates()
    found = texts.select("toxic", "text").mapInArrow(_distinct_terms, "toxic int, terms array<long>")
    each = kept_table(found.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")), "terms")
    n, pos = (each.where(F.col("term") == EVERY).select("n", "p").first() or (0, 0))
    expected = F.col("n") * F.lit(pos / max(n, 1))
    chi = (F.col("p") - expected) ** 2 / F.greatest(expected * F.lit(1 - pos / max(n, 1)), F.lit(1e-9))
    best = each.where((F.col("term") != EVERY) & (F.col("n") >= SUPPORT_ROWS)).select("term", "n", "p", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(terms).collect()
    hashes = [r.term for r in best]
    share = min(1.0, train_rows / max(n, 1))
    picked = texts.where(F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).select("toxic", "text")
    numbers = spark.sparkContext.broadcast({h: i for i, h in enumerate(hashes)})

    def numbered(batches):
        dictionary = Terms(numbers.value)
        for batch in slices(batches, 256):
            out = [dictionary.of(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "at"])

    data = picked.mapInArrow(numbered, "toxic int, at array<int>").toArrow()
    docs = [np.array(x, np.int32) for x in data.column("at").to_pylist()]
    y = data.column("toxic").to_numpy().astype(np.float64)
    order = sorted(range(len(docs)), key=lambda i: (y[i], docs[i].tolist()))  # the model does not depend on how rows arrive
    base = (pos + 0.5) / (n + 1)
    have, bad = np.array([r.n for r in best], float), np.array([r.p for r in best], float)
    odds = (bad + SHRINK * base) / (have - bad + SHRINK * (1 - base)) * (1 - base) / base
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64), minlength=len(best))
    return learn([docs[i] for i in order], y[order], hashes, start=np.where(seen < SUPPORT_ROWS, np.log(odds), 0.0))


def predict(df: DataFrame, model: Machine, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The `keep` columns of every row with score and predicted, in one pass without a shuffle.

    Defined cases: null and empty texts, and texts without known terms, get the score of the bias
    alone; repeated rows score alike; input columns named score or predicted are replaced; an empty
    table gives an empty result.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    # Plain values, so that workers need no copy of this package.
    shared = df.sparkSession.sparkContext.broadcast((model.hashes, model.bias, model.weight, model.factor))

    def run(batches):
        model = Machine(*shared.value)
        dictionary = model.terms()
        for batch in slices(batches, 256):
            docs = [dictionary.of(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            p = model.scores(docs)
            yield pa.record_batch([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    rows = df.select(*kept, F.col(text_col).alias("__text"))
    schema = T.StructType(rows.schema.fields[:-1]).add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
