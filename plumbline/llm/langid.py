"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices

#: Hash buckets, n-gram orders, smoothing, n-grams after which the evidence no longer sharpens the score.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
EVIDENCE = 50.0
#: Characters worked on at once; distinct languages at most (the matrix has BUCKETS x languages cells).
CHUNK = 1 << 18
MAX_LANGUAGES = 1000
UNDETERMINED = "und"


def grams(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashed n-grams of a lower-cased text, padded with a space at both ends."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(text: str, size: int = CHUNK):
    """A long text in stretches, so that memory does not follow its length."""
    for i in range(0, len(text), size):
        yield text[i : i + size]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tally(buckets: int, orders: tuple[int, ...]):
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                mine = counts.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for part in chunks(text):
                    mine += np.bincount(grams(part, buckets, orders), minlength=buckets)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(c[at], docs[lang]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return run


@dataclass
class NaiveBayes:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets
    orders: tuple[int, ...] = ORDERS


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, alpha: float = ALPHA) -> NaiveBayes:
    """Counts over all given rows; rows without text, letters or language teach nothing.

    Each task adds up its own n-grams and sends at most buckets x languages sums, which Spark adds
    by key. What reaches the driver is the model: buckets x languages counts, whatever the input.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(tally(buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    per.sort(key=lambda r: r.lang)
    counts = np.zeros((len(per), buckets))
    docs = np.ones(len(per))
    for i, r in enumerate(per):
        for bucket, n in r.cells:
            if bucket < 0:
                docs[i] = n
            else:
                counts[i, bucket] = n
    prob = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * buckets))
    return NaiveBayes([r.lang for r in per], np.log(docs / max(docs.sum(), 1)), prob.astype(np.float32), orders)


def score(model: NaiveBayes, texts: list[str | None], evidence: float = EVIDENCE) -> tuple[list[str], np.ndarray]:
    """Predicted language and its probability for each text.

    The mean log-likelihood of an n-gram is weighed as `evidence` n-grams at most: n-grams overlap and are
    not independent, and without that bound every long text would score 1.
    """
    total = np.zeros((len(texts), len(model.languages)))
    size = np.zeros(len(texts))
    letters = np.zeros(len(texts), bool)
    buckets = model.log_prob.shape[1]
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush():
        if not held:
            return
        at = np.concatenate(held)
        starts = np.cumsum([0, *map(len, held[:-1])])
        for k in range(len(model.languages)):
            np.add.at(total[:, k], owner, np.add.reduceat(model.log_prob[k][at].astype(np.float64), starts))
        held.clear()
        owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if not text or not has_letter(text):
            continue
        letters[i] = True
        for part in chunks(text):
            g = grams(part, buckets, model.orders)
            held.append(g)
            owner.append(i)
            size[i] += len(g)
            waiting += len(g)
            if waiting >= 3 * CHUNK:
                flush()
                waiting = 0
    flush()
    known = letters & (len(model.languages) > 0)
    names, p = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if known.any():
        z = total[known] * np.minimum(1.0, evidence / size[known])[:, None] + model.log_prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        p[known] = z[np.arange(len(z)), best]
        for i, k in zip(np.flatnonzero(known), best, strict=True):
            names[i] = model.languages[k]
    return names, p


def predict(df: DataFrame, model: NaiveBayes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of every row with lang_pred and score, in one pass without a shuffle.

    The log-probability matrix is broadcast; its size is buckets x languages x 4 bytes.

    Defined cases: a null or empty text, or one without a letter, is `und` with score 0, and so is
    every text if nothing was learned; input columns named lang_pred or score
    are replaced; equal scores go to the first language in alphabetical order;
    repeated rows are scored alike; an empty table gives an empty result.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    # Plain values, so that workers need no copy of this package.
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob, model.orders))

    def run(batches):
        model = NaiveBayes(*shared.value)
        for batch in slices(batches, 256):
            names, p = score(model, batch.column(at).to_pylist())
            yield pa.record_batch(
                [*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(p, pa.float64())], names=[*kept, "lang_pred", "score"]
            )

    rows = df.select(*kept, *([] if text_col in kept else [F.col(text_col).alias("__text")]))
    at = kept.index(text_col) if text_col in kept else len(kept)
    schema = T.StructType(rows.schema.fields[: len(kept)]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
