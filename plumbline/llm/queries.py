"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import centroids, exact, html, jaccard, langid, mixing, neighbours, packing, simhash, tokens, toxicity, warc, whitening
from plumbline.llm.common import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf):
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact.exact_groups(read(spark, sf, "documents"), carry={"text_sha256": sha})


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@query
def op3_source_mixing(spark, sf):
    return mixing.taken_words(mixing.mix(read(spark, sf, "documents")))


@query
def op4_nn_descent(spark, sf):
    return neighbours.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op4_nn_descent"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.x, q.x) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query
def op5_token_counts(spark, sf):
    import public_tokenizers

    counts = tokens.token_counts(read(spark, sf, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op6_warc(spark, sf):
    return warc.round_trip(read(spark, sf, "pages"))


SQL["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), h AS (SELECT *, sha1(body) AS digits FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(digits, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM h
"""


@query
def op7_ngram_jaccard(spark, sf):
    return jaccard.near_duplicates(read(spark, sf, "documents"))


@query
def op8_best_fit_packing(spark, sf):
    return packing.packed_documents(read(spark, sf, "documents"))


@query
def op9_toxicity(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    return toxicity.predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@query
def op10_html_text(spark, sf):
    return html.main_texts(read(spark, sf, "pages"))


@query
def op11_centroid_clustering(spark, sf):
    return centroids.clustered(read(spark, sf, "embeddings")).drop("scans")


_ROUND = """
d{i} AS (
  SELECT v.row, v.vec_id, v.x, c.n AS cluster, list_sum(list_transform(range(1, 65), lambda k: (v.x[k] - c.x[k]) * (v.x[k] - c.x[k])))::BIGINT AS distance
  FROM v CROSS JOIN c{i} c
), a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
_MOVE = """, e{i} AS (
  SELECT cluster, k, sum(x[k])::BIGINT AS s, count(*)::BIGINT AS m FROM a{i} CROSS JOIN range(1, 65) t(k) GROUP BY cluster, k
), f{i} AS (
  SELECT cluster, list((s - (((s % m) + m) % m)) // m ORDER BY k) AS x FROM e{i} GROUP BY cluster
), c{j} AS (SELECT c.n, coalesce(f.x, c.x) AS x FROM c{i} c LEFT JOIN f{i} f ON f.cluster = c.n),"""
SQL["op11_centroid_clustering"] = (
    """
WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda y: floor(64 * y)::BIGINT) AS x FROM w
  WHERE len(list_filter(e, lambda y: isfinite(y))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS n, x FROM v QUALIFY n < 16),"""
    + "".join(_ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 3 else "") for i in range(4))
    + """
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 c ON c.n = cluster
"""
)


@query
def op12_whitening(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_simhash(spark, sf):
    return simhash.near_duplicates(read(spark, sf, "documents"))
