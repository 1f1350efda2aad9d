"""Queries over embeddings, clusterings and their stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.dataset import case_key
from plumbline.operators import clustering as clu
from plumbline.operators import graph, ordered
from plumbline.operators import reduce as red
from plumbline.operators import separation as sep
from plumbline.plans import views
from plumbline.plans.registry import query
from plumbline.plans.sqltext import base
from plumbline.session import hold, keep

BY = ["case_id"]
K = len(views.SETTINGS)
LABELS = "lab AS (" + " UNION ALL ".join(
    f"SELECT CAST(vec_id AS VARCHAR) AS cell_id, {i} AS setting, CAST({'label' if k % 2 else 'CASE WHEN vec_id % 10 < 6 THEN label ELSE vec_id END'} % {k} AS VARCHAR) AS cluster, label, embedding FROM embeddings"
    for i, k in enumerate(views.SETTINGS)
) + ")"
ARI = """g AS (SELECT x.setting AS pair, x.cluster AS a, y.cluster AS b, COUNT(*) AS n FROM lab x JOIN lab y ON x.cell_id=y.cell_id AND y.setting=x.setting+1 GROUP BY ALL),
 sa AS (SELECT pair, SUM(n*(n-1)/2.0) AS sa FROM (SELECT pair, a, SUM(n) AS n FROM g GROUP BY ALL) GROUP BY 1),
 sb AS (SELECT pair, SUM(n*(n-1)/2.0) AS sb FROM (SELECT pair, b, SUM(n) AS n FROM g GROUP BY ALL) GROUP BY 1),
 sij AS (SELECT pair, SUM(n*(n-1)/2.0) AS sij, SUM(n) AS n FROM g GROUP BY 1),
 ari AS (SELECT pair, CASE WHEN (sa+sb)/2 = sa*sb/(n*(n-1)/2.0) THEN 1.0 ELSE (sij - sa*sb/(n*(n-1)/2.0)) / ((sa+sb)/2 - sa*sb/(n*(n-1)/2.0)) END AS ari FROM sij JOIN sa USING (pair) JOIN sb USING (pair))"""
PRESENT = """pc AS (SELECT setting, cluster, COUNT(*) AS size, COUNT(*) FILTER (label = 0) AS hit FROM lab GROUP BY 1, 2),
 pt AS (SELECT setting, SUM(hit) AS total FROM pc GROUP BY 1),
 pr AS (SELECT setting, COUNT(*) AS clusters, bool_or(total > 0 AND hit/total >= 0.5 AND hit/CAST(size AS DOUBLE) >= 0.5) AS present FROM pc JOIN pt USING (setting) GROUP BY 1)"""
SIL = """pd AS (SELECT x.setting, x.cell_id, x.cluster AS own, y.cluster AS other, SUM(pow(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 2)) AS d, COUNT(*) AS n
  FROM lab x JOIN lab y ON x.setting=y.setting GROUP BY 1, 2, 3, 4),
 ab AS (SELECT setting, cell_id, MAX(CASE WHEN own=other THEN n END) AS size, MAX(CASE WHEN own=other THEN d/greatest(n-1, 1) END) AS a, MIN(CASE WHEN own<>other THEN d/n END) AS b FROM pd GROUP BY 1, 2),
 sil AS (SELECT setting, CASE WHEN COUNT(b) > 0 THEN AVG(CASE WHEN size > 1 THEN (b-a)/greatest(a, b) ELSE 0 END) END AS score FROM ab GROUP BY 1)"""


def with_(*parts):
    return "WITH " + ",\n".join([LABELS, *parts]) + "\n"


@query("ari_adjacent", with_(ARI) + "SELECT CAST(pair AS INTEGER) AS pair, round(ari, 9) AS ari FROM ari")
def ari_adjacent(spark, sf):
    return clu.adjacent_ari(views.settings_labels(spark, sf), BY, K).select("pair", F.round("ari", 9).alias("ari"))


@query("ari_mean", with_(ARI) + "SELECT round(AVG(ari), 9) AS ari FROM ari")
def ari_mean(spark, sf):
    ari = clu.adjacent_ari(views.settings_labels(spark, sf), BY, K)
    return clu.mean_ari(ari, BY).select(F.round("ari", 9).alias("ari"))


@query("ari_by_setting", with_(ARI) + "SELECT CAST(s AS INTEGER) AS setting, round(AVG(ari), 9) AS score FROM (SELECT pair AS s, ari FROM ari UNION ALL SELECT pair+1, ari FROM ari) GROUP BY 1")
def ari_by_setting(spark, sf):
    ari = clu.adjacent_ari(views.settings_labels(spark, sf), BY, K)
    return clu.ari_by_setting(ari, BY).select("setting", F.round("score", 9).alias("score"))


@query("presence_by_setting", with_(PRESENT) + "SELECT CAST(setting AS INTEGER) AS setting, clusters, present FROM pr")
def presence_by_setting(spark, sf):
    lab = views.settings_labels(spark, sf).withColumn("tracked", F.col("label") == 0)
    return clu.presence(lab, BY).drop("case_id")


@query("stability_profile", with_(PRESENT) + """SELECT COUNT(*) AS settings, COUNT(*) FILTER (present) AS present_in, round(AVG(CASE WHEN present THEN 1 ELSE 0 END), 6) AS stability,
 CAST(MIN(CASE WHEN present THEN setting END) AS INTEGER) AS first, CAST(MAX(CASE WHEN present THEN setting END) AS INTEGER) AS last FROM pr""")
def stability_profile(spark, sf):
    lab = views.settings_labels(spark, sf).withColumn("tracked", F.col("label") == 0)
    return clu.stability(clu.presence(lab, BY), BY).drop("case_id").withColumn("stability", F.round("stability", 6))


REPEATS = "rep AS (" + " UNION ALL ".join(
    f"SELECT CAST(vec_id AS VARCHAR) AS cell_id, CAST(r AS INTEGER) AS r, {i} AS setting, CAST({'label' if k % 2 else 'CASE WHEN (vec_id + r) % 10 < 6 THEN label ELSE vec_id + r END'} % {k} AS VARCHAR) AS cluster, label FROM embeddings CROSS JOIN range(0, {views.REPEATS}) t(r)"
    for i, k in enumerate(views.SETTINGS)
) + ")"


@query("repeated_presence", "WITH " + REPEATS + """, pc AS (SELECT r, setting, cluster, COUNT(*) AS size, COUNT(*) FILTER (label = 0) AS hit FROM rep GROUP BY ALL),
 pt AS (SELECT r, setting, SUM(hit) AS total FROM pc GROUP BY ALL),
 pr AS (SELECT r, setting, COUNT(*) AS clusters, bool_or(total > 0 AND hit/total >= 0.5 AND hit/CAST(size AS DOUBLE) >= 0.5) AS present FROM pc JOIN pt USING (r, setting) GROUP BY ALL)
 SELECT CAST(setting AS INTEGER) AS setting, COUNT(DISTINCT r) AS repeats, round(AVG(CASE WHEN present THEN 1 ELSE 0 END), 6) AS share, AVG(CASE WHEN present THEN 1 ELSE 0 END) >= 0.5 AS present, quantile_cont(CAST(clusters AS DOUBLE), 0.5) AS clusters FROM pr GROUP BY 1""")
def repeated_presence(spark, sf):
    lab = views.repeat_labels(spark, sf).withColumn("tracked", F.col("label") == 0)
    out = clu.repeated_presence(clu.presence(lab, [*BY, "r"]), BY, "r")
    return out.drop("case_id").withColumn("share", F.round("share", 6))


@query("mechanical_stability", "WITH " + REPEATS + ", " + ARI.replace("x.setting AS pair", "x.r AS r, x.setting AS pair").replace("FROM lab x JOIN lab y ON x.cell_id=y.cell_id", "FROM rep x JOIN rep y ON x.cell_id=y.cell_id AND x.r=y.r").replace("SELECT pair,", "SELECT r, pair,").replace("GROUP BY 1)", "GROUP BY ALL)").replace("USING (pair)", "USING (r, pair)")
 + """, m AS (SELECT r, AVG(ari) AS ari FROM ari GROUP BY 1) SELECT round(quantile_cont(ari, 0.5), 9) AS median, round(quantile_cont(ari, 0.025), 9) AS lo, round(quantile_cont(ari, 0.975), 9) AS hi, COUNT(*) AS n, quantile_cont(ari, 0.5) >= 0.8 AS stable FROM m""")
def mechanical_stability(spark, sf):
    lab = views.repeat_labels(spark, sf)
    out = clu.mechanical_stability(clu.adjacent_ari(lab, [*BY, "r"], K), BY, "r")
    return out.select(*[F.round(c, 9).alias(c) for c in ("median", "lo", "hi")], "n", "stable")


@query("silhouette_by_setting", with_(SIL) + "SELECT CAST(setting AS INTEGER) AS setting, round(score, 7) AS score, 'squared euclidean' AS distance FROM sil")
def silhouette_by_setting(spark, sf):
    lab = views.settings_labels(spark, sf)
    return clu.silhouette(lab, K).select("setting", F.round("score", 7).alias("score"), "distance")


@query("supported_window", with_(ARI, "sc AS (SELECT s AS setting, AVG(ari) AS score FROM (SELECT pair AS s, ari FROM ari UNION ALL SELECT pair+1, ari FROM ari) GROUP BY 1)",
 "pk AS (SELECT setting AS best, score AS peak FROM sc ORDER BY score DESC, setting LIMIT 1)",
 "bn AS (SELECT best, coalesce(MAX(CASE WHEN score < peak-0.02 AND setting < best THEN setting END) + 1, 0) AS lo, coalesce(MIN(CASE WHEN score < peak-0.02 AND setting > best THEN setting END) - 1, 9) AS hi FROM sc, pk GROUP BY best)")
 + "SELECT CAST((lo+1)*0.2 AS DOUBLE) AS supported_lo, CAST((hi+1)*0.2 AS DOUBLE) AS supported_hi, CAST((best+1)*0.2 AS DOUBLE) AS best, CAST((lo+1)*0.2 AS DOUBLE) AS corrected FROM bn")
def supported_window(spark, sf):
    grid = clu.resolutions(0.2, 2.0, 0.2)
    scores = clu.ari_by_setting(clu.adjacent_ari(views.settings_labels(spark, sf), BY, K), BY)
    return clu.supported_window(scores, BY, grid, 1.0).drop("case_id")


@query("jaccard_best_cluster", with_("j AS (SELECT setting, cluster, COUNT(*) AS size, COUNT(*) FILTER (label=0) AS hit FROM lab GROUP BY 1, 2)", "t AS (SELECT setting, SUM(hit) AS c FROM j GROUP BY 1)")
 + "SELECT CAST(setting AS INTEGER) AS setting, cluster, size, hit, round(hit/(size+c-hit), 9) AS jaccard FROM j JOIN t USING (setting) QUALIFY ROW_NUMBER() OVER (PARTITION BY setting ORDER BY hit/(size+c-hit) DESC, cluster) = 1")
def jaccard_best_cluster(spark, sf):
    lab = views.settings_labels(spark, sf).select(
        (F.col("label") == 0).alias("member"), F.posexplode("labels").alias("setting", "cluster")
    )
    return sep.best_cluster(lab, ["setting"]).withColumn("jaccard", F.round("jaccard", 9))


@query("cluster_persistence", with_("pp AS (SELECT a.cluster, b.setting, b.cluster AS other, COUNT(*) AS n FROM lab a JOIN lab b ON a.cell_id=b.cell_id WHERE a.setting=4 AND b.setting<>4 GROUP BY ALL)",
 "za AS (SELECT setting, cluster, SUM(n) AS na FROM pp GROUP BY ALL)", "zb AS (SELECT setting, other, SUM(n) AS nb FROM pp GROUP BY ALL)",
 "bj AS (SELECT cluster, setting, MAX(n/(na+nb-n)) AS j FROM pp JOIN za USING (setting, cluster) JOIN zb USING (setting, other) GROUP BY ALL)")
 + "SELECT cluster, round(AVG(j), 9) AS persistence, AVG(j) <= 0.4 AS artifact FROM bj GROUP BY 1")
def cluster_persistence(spark, sf):
    out = clu.persistence(views.settings_labels(spark, sf), BY, K, 4)
    return out.select("cluster", F.round("persistence", 9).alias("persistence"), "artifact")


@query("tracked_column", base() + "SELECT 'segment' AS \"column\", COUNT(*) AS rows FROM cells WHERE segment='MACHINERY'")
def tracked_column(spark, sf):
    cells = views.order_cells(spark, sf)
    col = clu.find_track_column(cells, "MACHINERY")
    return cells.filter(F.col(col) == "MACHINERY").agg(F.lit(col).alias("column"), F.count("*").alias("rows"))


@query("resolution_grid", with_("c AS (SELECT setting, COUNT(DISTINCT cluster) AS clusters, COUNT(*) AS n FROM lab GROUP BY 1)") + "SELECT CAST(round(0.2 + 0.2*setting, 4) AS DOUBLE) AS r, clusters, n FROM c")
def resolution_grid(spark, sf):
    """The grid's settings beside the clusters and vectors of the labels found at each."""
    grid = F.array(*[F.lit(r) for r in clu.resolutions(0.2, 2.0, 0.2)])
    long = views.settings_labels(spark, sf).select(F.posexplode("labels").alias("setting", "cluster"))
    per = long.groupBy("setting").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n"))
    return per.select(F.get(grid, F.col("setting")).alias("r"), "clusters", "n")


SIGNATURES = {"S": ["Brand#1", "Brand#2", "Brand#3"], "G2M": ["Brand#4", "Brand#5"], "rest": ["Brand#6", "Brand#99"]}
SIGS = "sig AS (SELECT state, gene FROM (VALUES ('S','Brand#1'),('S','Brand#2'),('S','Brand#3'),('G2M','Brand#4'),('G2M','Brand#5'),('rest','Brand#6')) v(state, gene)), wd AS (SELECT COUNT(DISTINCT gene) AS w FROM counts), ks AS (SELECT state, COUNT(*) AS k FROM sig GROUP BY 1)"


def signatures(spark, sf):
    brands = views.brand_features(spark, sf)
    rows = [F.struct(F.lit(s).alias("state"), F.lit(g).alias("gene")) for s, gs in SIGNATURES.items() for g in gs]
    one = brands.agg(F.count("*").alias("n"))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.state", "s.gene")


def sig_sql(key: str) -> str:
    return f"""th AS (SELECT c.{key} AS key, s.state, SUM(ln(1+k.value)) AS hit FROM counts k JOIN cells c USING (cell_id) JOIN sig s USING (gene) GROUP BY ALL),
 tt AS (SELECT c.{key} AS key, SUM(ln(1+k.value)) AS total FROM counts k JOIN cells c USING (cell_id) GROUP BY 1),
 tn AS (SELECT {key} AS key, COUNT(*) AS n FROM cells GROUP BY 1),
 ss AS (SELECT tn.key, ks.state, (coalesce(hit, 0)/k - (coalesce(total, 0)-coalesce(hit, 0))/(w-k))/n AS score FROM tn CROSS JOIN ks CROSS JOIN wd LEFT JOIN th ON th.key=tn.key AND th.state=ks.state LEFT JOIN tt ON tt.key=tn.key)"""


@query("signature_annotation", base(SIGS, sig_sql("segment")) + "SELECT key AS segment, state, round(score, 7) AS score FROM ss QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY round(score, 10) DESC, state) = 1")
def signature_annotation(spark, sf):
    counts, cells = views.brand_counts(spark, sf), views.order_cells(spark, sf)
    s = clu.signature_scores(counts, cells, signatures(spark, sf), ["segment"], red.log1p_counts(F.col("value")))
    return clu.annotate(s, ["segment"]).withColumn("score", F.round("score", 7))


@query("cell_cycle_phase", base(SIGS, sig_sql("cell_id"), """cw AS (SELECT key, MAX(CASE WHEN state='S' THEN round(score, 9) END) AS s, MAX(CASE WHEN state='G2M' THEN round(score, 9) END) AS g FROM ss GROUP BY 1)""")
 + "SELECT CASE WHEN s <= 0 AND g <= 0 THEN 'G1' WHEN s > g THEN 'S' ELSE 'G2M' END AS phase, COUNT(*) AS n, round(SUM(s), 5) AS s_score FROM cw GROUP BY 1")
def cell_cycle_phase(spark, sf):
    counts, cells = views.brand_counts(spark, sf), views.order_cells(spark, sf)
    s = clu.signature_scores(counts, cells, signatures(spark, sf), ["cell_id"], red.log1p_counts(F.col("value")))
    c = clu.cell_cycle(s.withColumn("score", F.round("score", 9)), ["cell_id"])
    return c.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("s_score"), 5).alias("s_score"))


# --- model-backed steps: iterative, so rows only --------------------------------------
@query("pca_embedding")
def pca_embedding(spark, sf):
    ds = views.order_dataset(spark, sf)
    return clu.embed(ds.counts, ds.cells)


@query("pca_embedding_variable_features")
def pca_embedding_variable_features(spark, sf):
    ds = views.order_dataset(spark, sf)
    return clu.embed_hvg(ds.counts, ds.cells, BY)


@query("cluster_sweep")
def cluster_sweep(spark, sf):
    emb = views.embedding(spark, sf)
    lab, engine = clu.sweep(emb, clu.resolutions(0.2, 2.0, 0.2), 0)
    per = lab.select(F.posexplode("labels").alias("setting", "cluster")).groupBy("setting", "cluster").agg(F.count("*").alias("n"))
    return per.withColumn("engine", F.lit(clu.reconcile_engine([engine])))


@query("cluster_to_k")
def cluster_to_k(spark, sf):
    out = clu.cluster_to_k(views.embedding(spark, sf), 10, 0)
    return out.groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query("spurious_groups")
def spurious_groups(spark, sf):
    """Separation of every k-means group of the orders at discovery and held out, and which one collapses, if any."""
    ds = views.order_dataset(spark, sf)
    thinned = hold(sep.thin(ds.counts, 0.5, 0))
    train = thinned.select("cell_id", "gene", F.col("train").cast("double").alias("value")).filter("value > 0")
    groups = clu.cluster_to_k(clu.embed(train, ds.cells), 6, 0).select("cell_id", "cluster")
    halves = {}
    for half in ("train", "test"):
        rows = thinned.select("cell_id", "gene", F.col(half).cast("double").alias("value"))
        halves[half] = sep.one_vs_rest(rows, groups.withColumn("case_id", case_key("orders", "cell_id")), BY, "cluster")
    joined = halves["train"].select(*BY, "level", "gene", F.col("auc").alias("disc")).join(
        halves["test"].select(*BY, "level", "gene", F.col("auc").alias("hold")), [*BY, "level", "gene"]
    )
    best = ordered.top_k(joined, [*BY, "level"], [F.desc("disc"), F.asc("gene")], 4)
    scores = best.groupBy(*BY, F.col("level").alias("cluster")).agg(
        F.avg("disc").alias("disc_auc"), F.avg("hold").alias("hold_auc")
    )
    found = sep.spurious_group(scores, BY).select(*BY, "cluster", F.lit(True).alias("spurious"))
    told = scores.join(found, [*BY, "cluster"], "left").withColumn("spurious", F.coalesce("spurious", F.lit(False)))
    return told.drop("case_id").withColumn("collapse", F.col("disc_auc") - F.col("hold_auc"))


@query("neighbour_graph", """WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 d AS (SELECT a.v, b.v AS u, list_sum(list_transform(range(1, len(a.x)+1), lambda i: (a.x[i]-b.x[i])*(a.x[i]-b.x[i]))) AS d FROM p a JOIN p b ON a.v <> b.v),
 n AS (SELECT v, u FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY v ORDER BY d, u) <= 15)
 SELECT v, u, COUNT(*) AS w FROM (SELECT v, u FROM n UNION ALL SELECT u, v FROM n) GROUP BY ALL""")
def neighbour_graph(spark, sf):
    """Cells of up to one leaf: exact, so plain SQL can tell; above, tests hold its recall."""
    return graph.neighbour_graph(views.embedding(spark, sf))


@query("graph_communities")
def graph_communities(spark, sf):
    """Communities of all vectors at ten resolutions: how many, and their modularity."""
    emb = views.embedding(spark, sf)
    grid = clu.resolutions(0.2, 2.0, 0.2)
    edges = keep(graph.neighbour_graph(emb))
    found = graph.communities(edges, emb.select(F.col("cell_id").alias("v")), grid)
    out = graph.modularity(edges, found, grid)
    return out.select(F.get(F.array(*[F.lit(r) for r in grid]), F.col("s")).alias("r"), "communities", "modularity", F.lit(graph.ENGINE).alias("engine"))
