"""Queries over count splitting, AUC and marker hold-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.dataset import case_key
from plumbline.operators import ordered
from plumbline.operators import reduce as red
from plumbline.operators import separation as sep
from plumbline.plans import views
from plumbline.plans.reductions import BY
from plumbline.plans.registry import query
from plumbline.plans.sqltext import base
from plumbline.session import hold

def thin_sql(seed: str = "0") -> str:
    """Rows (cell_id, gene, n, seed, train) of an even split: set bits among n keyed bits."""
    return f"""SELECT cell_id, gene, CAST(round(value) AS BIGINT) AS n, {seed} AS seed,
  CAST(list_sum(list_transform(range(0, (CAST(round(value) AS BIGINT) + 59) // 60), lambda c:
    bit_count(CAST('0x' || substr(md5(cell_id || '|' || gene || '|' || CAST({seed} AS VARCHAR) || '|' || CAST(c AS VARCHAR)), 1, 15) AS BIGINT)
      & (CAST(pow(2, least(60, CAST(round(value) AS BIGINT) - 60*c)) AS BIGINT) - 1)))) AS BIGINT) AS train FROM counts"""


def thin_draw_sql(eps: float) -> str:
    """The general split: a sum of keyed Bernoulli draws."""
    return f"""SELECT cell_id, gene, CAST(round(value) AS BIGINT) AS n,
  CAST(list_sum(list_transform(range(0, CAST(round(value) AS BIGINT)), lambda i:
    CASE WHEN CAST('0x' || substr(md5(cell_id || '|' || gene || '|0|' || CAST(i // 4 AS VARCHAR)), CAST(8*(i % 4) + 1 AS BIGINT), 8) AS BIGINT) < {int(round(eps * 2**32))}
    THEN 1 ELSE 0 END)) AS BIGINT) AS train FROM counts"""


THIN = f"thin AS ({thin_sql()})"


def auc_sql(source: str, keys: str, score: str = "score", label: str = "member", fold: bool = True) -> str:
    k = keys + ", " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    raw = "(SUM(n1*(cum - n0/2.0)) / (SUM(n1)*CAST(SUM(n0) AS DOUBLE)))"
    val = f"greatest({raw}, 1-{raw})" if fold else raw
    return f"""SELECT {k}CASE WHEN SUM(n1) > 0 AND SUM(n0) > 0 THEN {val} ELSE 0.5 END AS auc FROM (
  SELECT *, SUM(n0) OVER ({part} ORDER BY s) AS cum FROM (
   SELECT {k}{score} AS s, SUM(CASE WHEN {label} THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN {label} THEN 0 ELSE 1 END) AS n0 FROM {source} GROUP BY ALL)){g}"""


GENES = "genes AS (SELECT DISTINCT gene FROM counts)"
MEMBER = "mem AS (SELECT cell_id, segment = 'BUILDING' AS member FROM cells)"


@query("thin_counts", base(THIN) + "SELECT gene, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(train) AS BIGINT) AS train, CAST(SUM(n - train) AS BIGINT) AS test, CAST(SUM(train*train) AS BIGINT) AS train_sq FROM thin GROUP BY gene")
def thin_counts(spark, sf):
    t = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    return t.groupBy("gene").agg(
        F.sum(F.col("train") + F.col("test")).alias("total"),
        F.sum("train").alias("train"),
        F.sum("test").alias("test"),
        F.sum(F.col("train") * F.col("train")).alias("train_sq"),
    )


@query("thin_counts_uneven", base(f"thin AS ({thin_draw_sql(0.3)})") + "SELECT gene, CAST(SUM(train) AS BIGINT) AS train, CAST(SUM(n - train) AS BIGINT) AS test FROM thin GROUP BY gene")
def thin_counts_uneven(spark, sf):
    t = sep.thin(views.brand_counts(spark, sf), 0.3, 0)
    return t.groupBy("gene").agg(F.sum("train").alias("train"), F.sum("test").alias("test"))


@query("thin_counts_fast_hash")
def thin_counts_fast_hash(spark, sf):
    """The 64-bit-hash draw for large data; no other engine shares that hash, so rows only."""
    t = sep.thin(views.brand_counts(spark, sf), 0.5, 0, draw="xx")
    return t.groupBy("gene").agg(F.sum("train").alias("train"), F.sum("test").alias("test"))


@query("auc_quality_by_length", "WITH d AS (SELECT n_chars, quality = 1 AS member FROM documents JOIN labels USING (doc_id)) SELECT round(auc, 9) AS auc FROM ("
 + auc_sql("d", "", "n_chars") + ")")
def auc_quality_by_length(spark, sf):
    d = views.document_labels(spark, sf)
    return sep.auc(d, BY, F.col("n_chars").cast("double"), F.col("quality") == 1).select(F.round("auc", 9).alias("auc"))


@query("directional_auc_toxic_by_length", "WITH d AS (SELECT lang, n_chars, toxic = 1 AS member FROM documents JOIN labels USING (doc_id)) SELECT lang, round(auc, 9) AS auc FROM ("
 + auc_sql("d", "lang", "n_chars", fold=False) + ")")
def directional_auc_toxic_by_length(spark, sf):
    d = views.document_labels(spark, sf)
    return sep.auc(d, ["lang"], F.col("n_chars").cast("double"), F.col("toxic") == 1, fold=False).select(
        "lang", F.round("auc", 9).alias("auc")
    )


OVR = """levels AS (SELECT DISTINCT region AS lv FROM cells),
 dense AS (SELECT lv, g.gene, c.region = lv AS member, coalesce(k.value, 0) AS v FROM levels CROSS JOIN genes g CROSS JOIN cells c LEFT JOIN counts k ON k.cell_id=c.cell_id AND k.gene=g.gene)"""


@query("auc_by_brand_per_region", base(GENES, OVR) + 'SELECT lv AS "level", gene, round(auc, 9) AS auc FROM (' + auc_sql("dense", "lv, gene", "v") + ")")
def auc_by_brand_per_region(spark, sf):
    out = sep.one_vs_rest(views.brand_counts(spark, sf), views.order_cells(spark, sf), BY, "region")
    return out.select("level", "gene", F.round("auc", 9).alias("auc"))


@query("claimed_group_by_markers", base(GENES, OVR, "a AS (" + auc_sql("dense", "lv, gene", "v") + ")", "sz AS (SELECT region AS lv, COUNT(*) AS n FROM cells GROUP BY 1)")
 + """SELECT lv AS "level", n, round(m, 9) AS mean_auc FROM (SELECT lv, AVG(auc) AS m FROM a WHERE gene IN ('Brand#3','Brand#11') GROUP BY 1) JOIN sz USING (lv) ORDER BY round(m, 10) DESC, n DESC, lv LIMIT 1""")
def claimed_group_by_markers(spark, sf):
    g = sep.claimed_group(
        views.brand_counts(spark, sf), views.order_cells(spark, sf), BY, "region", None, ["Brand#3", "Brand#11"]
    )
    return g.select("level", "n", F.round("mean_auc", 9).alias("mean_auc"))


@query("claimed_group_named", base() + """SELECT 'EUROPE' AS "level", COUNT(*) AS n FROM cells WHERE region='EUROPE'""")
def claimed_group_named(spark, sf):
    g = sep.claimed_group(views.brand_counts(spark, sf), views.order_cells(spark, sf), BY, "region", "EUROPE", [])
    return g.select("level", "n")


@query("wilcoxon_markers", base(GENES, OVR, "a AS (" + auc_sql("dense", "lv, gene", "v", fold=False) + ")",
 "s AS (SELECT lv, COUNT(*) FILTER (region=lv) AS n1, COUNT(*) FILTER (region<>lv) AS n0 FROM levels CROSS JOIN cells GROUP BY 1)")
 + """SELECT lv AS "level", gene, round((auc-0.5)*n1*n0/sqrt(n1*CAST(n0 AS DOUBLE)*(n1+n0+1)/12), 6) AS score FROM a JOIN s USING (lv)""")
def wilcoxon_markers(spark, sf):
    m = sep.rank_markers(views.brand_counts(spark, sf), views.order_cells(spark, sf), BY, "region")
    return m.select("level", "gene", F.round("score", 6).alias("score"))


@query("wilcoxon_markers_with_fdr")
def wilcoxon_markers_with_fdr(spark, sf):
    """The same ranking with normal p, adjusted p and log fold change (no erfc in plain SQL)."""
    m = sep.rank_markers(views.brand_counts(spark, sf), views.order_cells(spark, sf), BY, "region")
    top = ordered.top_k(m, [*BY, "level"], [F.desc("score"), F.asc("gene")], 10, out="rank")
    return top.select("level", "rank", "gene", "score", "p", "q", "logfc")


def building_cells(spark, sf):
    return views.order_cells(spark, sf).withColumn("member", F.col("segment") == "BUILDING")


SPLIT = """hd AS (SELECT g.gene, m.member, coalesce(t.train, 0) AS tr, coalesce(t.n - t.train, 0) AS te FROM genes g CROSS JOIN mem m LEFT JOIN thin t ON t.cell_id=m.cell_id AND t.gene=g.gene),
 sa AS (SELECT gene, a.auc AS disc, b.auc AS hold FROM ({}) a JOIN ({}) b USING (gene))""".format(auc_sql("hd", "gene", "tr"), auc_sql("hd", "gene", "te"))


@query("split_aucs", base(GENES, MEMBER, THIN, SPLIT) + "SELECT gene, round(disc, 9) AS disc, round(hold, 9) AS hold FROM sa")
def split_aucs(spark, sf):
    thinned = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    out = sep.split_aucs(thinned, building_cells(spark, sf), BY)
    return out.select("gene", F.round("disc", 9).alias("disc"), F.round("hold", 9).alias("hold"))


@query("auto_markers", base(GENES, MEMBER, THIN, SPLIT) + "SELECT gene, round(disc, 9) AS auc, ROW_NUMBER() OVER (ORDER BY round(disc, 10) DESC, gene) AS rank FROM sa WHERE gene <> 'Brand#1' QUALIFY rank <= 4")
def auto_markers(spark, sf):
    thinned = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    aucs = sep.split_aucs(thinned, building_cells(spark, sf), BY).withColumnRenamed("disc", "auc")
    top = sep.top_markers(aucs, BY, 4, exclude=["Brand#1"])
    return top.select("gene", F.round("auc", 9).alias("auc"), F.col("rank").cast("long").alias("rank"))


def claimed_markers(spark, sf):
    """Claimed markers: every brand of the most expensive parts, plus one name no dataset has."""
    p = views.table(spark, sf, "part")
    dear = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    top = dear.orderBy(F.desc(F.round("m", 6)), "p_brand").limit(5).select(F.col("p_brand").alias("gene"))
    ghost = p.agg(F.concat(F.lit("Brand#"), (F.count("*") + 1000).cast("string")).alias("gene"))
    return top.unionByName(ghost).withColumn("case_id", case_key("orders", "gene"))


CLAIMED = """claimed AS (SELECT gene FROM (SELECT p_brand AS gene FROM part GROUP BY 1 ORDER BY round(AVG(p_retailprice), 6) DESC, p_brand LIMIT 5)
 UNION ALL SELECT 'Brand#' || CAST(COUNT(*) + 1000 AS VARCHAR) FROM part)"""


@query("holdout_report", base(GENES, MEMBER, THIN, SPLIT, CLAIMED) + "SELECT gene, round(disc, 9) AS disc, round(hold, 9) AS hold, coalesce(hold >= 0.6, false) AS survives FROM claimed LEFT JOIN sa USING (gene)")
def holdout_report(spark, sf):
    thinned = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    rep = sep.holdout_report(sep.split_aucs(thinned, building_cells(spark, sf), BY), claimed_markers(spark, sf), BY)
    return rep.select("gene", F.round("disc", 9).alias("disc"), F.round("hold", 9).alias("hold"), "survives")


SEEDS = 200


def seeded_report(spark, sf):
    """Both separations of every claimed marker in each of the repeated splits."""
    counts = views.brand_counts(spark, sf)
    wanted = counts.join(claimed_markers(spark, sf).select("gene"), "gene", "left_semi")
    return hold(sep.repeated_split_aucs(wanted, building_cells(spark, sf), BY, 0.5, 0, SEEDS))


SEEDED = """wanted AS (SELECT * FROM counts WHERE gene IN (SELECT gene FROM claimed)),
 sthin AS ({}), sh AS (SELECT g.gene, s.seed, m.member, coalesce(t.train, 0) AS tr, coalesce(t.n - t.train, 0) AS te
  FROM (SELECT DISTINCT gene FROM wanted) g CROSS JOIN (SELECT DISTINCT seed FROM sthin) s CROSS JOIN mem m LEFT JOIN sthin t ON t.cell_id=m.cell_id AND t.gene=g.gene AND t.seed=s.seed),
 ss AS (SELECT gene, seed, a.auc AS disc, b.auc AS hold FROM ({}) a JOIN ({}) b USING (gene, seed)),
 rep AS (SELECT seed, AVG(disc) AS disc, AVG(hold) AS hold, CAST(SUM(CASE WHEN hold >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS surviving FROM ss GROUP BY 1)""".format(
    thin_sql("seed").replace("FROM counts", f"FROM wanted CROSS JOIN (SELECT unnest(range(0, {SEEDS})) AS seed)"),
    auc_sql("sh", "gene, seed", "tr"), auc_sql("sh", "gene, seed", "te"))


@query("repeat_split_distributions", base(MEMBER, CLAIMED, SEEDED) + "SELECT CAST(seed AS INTEGER) AS seed, round(disc, 9) AS disc_mean, round(hold, 9) AS hold_mean, surviving FROM rep")
def repeat_split_distributions(spark, sf):
    rep = seeded_report(spark, sf).withColumn("survives", F.col("hold") >= 0.60)
    out = sep.holdout_summary(rep, [*BY, "seed"])
    return out.select("seed", F.round("disc_mean", 9).alias("disc_mean"), F.round("hold_mean", 9).alias("hold_mean"), "surviving")


@query("interval_over_seeds", base(MEMBER, CLAIMED, SEEDED) + """SELECT round(quantile_cont(hold, 0.5), 9) AS median, round(quantile_cont(hold, 0.025), 9) AS lo, round(quantile_cont(hold, 0.975), 9) AS hi, COUNT(*) AS n FROM rep""")
def interval_over_seeds(spark, sf):
    rep = seeded_report(spark, sf).withColumn("survives", F.col("hold") >= 0.60)
    summary = sep.holdout_summary(rep, [*BY, "seed"])
    iv = sep.interval(summary, BY, "hold_mean")
    return iv.select(*[F.round(c, 9).alias(c) for c in ("median", "lo", "hi")], "n")


@query("marker_medians_over_seeds", base(MEMBER, CLAIMED, SEEDED) + "SELECT gene, round(quantile_cont(disc, 0.5), 9) AS disc, round(quantile_cont(hold, 0.5), 9) AS hold FROM ss GROUP BY gene")
def marker_medians_over_seeds(spark, sf):
    aucs = seeded_report(spark, sf)
    return aucs.groupBy("gene").agg(
        F.round(F.percentile("disc", F.lit(0.5)), 9).alias("disc"), F.round(F.percentile("hold", F.lit(0.5)), 9).alias("hold")
    )


DIFFS = """tr AS (SELECT t.cell_id, t.gene, m.member, ln(1 + t.train) AS d, ln(1 + t.n - t.train) AS h FROM thin t JOIN mem m USING (cell_id)),
 nn AS (SELECT COUNT(*) FILTER (member) AS n1, COUNT(*) FILTER (NOT member) AS n0 FROM mem),
 df AS (SELECT gene, SUM(CASE WHEN member THEN d ELSE 0 END)/ANY_VALUE(n1) AS mu1, SUM(CASE WHEN member THEN 0 ELSE d END)/ANY_VALUE(n0) AS mu0,
   SUM(CASE WHEN member THEN d*d ELSE 0 END)/ANY_VALUE(n1) AS q1, SUM(CASE WHEN member THEN 0 ELSE d*d END)/ANY_VALUE(n0) AS q0 FROM tr, nn GROUP BY gene)"""


@query("mean_score_auc", base(MEMBER, THIN, DIFFS, "tk AS (SELECT gene FROM df ORDER BY round(mu1-mu0, 10) DESC, gene LIMIT 4)",
 """sc AS (SELECT m.cell_id, m.member, round(coalesce(SUM(0.25*d), 0), 10) AS sd, round(coalesce(SUM(0.25*h), 0), 10) AS sh FROM mem m LEFT JOIN (SELECT * FROM tr WHERE gene IN (SELECT gene FROM tk)) x ON x.cell_id=m.cell_id GROUP BY 1, 2)""")
 + "SELECT round(a.auc, 7) AS disc_auc, round(b.auc, 7) AS hold_auc FROM (" + auc_sql("sc", "", "sd") + ") a, (" + auc_sql("sc", "", "sh") + ") b")
def mean_score_auc(spark, sf):
    thinned = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    out = sep.mean_score_auc(hold(thinned), building_cells(spark, sf), BY)
    return out.select(F.round("disc_auc", 7).alias("disc_auc"), F.round("hold_auc", 7).alias("hold_auc"))


@query("direction_score_auc", base(MEMBER, THIN, DIFFS, """wt AS (SELECT gene, (mu1-mu0) / CASE WHEN sqrt((greatest(q1-mu1*mu1,0)+greatest(q0-mu0*mu0,0))/2) < 1e-8 THEN 1 ELSE sqrt((greatest(q1-mu1*mu1,0)+greatest(q0-mu0*mu0,0))/2) END AS w FROM df)""",
 """sc AS (SELECT m.cell_id, m.member, round(coalesce(SUM(w*d), 0), 10) AS sd, round(coalesce(SUM(w*h), 0), 10) AS sh FROM mem m LEFT JOIN (SELECT * FROM tr JOIN wt USING (gene)) x ON x.cell_id=m.cell_id GROUP BY 1, 2)""")
 + "SELECT round(CASE WHEN a.auc < 0.5 THEN 1-a.auc ELSE a.auc END, 7) AS disc_auc, round(CASE WHEN a.auc < 0.5 THEN 1-b.auc ELSE b.auc END, 7) AS hold_auc FROM (" + auc_sql("sc", "", "sd", fold=False) + ") a, (" + auc_sql("sc", "", "sh", fold=False) + ") b")
def direction_score_auc(spark, sf):
    thinned = sep.thin(views.brand_counts(spark, sf), 0.5, 0)
    out = sep.direction_score_auc(hold(thinned), building_cells(spark, sf), BY)
    return out.select(F.round("disc_auc", 7).alias("disc_auc"), F.round("hold_auc", 7).alias("hold_auc"))
