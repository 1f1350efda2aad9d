"""Queries over arms, expression scales, replicate tables and per-feature tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import inference as inf
from plumbline.operators import reduce as red
from plumbline.plans import views
from plumbline.plans.registry import query
from plumbline.plans.sqltext import FOCUS, GENE_WELCH, KEPT, LIBRARY, PICKED, UNIT_WELCH, WELCH_T, base, fdr_sql, welch_p

BY = ["case_id"]


def arms_and_kept(spark, sf):
    cells = views.order_cells(spark, sf)
    picked = red.two_arms(cells, "region", BY).first()
    return cells, picked, red.filter_arms(cells, "region", picked.ref, picked.alt)


def cpm_unit_tests(spark, sf):
    counts = views.brand_counts(spark, sf)
    _, _, kept = arms_and_kept(spark, sf)
    deep = red.with_library(kept, counts)
    values = red.unit_means(counts, deep, BY, red.log1p_cpm(F.col("value"), F.col("library")))
    return inf.welch_by_gene_units(values, kept, BY)


@query("two_arm_pick", base() + """SELECT ref, alt, (SELECT COUNT(*) FROM kept WHERE arm='ref') AS n_ref,
 (SELECT COUNT(*) FROM kept WHERE arm='alt') AS n_alt FROM arms""")
def two_arm_pick(spark, sf):
    return red.two_arms(views.order_cells(spark, sf), "region", BY).drop("case_id")


@query("busiest_levels_by_segment", base() + """SELECT segment, MAX(CASE WHEN rn=1 THEN unit END) AS ref, MAX(CASE WHEN rn=2 THEN unit END) AS alt
 FROM (SELECT segment, unit, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY COUNT(*) DESC, unit) AS rn FROM cells GROUP BY 1, 2)
 GROUP BY 1""")
def busiest_levels_by_segment(spark, sf):
    return red.busiest_levels(views.order_cells(spark, sf), "unit", ["segment"]).select("segment", "ref", "alt")


@query("arm_filter_counts", base() + "SELECT arm, region, unit, COUNT(*) AS n, round(SUM(price), 2) AS price FROM kept GROUP BY 1, 2, 3")
def arm_filter_counts(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    return kept.groupBy("arm", "region", "unit").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("bad_unit_candidates", base() + """SELECT * FROM (
 SELECT 'cell_id' AS unit_column, COUNT(DISTINCT cell_id) AS units, COUNT(*) AS n, COUNT(DISTINCT cell_id) >= greatest(0.9*COUNT(*), COUNT(*)-1) AS bad_unit FROM cells
 UNION ALL SELECT 'unit', COUNT(DISTINCT unit), COUNT(*), COUNT(DISTINCT unit) >= greatest(0.9*COUNT(*), COUNT(*)-1) FROM cells
 UNION ALL SELECT 'customer', COUNT(DISTINCT customer), COUNT(*), COUNT(DISTINCT customer) >= greatest(0.9*COUNT(*), COUNT(*)-1) FROM cells)""")
def bad_unit_candidates(spark, sf):
    cells = views.order_cells(spark, sf)
    out = None
    for c in ("cell_id", "unit", "customer"):
        one = red.bad_unit(cells, c, BY).select(F.lit(c).alias("unit_column"), "units", "n", "bad_unit")
        out = one if out is None else out.unionByName(one)
    return out


@query("expressed_features", base() + "SELECT gene, SUM(value) AS total FROM counts JOIN kept USING (cell_id) GROUP BY gene HAVING SUM(value) > 0")
def expressed_features(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    return red.expressed(views.brand_counts(spark, sf), kept, BY).drop("case_id")


@query("log1p_expression_by_region", base() + """SELECT region, gene, COUNT(*) AS nonzero, round(SUM(ln(1+value)), 6) AS total
 FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2""")
def log1p_expression_by_region(spark, sf):
    rows = red.measured(views.brand_counts(spark, sf), views.order_cells(spark, sf), ["region"])
    return rows.groupBy("region", "gene").agg(
        F.count("*").alias("nonzero"), F.round(F.sum(red.log1p_counts(F.col("value"))), 6).alias("total")
    )


@query("cpm_log1p_means", base(LIBRARY) + """SELECT region, gene, round(SUM(ln(1 + value/library*1e6)) / ANY_VALUE(n), 6) AS mean
 FROM counts JOIN library USING (cell_id) JOIN cells USING (cell_id) JOIN (SELECT region, COUNT(*) AS n FROM cells GROUP BY 1) USING (region) GROUP BY 1, 2""")
def cpm_log1p_means(spark, sf):
    counts = views.brand_counts(spark, sf)
    cells = red.with_library(views.order_cells(spark, sf), counts)
    sums = red.measured(counts, cells, ["region", "library"]).groupBy("region", "gene").agg(
        F.sum(red.log1p_cpm(F.col("value"), F.col("library"))).alias("s")
    )
    n = cells.groupBy("region").agg(F.count("*").alias("n"))
    return sums.join(n, "region").select("region", "gene", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@query("cp10k_log1p_means", base(LIBRARY) + """SELECT segment, gene, round(SUM(ln(1 + value/greatest(library,1)*1e4)) / ANY_VALUE(n), 6) AS mean
 FROM counts JOIN library USING (cell_id) JOIN cells USING (cell_id) JOIN (SELECT segment, COUNT(*) AS n FROM cells GROUP BY 1) USING (segment) GROUP BY 1, 2""")
def cp10k_log1p_means(spark, sf):
    counts = views.brand_counts(spark, sf)
    cells = red.with_library(views.order_cells(spark, sf), counts)
    sums = red.measured(counts, cells, ["segment", "library"]).groupBy("segment", "gene").agg(
        F.sum(red.log1p_cp10k(F.col("value"), F.col("library"))).alias("s")
    )
    n = cells.groupBy("segment").agg(F.count("*").alias("n"))
    return sums.join(n, "segment").select("segment", "gene", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@query("dense_to_long", """SELECT CAST(i AS INTEGER) - 1 AS pos, COUNT(*) AS n, round(SUM(CAST(embedding[CAST(i AS INTEGER)] AS DOUBLE)), 6) AS total
 FROM embeddings, range(1, 65) r(i) WHERE embedding[CAST(i AS INTEGER)] <> 0 GROUP BY 1""")
def dense_to_long(spark, sf):
    long = red.to_long(views.embedding(spark, sf))
    return long.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("long_to_vectors", base("""long AS (SELECT cell_id, CAST(regexp_extract(gene, '(\\d+)', 1) AS INTEGER) - 1 AS pos, value FROM counts)""")
 + """SELECT COUNT(DISTINCT cell_id) AS cells, CAST(MAX((SELECT COUNT(DISTINCT p_brand) FROM part)) AS BIGINT) AS width, SUM(value * (pos + 1)) AS checksum FROM long""")
def long_to_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array

    vec = red.to_vectors(views.brand_counts(spark, sf), views.brand_features(spark, sf), "value")
    arr = vec.select(vector_to_array("vec").alias("a"))
    weighted = F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return arr.agg(
        F.count("*").alias("cells"), F.max(F.size("a")).cast("long").alias("width"), F.sum(weighted).alias("checksum")
    )


@query("log2_fold_change", base(GENE_WELCH) + "SELECT gene, round((m1 - m0)/ln(2), 6) AS log2fc FROM gene_stats")
def log2_fold_change(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    t = inf.welch_by_gene(views.brand_counts(spark, sf), kept, BY, red.log1p_counts(F.col("value")))
    return t.select("gene", F.round("log2fc", 6).alias("log2fc"))


@query("pseudobulk_region_nation_brand", base() + """SELECT region, unit, gene, CAST(SUM(round(value)) AS BIGINT) AS total
 FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3""")
def pseudobulk_region_nation_brand(spark, sf):
    return red.pseudobulk(views.brand_counts(spark, sf), views.order_cells(spark, sf), ["region", "unit"])


@query("pseudobulk_samples_with_factor", base() + """SELECT region, unit, priority, COUNT(*) AS n_cells FROM cells GROUP BY 1, 2, 3""")
def pseudobulk_samples_with_factor(spark, sf):
    return red.sample_table(views.order_cells(spark, sf), ["region", "unit", "priority"])


@query("replicate_profiles", base(GENE_WELCH, PICKED, FOCUS) + """SELECT unit, arm, gene, COUNT(*) AS n, round(AVG(ln(1+value)), 6) AS value FROM focus GROUP BY 1, 2, 3""")
def replicate_profiles(spark, sf):
    focus = picked_focus(spark, sf)
    return red.unit_profiles(focus, ["gene"]).withColumn("value", F.round("value", 6))


def picked_focus(spark, sf, scale=red.log1p_counts):
    _, _, kept = arms_and_kept(spark, sf)
    counts = views.brand_counts(spark, sf)
    gene = inf.pick_gene(inf.welch_by_gene(counts, kept, BY, scale(F.col("value"))), BY).select(*BY, "gene")
    return red.focus_values(counts, kept.join(gene, BY), BY)


@query("unit_mean_matrix", base(UNIT_WELCH) + "SELECT unit, arm, gene, n_cells, round(value, 6) AS value FROM unit_values JOIN unit_n USING (unit, arm)")
def unit_mean_matrix(spark, sf):
    counts = views.brand_counts(spark, sf)
    _, _, kept = arms_and_kept(spark, sf)
    deep = red.with_library(kept, counts)
    out = red.unit_means(counts, deep, BY, red.log1p_cpm(F.col("value"), F.col("library")))
    return out.select("unit", "arm", "gene", "n_cells", F.round("value", 6).alias("value"))


@query("unit_cpm_of_sums", base("""us AS (SELECT unit, arm, gene, SUM(value) AS total FROM counts JOIN kept USING (cell_id) GROUP BY 1, 2, 3)""")
 + "SELECT unit, arm, gene, total, round(ln(1 + total / SUM(total) OVER (PARTITION BY unit, arm) * 1e6), 6) AS value FROM us")
def unit_cpm_of_sums(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    out = red.unit_cpm(views.brand_counts(spark, sf), kept, BY)
    return out.select("unit", "arm", "gene", "total", F.round("value", 6).alias("value"))


@query("replicate_counts", base() + """SELECT CAST(COUNT(DISTINCT CASE WHEN arm='ref' THEN unit END) AS BIGINT) AS units_ref, COUNT(DISTINCT CASE WHEN arm='alt' THEN unit END) AS units_alt,
 least(COUNT(DISTINCT CASE WHEN arm='ref' THEN unit END), COUNT(DISTINCT CASE WHEN arm='alt' THEN unit END)) AS per_group,
 COUNT(DISTINCT unit) AS total_units, COUNT(DISTINCT unit || '|' || arm) AS n_samples FROM kept""")
def replicate_counts(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    return red.replicates(kept, BY).drop("case_id")


@query("icc_price_by_supplier", """WITH per AS (SELECT l_suppkey AS u, AVG(l_extendedprice) AS m, VAR_SAMP(l_extendedprice) AS v, COUNT(*) AS n FROM lineitem GROUP BY 1),
 s AS (SELECT COUNT(*) AS units, VAR_SAMP(m) AS b, coalesce(AVG(CASE WHEN n>1 THEN v END), 0) AS w FROM per)
 SELECT units, round(b/(b+w), 9) AS icc FROM s""")
def icc_price_by_supplier(spark, sf):
    return red.icc(views.crossed_rows(spark, sf), BY, "unit", "value").select("units", F.round("icc", 9).alias("icc"))


@query("icc_focus_feature", base(GENE_WELCH, PICKED, FOCUS, """per AS (SELECT unit, AVG(ln(1+value)) AS m, VAR_SAMP(ln(1+value)) AS v, COUNT(*) AS n FROM focus GROUP BY 1),
 s AS (SELECT COUNT(*) AS units, VAR_SAMP(m) AS b, coalesce(AVG(CASE WHEN n>1 THEN v END), 0) AS w FROM per)""") + "SELECT units, round(b/(b+w), 9) AS icc FROM s")
def icc_focus_feature(spark, sf):
    rows = picked_focus(spark, sf).withColumn("x", red.log1p_counts(F.col("value")))
    return red.icc(rows, BY, "unit", "x").select("units", F.round("icc", 9).alias("icc"))


@query("overdispersion_brand", base("""per AS (SELECT gene, SUM(value)/(SELECT COUNT(*) FROM kept) AS m, SUM(value*value)/(SELECT COUNT(*) FROM kept) AS q
 FROM counts JOIN kept USING (cell_id) GROUP BY gene)""") + "SELECT round(AVG((q - m*m)/m), 6) AS overdispersion FROM per WHERE m > 0")
def overdispersion_brand(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    out = red.overdispersion(views.brand_counts(spark, sf), kept, BY)
    return out.select(F.round("overdispersion", 6).alias("overdispersion"))


@query("highly_variable_features", base("""hv AS (SELECT gene, COUNT(*) AS d, SUM(ln(1+value)) AS s1, SUM(ln(1+value)*ln(1+value)) AS s2 FROM counts JOIN cells USING (cell_id) GROUP BY gene),
 hn AS (SELECT COUNT(*) AS n FROM cells)""") + """SELECT gene, round(s2/n - pow(s1/n, 2), 6) AS variance, ROW_NUMBER() OVER (ORDER BY round(s2/n - pow(s1/n, 2), 12) DESC, gene) AS rank
 FROM hv, hn WHERE d >= 0.02*n QUALIFY rank <= 25""")
def highly_variable_features(spark, sf):
    out = red.highly_variable(views.brand_counts(spark, sf), views.order_cells(spark, sf), BY)
    return out.select("gene", F.round("variance", 6).alias("variance"), F.col("rank").cast("long").alias("rank"))


@query("qc_covariates", base("""q AS (SELECT cell_id, COUNT(*) AS n_genes, SUM(CASE WHEN CAST(regexp_extract(gene, '(\\d+)', 1) AS INTEGER) <= 3 THEN value ELSE 0 END) / SUM(value) * 100 AS pct FROM counts GROUP BY 1)""")
 + "SELECT cells.cell_id, coalesce(n_genes, 0) AS n_genes, round(coalesce(pct, 0), 6) AS pct_mt FROM cells LEFT JOIN q USING (cell_id)")
def qc_covariates(spark, sf):
    out = red.qc_covariates(views.brand_counts(spark, sf), views.order_cells(spark, sf), views.brand_features(spark, sf))
    return out.select("cell_id", "n_genes", F.round("pct_mt", 6).alias("pct_mt"))


# --- tests --------------------------------------------------------------------------
ITEM_WELCH = f"""WITH a AS (SELECT MAX(CASE WHEN rn=1 THEN f END) AS ref, MAX(CASE WHEN rn=2 THEN f END) AS alt FROM
 (SELECT l_returnflag AS f, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1) WHERE rn <= 2),
 s AS (SELECT COUNT(*) FILTER (l_returnflag=ref) AS n_ref, COUNT(*) FILTER (l_returnflag=alt) AS n_alt,
 AVG(l_extendedprice) FILTER (l_returnflag=ref) AS m0, AVG(l_extendedprice) FILTER (l_returnflag=alt) AS m1,
 VAR_SAMP(l_extendedprice) FILTER (l_returnflag=ref) AS v0, VAR_SAMP(l_extendedprice) FILTER (l_returnflag=alt) AS v1 FROM lineitem, a),
 w AS (SELECT *, {WELCH_T} FROM s) """


@query("welch_value_by_returnflag", ITEM_WELCH + f"SELECT n_ref, n_alt, round(t, 6) AS t, round(df, 3) AS df, round({welch_p()}, 6) AS p FROM w")
def welch_value_by_returnflag(spark, sf):
    rows = views.crossed_rows(spark, sf)
    kept = red.keep_arms(rows, "flag", red.two_arms(rows, "flag", BY), BY)
    w = inf.welch(kept, BY, F.col("value"))
    return w.select("n_ref", "n_alt", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"))


@query("student_t_tail", f"""WITH g AS (SELECT l_suppkey AS unit, COUNT(*) AS n, AVG(l_discount - 0.05) AS m, VAR_SAMP(l_discount - 0.05) AS v FROM lineitem GROUP BY 1),
 x AS (SELECT unit, n - 1 AS df, m / sqrt(v / n) AS t FROM g) SELECT unit, df, round(t, 6) AS t, round({{P}}, 6) AS p FROM x""".replace("{P}", __import__("plumbline.plans.sqltext", fromlist=["t_p"]).t_p("t", "df")))
def student_t_tail(spark, sf):
    from plumbline.functions.stats import t_pvalue

    d = F.col("l_discount") - 0.05
    g = views.crossed_rows(spark, sf).groupBy(F.col("unit").cast("long").alias("unit")).agg(
        F.count("*").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v")
    )
    x = g.select("unit", (F.col("n") - 1).alias("df"), (F.col("m") / F.sqrt(F.col("v") / F.col("n"))).alias("t"))
    return x.select("unit", "df", F.round("t", 6).alias("t"), F.round(t_pvalue("t", F.col("df").cast("double")), 6).alias("p"))


@query("welch_by_brand", base(GENE_WELCH) + "SELECT gene, n_ref, n_alt, round(t, 6) AS t, round(df, 3) AS df, round(p, 6) AS p FROM gene_tests")
def welch_by_brand(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    w = inf.welch_by_gene(views.brand_counts(spark, sf), kept, BY, red.log1p_counts(F.col("value")))
    return w.select("gene", "n_ref", "n_alt", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"))


@query("welch_by_brand_replicates", base(UNIT_WELCH) + "SELECT gene, n_ref, n_alt, round(t, 6) AS t, round(p, 6) AS p FROM utests")
def welch_by_brand_replicates(spark, sf):
    w = cpm_unit_tests(spark, sf)
    return w.select("gene", "n_ref", "n_alt", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


@query("fdr_bh", base(UNIT_WELCH, fdr_sql("utests", "bh")) + "SELECT gene, round(p, 6) AS p, round(q, 6) AS q FROM q_tests")
def fdr_bh(spark, sf):
    out = inf.fdr(cpm_unit_tests(spark, sf), BY, "bh")
    return out.select("gene", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("fdr_by", base(UNIT_WELCH, fdr_sql("utests", "by")) + "SELECT gene, round(p, 6) AS p, round(q, 6) AS q FROM q_tests")
def fdr_by(spark, sf):
    out = inf.fdr(cpm_unit_tests(spark, sf), BY, "by")
    return out.select("gene", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("fdr_with_missing", """WITH x AS (SELECT l_suppkey AS unit, l_returnflag AS flag, CASE WHEN COUNT(*) % 7 = 0 THEN NULL ELSE round(AVG(l_discount)*AVG(l_tax)*100, 3) END AS p FROM lineitem GROUP BY 1, 2),
 ok AS (SELECT *, COUNT(*) OVER (PARTITION BY flag) AS m, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY p, unit) AS rn FROM x WHERE p IS NOT NULL),
 q AS (SELECT unit, flag, p, least(1.0, MIN(p*m/rn) OVER (PARTITION BY flag ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM ok)
 SELECT x.flag, x.unit, x.p, round(q.q, 6) AS q FROM x LEFT JOIN q ON x.unit=q.unit AND x.flag=q.flag""")
def fdr_with_missing(spark, sf):
    x = views.crossed_rows(spark, sf).groupBy("flag", F.col("unit").cast("long").alias("unit")).agg(
        F.when(F.count("*") % 7 != 0, F.round(F.avg("l_discount") * F.avg("l_tax") * 100, 3)).alias("p")
    )
    return inf.fdr(x, ["flag"]).select("flag", "unit", "p", F.round("q", 6).alias("q"))


@query("top25_features", base(UNIT_WELCH, fdr_sql("utests", "bh")) + """SELECT gene, ROW_NUMBER() OVER (ORDER BY p, gene) AS rank, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS survives
 FROM q_tests QUALIFY rank <= 25""")
def top25_features(spark, sf):
    out = inf.top_genes(inf.fdr(cpm_unit_tests(spark, sf), BY), BY, 0.05)
    return out.select("gene", F.col("rank").cast("long").alias("rank"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "survives")


@query("volcano_points", base(UNIT_WELCH, fdr_sql("utests", "bh")) + """SELECT gene, round((m1-m0)/ln(2), 6) AS log2fc, round(-log10(greatest(q, 1e-300)), 4) AS neg_log10_q, q < 0.05 AS sig,
 gene IN ('Brand#1', 'Brand#7') AS claimed, (SELECT COUNT(*) FROM q_tests WHERE q < 0.05) AS n_sig FROM q_tests
 QUALIFY ROW_NUMBER() OVER (ORDER BY q, p, gene) <= 200 OR claimed""")
def volcano_points(spark, sf):
    tests = inf.fdr(cpm_unit_tests(spark, sf), BY)
    claimed = views.brand_features(spark, sf).filter(F.col("gene").isin("Brand#1", "Brand#7"))
    v = inf.volcano(tests, BY, claimed, 0.05)
    return v.select("gene", F.round("log2fc", 6).alias("log2fc"), F.round("neg_log10_q", 4).alias("neg_log10_q"), "sig", "claimed", "n_sig")


@query("audited_feature", base(GENE_WELCH, PICKED) + "SELECT gene, round(t, 6) AS t FROM gene_t JOIN picked USING (gene)")
def audited_feature(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    w = inf.welch_by_gene(views.brand_counts(spark, sf), kept, BY, red.log1p_counts(F.col("value")))
    return inf.pick_gene(w, BY).select("gene", F.round("t", 6).alias("t"))


@query("most_significant_feature", base(UNIT_WELCH) + "SELECT gene, round(p, 6) AS p FROM utests ORDER BY p, gene LIMIT 1")
def most_significant_feature(spark, sf):
    return inf.most_significant(cpm_unit_tests(spark, sf), BY).select("gene", F.round("p", 6).alias("p"))
