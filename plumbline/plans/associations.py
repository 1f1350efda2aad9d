"""Queries over contingency grids, design separability and least-squares fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.dataset import case_key
from plumbline.operators import association as asc
from plumbline.operators import inference as inf
from plumbline.operators import reduce as red
from plumbline.plans import views
from plumbline.plans.reductions import BY, arms_and_kept, picked_focus
from plumbline.plans.registry import query
from plumbline.plans.sqltext import FOCUS, GENE_WELCH, PICKED, base, t_p
from plumbline.session import hold

TECHNICAL = ["priority", "status", "segment", "unit"]
V_STACK = """tech AS (
  SELECT region AS a, 0 AS pos, 'priority' AS col, priority AS b FROM cells UNION ALL SELECT region, 1, 'status', status FROM cells
  UNION ALL SELECT region, 2, 'segment', segment FROM cells UNION ALL SELECT region, 3, 'unit', unit FROM cells),
 grid AS (SELECT pos, col, a, b, COUNT(*) AS n FROM tech GROUP BY ALL),
 r AS (SELECT pos, a, SUM(n) AS ra, COUNT(*) AS ua FROM grid GROUP BY ALL), c AS (SELECT pos, b, SUM(n) AS cb, COUNT(*) AS ub FROM grid GROUP BY ALL),
 ag AS (SELECT pos, col, SUM(n) AS n, COUNT(DISTINCT a) AS la, COUNT(DISTINCT b) AS lb, SUM(n*n/(ra*CAST(cb AS DOUBLE))) AS f, MAX(ua) <= 1 OR MAX(ub) <= 1 AS nested
  FROM grid JOIN r USING (pos, a) JOIN c USING (pos, b) GROUP BY ALL),
 vs AS (SELECT pos, col, CAST(n AS BIGINT) AS n, la, lb, greatest(n*(f-1), 0) AS chi2, sqrt(greatest(f-1, 0)/(least(la, lb)-1)) AS v, nested FROM ag)"""


@query("contingency_priority_region", base("g AS (SELECT region, priority, COUNT(*) AS n FROM cells GROUP BY 1, 2)")
 + """SELECT a.region AS a, b.priority AS b, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT region FROM cells) a CROSS JOIN (SELECT DISTINCT priority FROM cells) b
 LEFT JOIN g ON g.region=a.region AND g.priority=b.priority""")
def contingency_priority_region(spark, sf):
    grid = asc.contingency(views.order_cells(spark, sf), BY, "region", "priority")
    return asc.dense_grid(grid, BY).drop("case_id")


@query("contingency_nation_region", base("g AS (SELECT region, unit, COUNT(*) AS n FROM cells GROUP BY 1, 2)")
 + """SELECT a.unit AS a, b.region AS b, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT unit FROM cells) a CROSS JOIN (SELECT DISTINCT region FROM cells) b
 LEFT JOIN g ON g.unit=a.unit AND g.region=b.region""")
def contingency_nation_region(spark, sf):
    grid = asc.contingency(views.order_cells(spark, sf), BY, "unit", "region")
    return asc.dense_grid(grid, BY).drop("case_id")


@query("cramers_v_all_technical", base(V_STACK) + """SELECT col AS "column", n, la AS levels_a, lb AS levels_b, round(chi2, 6) AS chi2, round(v, 9) AS v, nested FROM vs""")
def cramers_v_all_technical(spark, sf):
    s = asc.technical_scores(views.order_cells(spark, sf), BY, "region", TECHNICAL)
    return s.select("column", "n", "levels_a", "levels_b", F.round("chi2", 6).alias("chi2"), F.round("v", 9).alias("v"), "nested")


@query("most_aligned_technical", base(V_STACK) + """SELECT col AS "column", round(v, 9) AS v, nested FROM vs ORDER BY round(v, 12) DESC, pos LIMIT 1""")
def most_aligned_technical(spark, sf):
    s = asc.technical_scores(views.order_cells(spark, sf), BY, "region", TECHNICAL)
    return asc.most_aligned(s, BY).select("column", F.round("v", 9).alias("v"), "nested")


@query("cramers_v_items_by_supplier", """WITH g AS (SELECT l_suppkey AS s, l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY ALL),
 r AS (SELECT s, a, SUM(n) AS ra FROM g GROUP BY ALL), c AS (SELECT s, b, SUM(n) AS cb FROM g GROUP BY ALL)
 SELECT CAST(s AS VARCHAR) AS unit, CAST(SUM(n) AS BIGINT) AS n, round(CASE WHEN least(COUNT(DISTINCT a), COUNT(DISTINCT b)) < 2 THEN 0 ELSE
 sqrt(greatest(SUM(n*n/(ra*CAST(cb AS DOUBLE))) - 1, 0)/(least(COUNT(DISTINCT a), COUNT(DISTINCT b))-1)) END, 9) AS v
 FROM g JOIN r USING (s, a) JOIN c USING (s, b) GROUP BY s""")
def cramers_v_items_by_supplier(spark, sf):
    s = asc.cramers_v(views.crossed_rows(spark, sf), ["unit"], "flag", "linestatus")
    return s.select("unit", "n", F.round("v", 9).alias("v"))


@query("nesting_nation_region", base() + """SELECT (SELECT MAX(k) FROM (SELECT COUNT(DISTINCT region) AS k FROM cells GROUP BY unit)) <= 1
 OR (SELECT MAX(k) FROM (SELECT COUNT(DISTINCT unit) AS k FROM cells GROUP BY region)) <= 1 AS nested""")
def nesting_nation_region(spark, sf):
    return asc.cramers_v(views.order_cells(spark, sf), BY, "unit", "region").select("nested")


RANK_SQL = """edges AS (SELECT DISTINCT 'r' || region AS x, {p} || {f} AS y FROM cells), nodes AS (SELECT x AS n FROM edges UNION SELECT y FROM edges),
 reach AS (SELECT n, n AS m FROM nodes UNION SELECT reach.n, CASE WHEN e.x = reach.m THEN e.y ELSE e.x END FROM reach JOIN edges e ON e.x = reach.m OR e.y = reach.m),
 comp AS (SELECT COUNT(DISTINCT root) AS k FROM (SELECT n, MIN(m) AS root FROM reach GROUP BY n)),
 dims AS (SELECT COUNT(*) AS n FROM nodes)"""


@query("design_rank_region_priority", base(RANK_SQL.format(p="'p'", f="priority")) + """SELECT CAST(n - 1 AS INTEGER) AS columns, CAST(n - k AS INTEGER) AS rank, k > 1 AS rank_deficient FROM dims, comp""")
def design_rank_region_priority(spark, sf):
    return asc.design_rank(views.order_cells(spark, sf), BY, ["region", "priority"]).drop("case_id")


@query("design_rank_region_nation", base(RANK_SQL.format(p="'n'", f="unit")) + """SELECT CAST(n - 1 AS INTEGER) AS columns, CAST(n - k AS INTEGER) AS rank, k > 1 AS rank_deficient FROM dims, comp""")
def design_rank_region_nation(spark, sf):
    return asc.design_rank(views.order_cells(spark, sf), BY, ["region", "unit"]).drop("case_id")


# --- least squares --------------------------------------------------------------------
# Replicate samples of the audited brand: mean log1p CPM per (nation, region, priority).
SAMPLES = """library AS (SELECT cell_id, SUM(value) AS library FROM counts GROUP BY 1),
 samples AS (SELECT unit, arm, priority, AVG(CASE WHEN library > 0 THEN ln(1 + value/library*1e6) ELSE 0 END) AS y
  FROM focus LEFT JOIN library USING (cell_id) GROUP BY 1, 2, 3)"""
NAIVE_FIT = """nfit AS (SELECT COUNT(*) AS n, SUM(x*x) - SUM(x)*SUM(x)/COUNT(*) AS sxx, SUM(x*y) - SUM(x)*SUM(y)/COUNT(*) AS sxy, SUM(y*y) - SUM(y)*SUM(y)/COUNT(*) AS syy
  FROM (SELECT CASE WHEN arm='alt' THEN 1.0 ELSE 0.0 END AS x, y FROM samples)),
 nt AS (SELECT n, n - 2 AS df, sxy/sxx / sqrt((syy - sxy*sxy/sxx)/(n-2)/sxx) AS t FROM nfit)"""
ADJUSTED_FIT = """dm AS (SELECT x - AVG(x) OVER (PARTITION BY priority) AS dx, y - AVG(y) OVER (PARTITION BY priority) AS dy
  FROM (SELECT priority, CASE WHEN arm='alt' THEN 1.0 ELSE 0.0 END AS x, y FROM samples)),
 afit AS (SELECT COUNT(*) AS n, (SELECT COUNT(DISTINCT priority) FROM samples) AS levels, SUM(dx*dx) AS sxx, SUM(dx*dy) AS sxy, SUM(dy*dy) AS syy FROM dm),
 adt AS (SELECT n, levels, n - levels - 1 AS df, sxy/sxx AS beta, sxy/sxx / sqrt((syy - sxy*sxy/sxx)/(n-levels-1)/sxx) AS t FROM afit)"""


def focus_samples(spark, sf, other="priority"):
    counts = views.brand_counts(spark, sf)
    focus = picked_focus(spark, sf)
    deep = red.with_library(focus, counts)
    return inf.sample_means(deep, BY, ["unit", "arm", other], red.log1p_cpm(F.col("value"), F.col("library")))


@query("ols_naive_and_adjusted", base(GENE_WELCH, PICKED, FOCUS, SAMPLES, NAIVE_FIT, ADJUSTED_FIT)
 + f"SELECT nt.n AS n_samples, round((SELECT {t_p('t', 'df')} FROM nt), 6) AS naive_p, round((SELECT {t_p('t', 'df')} FROM adt), 6) AS adjusted_p FROM nt")
def ols_naive_and_adjusted(spark, sf):
    """The adjusted fit here is the general one: every level is a design column."""
    samples = hold(focus_samples(spark, sf))
    levels = inf.factor_levels(samples, "priority")
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    naive = inf.ols_p(samples, BY, F.col("y"), [F.lit(1.0), alt], 1, "naive_p")
    full = inf.ols_p(samples, BY, F.col("y"), [F.lit(1.0), alt, *inf.dummies("priority", levels)], 1, "adjusted_p")
    out = naive.join(full.drop("n_samples"), BY)
    return out.select("n_samples", F.round("naive_p", 6).alias("naive_p"), F.round("adjusted_p", 6).alias("adjusted_p"))


@query("two_factor_replicate_fit", base(GENE_WELCH, PICKED, FOCUS, SAMPLES, NAIVE_FIT, ADJUSTED_FIT)
 + f"SELECT nt.n AS n_samples, round((SELECT {t_p('t', 'df')} FROM nt), 6) AS naive_p, round((SELECT {t_p('t', 'df')} FROM adt), 6) AS adjusted_p FROM nt")
def two_factor_replicate_fit(spark, sf):
    out = inf.two_factor_p(hold(focus_samples(spark, sf)), BY, "priority")
    return out.select("n_samples", F.round("naive_p", 6).alias("naive_p"), F.round("adjusted_p", 6).alias("adjusted_p"))


@query("ols_adjusted_priority", base(GENE_WELCH, PICKED, FOCUS, SAMPLES, ADJUSTED_FIT)
 + f"SELECT n, levels, df AS dof, round(beta, 6) AS beta, round({t_p('t', 'df')}, 6) AS p FROM adt")
def ols_adjusted_priority(spark, sf):
    d = inf.demeaned_p(focus_samples(spark, sf), BY, "priority")
    return d.select("n", "levels", "dof", F.round("beta", 6).alias("beta"), F.round("p", 6).alias("p"))


@query("agreement_with_other_segment", base("""fc AS (SELECT gene, segment, SUM(CASE WHEN arm='alt' THEN x ELSE 0 END) AS b, SUM(CASE WHEN arm='ref' THEN x ELSE 0 END) AS a
  FROM (SELECT gene, segment, arm, ln(1+value) AS x FROM counts JOIN kept USING (cell_id)) GROUP BY 1, 2),
 sz AS (SELECT segment, COUNT(*) FILTER (arm='ref') AS nr, COUNT(*) FILTER (arm='alt') AS na FROM kept GROUP BY 1),
 l AS (SELECT gene, segment, (b/na - a/nr)/ln(2) AS log2fc FROM fc JOIN sz USING (segment)),
 j AS (SELECT x.gene, x.log2fc AS a, y.log2fc AS b FROM l x JOIN l y ON x.gene=y.gene WHERE x.segment='AUTOMOBILE' AND y.segment='BUILDING'),
 rk AS (SELECT *, RANK() OVER (ORDER BY a) AS ra, RANK() OVER (ORDER BY b) AS rb FROM j)""")
 + """SELECT COUNT(*) AS shared, round(corr(ra, rb), 6) AS spearman, round(corr(a, b), 6) AS pearson, round(AVG(CASE WHEN sign(a)=sign(b) THEN 1 ELSE 0 END), 6) AS sign_agreement,
 corr(ra, rb) >= 0.8 AND AVG(CASE WHEN sign(a)=sign(b) THEN 1 ELSE 0 END) >= 0.85 AND COUNT(*) >= 50 AS passed FROM rk""")
def agreement_with_other_segment(spark, sf):
    counts = views.brand_counts(spark, sf)
    _, _, kept = arms_and_kept(spark, sf)
    t = inf.welch_by_gene(counts, kept, ["segment"], red.log1p_counts(F.col("value"))).withColumn("case_id", case_key("x", "gene"))
    a, b = t.filter("segment = 'AUTOMOBILE'"), t.filter("segment = 'BUILDING'")
    out = inf.agreement(a, b, BY)
    return out.select(
        "shared", *[F.round(c, 6).alias(c) for c in ("spearman", "pearson", "sign_agreement")], "passed"
    )


@query("shared_features", base() + """SELECT gene FROM (SELECT DISTINCT gene FROM counts JOIN cells USING (cell_id) WHERE segment='AUTOMOBILE'
 INTERSECT SELECT DISTINCT gene FROM counts JOIN cells USING (cell_id) WHERE segment='BUILDING')""")
def shared_features(spark, sf):
    rows = red.measured(views.brand_counts(spark, sf), views.order_cells(spark, sf), ["segment"])
    a, b = (rows.filter(F.col("segment") == s).select("gene").distinct() for s in ("AUTOMOBILE", "BUILDING"))
    return a.intersect(b)


@query("unit_union", base() + "SELECT DISTINCT unit FROM kept")
def unit_union(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    a, b = (kept.filter(F.col("arm") == s).select("unit") for s in ("ref", "alt"))
    return a.union(b).distinct()
