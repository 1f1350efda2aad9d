"""Queries that run whole checks, audits and corpus-wide answer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks import audit as au
from plumbline.checks.base import findings_frame
from plumbline.dataset import Claim, Dataset, Design
from plumbline.operators import association as asc
from plumbline.operators import clustering as clu
from plumbline.operators import inference as inf
from plumbline.operators import nbmodel
from plumbline.operators import reduce as red
from plumbline.operators import scoring as sc
from plumbline.operators import separation as sep
from plumbline.plans import views
from plumbline.plans.associations import ADJUSTED_FIT, NAIVE_FIT, SAMPLES
from plumbline.plans.registry import query
from plumbline.plans.reductions import BY, arms_and_kept
from plumbline.plans.splits import THIN, auc_sql
from plumbline.plans.sqltext import FOCUS, GENE_WELCH, PICKED, UNIT_WELCH, WELCH_T, base, fdr_sql, t_p, welch_p
from plumbline.session import discard, hold, keep, scope, sweep_up

DE = Claim(kind="de")


def order_design(**knobs) -> Design:
    return Design(unit="unit", grouping="region", derived="segment", nuisance=("priority", "status"), knobs=knobs)


def run(spark, sf, check, design, claim=DE, ds=None):
    found = au.run_check(check, ds or views.order_dataset(spark, sf), design, claim, safe=False)
    return findings_frame(spark, [found], "orders")


def num(key, digits=6):
    return F.round(F.col("numbers")[key], digits).alias(key)


def p6(name):
    return F.round(name, 6).alias(name)


UNIT_CPM = """us AS (SELECT unit, arm, gene, SUM(value) AS total FROM counts JOIN kept USING (cell_id) GROUP BY 1, 2, 3),
 uv AS (SELECT unit, arm, gene, ln(1 + total / SUM(total) OVER (PARTITION BY unit, arm) * 1e6) AS v FROM us),
 sp AS (SELECT DISTINCT unit, arm FROM kept),
 fu AS (SELECT sp.unit, sp.arm, coalesce(uv.v, 0) AS v FROM sp CROSS JOIN picked LEFT JOIN uv ON uv.unit=sp.unit AND uv.arm=sp.arm AND uv.gene=picked.gene)"""
REPLICATE = f"""ra AS (SELECT COUNT(*) FILTER (arm='ref') AS n_ref, COUNT(*) FILTER (arm='alt') AS n_alt, AVG(v) FILTER (arm='ref') AS m0, AVG(v) FILTER (arm='alt') AS m1,
  VAR_SAMP(v) FILTER (arm='ref') AS v0, VAR_SAMP(v) FILTER (arm='alt') AS v1 FROM fu), rt AS (SELECT *, {WELCH_T} FROM ra), rp AS (SELECT {welch_p()} AS p FROM rt)"""
ICC = """ic AS (SELECT unit, AVG(ln(1+value)) AS m, VAR_SAMP(ln(1+value)) AS v, COUNT(*) AS n FROM focus GROUP BY 1),
 icv AS (SELECT VAR_SAMP(m) AS b, coalesce(AVG(CASE WHEN n>1 THEN v END), 0) AS w FROM ic)"""


def check1_sql(prefix: str) -> str:
    return prefix + """SELECT CASE WHEN np.p >= 0.05 OR rp.p < 0.05 THEN 'clean' ELSE 'flagged' END AS state, np.gene AS target, round(np.p, 6) AS original, CASE WHEN np.p < 0.05 THEN round(rp.p, 6) END AS corrected,
 (SELECT CAST(COUNT(*) AS DOUBLE) FROM kept) AS n_cells, (SELECT CAST(COUNT(*) AS DOUBLE) FROM sp) AS n_units, CASE WHEN np.p < 0.05 THEN (SELECT round(b/(b+w), 6) FROM icv) END AS icc
 FROM (SELECT gene, p FROM gene_tests JOIN picked USING (gene)) np, rp"""


def check1_rows(df):
    return df.select("state", "target", p6("original"), p6("corrected"), num("n_cells"), num("n_units"), num("icc"))


@query("check1_pseudoreplication", check1_sql(base(GENE_WELCH, PICKED, FOCUS, UNIT_CPM, REPLICATE, ICC)))
def check1_pseudoreplication(spark, sf):
    return check1_rows(run(spark, sf, 1, order_design()))


BY_SEGMENT = base(GENE_WELCH, PICKED, FOCUS, UNIT_CPM, REPLICATE, ICC).replace("region END", "segment END").replace("SELECT region, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, region) AS rn FROM cells GROUP BY region", "SELECT segment, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, segment) AS rn FROM cells GROUP BY segment").replace("CASE WHEN region = ref", "CASE WHEN segment = ref").replace("WHERE region = ref OR region = alt", "WHERE segment = ref OR segment = alt")


@query("check1_crossed_units", check1_sql(BY_SEGMENT))
def check1_crossed_units(spark, sf):
    """Nations occur in both market segments, so samples are (unit, arm) pairs."""
    return check1_rows(run(spark, sf, 1, Design(unit="unit", grouping="segment")))


@query("check1_hard_stop", base() + """SELECT 'hard_stop' AS state, 'region' AS target, CAST(1 AS DOUBLE) AS per_group, true AS unsalvageable, (SELECT CAST(COUNT(*) AS DOUBLE) FROM kept) AS n_cells""")
def check1_hard_stop(spark, sf):
    """With the region itself as the unit every arm holds one replicate."""
    f = run(spark, sf, 1, Design(unit="region", grouping="region"))
    return f.select("state", "target", num("per_group"), "unsalvageable", num("n_cells"))


@query("check1_cell_as_unit", check1_sql(base(GENE_WELCH, PICKED, FOCUS, UNIT_CPM, REPLICATE, ICC)))
def check1_cell_as_unit(spark, sf):
    """The configured unit is the cell; the resolved unit is used instead."""
    return check1_rows(run(spark, sf, 1, order_design(unit="cell_id")))


@query("check1_without_counts", base("lg AS (SELECT cell_id, gene, ln(1+value) AS x FROM counts)", GENE_WELCH, PICKED) + "SELECT CASE WHEN p >= 0.05 THEN 'clean' ELSE 'flag_only' END AS state, gene AS target, round(p, 6) AS original FROM gene_tests JOIN picked USING (gene)")
def check1_without_counts(spark, sf):
    ds = views.order_dataset(spark, sf)
    logged = ds.counts.withColumn("value", F.log1p("value")).withColumn("layer", F.lit("main"))
    f = run(spark, sf, 1, order_design(), ds=Dataset(ds.cells, logged, ds.features))
    return f.select("state", "target", p6("original"))


@query("check1_negative_binomial")
def check1_negative_binomial(spark, sf):
    return check1_rows(run(spark, sf, 1, order_design(engine="nb", gene="Brand#12"))).withColumn("asked", F.lit("nb"))


def check4_sql(tech: str) -> str:
    swap = lambda s: s.replace("priority", tech)
    return base(GENE_WELCH, PICKED, FOCUS, swap(SAMPLES), NAIVE_FIT, swap(ADJUSTED_FIT), f"""vg AS (SELECT arm AS a, {tech} AS b, COUNT(*) AS n FROM kept GROUP BY ALL),
 vr AS (SELECT a, SUM(n) AS ra FROM vg GROUP BY 1), vc AS (SELECT b, SUM(n) AS cb FROM vg GROUP BY 1),
 v2 AS (SELECT sqrt(greatest(SUM(n*n/(ra*CAST(cb AS DOUBLE))) - 1, 0)) AS v FROM vg JOIN vr USING (a) JOIN vc USING (b))""")


@query("check4_confounding_separable", check4_sql("batch") + f"SELECT 'flagged' AS state, 'batch' AS target, round((SELECT {t_p('t', 'df')} FROM nt), 6) AS original, round((SELECT {t_p('t', 'df')} FROM adt), 6) AS corrected, false AS unsalvageable, round(v, 6) AS v FROM v2")
def check4_confounding_separable(spark, sf):
    f = run(spark, sf, 4, order_design(nuisance=["priority", "batch"]))
    return f.select("state", "target", p6("original"), p6("corrected"), "unsalvageable", num("v"))


@query("check4_confounding_nested", base("n AS (SELECT 1.0 AS v)") + "SELECT 'flagged' AS state, 'unit' AS target, CAST(NULL AS DOUBLE) AS corrected, true AS unsalvageable, CAST(v AS DOUBLE) AS v FROM n")
def check4_confounding_nested(spark, sf):
    f = run(spark, sf, 4, order_design(nuisance=["unit"]))
    return f.select("state", "target", "corrected", "unsalvageable", num("v"))


@query("check4_confounding_clean", base("""g AS (SELECT region AS a, priority AS b, COUNT(*) AS n FROM cells GROUP BY ALL), r AS (SELECT a, SUM(n) AS ra FROM g GROUP BY 1), c AS (SELECT b, SUM(n) AS cb FROM g GROUP BY 1),
 g2 AS (SELECT region AS a, status AS b, COUNT(*) AS n FROM cells GROUP BY ALL), r2 AS (SELECT a, SUM(n) AS ra FROM g2 GROUP BY 1), c2 AS (SELECT b, SUM(n) AS cb FROM g2 GROUP BY 1),
 vs AS (SELECT 0 AS pos, 'priority' AS target, sqrt((SUM(n*n/(ra*CAST(cb AS DOUBLE)))-1)/4) AS v FROM g JOIN r USING (a) JOIN c USING (b) UNION ALL SELECT 1, 'status', sqrt((SUM(n*n/(ra*CAST(cb AS DOUBLE)))-1)/2) FROM g2 JOIN r2 USING (a) JOIN c2 USING (b))""")
 + "SELECT 'clean' AS state, target, round(v, 6) AS v FROM vs ORDER BY round(v, 12) DESC, pos LIMIT 1")
def check4_confounding_clean(spark, sf):
    return run(spark, sf, 4, order_design()).select("state", "target", num("v"))


@query("check5_multiple_testing", base(UNIT_WELCH, fdr_sql("utests", "bh")) + """SELECT CASE WHEN COUNT(*) < 20 THEN 'clean' ELSE 'flagged' END AS state, CAST(COUNT(*) FILTER (p < 0.05) AS DOUBLE) AS original, CAST(COUNT(*) FILTER (q < 0.05) AS DOUBLE) AS corrected,
 CAST(COUNT(*) AS DOUBLE) AS tests FROM q_tests""")
def check5_multiple_testing(spark, sf):
    return run(spark, sf, 5, order_design()).select("state", "original", "corrected", num("tests"))


@query("check5_already_adjusted", base(UNIT_WELCH, fdr_sql("utests", "by")) + """SELECT 'clean' AS state, 'fdr' AS target, CAST(COUNT(*) FILTER (p < 0.05) AS DOUBLE) AS raw_hits, CAST(COUNT(*) FILTER (q < 0.05) AS DOUBLE) AS adjusted_hits FROM q_tests""")
def check5_already_adjusted(spark, sf):
    f = run(spark, sf, 5, order_design(method="by", pAdjust="fdr"))
    return f.select("state", "target", num("raw_hits"), num("adjusted_hits"))


V_ALL = """g6 AS (SELECT region AS a, batch AS b, COUNT(*) AS n FROM cells GROUP BY ALL), r6 AS (SELECT a, SUM(n) AS ra FROM g6 GROUP BY 1), c6 AS (SELECT b, SUM(n) AS cb FROM g6 GROUP BY 1),
 v6 AS (SELECT sqrt(greatest(SUM(n*n/(ra*CAST(cb AS DOUBLE))) - 1, 0)/(least(COUNT(DISTINCT a), COUNT(DISTINCT b))-1)) AS v FROM g6 JOIN r6 USING (a) JOIN c6 USING (b))"""


@query("check6_unmodeled_covariate", check4_sql("batch").rstrip() + ",\n" + V_ALL + f"\nSELECT 'flagged' AS state, 'batch' AS target, round((SELECT {t_p('t', 'df')} FROM nt), 6) AS original, round((SELECT {t_p('t', 'df')} FROM adt), 6) AS corrected, round(v, 6) AS v FROM v6")
def check6_unmodeled_covariate(spark, sf):
    f = run(spark, sf, 6, order_design(covariate="batch"))
    return f.select("state", "target", p6("original"), p6("corrected"), num("v"))


@query("check6_covariate_negligible", base("g AS (SELECT region AS a, priority AS b, COUNT(*) AS n FROM cells GROUP BY ALL)", "r AS (SELECT a, SUM(n) AS ra FROM g GROUP BY 1)", "c AS (SELECT b, SUM(n) AS cb FROM g GROUP BY 1)") + "SELECT 'clean' AS state, 'priority' AS target, round(sqrt((SUM(n*n/(ra*CAST(cb AS DOUBLE)))-1)/4), 6) AS v FROM g JOIN r USING (a) JOIN c USING (b)")
def check6_covariate_negligible(spark, sf):
    return run(spark, sf, 6, order_design(covariate="priority")).select("state", "target", num("v"))


RAW = base(GENE_WELCH.replace("ln(1 + value)", "value"), PICKED, UNIT_CPM, REPLICATE, """od AS (SELECT gene, SUM(value)/(SELECT COUNT(*) FROM kept) AS m, SUM(value*value)/(SELECT COUNT(*) FROM kept) AS q FROM counts JOIN kept USING (cell_id) GROUP BY gene)""")


@query("check8_test_assumptions", RAW + "SELECT 'flagged' AS state, np.gene AS target, round(np.p, 6) AS original, round(rp.p, 6) AS corrected, (SELECT round(AVG((q-m*m)/m), 6) FROM od) AS overdispersion FROM (SELECT gene, p FROM gene_tests JOIN picked USING (gene)) np, rp")
def check8_test_assumptions(spark, sf):
    f = run(spark, sf, 8, order_design(claimedTest="ttest"))
    return f.select("state", "target", p6("original"), p6("corrected"), num("overdispersion"))


@query("check2_double_dipping")
def check2_double_dipping(spark, sf):
    f = run(spark, sf, 2, order_design(grouping="segment", target_group="BUILDING"), Claim(kind="marker"))
    return f.select("state", "target", "original", "corrected", "engine", F.explode("groups.markers").alias("m")).select("*", "m.*").drop("m")


@query("check3_fragility")
def check3_fragility(spark, sf):
    emb = views.embedding(spark, sf)
    ds = Dataset(emb.select("cell_id", F.col("label").cast("string").alias("state")), embedding=emb)
    f = run(spark, sf, 3, Design(derived="state", knobs={"track": "3"}), Claim(kind="cluster"), ds)
    return f.select("state", "target", "original", "engine", F.explode("fragility.steps").alias("s")).select("*", "s.r", "s.present", "s.clusters").drop("s")


@query("check3_whole_clustering")
def check3_whole_clustering(spark, sf):
    emb = views.embedding(spark, sf)
    ds = Dataset(emb.select("cell_id", "label"), embedding=emb)
    return run(spark, sf, 3, Design(), Claim(kind="cluster"), ds).select("state", "original", "corrected", "engine")


@query("check7_resolution_choice")
def check7_resolution_choice(spark, sf):
    emb = views.embedding(spark, sf)
    ds = Dataset(emb.select("cell_id", "label"), embedding=emb)
    f = run(spark, sf, 7, Design(knobs={"chosen": 0.4}), Claim(kind="cluster"), ds)
    return f.select("state", "original", "corrected", "engine", num("supported_lo"), num("supported_hi"), num("best"))


@query("check7_resolution_by_ari")
def check7_resolution_by_ari(spark, sf):
    emb = views.embedding(spark, sf)
    ds = Dataset(emb.select("cell_id", "label"), embedding=emb)
    f = run(spark, sf, 7, Design(knobs={"criterion": "ari"}), Claim(kind="cluster"), ds)
    return f.select("state", "original", "corrected", num("supported_lo"), num("supported_hi"))


# --- audits --------------------------------------------------------------------------
def audited(spark, sf):
    """All eight checks under resolved roles: each speaks to a claim of its own kind, on the orders' states."""
    c = views.order_cells(spark, sf)
    cells = c.select(
        "cell_id", F.col("unit").alias("donor_id"), F.col("region").alias("condition"), F.col("batch"), F.col("segment").alias("leiden"), F.col("price").alias("total_counts")
    )
    ds = Dataset(cells, views.brand_counts(spark, sf), views.brand_features(spark, sf))
    _, findings = au.audit(ds, "cell_id", {"target_group": "BUILDING", "track": "BUILDING", "config": {8: {"claimedTest": "ttest"}}})
    return findings_frame(spark, findings, "orders")


@query("full_audit")
def full_audit(spark, sf):
    f = au.with_provenance(audited(spark, sf))
    return f.select("check_id", "state", "original", "corrected", "engine", "target", F.col("nonce").isNotNull().alias("stamped"))


@query("audit_report")
def audit_report(spark, sf):
    return sc.assemble_report(audited(spark, sf), ["case_id"])


@query("audit_previews")
def audit_previews(spark, sf):
    return au.preview(audited(spark, sf))


@query("audit_recommendations")
def audit_recommendations(spark, sf):
    return au.recommend(audited(spark, sf))


@query("applicable_checks", """WITH k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'de' WHEN 'view' THEN 'marker' WHEN 'error' THEN 'cluster' ELSE 'unknown' END AS kind FROM events),
 m AS (SELECT * FROM (VALUES ('de',1),('de',4),('de',5),('de',6),('de',8),('marker',2),('cluster',3),('cluster',7),('unknown',1),('unknown',2),('unknown',3),('unknown',4)) v(kind, check_id))
 SELECT kind, CAST(check_id AS INTEGER) AS check_id, COUNT(*) AS n FROM k JOIN m USING (kind) GROUP BY 1, 2""")
def applicable_checks(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "click", F.lit("de")).when(t == "view", F.lit("marker")).when(t == "error", F.lit("cluster")).otherwise(F.lit("unknown"))
    claims = views.table(spark, sf, "events").select("event_id", kind.alias("kind"))
    roles = {"unit": ["unit"], "grouping": ["region"], "nuisance": ["priority"], "derived": ["segment"]}
    return au.applicable(claims, roles).groupBy("kind", "check_id").agg(F.count("*").alias("n"))


# --- models ---------------------------------------------------------------------------
@query("negative_binomial_wald")
def negative_binomial_wald(spark, sf):
    _, _, kept = arms_and_kept(spark, sf)
    totals = red.pseudobulk(views.brand_counts(spark, sf), kept, [*BY, "unit", "arm"])
    samples = red.sample_table(kept, [*BY, "unit", "arm"])
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    return nbmodel.nb_wald(totals, samples, BY, ["unit", "arm"], [F.lit(1.0), alt]).drop("case_id")


@query("multi_factor_survival")
def multi_factor_survival(spark, sf):
    """~ region + priority on (unit, arm, priority) samples: does any feature survive?"""
    _, _, kept = arms_and_kept(spark, sf)
    keys = ["unit", "arm", "priority"]
    totals = red.pseudobulk(views.brand_counts(spark, sf), kept, [*BY, *keys])
    samples = hold(red.sample_table(kept, [*BY, *keys]))
    levels = inf.factor_levels(samples, "priority")
    runnable = samples.count() >= 4 and len(levels) >= 2
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    design = [F.lit(1.0), alt, *inf.dummies("priority", levels)]
    fit = inf.fdr(nbmodel.nb_wald(totals, samples, BY, keys, design), BY)
    return fit.agg(
        F.when(F.lit(runnable), F.bool_or(F.col("q") < 0.05)).alias("survives"), F.count("p").alias("tests"), F.min("q").alias("best_q")
    )


@query("focus_feature_call")
def focus_feature_call(spark, sf):
    """One feature end to end: samples of at least 10 cells, NB test, adjusted call."""
    _, _, kept = arms_and_kept(spark, sf)
    keys = [*BY, "unit", "arm"]
    samples = hold(red.sample_table(kept, keys).filter("n_cells >= 10"))
    arms = red.arm_sizes(samples, BY).first()
    if arms is None or min(arms["n_ref"], arms["n_alt"]) < 2:
        return samples.limit(0).select(F.lit("hard_stop").alias("state"))
    totals = red.pseudobulk(views.brand_counts(spark, sf), kept, keys).join(samples.select(*keys), keys, "left_semi")
    alt = F.when(F.col("arm") == "alt", 1.0).otherwise(0.0)
    fit = inf.fdr(nbmodel.nb_wald(totals, samples, BY, ["unit", "arm"], [F.lit(1.0), alt]), BY)
    return fit.filter(F.col("gene") == "Brand#12").select("gene", "log2fc", "p", "q", (F.col("q") < 0.05).alias("significant"), "engine")


# --- corpus-wide keys: one case per market segment, all in one job -----------------------
CASE = ["segment"]
CASES_SQL = f"""sizes5 AS (SELECT segment, COUNT(*) FILTER (arm='ref') AS n_ref, COUNT(*) FILTER (arm='alt') AS n_alt FROM kept GROUP BY 1),
 g5 AS (SELECT segment, gene, SUM(CASE WHEN arm='ref' THEN x ELSE 0 END) AS a1, SUM(CASE WHEN arm='ref' THEN x*x ELSE 0 END) AS a2, SUM(CASE WHEN arm='alt' THEN x ELSE 0 END) AS b1, SUM(CASE WHEN arm='alt' THEN x*x ELSE 0 END) AS b2
  FROM (SELECT segment, gene, arm, ln(1+value) AS x FROM counts JOIN kept USING (cell_id)) GROUP BY 1, 2),
 s5 AS (SELECT segment, gene, n_ref, n_alt, a1/n_ref AS m0, b1/n_alt AS m1, greatest((a2-a1*a1/n_ref)/(n_ref-1), 0) AS v0, greatest((b2-b1*b1/n_alt)/(n_alt-1), 0) AS v1 FROM g5 JOIN sizes5 USING (segment)),
 t5 AS (SELECT *, {WELCH_T} FROM s5), pk5 AS (SELECT * FROM t5 QUALIFY ROW_NUMBER() OVER (PARTITION BY segment ORDER BY round(abs(t), 10) DESC, gene) = 1),
 np5 AS (SELECT segment, gene, {welch_p()} AS cell_p FROM pk5),
 us5 AS (SELECT segment, unit, arm, gene, SUM(value) AS total FROM counts JOIN kept USING (cell_id) GROUP BY ALL),
 uv5 AS (SELECT segment, unit, arm, gene, ln(1 + total/SUM(total) OVER (PARTITION BY segment, unit, arm)*1e6) AS v FROM us5),
 fu5 AS (SELECT sp.segment, sp.unit, sp.arm, coalesce(uv5.v, 0) AS v FROM (SELECT DISTINCT segment, unit, arm FROM kept) sp JOIN pk5 USING (segment) LEFT JOIN uv5 ON uv5.segment=sp.segment AND uv5.unit=sp.unit AND uv5.arm=sp.arm AND uv5.gene=pk5.gene),
 ra5 AS (SELECT segment, COUNT(*) FILTER (arm='ref') AS n_ref, COUNT(*) FILTER (arm='alt') AS n_alt, AVG(v) FILTER (arm='ref') AS m0, AVG(v) FILTER (arm='alt') AS m1, VAR_SAMP(v) FILTER (arm='ref') AS v0, VAR_SAMP(v) FILTER (arm='alt') AS v1 FROM fu5 GROUP BY 1),
 rt5 AS (SELECT *, {WELCH_T} FROM ra5), up5 AS (SELECT segment, {welch_p()} AS unit_p FROM rt5),
 fo5 AS (SELECT k.segment, k.unit, ln(1+coalesce(c.value, 0)) AS x FROM kept k JOIN pk5 USING (segment) LEFT JOIN counts c ON c.cell_id=k.cell_id AND c.gene=pk5.gene),
 ic5 AS (SELECT segment, VAR_SAMP(m)/(VAR_SAMP(m)+AVG(v)) AS icc FROM (SELECT segment, unit, AVG(x) AS m, VAR_SAMP(x) AS v FROM fo5 GROUP BY 1, 2) GROUP BY 1),
 vg5 AS (SELECT segment, arm AS a, batch AS b, COUNT(*) AS n FROM kept GROUP BY ALL), vr5 AS (SELECT segment, a, SUM(n) AS ra FROM vg5 GROUP BY ALL), vc5 AS (SELECT segment, b, SUM(n) AS cb FROM vg5 GROUP BY ALL),
 v5 AS (SELECT segment, sqrt(greatest(SUM(n*n/(ra*CAST(cb AS DOUBLE))) - 1, 0)) AS v FROM vg5 JOIN vr5 USING (segment, a) JOIN vc5 USING (segment, b) GROUP BY 1)"""


def case_statistics(spark, sf, counts=None):
    """Naive and replicate p, ICC and V of every case from one pass over the counts, and one over those of the picked features."""
    counts = views.brand_counts(spark, sf) if counts is None else counts
    _, _, kept = arms_and_kept(spark, sf)
    kept = keep(kept.select(*CASE, "cell_id", "unit", "arm", "batch"), "kept")
    moments = keep(red.sample_moments(counts, kept, CASE), "moments")
    sweep_up(spark)
    sizes = red.arm_sizes(kept, CASE)
    picked = hold(inf.pick_gene(inf.welch_from_moments(moments, sizes, CASE), CASE))
    naive = picked.select(*CASE, "gene", F.col("p").alias("cell_p"))
    cpm = red.moments_cpm(moments, CASE).join(picked.select(*CASE, "gene"), [*CASE, "gene"])
    unit = inf.welch_by_gene_units(cpm, kept, CASE).select(*CASE, F.col("p").alias("unit_p"))
    few = counts.join(picked.select("gene").distinct(), "gene", "left_semi")
    focus = red.focus_values(few, kept.join(picked.select(*CASE, "gene"), CASE), CASE)
    icc = red.icc(focus.withColumn("x", red.log1p_counts(F.col("value"))), CASE, "unit", "x").select(*CASE, "icc")
    v = asc.cramers_v(kept, CASE, "arm", "batch").select(*CASE, "v")
    return naive.join(unit, CASE).join(icc, CASE).join(v, CASE)


@query("answer_key", base(CASES_SQL) + """SELECT segment, gene, round(cell_p, 6) AS cell_p, round(unit_p, 6) AS unit_p, round(icc, 6) AS icc, round(v, 6) AS v,
 CASE WHEN cell_p < 0.05 AND unit_p >= 0.05 THEN 'flagged' ELSE 'clean' END AS check1, CASE WHEN v >= 0.5 THEN 'flagged' ELSE 'clean' END AS check4 FROM np5 JOIN up5 USING (segment) JOIN ic5 USING (segment) JOIN v5 USING (segment)""")
def answer_key(spark, sf):
    s = case_statistics(spark, sf)
    return s.select(
        "segment", "gene", *[p6(c) for c in ("cell_p", "unit_p", "icc", "v")],
        F.when((F.col("cell_p") < 0.05) & (F.col("unit_p") >= 0.05), F.lit("flagged")).otherwise(F.lit("clean")).alias("check1"),
        F.when(F.col("v") >= 0.5, F.lit("flagged")).otherwise(F.lit("clean")).alias("check4"),
    )


LABELS_SQL = CASES_SQL + ",\n" + THIN + f""",
 me AS (SELECT segment, cell_id, status = 'F' AS member FROM cells),
 tr5 AS (SELECT m.segment, t.cell_id, t.gene, m.member, ln(1+t.train) AS d, ln(1+t.n-t.train) AS h FROM thin t JOIN me m USING (cell_id)),
 nn5 AS (SELECT segment, COUNT(*) FILTER (member) AS n1, COUNT(*) FILTER (NOT member) AS n0 FROM me GROUP BY 1),
 df5 AS (SELECT segment, gene, SUM(CASE WHEN member THEN d ELSE 0 END)/ANY_VALUE(n1) - SUM(CASE WHEN member THEN 0 ELSE d END)/ANY_VALUE(n0) AS diff FROM tr5 JOIN nn5 USING (segment) GROUP BY 1, 2),
 tk5 AS (SELECT segment, gene FROM df5 QUALIFY ROW_NUMBER() OVER (PARTITION BY segment ORDER BY round(diff, 10) DESC, gene) <= 4),
 sc5 AS (SELECT m.segment, m.cell_id, m.member, round(coalesce(SUM(0.25*h), 0), 10) AS sh FROM me m LEFT JOIN (SELECT tr5.* FROM tr5 JOIN tk5 USING (segment, gene)) x ON x.cell_id=m.cell_id GROUP BY 1, 2, 3),
 ho5 AS ({auc_sql('sc5', 'segment', 'sh')})"""


@query("case_truth", base(LABELS_SQL) + """SELECT segment, round(auc, 6) AS hold_auc, cell_p < 0.05 AND unit_p >= 0.05 AS pseudoreplication, auc <= 0.6 AS double_dipping, v >= 0.8 AS confounding
 FROM np5 JOIN up5 USING (segment) JOIN v5 USING (segment) JOIN ho5 USING (segment)""")
def case_truth(spark, sf):
    """The truth booleans of every case that need no clustering."""
    aucs, _ = case_members(spark, sf)
    stats = case_statistics(spark, sf).join(aucs, CASE).withColumn("stability", F.lit(None).cast("double"))
    return sc.label_truth(stats).select("segment", p6("hold_auc"), "pseudoreplication", "double_dipping", "confounding")


def case_members(spark, sf, counts=None):
    """Held-out AUC of the finished orders' markers per case, and the cells that say which are finished."""
    counts = views.brand_counts(spark, sf) if counts is None else counts
    cells = views.order_cells(spark, sf).withColumn("member", F.col("status") == "F")
    cells = keep(cells.select("cell_id", *CASE, "member"), "members")
    thinned = keep(sep.thin(counts.drop("layer"), 0.5, 0).select("cell_id", "gene", "train", "test"), "thinned")
    aucs = keep(sep.mean_score_auc(thinned, cells, CASE).select(*CASE, "hold_auc"), "aucs")
    discard(thinned)
    return aucs, cells


@query("truth_labels")
def truth_labels(spark, sf):
    """The four truth booleans of every case; stability from a seeded sweep of the orders' components over the whole grid.

    Each step ends in a small written table, so that what it shuffled can be deleted before the next begins.
    """
    counts = keep(views.brand_counts(spark, sf), "counts")  # read by every step below
    sweep_up(spark)
    with scope():
        aucs, cells = case_members(spark, sf, counts)
    sweep_up(spark)
    with scope():
        stats = keep(case_statistics(spark, sf, counts), "statistics")
    sweep_up(spark)
    emb = clu.embed(counts, cells.select("cell_id"))
    labels, _ = clu.sweep(emb, clu.resolutions(0.2, 2.0, 0.2), 0)
    tracked = labels.select("cell_id", "labels").join(cells.select("cell_id", *CASE, F.col("member").alias("tracked")), "cell_id")
    stab = keep(clu.stability(clu.presence(tracked, CASE), CASE).select(*CASE, "stability", "settings"), "stability")
    stats = stats.join(aucs, CASE).join(stab, CASE)
    return sc.label_truth(stats).select("segment", p6("hold_auc"), p6("stability"), "settings", *sc.ERROR_CLASSES)
