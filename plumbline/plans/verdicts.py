"""Queries over findings, rulings, truth and answer keys: every supplier is one audited case."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import scoring as sc
from plumbline.plans import views
from plumbline.plans.registry import query

KEY = ["case_id", "check_id"]


def finding_view(spark, sf, status: str | None = None):
    """Four findings per supplier, with evidence numbers taken from its line items."""
    rows = views.crossed_rows(spark, sf)
    if status is not None:
        rows = rows.filter(F.col("linestatus") == status)
    per = rows.groupBy(F.col("unit").cast("long").alias("s")).agg(
        F.count("*").alias("n"),
        F.round(F.abs(F.avg("l_discount") - 0.05) * 40, 6).alias("p"),
        F.round(0.5 + F.abs(F.avg("l_tax") - 0.04) * 100, 6).alias("hold"),
        F.round((F.count("*") % 11) / 10.0, 6).alias("stab"),
        F.round((F.count_if(F.col("flag") == "R") % 13) / 12.0, 6).alias("vv"),
    )
    out = per.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("check_id"))
    c, s, n = F.col("check_id"), F.col("s"), F.col("n")
    state = (
        F.when((s + c) % 17 == 0, F.lit("hard_stop"))
        .when((s + c) % 7 == 0, F.lit("flag_only"))
        .when((n + c) % 3 != 0, F.lit("flagged"))
        .otherwise(F.lit("clean"))
    )
    return out.select(
        F.concat(F.lit("case"), s.cast("string")).alias("case_id"),
        "check_id",
        state.alias("state"),
        "s",
        F.when(c == 1, n % 7).alias("n"),
        F.when(c == 1, F.col("p")).alias("replicate_p"),
        F.when(c == 2, F.round(F.col("hold") + (n % 5) * 0.05, 6)).alias("disc_auc"),
        F.when(c == 2, F.col("hold")).alias("hold_auc"),
        F.when(c == 2, n % 50).alias("heldout_cells"),
        F.when(c == 3, F.col("stab")).alias("stability"),
        F.when(c == 4, F.col("vv")).alias("v"),
        F.when(c == 4, (n % 4 == 0)).alias("separable"),
    )


def findings_sql(where: str = "", name: str = "fi") -> str:
    return f"""{name}_per AS (SELECT l_suppkey AS s, COUNT(*) AS n, round(abs(AVG(l_discount) - 0.05)*40, 6) AS p, round(0.5 + abs(AVG(l_tax) - 0.04)*100, 6) AS hold,
  round((COUNT(*) % 11)/10.0, 6) AS stab, round((COUNT(*) FILTER (l_returnflag='R') % 13)/12.0, 6) AS vv FROM lineitem {where} GROUP BY 1),
 {name} AS (SELECT 'case' || CAST(s AS VARCHAR) AS case_id, CAST(c AS INTEGER) AS check_id, s, CASE WHEN (s+c) % 17 = 0 THEN 'hard_stop' WHEN (s+c) % 7 = 0 THEN 'flag_only' WHEN (n+c) % 3 <> 0 THEN 'flagged' ELSE 'clean' END AS state,
  CASE WHEN c=1 THEN n % 7 END AS n, CASE WHEN c=1 THEN p END AS replicate_p, CASE WHEN c=2 THEN round(hold + (n % 5)*0.05, 6) END AS disc_auc, CASE WHEN c=2 THEN hold END AS hold_auc, CASE WHEN c=2 THEN n % 50 END AS heldout_cells,
  CASE WHEN c=3 THEN CAST(stab AS DOUBLE) END AS stability, CASE WHEN c=4 THEN CAST(vv AS DOUBLE) END AS v, CASE WHEN c=4 THEN n % 4 = 0 END AS separable FROM {name}_per CROSS JOIN range(1, 5) r(c))"""


FI = findings_sql()
RULES = """ru AS (SELECT case_id, check_id, CASE WHEN check_id=1 AND replicate_p < 0.05 THEN 'veto' WHEN check_id=2 AND hold_auc >= 0.62 THEN 'veto' WHEN check_id=2 AND heldout_cells < 20 THEN 'downgrade'
  WHEN check_id=3 AND stability >= 0.8 THEN 'veto' WHEN check_id=4 AND (separable OR v < 0.9) THEN 'veto' ELSE 'confirm' END AS verdict FROM fi WHERE state='flagged'),
 rs AS (SELECT * FROM ru WHERE CAST(substr(case_id, 5) AS BIGINT) % 4 <> 0),
 ga AS (SELECT fi.*, CASE WHEN state='flagged' THEN coalesce(rs.verdict, 'confirm') END AS ruling, state='flagged' AND rs.verdict IS NULL AS unverified,
  CASE WHEN state='flagged' AND coalesce(rs.verdict, '') = 'veto' THEN 'clean' ELSE state END AS effective_state FROM fi LEFT JOIN rs USING (case_id, check_id))"""


def rulings_given(findings):
    """Rulings arrive for three cases in four."""
    r = sc.rule_rulings(findings)
    return r.filter(F.substring("case_id", 5, 20).cast("long") % 4 != 0)


@query("verdict_summary", "WITH " + FI + """, a AS (SELECT case_id, COUNT(*) AS checks, COUNT(*) FILTER (state IN ('flagged','hard_stop')) AS flagged, COUNT(*) FILTER (state='hard_stop') AS hard_stop,
 COUNT(*) FILTER (state='clean') AS clean, COUNT(*) FILTER (state='flag_only') AS need_input FROM fi GROUP BY 1) SELECT *, CASE WHEN flagged=0 AND need_input=0 THEN 'All ' || checks || ' checks are clean.'
 WHEN flagged=0 THEN clean || ' of ' || checks || ' checks are clean; ' || need_input || ' need input.' ELSE flagged || ' of ' || checks || ' checks flagged.' END AS verdict FROM a""")
def verdict_summary(spark, sf):
    return sc.assemble_report(finding_view(spark, sf), ["case_id"])


@query("rule_based_rulings", "WITH " + FI + ", " + RULES + " SELECT * FROM ru")
def rule_based_rulings(spark, sf):
    return sc.rule_rulings(finding_view(spark, sf)).drop("confidence")


@query("second_look_gate", "WITH " + FI + ", " + RULES + " SELECT case_id, check_id, state, effective_state, ruling, unverified FROM ga")
def second_look_gate(spark, sf):
    f = finding_view(spark, sf)
    g = sc.apply_rulings(f, rulings_given(f), KEY)
    return g.select("case_id", "check_id", "state", "effective_state", "ruling", "unverified")


@query("second_look_headlines", "WITH " + FI + ", " + RULES + " SELECT case_id, check_id, CASE WHEN state='flagged' AND effective_state='clean' THEN 'A second look cleared this finding; its numbers are kept as evidence.' ELSE state || ' by check ' || check_id END AS headline, CAST(state='flagged' AND effective_state='flagged' AS BOOLEAN) AS show_bad FROM ga")
def second_look_headlines(spark, sf):
    f = finding_view(spark, sf)
    told = f.withColumn("headline", F.concat_ws(" by check ", "state", F.col("check_id").cast("string")))
    return sc.apply_rulings(told, rulings_given(f), KEY).select("case_id", "check_id", "headline", "show_bad")


@query("evidence_flattening", "WITH " + FI + " SELECT case_id, check_id, key, value FROM (" + " UNION ALL ".join(
    f"SELECT case_id, check_id, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM fi" for c in ("n", "replicate_p", "disc_auc", "hold_auc", "heldout_cells", "stability", "v")
) + ") WHERE value IS NOT NULL")
def evidence_flattening(spark, sf):
    cols = ["n", "replicate_p", "disc_auc", "hold_auc", "heldout_cells", "stability", "v"]
    return sc.flatten_evidence(finding_view(spark, sf), KEY, cols)


EXPECTED = """ex AS (SELECT case_id, check_id, CASE WHEN s % 3 = 0 THEN 'over-fire' WHEN s % 3 = 1 THEN 'genuine' ELSE 'underpowered' END AS kind,
  CASE WHEN s % 3 = 0 THEN 'veto' WHEN s % 3 = 1 THEN 'confirm' ELSE 'downgrade' END AS expected FROM fi WHERE state='flagged'),
 gr AS (SELECT ex.*, ga.effective_state, coalesce(ga.ruling = ex.expected AND NOT ga.unverified, false) AS passed FROM ex LEFT JOIN ga USING (case_id, check_id))"""


def graded(spark, sf):
    f = finding_view(spark, sf)
    r = F.col("s") % 3
    expected = f.filter("state = 'flagged'").select(
        *KEY,
        F.when(r == 0, F.lit("over-fire")).when(r == 1, F.lit("genuine")).otherwise(F.lit("underpowered")).alias("kind"),
        F.when(r == 0, F.lit("veto")).when(r == 1, F.lit("confirm")).otherwise(F.lit("downgrade")).alias("expected"),
    )
    return sc.grade_rulings(sc.apply_rulings(f, rulings_given(f), KEY), expected, KEY)


@query("ruling_acceptance", "WITH " + FI + ", " + RULES + ", " + EXPECTED + " SELECT case_id, check_id, expected, passed FROM gr")
def ruling_acceptance(spark, sf):
    return graded(spark, sf).select("case_id", "check_id", "expected", "passed")


@query("ruling_readiness", "WITH " + FI + ", " + RULES + ", " + EXPECTED + """, q AS (SELECT case_id, COUNT(*) AS rulings, COUNT(*) FILTER (passed) AS passed, COUNT(*) FILTER (kind='over-fire') AS over_fires,
 COUNT(*) FILTER (kind='over-fire' AND effective_state='clean') AS over_clean FROM gr GROUP BY 1) SELECT *, over_fires > 0 AND over_clean = over_fires AS green, over_fires > 0 AND over_clean = over_fires AND passed = rulings AS ready FROM q""")
def ruling_readiness(spark, sf):
    return sc.rulings_ready(graded(spark, sf), ["case_id"])


# --- confusion ------------------------------------------------------------------------
BYC = ["case_id", "error_class"]
CLASSES = "list_value('pseudoreplication','double_dipping','fragility','confounding')"
TRUTH = f"""tr AS (SELECT case_id, {CLASSES}[check_id] AS error_class, CASE WHEN s % 5 = 0 THEN 'clean_control' ELSE 'planted' END AS family, s % 5 <> 0 AND (s + check_id) % 2 = 0 AS present FROM fi),
 de AS (SELECT case_id, {CLASSES}[check_id] AS error_class, state='flagged' AS flag FROM fi), su AS (SELECT case_id, {CLASSES}[check_id] AS error_class, verdict <> 'veto' AS supported FROM rs),
 ve AS (SELECT case_id, error_class, 'raw' AS arm, flag AS detected FROM de UNION ALL SELECT case_id, error_class, 'reviewed', flag AND coalesce(supported, true) FROM de LEFT JOIN su USING (case_id, error_class))"""
BENCH = "WITH " + FI + ", " + RULES + ", " + TRUTH
CONF = """, cm AS (SELECT arm, error_class, COUNT(*) FILTER (present AND detected) AS tp, COUNT(*) FILTER (NOT present AND detected) AS fp, COUNT(*) FILTER (present AND NOT detected) AS fn, COUNT(*) FILTER (NOT present AND NOT detected) AS tn
 FROM tr JOIN ve USING (case_id, error_class) GROUP BY GROUPING SETS ((arm), (arm, error_class)))"""


def bench_tables(spark, sf):
    f = finding_view(spark, sf)
    name = F.element_at(F.array(*[F.lit(c) for c in sc.ERROR_CLASSES]), F.col("check_id"))
    truth = f.select(
        "case_id",
        name.alias("error_class"),
        F.when(F.col("s") % 5 == 0, F.lit("clean_control")).otherwise(F.lit("planted")).alias("family"),
        ((F.col("s") % 5 != 0) & ((F.col("s") + F.col("check_id")) % 2 == 0)).alias("present"),
    )
    detected = f.select("case_id", name.alias("error_class"), (F.col("state") == "flagged").alias("flag"))
    supported = rulings_given(f).select("case_id", name.alias("error_class"), (F.col("verdict") != "veto").alias("supported"))
    return truth, sc.assemble_arms(detected, supported, BYC)


@query("arm_assembly", BENCH + " SELECT * FROM ve")
def arm_assembly(spark, sf):
    return bench_tables(spark, sf)[1]


@query("confusion_rollup", BENCH + CONF + " SELECT * FROM cm")
def confusion_rollup(spark, sf):
    truth, verdicts = bench_tables(spark, sf)
    return sc.confusion(verdicts, truth, BYC)


@query("detection_rates", BENCH + CONF + """, r AS (SELECT arm, error_class, tp/nullif(tp+fn, 0) AS d, fp/nullif(fp+tn, 0) AS f, tp/nullif(tp+fp, 0) AS pr, tn/nullif(fp+tn, 0) AS sp, tp+fn AS pos FROM cm)
 SELECT arm, error_class, round(d, 9) AS detection, round(f, 9) AS fp_rate, round(pr, 9) AS precision, round(sp, 9) AS specificity, round(CASE WHEN pr > 0 AND d > 0 THEN 2*pr*d/(pr+d) WHEN pos > 0 THEN 0 END, 9) AS f1, round(d+sp-1, 9) AS youden_j FROM r""")
def detection_rates(spark, sf):
    truth, verdicts = bench_tables(spark, sf)
    cols = ["detection", "fp_rate", "precision", "specificity", "f1", "youden_j"]
    return sc.rates(sc.confusion(verdicts, truth, BYC)).select("arm", "error_class", *[F.round(c, 9).alias(c) for c in cols])


@query("clean_control_flags", BENCH + """, pc AS (SELECT arm, case_id, COUNT(*) AS pairs, COUNT(*) FILTER (detected) AS flags FROM tr JOIN ve USING (case_id, error_class) WHERE family='clean_control' GROUP BY ALL)
 SELECT arm, COUNT(*) AS cases, COUNT(*) FILTER (flags > 0) AS cases_flagged, round(COUNT(*) FILTER (flags > 0)/COUNT(*), 9) AS case_fp_rate, round(SUM(flags)/SUM(pairs), 9) AS pair_fp_rate FROM pc GROUP BY 1""")
def clean_control_flags(spark, sf):
    truth, verdicts = bench_tables(spark, sf)
    out = sc.clean_control_flags(verdicts, truth, BYC)
    return out.withColumns({c: F.round(c, 9) for c in ("case_fp_rate", "pair_fp_rate")})


@query("confusion_labels_by_length", """WITH a AS (SELECT source, AVG(n_chars) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1), d AS (SELECT source, quality = 1 AS t, n_chars > m AS p FROM documents JOIN labels USING (doc_id) JOIN a USING (source))
 SELECT 'length' AS arm, source AS error_class, COUNT(*) FILTER (t AND p) AS tp, COUNT(*) FILTER (NOT t AND p) AS fp, COUNT(*) FILTER (t AND NOT p) AS fn, COUNT(*) FILTER (NOT t AND NOT p) AS tn FROM d GROUP BY GROUPING SETS ((), (source))""")
def confusion_labels_by_length(spark, sf):
    d = views.document_labels(spark, sf)
    means = d.groupBy("source").agg(F.avg("n_chars").alias("m"))
    rows = d.join(means, "source").withColumn("error_class", F.col("source"))
    truth = rows.select("doc_id", "error_class", (F.col("quality") == 1).alias("present"))
    verdicts = rows.select("doc_id", "error_class", F.lit("length").alias("arm"), (F.col("n_chars") > F.col("m")).alias("detected"))
    return sc.confusion(verdicts, truth, ["doc_id", "error_class"])


# --- reconciliation -------------------------------------------------------------------
NEAR = findings_sql("WHERE l_linestatus='O'", "k0")
CMP = """cj AS (SELECT coalesce(o.case_id, k.case_id) AS case_id, coalesce(o.check_id, k.check_id) AS check_id, o.state AS os, k.state AS ks, o.n AS o_n, k.n AS kn, o.replicate_p AS op, k.replicate_p AS kp, o.disc_auc AS od, k.disc_auc AS kd,
  o.hold_auc AS oh, k.hold_auc AS kh, o.stability AS ost, k.stability AS kst, o.v AS ov, k.v AS kv FROM fi o FULL JOIN (SELECT * FROM k0 WHERE s % 10 <> 3) k ON o.case_id=k.case_id AND o.check_id=k.check_id),
 ct AS (SELECT case_id, check_id, os IS NOT NULL AND ks IS NOT NULL AS present, list_filter([
  CASE WHEN ks IS NOT NULL THEN coalesce(os=ks, false) END, CASE WHEN check_id=1 AND kn IS NOT NULL THEN coalesce(o_n=kn, false) END,
  CASE WHEN check_id=1 AND os NOT IN ('flag_only','hard_stop') AND op IS NOT NULL AND kp IS NOT NULL THEN (op<0.05)=(kp<0.05) AND (NOT (op>=0.05 AND kp>=0.05) OR abs(log10(greatest(op,1e-300))-log10(greatest(kp,1e-300)))<=0.5) END,
  CASE WHEN check_id=2 AND oh IS NOT NULL AND kh IS NOT NULL THEN abs(oh-kh) <= 0.06+1e-12 END, CASE WHEN check_id=2 AND oh IS NOT NULL AND kh IS NOT NULL AND od IS NOT NULL AND kd IS NOT NULL THEN (od>=oh)=(kd>=kh) END,
  CASE WHEN check_id=3 AND ost IS NOT NULL AND kst IS NOT NULL THEN abs(ost-kst) <= 0.06+1e-12 END, CASE WHEN check_id=4 AND ov IS NOT NULL AND kv IS NOT NULL THEN abs(ov-kv) <= 0.03+1e-12 END], lambda x: x IS NOT NULL) AS made FROM cj),
 cc AS (SELECT case_id, check_id, CAST(len(made) AS INTEGER) AS compared, present AND len(made) > 0 AND NOT list_contains(made, false) AS matches FROM ct)"""


def compared(spark, sf):
    ours = finding_view(spark, sf).withColumnRenamed("replicate_p", "p")
    key = finding_view(spark, sf, "O").withColumnRenamed("replicate_p", "p").filter(F.col("s") % 10 != 3)
    return sc.compare(ours, key)


@query("numeric_comparator", "WITH " + FI + ", " + NEAR + ", " + CMP + " SELECT * FROM cc")
def numeric_comparator(spark, sf):
    return compared(spark, sf)


@query("numeric_comparator_cases", "WITH " + FI + ", " + NEAR + ", " + CMP + " SELECT case_id, COUNT(*) AS checks, COUNT(*) FILTER (matches) AS matched, COUNT(*) >= 4 AND COUNT(*) FILTER (matches) = COUNT(*) AS passed FROM cc GROUP BY 1")
def numeric_comparator_cases(spark, sf):
    return sc.compare_cases(compared(spark, sf))


@query("three_way_agreement", """WITH b AS (SELECT l_suppkey AS s, l_returnflag AS f, CASE l_returnflag WHEN 'A' THEN 'auc' WHEN 'N' THEN 'p' ELSE 'frac' END AS category, round(AVG(l_discount), 9) AS x, round(AVG(l_discount), 2) AS y, round(AVG(l_discount) FILTER (l_linestatus='O'), 9) AS z, COUNT(*) AS n FROM lineitem GROUP BY ALL),
 t AS (SELECT s, f, category, x AS a, CASE WHEN n % 9 = 0 THEN NULL ELSE y END AS b, z AS c, CASE category WHEN 'auc' THEN 0.03 WHEN 'p' THEN 0.001 ELSE 0.05 END AS tol FROM b),
 g AS (SELECT *, abs(a-b) <= tol+1e-12 OR (category='p' AND abs(log10(greatest(a,1e-300))-log10(greatest(b,1e-300))) <= 0.5) AS ab, abs(b-c) <= tol+1e-12 OR (category='p' AND abs(log10(greatest(b,1e-300))-log10(greatest(c,1e-300))) <= 0.5) AS bc,
  abs(a-c) <= tol+1e-12 OR (category='p' AND abs(log10(greatest(a,1e-300))-log10(greatest(c,1e-300))) <= 0.5) AS ac FROM t)
 SELECT CAST(s AS VARCHAR) AS unit, f AS flag, category, a, b, c, coalesce(ab, a IS NULL AND b IS NULL) AND coalesce(bc, b IS NULL AND c IS NULL) AND coalesce(ac, a IS NULL AND c IS NULL) AS agree FROM g""")
def three_way_agreement(spark, sf):
    rows = views.crossed_rows(spark, sf)
    f = F.col("flag")
    per = rows.groupBy("unit", "flag").agg(
        F.round(F.avg("l_discount"), 9).alias("x"),
        F.round(F.avg("l_discount"), 2).alias("y"),
        F.round(F.avg(F.when(F.col("linestatus") == "O", F.col("l_discount"))), 9).alias("z"),
        F.count("*").alias("n"),
    ).withColumn("category", F.when(f == "A", F.lit("auc")).when(f == "N", F.lit("p")).otherwise(F.lit("frac")))
    by = ["unit", "flag"]
    a = per.select(*by, "category", F.col("x").alias("value"))
    b = per.select(*by, F.when(F.col("n") % 9 != 0, F.col("y")).alias("value"))
    return sc.three_way(a, b, per.select(*by, F.col("z").alias("value")), by)


CASES = """ca AS (SELECT 'case' || CAST(s_suppkey AS VARCHAR) AS case_id, s_suppkey AS s, s_suppkey % 5 = 0 AS clean, list_filter([1,2,3,4], lambda c: (s_suppkey + c) % 2 = 0) AS planted, s_nationkey % 4 AS min_units FROM supplier),
 wa AS (SELECT case_id, 1 AS check_id, NULL AS track, CASE WHEN NOT clean AND list_contains(planted, 1) THEN 'flagged' WHEN min_units < 2 THEN 'hard_stop' ELSE 'clean' END AS want FROM ca
  UNION ALL SELECT case_id, 2, NULL, CASE WHEN NOT clean AND list_contains(planted, 2) THEN 'flagged' ELSE 'clean' END FROM ca UNION ALL SELECT case_id, 4, NULL, CASE WHEN NOT clean AND list_contains(planted, 4) THEN 'flagged' ELSE 'clean' END FROM ca
  UNION ALL SELECT case_id, 3, 'Effector', 'flagged' FROM ca WHERE NOT clean AND list_contains(planted, 3) UNION ALL SELECT case_id, 3, 'Naive', 'clean' FROM ca)"""


def intended(spark, sf):
    s = views.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    tracked = F.array(
        F.struct(F.lit("Effector").alias("name"), F.lit(True).alias("noise")),
        F.struct(F.lit("Naive").alias("name"), F.lit(False).alias("noise")),
    )
    cases = s.select(
        F.concat(F.lit("case"), k.cast("string")).alias("case_id"),
        (k % 5 == 0).alias("clean"),
        F.filter(F.array(*[F.lit(i) for i in range(1, 5)]), lambda c: (k + c) % 2 == 0).alias("planted"),
        (F.col("s_nationkey") % 4).alias("min_units"),
        tracked.alias("tracked"),
    )
    return sc.intended_verdicts(cases)


@query("intended_verdicts", "WITH " + CASES + " SELECT * FROM wa")
def intended_verdicts(spark, sf):
    return intended(spark, sf)


@query("verdict_mismatches", "WITH " + FI + ", " + CASES + ", g AS (SELECT case_id, check_id, CASE WHEN check_id=3 THEN 'Naive' END AS track, state FROM fi) SELECT wa.case_id, wa.check_id, wa.track, wa.want, g.state AS got FROM wa LEFT JOIN g ON g.case_id=wa.case_id AND g.check_id=wa.check_id AND g.track IS NOT DISTINCT FROM wa.track WHERE g.state IS DISTINCT FROM wa.want")
def verdict_mismatches(spark, sf):
    got = finding_view(spark, sf).select(*KEY, F.when(F.col("check_id") == 3, F.lit("Naive")).alias("track"), "state")
    return sc.mismatches(got, intended(spark, sf))


@query("truth_drift", BENCH + """, nw AS (SELECT case_id, error_class, CASE WHEN substr(case_id, -1) = '7' THEN NOT present ELSE present END AS present FROM tr)
 SELECT case_id, error_class, present, 'old' AS side FROM (SELECT case_id, error_class, present FROM tr EXCEPT ALL SELECT * FROM nw) UNION ALL SELECT case_id, error_class, present, 'new' FROM (SELECT * FROM nw EXCEPT ALL SELECT case_id, error_class, present FROM tr)""")
def truth_drift(spark, sf):
    old = bench_tables(spark, sf)[0].select(*BYC, "present")
    new = old.withColumn("present", F.when(F.col("case_id").endswith("7"), ~F.col("present")).otherwise(F.col("present")))
    return sc.truth_drift(old, new, BYC)


@query("case_acceptance", "WITH " + FI + """, x AS (SELECT s, MAX(replicate_p) AS up, MAX(hold_auc) AS h, MAX(stability) AS st, MAX(v) AS v FROM fi GROUP BY 1),
 y AS (SELECT *, list_value('p1','spurious_state','real_state','continuum','p4','clean_control')[s % 6 + 1] AS family, CASE WHEN s % 2 = 0 THEN 'pos' ELSE 'neg' END AS polarity, up/1000 AS cp FROM x)
 SELECT 'case' || CAST(s AS VARCHAR) AS case_id, family FROM y WHERE s % 9 <> 0 AND CASE WHEN family='p1' AND polarity='pos' THEN cp < 1e-4 AND up >= 0.15 WHEN family='spurious_state' THEN h <= 0.6 AND st <= 0.45
 WHEN family='continuum' THEN st <= 0.45 AND h >= 0.62 WHEN family='p4' AND polarity='pos' THEN v >= 0.99 ELSE true END""")
def case_acceptance(spark, sf):
    f = finding_view(spark, sf)
    x = f.groupBy("case_id", "s").agg(
        F.max("replicate_p").alias("unit_p"), F.max("hold_auc").alias("hold_auc"), F.max("stability").alias("stability"), F.max("v").alias("v")
    )
    fams = F.array(*[F.lit(n) for n in ("p1", "spurious_state", "real_state", "continuum", "p4", "clean_control")])
    s = F.col("s")
    labels = x.select(
        "case_id",
        F.get(fams, (s % 6).cast("int")).alias("family"),
        F.when(s % 2 == 0, F.lit("pos")).otherwise(F.lit("neg")).alias("polarity"),
        (F.col("unit_p") / 1000).alias("cell_p"),
        "unit_p",
        "hold_auc",
        "stability",
        "v",
        F.array(F.lit(True), s % 9 != 0).alias("truth"),
        F.array(F.lit(True), F.lit(True)).alias("intent"),
    )
    return sc.accept_cases(labels).select("case_id", "family")
