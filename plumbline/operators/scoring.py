"""Verdict summaries, rulings, confusion against truth, and reconciliation with an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_CLASSES = ("pseudoreplication", "double_dipping", "fragility", "confounding")
# Tolerances of the comparators and thresholds of truth and acceptance.
TOLERANCE = {"auc": 0.06, "stability": 0.06, "v": 0.03, "log10p": 0.5}
THREE_WAY = {"count": 1.0, "res": 1e-3, "frac": 0.05, "auc": 0.03, "p": 1e-3, "v": 1e-3}
ALPHA = 0.05


# --- verdicts ----------------------------------------------------------------------
def assemble_report(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts per verdict and one sentence. A hard stop counts as flagged and is also shown apart."""
    s = F.col("state")
    out = findings.groupBy(*by).agg(
        F.count("*").alias("checks"),
        F.count_if(s.isin("flagged", "hard_stop")).alias("flagged"),
        F.count_if(s == "hard_stop").alias("hard_stop"),
        F.count_if(s == "clean").alias("clean"),
        F.count_if(s == "flag_only").alias("need_input"),
    )
    n, bad, open_ = F.col("checks"), F.col("flagged"), F.col("need_input")
    sentence = (
        F.when((bad == 0) & (open_ == 0), F.format_string("All %d checks are clean.", n))
        .when(bad == 0, F.format_string("%d of %d checks are clean; %d need input.", F.col("clean"), n, open_))
        .otherwise(F.format_string("%d of %d checks flagged.", bad, n))
    )
    return out.withColumn("verdict", sentence)


VETOED = "A second look cleared this finding; its numbers are kept as evidence."


def apply_rulings(findings: DataFrame, rulings: DataFrame, by: list[str]) -> DataFrame:
    """A veto turns a flagged finding clean; a missing ruling keeps it and marks it unverified.

    Where findings carry a headline, that of a vetoed one gives way: it would still speak of a flag. Numbers and charts
    stay as what was looked at.
    """
    j = findings.join(rulings.select(*by, F.col("verdict").alias("__v")), by, "left")
    flagged = F.col("state") == "flagged"
    veto = flagged & F.coalesce(F.col("__v") == "veto", F.lit(False))
    if "headline" in findings.columns:
        j = j.withColumn("headline", F.when(veto, F.lit(VETOED)).otherwise(F.col("headline")))
    return (
        j.withColumn("ruling", F.when(flagged, F.coalesce("__v", F.lit("confirm"))))
        .withColumn("unverified", flagged & F.col("__v").isNull())
        .withColumn("effective_state", F.when(veto, F.lit("clean")).otherwise(F.col("state")))
        .withColumn("show_bad", flagged & ~veto)
        .drop("__v")
    )


def rule_rulings(findings: DataFrame) -> DataFrame:
    """A deterministic second look at each flagged finding from its own numbers."""
    c, flagged = F.col("check_id"), F.col("state") == "flagged"
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    verdict = (
        F.when((c == 1) & yes(F.col("replicate_p") < 0.05), F.lit("veto"))
        .when((c == 2) & yes(F.col("hold_auc") >= 0.62), F.lit("veto"))
        .when((c == 2) & yes(F.col("heldout_cells") < 20), F.lit("downgrade"))
        .when((c == 3) & yes(F.col("stability") >= 0.8), F.lit("veto"))
        .when((c == 4) & (yes(F.col("separable")) | yes(F.col("v") < 0.9)), F.lit("veto"))
        .otherwise(F.lit("confirm"))
    )
    confidence = F.when(verdict == "downgrade", F.lit("medium")).when(c > 4, F.lit("low")).otherwise(F.lit("high"))
    return findings.filter(flagged).select("case_id", "check_id", verdict.alias("verdict"), confidence.alias("confidence"))


def flatten_evidence(findings: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The load-bearing numbers as (key, value) rows; nulls dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        findings.select(*by, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select(
            *by, "p.key", "p.value"
        )
    )


def grade_rulings(gated: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Per ruling whether it passes; an unverified one never does."""
    j = expected.join(gated.select(*by, "ruling", "unverified", "effective_state"), by, "left")
    ok = F.coalesce((F.col("ruling") == F.col("expected")) & ~F.col("unverified"), F.lit(False))
    return j.withColumn("passed", ok)


def rulings_ready(graded: DataFrame, by: list[str]) -> DataFrame:
    """All passed, and every over-fired flag ended clean with at least one to show for it."""
    over = F.col("kind") == "over-fire"
    return graded.groupBy(*by).agg(
        F.count("*").alias("rulings"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(over).alias("over_fires"),
        F.count_if(over & F.coalesce(F.col("effective_state") == "clean", F.lit(False))).alias("over_clean"),
    ).withColumn("green", (F.col("over_fires") > 0) & (F.col("over_clean") == F.col("over_fires"))).withColumn(
        "ready", F.col("green") & (F.col("passed") == F.col("rulings"))
    )


# --- confusion ---------------------------------------------------------------------
def assemble_arms(detected: DataFrame, rulings: DataFrame, by: list[str]) -> DataFrame:
    """Detected flag per arm: raw, and raw kept unless a ruling rejects it."""
    j = detected.join(rulings.select(*by, "supported"), by, "left")
    arms = F.array(
        F.struct(F.lit("raw").alias("arm"), F.col("flag").alias("detected")),
        F.struct(F.lit("reviewed").alias("arm"), (F.col("flag") & F.coalesce("supported", F.lit(True))).alias("detected")),
    )
    return j.select(*by, F.explode(arms).alias("a")).select(*by, "a.arm", "a.detected")


def confusion(verdicts: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """TP/FP/FN/TN per arm, overall (`error_class` null) and per error class."""
    j = truth.join(verdicts.select(*by, "arm", "detected"), by)
    t, d = F.col("present"), F.coalesce("detected", F.lit(False))
    marked = j.withColumns({"tp": t & d, "fp": ~t & d, "fn": t & ~d, "tn": ~t & ~d})
    return marked.groupingSets([[F.col("arm")], [F.col("arm"), F.col("error_class")]], "arm", "error_class").agg(
        *[F.count_if(F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )


def rates(conf: DataFrame) -> DataFrame:
    """Detection, false-positive rate, precision, F1, specificity and Youden's J; null over nothing."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = (
        conf.withColumn("detection", F.try_divide(tp, tp + fn))
        .withColumn("fp_rate", F.try_divide(fp, fp + tn))
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("specificity", F.try_divide(tn, fp + tn))
    )
    p, r = F.col("precision"), F.col("detection")
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when(tp + fn > 0, F.lit(0.0))
    return out.withColumn("f1", f1).withColumn("youden_j", r + F.col("specificity") - 1)


def clean_control_flags(verdicts: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """False flags on control cases: by case and by (case, class) pair."""
    j = truth.filter(F.col("family") == "clean_control").join(verdicts.select(*by, "arm", "detected"), by)
    per = j.groupBy("arm", "case_id").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("detected")).alias("flags")
    )
    return per.groupBy("arm").agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("flags") > 0).alias("cases_flagged"),
        (F.count_if(F.col("flags") > 0) / F.count("*")).alias("case_fp_rate"),
        (F.sum("flags") / F.sum("pairs")).alias("pair_fp_rate"),
    )


# --- answer keys -------------------------------------------------------------------
def _close_log10(a: Column, b: Column, tol: float) -> Column:
    lg = lambda c: F.log10(F.greatest(c, F.lit(1e-300)))
    return F.abs(lg(a) - lg(b)) <= tol


def compare(ours: DataFrame, key: DataFrame, expected_checks: int = 4) -> DataFrame:
    """Value-by-value agreement per (case, check), then per case.

    Both tables have case_id, check_id, state, n, p, disc_auc, hold_auc, stability, v. A check
    with nothing compared does not match; a case with too few checks fails.
    """
    names = ("state", "n", "p", "disc_auc", "hold_auc", "stability", "v")
    o = ours.select("case_id", "check_id", *[F.col(c).alias(f"o_{c}") for c in names])
    k = key.select("case_id", "check_id", *[F.col(c).alias(f"k_{c}") for c in names])
    j = o.join(k, ["case_id", "check_id"], "full")
    oc, kc = (lambda c: F.col(f"o_{c}")), (lambda c: F.col(f"k_{c}"))
    chk = F.col("check_id")
    both = lambda c: oc(c).isNotNull() & kc(c).isNotNull()
    near = lambda c, t: F.abs(oc(c) - kc(c)) <= t + 1e-12
    same_call = (oc("p") < ALPHA) == (kc("p") < ALPHA)
    quiet = (oc("p") >= ALPHA) & (kc("p") >= ALPHA)
    ran = ~oc("state").isin("flag_only", "hard_stop")
    tests = F.array(
        F.when(kc("state").isNotNull(), F.coalesce(oc("state") == kc("state"), F.lit(False))),
        F.when((chk == 1) & kc("n").isNotNull(), F.coalesce(oc("n") == kc("n"), F.lit(False))),
        F.when((chk == 1) & ran & both("p"), same_call & (~quiet | _close_log10(oc("p"), kc("p"), TOLERANCE["log10p"]))),
        F.when((chk == 2) & both("hold_auc"), near("hold_auc", TOLERANCE["auc"])),
        F.when(
            (chk == 2) & both("hold_auc") & both("disc_auc"),
            (oc("disc_auc") >= oc("hold_auc")) == (kc("disc_auc") >= kc("hold_auc")),
        ),
        F.when((chk == 3) & both("stability"), near("stability", TOLERANCE["stability"])),
        F.when((chk == 4) & both("v"), near("v", TOLERANCE["v"])),
    )
    made = F.array_compact(tests)
    present = F.col("o_state").isNotNull() & F.col("k_state").isNotNull()
    return j.select(
        "case_id",
        "check_id",
        F.size(made).alias("compared"),
        (present & (F.size(made) > 0) & F.forall(made, lambda x: x)).alias("matches"),
    )


def compare_cases(per_check: DataFrame, expected_checks: int = 4) -> DataFrame:
    return per_check.groupBy("case_id").agg(
        F.count("*").alias("checks"), F.count_if(F.col("matches")).alias("matched")
    ).withColumn("passed", (F.col("checks") >= expected_checks) & (F.col("matched") == F.col("checks")))


def three_way(reported: DataFrame, previewed: DataFrame, recomputed: DataFrame, by: list[str]) -> DataFrame:
    """The reported, previewed and recomputed corrected values agree within their category.

    Each table has `by`, category and value; a null agrees only with nulls.
    """
    j = (
        reported.select(*by, "category", F.col("value").alias("a"))
        .join(previewed.select(*by, F.col("value").alias("b")), by, "full")
        .join(recomputed.select(*by, F.col("value").alias("c")), by, "full")
    )
    tol = F.create_map(*[F.lit(x) for kv in THREE_WAY.items() for x in kv])[F.col("category")]

    def agree(x, y):
        close = F.abs(x - y) <= tol + 1e-12
        close = close | ((F.col("category") == "p") & _close_log10(x, y, 0.5))
        return F.when(x.isNull() & y.isNull(), F.lit(True)).otherwise(F.coalesce(close, F.lit(False)))

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return j.select(*by, "category", "a", "b", "c", (agree(a, b) & agree(b, c) & agree(a, c)).alias("agree"))


def intended_verdicts(cases: DataFrame) -> DataFrame:
    """What each check should say: planted means flagged; check 1 hard-stops below two units.

    `cases` has case_id, clean, planted (array of check ids), min_units and tracked groups
    (array of struct<name, noise>).
    """
    planted = lambda c: ~F.col("clean") & F.array_contains("planted", c)
    one = F.when(planted(1), F.lit("flagged")).when(F.col("min_units") < 2, F.lit("hard_stop")).otherwise(F.lit("clean"))
    flat = lambda c: F.when(planted(c), F.lit("flagged")).otherwise(F.lit("clean"))
    none = F.lit(None).cast("string")
    row = lambda c, t, w: F.struct(F.lit(c).alias("check_id"), t.alias("track"), w.alias("want"))
    noise = F.transform(
        F.filter("tracked", lambda t: ~t["noise"] | planted(3)),
        lambda t: row(3, t["name"], F.when(t["noise"], F.lit("flagged")).otherwise(F.lit("clean"))),
    )
    rows = F.concat(F.array(row(1, none, one), row(2, none, flat(2)), row(4, none, flat(4))), noise)
    return cases.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")


def mismatches(got: DataFrame, want: DataFrame) -> DataFrame:
    """Checks whose verdict is not the intended one ('any' accepts all)."""
    g = got.select("case_id", "check_id", F.coalesce("track", F.lit("")).alias("__t"), F.col("state").alias("got"))
    w = want.withColumn("__t", F.coalesce("track", F.lit("")))
    return (
        w.join(g, ["case_id", "check_id", "__t"], "left")
        .filter((F.col("want") != "any") & ~F.col("got").eqNullSafe(F.col("want")))
        .drop("__t")
    )


def truth_drift(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Truth rows that changed, appeared or vanished; any row refuses the relabelling."""
    cols = [*by, "present"]
    gone = old.select(cols).exceptAll(new.select(cols)).withColumn("side", F.lit("old"))
    came = new.select(cols).exceptAll(old.select(cols)).withColumn("side", F.lit("new"))
    return gone.unionByName(came)


# A fragile case needs a clear margin, a stable one must stay present.
FRAGILE_MAX, STABLE_MIN = 0.45, 0.8


def lost_margins(labels: DataFrame) -> DataFrame:
    """Cases whose stability no longer keeps its margin, and why; any row refuses the relabelling.

    Fragile positives (family spurious_state or continuum) stay at or under FRAGILE_MAX; cases labelled
    not fragile stay at or over STABLE_MIN. A missing stability is a lost margin.
    """
    fragile = F.col("family").isin("spurious_state", "continuum") & (F.col("polarity") == "pos")
    s = F.col("stability")
    why = F.when(fragile & ~F.coalesce(s <= FRAGILE_MAX, F.lit(False)), F.lit("fragile case without margin")).when(
        ~fragile & ~F.col("fragility") & ~F.coalesce(s >= STABLE_MIN, F.lit(False)), F.lit("stable case without margin")
    )
    return labels.withColumn("reason", why).filter("reason is not null").select("case_id", "stability", "reason")


def accept_cases(labels: DataFrame) -> DataFrame:
    """Generated cases whose truth equals the intent with a clear margin on the deciding number."""
    fam, positive = F.col("family"), F.col("polarity") == "pos"
    collapse, fragile = F.col("hold_auc") <= 0.60, F.col("stability") <= 0.45
    margin = (
        F.when((fam == "p1") & positive, (F.col("cell_p") < 1e-4) & (F.col("unit_p") >= 0.15))
        .when(fam == "spurious_state", collapse & fragile)
        .when(fam == "continuum", fragile & (F.col("hold_auc") >= 0.62))
        .when((fam == "p4") & positive, F.col("v") >= 0.99)
        .otherwise(F.lit(True))
    )
    same = F.forall(F.zip_with("truth", "intent", lambda a, b: a == b), lambda x: x)
    return labels.filter(same & F.coalesce(margin, F.lit(False)))


def label_truth(stats: DataFrame) -> DataFrame:
    """The four truth booleans of a case from its recomputed numbers."""
    return stats.withColumns(
        {
            "pseudoreplication": (F.col("cell_p") < ALPHA) & (F.col("unit_p") >= ALPHA),
            "double_dipping": F.col("hold_auc") <= 0.60,
            "fragility": F.col("stability") < 0.5,
            "confounding": F.col("v") >= 0.80,
        }
    )
