"""Claim tables: grounding in the dataset, route pruning, and expansion into runs.

`claims` has dataset_id, pos, id, text, status, confidence, note, obs_columns, uns_keys,
genes (arrays) and checks: array<struct<check int, params map<string,string>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.session import settle

CLAIM = ["dataset_id", "pos"]
CHECKS = tuple(range(1, 9))
# Which route parameters name columns and features, which are evidence only,
# the knobs of each check with their kinds, and the two parameter aliases.
COLUMN_PARAMS = ("grouping", "unit", "nuisance", "interest")
GENE_PARAMS = ("gene", "markers")
EVIDENCE_PARAMS = ("storedResult", "reported")
KNOBS = {
    1: {"unit": "string", "grouping": "string", "alpha": "number", "gene": "string"},
    2: {"split": "number", "grouping": "string", "markers": "string[]", "target_group": "string"},
    3: {"min": "number", "max": "number", "step": "number", "track": "string", "scrub": "number"},
    4: {"interest": "string", "nuisance": "string[]", "grouping": "string"},
    5: {"alpha": "number", "method": "string"},
    6: {"interest": "string", "covariate": "string", "alpha": "number"},
    7: {"min": "number", "max": "number", "step": "number", "criterion": "string", "chosen": "number"},
    8: {"grouping": "string", "claimedTest": "string", "alpha": "number"},
}
DEFAULTS = {
    1: {"alpha": "0.05"},
    2: {"split": "0.5", "seed": "0"},
    3: {"min": "0.2", "max": "2.0", "step": "0.2", "scrub": "0.9", "track": "", "seed": "0"},
    4: {},
    5: {"alpha": "0.05", "method": "bh"},
    6: {"alpha": "0.05"},
    7: {"min": "0.2", "max": "2.0", "step": "0.2", "criterion": "silhouette", "chosen": "1.0", "seed": "0"},
    8: {"claimedTest": "unknown", "alpha": "0.05"},
}
ALIASES = {2: ("cluster", "target_group"), 3: ("cluster", "track")}


def is_active(status: Column) -> Column:
    return ~status.isin("out_of_scope", "removed")


def _refs(params: Column, keys: tuple[str, ...]) -> Column:
    vals = F.array(*[params[k] for k in keys])
    return F.filter(vals, lambda v: v.isNotNull() & (v != ""))


def dataset_columns(columns: DataFrame) -> DataFrame:
    """Column names per dataset as one array: as long as a schema is wide."""
    return columns.groupBy("dataset_id").agg(F.collect_set("name").alias("__cols"))


def ground_claims(claims: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Drops claims citing a column or a stored-result key the dataset does not hold."""
    cited_cols = claims.select(*CLAIM, F.explode("obs_columns").alias("name"))
    cited_keys = claims.select(*CLAIM, F.explode("uns_keys").alias("key"))
    fabricated = (
        cited_cols.join(columns.select("dataset_id", "name").distinct(), ["dataset_id", "name"], "left_anti")
        .select(*CLAIM)
        .union(cited_keys.join(keys.select("dataset_id", "key").distinct(), ["dataset_id", "key"], "left_anti").select(*CLAIM))
    )
    return claims.join(fabricated.distinct(), CLAIM, "left_anti")


def route_table(claims: DataFrame) -> DataFrame:
    """One row per proposed route of a claim that may be audited."""
    return claims.filter(F.col("status") != "out_of_scope").select(*CLAIM, F.posexplode("checks").alias("rpos", "route")).select(
        *CLAIM, "rpos", F.col("route.check").alias("check"), F.col("route.params").alias("params")
    )


def absent_labels(routes: DataFrame, levels: DataFrame) -> DataFrame:
    """Routes whose cluster label a fully known column does not contain.

    `levels` lists every (dataset_id, column, label) of the enumerable columns.
    """
    named = routes.select(*CLAIM, "rpos", F.col("params")["grouping"].alias("column"), F.col("params")["cluster"].alias("label"))
    named = named.filter((F.trim("column") != "") & (F.trim("label") != ""))
    enumerable = levels.select("dataset_id", "column").distinct()
    return named.join(enumerable, ["dataset_id", "column"], "left_semi").join(
        levels.select("dataset_id", "column", "label").distinct(), ["dataset_id", "column", "label"], "left_anti"
    )


def prune_routes(claims: DataFrame, columns: DataFrame, levels: DataFrame) -> DataFrame:
    """Claims with impossible routes removed, plus what was removed and why.

    Unknown checks, absent columns and absent labels go; the first route per check stays.
    """
    cols = dataset_columns(columns)
    routes = ordered.attach(route_table(claims), cols, ["dataset_id"], "left").withColumn(
        "__missing", F.array_except(_refs(F.col("params"), COLUMN_PARAMS), F.coalesce("__cols", F.array().cast("array<string>")))
    )
    absent = absent_labels(routes, levels).select(*CLAIM, "rpos", F.lit(True).alias("__absent"), "label", "column")
    marked = routes.join(absent, [*CLAIM, "rpos"], "left").withColumn(
        "__keep", F.col("check").isin(*CHECKS) & (F.size("__missing") == 0) & F.col("__absent").isNull()
    )
    # Rule order: a label is only judged on routes whose check and columns are possible.
    judged = F.col("__absent").isNotNull() & F.col("check").isin(*CHECKS) & (F.size("__missing") == 0)
    chosen = marked.groupBy(*CLAIM, "check").agg(
        F.min(F.when(F.col("__keep"), F.col("rpos"))).alias("__first"),
        F.min_by("params", F.when(F.col("__keep"), F.col("rpos"))).alias("params"),
        F.flatten(F.collect_list("__missing")).alias("__missing"),
        F.collect_list(F.when(judged, F.concat("label", F.lit(" (in "), "column", F.lit(")")))).alias("__labels"),
    )
    kept = chosen.groupBy(*CLAIM).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("__first").isNotNull(), F.struct(F.col("__first").alias("rpos"), "check", F.map_entries("params").alias("params"))))
        ).alias("__kept"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__missing")))).alias("missing_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__labels")))).alias("absent_labels"),
    )
    none = F.array().cast("array<string>")
    rebuilt = F.transform(
        "__kept", lambda r: F.struct(r["check"].alias("check"), F.map_from_entries(r["params"]).alias("params"))
    )
    empty = F.filter("checks", lambda _: F.lit(False))
    return (
        claims.join(kept, CLAIM, "left")
        .withColumn("proposed", F.size("checks"))
        .withColumn("checks", F.coalesce(rebuilt, empty))
        .withColumn("missing_columns", F.coalesce("missing_columns", none))
        .withColumn("absent_labels", F.coalesce("absent_labels", none))
        .drop("__kept")
    )


def unknown_genes(claims: DataFrame, features: DataFrame) -> DataFrame:
    """Features a claim cites, directly or through a route, that the dataset does not know."""
    from_routes = F.flatten(F.transform("checks", lambda r: _refs(r["params"], GENE_PARAMS)))
    cited = claims.select(*CLAIM, F.explode(F.array_union("genes", from_routes)).alias("gene")).withColumn(
        "__g", F.lower(F.trim("gene"))
    )
    known = features.select(F.lower(F.trim("gene")).alias("__g")).distinct()
    return (
        cited.join(known, "__g", "left_anti")
        .groupBy(*CLAIM, "__g")
        .agg(F.min("gene").alias("gene"))
        .groupBy(*CLAIM)
        .agg(F.array_sort(F.collect_list("gene")).alias("unknown_genes"))
    )


def demote(pruned: DataFrame, unknown: DataFrame) -> DataFrame:
    """Low confidence and an appended note for every reason a claim cannot be taken as routed."""
    df = pruned.join(unknown, CLAIM, "left").withColumn(
        "unknown_genes", F.coalesce("unknown_genes", F.array().cast("array<string>"))
    )
    active = is_active(F.col("status"))
    arrived = active & (F.col("proposed") > 0)
    empty = F.size("checks") == 0
    uncited = (F.size("obs_columns") == 0) & (F.size("uns_keys") == 0) & (F.size("genes") == 0)
    lists = lambda c: F.concat_ws(", ", c)
    reasons = [
        (F.size("absent_labels") > 0, F.concat(F.lit("Labels not in their column: "), lists("absent_labels"), F.lit("."))),
        (F.size("unknown_genes") > 0, F.concat(F.lit("Features not in the data: "), lists("unknown_genes"), F.lit("."))),
        (
            arrived & empty,
            F.when(
                F.size("missing_columns") > 0,
                F.concat(F.lit("No route left; columns not in the data: "), lists("missing_columns"), F.lit(".")),
            ).otherwise(F.lit("No route left that this data can run.")),
        ),
        (active & ~arrived & empty & uncited, F.lit("Cites nothing and routes nowhere.")),
    ]
    out = df
    for cond, note in reasons:
        seen = F.coalesce("note", F.lit(""))
        out = out.withColumn("confidence", F.when(cond, F.lit("low")).otherwise(F.col("confidence"))).withColumn(
            "note",
            F.when(~cond, F.col("note"))
            .when(seen == "", note)
            .when(F.contains(seen, note), seen)
            .otherwise(F.concat_ws(" ", seen, note)),
        )
    return out


def unique_ids(claims: DataFrame) -> DataFrame:
    """Non-empty ids unique per dataset: a repeat takes the first free `<id>-N`, N from 2.

    In claim order each claim takes the first free name of its own list, so earlier claims
    always win. Occurrence k of a base starts at suffix k, its lower bound; a round then
    pushes back, together with its later siblings, any claim whose name an earlier claim
    holds. A pushed name is never free again, so the rounds end at the sequential answer.
    """
    base = F.when(F.trim("id") == "", F.concat(F.lit("claim-"), F.col("pos").cast("string"))).otherwise(F.col("id"))
    rows = claims.select(*CLAIM, base.alias("base"))
    rows = ordered.position_in_group(rows, ["dataset_id", "base"], "pos", "k").withColumn("shift", F.lit(0).cast("long"))
    rows = settle(rows)
    name = F.when(F.col("k") + F.col("shift") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit("-"), (F.col("k") + F.col("shift")).cast("string"))
    )
    while True:
        named = rows.withColumn("id", name)
        holders = named.groupBy("dataset_id", "id").agg(F.min("pos").alias("__holder"), F.count("*").alias("__n"))
        losers = named.join(holders.filter("__n > 1"), ["dataset_id", "id"]).filter(F.col("pos") != F.col("__holder"))
        push = settle(losers.groupBy("dataset_id", "base").agg(F.min("k").alias("__from")))
        if push.isEmpty():
            break
        rows = settle(
            rows.join(push, ["dataset_id", "base"], "left")
            .withColumn("shift", F.col("shift") + F.when(F.col("k") >= F.col("__from"), 1).otherwise(0))
            .drop("__from")
        )
    return claims.drop("id").join(named.select(*CLAIM, "id"), CLAIM)


def assess(claims: DataFrame, stored_kinds: DataFrame) -> DataFrame:
    """Per dataset: auditable claims, testable stored results, and a suspicious silence."""
    can = is_active(F.col("status")) & (F.size("checks") > 0)
    a = claims.groupBy("dataset_id").agg(F.count_if(can).alias("auditable"))
    e = stored_kinds.filter(F.col("kind").isin("de_result", "marker_table")).groupBy("dataset_id").agg(
        F.count("*").alias("evidence")
    )
    return (
        a.join(e, "dataset_id", "full")
        .select(
            "dataset_id",
            F.coalesce("auditable", F.lit(0)).alias("auditable"),
            F.coalesce("evidence", F.lit(0)).alias("evidence"),
        )
        .withColumn("suspiciously_empty", (F.col("auditable") == 0) & (F.col("evidence") > 0))
    )


# --- runs --------------------------------------------------------------------------
def runs_from(claims: DataFrame) -> DataFrame:
    """One run per (active claim, valid route); order by (pos, check) to read in claim order."""
    return (
        claims.filter(is_active(F.col("status")))
        .select("dataset_id", "pos", "id", "text", F.explode("checks").alias("r"))
        .filter(F.col("r.check").isin(*CHECKS))
        .select(
            "dataset_id",
            "pos",
            F.concat_ws("::", "id", F.col("r.check").cast("string")).alias("key"),
            F.col("id").alias("claim_id"),
            "text",
            F.col("r.check").alias("check"),
            F.col("r.params").alias("params"),
        )
    )


def routed_checks(claims: DataFrame) -> DataFrame:
    return runs_from(claims).select("dataset_id", "check").distinct()


def owner_claim(claims: DataFrame) -> DataFrame:
    """Per check the active claim with the fewest valid routes, first wins; for comparison only."""
    valid = F.filter("checks", lambda r: r["check"].isin(*CHECKS))
    c = claims.filter(is_active(F.col("status"))).select("dataset_id", "pos", "id", valid.alias("v"))
    return (
        c.select("dataset_id", "pos", "id", F.size("v").alias("n_routes"), F.explode("v.check").alias("check"))
        .groupBy("dataset_id", "check")
        .agg(F.min(F.struct("n_routes", "pos", "id")).alias("m"))
        .select("dataset_id", "check", F.col("m.id").alias("claim_id"), F.col("m.n_routes").alias("n_routes"))
    )


def alias_params(runs: DataFrame) -> DataFrame:
    """`cluster` becomes the knob the check reads; a knob already given wins."""
    p = F.col("params")
    out = p
    for check, (old, new) in ALIASES.items():
        without = F.map_filter(p, lambda k, _: k != old)
        moved = F.when(F.map_contains_key(p, new), without).otherwise(F.map_concat(without, F.create_map(F.lit(new), p[old])))
        out = F.when((F.col("check") == check) & F.map_contains_key(p, old), moved).otherwise(out)
    return runs.withColumn("params", out)


def merge_params(runs: DataFrame) -> DataFrame:
    """Params laid over the check's defaults by knob kind; what could not be applied is listed."""
    kinds = F.create_map(*[F.lit(x) for c, ks in KNOBS.items() for k, kind in ks.items() for x in (f"{c}.{k}", kind)])
    base = F.create_map(
        *[
            x
            for c, d in DEFAULTS.items()
            for x in (
                F.lit(c),
                F.create_map(*[F.lit(y) for kv in d.items() for y in kv]) if d else F.create_map().cast("map<string,string>"),
            )
        ]
    )
    number = lambda v: F.when(F.trim(v) == "", F.lit(0.0)).otherwise(F.trim(v).try_cast("double"))

    def kind_of(k):
        return kinds[F.concat(F.col("check").cast("string"), F.lit("."), k)]

    def usable(k, v):
        n = number(v)
        kind = kind_of(k)
        return F.when(kind == "number", n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))).otherwise(
            F.coalesce(kind.isNotNull() & (v != ""), F.lit(False))
        )

    applied = F.map_filter("params", usable)
    ignored = F.map_filter("params", lambda k, v: ~usable(k, v) & ~(kind_of(k).isNull() & k.isin(*EVIDENCE_PARAMS)))
    defaults = base[F.col("check")]
    return (
        runs.withColumn("__a", applied)
        .withColumn("unmapped", F.array_sort(F.map_keys(ignored)))
        .withColumn(
            "config",
            F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(F.col("__a"), k)), F.col("__a")),
        )
        .drop("__a")
    )


def prepare_runs(claims: DataFrame) -> DataFrame:
    return merge_params(alias_params(runs_from(claims)))
