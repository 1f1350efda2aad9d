"""Queries over claim tables: every event is read as one extracted claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import claims as cl
from plumbline.plans import views
from plumbline.plans.registry import query


def claim_view(spark, sf):
    """Claims, known columns, stored-result keys and column levels, all from `events`.

    Ten datasets by user; ids repeat and collide, some citations, routes and labels are
    impossible, some claims are set aside.
    """
    e = views.table(spark, sf, "events").select(
        F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("dataset_id"),
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    i = F.col("pos")
    uid = F.concat(F.lit("c"), F.col("u").cast("string"))
    cid = (
        F.when(i % 7 == 0, F.lit(""))
        .when(i % 7 <= 2, uid)
        .when(i % 7 == 3, F.concat(uid, F.lit("-2")))
        .otherwise(F.concat(F.lit("e"), i.cast("string")))
    )

    def route(j):
        n = i + j
        params = F.map_from_entries(
            F.array_compact(
                F.array(
                    F.struct(F.lit("grouping").alias("key"), F.when(n % 6 == 0, F.lit("error")).otherwise(F.lit("click")).alias("value")),
                    F.when(n % 4 == 0, F.struct(F.lit("cluster").alias("key"), F.concat(F.lit("k"), (n % 130).cast("string")).alias("value"))),
                    F.when(n % 5 == 0, F.struct(F.lit("gene").alias("key"), F.concat(F.lit("Brand#"), (n % 30 + 1).cast("string")).alias("value"))),
                    F.when(n % 3 == 0, F.struct(F.lit("alpha").alias("key"), F.when(n % 9 == 0, F.lit("tiny")).otherwise(F.lit("0.01")).alias("value"))),
                    F.when(n % 8 == 0, F.struct(F.lit("storedResult").alias("key"), F.lit("r1").alias("value"))),
                )
            )
        )
        return F.struct(((n * 3) % 10 + 1).cast("int").alias("check"), params.alias("params"))

    routes = F.slice(F.array(route(0), route(1), route(0), route(3)), 1, (i % 5).cast("int"))
    none = F.array().cast("array<string>")
    claims = e.select(
        "dataset_id",
        "pos",
        cid.alias("id"),
        F.concat_ws(" ", F.lit("claim on"), "kind").alias("text"),
        F.when(i % 11 == 0, F.lit("out_of_scope")).when(i % 11 == 1, F.lit("removed")).otherwise(F.lit("active")).alias("status"),
        F.when(F.col("value") > 60, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"),
        F.lit(None).cast("string").alias("note"),
        F.when(i % 3 == 0, F.array("kind")).otherwise(none).alias("obs_columns"),
        F.when(i % 13 == 0, F.array(F.col("k").cast("string"))).otherwise(none).alias("uns_keys"),
        F.when(i % 5 == 0, F.array(F.concat(F.lit("Brand#"), (i % 30 + 1).cast("string")))).otherwise(none).alias("genes"),
        routes.alias("checks"),
    )
    columns = e.filter("kind != 'error'").select("dataset_id", F.col("kind").alias("name")).distinct()
    keys = e.filter("k < 50").select("dataset_id", F.col("k").cast("string").alias("key")).distinct()
    levels = e.select(
        "dataset_id", F.col("kind").alias("column"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("label")
    ).distinct()
    return claims, columns, keys, levels


CLAIMS = """ev AS (SELECT 'd' || CAST(user_id % 10 AS VARCHAR) AS dataset_id, event_id AS pos, user_id AS u, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 cols AS (SELECT DISTINCT dataset_id, kind AS name FROM ev WHERE kind <> 'error'), keys AS (SELECT DISTINCT dataset_id, k AS key FROM ev WHERE k < 50),
 lev AS (SELECT DISTINCT dataset_id, kind AS col, 'k' || CAST(k AS VARCHAR) AS label FROM ev),
 claims AS (SELECT *, CASE WHEN pos % 11 = 0 THEN 'out_of_scope' WHEN pos % 11 = 1 THEN 'removed' ELSE 'active' END AS status, CASE WHEN value > 60 THEN 'high' ELSE 'medium' END AS confidence,
   CASE WHEN pos % 7 = 0 THEN '' WHEN pos % 7 <= 2 THEN 'c' || CAST(u AS VARCHAR) WHEN pos % 7 = 3 THEN 'c' || CAST(u AS VARCHAR) || '-2' ELSE 'e' || CAST(pos AS VARCHAR) END AS id, 'claim on ' || kind AS text,
   CASE WHEN pos % 3 = 0 THEN kind END AS cited_col, CASE WHEN pos % 13 = 0 THEN k END AS cited_key, CASE WHEN pos % 5 = 0 THEN 'Brand#' || CAST(pos % 30 + 1 AS VARCHAR) END AS cited_gene FROM ev),
 routes AS (SELECT c.*, r.rpos, c.pos + r.j AS n FROM claims c JOIN (VALUES (0, 0), (1, 1), (2, 0), (3, 3)) r(rpos, j) ON r.rpos < c.pos % 5),
 rt AS (SELECT *, (n*3) % 10 + 1 AS ck, CASE WHEN n % 6 = 0 THEN 'error' ELSE 'click' END AS p_grouping, CASE WHEN n % 4 = 0 THEN 'k' || CAST(n % 130 AS VARCHAR) END AS p_cluster,
   CASE WHEN n % 5 = 0 THEN 'Brand#' || CAST(n % 30 + 1 AS VARCHAR) END AS p_gene, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 9 = 0 THEN 'tiny' ELSE '0.01' END END AS p_alpha, n % 8 = 0 AS p_stored FROM routes),
 judged AS (SELECT rt.*, ck BETWEEN 1 AND 8 AND EXISTS (SELECT 1 FROM cols WHERE cols.dataset_id = rt.dataset_id AND cols.name = p_grouping) AS possible,
   p_cluster IS NOT NULL AND EXISTS (SELECT 1 FROM lev WHERE lev.dataset_id=rt.dataset_id AND lev.col=p_grouping) AND NOT EXISTS (SELECT 1 FROM lev WHERE lev.dataset_id=rt.dataset_id AND lev.col=p_grouping AND lev.label=p_cluster) AS absent
   FROM rt WHERE status <> 'out_of_scope'),
 kept AS (SELECT * FROM judged WHERE possible AND NOT absent QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset_id, pos, ck ORDER BY rpos) = 1),
 grounded AS (SELECT * FROM claims c WHERE NOT (cited_col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cols WHERE cols.dataset_id=c.dataset_id AND cols.name=cited_col))
   AND NOT (cited_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.dataset_id=c.dataset_id AND keys.key=cited_key)))"""


def sql(tail: str) -> str:
    return "WITH " + CLAIMS + " " + tail


@query("claim_grounding", sql("SELECT dataset_id, pos, id FROM grounded"))
def claim_grounding(spark, sf):
    claims, columns, keys, _ = claim_view(spark, sf)
    return cl.ground_claims(claims, columns, keys).select("dataset_id", "pos", "id")


@query("route_pruning", sql("SELECT dataset_id, pos, ck AS \"check\", p_grouping AS grouping, p_cluster AS cluster FROM kept"))
def route_pruning(spark, sf):
    claims, columns, _, levels = claim_view(spark, sf)
    p = cl.prune_routes(claims, columns, levels).select("dataset_id", "pos", F.explode("checks").alias("r"))
    return p.select(
        "dataset_id", "pos", F.col("r.check").cast("long").alias("check"), F.col("r.params")["grouping"].alias("grouping"), F.col("r.params")["cluster"].alias("cluster")
    )


@query("absent_labels", sql("SELECT dataset_id, pos, rpos, p_cluster AS label FROM judged WHERE absent"))
def absent_labels(spark, sf):
    claims, _, _, levels = claim_view(spark, sf)
    return cl.absent_labels(cl.route_table(claims), levels).select("dataset_id", "pos", "rpos", "label")


DEMOTE = """, ug AS (SELECT DISTINCT dataset_id, pos FROM (SELECT dataset_id, pos, cited_gene AS g FROM claims UNION ALL SELECT dataset_id, pos, p_gene FROM rt)
   WHERE g IS NOT NULL AND lower(g) NOT IN (SELECT lower(p_brand) FROM part)),
 agg AS (SELECT c.dataset_id, c.pos, c.status, c.confidence, c.pos % 5 AS proposed, (SELECT COUNT(*) FROM kept k WHERE k.dataset_id=c.dataset_id AND k.pos=c.pos) AS routes,
   EXISTS (SELECT 1 FROM judged j WHERE j.dataset_id=c.dataset_id AND j.pos=c.pos AND j.absent AND j.possible) AS has_absent,
   EXISTS (SELECT 1 FROM ug WHERE ug.dataset_id=c.dataset_id AND ug.pos=c.pos) AS has_unknown, cited_col IS NULL AND cited_key IS NULL AND cited_gene IS NULL AS uncited FROM claims c),
 fl AS (SELECT *, status = 'active' AND proposed > 0 AND routes = 0 AS all_pruned, status = 'active' AND proposed = 0 AND routes = 0 AND uncited AS nothing FROM agg)"""


@query("claim_demotion", "WITH " + CLAIMS + DEMOTE + """ SELECT dataset_id, pos, CASE WHEN has_absent OR has_unknown OR all_pruned OR nothing THEN 'low' ELSE confidence END AS confidence,
 CAST(has_absent AS BIGINT) + CAST(has_unknown AS BIGINT) + CAST(all_pruned AS BIGINT) + CAST(nothing AS BIGINT) AS reasons, routes FROM fl""")
def claim_demotion(spark, sf):
    claims, columns, _, levels = claim_view(spark, sf)
    features = views.brand_features(spark, sf)
    d = cl.demote(cl.prune_routes(claims, columns, levels), cl.unknown_genes(claims, features))
    starts = ["Labels not", "Features not", "No route left", "Cites nothing"]
    reasons = sum(F.coalesce(F.contains("note", F.lit(s)), F.lit(False)).cast("long") for s in starts)
    return d.select("dataset_id", "pos", "confidence", reasons.alias("reasons"), F.size("checks").cast("long").alias("routes"))


@query("unique_claim_ids")
def unique_claim_ids(spark, sf):
    """Sequential renaming has no set-based SQL; a brute-force test checks it."""
    claims, _, _, _ = claim_view(spark, sf)
    return cl.unique_ids(claims).select("dataset_id", "pos", "id")


@query("extraction_assessment", "WITH " + CLAIMS + """, a AS (SELECT dataset_id, COUNT(*) FILTER (status='active' AND EXISTS (SELECT 1 FROM kept k WHERE k.dataset_id=c.dataset_id AND k.pos=c.pos)) AS auditable FROM claims c GROUP BY 1),
 e AS (SELECT dataset_id, COUNT(*) FILTER (key % 3 <> 0) AS evidence FROM keys GROUP BY 1)
 SELECT dataset_id, auditable, evidence, auditable = 0 AND evidence > 0 AS suspiciously_empty FROM a JOIN e USING (dataset_id)""")
def extraction_assessment(spark, sf):
    claims, columns, keys, levels = claim_view(spark, sf)
    k = F.col("key").cast("int")
    kinds = keys.withColumn(
        "kind", F.when(k % 3 == 0, F.lit("unknown")).when(k % 3 == 1, F.lit("de_result")).otherwise(F.lit("marker_table"))
    )
    return cl.assess(cl.prune_routes(claims, columns, levels), kinds)


RUNS = ", runs AS (SELECT * FROM rt WHERE status = 'active' AND ck BETWEEN 1 AND 8)"


@query("run_expansion", "WITH " + CLAIMS + RUNS + " SELECT dataset_id, pos, id || '::' || CAST(ck AS VARCHAR) AS key, text, CAST(ck AS INTEGER) AS \"check\" FROM runs")
def run_expansion(spark, sf):
    claims, _, _, _ = claim_view(spark, sf)
    return cl.runs_from(claims).select("dataset_id", "pos", "key", "text", "check")


@query("routed_checks", "WITH " + CLAIMS + RUNS + " SELECT DISTINCT dataset_id, CAST(ck AS INTEGER) AS \"check\" FROM runs")
def routed_checks(spark, sf):
    claims, _, _, _ = claim_view(spark, sf)
    return cl.routed_checks(claims)


@query("owning_claims", "WITH " + CLAIMS + RUNS + """, nr AS (SELECT dataset_id, pos, id, ck, COUNT(*) OVER (PARTITION BY dataset_id, pos) AS n FROM runs)
 SELECT dataset_id, CAST(ck AS INTEGER) AS "check", id AS claim_id, CAST(n AS INTEGER) AS n_routes FROM nr QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset_id, ck ORDER BY n, pos) = 1""")
def owning_claims(spark, sf):
    claims, _, _, _ = claim_view(spark, sf)
    return cl.owner_claim(claims)


PREPARED = """, pr AS (SELECT *, ck IN (1,5,6,8) AS k_alpha, ck IN (1,2,4,8) AS k_grouping, ck = 1 AS k_gene,
   CASE WHEN p_cluster IS NOT NULL AND ck = 2 THEN 'target_group' WHEN p_cluster IS NOT NULL AND ck = 3 THEN 'track' WHEN p_cluster IS NOT NULL THEN 'cluster' END AS ckey FROM runs)"""


@query("prepared_runs", "WITH " + CLAIMS + RUNS + PREPARED + """ SELECT dataset_id, pos, rpos, CAST(ck AS INTEGER) AS "check",
 CASE WHEN k_alpha AND p_alpha = '0.01' THEN '0.01' WHEN k_alpha THEN '0.05' END AS alpha, CASE WHEN k_grouping THEN p_grouping END AS grouping, CASE WHEN ck = 2 THEN p_cluster END AS target_group,
 CASE WHEN ck = 3 THEN coalesce(p_cluster, '') END AS track,
 concat_ws(',', CASE WHEN p_alpha IS NOT NULL AND (NOT k_alpha OR p_alpha = 'tiny') THEN 'alpha' END, CASE WHEN ckey = 'cluster' THEN 'cluster' END, CASE WHEN p_gene IS NOT NULL AND NOT k_gene THEN 'gene' END,
   CASE WHEN NOT k_grouping THEN 'grouping' END) AS unmapped FROM pr""")
def prepared_runs(spark, sf):
    claims, _, _, _ = claim_view(spark, sf)
    indexed = claims.withColumn(
        "checks",
        F.transform("checks", lambda r, i: F.struct(r["check"].alias("check"), F.map_concat(r["params"], F.create_map(F.lit("reported"), i.cast("string"))).alias("params"))),
    )
    p = cl.prepare_runs(indexed)
    return p.select(
        "dataset_id",
        "pos",
        F.col("params")["reported"].cast("int").alias("rpos"),
        "check",
        *[F.col("config")[c].alias(c) for c in ("alpha", "grouping", "target_group", "track")],
        F.concat_ws(",", "unmapped").alias("unmapped"),
    )


@query("parameter_aliases", "WITH " + CLAIMS + RUNS + PREPARED + " SELECT ckey AS key, CAST(ck AS INTEGER) AS \"check\", COUNT(*) AS n FROM pr WHERE ckey IS NOT NULL GROUP BY 1, 2")
def parameter_aliases(spark, sf):
    claims, _, _, _ = claim_view(spark, sf)
    r = cl.alias_params(cl.runs_from(claims))
    return (
        r.select("check", F.explode(F.map_keys("params")).alias("key"))
        .filter(F.col("key").isin("cluster", "target_group", "track"))
        .groupBy("key", "check")
        .agg(F.count("*").alias("n"))
    )
