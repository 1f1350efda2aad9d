"""Queries over sources, selection, profiles, roles and inventories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.functions import labels as L
from plumbline.operators import inventory as inv
from plumbline.operators import profile as pro
from plumbline.operators import selection as sel
from plumbline.plans import views
from plumbline.plans.registry import query
from plumbline.plans.sqltext import base
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import manifest, tables

BY = ["case_id"]


def scratch(spark, name):
    """A fresh folder on the shared checkpoint store."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------
@query("dataset_store_and_load", base() + "SELECT unit, gene, COUNT(*) AS n, SUM(value) AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2")
def dataset_store_and_load(spark, sf):
    path = scratch(spark, "dataset")
    tables.save(views.order_dataset(spark, sf), path)
    ds = tables.load(spark, path)
    return ds.counts.join(ds.cells, "cell_id").groupBy("unit", "gene").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("dataset_metadata_only", base() + "SELECT (SELECT COUNT(*) FROM cells) AS n_cells, (SELECT COUNT(DISTINCT p_brand) FROM part) AS n_genes, CAST(10 AS BIGINT) AS n_columns")
def dataset_metadata_only(spark, sf):
    path = scratch(spark, "metadata")
    ds = views.order_dataset(spark, sf)
    tables.save(Dataset(ds.cells, None, ds.features), path)
    meta = tables.load_metadata(spark, path)
    n_genes = meta.features.agg(F.count("*").alias("n")).scalar()
    return meta.cells.agg(
        F.count("*").alias("n_cells"),
        F.max(n_genes).alias("n_genes"),
        F.lit(len(meta.cells.columns)).cast("long").alias("n_columns"),
    )


@query("csv_summary_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_summary_table(spark, sf):
    path = scratch(spark, "csv")
    views.table(spark, sf, "supplier").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("json_safe_results", "SELECT event_id, CASE WHEN value >= 20 AND value < 80 THEN value END AS value FROM events")
def json_safe_results(spark, sf):
    """Non-finite and undefined results leave the file as absent fields."""
    path = scratch(spark, "json")
    v = F.col("value")
    e = views.table(spark, sf, "events").select(
        "event_id", F.when(v < 20, F.lit(float("nan"))).when(v >= 80, F.lit(float("inf"))).otherwise(v).alias("value")
    )
    tables.write_results(e, path)
    return spark.read.schema("event_id long, value double").json(path)


@query("case_manifest", """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS case_id, n_name AS foil, 'nation' AS unit, CASE WHEN n_nationkey % 5 <> 0 THEN 'region' END AS grouping,
 CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.05 ELSE 0.01 END AS DOUBLE) AS alpha, CASE WHEN n_nationkey % 5 = 0 THEN 'missing grouping' END AS error FROM nation""")
def case_manifest(spark, sf):
    """A manifest written from the nation table with mixed field spellings, then read back."""
    path = scratch(spark, "manifest")
    n = views.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    case = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("id"),
        F.when(k % 2 == 1, F.concat(F.lit("n"), k.cast("string"))).alias("case_id"),
        F.col("n_name").alias("path"),
        F.lit("nation").alias("unit_col"),
        F.when(k % 5 != 0, F.lit("region")).alias("group"),
        F.lit("priority").alias("technical"),
        F.lit("segment").alias("stateCol"),
        F.lit("Brand#1").alias("gene"),
        F.lit("BUILDING").alias("tracked"),
        F.when(k % 2 == 1, F.lit("0.01")).alias("alpha"),
    )
    n.agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value")).write.text(path)
    files = manifest.read_cases(spark, path, {"alpha": 0.05})
    return files.select("case_id", "foil", "unit", "grouping", "alpha", "error")


LAYERS = """layers AS (SELECT 'main' AS layer, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'umi', l_quantity FROM lineitem
 UNION ALL SELECT 'raw', l_quantity FROM lineitem UNION ALL SELECT 'lognorm', ln(1+l_quantity) FROM lineitem UNION ALL SELECT 'counts', l_discount FROM lineitem)"""


def layered(spark, sf):
    l = views.table(spark, sf, "lineitem")
    pick = F.array(
        *[
            F.struct(F.lit(n).alias("layer"), c.alias("value"))
            for n, c in (
                ("main", F.col("l_extendedprice")),
                ("umi", F.col("l_quantity")),
                ("raw", F.col("l_quantity")),
                ("lognorm", F.log1p("l_quantity")),
                ("counts", F.col("l_discount")),
            )
        ]
    )
    return l.select(F.explode(pick).alias("s")).select("s.layer", "s.value")


@query("count_shape_by_layer", "WITH " + LAYERS + " SELECT layer, COUNT(*) AS finite, MIN(value) >= 0 AND MAX(abs(value - round_even(value, 0))) < 1e-6 AS is_counts FROM layers GROUP BY 1")
def count_shape_by_layer(spark, sf):
    return inv.count_shape(layered(spark, sf)).select("layer", "finite", "is_counts")


@query("raw_count_locator", "WITH " + LAYERS + """, s AS (SELECT layer FROM layers GROUP BY 1 HAVING MIN(value) >= 0 AND MAX(abs(value - round_even(value, 0))) < 1e-6)
 SELECT layer AS source, true AS ok FROM s WHERE layer IN ('counts','count','raw_counts','umi','raw','main') ORDER BY list_position(['counts','count','raw_counts','umi','raw','main'], layer) LIMIT 1""")
def raw_count_locator(spark, sf):
    return inv.find_counts(layered(spark, sf))


@query("strided_sample", """WITH p AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders),
 a AS (SELECT DISTINCT CAST(floor(i * ((SELECT COUNT(*) FROM orders) - 1) / 399.0) AS BIGINT) + 1 AS rn FROM range(0, 400) r(i)) SELECT o_orderkey, o_totalprice FROM p JOIN a USING (rn)""")
def strided_sample(spark, sf):
    return inv.strided_sample(views.table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


# --- selection -----------------------------------------------------------------------
@query("stratified_cap", """SELECT l_returnflag, o_orderpriority, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM (
 SELECT DISTINCT l_returnflag, o_orderpriority, o_orderkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
 JOIN (SELECT l_returnflag, o_orderpriority, o_orderkey FROM (SELECT l_returnflag, o_orderpriority, o_orderkey, ROW_NUMBER() OVER (PARTITION BY l_returnflag, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) AS rn
  FROM (SELECT DISTINCT l_returnflag, o_orderpriority, o_orderkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey)) WHERE rn <= 1400) USING (l_returnflag, o_orderpriority, o_orderkey) GROUP BY 1, 2""")
def stratified_cap(spark, sf):
    l, o = views.table(spark, sf, "lineitem"), views.table(spark, sf, "orders")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).select("l_returnflag", "o_orderpriority", "o_orderkey").distinct()
    kept = sel.stratified_cap(rows, ["l_returnflag", "o_orderpriority"], "o_orderkey", 1400, 7)
    return kept.groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("control_contrast", """SELECT CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'non-targeting' ELSE 'Widget-KD' END AS condition, COUNT(*) AS n, round(SUM(l_quantity), 2) AS qty
 FROM lineitem JOIN part ON l_partkey=p_partkey WHERE contains(lower(p_name), 'widget') OR contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') GROUP BY 1""")
def control_contrast(spark, sf):
    l, p = views.table(spark, sf, "lineitem"), views.table(spark, sf, "part")
    col = sel.first_present(p.columns, ["guide", "P_NAME"], fold_case=True)
    rows = sel.build_contrast(p, col, "Widget", ["RING", "bolt"])
    return l.join(rows, l.l_partkey == rows.p_partkey).groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("design_summary", """SELECT CAST(o_custkey AS VARCHAR) AS donor, arg_min(o_orderpriority, o_orderkey) AS priority, arg_min(o_orderstatus, o_orderkey) AS status,
 array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS conditions, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS runs, COUNT(*) AS samples FROM orders GROUP BY 1""")
def design_summary(spark, sf):
    o = views.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("donor"),
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    o = o.withColumn("c", F.col("status")).withColumn("r", F.col("priority"))
    d = sel.design_summary(o, "donor", "o_orderkey", ["priority", "status"], "c", "r")
    return d.withColumn("conditions", F.concat_ws(",", "conditions")).withColumn("runs", F.concat_ws(",", "runs"))


DE = """de AS (SELECT p_brand AS gene, l_returnflag AS condition, COUNT(*) AS n_cells, CAST(SUM(l_quantity) AS BIGINT) AS n_de, round(AVG(l_discount) - 0.05, 6) AS effect,
 AVG(l_discount) > 0.05 AS significant, CASE WHEN AVG(l_tax) > 0.04 THEN 'high' ELSE 'low' END AS category FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1, 2)"""


def de_table(spark, sf):
    l, p = views.table(spark, sf, "lineitem"), views.table(spark, sf, "part")
    return (
        l.join(p, l.l_partkey == p.p_partkey)
        .groupBy(F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("condition"))
        .agg(
            F.count("*").alias("n_cells"),
            F.sum("l_quantity").cast("long").alias("n_de"),
            F.round(F.avg("l_discount") - 0.05, 6).alias("effect"),
            (F.avg("l_discount") > 0.05).alias("significant"),
            F.when(F.avg("l_tax") > 0.04, F.lit("high")).otherwise(F.lit("low")).alias("category"),
        )
    )


@query("perturbation_summary", "WITH " + DE + " SELECT gene, " + ", ".join(
    f"MAX(CASE WHEN condition='{c}' THEN {m} END) AS \"{c}_{m}\"" for c in "ANR" for m in ("n_cells", "n_de", "effect", "significant", "category")
) + " FROM de WHERE gene IN ('Brand#1','Brand#12','Brand#25','Brand#77') GROUP BY 1")
def perturbation_summary(spark, sf):
    genes = ["Brand#1", "Brand#12", "Brand#25", "Brand#77"]
    measures = ["n_cells", "n_de", "effect", "significant", "category"]
    return sel.perturbation_summary(de_table(spark, sf), genes, ["A", "N", "R"], measures)


@query("significance_totals", "WITH " + DE + " SELECT COUNT(*) FILTER (significant) AS significant, COUNT(*) AS rows FROM de")
def significance_totals(spark, sf):
    return sel.significance_totals(de_table(spark, sf))


# --- profiles and roles --------------------------------------------------------------
def role_cells(spark, sf):
    """Orders under design-like column names, with one technical column nested in the groups."""
    c = views.order_cells(spark, sf)
    return c.select(
        F.col("cell_id").cast("long").alias("row"),
        F.col("cell_id").alias("cell_barcode"),
        F.col("unit").alias("donor_id"),
        F.col("region").alias("condition"),
        F.concat(F.lit("L"), F.substring("region", 1, 2)).alias("lane"),
        F.col("priority").alias("seq.run"),
        F.col("segment").alias("leiden"),
        F.col("status").alias("phase"),
        F.when(F.col("price") > 1000, F.col("price")).alias("total_counts"),
        F.when(F.col("price") > 200000, F.col("status")).alias("kind"),
        "customer",
    )


COLS = ["cell_barcode", "donor_id", "condition", "lane", "seq.run", "leiden", "phase", "total_counts", "kind", "customer"]
ROLE_CELLS = """rc AS (SELECT CAST(cell_id AS BIGINT) AS row, cell_id AS cell_barcode, unit AS donor_id, region AS condition, 'L' || substr(region, 1, 2) AS lane, priority AS "seq.run",
 segment AS leiden, status AS phase, CASE WHEN price > 1000 THEN price END AS total_counts, CASE WHEN price > 200000 THEN status END AS kind, customer FROM cells)"""
PROFILE = "pf AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{c}' AS col, {'true' if c == 'total_counts' else 'false'} AS is_numeric, {'true' if c == 'total_counts' else 'false'} AS is_float, COUNT(DISTINCT "{c}") AS nunique, COUNT(*) - COUNT("{c}") AS missing, COUNT(*) AS n,
 {"''" if c == 'total_counts' else f'''(SELECT string_agg(v, ' · ' ORDER BY f, v) FROM (SELECT "{c}" AS v, MIN(row) AS f FROM rc WHERE "{c}" IS NOT NULL GROUP BY 1 ORDER BY f, v LIMIT 3))'''} AS head FROM rc"""
    for i, c in enumerate(COLS)) + ")"


def words_sql(words, col="norm"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


TYPED = f"""ty AS (SELECT *, CASE WHEN {words_sql(L.DERIVED_WORDS)} THEN 'categorical' WHEN {words_sql(L.BARCODE_WORDS)} THEN 'identifier'
  WHEN NOT is_numeric AND nunique >= greatest(0.9*n, n-1) AND nunique > 1 THEN 'identifier' WHEN is_numeric AND (is_float OR nunique > 12) THEN 'numeric' ELSE 'categorical' END AS dtype
  FROM (SELECT *, replace(replace(replace(lower(trim(col)), '.', '_'), '-', '_'), ' ', '_') AS norm FROM pf)),
 lv AS (SELECT *, CASE WHEN dtype <> 'numeric' THEN nunique END AS levels FROM ty),
 ro AS (SELECT *, CASE WHEN dtype='identifier' THEN 'observation/high' WHEN dtype='numeric' THEN CASE WHEN {words_sql(L.COVARIATE_WORDS)} THEN 'covariate/high' ELSE 'covariate/medium' END
  WHEN {words_sql(L.DERIVED_WORDS)} THEN 'derived/medium' WHEN {words_sql(L.CYCLE_WORDS)} THEN 'nuisance/low'
  WHEN {words_sql(L.GROUPING_WORDS)} THEN CASE WHEN levels BETWEEN 2 AND 6 THEN 'grouping/high' ELSE 'grouping/medium' END
  WHEN {words_sql(L.UNIT_WORDS)} THEN CASE WHEN levels BETWEEN 2 AND 64 THEN 'unit/high' ELSE 'unit/medium' END
  WHEN {words_sql(L.NUISANCE_WORDS)} THEN 'nuisance/medium' WHEN {words_sql(L.DEMOGRAPHIC_WORDS)} THEN 'nuisance/low'
  WHEN levels BETWEEN 2 AND 3 THEN 'grouping/low' WHEN levels BETWEEN 4 AND 64 THEN 'unit/low' ELSE 'ignore/low' END AS rc2 FROM lv)"""


@query("column_profile", base(ROLE_CELLS, PROFILE) + "SELECT col AS \"column\", is_numeric, is_float, nunique, CAST(missing AS BIGINT) AS missing, n, head FROM pf")
def column_profile(spark, sf):
    p = pro.profile_columns(role_cells(spark, sf), "row", COLS)
    head = F.when(F.col("is_numeric"), F.lit("")).otherwise(F.concat_ws(" · ", "head"))
    return p.select("column", "is_numeric", "is_float", "nunique", "missing", "n", head.alias("head"))


@query("column_roles", base(ROLE_CELLS, PROFILE, TYPED) + "SELECT col AS \"column\", dtype, levels, split_part(rc2, '/', 1) AS role, split_part(rc2, '/', 2) AS confidence FROM ro")
def column_roles(spark, sf):
    p = pro.classify_roles(pro.column_dtypes(pro.profile_columns(role_cells(spark, sf), "row", COLS)))
    return p.select("column", "dtype", "levels", "role", "confidence")


ALIGN = """al AS (SELECT 'lane' AS col, 1.0 AS hit UNION ALL SELECT col, 0.0 FROM ro WHERE col <> 'lane'),
 fs AS (SELECT ro.*, CASE WHEN split_part(rc2,'/',1)='nuisance' AND hit=1.0 AND split_part(rc2,'/',2)='low' THEN 'medium' ELSE split_part(rc2,'/',2) END AS conf FROM ro JOIN al USING (col))"""


@query("resolved_fields", base(ROLE_CELLS, PROFILE, TYPED, ALIGN) + """SELECT col AS id, dtype, levels, CAST(missing AS BIGINT) AS missing, split_part(rc2, '/', 1) AS role, conf AS confidence, CASE WHEN dtype <> 'numeric' AND nunique <= 200 AND head <> '' THEN head END AS sample,
 col = 'lane' AS aligned FROM fs""")
def resolved_fields(spark, sf):
    f = pro.resolve_fields(role_cells(spark, sf), "row", COLS)
    return f.select("id", "dtype", "levels", "missing", "role", "confidence", "sample", F.col("reason").startswith("Lines up").alias("aligned"))


@query("nuisance_alignment", base(ROLE_CELLS, """g AS (SELECT col, a, b, COUNT(*) AS n FROM (SELECT 'lane' AS col, condition AS a, lane AS b FROM rc UNION ALL SELECT 'phase', condition, phase FROM rc UNION ALL SELECT 'seq.run', condition, "seq.run" FROM rc) GROUP BY ALL),
 r AS (SELECT col, a, SUM(n) AS ra FROM g GROUP BY ALL), c AS (SELECT col, b, SUM(n) AS cb FROM g GROUP BY ALL)""")
 + """SELECT col AS "column", round(sqrt(greatest(SUM(n*n/(ra*CAST(cb AS DOUBLE))) - 1, 0)/(least(COUNT(DISTINCT a), COUNT(DISTINCT b))-1)), 9) AS v FROM g JOIN r USING (col, a) JOIN c USING (col, b) GROUP BY col""")
def nuisance_alignment(spark, sf):
    from plumbline.operators.association import technical_scores

    cells = role_cells(spark, sf).withColumn("k", F.lit(1))
    s = technical_scores(cells, ["k"], "condition", ["lane", "phase", "seq.run"])
    return s.select("column", F.round("v", 9).alias("v"))


# --- stored results, features, inventory -----------------------------------------------
def stored_results(spark, sf):
    """Ranked part lists per nation in four stored shapes, plus one scalar per nation."""
    s, l, p = (views.table(spark, sf, t) for t in ("supplier", "lineitem", "part"))
    rows = (
        l.join(s, l.l_suppkey == s.s_suppkey)
        .join(p, l.l_partkey == p.p_partkey)
        .groupBy("s_nationkey", "p_type", "p_partkey", "p_name")
        .agg(F.sum("l_quantity").alias("num"))
    )
    kind = F.col("s_nationkey") % 4
    col = F.when(kind == 0, "names").when(kind == 1, "Gene.Name").when(kind == 2, "gene").otherwise("index_name")
    stat = F.when(kind == 0, "scores").when(kind == 1, "log2FoldChange").when(kind == 2, "mean").otherwise("p-adj")
    key = F.concat(F.lit("res"), F.col("s_nationkey").cast("string"))
    name = F.concat_ws("-", "p_name", (F.col("p_partkey") % 97).cast("string"))
    group = F.when(kind == 0, F.col("p_type"))
    both = F.array(
        F.struct(col.alias("column"), F.lit(None).cast("double").alias("num"), name.alias("str")),
        F.struct(stat.alias("column"), F.col("num"), F.lit(None).cast("string").alias("str")),
    )
    body = rows.select(
        key.alias("key"), group.alias("group"), F.col("p_partkey").cast("int").alias("pos"), F.explode(both).alias("s")
    ).select("key", "s.column", "group", "pos", F.lit(None).cast("string").alias("gene"), "s.num", "s.str")
    scalars = s.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("num")).select(
        F.concat(F.lit("scalar"), F.col("s_nationkey").cast("string")).alias("key"),
        F.lit("total").alias("column"),
        F.lit(None).cast("string").alias("group"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("string").alias("gene"),
        "num",
        F.lit(None).cast("string").alias("str"),
    )
    return body.unionByName(scalars)


STORED = """sr AS (SELECT s_nationkey AS k, p_type AS ty, p_partkey AS pos, p_name || '-' || CAST(p_partkey % 97 AS VARCHAR) AS nm FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey GROUP BY ALL)"""


@query("stored_result_kinds", "WITH " + STORED + """ SELECT 'res' || CAST(k AS VARCHAR) AS key, CASE k % 4 WHEN 0 THEN 'marker_table' WHEN 1 THEN 'de_result' ELSE 'unknown' END AS kind, CAST(2 AS BIGINT) AS columns,
 CASE WHEN k % 4 = 0 THEN COUNT(DISTINCT ty) ELSE 0 END AS groups FROM sr GROUP BY k""")
def stored_result_kinds(spark, sf):
    return inv.classify_stored(stored_results(spark, sf))


@query("stored_result_features", "WITH " + STORED + """, mk AS (SELECT k, ty, pos, nm FROM sr WHERE k % 4 = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY k, ty ORDER BY pos, nm) <= 50),
 al AS (SELECT k, ty AS g, pos, nm FROM mk UNION ALL SELECT k, '', pos, nm FROM sr WHERE k % 4 = 1),
 fi AS (SELECT k, nm, MIN({'g': g, 'p': pos}) AS f FROM al GROUP BY 1, 2)
 SELECT 'res' || CAST(k AS VARCHAR) AS key, nm AS str, ROW_NUMBER() OVER (PARTITION BY k ORDER BY f, nm) AS rank FROM fi QUALIFY rank <= 200""")
def stored_result_features(spark, sf):
    st = stored_results(spark, sf)
    out = inv.stored_genes(st, inv.classify_stored(st))
    return out.select("key", "str", F.col("rank").cast("long").alias("rank"))


@query("first_values_per_source", """WITH f AS (SELECT source, lang AS v, MIN(doc_id) AS f FROM documents WHERE lang <> '' GROUP BY 1, 2) SELECT source, v AS lang, ROW_NUMBER() OVER (PARTITION BY source ORDER BY f, v) AS rank FROM f QUALIFY rank <= 3""")
def first_values_per_source(spark, sf):
    d = views.table(spark, sf, "documents")
    out = inv.cap_unique(d, ["source"], "lang", F.col("doc_id"), 3)
    return out.select("source", "lang", F.col("rank").cast("long").alias("rank"))


@query("dataset_inventory", base(ROLE_CELLS, PROFILE, TYPED, LAYERS) + """SELECT (SELECT COUNT(*) FROM rc) AS n_cells, (SELECT COUNT(DISTINCT p_brand) FROM part) AS n_genes, (SELECT string_agg(col, ',' ORDER BY pos) FROM pf) AS columns,
 (SELECT string_agg(col, ',' ORDER BY pos) FROM lv WHERE dtype='categorical' AND levels BETWEEN 2 AND 100 AND """ + words_sql(L.DERIVED_WORDS) + """) AS cluster_fields, 'umi' AS counts_source, true AS has_raw_counts,
 (SELECT string_agg(DISTINCT layer, ',' ORDER BY layer) FROM layers) AS layers, (SELECT COUNT(DISTINCT s_nationkey) FROM lineitem JOIN supplier ON l_suppkey=s_suppkey) AS stored""")
def dataset_inventory(spark, sf):
    typed = pro.column_dtypes(pro.profile_columns(role_cells(spark, sf), "row", COLS))
    st = inv.classify_stored(stored_results(spark, sf))
    i = inv.inventory(role_cells(spark, sf), typed, layered(spark, sf), views.brand_features(spark, sf), st)
    join = lambda c: F.concat_ws(",", c).alias(c)
    return i.select("n_cells", "n_genes", join("columns"), join("cluster_fields"), "counts_source", "has_raw_counts", join("layers"), F.size("stored").cast("long").alias("stored"))


@query("feature_lookup", """WITH w AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_brand) WHEN p_size % 3 = 1 THEN p_brand ELSE p_brand || '?' END AS name FROM part),
 f AS (SELECT DISTINCT p_brand AS gene, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) - 1 AS pos FROM part) SELECT name, (SELECT MIN(pos) FROM f WHERE lower(f.gene) = lower(w.name)) AS pos FROM w""")
def feature_lookup(spark, sf):
    p = views.table(spark, sf, "part")
    k = F.col("p_size") % 3
    wanted = p.select(
        F.when(k == 0, F.upper("p_brand")).when(k == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("?"))).alias("name")
    ).distinct()
    return inv.feature_lookup(wanted, views.brand_features(spark, sf))


@query("known_features", """SELECT COUNT(*) AS n FROM part WHERE p_size % 2 = 0""")
def known_features(spark, sf):
    p = views.table(spark, sf, "part").select(
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" "))).otherwise(F.lit("absent")).alias("g")
    )
    return inv.knows_gene(p, "g", views.brand_features(spark, sf)).agg(F.count("*").alias("n"))


@query("known_columns", "SELECT event_type AS name, COUNT(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def known_columns(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("name"))
    held = e.filter(F.col("name").isin("click", "view")).distinct()
    return inv.has_field(e, "name", held).groupBy("name").agg(F.count("*").alias("n"))


@query("design_descriptor", base() + """SELECT (SELECT COUNT(DISTINCT region) FROM cells) AS levels, (SELECT COUNT(*) FROM cells) AS n_cells, (SELECT COUNT(DISTINCT unit) FROM cells) AS total_units, ref, alt,
 (SELECT MIN(u) FROM (SELECT COUNT(DISTINCT unit) AS u FROM kept GROUP BY arm)) AS min_units, true AS can_replicate_test, true AS can_split_test, true AS can_sweep, true AS can_confound, 'ready' AS replicate_reason FROM arms""")
def design_descriptor(spark, sf):
    return inv.describe_design(views.order_cells(spark, sf), BY, "unit", "region", True, 25).drop("case_id")


@query("design_feasibility_by_segment", base() + """SELECT priority, COUNT(DISTINCT status) AS levels, COUNT(*) AS n_cells, COUNT(DISTINCT customer) AS total_units FROM cells GROUP BY 1""")
def design_feasibility_by_segment(spark, sf):
    d = inv.describe_design(views.order_cells(spark, sf), ["priority"], "customer", "status", True, 25)
    return d.select("priority", "levels", "n_cells", "total_units")


@query("state_candidates", base(ROLE_CELLS, PROFILE, TYPED) + """SELECT col AS id, CASE WHEN split_part(rc2,'/',1)='derived' THEN 0 ELSE 1 END AS tier, pos FROM ro
 WHERE split_part(rc2,'/',1)='derived' OR (dtype='categorical' AND levels BETWEEN 2 AND 40 AND col NOT IN ('condition', 'donor_id'))""")
def state_candidates(spark, sf):
    f = pro.resolve_fields(role_cells(spark, sf), "row", COLS)
    return inv.state_candidates(f, "condition", "donor_id")
