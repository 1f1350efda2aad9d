"""What a dataset holds: raw counts, stored results, feature names, a usable design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.operators import ordered

# Where raw counts are looked for, in order of preference.
COUNT_LAYERS = ("counts", "count", "raw_counts", "umi", "raw", "main")


def count_shape(layers: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per layer: finite values non-negative and within 1e-6 of whole numbers."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return (
        layers.groupBy(*by, "layer")
        .agg(F.min(v).alias("low"), F.max(F.abs(v - F.rint(v))).alias("off"), F.count(v).alias("finite"))
        .withColumn("is_counts", F.coalesce((F.col("finite") > 0) & (F.col("low") >= 0) & (F.col("off") < 1e-6), F.lit(False)))
    )


def find_counts(layers: DataFrame) -> DataFrame:
    """One row: the preferred layer that holds counts (null when none does) and the gate."""
    rank = F.array_position(F.array(*[F.lit(x) for x in COUNT_LAYERS]), F.lower("layer"))
    usable = count_shape(layers).filter(F.col("is_counts") & (rank > 0))
    return usable.agg(F.min_by("layer", rank).alias("source")).withColumn("ok", F.col("source").isNotNull())


def strided_sample(df: DataFrame, order: str, n: int = 400) -> DataFrame:
    """At most n rows at evenly spaced positions of a numeric order; null keys come last, equal keys one after another."""
    total = df.count()
    if total <= n:
        return df
    at = sorted({int(i * (total - 1) / (n - 1)) + 1 for i in range(n)})
    keyed = df.withColumn("__key", F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("key")))
    return ordered.row_position(keyed, "__key", "__p").filter(F.col("__p").isin(at)).drop("__key", "__p")


def cap_unique(rows: DataFrame, key: list[str], value: str, order: Column, n: int) -> DataFrame:
    """First n distinct non-empty values per key, by first appearance."""
    firsts = rows.filter(F.col(value) != "").groupBy(*key, value).agg(F.min(order).alias("__f"))
    return ordered.top_k(firsts, key, [F.asc("__f"), F.asc(value)], n, out="rank").drop("__f")


def classify_stored(stored: DataFrame, by: list[str] = ()) -> DataFrame:
    """marker_table / de_result / unknown per stored result; scalars (no position) are skipped."""
    norm = L.norm_name_col(F.col("column"))
    per = (
        stored.filter(F.col("pos").isNotNull())
        .withColumn("__c", norm)
        .groupBy(*by, "key")
        .agg(
            F.bool_or((F.col("__c") == "names") & F.col("group").isNotNull()).alias("grouped"),
            F.bool_or(F.col("__c").isin(*L.STATISTIC_NAMES)).alias("has_stat"),
            F.bool_or(F.col("__c").isin(*L.GENE_COLUMN_NAMES, "__index__") & F.col("str").isNotNull()).alias("has_gene"),
            F.count_distinct("column").alias("columns"),
            F.count_distinct("group").alias("groups"),
        )
    )
    kind = (
        F.when(F.col("grouped"), F.lit("marker_table"))
        .when(F.col("has_stat") & F.col("has_gene"), F.lit("de_result"))
        .otherwise(F.lit("unknown"))
    )
    return per.select(*by, "key", kind.alias("kind"), "columns", "groups")


def stored_genes(stored: DataFrame, kinds: DataFrame, cap: int = 200, per_group: int = 50) -> DataFrame:
    """Feature names of each recognised result: 50 per group for marker tables, 200 in all."""
    rows = stored.withColumn("__c", L.norm_name_col(F.col("column"))).filter(
        F.col("__c").isin(*L.GENE_COLUMN_NAMES, "__index__") & F.col("str").isNotNull() & F.col("pos").isNotNull()
    )
    rows = rows.join(kinds.filter("kind != 'unknown'").select("key", "kind"), "key")
    marker = ordered.top_k(rows.filter("kind = 'marker_table'"), ["key", "group"], [F.asc("pos"), F.asc("str")], per_group)
    both = marker.unionByName(rows.filter("kind = 'de_result'"))
    return cap_unique(both, ["key"], "str", F.struct(F.coalesce("group", F.lit("")), "pos"), cap)


def cluster_fields(typed: DataFrame) -> DataFrame:
    """Categorical columns of 2..100 levels named like clusterings."""
    return typed.filter(
        (F.col("dtype") == "categorical") & F.col("levels").between(2, 100) & L.hits_col(F.col("norm"), L.DERIVED_WORDS)
    )


def inventory(
    cells: DataFrame, typed: DataFrame, layers: DataFrame, features: DataFrame, kinds: DataFrame, embeddings: list[str] | None = None
) -> DataFrame:
    """One row describing a dataset: sizes, columns, stored results, clusterings, layers.

    `embeddings` names the dataset's embeddings, if it tells them; they follow as a sorted column.
    """
    extra = [] if embeddings is None else [F.array(*[F.lit(e) for e in sorted(embeddings)]).cast("array<string>").alias("embeddings")]
    seen = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "column"))), lambda s: s["column"]
    )
    cols = typed.agg(F.max("n").alias("n_cells"), seen.alias("columns"))
    clusters = cluster_fields(typed).agg(seen.alias("cluster_fields"))
    names = features.agg(F.count("*").alias("n_genes"))
    head = features.orderBy("pos").limit(50).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda s: s["gene"]).alias("feature_sample")
    )
    layer_names = layers.select("layer").distinct().agg(F.array_sort(F.collect_list("layer")).alias("layers"))
    results = kinds.agg(F.array_sort(F.collect_list(F.struct("key", "kind"))).alias("stored"))
    one = lambda d, c: d.select(c).scalar()
    return cols.select(
        "n_cells",
        one(names, "n_genes").alias("n_genes"),
        "columns",
        one(clusters, "cluster_fields").alias("cluster_fields"),
        one(find_counts(layers), "source").alias("counts_source"),
        one(find_counts(layers), "ok").alias("has_raw_counts"),
        one(layer_names, "layers").alias("layers"),
        one(results, "stored").alias("stored"),
        one(head, "feature_sample").alias("feature_sample"),
        *extra,
    )


def has_field(refs: DataFrame, column: str, inventory_columns: DataFrame) -> DataFrame:
    """References to columns the inventory holds (exact, case-sensitive)."""
    known = inventory_columns.select(F.col("name").alias(column)).distinct()
    return refs.join(known, column, "left_semi")


def knows_gene(refs: DataFrame, gene: str, features: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """References to known features: trimmed and case-insensitive, over every feature name."""
    names = features.select(F.lower(F.trim("gene")).alias("__g"))
    if stored is not None:
        names = names.union(stored.select(F.lower(F.trim("str"))))
    return refs.withColumn("__g", F.lower(F.trim(gene))).join(names.distinct(), "__g", "left_semi").drop("__g")


def feature_lookup(wanted: DataFrame, features: DataFrame) -> DataFrame:
    """Exact name first, else the first case-insensitive match; unknown names stay null."""
    exact = features.groupBy(F.col("gene").alias("name")).agg(F.min("pos").alias("__e"))
    loose = features.groupBy(F.lower("gene").alias("__l")).agg(F.min("pos").alias("__p"))
    return (
        wanted.join(exact, "name", "left")
        .withColumn("__l", F.lower("name"))
        .join(loose, "__l", "left")
        .withColumn("pos", F.coalesce("__e", "__p"))
        .drop("__e", "__p", "__l")
    )


def describe_design(cells: DataFrame, by: list[str], unit: str, grouping: str, has_counts: bool, n_genes: int) -> DataFrame:
    """Levels, cells and units of the comparison, and which families of checks can run."""
    from plumbline.operators.reduce import two_arms

    samples = cells.groupBy(*by, grouping, unit).agg(F.count("*").alias("n"))
    per_level = samples.groupBy(*by, F.col(grouping).alias("level")).agg(
        F.count("*").alias("units"), F.sum("n").alias("cells")
    )
    totals = per_level.groupBy(*by).agg(F.count("*").alias("levels"), F.sum("cells").alias("n_cells"))
    units = samples.groupBy(*by, unit).agg(F.lit(1).alias("x")).groupBy(*by).agg(F.count("*").alias("total_units"))
    arms = two_arms(cells, grouping, by)
    compared = (
        per_level.join(arms.select(*by, "ref", "alt"), by)
        .filter((F.col("level") == F.col("ref")) | (F.col("level") == F.col("alt")))
        .groupBy(*by, "ref", "alt")
        .agg(F.min("units").alias("min_units"))
    )
    d = totals.join(units, by).join(compared, by, "left").withColumn("min_units", F.coalesce("min_units", F.lit(0)))
    counts, wide = F.lit(has_counts), F.lit(n_genes >= 20)
    return d.select(
        "*",
        ((F.col("levels") >= 2) & (F.col("min_units") >= 2) & counts).alias("can_replicate_test"),
        (counts & wide & (F.col("n_cells") >= 80)).alias("can_split_test"),
        (wide & (F.col("n_cells") >= 80)).alias("can_sweep"),
        (F.col("levels") >= 2).alias("can_confound"),
        F.when(F.col("levels") < 2, F.lit("fewer than two levels to compare"))
        .when(F.col("min_units") < 2, F.format_string("%d replicate in an arm, two needed", F.col("min_units")))
        .when(~counts, F.lit("no raw counts"))
        .otherwise(F.lit("ready"))
        .alias("replicate_reason"),
    )


def state_candidates(fields: DataFrame, grouping: str, unit: str) -> DataFrame:
    """Derived columns first, then categorical ones of 2..40 levels that are neither arm nor unit."""
    derived = F.col("role") == "derived"
    other = (F.col("dtype") == "categorical") & F.col("levels").between(2, 40) & ~F.col("id").isin(grouping, unit)
    return fields.filter(derived | other).select(
        "id", F.when(derived, 0).otherwise(1).alias("tier"), "pos"
    )
