"""Role views: the given tables seen as audited datasets.

Orders are the observations, nations the replicate units nested in regions, and brands
the features: the summed quantity of a brand in an order is its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.dataset import Dataset, case_key
from plumbline.session import keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: unit = nation, group = region, technical columns, states."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            case_key("orders", "o_orderstatus").alias("case_id"),
            F.col("o_orderkey").cast("string").alias("cell_id"),
            F.col("n_name").alias("unit"),
            F.col("r_name").alias("region"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_totalprice").alias("price"),
            F.col("o_custkey").cast("string").alias("customer"),
            F.concat(
                F.lit("B"),
                F.when(F.col("o_orderkey") % 10 < 5, F.substring("r_name", 1, 2)).otherwise(F.substring("o_orderpriority", 1, 1)),
            ).alias("batch"),
        )
    )


def brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Long counts: quantity of each brand in each order; absent pairs are zero."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        l.select("l_orderkey", "l_partkey", "l_quantity")
        .join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").cast("string").alias("cell_id"), F.col("p_brand").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
        .withColumn("layer", F.lit("counts"))
    )


def brand_features(spark: SparkSession, sf: str) -> DataFrame:
    """Brands in name order; the single-digit ones play the flagged (`mt`) features."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()
    return brands.withColumn("pos", F.regexp_extract("gene", r"(\d+)", 1).cast("int") - 1).withColumn(
        "mt", F.col("pos") < 3
    )


def order_dataset(spark: SparkSession, sf: str) -> Dataset:
    """Counts here are derived by a join, and a check reads them several times, so they are written once: plans start from there."""
    return Dataset(order_cells(spark, sf), keep(brand_counts(spark, sf), "counts"), brand_features(spark, sf))


def crossed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items: supplier units crossed with the return flag, line status technical."""
    return table(spark, sf, "lineitem").select(
        case_key("items", "l_returnflag").alias("case_id"),
        F.col("l_suppkey").cast("string").alias("unit"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_extendedprice").alias("value"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_orderkey",
    )


def embedding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        case_key("vectors", "vec_id").alias("case_id"),
        F.col("vec_id").cast("string").alias("cell_id"),
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        "label",
    )


SETTINGS = list(range(2, 12))


def labelled(emb: DataFrame, shift: Column) -> DataFrame:
    """Ten deterministic clusterings per vector: label or shifted id modulo k, as one array per row."""
    vec = F.col("vec_id") + shift
    picks = [(F.col("label") if k % 2 else F.when(vec % 10 < 6, F.col("label")).otherwise(vec)) % k for k in SETTINGS]
    return emb.withColumn("labels", F.array(*[p.cast("long").cast("string") for p in picks]))


def settings_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(embedding(spark, sf), F.lit(0))


REPEATS = 40


def repeat_labels(spark: SparkSession, sf: str) -> DataFrame:
    """REPEATS sweeps `r`, each over every vector."""
    each = embedding(spark, sf).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    return labelled(each, F.col("r"))


def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(l, "doc_id").withColumn("case_id", case_key("documents", "lang"))
