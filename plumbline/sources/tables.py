"""Reading and writing datasets, summary tables and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import COUNTS, EMBEDDING, FEATURES, STORED, Dataset

_SCHEMAS = {"counts": COUNTS, "features": FEATURES, "embedding": EMBEDDING, "stored": STORED}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> Dataset:
    """A dataset folder: cells plus whichever of counts, features, embedding, stored exist."""
    parts = {
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in _SCHEMAS.items()
        if _exists(spark, f"{path}/{name}")
    }
    return Dataset(cells=spark.read.parquet(f"{path}/cells"), **parts)


def load_metadata(spark: SparkSession, path: str) -> Dataset:
    """Everything but the counts: their values are never opened."""
    ds = load(spark, path)
    ds.counts = None
    return ds


def save(ds: Dataset, path: str) -> None:
    """Writes a dataset folder. Counts are sorted by feature inside files, so a feature filter skips row groups."""
    ds.cells.write.mode("overwrite").parquet(f"{path}/cells")
    for name in _SCHEMAS:
        df = getattr(ds, name)
        if df is None:
            continue
        out = df.select([F.col(f.name).cast(f.dataType) for f in _SCHEMAS[name].fields])
        if name == "counts":
            out = out.sortWithinPartitions("gene")
        out.write.mode("overwrite").parquet(f"{path}/{name}")


def save_bucketed(ds: Dataset, prefix: str, buckets: int) -> None:
    """Tables bucketed and sorted on the cell key, so the cells-counts join never shuffles."""
    for name in ("cells", "counts"):
        df = getattr(ds, name)
        if df is not None:
            df.write.mode("overwrite").bucketBy(buckets, "cell_id").sortBy("cell_id").saveAsTable(f"{prefix}_{name}")


def load_bucketed(spark: SparkSession, prefix: str) -> Dataset:
    return Dataset(cells=spark.table(f"{prefix}_cells"), counts=spark.table(f"{prefix}_counts"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A summary table with a header, read under an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null, at any depth the JSON writer would reach."""

    def clean(col, dtype):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: clean(x, dtype.elementType))
        if isinstance(dtype, T.StructType):
            fields = [clean(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        return col

    return df.select([clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are left out of the object."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", True).json(path)
