"""What the operators share: kept tables, skew-proof lookups, measured broadcasts, word sizes."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only below this many rows, counted first; callers keep such rows narrow.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that every executor shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write a narrow result that later steps read several times; the table outlives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete kept tables whose results are kept themselves; nothing may read them any more."""
    for df in kept:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches, rows: int):
    """Arrow batches of at most `rows` rows, so that what a worker holds at once stays small.

    At the end the worker, which waits for other tasks, gives its free memory back.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        batch = None
    pa.default_memory_pool().release_unused()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count shows at most `rows` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: str, of: int) -> Column:
    """crc32 of a key as text, modulo `of`; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, values: list[str], share: int = 1000) -> DataFrame:
    """Left join of rows with one row per key, when a few keys may hold a third of all rows.

    groups: a kept table with unique keys, read three times; `weight` counts the rows of a key.
    Keys with more than 1/share of the weight, fewer than `share` by arithmetic, are broadcast.
    Their rows, and rows with a null key, then carry a spread number, so no task gathers them.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > F.lit(total)
    head = groups.where(hot).select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot"))
    body = groups.select(*keys, *values, F.when(hot, -1).otherwise(0).cast("long").alias("__spread"))
    lone = F.coalesce(F.col("__hot"), F.lit(False))
    for k in keys:
        lone = lone | F.col(k).isNull()
    spread = F.when(lone, F.monotonically_increasing_id() % 65_536 + 1).otherwise(0).cast("long")
    marked = rows.join(F.broadcast(head), keys, "left").withColumn("__spread", spread)
    found = marked.join(body, [*keys, "__spread"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{v}"), F.col(v)).alias(v) for v in values])
