"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; fall back to a scratch folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-ckpt-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def settle(df: DataFrame) -> DataFrame:
    """Materialise a result that later stages read several times and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write a result to the shared folder and read it back: a cut whose plan and size start anew.

    A checkpoint keeps the size that the optimizer guessed for its plan; over many rounds that guess grows
    without bound, where a written table has the size of its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete tables written by `keep` that nothing reads any more."""
    for df in kept:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def sweep_up(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more: shuffle files leave the executors' disks only when it collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_scopes: list[list[DataFrame]] = []


def hold(df: DataFrame) -> DataFrame:
    """Keep a reused intermediate; lost blocks are recomputed from lineage."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _scopes:
        _scopes[-1].append(kept)
    return kept


@contextmanager
def scope():
    """Frees what was held inside once the results have become plain values."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            df.unpersist()
