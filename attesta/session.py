"""Session construction, table reading and shared scratch storage."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(master)
        .appName("attesta")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables whose rows take long enough to be dealt out before anything is done with them.
HEAVY = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store Spark reads.

    A heavy table that arrives in fewer splits than there are cores (a few
    small files) is dealt out evenly; a large one never is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in HEAVY and df.rdd.getNumPartitions() < min(cores, 64) else df


#: Scratch folders that were named and not yet removed, in order.
_NAMED: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for written intermediates below the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset in a local session (tests) a temporary one of our own
    is used. On a cluster without it this raises: executors share no other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), f"attesta-{os.getuid()}")
        os.makedirs(root, exist_ok=True)
        spark.sparkContext.setCheckpointDir(root)
        root = f"file://{root}"
    path = f"{root.rstrip('/')}/attesta-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders that were named inside once the block ends; results read from them must be written by then."""
    before = len(_NAMED)
    try:
        yield
    finally:
        for path in _NAMED[before:]:
            remove(spark, path)
        del _NAMED[before:]


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished writes; Spark deletes them once nothing refers to their plans."""
    for _ in range(2):  # a finished query is still referred to until its last event has been dealt with
        time.sleep(0.4)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Records in an Arrow batch; with Spark's own bound on bytes a batch of long texts stays small.
BATCH_RECORDS = 512


def bound_batches(spark: SparkSession, records: int = BATCH_RECORDS) -> None:
    """Keep Arrow batches small enough that a batch of very long texts fits a Python worker; smaller bounds that are set already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = (spark.conf.get(key) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
