"""Incremental runs over a stream of files: new rows by key, replaced rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.session import remove


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def once_by_content(stream: DataFrame, event_time: str, keys: list[str], delay: str) -> DataFrame:
    """Each content once within the watermark's delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, target: str, key: str, checkpoint: str, order: str) -> StreamingQuery:
    """Keep the latest row of each key, by ``order``, below ``target``; a generation of files for each batch.

    A batch that is run again writes its own generation again, so a restart
    leaves no row twice. :func:`current` reads the latest one; generations
    before the last two are removed.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _generation(spark, target, epoch)
        rows = batch.withColumn("_new", F.lit(1))
        if before is not None:
            rows = spark.read.parquet(f"{target}/g={before}").withColumn("_new", F.lit(0)).unionByName(rows)
        latest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc(), F.xxhash64(*batch.columns))
        merged = rows.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "_new")
        merged.write.mode("overwrite").parquet(f"{target}/g={epoch}")
        while before is not None and (old := _generation(spark, target, before)) is not None:
            remove(spark, f"{target}/g={old}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest generation."""
    return spark.read.parquet(f"{target}/g={_generation(spark, target)}")


def _generation(spark: SparkSession, target: str, below: int | None = None) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("g=")] if fs.exists(path) else []
    return max((g for g in found if below is None or g < below), default=None)
