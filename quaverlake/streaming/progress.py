"""Progress events as a stream, and resumable ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.operators.catalogue import insert_if_absent
from quaverlake.session import exists, scratch

PROGRESS = "source string, stage string, track_id string, bytes_delta bigint, completed boolean, failed boolean, skipped boolean, err string, ts timestamp_ntz"


def events(spark: SparkSession, path: str) -> DataFrame:
    """The progress table, a folder or one file, read as a stream of files, once each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(PROGRESS)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name).option("recursiveFileLookup", "true")
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs an append stream over all that is there, and reads what it wrote."""
    at = scratch(spark)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def distinct_events(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Repeated events once, as long as a repeat is not later than ``late``; state is bounded by it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([c for c in stream.columns])


def progress_by_source(distinct: DataFrame) -> DataFrame:
    """Live totals of each source and stage."""
    return distinct.groupBy("source", "stage").agg(
        F.count("*").alias("events"), F.sum(F.coalesce("bytes_delta", F.lit(0))).alias("bytes"), F.count_if("completed").alias("completed"), F.count_if("failed").alias("failed"), F.count_if("skipped").alias("skipped")
    )


def ingest(batch: DataFrame, spark: SparkSession, path: str, *keys: str) -> None:
    """For ``foreachBatch``: appends the rows whose keys the table lacks, so that a repeated batch adds nothing."""
    if not exists(spark, path):
        batch.dropDuplicates(list(keys)).write.parquet(path)
        return
    old = spark.read.parquet(path)
    new = insert_if_absent(batch, old.limit(0), *keys).join(old.select(*keys), list(keys), "left_anti")
    new.write.mode("append").parquet(path)
