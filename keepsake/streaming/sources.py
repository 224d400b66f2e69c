"""Event streams from files, and running a stream to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.schemas import RUN_EVENT
from keepsake.session import fresh_path


def event_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet", fmt: str = "parquet",
                 files_per_batch: int = 1000) -> DataFrame:
    """Run events as they arrive in a folder. The schema is explicit, never inferred."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def run_events(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Posted run events (JSON, one per line), flat and with a zone-free time; batch or stream."""
    reader = (spark.readStream if streaming else spark.read).schema(RUN_EVENT)
    return reader.json(folder).select(
        F.col("eventType").alias("event_type"), F.col("pipelineName").alias("pipeline_name"),
        F.col("executionId").alias("execution_id"), F.col("correlationId").alias("correlation_id"), "environment",
        F.col("timestamp").try_cast("timestamp_ntz").alias("ts"), F.col("parameters.sourceLakehouse").alias("source_lakehouse"),
        F.col("parameters.backupLocation").alias("backup_location"), F.col("parameters.backupMode").alias("backup_mode"))


def append_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Writer of an append-only table, for logs, metrics and alerts alike; start it with a trigger."""
    return stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything that is there now, and return the written table."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    query = append_stream(stream, f"{path}/rows", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
