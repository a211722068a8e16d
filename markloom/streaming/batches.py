"""The operators on streams: each is a map over documents, so a stream takes them as they are, in
append mode and without a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The files of one table of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def work_dir(spark: SparkSession) -> str:
    """A folder for sinks and checkpoints: under spark.checkpoint.dir, or a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="markloom-")
    return f"{base.rstrip('/')}/markloom/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into Parquet, and reads that."""
    spark, folder = stream.sparkSession, folder or work_dir(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
