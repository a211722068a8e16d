"""Where documents come from: columns of tables, and trees of Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_column(df: DataFrame, source: str | Column, *keep: str) -> DataFrame:
    """Documents out of a table: the columns to keep, and `source` as a string; null is empty."""
    text = F.col(source) if isinstance(source, str) else source
    return df.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("source"))


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, source of every Markdown file under a folder, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("source"))


def stream_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """read_markdown() for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("source"))
