"""Sinks: part files in order, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_index


def export_parts(df: DataFrame, path: str, parts: int, *by: str) -> None:
    """Parquet part files that hold consecutive ranges of the order."""
    df.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, separator: str = " ") -> None:
    df.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_in_place(spark: SparkSession, path: str) -> DataFrame:
    """Rows of part files with place (from 0): the order of the files' names, then of the rows in them."""
    own = spark.read.parquet(path)
    return with_index(own.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")), ["_file", "_row"], "place").drop("_file", "_row")


def copy_sorted(spark: SparkSession, source: str, target: str, parts: int, *by: str) -> None:
    """A copy of parquet files whose part files, read in the order of their names, are sorted."""
    export_parts(spark.read.parquet(source), target, parts, *by)


def write_buckets(df: DataFrame, path: str, buckets: int, *by: str) -> None:
    """Rows dealt by the hash of `by` into folders bucket=0, 1, ...: each is written by one buffered writer."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
