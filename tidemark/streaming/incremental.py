"""Structured Streaming forms of the batch operators.  On a finished input they give the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import upsert


def read_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_of_key(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first arrival of every key; state older than the watermark goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(window, *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sorted_batches(stream: DataFrame, by: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch sorted on its own, as runs to be merged later."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(df.orderBy(*by), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_upserts(stream: DataFrame, key: str, seq: str, path: str, checkpoint: str):
    """A keyed store in alternating folders of path: after each micro-batch the newest row (largest seq) of every key.

    The folder is named by the batch, so a batch that is run again writes the same store again.
    """

    def merge(df: DataFrame, n: int) -> None:
        newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("x")).select("x.*")
        if n:
            newest = upsert(df.sparkSession.read.parquet(f"{path}/{n - 1}"), newest, key)
        newest.write.mode("overwrite").parquet(f"{path}/{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def top_k_table(stream: DataFrame, k: int, by: list, name: str, checkpoint: str):
    """The k best rows so far, in the memory table `name`."""
    return stream.groupBy(*stream.columns).count().drop("count").orderBy(*by).limit(k).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
