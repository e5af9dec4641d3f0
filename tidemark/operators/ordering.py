"""Order as data: dense positions, the row before, running folds, and positional zips.

Frames have no order of their own, so every operator that depends on one takes `order_by`: columns or sort
expressions that together are unique.  Plain column names sort nulls last.

All of them share one plan, at every size and for every order: rows are dealt by ranges of the order
(bounds from Spark's own sample), sorted within their range and written once; what a range needs from the ranges
before it is one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import partitions, staged

Key = str | Column


def keys(order_by: Sequence[Key]) -> list[Column]:
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in order_by]


def ranged(df: DataFrame, order_by: Sequence[Key], ranges: int | None = None) -> DataFrame:
    """df with _part (its range) and _at (ascending in the order, consecutive within a range), written once."""
    by = keys(order_by)
    ordered = df.repartitionByRange(ranges or partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    return staged(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def _before(per_range: DataFrame, value: Column, *others: str) -> DataFrame:
    """_part, others and _carry: value over the rows of all ranges before; per_range has one row a range, so one task holds it."""
    return per_range.select("_part", *others, value.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))


def with_index(df: DataFrame, order_by: Sequence[Key], name: str = "idx", start: int = 0, ranges: int | None = None) -> DataFrame:
    """df with its dense position in the order, from start."""
    own = ranged(df, order_by, ranges)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = _before(sizes, F.sum("_n"), "_first")
    index = F.col("_at") - F.col("_first") + F.coalesce("_carry", F.lit(0)) + start
    return own.join(F.broadcast(before), "_part").withColumn(name, index.cast("bigint")).select(*df.columns, name)


def with_previous(df: DataFrame, values: Sequence[str], order_by: Sequence[Key], name: str, ranges: int | None = None) -> DataFrame:
    """df with a struct of the values of the row before; null at the first row."""
    own = ranged(df, order_by, ranges)
    row = F.struct(*values)
    last = own.groupBy("_part").agg(F.max_by(row, "_at").alias("_last"), F.min("_at").alias("_first"))
    carry = last.select("_part", "_first", F.lag("_last").over(Window.orderBy("_part")).alias("_carry"))
    lag = F.lag(row).over(Window.partitionBy("_part").orderBy("_at"))
    out = own.withColumn(name, lag).join(F.broadcast(carry), "_part")
    return out.withColumn(name, F.when(F.col("_at") == F.col("_first"), F.col("_carry")).otherwise(F.col(name))).select(*df.columns, name)


FOLDS = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, value: str, order_by: Sequence[Key], name: str, fold: str = "sum", ranges: int | None = None) -> DataFrame:
    """df with the fold (sum, min or max) of value over all rows up to its own; nulls are passed over."""
    whole, two = FOLDS[fold]
    own = ranged(df, order_by, ranges)
    carry = _before(own.groupBy("_part").agg(whole(value).alias("_v")), whole("_v"))
    here = whole(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = own.withColumn(name, here).join(F.broadcast(carry), "_part")
    return out.withColumn(name, F.coalesce(two(F.col(name), F.col("_carry")), F.col(name), F.col("_carry"))).select(*df.columns, name)


def zip_frames(*frames: tuple[DataFrame, Sequence[Key]], name: str = "idx") -> DataFrame:
    """Rows of all frames side by side by position; it ends with the shortest.  Column names must differ."""
    numbered = [with_index(df, order, name) for df, order in frames]
    return reduce(lambda a, b: a.join(b, name), numbered)


def concatenate(*frames: DataFrame, name: str = "src") -> DataFrame:
    """All rows of the first frame, then of the second, and so on: name is the frame's number, to sort by first."""
    return reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(n)) for n, df in enumerate(frames)))


def physical_index(df: DataFrame, name: str = "place") -> DataFrame:
    """df with the place that its rows really have, from 0: written by its tasks as they are, read back by task and row."""
    return with_index(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], name).drop("_row")
