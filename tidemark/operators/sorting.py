"""Sorts, merges, top-k, shuffles and order checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import Key, keys, with_index, with_previous


def sort(df: DataFrame, by: Sequence[Key], stable_by: Sequence[Key] = ()) -> DataFrame:
    """Rows in order; stable_by (the order before) makes equal keys keep theirs."""
    return df.orderBy(*keys(by), *keys(stable_by))


def sorted_runs(df: DataFrame, by: Sequence[str], runs: int) -> DataFrame:
    """Range-partitioned, sorted runs with their number in `run`."""
    return df.repartitionByRange(runs, *by).sortWithinPartitions(*keys(by)).withColumn("run", F.spark_partition_id())


def merge_runs(runs: Sequence[DataFrame], by: Sequence[Key]) -> DataFrame:
    """Rows of all runs in one order; equal keys come in the order of their runs."""
    numbered = [r.withColumn("run", F.lit(n)) for n, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, numbered).orderBy(*keys(by), "run")


def top_k(df: DataFrame, k: int, by: Sequence[Key]) -> DataFrame:
    return df.orderBy(*keys(by)).limit(k)


def top_k_per(df: DataFrame, k: int, within: Sequence[str], by: Sequence[Key]) -> DataFrame:
    """The first k rows of every group, with `place` from 1; the planner limits groups before the shuffle."""
    w = Window.partitionBy(*within).orderBy(*keys(by))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pop_limit(df: DataFrame, value: str, limit: object, most: int, order_by: Sequence[Key]) -> tuple[DataFrame, DataFrame]:
    """Rows strictly better (smaller) than limit, at most `most`, and one row telling whether those are all."""
    better = df.where(F.col(value) < F.lit(limit))
    return better.orderBy(*keys(order_by)).limit(most), better.agg((F.count("*") <= most).alias("complete"))


def random_shuffle(df: DataFrame, order_by: Sequence[str], seed: int, begin: int = 0, end: int | None = None) -> DataFrame:
    """df with idx permuted within [begin, end); positions outside keep their rows.  The same seed gives the same order."""
    own = with_index(df, order_by)
    inside = (F.col("idx") >= begin) & (F.lit(True) if end is None else F.col("idx") < end)
    moved = with_index(own.where(inside).withColumn("_key", F.xxhash64("idx", F.lit(seed))), ["_key", "idx"], "_place", begin)
    return moved.withColumn("idx", F.col("_place")).drop("_key", "_place").unionByName(own.where(~inside))


def is_sorted(df: DataFrame, value: Column, order_by: Sequence[Key], within: Sequence[str] = ()) -> DataFrame:
    """One row (for each group): whether value never falls in the order; nulls are passed over."""
    own = with_previous(df.withColumn("_v", value), ["_v", *within], [*within, *order_by], "_before")
    same = F.lit(True)
    for c in within:
        same = same & F.col(f"_before.{c}").eqNullSafe(F.col(c))
    fine = F.coalesce(F.every(F.coalesce((F.col("_before._v") <= F.col("_v")) | ~same, F.lit(True))), F.lit(True)).alias("is_sorted")
    return own.groupBy(*within).agg(fine) if within else own.agg(fine)


def is_heap(df: DataFrame, value: str) -> DataFrame:
    """One row: no parent (position (i - 1) div 2) is smaller than its child."""
    child = df.where("idx > 0").select(F.expr("(idx - 1) div 2").alias("p"), F.col(value).alias("c"))
    return child.join(df.select(F.col("idx").alias("p"), F.col(value).alias("v")), "p").agg(F.coalesce(F.every(F.col("v") >= F.col("c")), F.lit(True)).alias("is_heap"))


def check_runs(runs: DataFrame, run: str, value: Column, place: str) -> DataFrame:
    """run, is_sorted and first (its trigger value) of every run; place: the column that tells where a row really stands."""
    checked = is_sorted(runs, value, [place], [run])
    return checked.join(runs.groupBy(run).agg(F.min_by(value, place).alias("first")), run)


def limit_session(queue: DataFrame, pushes: DataFrame, value: str, seq: str, limit: object) -> tuple[DataFrame, DataFrame]:
    """Pop everything better (smaller) than limit while rows are pushed: the popped rows with step, and the queue that is left.

    pushes come at their seq, one pop after each (and pops at the end until nothing is below limit).  step: the number of
    pushes before the row can have been popped, so 0 for rows that were there; a row below limit pushed within the session is popped in it.
    """
    every = queue.withColumn("step", F.lit(0).cast("bigint")).unionByName(with_index(pushes, [seq], "step", 1).drop(seq))
    below = F.coalesce(F.col(value) < F.lit(limit), F.lit(False))
    return every.where(below), every.where(~below).drop("step")


def aggregate_push(pushes: DataFrame, size: int, seq: str) -> DataFrame:
    """pushes with flush: the number (from 0) of the batch of `size` rows in which each reaches the queue, in the order of seq."""
    return with_index(pushes, [seq], "_n").withColumn("flush", F.floor(F.col("_n") / size).cast("bigint")).drop("_n")


def merge_recursively(runs: Sequence[DataFrame], by: Sequence[Key], factor: int) -> DataFrame:
    """Rows of all runs in one order, merged `factor` runs at a time; equal rows come in the order of their runs."""
    numbered = [r.withColumn("run", F.lit(n)) for n, r in enumerate(runs)]
    while len(numbered) > 1:
        numbered = [reduce(DataFrame.unionByName, numbered[lo : lo + factor]).sort(*keys(by), "run") for lo in range(0, len(numbered), factor)]
    return numbered[0]


def compare(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: order (-1, 0, 1) of two indexed sequences, first difference first, shorter first."""
    x, y = a.select("idx", F.col(value).alias("x"), F.lit(1).alias("in_a")), b.select("idx", F.col(value).alias("y"), F.lit(1).alias("in_b"))
    both = x.join(y, "idx", "full_outer")
    sign = F.when(F.col("in_a").isNull(), -1).when(F.col("in_b").isNull(), 1).when(F.col("x") < F.col("y"), -1).when(F.col("x") > F.col("y"), 1).otherwise(0)
    return both.select("idx", sign.alias("s")).agg(F.coalesce(F.min_by("s", F.when(F.col("s") != 0, F.col("idx"))), F.lit(0)).alias("sign"))


class Sorter:
    """push rows, sort, read them any number of times."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str, by: Sequence[Key]):
        self.by, self._spark, self._schema = by, spark, schema
        self.clear()

    def clear(self) -> None:
        self._in, self._out, self._read = [], None, 0

    def push(self, rows: DataFrame) -> None:
        if self._out is not None:
            raise RuntimeError("push after sort: clear first")
        self._in.append(rows)

    def sort(self) -> None:
        if self._out is None:
            every = reduce(DataFrame.unionByName, self._in) if self._in else self._spark.createDataFrame([], self._schema)
            self._out = every.orderBy(*keys(self.by))

    def rows(self) -> DataFrame:
        if self._out is None:
            raise RuntimeError("rows before sort")
        return self._out

    def next(self, n: int) -> DataFrame:
        """The next n rows."""
        out = self.rows().offset(self._read).limit(n)
        self._read += n
        return out

    def rewind(self) -> None:
        self.rows()
        self._read = 0

    def size(self) -> int:
        """Rows pushed; after sort, rows not yet read."""
        every = sum(x.count() for x in self._in)
        return every if self._out is None else max(0, every - self._read)
