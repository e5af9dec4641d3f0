"""Dense linear algebra on coordinate frames: matrices (i, j, v), vectors (i, v).  Cells that are missing are zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elementwise(a: DataFrame, b: DataFrame, op, on: tuple[str, ...] = ("i", "j")) -> DataFrame:
    zero = F.lit(0.0)
    both = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), list(on), "full_outer")
    return both.select(*on, op(F.coalesce("_a", zero), F.coalesce("_b", zero)).alias("v"))


def add(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("i", "j")) -> DataFrame:
    return elementwise(a, b, lambda x, y: x + y, on)


def subtract(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("i", "j")) -> DataFrame:
    return elementwise(a, b, lambda x, y: x - y, on)


def scale(a: DataFrame, factor: float | Column) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a * b by cells: right for sparse frames; dense ones are better served by multiply_blocked."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def multiply_blocked(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """a * b by square blocks: cells meet in their block, blocks are multiplied by NumPy and partial products summed.

    A block has block * block cells at most, so a task's memory does not depend on the matrices.
    """

    def blocks(df: DataFrame, r: str, c: str) -> DataFrame:
        lists = [F.collect_list(x).alias(f"{n}_{r}") for n, x in (("at", F.expr(f"int((i % {block}) * {block} + j % {block})")), ("v", F.col("v").cast("double")))]
        return df.where("v is not null").groupBy(F.expr(f"i div {block}").alias(r), F.expr(f"j div {block}").alias(c)).agg(*lists)

    pairs = blocks(a, "bi", "bk").join(blocks(b, "bk", "bj"), "bk")

    def dense(at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v, block * block).reshape(block, block)

    def run(batches):
        for pdf in batches:
            for bi, bj, *x in zip(*(pdf[c] for c in ("bi", "bj", "at_bi", "v_bi", "at_bk", "v_bk")), strict=True):
                out = dense(x[0], x[1]) @ dense(x[2], x[3])
                r, c = np.nonzero(out)
                yield pd.DataFrame({"i": r + bi * block, "j": c + bj * block, "v": out[r, c]})

    return pairs.select("bi", "bj", "at_bi", "v_bi", "at_bk", "v_bk").mapInPandas(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def times_column(a: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix (i, j, v) times column (i, v): i, v."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def row_times(x: DataFrame, a: DataFrame) -> DataFrame:
    """Row (i, v) times matrix: i (column of the matrix), v."""
    return times_column(transpose(a), x)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("_y")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("_y")), F.lit(0.0)).alias("v"))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    """Column times row: every cell is asked for, so the result is the product of the sizes."""
    return x.select("i", F.col("v").alias("_x")).crossJoin(y.select(F.col("i").alias("j"), F.col("v").alias("_y"))).select("i", "j", (F.col("_x") * F.col("_y")).alias("v"))
