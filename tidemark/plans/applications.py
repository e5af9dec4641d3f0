"""Composed queries: billing, random graphs, transposition, iteration to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def call_bills(log: DataFrame, drop_last: bool = False) -> DataFrame:
    """caller, cents: of every end of a call (event 2) after a record of the same caller, 2 * seconds div 60, summed.

    log: caller, ts (seconds), event.  drop_last leaves the largest caller out.
    """
    w = Window.partitionBy("caller").orderBy("ts", "event")
    paired = log.withColumn("since", F.lag("ts").over(w))
    cost = F.when((F.col("event") == 2) & F.col("since").isNotNull(), F.expr("(2 * (ts - since)) div 60")).otherwise(0)
    bills = paired.withColumn("cost", cost).groupBy("caller").agg(F.sum("cost").alias("cents"))
    return bills.join(F.broadcast(bills.agg(F.max("caller").alias("_last"))), F.col("caller") != F.col("_last"), "left_semi") if drop_last else bills


def bill_text(bills: DataFrame) -> DataFrame:
    return bills.select(F.format_string("%d; %d EUR %d ct", "caller", F.expr("cents div 100"), F.col("cents") % 100).alias("line"))


def call_log(spark: SparkSession, callers: int, calls: int, seed: int) -> DataFrame:
    """caller, ts, event of random calls that do not overlap; the same seed gives the same log."""
    one = spark.range(callers).select(F.col("id").alias("caller"), F.explode(F.sequence(F.lit(0), F.lit(calls - 1))).alias("n"))
    rnd = F.pmod(F.xxhash64("caller", "n", F.lit(seed)), F.lit(1800))
    start = F.col("n") * 3600 + rnd
    ends = F.array(F.struct(start.alias("ts"), F.lit(1).alias("event")), F.struct((start + F.pmod(rnd * 7, F.lit(1700)) + 1).alias("ts"), F.lit(2).alias("event")))
    return one.select("caller", F.explode(ends).alias("x")).select("caller", "x.ts", "x.event")


def random_edges(pairs: DataFrame) -> DataFrame:
    """src, dst: no loops, each edge once, in order."""
    return pairs.where("src <> dst").select("src", "dst").distinct().orderBy("src", "dst")


def transposed(values: DataFrame, rows: int, columns: int) -> DataFrame:
    """idx, v of a row-major rows x columns array turned into columns x rows."""
    return values.select(F.expr(f"(idx % {columns}) * {rows} + idx div {columns}").alias("idx"), "v")


def until_fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """step applied until it leaves the frame's count and sum of hashes as they are, or `rounds` times."""

    def state(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first())

    now = state(df)
    for _ in range(rounds):
        df = keep(step(df))
        new = state(df)
        if new == now:
            break
        now = new
    return df
