"""Replay of operation logs (grp, seq, op, v): stacks, queues, deques and priority queues.

Stacks and queues are matched by windows within a group.  Interleaved priority queues and deques
depend on all that went before; each group's log is replayed in order by one task, which holds that
group's log.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_index


def stack_pops(log: DataFrame) -> DataFrame:
    """grp, seq, v of every pop: the last push not yet popped; null where the stack is empty."""
    w = Window.partitionBy("grp").orderBy("seq")
    step = F.when(F.col("op") == "push", 1).otherwise(-1)
    total = log.withColumn("_sum", F.sum(step).over(w))
    # Pops of an empty stack do not lower it: the lowest sum so far is the floor.
    low = total.withColumn("_low", F.least(F.min("_sum").over(w), F.lit(0)))
    depth = low.withColumn("_depth", F.col("_sum") - F.col("_low")).withColumn("_miss", (F.col("op") == "pop") & (F.col("_low") < F.coalesce(F.lag("_low").over(w), F.lit(0))))
    level = depth.withColumn("_level", F.when(F.col("op") == "push", F.col("_depth")).otherwise(F.col("_depth") + 1))
    at = Window.partitionBy("grp", "_level").orderBy("seq")
    found = level.where("not _miss").withColumn("_v", F.lag("v").over(at)).where("op = 'pop'").select("grp", "seq", F.col("_v").alias("v"))
    missed = level.where("_miss").select("grp", "seq", F.lit(None).cast(log.schema["v"].dataType).alias("v"))
    return found.unionByName(missed)


def queue_pops(log: DataFrame) -> DataFrame:
    """grp, seq, v of every pop: the oldest push not yet popped; null where the queue is empty.

    The n-th pop that finds something takes the n-th push.
    """
    w = Window.partitionBy("grp").orderBy("seq")
    step = F.when(F.col("op") == "push", 1).otherwise(-1)
    total = log.withColumn("_sum", F.sum(step).over(w)).withColumn("_low", F.least(F.min("_sum").over(w), F.lit(0)))
    total = total.withColumn("_miss", (F.col("op") == "pop") & (F.col("_low") < F.coalesce(F.lag("_low").over(w), F.lit(0))))
    order = Window.partitionBy("grp", "op").orderBy("seq")
    hits = total.where("not _miss").withColumn("_n", F.row_number().over(order))
    pops = hits.where("op = 'pop'").select("grp", "seq", "_n")
    pushes = hits.where("op = 'push'").select("grp", "_n", "v")
    missed = total.where("_miss").select("grp", "seq", F.lit(None).cast(log.schema["v"].dataType).alias("v"))
    return pops.join(pushes, ["grp", "_n"], "left").select("grp", "seq", "v").unionByName(missed)


def _replay(log: DataFrame, make: Callable[[], Callable[[str, float], float | None]]) -> DataFrame:
    """grp, seq, v of every operation that answers (make() gives a group's machine: op, v -> answer or None for no row)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = make()
        for pdf in batches:
            out = [(key[0], s, a[0]) for s, o, v in zip(pdf["seq"], pdf["op"], pdf["v"], strict=True) if (a := machine(o, v)) is not None]
            if out:
                yield pd.DataFrame(out, columns=["grp", "seq", "v"])

    shape = f"grp {log.schema['grp'].dataType.simpleString()}, seq bigint, v double"
    ordered = log.select("grp", F.col("seq").cast("bigint").alias("seq"), "op", F.col("v").cast("double").alias("v"))
    return ordered.groupBy("grp").applyInPandas(_sorted(run), shape)


def _sorted(run: Callable) -> Callable:
    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(run(key, iter([pdf.sort_values("seq", kind="stable")])))
        return pd.concat(out) if out else pd.DataFrame({"grp": [], "seq": [], "v": []})

    return whole


def priority_queue_pops(log: DataFrame, largest: bool = True) -> DataFrame:
    """grp, seq, v of every pop of an interleaved push and pop log; null where the queue is empty."""

    def make() -> Callable:
        heap: list[float] = []
        sign = -1 if largest else 1

        def machine(op: str, v: float):
            if op == "push":
                heapq.heappush(heap, sign * v)
                return None
            return (sign * heapq.heappop(heap),) if heap else (None,)

        return machine

    return _replay(log, make)


def deque_pops(log: DataFrame) -> DataFrame:
    """Answers of push_front, push_back, pop_front and pop_back; null where the deque is empty."""

    def make() -> Callable:
        held: deque[float] = deque()

        def machine(op: str, v: float):
            if op == "push_front":
                held.appendleft(v)
            elif op == "push_back":
                held.append(v)
            else:
                return ((held.popleft() if op == "pop_front" else held.pop()) if held else None,)
            return None

        return machine

    return _replay(log, make)


def addressable_fifo(log: DataFrame) -> DataFrame:
    """k, place of the keys left after a log of ins (moves to the back) and del (seq, op, k)."""
    last = log.groupBy("k").agg(F.max(F.struct("seq", "op")).alias("x")).where("x.op = 'ins'")
    return with_index(last.select("k", F.col("x.seq").alias("_seq")), ["_seq"], "place", 1).select("k", "place")


def addressable_priority(log: DataFrame) -> DataFrame:
    """k, v, place of the keys left after a log of ins (sets the priority v) and del; smallest first, ties by key."""
    last = log.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("x")).where("x.op = 'ins'")
    return with_index(last.select("k", F.col("x.v").alias("v")), ["v", "k"], "place", 1)
