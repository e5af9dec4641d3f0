"""Pipeline nodes: map, project, drop consecutive duplicates, cut, overwrite a prefix."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Key, keys, with_index, with_previous
from tidemark.session import staged


def transform(op: Callable[..., Column], *inputs: tuple[DataFrame, Sequence[Key], str], alias: str = "value") -> DataFrame:
    """op over the named columns of any number of frames zipped by position: idx and alias."""
    numbered = [with_index(df, order).select("idx", F.col(c).alias(f"_in{n}")) for n, (df, order, c) in enumerate(inputs)]
    return reduce(lambda a, b: a.join(b, "idx"), numbered).select("idx", op(*(F.col(f"_in{n}") for n in range(len(inputs)))).alias(alias))


def choose(df: DataFrame, k: int) -> DataFrame:
    """The k-th component (from 1) of every row."""
    return df.select(df.columns[k - 1])


def unique(df: DataFrame, values: Sequence[str], order_by: Sequence[Key], within: Sequence[str] = ()) -> DataFrame:
    """Rows that differ from the row before (of their group) in `values`; nulls equal each other."""
    own = with_previous(df, list(dict.fromkeys([*values, *within])), [*within, *order_by], "_before")
    same = F.col("_before").isNotNull()
    for c in (*values, *within):
        same = same & F.col(f"_before.{c}").eqNullSafe(F.col(c))
    return own.where(~same).drop("_before")


def unique_by(df: DataFrame, like: Callable[[object, object], bool], value: str, order_by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows whose value is not `like` the value at the head of their run.

    like need not be transitive, so each group of `within` is read in order by one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order_by), kind="stable")
        keep, head = [], None
        for n, v in enumerate(pdf[value]):
            if n and like(head, v):
                keep.append(False)
            else:
                keep.append(True)
                head = v
        return pdf[keep]

    return df.groupBy(*within).applyInPandas(run, df.schema)


def cut(df: DataFrame, n: int, order_by: Sequence[Key]) -> DataFrame:
    """The first n rows, or fewer."""
    return df.orderBy(*keys(order_by)).limit(n)


def overwrite_prefix(target: DataFrame, new: DataFrame, value: str, order_by: Sequence[Key], new_order: Sequence[Key], limit: int | None = None) -> DataFrame:
    """target (idx, value) with its first values replaced by those of new; the rest keep theirs."""
    old = with_index(target, order_by)
    fresh = with_index(new, new_order).select("idx", F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    if limit is not None:
        fresh = fresh.where(F.col("idx") < limit)
    return old.join(fresh, "idx", "left").withColumn(value, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_hit")


def discard(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def mutate_range(df: DataFrame, value: str, change: Callable[[Column], Column], begin: int, end: int) -> DataFrame:
    """value changed where begin <= idx < end."""
    return df.withColumn(value, F.when((F.col("idx") >= begin) & (F.col("idx") < end), change(F.col(value))).otherwise(F.col(value)))


def find(df: DataFrame, value: str, wanted: object) -> DataFrame:
    """One row: the first idx whose value equals wanted, or the number of rows."""
    return df.agg(F.coalesce(F.min(F.when(F.col(value) == F.lit(wanted), F.col("idx"))), F.count("*")).alias("position"))


def filtered(df: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where drop does not hold, and one row with the number of those where it does."""
    return df.where(~F.coalesce(drop, F.lit(False))), df.agg(F.count_if(drop).alias("dropped"))


def node_outputs(df: DataFrame, **outputs: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Several outputs of one node: its rows are computed and written once, and every output reads them there."""
    own = staged(df, "node")
    return {name: f(own) for name, f in outputs.items()}
